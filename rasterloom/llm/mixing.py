"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources they belong to. A pattern has a
capacity of its words for each repetition, each repetition costing more than the one before, and an
arc to each of its sources; a source passes its quota on to the sink. The cheapest flow says how
many words of each pattern the mix takes. Documents are then selected in a seeded hash order: whole
repetitions of a pattern first, then a subset whose words come to the remainder.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, prepare

WEIGHTS = (3, 1, 2)
#: Bits of a seeded hash by which each step of the selection's histogram tells a pattern's documents apart.
STEP = 12
#: The remainder's last words are looked for among at least so many documents after the cut, and a step follows while they are more than EDGE_ROWS.
EDGE_DOCS, EDGE_ROWS = 256, 50_000
#: Patterns that the flow routes one by one. Documents of others, of fewer words, are routed by one of their sources.
MAX_PATTERNS = 2_000
#: Selected documents that are broadcast, at most; more are joined by shuffling.
BROADCAST_ROWS = 100_000


def targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Shares of ``total`` by weight; none above ``cap`` times its size, the excess shared anew by weight."""
    out, open_, left = {}, {k for k in sizes if sizes[k] >= 0}, float(total)
    while open_:
        w = math.fsum(weights[k] for k in open_)
        over = {k for k in open_ if left * weights[k] / w > cap * sizes[k]}
        if not over:
            out |= {k: left * weights[k] / w for k in open_}
            break
        out |= {k: float(cap * sizes[k]) for k in over}
        left -= math.fsum(out[k] for k in over)
        open_ -= over
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (tail, head, capacity, cost >= 0) of a cheapest maximum flow, by successive shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    head, cap, cost = [], [], []
    for a, b, c, w in arcs:
        graph[a].append(len(head))
        head.append(b), cap.append(c), cost.append(w)
        graph[b].append(len(head))
        head.append(a), cap.append(0), cost.append(-w)
    potential = [0] * n
    while True:
        far, via = [math.inf] * n, [-1] * n
        far[source], queue = 0, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in graph[u]:
                if cap[e] > 0 and (x := d + cost[e] + potential[u] - potential[head[e]]) < far[head[e]]:
                    far[head[e]], via[head[e]] = x, e
                    heapq.heappush(queue, (x, head[e]))
        if far[sink] == math.inf:
            return [cap[i + 1] for i in range(0, len(cap), 2)]
        potential = [p + (d if d < math.inf else 0) for p, d in zip(potential, far)]
        push, v = math.inf, sink
        while v != source:
            push, v = min(push, cap[via[v]]), head[via[v] ^ 1]
        v = sink
        while v != source:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = head[via[v] ^ 1]


def plan(patterns: dict[tuple, int], weights: tuple[int, ...], share: float, cap: int, sizes: dict | None = None) -> tuple[dict, dict, dict]:
    """From words by pattern (a sorted tuple of sources): words to take by pattern, and size and target by source.

    ``sizes`` gives the words by source where the patterns don't tell them.
    """
    names = sorted(sizes or {s for p in patterns for s in p}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sizes[s] if sizes else sum(n for p, n in patterns.items() if s in p) for s in names}
    goal = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(patterns.values()), cap)
    order = list(patterns)
    first_source, sink = 1 + len(order), 1 + len(order) + len(names)
    at = {s: first_source + i for i, s in enumerate(names)}
    arcs = [(0, 1 + i, patterns[p], 2 * r + 1) for r in range(cap) for i, p in enumerate(order)]  # convex: the r-th repetition costs 2r + 1
    arcs += [(1 + i, at[s], cap * patterns[p], 0) for i, p in enumerate(order) for s in p]
    arcs += [(at[s], sink, round(goal[s]), 0) for s in names]
    flow = min_cost_flow(sink + 1, arcs, 0, sink)
    taken = {p: sum(flow[r * len(order) + i] for r in range(cap)) for i, p in enumerate(order)}
    return taken, sizes, goal


def n_words(text) :
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _edge(rows: pd.DataFrame) -> pd.DataFrame:
    """Fill a pattern's remaining words from the documents after the cut, in seeded order."""
    rows = rows.sort_values(["__h", "doc_id", "size", "__t"], kind="stable", na_position="last")
    gap, took = int(rows["gap"].iloc[0]), []
    for size in rows["units"].tolist():
        took.append(size <= gap)
        gap -= size if took[-1] else 0
    left = rows[[not t for t in took]]
    if gap > 0 and len(left):
        nearest = (left["units"] - gap).abs()
        i = nearest.idxmin()
        if nearest[i] < gap:
            took[rows.index.get_loc(i)] = True
    rows["more"] = took
    return rows[["__h", "doc_id", "size", "__t", "more"]]


def _routed(found: DataFrame, seed: int) -> DataFrame:
    """``found(__p, __s, words)`` with the pattern ``__q`` that routes each: itself, or one of its sources for those after the first MAX_PATTERNS by words."""
    large = found.orderBy(F.desc("words"), "__p").limit(MAX_PATTERNS).select("__p", F.lit(True).alias("large"))
    one = F.array(F.element_at("__s", (F.pmod(F.xxhash64(F.lit(seed), "__p"), F.size("__s")) + 1).cast("int")))
    return found.join(large, "__p", "left").withColumn("__r", F.when(F.col("large"), F.col("__s")).otherwise(one)).withColumn("__q", _key("__r"))


def _key(sources: str):
    return F.to_json(F.struct(F.col(sources).alias("s")), {"ignoreNullFields": "false"})


def _cuts(spark: SparkSession, thin: DataFrame, rest: dict[str, int]) -> dict[str, tuple[int, int, int]]:
    """By pattern: the first and last hash of the edge, and the words that are left for it.

    Documents with smaller hashes are all in. Histograms over ranges of the hash find the range in
    which the remainder ends, each step in the range that the one before found, until the edge is small.
    """
    state = {p: (-(2**63), 2**63 - 1, n) for p, n in rest.items() if n > 0}
    open_ = set(state)
    for shift in range(64 - STEP, -1, -STEP):
        if not open_:
            break
        bounds = spark.createDataFrame([(p, *state[p]) for p in sorted(open_)], "__q string, lo long, hi long, rest long")
        inside = thin.join(F.broadcast(bounds), "__q").where("__h BETWEEN lo AND hi")  # MAX_PATTERNS rows and one for each source
        hist = inside.groupBy("__q", F.shiftright("__h", shift).alias("b")).agg(F.first("rest").alias("rest"), F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("n"))
        run = Window.partitionBy("__q").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** STEP rows
        cum = hist.withColumns({"to": F.sum("words").over(run), "rows": F.sum("n").over(run)})
        cut = cum.where("to > rest").groupBy("__q").agg(F.min_by(F.struct("b", (F.col("rest") - F.col("to") + F.col("words")).alias("left"), (F.col("rows") - F.col("n")).alias("seen"), "n"), "b").alias("c"))
        ends = cum.join(cut, "__q").where((F.col("b") >= F.col("c.b")) & (F.col("rows") >= F.col("c.seen") + EDGE_DOCS)).groupBy("__q").agg(F.min_by(F.struct("b", "rows"), "b").alias("e"))
        for r in cut.join(ends, "__q", "left").collect():  # a row for each open pattern
            c, e, (_, hi, _) = r["c"], r["e"], state[r["__q"]]
            if c["n"] > EDGE_ROWS:  # on in this range alone
                state[r["__q"]] = c["b"] << shift, (c["b"] << shift) + (1 << shift) - 1, c["left"]
                continue
            state[r["__q"]] = c["b"] << shift, (e["b"] << shift) + (1 << shift) - 1 if e else hi, c["left"]
            open_.discard(r["__q"])
    return state


def mix(spark: SparkSession, docs: DataFrame, sources: str = "sources", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (``copies`` times ``size``).

    ``sources`` names an array column: the document's membership pattern (null elements are a
    source of their own; repeated ones count once; a null or empty array is the null source). Sources in
    code point order, null last, weigh ``weights``, repeating; targets sum to ``share`` times all
    words, none above ``cap`` times its source's. source_size and target are those of the pattern's
    sources, summed where there are several. Null and empty texts have size 0 and are never taken.
    Rows without doc_id are documents like others. Equal rows (same doc_id and text) are taken or left
    together. An empty table gives an empty result. Input columns with the names of the new ones are replaced.

    The flow routes MAX_PATTERNS patterns, those of most words. A document of any other counts, in
    the flow, source_size and target, for one of its sources, chosen by the seed; its words are in the
    sizes of all of them. The driver sees a row for each of these patterns and for each source.
    Selection needs no sort of a source: histograms over hash ranges find the range where the
    quota ends, and only that range's documents are looked at one by one.
    """
    prepare(spark)
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    null = F.array(F.lit(None).cast("string"))
    given = F.array_sort(F.array_distinct(F.col(sources).cast("array<string>")))
    docs = docs.withColumns({"__s": F.when(F.size(given) > 0, given).otherwise(null), "size": n_words(F.col("text")), "__t": F.xxhash64("text")})
    docs = docs.withColumns({"__p": _key("__s"), "__h": F.xxhash64(F.lit(seed), "doc_id", "__t")})
    added = "__q string, source_size long, target double, __base long, __lo long"
    with Scratch(spark) as scratch:
        thin = scratch.table(docs.select("__p", "__s", "__h", "__t", "doc_id", "size"))
        found = scratch.table(thin.groupBy("__p").agg(F.first("__s").alias("__s"), F.sum("size").alias("words")))
        many = found.count() > MAX_PATTERNS
        if many:
            routed = scratch.table(_routed(found, seed))
            thin = scratch.table(thin.join(routed.select("__p", "__q"), "__p"))
            sizes = {r["s"]: r["words"] for r in routed.select(F.explode("__s").alias("s"), "words").groupBy("s").agg(F.sum("words").alias("words")).collect()}
            by_route = routed.groupBy("__q").agg(F.first("__r").alias("__s"), F.sum("words").alias("words")).collect()
        else:
            thin, sizes = thin.withColumn("__q", F.col("__p")), None
            by_route = found.select(F.col("__p").alias("__q"), "__s", "words").collect()
        by_route = sorted(by_route, key=lambda r: r["__q"])
        take, sizes, goal = plan({tuple(r["__s"]): r["words"] for r in by_route}, weights, share, cap, sizes)
        base, rest, rows = {}, {}, []
        for r in by_route:
            base[r["__q"]], rest[r["__q"]] = divmod(take[tuple(r["__s"])], r["words"]) if r["words"] else (0, 0)
        state = _cuts(spark, thin.select("__q", "__h", "size"), rest)
        for r in by_route:
            rows.append((r["__q"], sum(sizes[s] for s in r["__s"]), math.fsum(goal[s] for s in r["__s"]), int(base[r["__q"]]), state[r["__q"]][0] if r["__q"] in state else -(2**63)))
        edges = spark.createDataFrame([(p, *x) for p, x in sorted(state.items())], "__q string, lo long, hi long, gap long")
        at_edge = thin.where("size > 0").join(F.broadcast(edges), "__q").where("__h BETWEEN lo AND hi")
        at_edge = at_edge.groupBy("__q", "__h", "doc_id", "size", "__t").agg(F.first("gap").alias("gap"), F.sum("size").alias("units"))
        more = at_edge.groupBy("__q").applyInPandas(_edge, "__h long, doc_id long, size long, __t long, more boolean").where("more")
        more = scratch.keep(more.select(F.col("__h").alias("__h2"), F.col("doc_id").alias("__id2"), F.col("__t").alias("__t2"), "more"))
        routes = scratch.keep(routed.select("__p", "__q")) if many else None
    docs = docs.join(routes, "__p") if many else docs.withColumn("__q", F.col("__p"))
    docs = docs.join(F.broadcast(spark.createDataFrame(rows, added)), "__q")  # MAX_PATTERNS rows and one for each source
    more = F.broadcast(more) if more.count() <= BROADCAST_ROWS else more
    docs = docs.join(more, (F.col("__h") == F.col("__h2")) & F.col("doc_id").eqNullSafe(F.col("__id2")) & (F.col("__t") == F.col("__t2")), "left")
    copies = F.col("__base") + F.when((F.col("__h") < F.col("__lo")) | F.col("more"), 1).otherwise(0)
    docs = docs.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(copies).cast("int"))
    return docs.withColumn("taken", F.col("copies") * F.col("size")).drop("__p", "__q", "__s", "__h", "__t", "__base", "__lo", "__h2", "__id2", "__t2", "more")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.array("source").alias("sources"))
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")
