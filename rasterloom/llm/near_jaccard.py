"""N-gram Jaccard join by PartEnum signatures.

Two sets with a Jaccard similarity of at least ``t`` differ in at most ``k = (1 - t) / (1 + t)`` times
the sum of their sizes elements. A pair belongs to the band of sizes that holds its smaller set, so a set
leaves signatures in its own band and in the one below. For each band, the feature domain is dealt into
``N`` partitions by hash: at least ``N - k`` of them are then without a difference, and a set's elements in
one such partition, hashed, are a signature that both sets share.

As similar sets share ``N - k`` signatures and one suffices to find them, each set needs only those that
remain without its ``N - k - 1`` most frequent ones: whichever shared signature comes first in the order of
frequency has ``N - k - 1`` shared ones behind it, in either set. That is where passages go that many
otherwise different texts hold. Empty partitions count as the most frequent signatures of all.

Equal sets are one class with one representative before any of this. In a bucket of equal
signatures, members are first compared with its leader only, the member that shares most signatures
with others. Members that are then in one component need no comparison; the remaining ones are compared
block by block, where only links leave a block. All comparisons are exact counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, mix64, prepare, trimmed

#: Set ids that a task remembers before it starts anew, and bytes of text that are hashed at once.
MEMO, PIECE = 300_000, 1 << 16
#: Buckets of at most so many members are paired in the last comparison; sets of a block there.
SMALL_BUCKET = 32
BLOCK = 2048
#: Signatures only propose pairs, so a shorter hash costs comparisons, never links.
SIGNATURE_BITS = 48
#: Spare partitions for each one in which similar sets may differ: more leave out more frequent signatures, but cover fewer elements each.
EXTRA = 0.5


class Shingler:
    """64-bit hashes of a text's distinct word n-grams, sorted.

    A word's hash is a polynomial over its bytes' random numbers, in which capital letters have those
    of small ones; the differences of prefix sums give those of all words of a piece of text at once.
    """

    def __init__(self, n: int):
        self.n, rng = n, np.random.default_rng(7)
        self.odd = [np.uint64(x) for x in rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
        self.byte = rng.integers(0, 2**64 - 1, 256, dtype=np.uint64)
        self.byte[ord("A") : ord("Z") + 1] = self.byte[ord("a") : ord("z") + 1]
        self.space = np.zeros(256, bool)
        self.space[[*b" \t\n\v\f\r"]] = True
        self.base = int(rng.integers(0, 2**62)) * 4 + 1
        powers = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, x, np.uint64)]))
        self.power, self.back = powers(self.base), powers(pow(self.base, -1, 2**64))

    def words(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words in their order."""
        out, sizes, held, length = [], [], np.zeros(1, np.uint64), 0  # held, length: the word that the last piece ended in
        for at in range(0, len(text or b""), PIECE):
            b = np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at)
            gap = np.concatenate([[True], self.space[b], [True]])
            edge = np.flatnonzero(gap[1:] != gap[:-1])
            first, last = edge[::2], edge[1::2]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[b] * self.power[: len(b)], dtype=np.uint64)])
            h, size = (sums[last] - sums[first]) * self.back[first], last - first
            if length and len(h) and first[0] == 0:
                h[:1] = held + h[:1] * np.uint64(pow(self.base, length, 2**64))
                size[0] += length
            elif length:
                h, size = np.append(held, h), np.append(length, size)
            length = 0
            if at + PIECE < len(text) and len(h) and not gap[-2]:
                held, length, h, size = h[-1:], int(size[-1]), h[:-1], size[:-1]
            out.append(h), sizes.append(size)
        if not out:
            return np.zeros(0, np.uint64)
        return mix64(np.concatenate(out) + np.concatenate(sizes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, text: bytes | None) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        n = self.n if len(h) >= self.n else len(h)
        m = len(h) - n + 1
        out = np.full(m, n, np.uint64)
        for i in range(n):
            out = mix64(out ^ (h[i : i + m] * self.odd[i]))
        return np.unique(out)


def bands(size: int, t: float) -> range:
    """The bands (numbered by their floors) that may hold the smaller set of a similar pair in which a set of this size is."""
    ratio = 1 / t
    return range(_band(math.ceil(size * t - 1e-9), ratio), _band(size, ratio) + 1)


def _band(size: int, ratio: float) -> int:
    b = int(math.log(size) / math.log(ratio))
    while _floor(b + 1, ratio) <= size:
        b += 1
    while b and _floor(b, ratio) > size:
        b -= 1
    return b


def _floor(b: int, ratio: float) -> int:
    return math.ceil(ratio**b - 1e-9)


def differences(size: int, band: int, t: float) -> int:
    """Elements in which a set of this size differs at most from a similar one, the smaller of the two in the band."""
    top = _floor(band + 1, 1 / t) - 1
    other = math.floor(size / t + 1e-9) if size <= top else top
    return math.floor((1 - t) / (1 + t) * (size + other) + 1e-9)


def partitions(band: int, t: float) -> int:
    """Partitions of the feature domain for the band: EXTRA more for each one that similar sets may differ in."""
    k = differences(_floor(band + 1, 1 / t) - 1, band, t)
    return k + 1 + math.ceil(EXTRA * k)


def band_signatures(features: np.ndarray, t: float) -> list[tuple[int, int, np.ndarray]]:
    """(band, spare, signatures) for each of a set's bands; of the signatures, the ``spare`` most frequent ones aren't needed."""
    out = []
    mixed = mix64(features)
    for band in bands(len(features), t):
        k = differences(len(features), band, t)
        if k == 0 or _floor(band, 1 / t) == _floor(band + 1, 1 / t):  # only equal sets are similar, and those are one class already; or no size is in the band
            continue
        parts = partitions(band, t)
        at = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        order = np.argsort(at, kind="stable")
        where, starts = np.unique(at[order], return_index=True)
        sums[where] = np.add.reduceat(features[order] * np.uint64(0xD6E8FEB86659FD93), starts)
        salt = mix64(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40))
        spare = parts - k - 1 - (parts - len(where))
        if spare < 0:  # the last empty partitions go first, those before them are needed
            where = np.concatenate([where, np.setdiff1d(np.arange(parts), where)[:-spare]])
        sigs = mix64(sums[where] ^ salt[where]) >> np.uint64(64 - SIGNATURE_BITS) << np.uint64(8) | np.uint64(band & 255)
        out.append((band, max(0, spare), sigs))
    return out


def signatures(features: np.ndarray, t: float) -> np.ndarray:
    """Signatures of a set of hashes over all its bands."""
    return np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s in band_signatures(features, t))])


def bitmap(features: np.ndarray) -> bytes:
    """One bit per element hash, two to four bits an element: folding halves makes maps of different sizes comparable."""
    size = 64 << max(0, (2 * len(features) - 1).bit_length() - 6)
    out = np.zeros(size, np.uint8)
    out[(features & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """False only for sets of ``n`` and ``m`` elements that cannot link: a bit that one map alone has is an element that one set alone has."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * both >= percent * (n + m - both)


def _may_link_rows(percent: int):
    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(2, 6)))
            yield b.select([0, 1]).filter(pa.array([may_link(x, y, n, m, percent) for x, y, n, m in rows], pa.bool_()))

    return run


SET_ROWS = "doc_id long, n_shingles long, id long, bits binary, spares array<struct<band:int,spare:int>>"


def _set_rows(n: int, t: float):
    spares = pa.list_(pa.struct([("band", pa.int32()), ("spare", pa.int32())]))

    def run(batches):
        shingle = Shingler(n)
        for b in batches:
            found = [shingle(text) for text in b.column(1).cast(pa.binary()).to_pylist()]
            spare = [[{"band": band & 255, "spare": x} for band, x, _ in band_signatures(f, t)] if len(f) else [] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([_set_id(f) for f in found], pa.int64()), pa.array(map(bitmap, found), pa.binary()), pa.array(spare, spares)],
                ["doc_id", "n_shingles", "id", "bits", "spares"],
            )

    return run


def _signature_rows(n: int, t: float):
    def run(batches):
        shingle, seen = Shingler(n), set()
        for b in batches:
            ids, sigs, held = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if doc is None or not len(f := shingle(text)) or (own := _set_id(f)) in seen:  # copies in a task count once
                    continue
                if len(seen) > MEMO:
                    seen.clear()
                seen.add(own)
                s = signatures(f, t)
                ids.append(np.full(len(s), doc, np.int64))
                sigs.append(s.view(np.int64))
                held += len(s)
                if held > 100_000:
                    yield _pack(ids, sigs)
                    ids, sigs, held = [], [], 0
            yield _pack(ids, sigs)

    return run


def _set_id(features: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(features.tobytes()), "little", signed=True)


def _pack(ids, sigs):
    empty = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs or empty)), pa.array(np.concatenate(ids or empty))], ["sig", "id"])


def _shared_rows(batches):
    """Of rows sorted by (sig, id), the distinct ones whose signature another id has, too."""
    empty = np.zeros(0, np.int64)
    sig, own, shared = empty, empty, False  # the last row read, not yet given out; whether an earlier id had its sig
    for b in batches:
        s, i = np.concatenate([sig, b.column(0).to_numpy()]), np.concatenate([own, b.column(1).to_numpy()])
        if not len(s):
            continue
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        s, i = s[new], i[new]
        same = s[1:] == s[:-1]
        keep = np.concatenate([[shared], same])
        keep[:-1] |= same
        sig, own, shared = s[-1:], i[-1:], bool(same[-1]) if len(same) else shared
        yield _pack([i[:-1][keep[:-1]]], [s[:-1][keep[:-1]]])
    if len(sig) and shared:
        yield _pack([own], [sig])


def _sieve(bloom):
    """Lets rows through whose doc_id is in the filter."""

    def run(batches):
        words = bloom.value
        for b in batches:
            at = mix64(b.column(0).fill_null(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)
            yield b.filter(pa.array((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))

    return run


def _packed(n: int):
    """A set's text, compressed: a quarter of its hashes' size."""

    def run(batches):
        shingle, pack = Shingler(n), zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = [x for x in b.column(1).cast(pa.binary()).to_pylist() if x and x.split()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(shingle(x)) for x in texts], pa.int64()), pa.array([pack(x) for x in texts], pa.binary())], ["id", "packed"])

    return run


def _linked(n: int, percent: int):
    def run(batches):
        shingle, unpack, held = Shingler(n), zstandard.ZstdDecompressor().decompress, {}

        def features(id_: int, packed) -> np.ndarray:
            if (f := held.get(id_)) is None:
                if len(held) >= 64:
                    held.clear()
                f = held[id_] = shingle(unpack(packed.as_buffer()))
            return f

        for b in batches:
            keep = []
            for i, j, u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = features(i, u), features(j, v)
                union = len(np.union1d(x, y))
                keep.append(100 * (len(x) + len(y) - union) >= percent * union)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bits of the filter that lets whole texts of candidates through; of fixed size, an exact join follows.
FILTER_BITS = 1 << 25


def _needed(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """``shared(sig, id)`` without each set's spare most frequent signatures, and then without those that one set alone has."""
    often = shared.groupBy("sig").agg(F.count("*").alias("often"))
    spares = classes.select("id", F.explode("spares").alias("s")).select("id", "s.band", "s.spare")
    rows = shared.join(often, "sig").where("often > 1").withColumn("band", F.col("sig").bitwiseAND(255).cast("int")).join(spares, ["id", "band"])
    place = F.row_number().over(Window.partitionBy("id", "band").orderBy(F.desc("often"), F.desc("sig")))
    return rows.withColumn("place", place).where("place > spare").select("sig", "id")


def _id_filter(ids: DataFrame) -> np.ndarray:
    """One bit per doc_id hash, or-ed in Spark; FILTER_BITS / 8 bytes however many ids there are."""

    def words(batches):
        for b in batches:
            at = mix64(b.column(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)
            where, inverse = np.unique((at >> np.uint64(6)).astype(np.int64), return_inverse=True)
            value = np.zeros(len(where), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(value.view(np.int64))], ["w", "v"])

    got = ids.mapInArrow(words, "w long, v long").groupBy("w").agg(F.expr("bit_or(v)").alias("v")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
    return out


def _texts_of(scratch: Scratch, texts: DataFrame, classes: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, packed) of these set ids. Only the candidates' texts are shuffled."""
    wanted = scratch.table(classes.join(ids.distinct(), "id", "left_semi").select("id", F.col("rep").alias("doc_id")).where("doc_id IS NOT NULL"))
    sent = scratch.spark.sparkContext.broadcast(_id_filter(wanted.select("doc_id")))
    found = texts.mapInArrow(_sieve(sent), texts.schema).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    out = scratch.table(found.mapInArrow(trimmed(_packed(n)), "id long, packed binary").groupBy("id").agg(F.first("packed").alias("packed")))
    scratch.drop(wanted)
    return out


def _fits(x: str, y: str, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _with_leaders(scratch: Scratch, texts: DataFrame, classes: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of the bucket's members to its leader, the member that shares most signatures with others."""
    leaders = known.groupBy("sig").agg(F.max(F.struct("c", F.col("id").alias("lead"), F.col("n").alias("ln"))).alias("l")).select("sig", "l.lead", "l.ln")
    pairs = known.join(leaders, "sig").where((F.col("id") != F.col("lead")) & _fits("n", "ln", percent))
    pairs = pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    return _verify(scratch, texts, classes, pairs, n, percent)


def _verify(scratch: Scratch, texts: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link. Bitmaps rule out most of the others before any text moves."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("bits").alias(f"m{c}"), F.col("n").alias(f"n{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb", "na", "nb").mapInArrow(trimmed(_may_link_rows(percent)), "a long, b long")
    pairs = scratch.table(pairs)
    sets = _texts_of(scratch, texts, classes, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), n)
    left = sets.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    right = sets.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    out = scratch.table(pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(trimmed(_linked(n, percent)), "a long, b long"))
    scratch.drop(sets)
    return out


def _compare_blocks(n: int, percent: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links between a block of sets and another, at most one from each left set to each component."""
        a, b = [], []
        if len(left) and len(right):
            shingle, unpack, held = Shingler(n), zstandard.ZstdDecompressor().decompress, {}

            def features(id_: int, packed: bytes) -> np.ndarray:
                if id_ not in held:
                    held[id_] = shingle(unpack(packed))
                return held[id_]

            ids, comps, sizes, texts = (right[c].to_numpy() for c in ("id", "comp", "n", "packed"))
            widths = right["bits"].map(len).to_numpy()
            maps = {w: (at := np.flatnonzero(widths == w), np.array([np.frombuffer(right["bits"].iloc[i], np.uint64) for i in at])) for w in np.unique(widths)}
            for id_, comp, size, bits, packed in zip(left["id"], left["comp"], left["n"], left["bits"], left["packed"]):
                linked = set()
                for at, theirs in maps.values():
                    own = np.frombuffer(bits, np.uint64)
                    while len(own) > theirs.shape[1]:
                        own = own[: len(own) // 2] | own[len(own) // 2 :]
                    while theirs.shape[1] > len(own):
                        theirs = theirs[:, : theirs.shape[1] // 2] | theirs[:, theirs.shape[1] // 2 :]
                    m = sizes[at]
                    both = np.minimum(size - np.bitwise_count(own & ~theirs).sum(1, dtype=np.int64), m - np.bitwise_count(theirs & ~own).sum(1, dtype=np.int64))
                    for i in at[(100 * both >= percent * (size + m - both)) & (comps[at] != comp)]:
                        if comps[i] in linked:
                            continue
                        f, g = features(id_, packed), features(ids[i], texts[i])
                        union = len(np.union1d(f, g))
                        if 100 * (len(f) + len(g) - union) >= percent * union:
                            linked.add(comps[i])
                            a.append(id_)
                            b.append(ids[i])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _across(scratch: Scratch, texts: DataFrame, classes: DataFrame, known: DataFrame, comps: DataFrame, n: int, percent: int) -> DataFrame | None:
    """Links between sets that share a bucket but no component yet.

    The members of a small bucket are paired. Sets that large ones connect form a cluster: there, sets outside
    the largest component meet all sets of fitting size, block by block; bitmaps rule out most pairs, the others are
    counted exactly in the block, and only links leave it.
    """
    spark = scratch.spark
    own = known.join(comps, "id").select("sig", "id", "n", "comp")
    open_ = own.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("id").alias("first"), F.count("*").alias("size")).where("low < high")
    open_ = scratch.table(own.join(open_.select("sig", "first", "size"), "sig"))
    if not open_.limit(1).count():
        return None
    small = open_.where(F.col("size") <= SMALL_BUCKET)
    other = small.select("sig", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    pairs = small.join(other, "sig").where((F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2")) & _fits("n", "n2", percent))
    links = _verify(scratch, texts, classes, pairs.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct(), n, percent)
    open_ = open_.where(F.col("size") > SMALL_BUCKET)
    if not open_.limit(1).count():
        return links
    clusters = components(spark, open_.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), scratch)
    members = open_.groupBy("id").agg(F.first("n").alias("n"), F.first("comp").alias("comp")).join(clusters.withColumnRenamed("component", "cluster"), "id")
    members = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100 - 1e-9)).cast("int"))
    members = scratch.table(members)
    largest = members.groupBy("cluster", "comp").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    members = members.join(largest, "cluster").withColumn("rest", F.col("comp") != F.col("main")).drop("main")
    sizes = members.groupBy("cluster", "band").agg(F.ceil(F.count_if("rest") / BLOCK).cast("int").alias("lefts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("rights"))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    meets = sizes.select("cluster", F.col("band").alias("lb"), "lefts", near.alias("rb")).where("lefts > 0").join(sizes.select("cluster", F.col("band").alias("rb"), "rights"), ["cluster", "rb"])
    meets = scratch.table(meets)
    sets = _texts_of(scratch, texts, classes, members.select("id"), n)
    full = scratch.table(members.join(sets, "id").join(classes.select("id", "bits"), "id"))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    spot = lambda c: F.pmod(F.xxhash64(F.lit(3), "id"), F.col(c)).cast("int")
    left = full.where("rest").withColumnRenamed("band", "lb").join(meets, ["cluster", "lb"]).select("cluster", "lb", "rb", spot("lefts").alias("i"), span("rights").alias("j"), "id", "comp", "n", "bits", "packed")
    right = full.withColumnRenamed("band", "rb").join(meets, ["cluster", "rb"]).select("cluster", "lb", "rb", span("lefts").alias("i"), spot("rights").alias("j"), "id", "comp", "n", "bits", "packed")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    keys = ["cluster", "lb", "rb", "i", "j"]
    return links.unionByName(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare_blocks(n, percent), "a long, b long"))


def _merge(spark: SparkSession, scratch: Scratch, comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps(id, comp)`` after ``links``: the components' own graph is small."""
    edges = links.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
    labels = components(spark, edges.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    return scratch.table(comps.join(labels.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")))


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``.

    Words are ``[^\x20\x09-\x0D]+`` of the A-Z lower-cased whole text; a document's set holds its
    distinct n-grams, the whole sequence where it has fewer words. Two documents link when
    100 * intersection >= threshold * union. component_id is the smallest doc_id reachable by
    links, itself included. Null and empty texts have an empty set, link with nothing and are their
    own component. Rows without doc_id link with nothing and have a null component. Rows that repeat a doc_id are documents of their own. An empty
    table gives an empty result; other columns are left out. Sets and their elements are compared by
    64-bit hashes.
    """
    prepare(spark)
    t = threshold / 100
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(spark) as scratch:
        sets = scratch.table(texts.mapInArrow(trimmed(_set_rows(n, t)), SET_ROWS))
        classes = scratch.table(sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("spares").alias("spares")))
        rows = texts.mapInArrow(trimmed(_signature_rows(n, t)), "sig long, id long")
        rows = rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(trimmed(_shared_rows), "sig long, id long")
        by_doc = scratch.table(rows.withColumnRenamed("id", "doc_id"))
        del rows
        scratch.sweep()
        shared = scratch.table(by_doc.join(sets.where("n_shingles > 0").select("doc_id", "id"), "doc_id").select("sig", "id").distinct())
        scratch.drop(by_doc)
        every, shared = shared, scratch.table(_needed(shared, classes))
        scratch.drop(every)
        lone = shared.groupBy("sig").agg(F.count("*").alias("often")).where("often > 1").select("sig")
        every, shared = shared, scratch.table(shared.join(lone, "sig"))
        scratch.drop(every)
        counts = shared.groupBy("id").agg(F.count("*").alias("c")).join(classes.select("id", "n"), "id")
        known = scratch.table(shared.join(counts, "id"))
        scratch.drop(shared)
        comps = scratch.table(known.select("id", F.col("id").alias("comp")).distinct())
        comps = _merge(spark, scratch, comps, _with_leaders(scratch, texts, classes, known, n, threshold))
        scratch.sweep()
        if (links := _across(scratch, texts, classes, known, comps, n, threshold)) is not None:
            comps = _merge(spark, scratch, comps, links)
        least = classes.join(comps, "id", "left").select("id", "rep", F.coalesce("comp", "id").alias("comp"))
        names = least.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = least.join(names, "comp").select("id", "component_id")
        out = sets.join(named, "id", "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        return scratch.keep(out)


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without the documents that are not their component's smallest doc_id. Rows without doc_id stay."""
    groups = jaccard_components(spark, docs, n, threshold)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(spark, docs, n=3, threshold=90)
