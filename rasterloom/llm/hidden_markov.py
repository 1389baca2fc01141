"""LM scoring with a hidden Markov language model.

States emit word classes, a class emits its words by their counts: P(word | state) =
P(class | state) * (c + 0.1) / (N_class + 0.1 * (V_class + 1)). A word's class is a hash of its first
and last letters, so the model's size is bounded while the word counts grow with the corpus.
Baum-Welch starts from class counts with a seeded perturbation, runs over one in FIRST of the learning
documents until a round gains little, and from there over all of them until a round gains little:
partitions sum expected counts, Spark adds them up by class, the driver re-estimates. A text's
likelihood is the scaled forward recursion's, to its end.

Texts are encoded once, chunk by chunk, against the chunk's own vocabulary. The corpus counts of a
chunk's words come back to the chunk by a join, so no task ever holds more words than its chunk.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64, prepare, trimmed

STATES, CLASSES = 8, 8192
#: Baum-Welch ends when a round gains less than so many nats a token.
GAIN = 1e-3
#: Of so many learning documents one is in the first rounds.
FIRST = 16
#: Tokens of a chunk, and tokens whose recursions run side by side.
CHUNK, LANES = 3_000_000, 400_000
PRIOR = 20.0


def word_key(word: bytes) -> int:
    """64 bits that name a word; the low 13 are its class."""
    return (xxhash.xxh3_64_intdigest(word) & ~(CLASSES - 1)) | (zlib.crc32(word[:2] + b"\0" + word[-3:]) & (CLASSES - 1))


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunk(n: int, part: int, local: _Local, docs: list, train: list, tokens: list) -> pa.RecordBatch:
    lengths = np.array([len(t) for t in tokens], np.int32)
    flat = np.concatenate([*tokens, np.zeros(0, np.uint32)]).astype(np.uint32)
    learn = np.repeat(np.array(train, bool), lengths)
    counts = np.bincount(flat[learn], minlength=len(local)).astype(np.int32)
    keys = np.fromiter(map(word_key, local), np.uint64, len(local))
    pack = zstandard.ZstdCompressor(level=1).compress
    one = lambda x: pa.array([x], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([part << 24 | n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), one(np.array(train, np.uint8).tobytes()), one(lengths.tobytes()), one(pack(flat.tobytes())), one(keys.tobytes()), one(counts.tobytes())],
        ["chunk", "docs", "train", "lengths", "tokens", "keys", "counts"])


CHUNKS = "chunk long, docs array<long>, train binary, lengths binary, tokens binary, keys binary, counts binary"


def _encode(batches):
    from pyspark import TaskContext

    part, n, held = TaskContext.get().partitionId(), 0, 0
    local, docs, train, tokens = _Local(), [], [], []
    for b in batches:
        for doc, learn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            words = text.lower().split() if text else []
            docs.append(doc), train.append(learn)
            tokens.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
            held += len(words) + 50
            if held >= CHUNK:
                yield _chunk(n, part, local, docs, train, tokens)
                n, held, local, docs, train, tokens = n + 1, 0, _Local(), [], [], []
    if docs:
        yield _chunk(n, part, local, docs, train, tokens)


def _unpack(tokens: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(tokens), np.uint32)


def _vocabulary(batches):
    for b in batches:
        for chunk, keys, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
            k = np.frombuffer(keys, np.int64)
            for s in range(0, len(k), 100_000):
                e = min(len(k), s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(k[s:e]), pa.array(np.full(e - s, chunk)), pa.array(np.arange(s, e, dtype=np.int32)), pa.array(np.frombuffer(counts, np.int32)[s:e])], ["key", "chunk", "pos", "n"])


class Hmm:
    """``start`` (K), ``move`` (K, K), ``emit`` (CLASSES + 1, K): rows of ``move`` and columns of ``emit`` sum to 1. Class CLASSES is the end."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def estimate(cls, start, move, emit, overall):
        """From expected counts, with a prior that leaves nothing impossible."""
        emit = (emit + PRIOR * overall[:, None]) / (emit.sum(0) + PRIOR)
        move = (move + 0.1) / (move + 0.1).sum(1, keepdims=True)
        start = (start + 0.1) / (start + 0.1).sum()
        return cls(start, move, emit)

    def prior(self, overall) -> float:
        """Log density of the prior of :meth:`estimate`, up to a constant. With the log likelihood, it is what no round lowers."""
        return PRIOR * float(overall @ np.log(self.emit).sum(1)) + 0.1 * float(np.log(self.move).sum() + np.log(self.start).sum())


def lanes(sequences: list[np.ndarray]):
    """Index groups of sequences of like lengths, about LANES tokens each."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    group: list[int] = []
    for i in order:
        if group and (len(group) + 1) * len(sequences[group[0]]) > LANES:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


class Space(dict):
    """Arrays that outlive a call, so that their memory is touched once for a task."""

    def array(self, name: str, shape: tuple, kind) -> np.ndarray:
        size, held = int(np.prod(shape)), self.get(name)
        if held is None or held.size < size or held.dtype != kind:
            self[name] = held = np.zeros(size, kind)
        return held[:size].reshape(shape)


def recursion(model: Hmm, sequences: list[np.ndarray], learn: bool, space: Space | None = None):
    """Natural-log likelihoods and, if ``learn``, the expected counts (start, move, emit) of
    non-empty sequences of classes, all of them together, longest first."""
    space, k, kind = Space() if space is None else space, len(model.start), model.emit.dtype
    lengths = np.array([len(s) for s in sequences])
    steps, width = int(lengths[0]), len(sequences)
    tokens = space.array("tokens", (steps, width), np.int32)
    tokens[lengths[-1] :] = CLASSES + 1  # emitted by no state
    for d, s in enumerate(sequences):
        tokens[: len(s), d] = s
    # runs of steps that the same number of sequences reach
    ends = np.unique(lengths)
    runs = list(zip([0, *ends[:-1].tolist()], ends.tolist(), (width - np.searchsorted(lengths[::-1], ends, "left")).tolist()))
    emit, ones = np.concatenate([model.emit, np.zeros((1, k), kind)]), np.ones(k, kind)
    alpha, scale = space.array("alpha", (steps, width, k), kind), space.array("scale", (steps, width), kind)
    np.take(emit, tokens, axis=0, out=alpha, mode="clip")
    scale[lengths[-1] :] = 1
    if learn:
        b = space.array("b", alpha.shape, kind)
        b[:] = alpha
    came, a = np.empty((width, k), kind), None
    for first, end, n in runs:
        a, to = a if a is None else a[:n], came[:n]
        for now, c, column in zip(alpha[first:end, :n], scale[first:end, :n], scale[first:end, :n, None]):
            now *= model.start if a is None else np.matmul(a, model.move, out=to)
            np.matmul(now, ones, out=c)
            now /= column
            a = now
    likelihood = np.log(scale).sum(0, dtype=np.float64)
    if not learn:
        return likelihood, None
    # backwards; b becomes emission times beta, scaled, and alpha times beta what each state expects of a token
    beta, back, after = space.array("beta", alpha.shape, kind), np.ascontiguousarray(model.move.T), 0
    b /= scale[:, :, None]
    for first, end, n in reversed(runs):
        beta[end - 1, after:n] = 1
        if after:
            np.matmul(b[end, :after], back, out=beta[end - 1, :after])
        for x, y, to in zip(b[first + 1 : end, :n][::-1], beta[first + 1 : end, :n][::-1], beta[first : end - 1, :n][::-1]):
            x *= y
            np.matmul(x, back, out=to)
        b[first, :n] *= beta[first, :n]
        after = n
    move = model.move * (alpha[:-1].reshape(-1, k).T @ b[1:].reshape(-1, k)) if steps > 1 else np.zeros((k, k))
    alpha *= beta
    flat = tokens.ravel().astype(np.int16)
    number = np.bincount(flat, minlength=CLASSES + 2)[: CLASSES + 1]
    where = np.flatnonzero(number)
    by_class = np.take(alpha.reshape(-1, k), np.argsort(flat, kind="stable"), axis=0, out=b.reshape(-1, k), mode="clip")
    emitted = np.zeros((CLASSES + 1, k))
    emitted[where] = np.add.reduceat(by_class[: number.sum()], (np.cumsum(number) - number)[where], 0)
    return likelihood, (alpha[0].sum(0), move, emitted)


def _add(total, some):
    return some if total is None else tuple(x + y for x, y in zip(total, some))


def _classes(tokens: np.ndarray, lengths: np.ndarray, keys: np.ndarray, use: np.ndarray | None = None) -> list[np.ndarray]:
    """The classes of each text's words and its end, of those texts that ``use`` names."""
    cls = (keys & np.uint64(CLASSES - 1)).astype(np.int32)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    return [np.append(cls[tokens[edges[i] : edges[i + 1]]], np.int32(CLASSES)) for i in (range(len(lengths)) if use is None else np.flatnonzero(use))]


def _expect(model: Hmm, one_in: int):
    """Expected counts of a partition's learning documents, or of one in so many by a hash of doc_id: rows of sums by
    class; -1 the starts, -2 - i the moves from state i, and below these the log likelihood in s0."""

    def run(batches):
        total, k, space, some = None, len(model.start), Space(), []
        quick = Hmm(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))

        def add() -> None:
            nonlocal total
            for group in lanes(some):
                likelihood, counts = recursion(quick, [some[i] for i in group], True, space)
                total = _add(total, (*(c.astype(np.float64) for c in counts), likelihood.sum(dtype=np.float64)))
            some.clear()

        for b in batches:
            for docs, train, lengths, tokens, keys in zip(*(b.column(i).to_pylist() for i in range(5))):
                use = np.frombuffer(train, np.uint8).astype(bool)
                if one_in > 1:
                    ids = np.array([-1 if d is None else d for d in docs], np.int64).view(np.uint64)
                    use &= mix64(ids + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(one_in) == 0
                some += _classes(_unpack(tokens), np.frombuffer(lengths, np.int32), np.frombuffer(keys, np.uint64), use)
                if sum(map(len, some)) >= LANES:  # few texts of a chunk would make narrow lanes
                    add()
        add()
        if total is not None:
            start, move, emit, likelihood = total
            ids = np.concatenate([np.arange(CLASSES + 1), [-1], -2 - np.arange(k + 1)])
            sums = np.concatenate([emit, start[None], move, likelihood * np.eye(1, k)])
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(k))], ["id", *(f"s{i}" for i in range(k))])

    return run


def first_model(counts: np.ndarray, overall: np.ndarray, k: int, seed: int) -> Hmm:
    """States that each emit the class counts with a perturbation of their own."""
    emit = counts[:, None] * np.random.default_rng(seed).exponential(size=(CLASSES + 1, k))
    move = np.full((k, k), 0.2 / k) + 0.8 * np.eye(k)
    return Hmm.estimate(np.ones(k), 1000 * move, emit, overall)


def _score(model: Hmm, n: int, v: int, ends: int, in_class: np.ndarray):
    """in_class: by class, log10 of the denominator of a word in its class."""
    log_all = np.log10(n + 0.1 * (v + 1))

    def run(key, chunks: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        out, space = [], Space()
        for docs, train, lengths, tokens, keys in zip(*(chunks[c] for c in ("docs", "train", "lengths", "tokens", "keys"))):
            keys, tokens, lengths = np.frombuffer(keys, np.uint64), _unpack(tokens), np.frombuffer(lengths, np.int32)
            count = np.zeros(len(keys), np.int64)
            count[totals["pos"].to_numpy()] = totals["total"].to_numpy()
            weight = np.log10(count + 0.1)
            own = weight - in_class[(keys & np.uint64(CLASSES - 1)).astype(np.int64)]
            edges = np.concatenate([[0], np.cumsum(lengths)])
            sums = lambda per_word: np.diff(np.concatenate([[0.0], np.cumsum(per_word[tokens])])[edges])
            known = sums((count > 0).astype(float)).round().astype(np.int64) + (ends > 0)
            base = sums(weight) + np.log10(ends + 0.1) - (lengths + 1) * log_all
            words = sums(own)
            sequences = _classes(tokens, lengths, keys)
            chain = np.zeros(len(sequences))
            for group in lanes(sequences):
                chain[group] = recursion(model, [sequences[i] for i in group], False, space)[0]
            out.append(pd.DataFrame({"doc_id": pd.array(docs, dtype="Int64"), "n_tokens": (lengths + 1).astype(np.int64), "n_known": known, "train_tokens": n, "base_score": base, "score": chain / np.log(10) + words}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []})

    return run


def lm_score(spark: SparkSession, docs: DataFrame, states: int = STATES, gain: float = GAIN, seed: int = 42) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row of ``docs``.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0. Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` of the A-Z lower-cased whole text and one end; null and empty texts have the end
    only. base_score is the smoothed unigram log10 probability, score the model's. Rows without doc_id are scored,
    teach nothing and count as not held out. Repeated rows count as often as they occur. With nothing to
    learn from, base_score is 0 and the model uniform over classes. An empty table gives an empty
    result; other columns are left out. Words are told apart by 64-bit hashes.
    """
    prepare(spark)
    learns = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), learns.alias("learn"), "text")
    with Scratch(spark) as scratch:
        chunks = scratch.table(rows.mapInArrow(trimmed(_encode), CHUNKS))
        words = chunks.select("chunk", "keys", "counts").mapInArrow(_vocabulary, "key long, chunk long, pos int, n int")
        by_word = Window.partitionBy("key")
        totals = words.select("chunk", "pos", "key", F.sum("n").over(by_word).alias("total"), (F.min("chunk").over(by_word) == F.col("chunk")).alias("first"))
        totals = scratch.table(totals.select("chunk", "pos", "total", "first", F.col("key").bitwiseAND(CLASSES - 1).cast("int").alias("cls")))
        of_class = np.zeros((2, CLASSES + 1))
        for r in totals.where("first AND total > 0").groupBy("cls").agg(F.sum("total").alias("n"), F.count("*").alias("v")).collect():  # at most CLASSES rows
            of_class[:, r["cls"]] = r["n"], r["v"]
        ends = rows.where("learn").count()
        of_class[:, CLASSES] = ends, ends > 0
        n, v = (int(x) for x in of_class.sum(1))
        overall = (of_class[0] + 1) / (n + CLASSES + 1)
        model = first_model(of_class[0], overall, states, seed)
        sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(states)]
        form = "id int, " + ", ".join(f"s{i} double" for i in range(states))
        for one_in in (FIRST, 1) if n else ():
            last = -np.inf
            while True:
                got = chunks.select("docs", "train", "lengths", "tokens", "keys").mapInArrow(trimmed(_expect(model, one_in)), form).groupBy("id").agg(*sums).orderBy("id").toPandas()  # CLASSES + 3 + states rows
                values, ids = got[[f"s{i}" for i in range(states)]].to_numpy(float), got["id"].to_numpy()
                emitted = values[ids >= 0]
                if not emitted.sum() > 0:  # none of so few documents is among the first
                    break
                reached = values[ids == -2 - states][0, 0] + model.prior(overall)
                model = Hmm.estimate(values[ids == -1][0], values[(ids < -1) & (ids > -2 - states)][::-1], emitted, overall)
                if reached - last < gain * emitted.sum():
                    break
                last = reached
        in_class = np.log10(of_class[0] + 0.1 * (of_class[1] + 1))
        form = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        # a chunk of empty texts has no words: the cogroup gives it an empty right side
        scored = chunks.groupBy("chunk").cogroup(totals.select(F.col("chunk").alias("c"), "pos", "total").groupBy("c")).applyInPandas(_score(model, n, v, ends, in_class), form)
        held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
        return scratch.keep(scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
