"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold the merge rank of each adjacent pair of a word's symbols, inner nodes
the smaller of their children. The root gives the lowest rank; going left first where the ranks are
equal gives the leftmost such pair. A merge changes at most three leaves, each in logarithmic time.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, slices, trimmed

NO_RANK = 1 << 60
#: The same for arrays.
NO = np.int32(2**31 - 1)
#: Words of more symbols are merged one by one.
LONG = 64
#: White space of the pattern's \s class (fixed values).
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that newer Unicode tables call letters or numbers and the library's tables (16.0) don't.
RECENT = (
    "\\u0558\\u058b\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a"
    "\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda"
    "\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128"
    "\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff"
    "\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4"
    "\\U0001e6fe\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
#: Lower case of code points that Python's tables (15.1) leave alone and the library's lower-case.
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
#: Words of only these code points are told apart alike by every Unicode version since 6; a text with any other word takes the careful pattern.
PLAIN = re.compile("[\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0391-\u03a9\u03b1-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u2010-\u2027\u2030-\u205e\u20ac\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff0f]*").fullmatch
#: Bytes of remembered words, about, at which a task forgets them and starts anew; and what one costs beyond its letters and ids.
MEMO_BYTES, ENTRY = 24 << 20, 200
#: Bytes of a vocabulary file that is broadcast, at most.
MOST_VOCABULARY = 64 << 20
#: Characters whose new words are merged together, and symbols that are merged side by side.
CHARS, SIDE_BY_SIDE = 500_000, 200_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_symbols(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals, until no pair can merge.

    ``ranks`` maps ``left << 32 | right`` to the rank, ``made`` a rank to the id of the merged symbol.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    size = 1 << (n - 2).bit_length()
    tree = [NO_RANK] * size
    tree += [get(a << 32 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
    tree += [NO_RANK] * (2 * size - len(tree))
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left <= right else right
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    while (low := tree[1]) < NO_RANK:
        i = 1
        while i < size:
            i *= 2
            if tree[i] != low:
                i += 1
        i -= size
        j = after[i]
        ids[i] = new = made[low]
        after[i] = k = after[j]
        ids[j] = -1
        h = before[i]
        changed = [(j, NO_RANK)] if j < n - 1 else []
        if k < n:
            before[k] = i
            changed.append((i, get(new << 32 | ids[k], NO_RANK)))
        else:
            changed.append((i, NO_RANK))
        if h >= 0:
            changed.append((h, get(ids[h] << 32 | new, NO_RANK)))
        for leaf, rank in changed:
            leaf += size
            tree[leaf] = rank
            while leaf > 1:
                other = tree[leaf ^ 1]
                if other < rank:
                    rank = other
                leaf >>= 1
                if tree[leaf] == rank:
                    break
                tree[leaf] = rank
    return [x for x in ids if x >= 0]


class PairTable:
    """Merge ranks by pair, for arrays of pairs: open addressing over a table at most a sixteenth full."""

    def __init__(self, ranks: dict[int, int]):
        keys, values = np.fromiter(ranks.keys(), np.int64, len(ranks)), np.fromiter(ranks.values(), np.int32, len(ranks))
        self.bits = max(4, (16 * len(ranks)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO, np.int32)
        at = self._slot(keys)
        while len(keys):  # each round seats one key in each free slot that is asked for
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            seated = self.keys[at] == keys
            self.values[at[seated]] = values[seated]
            keys, values, at = keys[~seated], values[~seated], (at[~seated] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NO where there is no merge; a negative id has none."""
        keys = (left << 32) | (right & 0xFFFFFFFF)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NO)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def merge_many(ids: np.ndarray, lengths: np.ndarray, table: PairTable, made: np.ndarray) -> np.ndarray:
    """:func:`merge_symbols` over many words at once: rows of ``ids`` padded with -1 to one more than
    a power of two. Every round does one merge in each word that still has one, each word with a
    segment tree of its own. Returns the rows with merged-away symbols as -1."""
    m, width = ids.shape
    size = width - 1
    tree = np.full((m, 2 * size), NO, np.int32)
    tree[:, size:] = table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, size)
    for i in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    before = np.tile(np.arange(-1, width, dtype=np.int64), (m, 1))
    after = np.tile(np.arange(1, width + 2, dtype=np.int64), (m, 1))
    ids = np.concatenate([ids, np.full((m, 1), -1, ids.dtype)], 1)
    flat, ids_, before_, after_ = tree.ravel(), ids.ravel(), before.ravel(), after.ravel()
    rows = np.arange(m)
    while True:
        low = flat[rows * (2 * size) + 1]
        going = low < NO
        if not going.all():
            rows, low = rows[going], low[going]
        if not len(rows):
            return ids[:, :width]
        base, line = rows * (2 * size), rows * (width + 1)
        i = np.ones(len(rows), np.int64)
        while True:
            if i[0] >= size:
                break
            i *= 2
            i += flat[base + i] != low
        i -= size
        j = after_[line + i]
        new = made[low]
        ids_[line + i] = new
        ids_[line + j] = -1
        k = after_[line + j]
        after_[line + i] = k
        before_[line + k] = i
        h = before_[line + i]
        follows = k < lengths[rows]
        some = h >= 0
        h = np.where(some, h, i)
        dead = np.where(j < size, j, i)
        flat[base + size + dead] = NO
        flat[base + size + i] = np.where(follows, table.get(new, ids_[line + k]), NO)
        left = table.get(ids_[line + h], new)
        at = np.flatnonzero(some)
        flat[base[at] + size + h[at]] = left[at]
        for leaf in (dead, i, h):
            up = (leaf + size) >> 1
            for _ in range(size.bit_length() - 1):
                spot = base + up
                child = spot + up
                flat[spot] = np.minimum(flat[child], flat[child + 1])
                up >>= 1


class _Odd(Exception):
    pass


class WordBpe:
    """A vocabulary in the JSON form of the public tokenizer files: NFC, lower case, a split pattern, byte letters, word ends."""

    def __init__(self, spec: str | dict):
        spec = json.loads(spec) if isinstance(spec, str) else spec
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.table, self.made_ = PairTable(self.ranks), np.array(self.made, np.int64)
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names.update({i: t for t, i in self.special.items()})
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern = pattern.replace(r"\s", SPACE)
        plain = pattern.replace(rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"(?:[^{SPACE}\w]|_)+").replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d")
        self.find = re.compile(plain).findall
        careful = pattern.replace(r"[\p{L}]+", rf"(?:(?![{RECENT}])\p{{L}})+").replace(r"[\p{N}]", rf"(?![{RECENT}])\p{{N}}").replace(rf"[^{SPACE}\p{{L}}\p{{N}}]+", rf"(?:[{RECENT}]|[^{SPACE}\p{{L}}\p{{N}}])+")
        self.find_carefully = regex.compile(careful).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = [self.vocab[x] for x in byte_letters()]
        self.inner_ = np.array(self.inner, np.int64)
        self.last = [self.vocab[x + self.end] for x in byte_letters()]
        self.last_ = np.array(self.last, np.int64)
        self.memo: dict[str, bytes] = {}
        self.held = 0  # bytes of the memo, about

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        return merge_symbols(ids, self.ranks, self.made)

    def _pieces(self, text: str):
        """(stretch, None) for text between special tokens, ("", id) for those."""
        if self.cut is None or not any(s in text for s in self.special):
            yield text, None
            return
        for part in self.cut.split(text):
            if part:
                yield ("", self.special[part]) if part in self.special else (part, None)

    def _words(self, text: str, careful: bool = False) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if careful:
            return self.find_carefully(text.translate(LOWER).lower())
        # lower-cased one code point at a time: the final sigma is no special case
        return self.find(text.replace("Σ", "σ").lower())

    def _learn(self, word: str, careful: bool = False) -> bytes:
        if not careful and not PLAIN(word):
            raise _Odd
        ids = self.word(word)
        out = b"".join([i.to_bytes(4, "little") for i in ids])
        if not careful:
            self._hold([word], [out])
        return out

    def _hold(self, words: list[str], ids: list[bytes]) -> None:
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        self.held += sum(map(len, words)) + sum(map(len, ids)) + ENTRY * len(words)
        self.memo.update(zip(words, ids))

    def learn(self, words: set[str]) -> None:
        """Put plain words into the memo, many at a time. What it forgets meanwhile is learnt again when it is met."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            n = len(w.encode())
            if n <= LONG and PLAIN(w):
                by_size.setdefault(1 << max(0, n - 2).bit_length(), []).append(w)
        for size, all_of_size in by_size.items():
            rows = SIDE_BY_SIDE // size
            for start in range(0, len(all_of_size), rows):
                some = all_of_size[start : start + rows]
                raw = [w.encode() for w in some]
                lengths = np.fromiter(map(len, raw), np.int64, len(raw))
                ids = np.full((len(raw), size + 1), -1, np.int64)
                inside = np.arange(size + 1) < lengths[:, None]
                symbols = np.frombuffer(b"".join(raw), np.uint8)
                ids[inside] = self.inner_[symbols]
                ends = np.cumsum(lengths) - 1
                ids[np.arange(len(raw)), lengths - 1] = self.last_[symbols[ends]]
                merged = merge_many(ids, lengths, self.table, self.made_)
                left = merged >= 0
                packed = merged[left].astype("<u4").tobytes()
                stops = (4 * np.cumsum(left.sum(1))).tolist()
                self._hold(some, [packed[a:b] for a, b in zip([0, *stops], stops)])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """:meth:`encode` of each text, null as empty; the words that are new to some millions of
        characters are merged together."""
        out: list[bytes] = []
        while len(out) < len(texts):
            held, unseen, chars = [], set(), 0
            for text in texts[len(out) :]:
                words = got = None
                if text and not any(s in text for s in self.special):
                    words = self._words(text)
                    got = list(map(self.memo.get, words))
                    if None in got:
                        unseen.update([w for w, g in zip(words, got) if g is None])
                    else:
                        got, words = b"".join(got), None
                    chars += len(text)
                held.append((text, words, got))
                if chars > CHARS:
                    break
            if unseen:
                self.learn(unseen)
            for text, words, got in held:
                if words is None:
                    out.append(got if got is not None else self.encode(text) if text else b"")
                    continue
                try:
                    out.append(b"".join([g or self.memo.get(w) or self._learn(w) for w, g in zip(words, got)]))
                except _Odd:
                    out.append(self._encode(text, True))
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        try:
            return self._encode(text, False)
        except _Odd:  # a code point on which Unicode tables differ by their version
            return self._encode(text, True)

    def _encode(self, text: str, careful: bool) -> bytes:
        out, memo, learn = [], self.memo, self._learn
        for part, special in self._pieces(text):
            if special is not None:
                out.append(special.to_bytes(4, "little"))
            elif careful:
                out += [learn(w, True) for w in self._words(part, True)]
            else:
                out += [memo.get(w) or learn(w) for w in self._words(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with spaces between, as the format decodes where it names no decoder; special tokens stay."""
        names = self.names
        return " ".join([names[i] for i in memoryview(ids).cast("I")])


def _encode_rows(sent, at: int, schema: T.StructType):
    """The vocabulary is loaded by each task and goes with it: workers idle on beside later stages."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        want, model = to_arrow_schema(schema), None
        for batch in slices(batches):
            model = model or WordBpe(sent.value)
            ids = model.encode_all(batch.column(at).to_pylist())
            decoded = [model.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(decoded, want.field(len(want) - 1).type)], schema=want)
            del ids, decoded

    return run


def bpe(spark: SparkSession, docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.

    One pass without a shuffle. The driver reads the vocabulary (at most MOST_VOCABULARY bytes, else it is refused)
    and broadcasts it. Null text counts as empty and gives no ids and an empty decoding. Columns
    named ids or decoded in the input are replaced; others pass through. Texts of any length are
    encoded whole; a word of n symbols takes O(n log n).
    """
    prepare(spark)
    if os.path.getsize(vocab_path) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary file of more than {MOST_VOCABULARY} bytes")
    with open(vocab_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(trimmed(_encode_rows(sent, docs.columns.index(text), schema)), schema)


def digest(out: DataFrame) -> DataFrame:
    return out.select(
        "doc_id",
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(bpe(spark, docs, public_tokenizers.path("word_bpe_49k.json")))
