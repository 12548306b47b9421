"""Removal of long repeated passages with a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a 400-byte string that starts at two or more places of the corpus. Beside
that, a document is marked if a passage of ``WORDS.length`` words or more stands in another document
too, however few bytes it has.

*Sparse suffixes.* The anchor of a start s is the position of the least hash of a gram among the
``window`` positions from s on, the leftmost of equals. It depends on the string at s alone, so
equal strings have their anchors at the same offset, and the ``prefix`` units from the anchor on
lie inside the string: a string can only occur twice if the suffix at its anchor shares its prefix
with another indexed suffix. One suffix in about 160 bytes is indexed, and one in about 20 words.
The starts of one anchor are an interval [lo, hi].

*Index family.* Documents come in batches. A batch's suffixes, ordered by the hash of their prefix,
are a suffix array of its own; it is merge-scanned (a sort-merge join) against each existing level
for prefixes that both have. When the next batch comes, levels of equal size merge, so a suffix is
rewritten at most log2(batches) times. What the levels hold of the prefixes found goes into the
steps below, so a batch meets all documents before it, those of earlier calls included.

*Exact ends.* Suffixes with a shared prefix form classes by the hash of all that their starts
cover. In a class of two or more, every start repeats. Where a prefix has several classes, a match
begins or ends within them: one member of each class is then cut into blocks of ``BLOCK`` starts,
counted from the anchor, which form classes in the same way by the bytes common to all starts of a
block and the bytes that they cover. Where these are several again, single starts are looked up by
the hash of their 400 bytes. A prefix and what it covers are two 64-bit hashes, a single start is
128 bits; bytes themselves are not compared.

A text is worked through in pieces of ``PIECE`` bytes, so memory does not follow its length. An
anchor's interval is cut where a piece ends, which makes a class of its own there and no other end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, materialize, utf8_parts


@dataclass(frozen=True)
class Unit:
    """Strings of ``length`` bytes or words; window + prefix is at most length + 1."""

    code: int
    length: int
    window: int
    prefix: int
    gram: int


BYTES, WORDS = Unit(0, 400, 320, 80, 16), Unit(1, 50, 38, 12, 12)
LENGTH = BYTES.length
BATCHES = 4
#: Starts in a block where the ends of matches are sought.
BLOCK = 16
#: Bytes of a text whose starts are hashed at once.
PIECE = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all runs of a sequence of codes, as differences of prefix sums of codes times powers modulo 2**64; equal runs have equal hashes wherever they stand."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, seed: int = 1):
        n = len(codes)
        power, inverse = self._powers.get(seed, (np.empty(0, np.uint64), np.empty(0, np.uint64)))
        if len(power) < n + 1:
            base, size = self._base(seed), max(2 * n, 1 << 16)
            fill = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
            power, inverse = self._powers[seed] = fill(base), fill(pow(base, -1, 2**64))
        self.inverse = inverse
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * power[:n], out=self.sums[1:])

    @staticmethod
    def _base(seed: int) -> int:
        return 0x9E3779B97F4A7C15 * (2 * seed + 1) & (2**64 - 1) | 1

    @classmethod
    def of(cls, raw: bytes, seed: int = 1) -> Rolling:
        codes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(cls._base(seed)))
        return cls(codes[np.frombuffer(raw, np.uint8)], seed)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def runs(self, length: int, low: int, high: int) -> np.ndarray:
        """Hashes of the runs of one length that start at low, ..., high - 1."""
        return _mix((self.sums[low + length : high + length] - self.sums[low:high]) * self.inverse[low:high])


def anchors(rolling: Rolling, n: int, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions of a sequence of n >= unit.length, and the first and last start that each has."""
    starts = n - unit.length + 1
    many = starts + unit.window - 1
    least = (rolling.runs(unit.gram, 0, many) & np.uint64(0xFFFFFFFF00000000)) | np.arange(many, dtype=np.uint64)
    size = 1
    while size < unit.window:
        step = min(size, unit.window - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:] - 1, [starts - 1]])
    return at[lo], lo, hi


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; words are parted by ASCII white space."""
    a = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[0], ((a != 32) & ((a < 9) | (a > 13))).view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes, whole: Rolling | None = None) -> np.ndarray:
    """The hash of each word; ``whole`` is that of all bytes where it is at hand. A word of over PIECE bytes has its digest's."""
    start, end = word_bounds(raw)
    if whole is not None or not len(start):
        return whole.at(start, end) if len(start) else np.empty(0, np.uint64)
    out, i = [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        low, high = int(start[i]), int(end[j - 1])
        if high - low > PIECE:
            out.append(np.frombuffer(hashlib.sha256(raw[low:high]).digest()[:8], np.uint64))
        else:
            out.append(Rolling.of(raw[low:high]).at(start[i:j] - low, end[i:j] - low))
        i = j
    return np.concatenate(out)


SUFFIX = "batch int, unit int, key long, cover long, uid long, at int, lo int, hi int"


def _entries(r: Rolling, n: int, unit: Unit, shift: int = 0) -> tuple[np.ndarray, ...]:
    """unit, key, cover, at, lo, hi of the suffixes that stand for all starts of a sequence of n codes."""
    at, lo, hi = anchors(r, n, unit)
    cover = _mix(r.at(lo, hi + unit.length) + (at - lo).astype(np.uint64) * _M2 + (hi - lo).astype(np.uint64) * _M1)
    # where the anchor lies is a matter of bytes alone
    return np.full(len(at), unit.code), r.at(at, at + unit.prefix).view(np.int64), cover.view(np.int64), at + shift if unit is BYTES else 0 * at, lo + shift, hi + shift


def suffixes_of(raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries of a text, in bytes and then in words."""
    whole = None
    for first in range(0, len(raw) - LENGTH + 1, PIECE):
        piece = raw[first : first + PIECE + LENGTH - 1]
        whole = Rolling.of(piece)
        yield _entries(whole, len(piece), BYTES, first)
    words = word_hashes(raw, (whole or Rolling.of(raw)) if len(raw) <= PIECE else None)
    if len(words) >= WORDS.length:
        yield _entries(Rolling(words), len(words), WORDS)


def _suffixes(batches: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            out: list[list] = [[] for _ in SUFFIX.split(", ")]
            for uid, raw in zip(b.column("uid").to_pylist(), utf8_parts(b.column("text"))):
                for unit, key, cover, at, lo, hi in suffixes_of(raw):
                    for o, x in zip(out, (np.full(len(at), uid % batches), unit, key, cover, np.full(len(at), uid), at, lo, hi)):
                        o.append(x)
            yield _columns(out, SUFFIX)

    return run


class IndexFamily:
    """Levels of suffixes (unit, key, cover, uid, at, lo, hi), each ordered by key: level i holds those of 2**i batches. Packed texts of earlier calls stand beside them."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.texts: list[DataFrame] = []

    def _settle(self) -> None:
        """Merge the last levels while they are of equal size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, materialize(a.unionByName(b).sortWithinPartitions("key"), "level")))

    def close(self) -> None:
        """Delete the tables of an index that is not kept."""
        discard(*(level for _, level in self.levels), *self.texts)

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch, a written table of suffixes, and give the keys that it repeats: within itself, or of any level."""
        self._settle()
        counted = materialize(batch.groupBy("key").agg(F.count("*").alias("n")), "keys")
        found = counted.filter("n > 1").select("key")
        for _, level in self.levels:
            found = found.unionByName(counted.select("key").join(level.select("key").distinct(), "key", "left_semi"))
        self.levels.append((1, batch))
        return found.distinct()

    def matches(self, keys: DataFrame) -> DataFrame:
        """The suffixes of all levels that have one of these keys."""
        levels = [level for _, level in self.levels]
        rows = levels[0]
        for level in levels[1:]:
            rows = rows.unionByName(level)
        return rows.join(keys, "key", "left_semi")


def _pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are packed before they are shuffled."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in stream:
        raws = utf8_parts(b.column("text"))
        yield pa.record_batch({"uid": b.column("uid"), "doc_id": b.column("doc_id"), "packed": pa.array([pack.compress(r) for r in raws], pa.binary())})


def _settle(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of which no more is asked are done: size and digest take the place of the text."""
    unpack = zstandard.ZstdDecompressor()
    for b in stream:
        packed, found, words = b.column("packed").to_pylist(), b.column("found"), b.column("words")
        n, sha = [None] * len(packed), [None] * len(packed)
        for i, (x, f, w) in enumerate(zip(packed, found.is_valid().to_pylist(), words.is_valid().to_pylist())):
            if not f and not w:
                raw = unpack.decompress(x)
                n[i], sha[i], packed[i] = len(raw), hashlib.sha256(raw).hexdigest(), None
        yield pa.record_batch({"uid": b.column("uid"), "doc_id": b.column("doc_id"), "packed": pa.array(packed, pa.binary()), "found": found, "words": words, "n_bytes": pa.array(n, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def _asked(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The fields of each row's list of structs."""
    flat, ends = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    for low, high in zip([0, *ends[:-1]], ends):
        yield {k: v[low:high] for k, v in fields.items()}


def _each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of count[i] members of i: i, and its number among them."""
    return np.repeat(np.arange(len(count)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _near(raw: bytes, rows: dict[str, np.ndarray], reach: int) -> Iterator[tuple[int, bytes, dict[str, np.ndarray]]]:
    """Rows (lo, hi), those that are near each other together, with the part of the text that their starts cover: where it begins, and its bytes."""
    if len(raw) <= PIECE:
        yield 0, raw, rows
        return
    order = np.argsort(rows["lo"], kind="stable")
    rows = {k: v[order] for k, v in rows.items()}
    i = 0
    while i < len(order):
        low = max(0, int(rows["lo"][i]) - reach)
        j = int(np.searchsorted(rows["lo"], low + PIECE, "right"))
        yield low, raw[low : int(rows["hi"][i:j].max()) + LENGTH + reach], {k: v[i:j] for k, v in rows.items()}
        i = j


def _answered(stream: Iterator[pa.RecordBatch], asked: str, ddl: str, answer) -> Iterator[pa.RecordBatch]:
    """What ``answer`` makes of each text and its rows of the column ``asked``, as rows of uid and others."""
    unpack, kinds = zstandard.ZstdDecompressor(), len(ddl.split(", "))
    for b in stream:
        out: list[list] = [[] for _ in range(kinds)]
        held = 0
        for uid, packed, rows in zip(b.column("uid").to_pylist(), b.column("packed"), _asked(b.column(asked))):
            if "asks" in rows:
                rows = {k: v[rows["asks"].astype(bool)] for k, v in rows.items()}
            if not len(rows["lo"]):
                continue
            for found in answer(unpack.decompress(packed.as_py()), rows):
                held += len(found[0])
                for o, v in zip(out, (np.full(len(found[0]), uid), *found)):
                    o.append(v)
            if held > 200_000:
                yield _columns(out, ddl)
                out, held = [[] for _ in range(kinds)], 0
        yield _columns(out, ddl)


BLOCKS = "uid long, key long, cover long, low int, high int, weight int"


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of starts of the members that stand for their class where a prefix has several classes."""

    def answer(raw: bytes, rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        for shift, part, x in _near(raw, rows, BYTES.window + BLOCK):
            one = Rolling.of(part)
            begin, stop = (x["lo"] - x["at"]) // BLOCK, (x["hi"] - x["at"]) // BLOCK
            i, k = _each(stop - begin + 1)
            first = x["at"][i] + BLOCK * (begin[i] + k)
            low, high = np.maximum(first, x["lo"][i]), np.minimum(first + BLOCK - 1, x["hi"][i])
            inside = (low - first).astype(np.uint64) * _M1 + (high - first).astype(np.uint64) * _M2
            key, cover = one.at(first + BLOCK - 1 - shift, first + LENGTH - shift), _mix(one.at(low - shift, high + LENGTH - shift) + inside)
            yield key.view(np.int64), cover.view(np.int64), low, high, np.minimum(x["n"][i], 2)

    return _answered(stream, "found", BLOCKS, answer)


LOOKUPS = "uid long, h1 long, h2 long, weight int, start int"


def _lookups(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all starts of the blocks that stand for their class where classes are several."""

    def answer(raw: bytes, rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        for shift, part, x in _near(raw, rows, 0):
            i, k = _each(x["hi"] - x["lo"] + 1)
            start, n = x["lo"][i] + k, x["n"][i]
            h1, h2 = (Rolling.of(part, seed).at(start - shift, start - shift + LENGTH).view(np.int64) for seed in (1, 2))
            yield h1, h2, np.minimum(n, 2), np.where(n > 1, -1, start)

    return _answered(stream, "asked", LOOKUPS, answer)


PASSAGES = "uid long, h1 long, h2 long"


def _passages(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the passages of WORDS.length words from each start that is asked for."""

    def answer(raw: bytes, x: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        codes = word_hashes(raw, Rolling.of(raw) if len(raw) <= PIECE else None)
        i, k = _each(x["hi"] - x["lo"] + 1)
        start = x["lo"][i] + k
        yield tuple(Rolling(codes, seed).at(start, start + WORDS.length).view(np.int64) for seed in (1, 2))

    return _answered(stream, "words", PASSAGES, answer)


def _columns(out: list[list], ddl: str) -> pa.RecordBatch:
    kinds = {"int": np.int32, "long": np.int64}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.record_batch({n: pa.array(np.concatenate(o).astype(kinds[k]) if o else np.empty(0, kinds[k])) for (n, k), o in zip(fields, out)})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open spans."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


RESULT = "uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:long,high:long>>"


def _remove(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in stream:
        rows = []
        for packed, found, blocks, starts in zip(*(b.column(c).to_pylist() for c in ("packed", "found", "blocks", "starts"))):
            raw = unpack.decompress(packed)
            spans = [(x["lo"], x["hi"] + LENGTH) for x in (*(found or ()), *(blocks or ())) if x["n"] > 1]
            starts = np.sort(np.array(starts or [], np.int64))
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > LENGTH)
                first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(starts) - 1]])
                spans += [(int(starts[i]), int(starts[j]) + LENGTH) for i, j in zip(first, last)]
            spans = merged(spans)
            digest, at = hashlib.sha256(), 0
            for low, high in spans:
                digest.update(raw[at:low])
                at = high
            digest.update(raw[at:])
            rows.append((len(raw), sum(h - s for s, h in spans), len(spans), digest.hexdigest(), [{"low": s, "high": h} for s, h in spans]))
        n, gone, many, sha, spans = zip(*rows) if rows else ([],) * 5
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        yield pa.record_batch({"uid": b.column("uid"), "doc_id": b.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(many, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, kind)})


def repeated_spans(docs: DataFrame, batches: int = BATCHES, index: IndexFamily | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage and spans (removed byte ranges) of every row of ``docs``.

    shares_passage says whether a passage of WORDS.length words or more, white space aside, stands
    in another document too; such a passage may have too few bytes to be removed. Null counts as
    empty; texts of under LENGTH bytes keep all. Matches stay inside documents. Rows
    that are equal in doc_id and text repeat each other, but are one document to shares_passage. A null doc_id stays null;
    other columns are not read. An index that is passed in is added to: what repeats
    a document of an earlier call goes as if both came in one call; rows of earlier calls are not given again.
    """
    base = documents(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("uid", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**63 - 1)))
    suffixes = materialize(base.select("uid", "text").mapInArrow(_suffixes(batches), SUFFIX).sortWithinPartitions("batch", "key"), "level", "batch")
    family, keys = index or IndexFamily(), None
    for k in range(batches):
        found = materialize(family.add(suffixes.filter(F.col("batch") == k).drop("batch")), "keys")
        keys = found if keys is None else keys.unionByName(found)
    # a key is found by every batch but the first that has it. Both sides of the join are tables, so that AQE can split a prefix that very many suffixes share
    keys = materialize(keys.distinct(), "keys")
    shared = materialize(family.matches(keys), "shared")
    if index is None:
        family.close()
    rows = _classed(shared.filter(F.col("unit") == BYTES.code).withColumn("weight", F.lit(1)), "at")
    marked, asked = _marked(shared.filter(F.col("unit") == WORDS.code))
    of_doc = rows.groupBy("uid").agg(F.collect_set(F.struct("at", "lo", "hi", F.least("n", F.lit(2)).alias("n"), "asks")).alias("found"))
    of_doc = of_doc.join(asked, "uid", "full")
    packed = base.select("uid", "doc_id", "text").mapInArrow(_pack, "uid long, doc_id long, packed binary")
    if index is not None:
        packed = materialize(packed, "packed")
    texts = packed.join(of_doc, "uid", "left")
    found_type = "array<struct<at:int,lo:int,hi:int,n:bigint,asks:boolean>>"
    joined = materialize(texts.mapInArrow(_settle, f"uid long, doc_id long, packed binary, found {found_type}, words array<struct<lo:int,hi:int>>, n_bytes long, kept_sha256 string"), "texts")
    own = touched = joined.filter("n_bytes is null").select("uid", "doc_id", "packed", "found", "words")
    for earlier in family.texts:
        touched = touched.unionByName(earlier.join(of_doc, "uid").select("uid", "doc_id", "packed", "found", "words"))
    if index is not None:
        family.texts.append(packed)
    blocks = materialize(_classed(materialize(touched.filter("found is not null").mapInArrow(_blocks, BLOCKS), "blocks"), "low"), "blocks")
    block = F.struct(F.col("low").alias("lo"), F.col("high").alias("hi"), F.least("n", F.lit(2)).alias("n"))
    asked = blocks.filter("asks").groupBy("uid").agg(F.collect_set(block).alias("asked"))
    looked = materialize(touched.select("uid", "packed").join(asked, "uid").mapInArrow(_lookups, LOOKUPS), "lookups")
    twice = materialize(looked.groupBy("h1", "h2").agg(F.sum("weight").alias("w")).filter("w > 1").select("h1", "h2"), "twice")
    starts = looked.filter("start >= 0").join(twice, ["h1", "h2"], "left_semi").groupBy("uid").agg(F.collect_set("start").alias("starts"))
    whole = blocks.filter("n > 1").groupBy("uid").agg(F.collect_set(block).alias("blocks"))
    passages = materialize(touched.filter("words is not null").mapInArrow(_passages, PASSAGES), "passages")
    both = materialize(passages.groupBy("h1", "h2").agg(F.min("uid").alias("u"), F.max("uid").alias("v")).filter("u <> v").select("h1", "h2"), "both")
    marked = materialize(marked.unionByName(passages.join(both, ["h1", "h2"], "left_semi").select("uid")).distinct(), "marked")
    cut = own.join(whole, "uid", "left").join(starts, "uid", "left").select("uid", "doc_id", "packed", "found", "blocks", "starts").mapInArrow(_remove, RESULT)
    none = F.lit(0).cast("long")
    plain = joined.filter("n_bytes is not null").select("uid", "doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept_sha256", F.array().cast("array<struct<low:bigint,high:bigint>>").alias("spans"))
    found = plain.unionByName(cut).join(marked.withColumn("shares_passage", F.lit(True)), "uid", "left")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"), "spans")


def _marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of word suffixes with shared prefixes: uid of the documents that are in a class with another one, and uid, words (lo, hi) of the starts to look up."""
    member = F.struct("uid", "lo", "hi")
    classes = materialize(rows.groupBy("key", "cover").agg(F.min(member).alias("speaker"), F.max("uid").alias("last")), "classes")
    shared = materialize(classes.filter(F.col("speaker.uid") != F.col("last")).select("key", "cover"), "classes")
    marked = materialize(rows.join(shared, ["key", "cover"], "left_semi").select("uid").distinct(), "marked")
    # a prefix is asked for if it has several classes, one of them of a document that is not marked yet
    single = classes.filter(F.col("speaker.uid") == F.col("last")).select("key", F.col("last").alias("uid"))
    open_keys = single.join(marked, "uid", "left_anti").select("key").distinct()
    several = classes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    asks = materialize(several.join(open_keys, "key", "left_semi"), "several")
    asked = classes.join(asks, "key", "left_semi").groupBy(F.col("speaker.uid").alias("uid")).agg(F.collect_set(F.struct("speaker.lo", "speaker.hi")).alias("words"))
    return marked, asked


def _classed(rows: DataFrame, at: str) -> DataFrame:
    """Rows (uid, key, cover, weight and ``at``) with n, the members of their class, and asks, whether they stand for it in further questions; rows of which neither matters are left out."""
    member = F.struct("uid", at)
    classes = materialize(rows.groupBy("key", "cover").agg(F.sum("weight").alias("n"), F.min(member).alias("speaker")), "classes")
    # tables again on both sides: a key of very many classes is then split
    several = materialize(classes.groupBy("key").agg((F.count("*") > 1).alias("several")), "several")
    known = materialize(classes.join(several, "key").filter("several or n > 1"), "classes")
    return rows.join(known, ["key", "cover"]).withColumn("asks", F.col("several") & (F.col("speaker") == member)).filter("asks or n > 1")
