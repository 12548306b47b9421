"""Exact dedup by skew-safe combining.

Copies meet in three stages, and each compares whole normalised texts, never digests alone:

1. every partition combines its own copies: only the first copy of a text carries it on;
2. rows meet by (digest, salt). A digest with more than ``SALT_ROWS`` rows is dealt over as many
   salts as it has multiples of that, and a partition moves on to the next salt, with one more copy
   of the text, after so many copies: no task gets a whole large group, even of one partition;
3. the winners of the salts of large groups are combined by digest.

Texts are shuffled once, and copies inside a partition not at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, slices, utf8_parts

#: A group of more rows than this is salted.
SALT_ROWS = 256
#: At most so many digests are salted, the largest groups first: what tasks get of them is under
#: 4 MB. Any other group is then smaller than 1/MOST_HOT of the rows.
MOST_HOT = 65_536
#: Bytes of text that a task remembers for its local combine. Forgetting sends a text twice; no result changes.
LOCAL_BYTES = 32 << 20

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

LOCAL = "row long, doc_id long, n_chars long, digest binary, salt int, rep long, body binary"
MERGED = "kind int, row long, doc_id long, n_chars long, digest binary, part long, size long, keep_row long, keep_id long, keep_chars long, body binary"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [hashlib.sha256(t.translate(None, BLANKS)).digest() for t in utf8_parts(b.column("text"))]
        yield pa.record_batch({"digest": pa.array(found, pa.binary())})


def _combine_locally(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, held, seen = part << 40, 0, {}
        for b in slices(batches):
            out = {n: [] for n in ("row", "doc_id", "n_chars", "digest", "salt", "rep", "body")}
            for doc_id, n_chars, raw in zip(b.column("doc_id").to_pylist(), b.column("n_chars").to_pylist(), utf8_parts(b.column("text"))):
                body = raw.translate(None, BLANKS)
                digest = hashlib.sha256(body).digest()
                salts = hot.value.get(digest, 1)
                same = next((c for c in seen.get(digest, ()) if c["body"] == body), None)
                if same is None:
                    if held > LOCAL_BYTES:
                        seen, held = {}, 0
                    held += len(body)
                    seen.setdefault(digest, []).append(same := {"body": body, "rep": row, "n": 0, "salt": part * 0x9E3779B1})
                elif same["n"] >= SALT_ROWS and salts > 1:
                    same |= {"rep": row, "n": 0, "salt": same["salt"] + 1}
                same["n"] += 1
                for name, x in zip(out, (row, doc_id, n_chars, digest, same["salt"] % salts, same["rep"], body if same["rep"] == row else None)):
                    out[name].append(x)
                row += 1
            yield _batch(out, LOCAL)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(columns: dict, ddl: str) -> pa.RecordBatch:
    kinds = dict(x.split() for x in ddl.split(", "))
    return pa.record_batch({n: pa.array(v, _ARROW[kinds[n]]) for n, v in columns.items()})


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (row, doc_id, n_chars) the one that stays: most code points, smallest doc_id (null last), first row."""
    order = lambda x: (-x[2], x[1] is None, x[1] or 0, x[0])
    return a if order(a) <= order(b) else b


def _merge_salts(hot):
    """Rows come sorted by digest and salt, representatives before the rows that refer to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MERGED.split(", ")]
        key, classes, of_rep = None, [], {}
        out: list[tuple] = []

        def close() -> None:
            for c in classes:
                (row, doc_id, n_chars), rows = c["best"], c["rows"]
                if key[0] not in hot.value:
                    out.extend((0, r, d, n, key[0], None, len(rows), row, doc_id, None, None) for r, d, n in rows)
                else:
                    part = rows[0][0]
                    out.extend((1, r, d, n, key[0], part, None, None, None, None, None) for r, d, n in rows)
                    out.append((2, None, None, None, key[0], part, len(rows), row, doc_id, n_chars, c["body"]))

        def flush() -> pa.RecordBatch:
            b = _batch(dict(zip(names, zip(*out))) if out else {n: [] for n in names}, MERGED)
            out.clear()
            return b

        for b in slices(batches):
            for row, doc_id, n_chars, digest, salt, rep, body in zip(*(b.column(n).to_pylist() for n in ("row", "doc_id", "n_chars", "digest", "salt", "rep", "body"))):
                if (digest, salt) != key:
                    close()
                    key, classes, of_rep = (digest, salt), [], {}
                if body is not None:
                    found = next((c for c in classes if c["body"] == body), None)
                    if found is None:
                        classes.append(found := {"body": body, "rows": [], "best": (row, doc_id, n_chars)})
                    of_rep[rep] = found
                c = of_rep[rep]
                c["rows"].append((row, doc_id, n_chars))
                c["best"] = _better(c["best"], (row, doc_id, n_chars))
                if len(out) >= 20_000:
                    yield flush()
        close()
        yield flush()

    return run


def _merge_winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Salt winners, sorted by digest: for each salted part the row that stays and the size of the whole group."""
    names, ddl = ("part", "size", "keep_row", "keep_id"), "part long, size long, keep_row long, keep_id long"
    key, classes, out = None, [], []

    def close() -> None:
        out.extend((p, c["size"], c["best"][0], c["best"][1]) for c in classes for p in c["parts"])

    for b in slices(batches):
        for digest, part, size, row, doc_id, n_chars, body in zip(*(b.column(n).to_pylist() for n in ("digest", "part", "size", "keep_row", "keep_id", "keep_chars", "body"))):
            if digest != key:
                close()
                key, classes = digest, []
            c = next((c for c in classes if c["body"] == body), None)
            if c is None:
                classes.append(c := {"body": body, "parts": [], "size": 0, "best": (row, doc_id, n_chars)})
            c["parts"].append(part)
            c["size"] += size
            c["best"] = _better(c["best"], (row, doc_id, n_chars))
    close()
    yield _batch(dict(zip(names, zip(*out))) if out else {n: [] for n in names}, ddl)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest (SHA-256 of the normalised text).

    Texts are equal when they are identical after deleting ASCII white space; the row with the most
    code points in its original text stays, then the smallest doc_id. Null text counts as empty, so
    null, empty and blank texts are one group. A null doc_id loses every tie; rows that repeat a
    doc_id are rows of their own, of which one stays. An empty table gives an empty result. Columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    base = documents(docs).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.col("text").cast("binary").alias("text"))
    large = base.select("text").mapInArrow(_digests, "digest binary").groupBy("digest").count().filter(F.col("count") > SALT_ROWS)
    hot = spark.sparkContext.broadcast({bytes(r["digest"]): -(-r["count"] // SALT_ROWS) for r in large.orderBy(F.desc("count"), "digest").limit(MOST_HOT).collect()})
    local = base.mapInArrow(_combine_locally(hot), LOCAL)
    met = local.repartition("digest", "salt").sortWithinPartitions("digest", "salt", "rep", "row")
    merged = materialize(met.mapInArrow(_merge_salts(hot), MERGED), "exact")
    alone = merged.filter("kind = 0").select("row", "doc_id", "digest", "size", "keep_row", "keep_id")
    winners = merged.filter("kind = 2").select("digest", "part", "size", "keep_row", "keep_id", "keep_chars", "body")
    ends = winners.repartition("digest").sortWithinPartitions("digest", "part").mapInArrow(_merge_winners, "part long, size long, keep_row long, keep_id long")
    salted = merged.filter("kind = 1").select("row", "doc_id", "digest", "part").join(ends, "part")
    both = alone.unionByName(salted.select("row", "doc_id", "digest", "size", "keep_row", "keep_id"))
    return both.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
