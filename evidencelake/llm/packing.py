"""Harmonic packing into sequences of a fixed capacity.

A piece of length l belongs to class k = capacity // l, whose slots hold capacity // k tokens; a
bin of class k takes k pieces, whatever their lengths, so bins fill without looking at any other
bin. A document is cut into whole sequences and a rest; a rest that would waste more than
``WASTE`` of its slot gives off pieces that fill the slots of the next class exactly.

Each task fills the bins of its own documents. What is left of a class when a task ends goes on,
as rows of a few numbers, to the next level, where one task fills bins from ``FAN`` tasks' rests,
and so on up to one last task. Rests are dealt evenly. A level passes on fewer than k pieces of each class, so the last
one reads a bounded number of rows whatever the corpus; it fills its last bins by size, largest
pieces first.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

#: A task has one core; threads of the tokenizer would only wait for each other.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from .common import documents, materialize, slices  # noqa: E402

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 2
#: Most of a slot that an uncut rest may leave empty.
WASTE = 1 / 32
#: Word encodings a Python worker remembers, and those of one more call: some 200 bytes each, 300 MB in all.
MEMO = 1_500_000
#: Latin letters up to U+024F become lower case one by one, but for the dotted capital I.
NOT_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Tasks whose rests one task of the next level takes.
FAN = 32

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECE}, task long, sequence_id long, offset long"


@cache
def _tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


class WordMemo:
    """Ids of texts as little-endian unsigned 32-bit bytes, through a bounded memo of words.

    The tokenizer drops white space and encodes no two words together, so a text's ids are those of
    its white-space-separated words. Texts for which that can't be said are encoded whole: those with
    special strings, and with separators that only Python counts as white space. The memo has two
    halves: when the young one is full it becomes the old one, so words that still occur stay.
    """

    def __init__(self, name: str, most: int = MEMO):
        self.tokenizer, self.most, self.memo, self.old = _tokenizer(name), max(2, most), {}, {}
        self.special = [*(t.content for t in self.tokenizer.get_added_tokens_decoder().values()), *"\x1c\x1d\x1e\x1f"]

    def _ids(self, asked: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)
        return {w: array("I", e.ids).tobytes() for w, e in zip(asked, found)}

    def _learn(self, missing: set[str]) -> None:
        """The young half gets these words, from the old one if it has them."""
        at_hand = lambda words: {w: ids for w in words if (ids := self.memo.get(w) or self.old.get(w))}
        known = at_hand(missing)
        missing = missing - known.keys()
        # a mark behind letters is a token of its own: both parts are looked up apart
        marked = {w: w[:-1] for w in missing if w[-1] in ".,|!?;:" and w[:-1].lower().isalpha()}
        parts = {*marked.values(), *(w[-1] for w in marked)}
        known |= at_hand(parts)
        known |= self._ids([w for w in (missing - marked.keys()) | parts if w not in known])
        known |= {w: known[core] + known[w[-1]] for w, core in marked.items()}
        self.memo |= known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; unknown words of all texts are encoded in one call."""
        out, split, missing = [b""] * len(texts), {}, set()
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
                continue
            if not NOT_LATIN.search(text):
                text = text.lower()  # as the tokenizer will, character by character
            split[i] = text.split()
            missing.update(split[i])
        missing -= self.memo.keys()
        if missing:
            self._learn(missing)
        get = self.memo.__getitem__
        for i, words in split.items():
            out[i] = b"".join(map(get, words))
        if len(self.memo) > self.most // 2:
            self.memo, self.old = {}, self.memo
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@cache
def word_memo(name: str) -> WordMemo:
    """One for all tasks of a Python worker."""
    return WordMemo(name)


@cache
def cuts(n: int, capacity: int = CAPACITY) -> tuple[int, ...]:
    """Lengths of the pieces of a rest of n < capacity tokens."""
    out = []
    while n:
        k = capacity // n
        slot = capacity // k
        if slot - n <= slot * WASTE or capacity // (k + 1) >= n:
            out.append(n)
            break
        out.append(capacity // (k + 1))
        n -= capacity // (k + 1)
    return tuple(out)


def pieces_of(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document's ids."""
    n = len(ids) // 4
    lengths = itertools.chain(itertools.repeat(capacity, n // capacity), cuts(n % capacity, capacity))
    start = 0
    for length in lengths:
        yield start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start += length


class Bins:
    """Open bins by class; a full bin gets its number and its pieces their offsets."""

    def __init__(self, task: int, level: int, capacity: int = CAPACITY):
        self.next = (level << 58) | (task << 30)
        self.capacity, self.open = capacity, defaultdict(list)
        self.out: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.out.append((*p, None, self.next, at))
            at += p[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        self.open[k].append(piece)
        if len(self.open[k]) == k:
            self.close(self.open.pop(k))

    def rest(self) -> Iterator[tuple]:
        for k in sorted(self.open):
            yield from self.open[k]

    def close_rest(self) -> None:
        """First fit, largest first, over what is left."""
        bins: list[list] = []
        for p in sorted(self.rest(), key=lambda p: -p[2]):
            found = next((b for b in bins if b[0] >= p[2]), None)
            if found is None:
                bins.append(found := [self.capacity, []])
            found[0] -= p[2]
            found[1].append(p)
        for _, pieces in bins:
            self.close(pieces)
        self.open.clear()


_KINDS = [x.split()[0] for x in PLACED.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _KINDS]
    return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(_KINDS, columns)})


def _first_level(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = word_memo(tokenizer), np.array([END_ID], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        bins = Bins(task, 0, capacity)
        for b in slices(batches):
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), memo.encode_all([t or "" for t in b.column("text").to_pylist()])):
                ids += end
                for start, length, crc in pieces_of(ids, capacity):
                    bins.add((doc_id, start, length, crc, len(ids) // 4))
            if len(bins.out) > 20_000:
                yield _rows(bins.out)
                bins.out.clear()
        yield _rows(bins.out + [(*p, task, None, None) for p in bins.rest()])

    return run


def _next_level(level: int, last: bool, capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        task = key[0].as_py()
        bins = Bins(task, level, capacity)
        columns = [table.column(n).to_pylist() for n in _KINDS[:5]]
        for piece in sorted(zip(*columns), key=lambda p: (p[2], p[0] is None, p[0] or 0, p[1])):
            bins.add(piece)
        if last:
            bins.close_rest()
        return pa.Table.from_batches([_rows(bins.out + [(*p, task, None, None) for p in bins.rest()])])

    return run


def harmonic_pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of ``docs``.

    Each id of each document, its closing id 2 included, lies in exactly one piece. Null and empty
    texts are one piece of the closing id alone. A null doc_id stays null; rows that repeat a doc_id
    are packed each. Columns other than doc_id and text are not read; an empty table gives none.
    """
    base = documents(docs)
    tasks = base.rdd.getNumPartitions()
    level, done = 0, []
    now = materialize(base.mapInArrow(_first_level(tokenizer, capacity), PLACED), "pack")
    while True:
        done.append(now.filter("sequence_id is not null"))
        tasks = -(-tasks // FAN)
        level += 1
        rests = now.filter("sequence_id is null").withColumn("task", F.pmod("task", F.lit(tasks)).cast("long"))
        now = rests.groupBy("task").applyInArrow(_next_level(level, tasks == 1, capacity), PLACED)
        if tasks <= 1:
            done.append(now)
            break
        now = materialize(now, "pack")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("task")
