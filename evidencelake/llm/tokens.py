"""Token counts by overlap resynchronisation.

A text of more than ``CHUNK`` bytes is encoded in overlapping chunks with offsets.
Two neighbours are spliced inside their overlap at a boundary that is

- common: both encodings have a token boundary there, with ``RUN`` equal tokens on either side, and
- proven stable: a non-space character stands before it and a space after it. No vocabulary entry
  holds a space after another character (checked when the model is loaded), so no merge of the
  whole text's encoding crosses such a place, and the parts encode as they do in the whole.

Where an overlap has no such place, it doubles; in the end the chunk reaches the end of the text
and is the plain encoding. Memory follows the chunk, not the document, but for unbroken strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP, RUN = 20_000, 400, 4
LIMIT = 4096
SPACE_MARK = "▁"


@cache
def _model(name: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether its vocabulary proves the boundary before a space."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    proven = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
    # the normaliser must keep characters where they are, or chunks would not be parts of the whole
    return sp, proven and sp.normalize("a  b ﬁ") in (f"{SPACE_MARK}a{SPACE_MARK}{SPACE_MARK}b{SPACE_MARK}ﬁ", "a  b ﬁ")


def _spans(sp: sentencepiece.SentencePieceProcessor, raw: bytes, low: int, stop: int) -> list[tuple[int, int, int]]:
    """(begin, end, id) of each token of raw[low:stop], in bytes of the whole text."""
    return [(p.begin + low, p.end + low, p.id) for p in sp.encode(raw[low:stop].decode(), return_type="proto").pieces]


def _start(raw: bytes, at: int) -> int:
    """``at``, or the start of the character that it cuts."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _splice(left: list, right: list, raw: bytes, low: int) -> tuple[int, int] | None:
    """Indices (i, j): tokens before left[i] and from right[j] on make up the common encoding."""
    starts = {b: j for j, (b, e, _) in enumerate(right) if e > b}
    for i in range(len(left) - RUN, RUN, -1):
        b = left[i][0]
        if b <= low:
            return None
        j = starts.get(b)
        if j is None or j < RUN or raw[b] != 0x20 or raw[b - 1] == 0x20 or raw[:b].endswith(SPACE_MARK.encode()):
            continue
        if left[i - RUN : i + RUN] == right[j - RUN : j + RUN]:
            return i, j
    return None


def encode_long(text: str, model: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of ``text``, equal to those of encoding it at once; chunk and overlap in UTF-8 bytes."""
    sp, proven = _model(model)
    raw = text.encode()
    if len(raw) <= chunk or not proven:
        return sp.encode(text)
    ids: list[int] = []
    base, end = 0, _start(raw, chunk)  # the left encoding is of raw[base:end], from ``base`` on a stable start
    left = _spans(sp, raw, 0, end)
    while end < len(raw):
        wide = overlap
        while True:
            low = _start(raw, max(base, end - wide))
            stop = _start(raw, end + chunk)
            if low == base:
                # nothing to splice at: what is left is encoded again, together with what follows
                stop = _start(raw, end + max(chunk, end - base))
                left, end = _spans(sp, raw, base + (base > 0), stop), stop  # the model's own leading space stands for the one at base
                break
            right = _spans(sp, raw, low, stop)
            if cut := _splice(left, right, raw, low):
                i, j = cut
                ids += [x for _, _, x in left[:i]]
                left, base, end = right[j:], right[j][0], stop
                break
            wide *= 2
    return ids + [x for _, _, x in left]


def _counter(model: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = _model(model)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if 4 * len(t) <= chunk or len(t.encode()) <= chunk]
            for at in range(0, len(short), 256):
                some = short[at : at + 256]
                for i, ids in zip(some, sp.encode([texts[i] for i in some], num_threads=1)):
                    counts[i] = len(ids)
            for i in set(range(len(texts))).difference(short):
                counts[i] = len(encode_long(texts[i], model, chunk))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_tokens": pa.array(counts, pa.int64())})

    return run


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row of ``docs``; no shuffle.

    Null and empty texts have 0 tokens. A null doc_id stays null and rows that repeat a doc_id are
    counted each. Columns other than doc_id and text are not read; an empty table gives none.
    """
    base = documents(docs).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = base.mapInArrow(_counter(model, chunk), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
