"""Document fingerprints: threshold-scaled sketches of character shingles.

A text's shingles are its runs of ``SHINGLE_BYTES`` UTF-8 bytes (a shorter text is one shingle), hashed to 32
bits. The fingerprint keeps every hash below the fixed fraction 1 / ``SCALE`` of the range, sorted, as eight hex
digits each; so fingerprints of parts merge by union, and the share of one's hashes that another has estimates
containment whatever their lengths. A text without any hash below the fraction, as many of under ``SCALE`` shingles
are, keeps its smallest one; ``merge`` keeps such a one only where no part has a hash below. It tells equal short texts
from others, but says nothing of containment in a longer text.
``likeness`` is the containment of the smaller fingerprint in the larger one, 1 for two empty texts, 0 for one.

``edited_fingerprints`` puts each document beside the next one in descending order of id. Ids are cut into
ranges at ids that occur, each range is sorted in a task, and the first row of a range is sent to the end of the
one before, so each text is shuffled once and no order is global.

A null text is empty. Rows without an id come last; rows of equal id are in order of their texts (UTF-8 bytes);
repeated rows stay. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, read_table, table_bytes

SHINGLE_BYTES = 16
SCALE = 16
#: Ranges of ids for each partition, so that they even out.
RANGES = 4
OUT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_BASE = 0x9E3779B97F4A7C15


def sketch(text: bytes) -> np.ndarray:
    """Sorted distinct kept hashes (uint32)."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    h = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    width, power = 1, _BASE
    while width < SHINGLE_BYTES and len(h) > width:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    if width < SHINGLE_BYTES:  # shorter than a shingle: what is left depends on every byte
        h = np.array([int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big")], dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h = (h >> np.uint64(32)).astype(np.uint32)
    return np.unique(_below(h))


def _below(hashes: np.ndarray) -> np.ndarray:
    """Of some hashes those below the fraction, the smallest one where there is none."""
    kept = hashes[hashes < np.uint32((1 << 32) // SCALE)]
    return kept if len(kept) or not len(hashes) else hashes.min(keepdims=True)


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of two texts taken together, but for shingles across their seam: exactly that of both texts' shingles."""
    return _below(np.union1d(a, b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(b) < len(a):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return float(np.count_nonzero(b[at] == a)) / len(a)


def edited_text(text: str, following: str) -> str:
    """The last half, rounded down, of ``text``'s code points gives way to the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _deal(bounds: list[int]):
    """Range 0 has the largest ids; range b begins with id bounds[b]; a range's first rows also end the one before."""
    starts = np.array(bounds, dtype=np.int64)
    ascending = starts[::-1]
    n = len(starts)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            null = np.asarray(ids.is_null())
            known = ids.fill_null(int(ascending[0]) if n else 0).to_numpy()
            if n:
                into = n - 1 - np.searchsorted(ascending, known, side="left")
                into[null] = n - 1
                first = ~null & (known == starts[into])
            else:
                into, first = np.zeros(len(known), dtype=np.int64), np.ones(len(known), dtype=bool)
            rows = np.concatenate((np.arange(len(known)), np.flatnonzero(first)))
            bucket = np.concatenate((into, (into[first] - 1) % max(n, 1)))
            tail = np.concatenate((np.zeros(len(known), dtype=np.int32), np.ones(int(first.sum()), dtype=np.int32)))
            took = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(tail), *took.columns], names=["bucket", "tail", "doc_id", "text"])

    return run


def _compare(batches):
    held = None
    for batch in batches:
        rows = []
        for bucket, tail, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            raw = text.as_py() or b""
            now = (bucket, tail, doc_id, raw, None if tail and (held is None or held[1]) else sketch(raw))
            if held and held[0] == bucket and not held[1]:
                rows.append(_row(held, now))
            held = now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], names=[x.split()[0] for x in OUT.split(", ")])


def _row(doc, following):
    text = doc[3].decode("utf-8", "replace")
    edited = edited_text(text, following[3].decode("utf-8", "replace"))
    raw = edited.encode()
    changed = doc[4] if raw == doc[3] else sketch(raw)
    return doc[2], len(text), edited, to_text(doc[4]), to_text(changed), likeness(doc[4], changed), likeness(doc[4], following[4])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the columns of ``OUT``."""
    # an estimate of the files' size; texts take a few times as much once they are read
    parts = partitions_for(docs.sparkSession, table_bytes(docs))
    n = RANGES * parts
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    shares = [i / n for i in range(1, n)]
    found = ids.agg(F.max("id"), F.percentile_approx("id", shares, 10_000 if n <= 10_000 else n)).first()
    bounds = [] if found[0] is None else sorted({found[0], *found[1]}, reverse=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    dealt = rows.mapInArrow(_deal(bounds), "bucket long, tail int, doc_id long, text binary")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(_compare, OUT)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
