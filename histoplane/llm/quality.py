"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, word pairs, word shapes (runs of capitals, small letters and digits as one
sign each, other signs as they are) and pairs of shapes with a mark for a repeated word, hashed into a table of
fixed size; each counts as its share of the text. Training is FTRL-proximal, one example at a time, on a
sample of labelled rows bounded by ``sample`` (the rows of smallest hash, read ``epochs`` times); the weights
(``2 ** bits`` floats) are sent to all tasks, which score every whole text as a sparse dot product.

A null, empty or blank text has no features and scores by the intercept. A label that is null or not 0 or 1
isn't learned from; a document with several labels is learned from with each, of documents that share an id one; labels of unknown documents do
nothing. Without a usable label every score is 0.5. Rows without an id are scored, and held out from nothing.
Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, trim_memory

BITS = 18
SAMPLE = 4_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-6
#: Bytes of words whose hashes a task keeps, and what a word takes besides its characters.
CACHE_BYTES = 32_000_000
ENTRY_BYTES = 190
_M = np.uint64(0x9E3779B97F4A7C15)
_X = np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)


def shape(word: str) -> str:
    out = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


class Features:
    """Feature numbers of a text, one for each word, pair, shape and pair of shapes."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self._reset()

    def _reset(self):
        self.place: dict[str, int] = {}
        self.held = 0
        self.words, self.shapes = np.empty(1024, dtype=np.uint64), np.empty(1024, dtype=np.uint64)

    def _add(self, new) -> None:
        place = self.place
        if len(place) + len(new) > len(self.words):
            size = 2 * (len(place) + len(new))
            self.words, self.shapes = np.resize(self.words, size), np.resize(self.shapes, size)
        for w in new:
            i = place[w] = len(place)
            self.held += ENTRY_BYTES + 2 * len(w)
            self.words[i] = xxhash.xxh3_64_intdigest(w)
            self.shapes[i] = xxhash.xxh3_64_intdigest(shape(w), seed=1)

    def of(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        if not words:
            return np.empty(0, dtype=np.int64)
        if self.held > CACHE_BYTES:
            self._reset()
        place = self.place
        new = {w for w in words if w not in place}
        if new:
            self._add(new)
        at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
        w, s = self.words[at], self.shapes[at]
        same = (at[1:] == at[:-1]).astype(np.uint64)
        pair = (w[:-1] * _M) ^ w[1:]
        shapes = (s[:-1] * _M) ^ (s[1:] + same * _X)
        h = np.concatenate((w, pair * _X, s, shapes * _X))
        h ^= h >> _S
        h *= _M
        return ((h >> np.uint64(20)) & self.mask).astype(np.int64)


def _train(bits: int, epochs: int):
    def run(batches):
        n, z = np.zeros(1 << bits), np.zeros(1 << bits)
        bias_n = bias_z = 0.0
        seen = 0

        def weights(z, n):
            return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

        def bias():
            return -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)

        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]  # as many as the sample at most
        for label, blob in rows * epochs:
            at, counts = np.unique(np.frombuffer(blob, dtype=np.int32), return_counts=True)
            x = counts / max(counts.sum() / 4, 1)
            w = weights(z[at], n[at])
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x) + bias()))))
            g = (p - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            b, g0 = bias(), p - label
            bias_z += g0 - (math.sqrt(bias_n + g0 * g0) - math.sqrt(bias_n)) / ALPHA * b
            bias_n += g0 * g0
            seen += 1
        if seen:
            out = weights(z, n).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([bias()], pa.float64()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["bias", "weights"])

    return run


def _featurise(bits: int):
    def run(batches):
        features = Features(bits)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                blobs = [features.of(t.as_py()).astype(np.int32).tobytes() for t in some.column(2)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(blobs, pa.binary())], names=["turn", "label", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS) -> tuple[float, np.ndarray]:
    """Intercept and weights. ``learn_from`` is a condition on the id, ``sample`` bounds the rows that are learned from."""
    usable = labels.where(learn_from).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    chosen = usable.withColumn("turn", F.xxhash64("_id", "label")).orderBy("turn", "_id").limit(sample)
    # at most ``sample`` rows of 20 bytes
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("turn", "label", "text")
    rows = texts.mapInArrow(_featurise(bits), "turn long, label int, features binary")
    # one text for each chosen label, whatever ids repeat
    rows = rows.groupBy("turn", "label").agg(F.min("features").alias("features"))
    one = rows.repartition(1).sortWithinPartitions("turn", "label", "features").select("label", "features")
    found = one.mapInArrow(_train(bits, epochs), "bias double, weights binary").first()
    if found is None:
        return 0.0, np.zeros(1 << bits, dtype=np.float32)
    return found["bias"], np.frombuffer(zlib.decompress(found["weights"]), dtype=np.float32)


def _score(model, bits: int, at: int, keep: int, names: list[str]):
    def run(batches):
        bias, weights = model.value
        features = Features(bits)
        for batch in batches:
            scores = []
            for text in batch.column(at):
                f = features.of(text.as_py())
                x = float(weights[f].sum(dtype=np.float64)) * 4 / len(f) if len(f) else 0.0
                scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, x + bias)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(scores, pa.float64())], names=names)
        del features
        trim_memory()

    return run


def score(docs: DataFrame, model: tuple[float, np.ndarray], text_col: str = "text", keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """The columns ``keep`` (default all) and ``score``; a ``score`` of the input is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    passed = text_col in keep and docs.schema[text_col].dataType == T.StringType()  # then the text travels once
    ahead = docs.select(*keep) if passed else docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*ahead.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())])
    return ahead.mapInArrow(_score(shared, bits, keep.index(text_col) if passed else len(keep), len(keep), [*keep, "score"]), schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels, ~held_out())
    out = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
