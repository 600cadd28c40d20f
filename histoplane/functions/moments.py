"""Statistics of whole columns that neither gather a column in one task nor grow the plan with the number of columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that the driver sorts at the end; beyond it the range is narrowed once more.
AT_ONCE = 50_000
#: Relative accuracy of the sketch that narrows the range; its summary has a few times as many values.
ACCURACY = 10_000
#: Rows of a block whose products are added up at once.
BLOCK = 2048


def _at_ranks(values: DataFrame, n: int, ranks: list[int]) -> list[float]:
    """The values at neighbouring ``ranks`` (from 0) of the one column ``v`` of ``n`` rows without nulls.

    Each round brackets the ranks by two values of a sketch, counts what lies below, at and between them, and goes on
    between them only, with less than a thousandth of the rows; so ties are counted, never gathered.
    """
    found: dict[int, float] = {}
    below = 0
    while len(found) < len(ranks):
        left = [r for r in ranks if r not in found]
        if n <= AT_ONCE:
            rest = np.sort([r[0] for r in values.collect()])  # NaN last, as in Spark
            found |= {r: float(rest[r - below]) for r in left}
            break
        room = 2.0 / ACCURACY
        shares = [max(0.0, (left[0] - below) / n - room), min(1.0, (left[-1] - below) / n + room)]
        low, high = values.agg(F.percentile_approx("v", shares, ACCURACY)).first()[0]
        count = lambda c: F.count(F.when(c, 1))
        v = F.col("v")
        lower, at_low, inside, at_high = values.agg(count(v < low), count(v == low), count((v > low) & (v < high)), count((v == high) & (v > low))).first()
        cuts = np.cumsum([below, lower, at_low, inside, at_high])
        parts = [int(np.searchsorted(cuts, r, side="right")) - 1 for r in left]
        found |= {r: (low if p == 1 else high) for r, p in zip(left, parts) if p in (1, 3)}
        open_parts = {p for p in parts if p not in (1, 3)}
        if not open_parts:
            break
        (part,) = open_parts  # neighbouring ranks on both sides of a bracket value have one of them at it
        kept = {0: v < low, 2: (v > low) & (v < high), 4: v > high}[part]
        values, n, below = values.where(kept), ([lower, 0, inside, 0, n - int(cuts[4] - below)])[part], int(cuts[part])
    return [found[r] for r in ranks]


def exact_quantiles(df: DataFrame, value: Column | str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles of all rows, as ``percentile`` has them, in a few passes; None for each without a value."""
    col = F.col(value) if isinstance(value, str) else value
    values = df.select(col.cast("double").alias("v")).where("v IS NOT NULL")
    n = values.count()
    out: list[float | None] = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        at = share * (n - 1)
        low, high = math.floor(at), math.ceil(at)
        ends = _at_ranks(values, n, sorted({low, high}))
        out.append(ends[0] if low == high or ends[0] == ends[1] else (high - at) * ends[0] + (at - low) * ends[1])
    return out


def covariance(rows: DataFrame, size: int, shift: list[float]) -> np.ndarray:
    """Sample covariance of sparse rows ``(at array<int>, val array<double>)`` of ``size`` columns, 0 where nothing is.

    ``shift`` is near the columns' means, so that no digits are lost; the result doesn't depend on it. Every task
    adds up the products of its rows, and the sums of one column meet in a task.
    """
    centre = np.array(shift, dtype=np.float64)

    def local(batches):
        total, gram, n = np.zeros(size), np.zeros((size, size)), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                some = batch.slice(begin, BLOCK)
                at, val = some.column(0), some.column(1)
                owner = np.repeat(np.arange(some.num_rows), pc.list_value_length(at).to_numpy())
                dense = np.zeros((some.num_rows, size))
                dense[owner, at.flatten().to_numpy()] = val.flatten().to_numpy()
                dense -= centre
                n += some.num_rows
                total += dense.sum(0)
                gram += dense.T @ dense
        if n:
            sums = np.column_stack((gram, total, np.full(size, float(n))))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(sums), pa.list_(pa.float64()))], names=["i", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            total += batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, size + 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["i", "sums"])

    if not size:
        return np.zeros((0, 0))
    # size rows of size + 2 numbers come back, whatever the table
    found = rows.select("at", "val").mapInArrow(local, "i int, sums array<double>").groupBy("i").applyInArrow(add, "i int, sums array<double>").collect()
    if not found:
        return np.zeros((size, size))
    sums = np.zeros((size, size + 2))
    for r in found:
        sums[r["i"]] = r["sums"]
    gram, total, n = sums[:, :size], sums[:, size], sums[0, size + 1]
    return (gram - np.outer(total, total) / n) / (n - 1) if n > 1 else np.zeros((size, size))
