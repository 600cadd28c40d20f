"""The preprocessing chain, plot layouts and orders of heat maps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import keep
from .clustering import graph_clusters, snn_graph
from .expression import centred_log_ratio, centred_log_ratio_nonzero, component_scores, component_spectrum, log_normalise, scale_features
from .local import nearest_vectors
from .neighbours import points


@dataclass
class Processed:
    """Normalised and scaled values, standard deviations and scores of the components, clusters and a plane layout."""

    normalised: DataFrame
    scaled: DataFrame
    stdev: list[float]
    scores: DataFrame
    clusters: DataFrame
    layout: DataFrame


def normalise(expr: DataFrame, method: str = "CLR", margin: int = 2) -> DataFrame:
    """CLR by feature (margin 1) or cell (2), its variant over positive values, LogNormalize, or RC (shares only)."""
    by = {1: "feature", 2: "cell_id"}[margin]
    if method == "CLR":
        return centred_log_ratio(expr, by)
    if method == "CLR_nonzero":
        return centred_log_ratio_nonzero(expr, by)
    if method in ("LogNormalize", "RC"):
        return log_normalise(expr, log=method == "LogNormalize")
    raise ValueError(f"unknown method {method}")


#: Queries and candidates of a task of ``nearest_in_components``.
QUERIES, CANDIDATES = 32_768, 262_144


def nearest_in_components(scores: DataFrame, dims: int, k: int) -> DataFrame:
    """``id, nid, d2, rn``: exact neighbours on all ``dims`` components, by blocks of cells against blocks of others in tasks."""
    v = keep(scores.select(F.col("cell_id").alias("id"), F.slice("vec", 1, dims).alias("v")), "components")
    kind = v.schema["id"].dataType
    n = v.count()
    asked, met = (max(1, -(-n // most)) for most in (QUERIES, CANDIDATES))
    # small tables still go to a few tasks
    asked = max(asked, min(16, n // 1024 + 1))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    left = v.select("id", "v", block(asked).alias("b"), every(met).alias("o"))
    right = v.select(F.col("id").alias("id"), F.col("v").alias("v"), every(asked).alias("b"), block(met).alias("o"))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        ids = [t.column("id").combine_chunks() for t in (q, c)]
        codes = [i.to_numpy(zero_copy_only=False) for i in ids]
        if any(i.dtype == object for i in codes):
            both = np.unique(np.concatenate(codes), return_inverse=True)[1]
            codes = [both[: len(codes[0])], both[len(codes[0]) :]]
        rows = [pa.chunked_array(t.column("v").chunks or [pa.array([], pa.list_(pa.float64()))]).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else np.empty((0, 1)) for t in (q, c)]
        i, j, d = nearest_vectors(rows[0], codes[0], rows[1], codes[1], k)
        return pa.table([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(d)], names=["id", "nid", "d2"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("nid", kind), T.StructField("d2", T.DoubleType())])
    found = left.groupBy("b", "o").cogroup(right.groupBy("b", "o")).applyInArrow(run, schema)
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("d2", "nid"))).where(F.col("rn") <= k)


def graph_layout(nn: DataFrame, steps: int = 200, seed: int = 42) -> DataFrame:
    """``id, x, y``: a plane layout that draws neighbours together and pushes sampled others apart. One task holds the whole graph."""
    kind = dict(nn.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["id"].to_numpy(), pdf["nid"].to_numpy())))
        pdf = pdf.sort_values(["id", "rn"])
        a, b = np.searchsorted(ids, pdf["id"].to_numpy()), np.searchsorted(ids, pdf["nid"].to_numpy())
        d = np.sqrt(pdf["d2"].to_numpy())
        low = np.full(len(ids), np.inf)
        np.minimum.at(low, a, d)
        w = np.exp(-(d - low[a]) / max(float(np.mean(d - low[a])), 1e-12))
        rnd = np.random.default_rng(seed)
        y = rnd.normal(0, 5, (len(ids), 2))
        ends = np.concatenate((a, b))
        for step in range(steps):
            rate = 1 - step / steps
            gap = y[a] - y[b]
            s = (gap**2).sum(1)
            pull = (-2 * w / (1 + s))[:, None] * gap
            other = rnd.integers(0, len(ids), len(a))
            away = y[a] - y[other]
            s = (away**2).sum(1)
            push = (2 / ((0.1 + s) * (1 + s)))[:, None] * away
            pull = np.clip(pull, -4, 4)
            both = np.concatenate((pull + np.clip(push, -4, 4), -pull))
            move = np.column_stack([np.bincount(ends, weights=both[:, c], minlength=len(ids)) for c in (0, 1)])
            y += rate * np.clip(move, -4, 4)
        return pd.DataFrame({"id": ids, "x": y[:, 0], "y": y[:, 1]})

    return nn.groupBy(F.lit(0).alias("_all")).applyInPandas(run, f"id {kind}, x double, y double")


def process_data(expr: DataFrame, features: list[str], method: str = "CLR", margin: int = 2, dims: int = 10, resolution: float = 0.5, k: int = 20) -> Processed:
    """Normalise, scale, components, shared-neighbour graph, communities, layout; values and scores are kept between the jobs."""
    normalised = keep(normalise(expr, method, margin), "normalised")
    scaled = keep(scale_features(normalised), "scaled")
    values, vectors = component_spectrum(scaled, features)
    scores = keep(component_scores(scaled, features, vectors), "scores")
    nn = keep(nearest_in_components(scores, min(dims, len(features)), k), "components-nn")
    clusters = graph_clusters(snn_graph(nn, k), resolution, weight="weight")
    return Processed(normalised, scaled, [float(v) ** 0.5 for v in values], scores, clusters, graph_layout(nn))


def dendrogram_order(matrix: np.ndarray, method: str = "complete") -> list[int]:
    """Order of a small matrix's rows by agglomeration (complete linkage, or Ward's on squared distances)."""
    groups = {i: [i] for i in range(len(matrix))}
    d = {(i, j): float(np.linalg.norm(matrix[i] - matrix[j])) for i in range(len(matrix)) for j in range(i)}
    while len(groups) > 1:
        (i, j) = min(d, key=lambda p: (d[p], p))
        ni, nj = len(groups[i]), len(groups[j])
        for o in groups:
            if o not in (i, j):
                a, b = d.pop((max(i, o), min(i, o))), d.pop((max(j, o), min(j, o)))
                no = len(groups[o])
                d[max(j, o), min(j, o)] = max(a, b) if method == "complete" else (((ni + no) * a * a + (nj + no) * b * b - no * d[i, j] ** 2) / (ni + nj + no)) ** 0.5
        del d[i, j]
        groups[j] = groups[j] + groups.pop(i)
    return next(iter(groups.values()), [])


def plane_points(layout: DataFrame, clusters: DataFrame) -> DataFrame:
    """Layout with clusters, as a scatter plot needs."""
    return layout.join(clusters, "id", "left")


def spatial_scatter(cells: DataFrame, category: str) -> DataFrame:
    return points(cells, "cell_id", "X", "Y", F.col(category).alias("category"))
