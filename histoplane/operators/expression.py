"""Expression values in long form ``(cell_id, feature, value)``: normalisation, scaling, components, markers, tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.moments import covariance
from ..functions.stats import benjamini_hochberg, normal_p, student_p


def _with(expr: DataFrame, by: str, **aggregates) -> DataFrame:
    """Adds aggregates of each group: by window for cells, whose rows are few; else summed in parts and joined, as a feature has a row for every cell."""
    if by == "cell_id":
        return expr.withColumns({name: value.over(Window.partitionBy(by)) for name, value in aggregates.items()})
    stats = expr.groupBy(F.col(by).alias("_by")).agg(*[value.alias(name) for name, value in aggregates.items()])
    return expr.join(stats, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def centred_log_ratio(expr: DataFrame, margin: str = "cell_id", universe: int | None = None) -> DataFrame:
    """log1p(x / exp(sum of log1p of positive values / N)) over each cell or feature; N is ``universe`` or the rows there are."""
    both = _with(expr, margin, _s=F.sum(F.when(F.col("value") > 0, F.log1p("value")).otherwise(0.0)), _n=F.count("*"))
    centre = F.col("_s") / (F.lit(universe) if universe else F.col("_n"))
    return both.withColumn("value", F.log1p(F.col("value") / F.exp(centre))).drop("_s", "_n")


def centred_log_ratio_nonzero(expr: DataFrame, margin: str = "cell_id") -> DataFrame:
    """The mean is over positive values only; vectors without one stay."""
    both = _with(expr, margin, _c=F.avg(F.when(F.col("value") > 0, F.log1p("value"))))
    return both.withColumn("value", F.when(F.col("_c").isNull(), F.col("value")).otherwise(F.log1p(F.col("value") / F.exp("_c")))).drop("_c")


def log_normalise(expr: DataFrame, scale: float = 10_000.0, log: bool = True) -> DataFrame:
    share = F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("cell_id"))) * scale
    return expr.withColumn("value", F.log1p(share) if log else share)


def scale_features(expr: DataFrame, clip: float = 10.0) -> DataFrame:
    """z-scores within each feature, at most ``clip``; 0 for a constant feature. Two small aggregates a feature instead of a window, so a hot feature is summed in parts."""
    stats = expr.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("_m"), F.col("_s")), F.lit(0.0))
    return expr.join(stats, "feature").select(*[F.least(z, F.lit(clip)).alias("value") if c == "value" else c for c in expr.columns])


def densify(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """A row for each cell and feature: absent ones are 0."""
    features = expr.select("feature").distinct()
    grid = cells.select("cell_id").join(F.broadcast(features))  # features are few against cells
    return grid.join(expr, ["cell_id", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def component_spectrum(expr: DataFrame, features: list[str], components: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the features' covariance, from the products that each task adds up; absent values are 0."""
    table = expr.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, i int")
    placed = expr.join(F.broadcast(table), "feature", "left")  # a row for each feature asked for
    means = dict(placed.where("i IS NOT NULL").groupBy("i").agg(F.avg("value")).collect())
    one = F.when(F.col("i").isNotNull() & F.col("value").isNotNull(), F.struct("i", F.col("value").cast("double").alias("v")))
    rows = placed.groupBy("cell_id").agg(F.array_sort(F.collect_list(one)).alias("r")).select(F.col("r.i").alias("at"), F.col("r.v").alias("val"))
    values, vectors = np.linalg.eigh(covariance(rows, len(features), [means.get(i) or 0.0 for i in range(len(features))]))
    order = np.argsort(values)[::-1][:components]
    return np.maximum(values[order], 0.0), vectors[:, order]


def component_scores(expr: DataFrame, features: list[str], vectors: np.ndarray) -> DataFrame:
    """``cell_id, vec``: projections of centred values."""
    load = expr.sparkSession.createDataFrame([(f, [float(x) for x in vectors[i]]) for i, f in enumerate(features)], "feature string, load array<double>")
    centred = _with(expr, "feature", _m=F.avg("value")).withColumn("value", F.col("value") - F.col("_m"))
    long = centred.join(F.broadcast(load), "feature")
    sums = [F.sum(F.col("value") * F.col("load")[i]) for i in range(vectors.shape[1])]
    return long.groupBy("cell_id").agg(F.array(*sums).alias("vec"))


def cluster_moments(expr: DataFrame, cells: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Count, mean and sum of squared deviations of each (cluster, feature) and of the rest, in one pass over the values.

    The rest's moments are merged from the other clusters' centred ones, which loses no digits.
    """
    joined = expr.join(cells.select("cell_id", F.col(cluster_col).cast("string").alias("cluster")), "cell_id").where("cluster IS NOT NULL AND value IS NOT NULL")
    own = joined.groupBy("cluster", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("ss"))
    other = own.select(F.col("cluster").alias("c2"), "feature", F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("ss").alias("s2"))
    # clusters squared rows a feature
    rest = own.select("cluster", "feature").join(other, "feature").where("cluster <> c2").groupBy("cluster", "feature").agg(
        F.sum("n2").alias("rest_n"), (F.sum(F.col("n2") * F.col("m2")) / F.sum("n2")).alias("rest_mean"), F.sum("s2").alias("_s"), F.collect_list(F.struct("n2", "m2")).alias("_parts")
    )
    between = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["n2"] * (p["m2"] - F.col("rest_mean")) * (p["m2"] - F.col("rest_mean")))
    rest = rest.withColumn("rest_ss", F.col("_s") + between).drop("_s", "_parts")
    return own.join(rest, ["cluster", "feature"], "left")


def welch(moments: DataFrame) -> DataFrame:
    """Adds t and degrees of freedom of Welch's test of each cluster against the rest, and the difference of means."""
    v1, v2 = F.try_divide("ss", F.col("n") - 1), F.try_divide("rest_ss", F.col("rest_n") - 1)
    a, b = v1 / F.col("n"), v2 / F.col("rest_n")
    diff = F.col("mean") - F.col("rest_mean")
    t = F.try_divide(diff, F.sqrt(F.when(a + b > 0, a + b)))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("n") - 1) + F.try_divide(b * b, F.col("rest_n") - 1))
    return moments.withColumn("mean_diff", diff).withColumn("t", t).withColumn("df", F.when(t.isNotNull(), df))


def differential_expression(expr: DataFrame, cells: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """``Protein, Cluster, Mean_Target, Mean_Control, MeanDiff, p_value, adj_p_value, Significance``; clusters or rests of fewer than two values are left out."""
    tested = welch(cluster_moments(expr, cells, cluster_col)).where("n >= 2 AND rest_n >= 2").withColumn("p_value", student_p("t", "df"))
    adjusted = benjamini_hochberg(tested, "p_value", ["cluster"], ["feature"], "adj_p_value")
    label = F.when(F.col("adj_p_value") < 0.05, F.when(F.col("mean_diff") > 0, "Up").otherwise("Down")).when(F.col("adj_p_value").isNotNull(), "NS")
    return adjusted.select(F.col("feature").alias("Protein"), F.col("cluster").alias("Cluster"), F.col("mean").alias("Mean_Target"), F.col("rest_mean").alias("Mean_Control"), F.col("mean_diff").alias("MeanDiff"), "p_value", "adj_p_value", label.alias("Significance"))


def volcano(diff: DataFrame, diff_threshold: float = 0.25, p_threshold: float = 0.05) -> DataFrame:
    hit = F.col("adj_p_value") < p_threshold
    label = F.when(hit & (F.col("MeanDiff") >= diff_threshold), "Up").when(hit & (F.col("MeanDiff") <= -diff_threshold), "Down").otherwise("NS")
    return diff.withColumn("Significance", label).withColumn("neg_log10_p", F.when(F.col("adj_p_value") > 0, -F.log10("adj_p_value")))


def merge_protein(cluster_df: DataFrame, expr_wide: DataFrame, id_col: str = "Cell_ID", cluster_col: str = "Neighborhood_Cluster") -> DataFrame:
    """Left join of clusters with expression by id without its ``Cell_`` marks; coordinates are the left side's."""
    bare = lambda c: F.replace(F.col(c).cast("string"), F.lit("Cell_"), F.lit(""))
    right = expr_wide.drop("X", "Y").withColumn(id_col, bare(id_col))
    return cluster_df.withColumn(id_col, bare(id_col)).join(right, id_col, "left").withColumn("Spatial_Zone", F.col(cluster_col).cast("string"))


def markers(expr: DataFrame, cells: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """One cluster against the rest for every feature: fold change of log values, shares of positive cells, rank sum and its p.

    Ranks are of values, so a feature is ranked over its distinct values with their counts, summed in parts before.
    """
    joined = expr.join(cells.select("cell_id", F.col(cluster_col).cast("string").alias("cluster")), "cell_id").where("cluster IS NOT NULL AND value IS NOT NULL")
    at = joined.groupBy("feature", "cluster", "value").agg(F.count("*").alias("c"))
    values = at.groupBy("feature", "value").agg(F.sum("c").alias("ties"))
    before = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.withColumn("rank", F.coalesce(F.sum("ties").over(before), F.lit(0)) + (F.col("ties") + 1) / 2.0)
    sums = at.join(ranks, ["feature", "value"]).groupBy("feature", "cluster").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"), F.sum(F.when(F.col("value") > 0, F.col("c")).otherwise(0)).alias("positive"), F.sum(F.col("c") * F.expm1("value")).alias("total")
    )
    tie = values.groupBy("feature").agg(F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")).alias("tie"))
    w = Window.partitionBy("feature")
    all_n, all_pos, all_total = F.sum("n").over(w), F.sum("positive").over(w), F.sum("total").over(w)
    one = sums.select("*", (all_n - F.col("n")).alias("m"), (all_pos - F.col("positive")).alias("rest_positive"), (all_total - F.col("total")).alias("rest_total")).where("m > 0").join(tie, "feature")
    u = F.col("rank_sum") - F.col("n") * (F.col("n") + 1) / 2.0
    total = (F.col("n") + F.col("m")).cast("double")
    sigma = F.sqrt(F.col("n").cast("double") * F.col("m") / 12 * (total + 1 - F.col("tie") / (total * (total - 1))))
    shift = u - F.col("n") * F.col("m") / 2.0
    z = F.try_divide(shift - 0.5 * F.signum(shift), sigma)
    fold = F.log2(F.col("total") / F.col("n") + 1) - F.log2(F.col("rest_total") / F.col("m") + 1)
    return one.select("cluster", "feature", "n", "m", fold.alias("avg_log2fc"), (F.col("positive") / F.col("n")).alias("pct_1"), (F.col("rest_positive") / F.col("m")).alias("pct_2"), u.alias("u"), z.alias("z"))


def top_markers(found: DataFrame, min_pct: float = 0.25, threshold: float = 0.25, only_positive: bool = True, top: int = 5) -> DataFrame:
    """The features of largest fold change of each cluster, ties kept, with p-values adjusted for the number of features."""
    n_features = found.select("feature").distinct().count()
    change = F.col("avg_log2fc") if only_positive else F.abs("avg_log2fc")
    kept = found.where((F.greatest("pct_1", "pct_2") >= min_pct) & (change >= threshold))
    kept = kept.withColumn("p", normal_p("z")).withColumn("adj_p", F.least(F.lit(1.0), F.col("p") * n_features))
    return kept.withColumn("place", F.rank().over(Window.partitionBy("cluster").orderBy(F.desc("avg_log2fc")))).where(F.col("place") <= top)


def marker_means(expr: DataFrame, cells: DataFrame, cluster_col: str = "cluster", features: list[str] | None = None) -> DataFrame:
    """Mean of each (feature, cluster) and its z-score within the feature."""
    joined = expr.join(cells.select("cell_id", F.col(cluster_col).alias("cluster")), "cell_id")
    joined = joined.where(F.col("feature").isin(features)) if features else joined
    means = joined.groupBy("feature", "cluster").agg(F.avg("value").alias("mean"))
    row = Window.partitionBy("feature")
    return means.withColumn("z", F.try_divide(F.col("mean") - F.avg("mean").over(row), F.stddev_samp("mean").over(row)))


def marker_distribution(expr: DataFrame, cells: DataFrame, features: list[str], cluster_col: str = "cluster") -> DataFrame:
    """Quartiles of each marker in each cluster, as a violin or box plot needs."""
    there = {r[0] for r in expr.where(F.col("feature").isin(features)).select("feature").distinct().collect()}  # at most the features asked for
    if not there:
        raise ValueError("none of the markers is there")
    joined = expr.where(F.col("feature").isin(sorted(there))).join(cells.select("cell_id", F.col(cluster_col).alias("cluster")), "cell_id")
    quartile = lambda p: F.percentile("value", F.lit(p))
    return joined.groupBy("feature", "cluster").agg(F.count("value").alias("n"), F.min("value").alias("low"), quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"), F.max("value").alias("high"))


def marker_panel(cells: DataFrame, expr: DataFrame, features: list[str] | None = None, id_col: str = "cell_id", x_col: str = "X", y_col: str = "Y") -> DataFrame:
    """Coordinates and value of each cell and marker, all of them by default; the axes are places or those of a layout."""
    chosen = expr.where(F.col("feature").isin(features)) if features else expr
    return cells.select(F.col(id_col).alias("cell_id"), F.col(x_col).alias("X"), F.col(y_col).alias("Y")).join(chosen, "cell_id")
