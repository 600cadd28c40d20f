"""Mixing sources to target weights by entropy balancing, on DataFrame operations only.

Each document gets a rate, its expected number of copies, between 0 and ``cap`` (2). Among all rates
whose expected words meet each source's target, those of largest entropy are exponential tilts of a
fair binomial number of copies: ``rate = cap / (1 + exp(-lambda * size / scale))``, with one multiplier
``lambda`` for each source. The multipliers solve the convex dual; as a rate depends on source and size
only, each Newton iteration is one aggregation of the (source, size) histogram, with all sources at once.
Rates are rounded into copies by a hash of the row, and a source's remaining gap is closed by moving
single copies in hash order until its words are as near the target as the next document allows. Rows equal in id,
source and text are numbered within their group, part of the input by part, and their hashes moved on by equal steps, so a
group of them takes its rate's share of copies, rounded once.

Nulls and blanks: a null or blank text has size 0, adds nothing and takes part with rate 1 (its copies
carry no words); a null source is a source of its own, last in order. A null id is an id like others.
Repeated rows are documents of their own. A source without words has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, read_table

WORD = r"[^\x20\x09-\x0D]+"
#: Newton stops when every source's words are this near its target, or after so many iterations.
TOLERANCE = 1e-10
MAX_ITERATIONS = 60
#: Rows of a source that are summed in one task.
RUN_ROWS = 1_000
#: Passes that close a source's gap, each with documents of at most twice the gap left by the one before.
CLOSINGS = 2


def _sources(sized: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> DataFrame:
    """``src, source_size, rows, scale, target``: one row a source, targets filled up to ``cap`` times its size by weight.

    Only source rows meet in the two windows without a key. Filling in order of size for each unit of
    weight is the fixed point of sharing the excess again and again.
    """
    by = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    fill = Window.orderBy(F.col("ratio"), F.col("src").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumn("limit", F.col("source_size") * cap).withColumn("ratio", F.col("limit") / F.col("weight"))
    ranked = ranked.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    full = F.col("limit") <= F.col("weight") * F.col("level")
    level = F.min(F.when(~full, F.struct("ratio", "level"))).over(every)["level"]
    ranked = ranked.withColumn("target", F.when(full, F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("weight") * level)))
    return ranked.select("src", "source_size", "rows", F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(F.lit(1.0)).alias("scale"), "target")


def _rate(lam: Column, size: Column, scale: Column, cap: int) -> Column:
    return F.lit(float(cap)) / (F.lit(1.0) + F.exp(-lam * size / scale))


def _multipliers(histogram: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """``src, lam``: the dual's solution of each source whose target lies strictly between 0 and ``cap`` times its size.

    The derivative of the dual is taken on the logit scale, on which it is straight for documents of one
    size; the step is kept inside the bracket that the signs seen so far give.
    """
    open_ = sources.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap))
    goal = F.log(F.col("target") / (F.col("source_size") * cap - F.col("target")))
    state = open_.select("src", "scale", (F.col("source_size") * cap).cast("double").alias("most"), "target", goal.alias("goal"), F.lit(0.0).alias("lam"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(float("inf")).alias("gap"))
    state = cut(state, "op1-state")
    for _ in range(MAX_ITERATIONS):
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
        size = F.col("size").cast("double")
        rate = _rate(F.col("lam"), size, F.col("scale"), cap)
        sums = (
            histogram.join(state.select("src", "lam", "scale"), histogram["src"].eqNullSafe(state["src"]))
            .select(state["src"].alias("s"), (F.col("n") * size * rate).alias("f"), (F.col("n") * size * size / F.col("scale") * rate * (1 - rate / cap)).alias("d"))
            .groupBy("s")
            .agg(F.sum("f").alias("f"), F.sum("d").alias("d"))
        )
        joined = state.join(sums, state["src"].eqNullSafe(sums["s"])).drop("s")
        off = F.col("goal") - F.log(F.col("f") / (F.col("most") - F.col("f")))
        low = F.when(off > 0, F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(off < 0, F.least("high", "lam")).otherwise(F.col("high"))
        slope = F.col("d") * F.col("most") / (F.col("f") * (F.col("most") - F.col("f")))
        step = F.col("lam") + off / slope
        middle = F.when(F.col("low") == float("-inf"), F.col("high") * 2 - 1).when(F.col("high") == float("inf"), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        gap = F.abs(F.col("f") - F.col("target")) / F.col("target")
        moved = joined.withColumn("gap", gap).withColumn("low", low).withColumn("high", high).withColumn("step", step)
        stay = F.col("gap") <= TOLERANCE
        good = F.col("step").isNotNull() & ~F.isnan("step") & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        after = cut(moved.withColumn("lam", F.when(stay, F.col("lam")).when(good, F.col("step")).otherwise(middle)).select(state.columns), "op1-state")
        drop_cut(state)
        state = after
    return state.select("src", F.round("lam", 9).alias("lam"))


def _running(rows: DataFrame, value: Column) -> DataFrame:
    """Adds ``upto``: the running sum of ``value`` over a source's rows by hash, summed in runs of bounded length, then over the runs."""
    run = F.floor(F.col("u") * F.ceil(F.col("rows") / RUN_ROWS)).cast("long")
    rows = rows.withColumn("value", value).withColumn("run", run)
    totals = rows.groupBy("src", "run").agg(F.sum("value").alias("total"))
    earlier = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("src").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("src", "run").orderBy("u", "id", "size", "h", "part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("value").over(inside))
    return rows.join(totals, rows["src"].eqNullSafe(totals["s"]) & (rows["run"] == totals["r"])).withColumn("upto", F.col("earlier") + F.col("inside")).drop("s", "r", "earlier", "inside", "run")


ROW = ["id", "src", "size", "h"]


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    on = F.lit(True)
    for c in cols:
        on = on & left[c].eqNullSafe(right[f"{c}_2"])
    return on


def _repeats(sized: DataFrame) -> DataFrame:
    """``id_2, ..., c``: the rows that stand in the table more than once, and how often."""
    return sized.groupBy(*ROW).agg(F.count("*").alias("c")).where("c > 1").select(*[F.col(c).alias(f"{c}_2") for c in ROW], "c")


def _parts(sized: DataFrame, repeats: DataFrame) -> DataFrame:
    """``row, part``: the number of each repeated row in its group, over the size of the group.

    Rows are numbered within a part of the input (``row`` has it in its high bits), then over the parts, so no task holds a whole group.
    """
    rows = cut(sized.join(repeats, _same(sized, repeats, ROW)).select("row", *ROW, "c", F.shiftright("row", 33).alias("pid")), "op1-repeated")
    inside = F.row_number().over(Window.partitionBy(*ROW, "pid").orderBy("row"))
    counts = rows.groupBy(*ROW, "pid").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*ROW).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(*[F.col(c).alias(f"{c}_2") for c in [*ROW, "pid"]], "earlier")
    rows = rows.withColumn("inside", inside)
    return cut(rows.join(counts, _same(rows, counts, [*ROW, "pid"])).select("row", ((F.col("earlier") + F.col("inside") - 1) / F.col("c")).alias("part")), "op1-parts")


def _read(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("id"), F.col(source_col).alias("src"), _size(text_col).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("h")]


def numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents with ``__part`` (0 but for repeated rows), and ``id, src, size, h, part`` of each.

    Only a table with repeated rows is written anew, with numbers for its rows.
    """
    cols = _read(docs, id_col, text_col, source_col)
    sized = cut(docs.select(*cols), "op1-sizes")
    repeats = cut(_repeats(sized), "op1-repeats")
    if not repeats.take(1):
        return docs.withColumn("__part", F.lit(0.0)), sized.withColumn("part", F.lit(0.0))
    drop_cut(sized)
    docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "op1-numbered")
    sized = cut(docs.select(F.col("__row").alias("row"), *cols), "op1-sizes")
    parts = _parts(sized, repeats)
    sized = sized.join(parts, "row", "left").select(*ROW, F.coalesce("part", F.lit(0.0)).alias("part"))
    named = parts.select(F.col("row").alias("__row"), F.col("part").alias("__part"))
    docs = docs.join(named, "__row", "left").withColumn("__part", F.coalesce("__part", F.lit(0.0))).drop("__row")
    return docs, cut(sized, "op1-sizes")


def solve(sized: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> DataFrame:
    """A row of parameters for each source, from the rows of ``numbered``."""
    sources = cut(_sources(sized, weights, share, cap), "op1-sources")
    histogram = cut(sized.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("n")), "op1-histogram")
    lam = _multipliers(histogram, sources, cap)
    lam = lam.select(F.col("src").alias("s"), "lam")
    params = cut(sources.join(lam, sources["src"].eqNullSafe(lam["s"]), "left").drop("s").withColumn("closings", F.array().cast("array<struct<gap:bigint,until:double>>")), "op1-params")
    for _ in range(CLOSINGS):
        rows = _with_copies(sized, params, cap)
        taken = rows.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.max("target").alias("goal"))
        gaps = cut(taken.select("src", F.round(F.col("goal") - F.col("got")).cast("long").alias("gap")), "op1-gaps").withColumnRenamed("src", "s")
        rows = rows.join(gaps, rows["src"].eqNullSafe(gaps["s"])).drop("s")
        upto = _running(rows, F.when(_movable(F.col("gap"), cap), F.col("size")).otherwise(F.lit(0)).cast("long"))
        moved = (F.col("value") > 0) & (F.col("upto") - F.col("value") / 2 <= F.abs("gap"))
        until = upto.groupBy("src").agg(F.max("gap").alias("gap"), F.max(F.when(moved, F.col("u"))).alias("until")).select(F.col("src").alias("s"), F.struct("gap", F.coalesce("until", F.lit(-1.0)).alias("until")).alias("closing"))
        after = params.join(until, params["src"].eqNullSafe(until["s"])).withColumn("closings", F.array_append("closings", F.col("closing"))).select(params.columns)
        params = cut(after, "op1-params")
    return params


def _movable(gap: Column, cap: int) -> Column:
    return (F.col("size") > 0) & (F.col("size") <= F.abs(gap) * 2) & F.when(gap > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)


def _with_copies(rows: DataFrame, params: DataFrame, cap: int) -> DataFrame:
    """``rows`` (with id, src, size, h, part) and their sources' parameters, ``rate``, ``u`` and ``copies``: a function of the row and its source alone."""
    full = F.col("target") >= F.col("source_size") * cap
    rate = F.when(full, F.lit(float(cap))).when(F.col("lam").isNull(), F.lit(0.0)).otherwise(_rate(F.col("lam"), F.col("size").cast("double"), F.col("scale"), cap))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.round(rate, 9))
    drawn = lambda name: F.pmod(F.xxhash64("id", "size", "h", F.lit(name)), F.lit(1 << 53)) / F.lit(float(1 << 53)) + F.col("part")
    unit, other = (drawn(name) - F.floor(drawn(name)) for name in ("mix", "gap"))
    named = params.withColumnRenamed("src", "s")
    rows = rows.join(named, rows["src"].eqNullSafe(named["s"])).drop("s").withColumn("rate", rate).withColumn("u", other)
    rows = rows.withColumn("copies", F.least(F.floor(F.col("rate") + unit), F.lit(cap)).cast("long"))
    for i in range(CLOSINGS):
        closing = F.get("closings", F.lit(i))
        moves = closing.isNotNull() & (F.col("u") <= closing["until"]) & _movable(closing["gap"], cap)
        rows = rows.withColumn("copies", F.when(moves, F.col("copies") + F.signum(closing["gap"]).cast("long")).otherwise(F.col("copies")))
    return rows.drop("closings")


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row per document: ``id, src, size, source_size, target, rate, copies``.

    ``copies`` is between 0 and ``cap``; each source's sum of ``copies * size`` comes within about half the size of
    one document of its target, as far as there are documents no larger than the gap.
    """
    _, sized = numbered(docs, id_col, text_col, source_col)
    params = solve(sized, weights, share, cap)
    return _with_copies(sized, params, cap).select("id", "src", "size", "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The documents themselves, each repeated as often as it has copies; the columns stay.

    Copies follow from the row and the few numbers of its source, so texts are joined with those and not shuffled by id
    (by the row's number, where rows repeat).
    """
    whole, sized = numbered(docs, id_col, text_col, source_col)
    params = solve(sized, weights, share, cap)
    row = whole.select(F.struct(*docs.columns).alias("row"), *_read(whole, id_col, text_col, source_col), F.col("__part").alias("part"))
    out = _with_copies(row, params, cap).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mixed_copies(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("src").alias("source"), "rate")
