"""Correlations, multiplicity adjustment, two-way fixed effects and small regressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caldrift.functions.expr import ratio
from caldrift.functions.pvalues import normal_p, student_p
from caldrift.functions.scratch import Scratch

from . import ranks


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    x = c.cast("double")
    return F.when(F.abs(F.nanvl(x, F.lit(float("inf")))) < float("inf"), x)


def pairs(df: DataFrame, groups: list[str], outcomes: list[str], predictors: list[str]) -> DataFrame:
    """One row per observation, outcome and predictor, complete or not."""
    cells = [F.struct(F.lit(o).alias("outcome"), F.lit(p).alias("predictor"), finite(F.col(o)).alias("y"), finite(F.col(p)).alias("x")) for o in outcomes for p in predictors]
    return df.select(*groups, F.explode(F.array(*cells)).alias("c")).select(*groups, "c.*")


def ranked(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with the average ranks of columns within the keys' groups: {column: name of its rank}. Null and NaN have none.

    Ranks are of distinct values and written, so a value that many rows share is one row of a table whose size the optimizer knows, and its
    join can be broadcast or split.
    """
    scratch = Scratch(df.sparkSession)
    for c, name in columns.items():
        of = scratch.write(ranks.average_ranks(ranks.cumulative(df, keys, c)), f"ranks-of-{c}")
        df = df.withColumn("caldrift_key", ranks.group(keys)).join(of.select(F.col("g").alias("caldrift_key"), F.col("value").alias(c), F.col("rank").alias(name)), ["caldrift_key", c], "left").drop("caldrift_key")
    return df


def correlations(df: DataFrame, groups: list[str], outcomes: list[str], predictors: list[str], min_n: int = 8) -> DataFrame:
    """Pearson and Spearman for every group, outcome and predictor: from moments, and moments of average ranks.

    The pairs are written once; a group's ranks are a prefix scan (``ranks``), so groups may be few and large.
    """
    keys = [*groups, "outcome", "predictor"]
    long = Scratch(df.sparkSession).write(pairs(df, groups, outcomes, predictors), "pairs")
    full = long.where("x IS NOT NULL AND y IS NOT NULL")
    spearman = ranked(full, keys, {"x": "rx", "y": "ry"}).select(*keys, F.col("rx").alias("x"), F.col("ry").alias("y"))
    both = full.select(*keys, "x", "y", F.lit("pearson").alias("method")).unionByName(spearman.withColumn("method", F.lit("spearman")))
    out = both.groupBy(ranks.group(keys).alias("g"), "method").agg(
        F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    varies = (F.col("n") >= min_n) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    methods = long.select(ranks.group(keys).alias("g")).distinct().withColumn("method", F.explode(F.array(F.lit("pearson"), F.lit("spearman"))))
    return methods.join(out, ["g", "method"], "left").select(
        "g.*", "method", F.coalesce("n", F.lit(0)).alias("sample_count"), F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("c"), F.col("sx") * F.col("sy"))))).alias("correlation")
    )


def with_p(df: DataFrame, families: list[str] | None = None) -> DataFrame:
    """``correlations`` with the two-sided t-test and its adjusted value."""
    r, k = F.col("correlation"), F.col("sample_count") - 2
    t = F.when(F.abs(r) < 1, r * F.sqrt(ratio(k, 1 - r * r))).otherwise(F.when(r.isNotNull(), F.lit(float("inf"))))
    return benjamini_hochberg(df.withColumn("p_value", F.when(r.isNotNull(), student_p(t, k.cast("double")))), "p_value", "q_value", families or [])


def benjamini_hochberg(df: DataFrame, p: str, out: str, families: list[str]) -> DataFrame:
    """Adjusted values within each family: the running minimum, from the largest p on, of p times count over rank.

    Both the rank and the minimum are scans in two levels over a family's distinct values (``ranks``), so a family may be the whole table.
    """
    family = ranks.group(families).alias("caldrift_key")
    values = Scratch(df.sparkSession).write(ranks.cumulative(df, families, p), "p-values")
    found = ranks.adjusted(values).select(F.col("g").alias("caldrift_key"), F.col("value").alias("bh_p"), F.col("adjusted").alias(out))
    return df.select("*", family, F.nanvl(F.col(p).cast("double"), F.lit(None)).alias("bh_p")).join(found, ["caldrift_key", "bh_p"], "left").drop("caldrift_key", "bh_p")


def lagged(df: DataFrame, groups: list[str], time: str, value: str, steps: Sequence[int]) -> DataFrame:
    """``df`` with the value k grid steps before (after, for negative k) in ``lag_{k}`` columns."""
    w = Window.partitionBy(*groups).orderBy(time)
    name = lambda k: f"lag_{k}" if k >= 0 else f"lead_{-k}"
    return df.select("*", *[F.lag(value, k).over(w).alias(name(k)) for k in steps])


def demeaned(df: DataFrame, groups: list[str], entity: str, time: str, columns: list[str]) -> DataFrame:
    """Balanced panels: each value less its entity's and time's mean, plus the whole mean.

    Means are aggregates by key of the panel, written once, and joined back: its rows are dealt by entity or time, or stay where they are when the
    means are small.
    """
    return _demeaned(Scratch(df.sparkSession).write(df, "panel"), groups, entity, time, columns)


def _demeaned(df: DataFrame, groups: list[str], entity: str, time: str, columns: list[str]) -> DataFrame:
    out = df
    for mark, keys in (("e", [*groups, entity]), ("t", [*groups, time]), ("w", groups)):
        means = df.groupBy(ranks.group(keys).alias("caldrift_key")).agg(*[F.avg(c).alias(f"{c}_{mark}_mean") for c in columns])
        out = out.withColumn("caldrift_key", ranks.group(keys)).join(means, "caldrift_key").drop("caldrift_key")
    within = [(F.col(c) - F.col(f"{c}_e_mean") - F.col(f"{c}_t_mean") + F.col(f"{c}_w_mean")).alias(f"{c}_within") for c in columns]
    return out.select(*df.columns, *within)


def cluster_meat(df: DataFrame, groups: list[str], cluster: str, score: str) -> DataFrame:
    """Sum over clusters of the square of their summed scores."""
    return df.groupBy(*groups, cluster).agg(F.sum(score).alias("s")).groupBy(*groups).agg(F.sum(F.col("s") * F.col("s")).alias("meat"))


def two_way_balanced(df: DataFrame, groups: list[str], entity: str, time: str, y: str, x: str) -> DataFrame:
    """Fixed-effects slope of balanced panels with errors clustered both ways (entity plus time less white); all JVM.

    Means in one step are right for full panels only: a group in which an entity lacks a time, or has one twice, has null results
    (``two_way`` finds them).
    """
    scratch = Scratch(df.sparkSession)
    own = scratch.write(df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*groups, entity, time, y, x), "panel")
    d = _demeaned(own, groups, entity, time, [y, x]).select(*groups, entity, time, F.col(f"{y}_within").alias("yw"), F.col(f"{x}_within").alias("xw"))
    sums = d.groupBy(*groups).agg(F.count("*").alias("n"), F.countDistinct(entity).alias("entities"), F.countDistinct(time).alias("times"), F.sum(F.col("xw") * F.col("xw")).alias("sxx"), F.sum(F.col("xw") * F.col("yw")).alias("sxy"), F.sum(F.col("yw") * F.col("yw")).alias("syy"))
    cells = own.groupBy(*groups, entity, time).agg(F.count("*").alias("k")).groupBy(*groups).agg(F.max("k").alias("most"), F.count("*").alias("cells"))
    full = (F.col("most") == 1) & (F.col("cells") == F.col("entities") * F.col("times"))
    slope = sums.join(cells, groups).withColumn("coefficient", F.when(full & (F.col("sxx") > 1e-12), F.col("sxy") / F.col("sxx"))).drop("most", "cells")
    e = d.join(slope.select(*groups, "coefficient"), groups).withColumn("u", F.col("yw") - F.col("coefficient") * F.col("xw")).withColumn("score", F.col("xw") * F.col("u"))
    by_entity = cluster_meat(e, groups, entity, "score").withColumnRenamed("meat", "m_entity")
    by_time = cluster_meat(e, groups, time, "score").withColumnRenamed("meat", "m_time")
    white = e.groupBy(*groups).agg(F.sum(F.col("score") * F.col("score")).alias("m_white"), F.sum(F.col("u") * F.col("u")).alias("ssr"))
    variance = ratio(F.col("m_entity") + F.col("m_time") - F.col("m_white"), F.col("sxx") * F.col("sxx"))
    return slope.join(by_entity, groups).join(by_time, groups).join(white, groups).withColumn("v", variance).select(
        *groups, "n", "entities", "times", "coefficient", F.when(F.col("v") > 0, F.sqrt(F.when(F.col("v") > 0, F.col("v")))).alias("standard_error"), ratio(F.col("syy") - F.col("ssr"), F.col("syy")).alias("within_r2")
    )


#: Alternations in one written round of ``projected``.
ALTERNATIONS = 4


def projected(rows: DataFrame, scratch: Scratch, tolerance: float = 1e-12, most: int = 100) -> DataFrame:
    """``rows`` (g, e, t, y, x) with yw and xw: y and x less the entity effects (by e) and time effects (by t) of their panel g.

    Alternating projections on the effects: an entity's is the mean of what the times leave, a time's the mean of what the entities leave. Only the effects,
    a row for each entity and time, go from round to round, written; rows stay as they are and meet them by key. It ends when no effect of a round of
    ``ALTERNATIONS`` has moved by more than the tolerance, in deviations of its panel, or after ``most``.
    """
    columns = ["y", "x"]

    def means(by: str, of: DataFrame, less: list[str]) -> DataFrame:
        return of.groupBy("g", by).agg(*[F.avg(F.col(c) - F.col(f"{c}_{k}") if k else F.col(c)).alias(f"{c}_{by}") for c in columns for k in (less or [None])])

    size = rows.groupBy("g").agg(*[F.stddev_pop(c).alias(f"{c}_size") for c in columns])
    times = None
    for done in range(ALTERNATIONS, most + ALTERNATIONS, ALTERNATIONS):
        now = times
        for k in range(ALTERNATIONS):
            left = rows if now is None else rows.join(now.drop("g"), "t")
            entities = means("e", left, ["t"] if now is not None else [])
            if k == ALTERNATIONS - 1:
                entities = scratch.write(entities, f"entities-{done}")
            now = means("t", rows.join(entities.drop("g"), "e"), ["e"])
        now = scratch.write(now, f"times-{done}")
        if times is not None:
            before = times.select("t", *[F.col(f"{c}_t").alias(f"{c}_before") for c in columns])
            moved = now.join(before, "t").join(size, "g")
            far = [F.max(F.abs(F.col(f"{c}_t") - F.col(f"{c}_before")) / F.when(F.col(f"{c}_size") > 0, F.col(f"{c}_size"))) for c in columns]
            if (moved.agg(F.greatest(F.coalesce(far[0], F.lit(0.0)), F.coalesce(far[1], F.lit(0.0))).alias("far")).first().far or 0.0) <= tolerance:
                times = now
                break
        times = now
    return rows.join(entities.drop("g"), "e").join(times.drop("g"), "t").select("g", "e", "t", *columns, *[(F.col(c) - F.col(f"{c}_e") - F.col(f"{c}_t")).alias(f"{c}w") for c in columns])


def two_way(df: DataFrame, groups: list[str], entity: str, time: str, outcomes: list[str], predictors: list[str], min_n: int = 8) -> DataFrame:
    """Fixed effects of every group, outcome and predictor, a row for each, also where undefined; panels needn't be balanced.

    All panels are projected together (``projected``); slope, clustered errors and R2 are sums by panel, entity and time. p by the normal tail, 95 % bounds
    by 1.96 errors. Rows with a null or non-finite y or x take no part.
    """
    keys = [*groups, "outcome", "predictor"]
    scratch = Scratch(df.sparkSession)
    long = scratch.write(pairs(df, [*groups, entity, time], outcomes, predictors), "pairs")
    g = ranks.group(keys)
    rows = scratch.write(long.where("x IS NOT NULL AND y IS NOT NULL").select(g.alias("g"), F.struct(g, F.col(entity)).alias("e"), F.struct(g, F.col(time)).alias("t"), "y", "x"), "rows")
    within = scratch.write(projected(rows, scratch), "within")
    xw, yw = F.col("xw"), F.col("yw")
    sums = within.groupBy("g").agg(
        F.count("*").alias("n"), F.count_distinct("e").alias("entities"), F.count_distinct("t").alias("times"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.sum(xw * xw).alias("sxx"), F.sum(xw * yw).alias("sxy"), F.sum(yw * yw).alias("syy"))
    defined = (F.col("n") >= min_n) & (F.col("entities") >= 2) & (F.col("times") >= 2) & (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0")) & (F.col("sxx") > 1e-12)
    slope = sums.select("g", "n", "entities", "times", "sxx", "syy", F.when(defined, F.col("sxy") / F.when(defined, F.col("sxx"))).alias("coefficient"))
    scores = within.join(slope.select("g", "coefficient"), "g").withColumn("u", yw - F.col("coefficient") * xw).withColumn("score", xw * F.col("u"))
    by_entity = cluster_meat(scores, ["g"], "e", "score").withColumnRenamed("meat", "m_entity")
    by_time = cluster_meat(scores, ["g"], "t", "score").withColumnRenamed("meat", "m_time")
    white = scores.groupBy("g").agg(F.sum(F.col("score") * F.col("score")).alias("m_white"), F.sum(F.col("u") * F.col("u")).alias("ssr"))
    variance = ratio(F.col("m_entity") + F.col("m_time") - F.col("m_white"), F.col("sxx") * F.col("sxx"))
    error = F.when(F.col("v") > 0, F.sqrt(F.when(F.col("v") > 0, F.col("v"))))
    fits = slope.join(by_entity, "g").join(by_time, "g").join(white, "g").withColumn("v", variance)
    fits = fits.select("g", "n", "entities", "times", "coefficient", error.alias("standard_error"), F.when((F.col("syy") > 0) & F.col("coefficient").isNotNull(), 1 - ratio(F.col("ssr"), F.col("syy"))).alias("within_r2"))
    count = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "entities", "times")]
    out = long.select(g.alias("g")).distinct().join(fits, "g", "left").select("g.*", *count, "coefficient", "standard_error", "within_r2")
    z = ratio(F.col("coefficient"), F.col("standard_error"))
    return out.withColumn("p_value", F.when(z.isNotNull(), normal_p(z))).withColumn("ci_low", F.col("coefficient") - 1.96 * F.col("standard_error")).withColumn("ci_high", F.col("coefficient") + 1.96 * F.col("standard_error"))


def standardized_ols(df: DataFrame, groups: list[str], y: str, predictors: list[str], drop_constant: bool = True) -> DataFrame:
    """Betas and R2 of z(log1p(y)) on z(predictors) by group; needs n > k + 2. Constant predictors drop out; without ``drop_constant`` a group
    with a constant column has NaN for all, as correlations with a constant are no number.

    The group's second moments are an ordinary aggregate; a grouped map solves them, so no group's rows meet in one task.
    """
    names = [y, *predictors]
    value = {y: F.log1p(y)} | {p: F.col(p).cast("double") for p in predictors}
    full = df.where(" AND ".join(f"{c} IS NOT NULL" for c in names)).select(*groups, *[value[c].alias(c) for c in names])
    cells = [F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    moments = full.groupBy(*groups).agg(F.count("*").alias("n"), *cells)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
        sd = np.sqrt(np.maximum(np.diag(c), 0))
        use = [i for i in range(1, len(names)) if sd[i] > 1e-12]
        betas, r2 = [None] * len(predictors), None
        enough = r["n"] > len(predictors) + 2
        if enough and use and sd[0] > 1e-12:
            corr = c / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1))
            b = np.linalg.lstsq(corr[np.ix_(use, use)], corr[use, 0], rcond=None)[0]
            r2 = float(b @ corr[use, 0])
            for i, x in zip(use, b, strict=True):
                betas[i - 1] = float(x)
        return pd.DataFrame([(*key, int(r["n"]), *betas, r2, bool(enough and (sd <= 1e-12).any()))], columns=[*groups, "n", *[f"beta_{p}" for p in predictors], "r2", "constant"])

    fields = {f.name: f.dataType.simpleString() for f in full.schema.fields}
    schema = ", ".join([*(f"{g} {fields[g]}" for g in groups), "n long", *(f"beta_{p} double" for p in predictors), "r2 double", "constant boolean"])
    fits = moments.groupBy(*groups).applyInPandas(solve, schema)
    shown = lambda c: c if drop_constant else F.when(F.col("constant"), F.lit(float("nan"))).otherwise(F.col(c)).alias(c)
    return fits.select(*groups, "n", *[shown(f"beta_{p}") for p in predictors], shown("r2"))
