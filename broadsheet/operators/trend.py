"""Trends of yearly series: weighted least squares on decades with Newey-West errors, in closed form over window lags.

A series has one row per year, so the windows per series are tiny; slopes of many series run in one job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.stats import normal_two_sided, t_quantile, t_two_sided
from broadsheet.functions.values import decades


def hac_trend(df: DataFrame, keys: list[str], value: str = "share", weight: str = "n", year: str = "year", maxlags: int = 2, centre: int = 1930) -> DataFrame:
    """(keys, slope_pp_dec, se, level, n_years): slope and level in percentage points, Newey-West standard error with
    Bartlett weights and the factor n / (n - 2). Fewer than four years with weight give nulls."""
    keys = keys or ["_all"]
    d = df if "_all" not in keys else df.withColumn("_all", F.lit(1))
    d = d.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*keys, F.col(year).alias("_y"), decades(F.col(year), centre).alias("x"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    s = d.groupBy(*keys).agg(
        F.sum("w").alias("s0"), F.sum(F.expr("w*x")).alias("s1"), F.sum(F.expr("w*x*x")).alias("s2"), F.sum(F.expr("w*v")).alias("t0"), F.sum(F.expr("w*x*v")).alias("t1"), F.count(F.lit(1)).alias("n_years")
    )
    s = s.withColumn("det", F.expr("s0*s2 - s1*s1")).withColumn("b", F.expr("try_divide(s0*t1 - s1*t0, det)")).withColumn("a", F.expr("try_divide(s2*t0 - s1*t1, det)"))
    e = d.join(s, keys).withColumn("g0", F.expr("w*(v - a - b*x)")).withColumn("g1", F.expr("g0*x"))
    order = Window.partitionBy(*keys).orderBy("_y")
    terms = [("00", "g0*g0"), ("01", "g0*g1"), ("11", "g1*g1")]
    sums = {k: F.sum(F.expr(x)) for k, x in terms}
    for lag in range(1, maxlags + 1):
        e = e.withColumn(f"p{lag}", F.lag("g0", lag).over(order)).withColumn(f"q{lag}", F.lag("g1", lag).over(order))
        bartlett = 1 - lag / (maxlags + 1)
        for k, x in (("00", f"2*g0*p{lag}"), ("01", f"g0*q{lag} + g1*p{lag}"), ("11", f"2*g1*q{lag}")):
            sums[k] = sums[k] + bartlett * F.sum(F.coalesce(F.expr(x), F.lit(0.0)))
    m = e.groupBy(*keys).agg(*[v.alias(f"m{k}") for k, v in sums.items()])
    r = s.join(m, keys)
    # second diagonal element of inverse(X'WX) * M * inverse(X'WX)
    var = F.expr("try_divide(s1*s1*m00 - 2*s0*s1*m01 + s0*s0*m11, det*det)") * F.expr("try_divide(n_years, n_years - 2)")
    enough = F.col("n_years") >= 4
    out = r.select(*keys, F.when(enough, 100 * F.col("b")).alias("slope_pp_dec"), F.when(enough, 100 * F.sqrt(F.greatest(var, F.lit(0.0)))).alias("se"), F.when(enough, 100 * F.col("a")).alias("level"), "n_years")
    return out.drop("_all")


def with_t_interval(df: DataFrame, df_col: str, lost: int = 2) -> DataFrame:
    """Adds ci_lo, ci_hi and p from slope_pp_dec, se and Student's t with ``df_col`` - ``lost`` degrees of freedom."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lo, hi, p = [], [], []
            for s, e, n in zip(b["slope_pp_dec"], b["se"], b[df_col], strict=True):
                if pd.isna(s) or pd.isna(e):
                    lo.append(None), hi.append(None), p.append(None)
                    continue
                dof = max(n - lost, 1)
                c = t_quantile(0.975, dof)
                lo.append(s - c * e), hi.append(s + c * e), p.append(t_two_sided(s / e, dof) if e > 0 else None)
            yield b.assign(ci_lo=pd.array(lo, "Float64"), ci_hi=pd.array(hi, "Float64"), p=pd.array(p, "Float64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", ci_lo double, ci_hi double, p double"
    return df.mapInPandas(run, schema)


def with_normal_p(df: DataFrame, z: str = "z") -> DataFrame:
    @F.pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        return s.map(normal_two_sided, na_action="ignore")

    return df.withColumn("p", f(F.col(z)))


def binned_trend(df: DataFrame, keys: list[str], y: str, width: int = 1, year: str = "year", centre: int = 1930) -> DataFrame:
    """Trend of bin means; a bin's time is the mean year of its rows, and one lag less is used for bins wider than a year."""
    d = df.where(F.col(y).isNotNull()).withColumn("_bin", F.floor(F.col(year) / width))
    g = d.groupBy(*keys, "_bin").agg(F.avg(F.col(year)).alias("year"), F.avg(y).alias("share"), F.count(F.lit(1)).alias("n"))
    return hac_trend(g, keys, maxlags=2 if width == 1 else 1, centre=centre)


def bh_fdr(df: DataFrame, p: str, family: list[str] | None = None, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values within each family; null p-values stay null. Windows run over result rows."""
    fam = family or ["_f"]
    d = df.withColumn("_f", F.lit(1)) if not family else df
    known = d.where(F.col(p).isNotNull())
    w = Window.partitionBy(*fam)
    known = known.withColumn("_r", F.row_number().over(w.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(w))
    step = F.col(p) * F.col("_m") / F.col("_r")
    known = known.withColumn(out, F.least(F.lit(1.0), F.min(step).over(w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))))
    rest = d.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return known.drop("_r", "_m").unionByName(rest).drop("_f")
