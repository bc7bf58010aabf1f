"""Claims evaluated by rule over result tables; each rule is an expression over aggregates of a small table.

Inputs: trends(estimand, method, subset, slope, ci_lo, ci_hi), yearly(method, year, share, share_auth), robust(estimand,
method, slope_min, sign_survives_all), contrasts(period, ci_hi), spread(role, ratio, same_sign)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(supported: Column, tentative: Column) -> Column:
    return F.when(F.coalesce(supported, F.lit(False)), "supported").when(F.coalesce(tentative, F.lit(False)), "tentative").otherwise("unsupported")


def _row(df: DataFrame, name: str, sup: Column, ten: Column) -> DataFrame:
    return df.agg(status(sup, ten).alias("status")).select(F.lit(name).alias("id"), "status")


def _is(**kw) -> Column:
    out = F.lit(True)
    for k, v in kw.items():
        out = out & (F.col(k) == v)
    return out


def claims(trends: DataFrame, yearly: DataFrame, robust: DataFrame, contrasts: DataFrame, spread: DataFrame) -> DataFrame:
    """(id, status) for H1 to H7. A missing row makes its condition false."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    pick = lambda c, v: F.max(F.when(c, F.col(v)))
    # H1: rising share, and every specification agrees in sign with a positive minimum
    h = trends.where(_is(estimand="female_share", subset="primary")).select(F.lit("t").alias("src"), (F.col("ci_lo") > 0).alias("ok"))
    r = robust.where(_is(estimand="female_share")).select(F.lit("r").alias("src"), (F.col("sign_survives_all") & (F.col("slope_min") > 0)).alias("ok"))
    holds, firm = any_(_is(src="t") & F.col("ok")), any_(_is(src="r") & F.col("ok"))
    h1 = _row(h.unionByName(r), "H1", holds & firm, holds)
    # H2: authority share below the overall share in every year, and the gap trend rises, for methods A and B
    below = yearly.groupBy("method").agg(F.bool_and(F.col("share_auth") < F.col("share")).alias("ok")).select(F.concat(F.lit("below_"), "method").alias("src"), "ok")
    gap = trends.where(_is(estimand="authority_gap")).select(F.concat(F.lit("gap_"), "method").alias("src"), (F.col("ci_lo") > 0).alias("ok"))
    rob = robust.where(_is(estimand="authority_share", method="B")).select(F.lit("robust").alias("src"), F.col("sign_survives_all").alias("ok"))
    d = below.unionByName(gap).unionByName(rob)
    got = {s: any_(_is(src=s) & F.col("ok")) for s in ("below_A", "below_B", "gap_A", "gap_B", "robust")}
    a, b = got["below_A"] & got["gap_A"], got["below_B"] & got["gap_B"]
    h2 = _row(d, "H2", a & b & got["robust"], a | b)
    # H3: adjustment changes the slope by at least a quarter
    t = trends.where(F.col("estimand") == "female_share")
    raw, adj = pick(_is(subset="raw"), "slope"), pick(_is(subset="adjusted"), "slope")
    h3 = _row(t, "H3", F.try_divide(F.abs(adj - raw), F.abs(raw)) >= 0.25, F.lit(False))
    # H4: methods disagree by a ratio over two or in sign
    h4 = _row(spread, "H4", any_((F.col("ratio") > 2) | ~F.col("same_sign")), F.lit(False))
    # H5: |slope| of A exceeds that of B and D for all roles, or for more than half
    p = trends.where(F.col("estimand") == "role_rate").groupBy("subset").agg(*[F.abs(pick(_is(method=m), "slope")).alias(m) for m in "ABD"])
    wins = F.coalesce((F.col("A") > F.col("B")) & (F.col("A") > F.col("D")), F.lit(False))
    h5 = _row(p, "H5", (F.count(F.lit(1)) > 0) & F.bool_and(wins), F.count_if(wins) > F.count(F.lit(1)) / 2)
    # H6: significant trend of the unknown share, and slopes that differ in sign over the treatments
    u = trends.where(F.col("estimand").isin("unknown_share", "unknown_treatment"))
    sig = any_(_is(estimand="unknown_share") & ((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)))
    tr = F.col("estimand") == "unknown_treatment"
    differ = any_(tr & (F.col("slope") > 0)) & any_(tr & (F.col("slope") < 0))
    h6 = _row(u, "H6", sig & differ, sig | differ)
    # H7: pooled contrast below zero, and in every period
    pooled = any_(_is(period="all") & (F.col("ci_hi") < 0))
    each = F.coalesce(F.bool_and(F.when(F.col("period") != "all", F.col("ci_hi") < 0)), F.lit(False))
    h7 = _row(contrasts, "H7", pooled & each, pooled)
    out = h1
    for x in (h2, h3, h4, h5, h6, h7):
        out = out.unionByName(x)
    return out
