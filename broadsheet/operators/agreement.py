"""Validation and agreement metrics as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.runtime import null_safe_join, with_row


def _group(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def weighted_prf(df: DataFrame, truth: Column, pred: Column, weight: Column | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, precision, recall, f1, n_pos_ref, n_pred_pos, prev_ref_w, prev_pred_w); a ratio without a denominator is null.
    A null truth or prediction counts as negative."""
    keys = keys or []
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(pred, F.lit(False))
    w = F.coalesce(weight, F.lit(0.0)) if weight is not None else F.lit(1.0)
    s = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    a = _group(df, keys).agg(s(t & p).alias("tp"), s(~t & p).alias("fp"), s(t & ~p).alias("fn"), F.sum(w).alias("w"), F.count_if(t).alias("n_pos_ref"), F.count_if(p).alias("n_pred_pos"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return a.select(
        *keys, F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "n_pos_ref", "n_pred_pos", F.try_divide(tp + fn, F.col("w")).alias("prev_ref_w"), F.try_divide(tp + fp, F.col("w")).alias("prev_pred_w"),
    )


def cohen_kappa(df: DataFrame, a: Column, b: Column, keys: list[str] | None = None, min_n: int = 1) -> DataFrame:
    """(keys, kappa, agree, n) of two label columns with any number of labels; rows with a null label are left out, groups
    below ``min_n`` too; kappa is null if only one label occurs."""
    keys = keys or []
    c = df.select(*keys, a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null").groupBy(*keys, "_a", "_b").agg(F.count(F.lit(1)).alias("c"))
    sides = c.select(*keys, F.explode(F.array(F.struct(F.col("_a").alias("v"), F.col("c").alias("x"), F.lit(0).alias("y")), F.struct(F.col("_b").alias("v"), F.lit(0).cast("long").alias("x"), F.col("c").cast("int").alias("y")))).alias("s"))
    margin = sides.select(*keys, "s.*").groupBy(*keys, "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    pe = _group(margin, keys).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    po = _group(c, keys).agg(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("c")).otherwise(0)).alias("same"), F.sum("c").alias("n"))
    r = (null_safe_join(po, pe, keys) if keys else with_row(po, pe)).where(F.col("n") >= min_n)
    agree, chance = F.col("same") / F.col("n"), F.col("xy") / (F.col("n").cast("double") * F.col("n"))
    return r.select(*keys, F.when(chance < 1, F.try_divide(agree - chance, 1 - chance)).alias("kappa"), agree.alias("agree"), "n")


def gender_validation(df: DataFrame, truth: str, pred: str, weight: Column | None = None) -> DataFrame:
    """Metric rows (metric, value, n): precision on classified, recall on reference-classified, F1 per gender, false assignment."""
    w = weight if weight is not None else F.lit(1.0)
    t, p = F.col(truth), F.col(pred)
    known, said = t.isin("F", "M"), p.isin("F", "M")
    s = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    rows = [
        ("precision_classified", s(known & said & (t == p)), s(known & said)),
        ("recall_reference", s(known & (t == p)), s(known)),
        ("f1_F", 2 * s((t == "F") & (p == "F")), s(t == "F") + s(p == "F")),
        ("f1_M", 2 * s((t == "M") & (p == "M")), s(t == "M") + s(p == "M")),
        ("false_assignment", s(~known & said), s(~known)),
    ]
    one = df.agg(*[x.alias(f"a{i}") for i, (_, x, _) in enumerate(rows)], *[x.alias(f"b{i}") for i, (_, _, x) in enumerate(rows)])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(f"a{i}", f"b{i}").alias("value"), F.col(f"b{i}").alias("n")) for i, (m, _, _) in enumerate(rows)])
    return one.select(F.explode(cells).alias("r")).select("r.*")


def pairwise_kappa(df: DataFrame, methods: list[str], keys: list[str] | None = None, min_n: int = 1) -> DataFrame:
    """Kappa of every pair of boolean method columns, (pair, keys, kappa, agree, n), in one pass."""
    pairs = [F.struct(F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("_x"), F.col(b).alias("_y")) for i, a in enumerate(methods) for b in methods[i + 1 :]]
    d = df.select(*(keys or []), F.explode(F.array(*pairs)).alias("p")).select(*(keys or []), "p.*")
    return cohen_kappa(d, F.col("_x"), F.col("_y"), ["pair", *(keys or [])], min_n)


def slope_spread(df: DataFrame, key: str, slope: str, lo: str, hi: str, method: str) -> DataFrame:
    """(key, slope_min, slope_max, ratio, same_sign, n_sig_pos, n_sig_neg, methods) over the methods of each key."""
    a = df.where(F.col(slope).isNotNull()).groupBy(key).agg(
        F.min(slope).alias("slope_min"), F.max(slope).alias("slope_max"), F.max(F.abs(slope)).alias("_x"), F.min(F.abs(slope)).alias("_n"),
        (F.bool_and(F.col(slope) > 0) | F.bool_and(F.col(slope) < 0)).alias("same_sign"), F.count_if(F.col(lo) > 0).alias("n_sig_pos"),
        F.count_if(F.col(hi) < 0).alias("n_sig_neg"), F.array_join(F.array_sort(F.collect_set(method)), ",").alias("methods"),
    )
    return a.withColumn("ratio", F.try_divide("_x", "_n")).drop("_x", "_n")
