"""Ranking, caps, quotas and seeded samples. Windows run within natural groups whose rows carry only keys; where a
group may be hot, the cut is found on counts of hash cells first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.values import uniform
from broadsheet.runtime import group_running, null_safe_join


def hash_order(key: Column, seed: int = 0) -> Column:
    """The pseudo-random place of a key: md5 of key and seed."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows with the n smallest order keys per group. The first order key must be a hexadecimal hash: rows are
    counted per (group, first two digits), whole cells below the cut pass without a sort, and only the cell with the cut is ranked."""
    d = _with_cells(df, group, order, n).where("_need <> 0")
    edge = d.where("_need > 0").withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_o", *order[1:]))).where("_r <= _need").drop("_r")
    return d.where("_need < 0").unionByName(edge).drop("_o", "_cell", "_need")


def _with_cells(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Adds _o, _cell and _need: -1 if all rows of the cell are among the first n, 0 if none, else how many."""
    d = df.withColumn("_o", order[0]).withColumn("_cell", F.substring("_o", 1, 2))
    per = d.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    per = per.withColumn("_u", F.sum("_c").over(Window.partitionBy(*group).orderBy("_cell")))
    need = F.when(F.col("_u") <= n, -1).when(F.col("_u") - F.col("_c") < n, n - F.col("_u") + F.col("_c")).otherwise(0)
    return null_safe_join(d, per.select(*group, "_cell", need.alias("_need")), [*group, "_cell"])


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """All rows with ``in_cap``: whether the row is among the ``cap`` first of its group. The first order key must be a
    hexadecimal hash, as for ``first_n``; only rows of the cell with the cut are ranked."""
    d = _with_cells(df, group, order, cap)
    edge = d.where("_need > 0").withColumn("in_cap", F.row_number().over(Window.partitionBy(*group).orderBy("_o", *order[1:])) <= F.col("_need"))
    return d.where("_need <= 0").withColumn("in_cap", F.col("_need") < 0).unionByName(edge).drop("_o", "_cell", "_need")


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows per stratum with pop_n, sample_n and weight pop_n / sample_n."""
    pop = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("pop_n"))
    pop = pop.withColumn("sample_n", F.least(F.lit(n), "pop_n").cast("long")).withColumn("weight", F.col("pop_n") / F.col("sample_n"))
    picked = first_n(df, strata, [hash_order(F.col(key), seed), F.col(key)], n)
    return null_safe_join(picked, pop, strata)


def interleave(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """A sample of n rows per group with ``rank`` in the group and ``place`` in a round-robin over groups, so that every prefix is balanced."""
    picked = first_n(df, [group], [hash_order(F.col(key), seed), F.col(key)], n)
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), key)))
    per = picked.groupBy("rank").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.sum("_c").over(Window.orderBy("rank")) - F.col("_c"))  # n rows
    return picked.join(F.broadcast(per.select("rank", "_b")), "rank").withColumn("place", F.col("_b") + F.row_number().over(Window.partitionBy("rank").orderBy(group))).drop("_b")


def fraction_sample(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Rows whose hashed key lies below ``share``: no shuffle, stable under new rows."""
    return df.where(uniform(F.col(key), F.lit(seed)) < share)


def quota_sample(df: DataFrame, group: str, order: list[str], size: str, quota: int) -> DataFrame:
    """Units in order until the running sum of ``size`` reaches the quota; the unit that reaches it is kept (so it overshoots)."""
    return group_running(df, [group], order, size).where(F.col("before") < quota).drop("before", "rank")


def prefix_split(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """Adds ``in_prefix``: whether the row is among the first n of its group."""
    return group_running(df, [group], order).withColumn("in_prefix", F.col("rank") < n).drop("before", "rank")


def top1_margin(df: DataFrame, key: str, item: str, weight: str) -> DataFrame:
    """(key, item, weight, margin) of the heaviest item and its lead over the second; item -1 if no item has weight."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col(weight)).alias("nw"), F.col(item).alias("i"))))
    g = df.groupBy(key).agg(ordered.alias("o"))
    first = -F.col("o")[0]["nw"]
    second = F.coalesce(-F.get("o", F.lit(1))["nw"], F.lit(0.0))
    return g.select(key, F.when(first > 0, F.col("o")[0]["i"]).otherwise(-1).alias(item), first.alias(weight), (first - second).alias("margin"))


def kinds_sample(df: DataFrame, kinds: dict[str, Column], key: str, per_kind: int = 4, seed: int = 0) -> DataFrame:
    """(kind, rows): up to ``per_kind`` rows of each predicate, in seeded order; a row may come under several kinds."""
    names = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())
    return first_n(df.withColumn("kind", F.explode(names)), ["kind"], [hash_order(F.col(key), seed), F.col(key)], per_kind)
