"""Shares, contrasts and decompositions over grouped counts. Everything is a hash aggregation with map-side partial
sums; the bootstrap draws its Poisson weights from a hash of (cluster, replicate), so all replicates come from one
shuffle of cluster sums and the result does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.values import poisson1
from broadsheet.runtime import with_row


def _weights(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def cluster_sums(df: DataFrame, keys: list[str], cluster: str, success: str, weight: str | None = None) -> DataFrame:
    """(keys, cluster, k, n): weighted successes and rows per cluster; rows with a null success are left out."""
    d = df.where(F.col(success).isNotNull())
    w = _weights(weight)
    return d.groupBy(*keys, cluster).agg(F.sum(F.col(success).cast("double") * w).alias("k"), F.sum(w).alias("n"))


def yearly_share(df: DataFrame, success: str, cluster: str, by: str | list[str] = "year", weight: str | None = None, B: int = 0, seed: int = 0) -> DataFrame:
    """(by, n, n_clusters, k, share[, ci_lo, ci_hi]): share of successes with a cluster Poisson bootstrap interval.

    Null successes are left out; a group without weight has a null share, one with fewer than two clusters a null interval."""
    keys = [by] if isinstance(by, str) else by
    sums = cluster_sums(df, keys, cluster, success, weight)
    out = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_clusters"), F.sum("k").alias("k"))
    out = out.withColumn("share", F.try_divide("k", "n"))
    if not B:
        return out
    ci = interval(bootstrap_sums(sums, keys, cluster, ["k", "n"], B, seed).withColumn("v", F.try_divide("k", "n")), keys, "v")
    few = F.col("n_clusters") < 2
    return out.join(ci, keys, "left").withColumn("ci_lo", F.when(~few, F.col("lo"))).withColumn("ci_hi", F.when(~few, F.col("hi"))).drop("lo", "hi")


def bootstrap_sums(sums: DataFrame, keys: list[str], cluster: str, cols: list[str], B: int, seed: int = 0) -> DataFrame:
    """(keys, b, cols): sums of all replicates, each cluster weighted by a Poisson(1) number fixed by (cluster, b, seed): four
    replicates take the four words of one md5.
    The replicates of a row are summed map-side; what is shuffled is groups x B rows per task."""
    q = sums.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit((B - 1) // 4))))
    q = q.withColumn("_h", F.md5(F.concat_ws("|", F.col(cluster).cast("string"), F.col("_q").cast("string"), F.lit(str(seed)))))
    reps = q.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("b", 4 * F.col("_q") + F.col("_r")).where(F.col("b") < B)
    u = F.conv(F.substring("_h", 8 * F.col("_r") + 1, F.lit(8)), 16, 10).cast("double") / F.lit(float(2**32))
    reps = reps.withColumn("_w", poisson1(u)).where("_w > 0")
    return reps.groupBy(*keys, "b").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in cols])


def interval(reps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, lo, hi): the 2.5 and 97.5 percentiles of the replicates, with linear interpolation."""
    return reps.groupBy(*keys).agg(F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"))


def role_trends(df: DataFrame, flags: list[str], success: str, cluster: str, by: str = "year") -> DataFrame:
    """(role, by, n, n_clusters, k, share) for each boolean flag column; a row counts under every flag that is set."""
    roles = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]), lambda x: x.isNotNull())
    return yearly_share(df.withColumn("role", F.explode(roles)), success, cluster, ["role", by])


def role_rate_gap(df: DataFrame, flag: str, gender: str, by: str = "year") -> DataFrame:
    """(by, rate_f, rate_m, gap, n): how often each gender has the flag; n is the smaller group."""
    g = df.where(F.col(gender).isin("F", "M")).groupBy(by).agg(
        *[F.count_if(F.col(gender) == x).alias(f"n_{x}") for x in "FM"], *[F.count_if((F.col(gender) == x) & F.col(flag)).alias(f"k_{x}") for x in "FM"]
    )
    rate = {x: F.try_divide(f"k_{x}", f"n_{x}") for x in "FM"}
    return g.select(by, rate["F"].alias("rate_f"), rate["M"].alias("rate_m"), (rate["F"] - rate["M"]).alias("gap"), F.least("n_F", "n_M").alias("n"))


def early_late(df: DataFrame, keys: list[str], k: str, n: str, early: tuple[int, int], late: tuple[int, int], year: str = "year") -> DataFrame:
    """(keys, early_share, late_share, diff_pp): pooled shares of two windows of a yearly table with counts."""
    inside = lambda w, c: F.sum(F.when(F.col(year).between(*w), F.col(c)))
    e, t = F.try_divide(inside(early, k), inside(early, n)), F.try_divide(inside(late, k), inside(late, n))
    agg = df.groupBy(*keys) if keys else df.groupBy()
    return agg.agg(e.alias("early_share"), t.alias("late_share"), (100 * (t - e)).alias("diff_pp"))


def speaker_gap(df: DataFrame, success: str, quoted: str, article: str, period: str, B: int = 0, seed: int = 0) -> DataFrame:
    """(period or 'all', diff_pp, n_speakers, n_mentions[, ci_lo, ci_hi]): share among quoted minus share among all."""
    d = df.where(F.col(success).isNotNull())
    s = d.groupBy(article, period).agg(
        F.sum(success).alias("nf"), F.count(F.lit(1)).cast("double").alias("nn"), F.coalesce(F.sum(F.when(F.col(quoted), F.col(success))), F.lit(0.0)).alias("sf"), F.count_if(quoted).cast("double").alias("sn")
    )
    s = s.withColumn("period", F.explode(F.array(F.lit("all"), F.col(period).cast("string"))))
    est = 100 * (F.col("sf") / F.greatest(F.col("sn"), F.lit(1.0)) - F.try_divide("nf", "nn"))
    cols = ["nf", "nn", "sf", "sn"]
    out = s.groupBy("period").agg(*[F.sum(c).alias(c) for c in cols])
    out = out.select("period", est.alias("diff_pp"), F.col("sn").alias("n_speakers"), F.col("nn").alias("n_mentions"))
    if not B:
        return out
    ci = interval(bootstrap_sums(s, ["period"], article, cols, B, seed).withColumn("v", est), ["period"], "v")
    return out.join(ci, "period").withColumnsRenamed({"lo": "ci_lo", "hi": "ci_hi"})


def group_period_share(df: DataFrame, group: str, y: str, period: str) -> DataFrame:
    """(group, period, n, mean_y, period_share); the window runs over group sums, not over rows."""
    g = df.where(F.col(group).isNotNull()).groupBy(group, period).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"))
    return g.withColumn("period_share", F.col("n") / F.sum("n").over(Window.partitionBy(period)))


def shift_share(df: DataFrame, group: str, y: str, article: str, early: tuple[int, int], late: tuple[int, int], B: int = 0, seed: int = 0, year: str = "year") -> DataFrame:
    """One row of the symmetric decomposition of the change between two windows: total_pp, composition_pp, within_pp,
    unmatched (share in groups of one window only), n_groups; with B > 0 also intervals per part.

    An article takes the group of its smallest non-null group name and the window of its year. Rows outside the windows or
    with a null group or outcome are left out."""
    d = df.where((F.col(year).between(*early) | F.col(year).between(*late)) & F.col(y).isNotNull() & F.col(group).isNotNull())
    art = d.groupBy(article).agg((F.min(year) >= late[0]).alias("late"), F.min(group).alias("grp"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("k"))

    def parts(a: DataFrame, keys: list[str]) -> DataFrame:
        pick = lambda c, on: F.sum(F.when(F.col("late") == on, F.col(c)).otherwise(0.0))
        g = a.groupBy(*keys, "grp").agg(*[pick(c, on).alias(f"{c}{t}") for c in "nk" for on, t in ((False, "e"), (True, "l"))])
        total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
        g = g.withColumn("we", F.try_divide("ne", F.sum("ne").over(total))).withColumn("wl", F.try_divide("nl", F.sum("nl").over(total)))
        g = g.withColumn("se", F.try_divide("ke", "ne")).withColumn("sl", F.try_divide("kl", "nl")).withColumn("ok", F.col("se").isNotNull() & F.col("sl").isNotNull())
        both = lambda e: F.coalesce(F.sum(F.when(F.col("ok"), e)), F.lit(0.0))
        agg = g.groupBy(*keys) if keys else g.groupBy()
        return agg.agg(
            (100 * (F.sum(F.coalesce(F.col("wl") * F.col("sl"), F.lit(0.0))) - F.sum(F.coalesce(F.col("we") * F.col("se"), F.lit(0.0))))).alias("total_pp"),
            (100 * both((F.col("wl") - F.col("we")) * (F.col("sl") + F.col("se")) / 2)).alias("composition_pp"),
            (100 * both((F.col("sl") - F.col("se")) * (F.col("wl") + F.col("we")) / 2)).alias("within_pp"),
            (1 - both(F.col("we") + F.col("wl")) / 2).alias("unmatched"),
            F.count(F.lit(1)).alias("n_groups"),
        )

    out = parts(art, [])
    if not B:
        return out
    sums = art.groupBy("grp", "late", article).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    reps = parts(bootstrap_sums(sums, ["grp", "late"], article, ["n", "k"], B, seed), ["b"])
    names = ["total_pp", "composition_pp", "within_pp"]
    ci = reps.agg(*[F.percentile(c, p).alias(c.replace("_pp", t)) for c in names for p, t in ((0.025, "_lo"), (0.975, "_hi"))])
    return with_row(out, ci)


def hhi(df: DataFrame, group: str, by: str) -> DataFrame:
    """(by, hhi): concentration of rows over groups."""
    c = df.groupBy(by, group).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(by).agg(F.try_divide(F.sum(F.col("c") * F.col("c")).cast("double"), F.pow(F.sum("c"), 2)).alias("hhi"))


def tvd(a: DataFrame, b: DataFrame, field: str) -> DataFrame:
    """One row (tvd): half the sum of absolute differences of two distributions of ``field``; null is a value of its own."""
    d = a.select(F.col(field).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(F.col(field).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    g = d.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    t = Window.partitionBy(F.lit(1))
    g = g.select(F.abs(F.try_divide("a", F.sum("a").over(t)) - F.try_divide("b", F.sum("b").over(t))).alias("d"))
    return g.agg((F.sum("d") / 2).alias("tvd"))


def tvd_null(df: DataFrame, field: str, n: int, draws: int = 500, seed: int = 0, most: int = 1_000_000) -> DataFrame:
    """(draw, tvd): distance between ``n`` rows drawn without replacement and the rest, per draw; null is a value of its own.

    The rows are counted once per value; how many of the ``n`` rows fall on each value is then drawn from the multivariate
    hypergeometric distribution over those counts, which is exact and copies no row. The counts of at most ``most`` values
    go to every task (eight bytes each); more distinct values are refused. Fewer than ``n`` + 1 rows give null distances."""
    counts = df.groupBy(field).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col(field).asc_nulls_first()).select("c").limit(most + 1).toPandas()["c"].to_numpy()
    if len(counts) > most:
        raise ValueError(f"more than {most} values of {field}")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        rest = int(c.sum()) - n
        for b in batches:
            out = []
            for d in b["draw"]:
                took = np.random.default_rng([seed, int(d)]).multivariate_hypergeometric(c, n, method="marginals") if rest > 0 and n > 0 else None
                out.append(None if took is None else float(np.abs(took / n - (c - took) / rest).sum() / 2))
            yield pd.DataFrame({"draw": b["draw"], "tvd": pd.array(out, "Float64")})

    return spark.range(draws).withColumnRenamed("id", "draw").mapInPandas(run, "draw long, tvd double")


def pooled_share(df: DataFrame, keys: list[str], k: str, n: str) -> DataFrame:
    """Share over periods of thin samples: sums of counts, then one division."""
    return df.groupBy(*keys).agg(F.sum(k).alias("k"), F.sum(n).alias("n")).withColumn("share", F.try_divide("k", "n"))


def agency_yearly(df: DataFrame, agent: str, patient: str, cluster: str, by: str | list[str]) -> DataFrame:
    """Share of agent among agent and patient positions (count columns), every row weighted by its positions."""
    d = df.withColumn("n_pos", (F.col(agent) + F.col(patient)).cast("double")).where("n_pos > 0")
    return yearly_share(d.withColumn("agency", F.col(agent) / F.col("n_pos")), "agency", cluster, by, "n_pos")


def mode_of(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mode, n, share): most frequent value, the smallest among equals."""
    c = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    g = c.groupBy(by).agg(F.min_by(value, F.struct(-F.col("c"), F.col(value))).alias("mode"), F.max("c").alias("n"), F.sum("c").alias("t"))
    return g.select(by, "mode", "n", (F.col("n") / F.col("t")).alias("share"))
