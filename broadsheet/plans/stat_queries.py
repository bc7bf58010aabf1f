"""Queries on shares, trends, decompositions, agreement, samples and specification grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions import text as T
from broadsheet.functions import values as V
from broadsheet.operators import agreement, claims as claim_rules, frame as frames, models, multiverse as mv, panel, ranking, rules, shares, trend
from broadsheet.plans import model_sql as M
from broadsheet.plans.bindings import CENTRE, EARLY, FRAME_SQL, LATE, TYPES, frame, topics
from broadsheet.runtime import cut, table, with_row
from broadsheet.sources.readers import parse_labels
from broadsheet.sources.sinks import clean_numbers, content_hash
from broadsheet.streaming import articles as streams

QUERIES: dict = {}
SQL: dict = {}
FLAGS = [f"r_{t}" for t in TYPES] + ["r_AUTHORITY"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def S(body: str, **cte: str) -> str:
    return "WITH " + ", ".join([FRAME_SQL, *(f"{k} AS ({v})" for k, v in cte.items())]) + " " + body


# ------------------------------------------------------------------ shares

_YEARLY = "SELECT year, sum(n) AS n, count(*) AS n_clusters, sum(k) AS k, sum(k) / sum(n) AS share FROM (SELECT year, article_id, sum(f) AS k, count(*)::DOUBLE AS n FROM frame WHERE f IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
_HAC = """d AS (SELECT {k}, year, (year - 1998) / 10.0::DOUBLE AS x, share AS v, n::DOUBLE AS w FROM {src} WHERE share IS NOT NULL AND n > 0),
s AS (SELECT {k}, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * v) AS t0, sum(w * x * v) AS t1, count(*) AS ny FROM d GROUP BY {g}),
b AS (SELECT *, s0 * s2 - s1 * s1 AS det, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS a FROM s),
g AS (SELECT {dk}, year, w * (v - a - b * x) AS g0, w * (v - a - b * x) * x AS g1 FROM d JOIN b ON {on}),
l AS (SELECT {k}, g0, g1, coalesce(lag(g0, 1) OVER o, 0) AS p1, coalesce(lag(g1, 1) OVER o, 0) AS q1, coalesce(lag(g0, 2) OVER o, 0) AS p2, coalesce(lag(g1, 2) OVER o, 0) AS q2 FROM g WINDOW o AS (PARTITION BY {g} ORDER BY year)),
m AS (SELECT {k}, sum(g0 * g0 + 2.0 / 3 * 2 * g0 * p1 + 1.0 / 3 * 2 * g0 * p2) AS m00, sum(g0 * g1 + 2.0 / 3 * (g0 * q1 + g1 * p1) + 1.0 / 3 * (g0 * q2 + g1 * p2)) AS m01, sum(g1 * g1 + 2.0 / 3 * 2 * g1 * q1 + 1.0 / 3 * 2 * g1 * q2) AS m11 FROM l GROUP BY {g})"""


def _hac_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys) or "1 AS z"
    g = ", ".join(keys) or "z"
    on = " AND ".join(f"d.{c} = b.{c}" for c in keys) or "d.z = b.z"
    return _HAC.format(k=k if keys else "z", g=g, dk=", ".join(f"d.{c}" for c in keys) or "d.z", on=on, src=src if keys else f"(SELECT *, 1 AS z FROM {src})")


_SLOPE = "round(100 * b.b, 6) AS slope_pp_dec, round(100 * sqrt(greatest((s1 * s1 * m00 - 2 * s0 * s1 * m01 + s0 * s0 * m11) / (det * det) * (ny / (ny - 2.0)), 0)), 6) AS se, round(100 * a, 6) AS level, ny AS n_years"


@query(S("SELECT year, n, n_clusters, k, round(share, 6) AS share FROM y", y=_YEARLY))
def yearly_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.yearly_share(frame(spark, d), "f", "article_id"))


@query(S("SELECT year, sum(w) AS n, count(DISTINCT article_id) AS n_clusters, sum(f * w) AS k, round(sum(f * w) / sum(w), 6) AS share FROM (SELECT *, weight AS w FROM frame WHERE f IS NOT NULL) GROUP BY 1"))
def yearly_share_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.yearly_share(frame(spark, d), "f", "article_id", weight="weight"))


_POISSON_STEPS = " ".join(f"WHEN u < {t!r} THEN {k}" for k, t in enumerate(__import__("itertools").accumulate(__import__("math").exp(-1) / __import__("math").factorial(i) for i in range(14))))


@query(
    S(
        "SELECT year, round(quantile_cont(v, 0.025), 6) AS ci_lo, round(quantile_cont(v, 0.975), 6) AS ci_hi FROM r GROUP BY 1",
        c="SELECT year, article_id, sum(f) AS k, count(*)::DOUBLE AS n FROM frame WHERE f IS NOT NULL GROUP BY 1, 2",
        x="SELECT year, k, n, b, (('0x' || substring(md5(article_id || '|' || b // 4 || '|0'), 8 * (b % 4)::INT + 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u FROM c, range(40) t(b)",
        p=f"SELECT year, k, n, b, CASE {_POISSON_STEPS} ELSE 14 END AS w FROM x",
        r="SELECT year, b, sum(k * w) / sum(n * w) AS v FROM p WHERE w > 0 GROUP BY 1, 2",
    )
)
def yearly_share_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.yearly_share(frame(spark, d), "f", "article_id", B=40)).select("year", "ci_lo", "ci_hi")


@query(S("SELECT 'r_' || role AS role, year, sum(f) AS k, count(*)::DOUBLE AS n, count(DISTINCT article_id) AS n_clusters, round(sum(f) / count(*), 6) AS share FROM (SELECT role, year, f, article_id FROM frame WHERE f IS NOT NULL UNION ALL SELECT 'AUTHORITY', year, f, article_id FROM frame WHERE f IS NOT NULL AND authority) GROUP BY 1, 2"))
def role_trends(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.role_trends(frame(spark, d), FLAGS, "f", "article_id"))


@query(S("SELECT year, round(rf, 6) AS rate_f, round(rm, 6) AS rate_m, round(rf - rm, 6) AS gap, n FROM (SELECT year, count(*) FILTER (WHERE gender = 'F' AND authority) / count(*) FILTER (WHERE gender = 'F') AS rf, count(*) FILTER (WHERE gender = 'M' AND authority) / count(*) FILTER (WHERE gender = 'M') AS rm, least(count(*) FILTER (WHERE gender = 'F'), count(*) FILTER (WHERE gender = 'M')) AS n FROM frame GROUP BY 1)"))
def role_rate_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.role_rate_gap(frame(spark, d), "r_AUTHORITY", "gender"))


@query(S("SELECT section, round(e, 6) AS early_share, round(l, 6) AS late_share, round(100 * (l - e), 6) AS diff_pp FROM (SELECT section, sum(f) FILTER (WHERE year BETWEEN 1995 AND 1997) / count(f) FILTER (WHERE year BETWEEN 1995 AND 1997) AS e, sum(f) FILTER (WHERE year BETWEEN 1999 AND 2001) / count(f) FILTER (WHERE year BETWEEN 1999 AND 2001) AS l FROM frame GROUP BY 1)"))
def early_late_contrast(spark: SparkSession, d: str) -> DataFrame:
    y = shares.yearly_share(frame(spark, d), "f", "article_id", ["section", "year"])
    return rounded(shares.early_late(y, ["section"], "k", "n", EARLY, LATE))


_GAP = "SELECT {p} AS period, round(100 * (coalesce(sum(f) FILTER (WHERE quoted), 0) / greatest(count(*) FILTER (WHERE quoted), 1) - sum(f) / count(*)), 6) AS diff_pp, (count(*) FILTER (WHERE quoted))::DOUBLE AS n_speakers, count(*)::DOUBLE AS n_mentions FROM frame WHERE f IS NOT NULL GROUP BY 1"


@query(S(_GAP.format(p="CAST(year AS VARCHAR)") + " UNION ALL " + _GAP.format(p="'all'")))
def speaker_gap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.speaker_gap(frame(spark, d), "f", "quoted", "article_id", "year"))


@query(M.speaker_gap(FRAME_SQL, 40))
def speaker_gap_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.speaker_gap(frame(spark, d), "f", "quoted", "article_id", "year", B=40))


@query(S("SELECT section, year, n, round(m, 6) AS mean_y, round(n / sum(n) OVER (PARTITION BY year), 6) AS period_share FROM (SELECT section, year, count(*) AS n, avg(f) AS m FROM frame GROUP BY 1, 2)"))
def group_period_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.group_period_share(frame(spark, d), "section", "f", "year"))


@query(
    S(
        "SELECT round(100 * (sum(coalesce(wl * sl, 0)) - sum(coalesce(we * se, 0))), 6) AS total_pp, round(100 * sum((wl - we) * (sl + se) / 2) FILTER (WHERE ok), 6) AS composition_pp, round(100 * sum((sl - se) * (wl + we) / 2) FILTER (WHERE ok), 6) AS within_pp, round(1 - sum(we + wl) FILTER (WHERE ok) / 2, 6) AS unmatched, count(*) AS n_groups FROM h",
        a="SELECT article_id, min(year) >= 1999 AS late, min(section) AS grp, count(*)::DOUBLE AS n, sum(f) AS k FROM frame WHERE f IS NOT NULL AND (year BETWEEN 1995 AND 1997 OR year BETWEEN 1999 AND 2001) GROUP BY 1",
        q="SELECT grp, coalesce(sum(n) FILTER (WHERE NOT late), 0) AS ne, coalesce(sum(n) FILTER (WHERE late), 0) AS nl, coalesce(sum(k) FILTER (WHERE NOT late), 0) AS ke, coalesce(sum(k) FILTER (WHERE late), 0) AS kl FROM a GROUP BY 1",
        h="SELECT *, ne / sum(ne) OVER () AS we, nl / sum(nl) OVER () AS wl, ke / nullif(ne, 0) AS se, kl / nullif(nl, 0) AS sl, ne > 0 AND nl > 0 AS ok FROM q",
    )
)
def shift_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.shift_share(frame(spark, d), "section", "f", "article_id", EARLY, LATE))


@query(M.shift_share(FRAME_SQL, "publication", 40))
def shift_share_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.shift_share(frame(spark, d), "publication", "f", "article_id", EARLY, LATE, B=40))


@query("SELECT year, round(sum(c * c)::DOUBLE / (sum(c) * sum(c)), 6) AS hhi FROM (SELECT year, publication, count(*) AS c FROM articles GROUP BY 1, 2) GROUP BY 1")
def hhi_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.hhi(table(spark, d, "articles"), "publication", "year"))


@query(
    """WITH a AS (SELECT article_id, min(year) AS year, min(publication) AS publication, min(state) AS state, min(length(text)) AS n_chars, min(legibility) AS legibility, min(page_number) AS page_number FROM articles GROUP BY 1),
m AS (SELECT year, publication, c, row_number() OVER (PARTITION BY year ORDER BY c DESC, publication NULLS FIRST) AS r FROM (SELECT year, publication, count(*) AS c FROM a GROUP BY 1, 2))
SELECT a.year, count(*) AS n_articles, count(DISTINCT a.publication) AS n_publications, count(DISTINCT state) AS n_states, any_value(m.publication) AS top_publication, round(any_value(m.c) / count(*), 6) AS top_share,
 round(avg(n_chars), 6) AS mean_chars, round(median(n_chars), 6) AS median_chars, round(quantile_cont(n_chars, 0.1), 6) AS p10_chars, max(n_chars)::BIGINT AS max_chars, round(avg(CASE WHEN page_number = 1 THEN 1.0 ELSE 0.0 END), 6) AS front_share, count(*) FILTER (WHERE legibility = 'Legible') AS n_legible
FROM a JOIN m ON a.year = m.year AND m.r = 1 GROUP BY 1"""
)
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    a = cut(table(spark, d, "articles").groupBy("article_id").agg(F.min("year").alias("year"), F.min("publication").alias("publication"), F.min("state").alias("state"), F.min(F.length("text")).alias("n_chars"), F.min("legibility").alias("legibility"), F.min("page_number").alias("page_number")))
    top = shares.mode_of(a, "year", "publication").select("year", F.col("mode").alias("top_publication"), F.col("share").alias("top_share"))
    g = a.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_articles"), F.countDistinct("publication").alias("n_publications"), F.countDistinct("state").alias("n_states"), F.avg("n_chars").alias("mean_chars"), F.median("n_chars").alias("median_chars"),
        F.percentile("n_chars", 0.1).alias("p10_chars"), F.max("n_chars").cast("long").alias("max_chars"), F.avg(F.when(F.col("page_number") == 1, 1.0).otherwise(0.0)).alias("front_share"), F.count_if(F.col("legibility") == "Legible").alias("n_legible"),
    )
    return rounded(g.join(top, "year"))


@query(S("SELECT year, count(*) AS n, count(*) FILTER (WHERE gender = 'UNKNOWN') AS n_unknown, round(nf / nullif(nf + nm, 0), 6) AS share_f_classified, round(nf / (nf + nm + nu), 6) AS lower, round((nf + nu) / (nf + nm + nu), 6) AS upper, round(avg(weight), 6) AS mean_weight FROM (SELECT year, gender, weight, count(*) FILTER (WHERE gender = 'F') OVER (PARTITION BY year) AS nf, count(*) FILTER (WHERE gender = 'M') OVER (PARTITION BY year) AS nm, count(*) FILTER (WHERE gender = 'UNKNOWN') OVER (PARTITION BY year) AS nu FROM frame) GROUP BY year, nf, nm, nu"))
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    g = frame(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("gender") == x).alias(f"n_{x}") for x in ("F", "M", "UNKNOWN")], F.avg("weight").alias("mean_weight"))
    return rounded(g.select("year", "n", F.col("n_UNKNOWN").alias("n_unknown"), *V.unknown_bounds(F.col("n_F"), F.col("n_M"), F.col("n_UNKNOWN")), "mean_weight"))


_CONS = "count(*) AS n, round(avg((gender = p)::INT), 6) AS agree, round(avg((gender = p)::INT) FILTER (WHERE gender = 'F'), 6) AS agree_f, round(avg((gender = p)::INT) FILTER (WHERE gender = 'M'), 6) AS agree_m"


@query(S(f"SELECT coalesce(year, -1) AS year, {_CONS} FROM (SELECT *, CASE WHEN quoted THEN 'F' ELSE 'M' END AS p FROM frame WHERE gender <> 'UNKNOWN') GROUP BY ROLLUP (year)"))
def gender_consistency(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d).where("gender <> 'UNKNOWN'").withColumn("same", (F.col("gender") == F.when(F.col("quoted"), "F").otherwise("M")).cast("int"))
    on = lambda g: F.avg(F.when(F.col("gender") == g, F.col("same")))
    r = f.rollup("year").agg(F.count(F.lit(1)).alias("n"), F.avg("same").alias("agree"), on("F").alias("agree_f"), on("M").alias("agree_m"))
    return rounded(r.withColumn("year", F.coalesce("year", F.lit(-1))))


@query(S("SELECT section, year, sum(n_pos) AS n, count(DISTINCT article_id) AS n_clusters, sum(a) AS k, round(sum(a) / sum(n_pos), 6) AS share FROM (SELECT *, weight % 3 AS a, weight % 3 + weight % 2 AS n_pos FROM frame) WHERE n_pos > 0 GROUP BY 1, 2"))
def agency_yearly(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d).withColumn("a", F.col("weight") % 3).withColumn("p", F.col("weight") % 2)
    y = shares.agency_yearly(f, "a", "p", "article_id", ["section", "year"])
    return rounded(y.withColumn("k", F.round("k", 6)))


@query("WITH x AS (SELECT publication, year < 1930 AS first FROM articles WHERE year IS NOT NULL), c AS (SELECT publication, count(*) FILTER (WHERE first) / (SELECT count(*) FROM x WHERE first) AS a, count(*) FILTER (WHERE NOT first) / (SELECT count(*) FROM x WHERE NOT first) AS b FROM x GROUP BY 1) SELECT round(sum(abs(a - b)) / 2, 6) AS tvd FROM c")
def tvd(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").where("year is not null").select("publication", (F.col("year") < 1930).alias("first"))
    return rounded(shares.tvd(a.where("first"), a.where("not first"), "publication"))


@query()
def tvd_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Null distances of random prefixes of scans, for the sampling audit."""
    s = table(spark, d, "scans").groupBy("scan_id").agg(F.min("lccn").alias("lccn"))
    return rounded(shares.tvd_null(s, "lccn", 100, 20))


@query(S("SELECT section, sum(f) AS k, count(f) AS n, round(sum(f) / count(f), 6) AS share FROM frame GROUP BY 1"))
def pooled_period_share(spark: SparkSession, d: str) -> DataFrame:
    y = frame(spark, d).groupBy("section", "year").agg(F.sum("f").alias("k"), F.count("f").alias("n"))
    return rounded(shares.pooled_share(y, ["section"], "k", "n"))


@query(S("SELECT section, " + ", ".join(f"round(count(*) FILTER (WHERE role = '{t}') / count(*), 6) AS \"{t}\"" for t in TYPES) + " FROM frame GROUP BY 1"))
def topic_shares(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d).groupBy("section").pivot("role", TYPES).count().na.fill(0)
    whole = sum((F.col(t) for t in TYPES), F.lit(0))
    return rounded(p.select("section", *[(F.col(t) / whole).alias(t) for t in TYPES]))


@query(S("SELECT min(year) AS first_year, max(year) AS last_year, count(*) AS n, round(sum(f * weight) / sum(weight) FILTER (WHERE f IS NOT NULL), 6) AS weighted_share, (SELECT round(share, 6) FROM y ORDER BY year LIMIT 1) AS share_first, (SELECT round(share, 6) FROM y ORDER BY year DESC LIMIT 1) AS share_last, (SELECT round(min(share), 6) FROM y) AS share_min, (SELECT round(max(share), 6) FROM y) AS share_max FROM frame", y=_YEARLY))
def headline(spark: SparkSession, d: str) -> DataFrame:
    y = frame(spark, d).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("s"), F.sum(F.col("f") * F.col("weight")).alias("fw"), F.sum(F.when(F.col("f").isNotNull(), F.col("weight"))).alias("w"))
    return rounded(y.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("n").alias("n"), (F.sum("fw") / F.sum("w")).alias("weighted_share"), F.min_by("s", "year").alias("share_first"), F.max_by("s", "year").alias("share_last"), F.min("s").alias("share_min"), F.max("s").alias("share_max")))


# ------------------------------------------------------------------ trends and models


@query(S(f"SELECT {_SLOPE} FROM b JOIN m USING (z)", y=_YEARLY) .replace(" SELECT round(100", ", " + _hac_sql("y", []) + " SELECT round(100", 1))
def hac_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trend.hac_trend(shares.yearly_share(frame(spark, d), "f", "article_id"), [], centre=CENTRE))


@query(
    (S(f"SELECT publication, {_SLOPE} FROM b JOIN m USING (publication)", y="SELECT publication, year, count(*) AS n, avg(f) AS share FROM frame WHERE f IS NOT NULL GROUP BY 1, 2")).replace(
        " SELECT publication, round(100", ", " + _hac_sql("y", ["publication"]) + " SELECT publication, round(100", 1
    )
)
def hac_trend_by_publication(spark: SparkSession, d: str) -> DataFrame:
    y = shares.yearly_share(frame(spark, d), "f", "article_id", ["publication", "year"])
    return rounded(trend.hac_trend(y, ["publication"], centre=CENTRE))


_ROLE_YEARLY = "SELECT 'r_' || role AS role, year, count(*)::DOUBLE AS n, sum(f) / count(*) AS share FROM (SELECT role, year, f FROM frame WHERE f IS NOT NULL UNION ALL SELECT 'AUTHORITY', year, f FROM frame WHERE f IS NOT NULL AND authority) GROUP BY 1, 2"


@query(M.trend_intervals(FRAME_SQL, _ROLE_YEARLY))
def hac_trend_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Trends per role with t intervals, p and q values."""
    y = shares.role_trends(frame(spark, d), FLAGS, "f", "article_id")
    return rounded(trend.bh_fdr(trend.with_t_interval(trend.hac_trend(y, ["role"], centre=CENTRE), "n_years"), "p"))


@query((S(f"SELECT y.year, y.n, round(y.share, 6) AS share, x.slope_pp_dec, x.se FROM y, (SELECT {_SLOPE} FROM b JOIN m USING (z)) x", y=_YEARLY)).replace(" SELECT y.year", ", " + _hac_sql("y", []) + " SELECT y.year", 1))
def share_with_trend(spark: SparkSession, d: str) -> DataFrame:
    y = cut(shares.yearly_share(frame(spark, d), "f", "article_id"))
    t = trend.hac_trend(y, [], centre=CENTRE).select("slope_pp_dec", "se")
    return rounded(with_row(y.select("year", "n", "share"), t))


@query(S("SELECT floor(year / 2)::BIGINT AS bin, round(avg(year), 6) AS mid, round(avg(f), 6) AS share, count(*) AS n FROM frame WHERE f IS NOT NULL GROUP BY 1"))
def binned_shares(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d).where("f is not null").groupBy(F.floor(F.col("year") / 2).alias("bin"))
    return rounded(f.agg(F.avg("year").alias("mid"), F.avg("f").alias("share"), F.count(F.lit(1)).alias("n")))


_TREND = "round(slope, 6) AS slope_pp_dec, round(se, 6) AS se, round(level, 6) AS level, ny AS n_years FROM hac"


@query(M.query(FRAME_SQL, {"y": "SELECT section, year, count(*) AS n, avg(f) AS share FROM frame WHERE f IS NOT NULL GROUP BY 1, 2"} | M.hac("y", ["section"]), f"SELECT section, {_TREND}"))
def binned_trends(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trend.binned_trend(frame(spark, d), ["section"], "f", 1, centre=CENTRE))


_PV = "SELECT publication, year, round(abs(avg(f) - 0.5), 9) AS p FROM frame WHERE f IS NOT NULL GROUP BY 1, 2"


@query(S("SELECT publication, year, p, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, publication, year) AS r, count(*) OVER () AS m FROM pv)", pv=_PV))
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    p = frame(spark, d).where("f is not null").groupBy("publication", "year").agg(F.round(F.abs(F.avg("f") - 0.5), 9).alias("p"))
    return trend.bh_fdr(p, "p").withColumn("q", F.round("q", 9))


@query(
    S(
        "SELECT round(100 * any_value(b), 6) AS slope_pp_dec, round(100 * sqrt(sum(u * u) * count(*) / (count(*) - 1)) / any_value(vxx), 6) AS se, any_value(nn)::BIGINT AS n, count(*) AS n_clusters FROM v",
        t="SELECT count(*)::DOUBLE AS nn, avg((year - 1998) / 10.0::DOUBLE) AS mx, avg(f) AS my FROM frame WHERE f IS NOT NULL",
        w="SELECT sum(((year - 1998) / 10.0::DOUBLE - mx) ** 2) AS vxx, sum(((year - 1998) / 10.0::DOUBLE - mx) * (f - my)) AS vxy FROM frame, t WHERE f IS NOT NULL",
        v="SELECT publication, any_value(vxy / vxx) AS b, any_value(vxx) AS vxx, any_value(nn) AS nn, sum(((year - 1998) / 10.0::DOUBLE - mx) * (f - my - vxy / vxx * ((year - 1998) / 10.0::DOUBLE - mx))) AS u FROM frame, t, w WHERE f IS NOT NULL GROUP BY 1",
    )
)
def lpm_trend_plain(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.lpm_trend_plain(frame(spark, d), "f", "publication", centre=CENTRE))


_SPECS = [[], ["section"], ["section", "publication"], ["section", "publication", "page_band"]]


@query(M.lpm(FRAME_SQL, _SPECS))
def lpm_trend(spark: SparkSession, d: str) -> DataFrame:
    """Trends with absorbed effects and two-way cluster errors."""
    return rounded(panel.trend_table(frame(spark, d), "f", _SPECS, centre=CENTRE))


@query(M.adjusted(FRAME_SQL, ["section", "publication"]))
def adjusted_yearly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.adjusted_yearly(frame(spark, d), "f", ["section", "publication"]))


@query()
def adjusted_yearly_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.adjusted_yearly(frame(spark, d), "f", ["section", "publication"], cluster="publication", B=20))


@query(M.wild(FRAME_SQL))
def wild_cluster(spark: SparkSession, d: str) -> DataFrame:
    r = panel.wild_cluster_p(frame(spark, d), "f", ["section"], centre=CENTRE)
    return spark.createDataFrame([(round(r["t"], 6), round(r["p"], 6), r["n_clusters"], r["B"])], "t double, p double, n_clusters int, B int")


@query(M.logit(FRAME_SQL))
def logit_ame(spark: SparkSession, d: str) -> DataFrame:
    return _logit(spark, d, [])


@query()
def logit_ame_topics(spark: SparkSession, d: str) -> DataFrame:
    """With dummies for the sections."""
    return _logit(spark, d, ["section"])


def _logit(spark: SparkSession, d: str, fe: list[str]) -> DataFrame:
    r = panel.logit_ame(frame(spark, d), "f", fe, centre=CENTRE)
    return rounded(spark.createDataFrame([(float(r["ame_pp_dec"]), float(r["se"]), r["n"], r["n_clusters"])], "ame_pp_dec double, se double, n long, n_clusters int"))


# ------------------------------------------------------------------ specification grids

GRID = {**mv.GRID, "tier": ["hp"], "resolution": ["mixed_unknown", "v2_merge"]}


def _mv_frame(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d).withColumn("f_v2", F.when(F.col("quoted"), F.col("f")))


_SEL = "(population <> 'ner' OR ner_ok) AND (dedup <> 'drop_near' OR NOT near_dup) AND (ocr <> 'clean' OR ocr_clean) AND (papers <> 'excl_evening_star' OR NOT evening_star) AND (papers <> 'capped' OR in_cap) AND (content <> 'news_only' OR is_news)"


@query(
    S(
        "SELECT population, dedup, ocr, papers, content, resolution, estimand, sum(y)::DOUBLE AS k, count(y) AS n FROM x GROUP BY 1, 2, 3, 4, 5, 6, 7",
        g="SELECT * FROM (VALUES ('ner'), ('ner+pattern')) a(population), (VALUES ('keep'), ('drop_near')) b(dedup), (VALUES ('all'), ('clean')) c(ocr), (VALUES ('all'), ('excl_evening_star'), ('capped')) e(papers), (VALUES ('all'), ('news_only')) h(content), (VALUES ('mixed_unknown'), ('v2_merge')) i(resolution), (VALUES ('female_share'), ('authority_share')) j(estimand)",
        x=f"SELECT g.*, CASE WHEN resolution = 'mixed_unknown' THEN f WHEN quoted THEN f END AS y FROM frame, g WHERE {_SEL} AND (estimand = 'female_share' OR authority)",
    )
)
def multiverse_counts(spark: SparkSession, d: str) -> DataFrame:
    """Successes and rows of every specification, from the compressed table."""
    small = mv.compressed(_mv_frame(spark, d), {("hp", "mixed_unknown"): "f", ("hp", "v2_merge"): "f_v2"}, {"female_share": F.lit(True), "authority_share": F.col("r_AUTHORITY")})
    names = ["population", "dedup", "ocr", "papers", "content", "resolution"]
    flags = small.withColumnsRenamed({"f_ner": "ner_ok", "f_dup": "near_dup", "f_ocr": "ocr_clean", "f_star": "evening_star", "f_cap": "in_cap", "f_news": "is_news"})
    cells = F.broadcast(mv.grid_table(spark, {k: GRID[k] for k in names}))  # one row per specification
    return flags.join(cells, "resolution").where(_SEL).groupBy(*names, "estimand").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))


def _grid_frame(spark: SparkSession, d: str) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """The frame of the full grid (see ``model_sql.GRID_FRAME``) and its outcomes by tier and resolution."""
    f = frame(spark, d).withColumn("year", 1900 + 9 * (F.col("year") - 1995))
    tiers = {"h": F.when(F.col("weight") % 2 == 0, F.col("f")), "hp": F.col("f"), "hpn": F.coalesce("f", F.when(F.col("weight") % 3 == 0, F.lit(1.0)))}
    f = f.withColumns({f"y_{t}": c for t, c in tiers.items()} | {f"y_{t}_v2": F.when(F.col("quoted"), c) for t, c in tiers.items()})
    return f, {(t, r): f"y_{t}" + ("_v2" if r == "v2_merge" else "") for t in tiers for r in mv.GRID["resolution"]}


_ESTIMANDS = {"female_share": F.lit, "authority_share@A": ["ECONOMY", "PROMO"], "authority_share@B": ["ECONOMY", "PROMO", "SMALL"], "civic_share@A": ["STANDARD"], "civic_share@B": ["MEDIUM", "STANDARD"]}


def _estimands() -> dict:
    return {k: F.lit(True) if callable(v) else F.col("role").isin(v) for k, v in _ESTIMANDS.items()}


def _grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the full grid, not rounded."""
    f, outcomes = _grid_frame(spark, d)
    return trend.with_t_interval(mv.multiverse(f, outcomes, _estimands(), mv.GRID), "n_years")


def _full_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with slopes to nine digits, for the sign of a slope that is zero but for rounding would be chance."""
    return _grid_cells(spark, d).withColumns({c: F.round(c, 9) for c in ("slope_pp_dec", "ci_lo", "ci_hi")})


@query(M.multiverse(FRAME_SQL, mv.GRID, M.ESTIMANDS))
def multiverse_cells(spark: SparkSession, d: str) -> DataFrame:
    """The whole aggregate grid: 864 specifications of five estimands. Rounded once: nine digits before six move values at a half."""
    return rounded(_grid_cells(spark, d))


@query(M.multiverse(FRAME_SQL, mv.METHOD_GRID, M.METHODS))
def multiverse_methods(spark: SparkSession, d: str) -> DataFrame:
    """The grid of thresholded methods: 144 specifications of eight method flags."""
    f, outcomes = _grid_frame(spark, d)
    score = {"C": F.col("weight"), "D": (F.col("weight") * 7) % 50}
    flags = {f"authority_share@{m}{t}": V.over(c / 50.0, t) for m, c in score.items() for t in (0.3, 0.5, 0.7)}
    flags |= {"authority_share@A(app)": _estimands()["authority_share@A"], "authority_share@B(app)": _estimands()["authority_share@B"]}
    grid = mv.METHOD_GRID
    outcomes = {k: c for k, c in outcomes.items() if k[0] in grid["tier"] and k[1] in grid["resolution"]}
    return rounded(trend.with_t_interval(mv.multiverse(f, outcomes, flags, grid), "n_years"))


@query()
def multiverse_effects(spark: SparkSession, d: str) -> DataFrame:
    """The 72 models with and without absorbed effects."""
    f, outcomes = _grid_frame(spark, d)
    e = _estimands()
    return rounded(mv.effect_cells(f, {t: outcomes[t, "mixed_unknown"] for t in ("h", "hp", "hpn")}, {k: e[k] for k in ("female_share", "authority_share@B")}, {"none": [], "topic+paper": ["section", "publication"]}))


_BY = [["estimand"], ["estimand", "resolution"], ["estimand", "tier"], ["estimand", "papers"]]


@query(M.multiverse_summary(FRAME_SQL, mv.GRID, M.ESTIMANDS, _BY))
def multiverse_summary(spark: SparkSession, d: str) -> DataFrame:
    c = cut(_full_cells(spark, d))
    out = None
    for k in _BY:
        s = mv.multiverse_summary(c, k).withColumn("by", F.lit("+".join(k)))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return rounded(out)


@query(S("SELECT publication, count(s) AS n_cells, round(count(*) FILTER (WHERE s > 0) / count(s), 6) AS share_positive, round(min(s), 6) AS slope_min, round(median(s), 6) AS slope_median, round(max(s), 6) AS slope_max, (bool_and(s > 0) OR bool_and(s < 0)) AS sign_survives_all FROM (SELECT publication, year, avg(f) - 0.5 AS s FROM frame WHERE f IS NOT NULL GROUP BY 1, 2) GROUP BY 1"))
def summary_of_cells(spark: SparkSession, d: str) -> DataFrame:
    c = frame(spark, d).where("f is not null").groupBy("publication", "year").agg((F.avg("f") - 0.5).alias("slope_pp_dec")).withColumn("ci_lo", F.col("slope_pp_dec")).withColumn("ci_hi", F.col("slope_pp_dec"))
    return rounded(mv.multiverse_summary(c, ["publication"]).drop("share_sig_positive", "share_sig_negative"))


@query(M.claims(FRAME_SQL, mv.GRID, 20))
def claims(spark: SparkSession, d: str) -> DataFrame:
    """Claim rules over the trends, shares and grids of this frame."""
    f = cut(_mv_frame(spark, d))
    tr = lambda df, e, m, s: trend.with_t_interval(trend.hac_trend(df, [], centre=CENTRE), "n_years").select(F.lit(e).alias("estimand"), F.lit(m).alias("method"), F.lit(s).alias("subset"), F.col("slope_pp_dec").alias("slope"), "ci_lo", "ci_hi")
    y = shares.yearly_share(f, "f", "article_id")
    ya = shares.yearly_share(f.where("r_AUTHORITY"), "f", "article_id")
    gap = y.join(ya.select("year", F.col("share").alias("share_auth")), "year").withColumn("share", F.col("share_auth") - F.col("share"))
    trends = tr(y, "female_share", "B", "primary").unionByName(tr(y, "female_share", "B", "raw")).unionByName(tr(gap, "authority_gap", "B", "primary")).unionByName(tr(shares.yearly_share(f.withColumn("u", (F.col("gender") == "UNKNOWN").cast("double")), "u", "article_id"), "unknown_share", "B", "primary"))
    yearly = y.join(ya.select("year", F.col("share").alias("share_auth")), "year").withColumn("method", F.lit("B"))
    part = F.split("estimand", "@")
    robust = mv.multiverse_summary(_full_cells(spark, d), ["estimand"]).select(part[0].alias("estimand"), F.get(part, F.lit(1)).alias("method"), "slope_min", "sign_survives_all")
    contrasts = shares.speaker_gap(f, "f", "quoted", "article_id", "year", B=20).select("period", "ci_hi")
    by_role = trend.with_t_interval(trend.hac_trend(shares.role_trends(f, FLAGS, "f", "article_id"), ["role"], centre=CENTRE), "n_years")
    spread = agreement.slope_spread(by_role.withColumn("one", F.lit("x")), "one", "slope_pp_dec", "ci_lo", "ci_hi", "role").select(F.col("one").alias("role"), "ratio", "same_sign")
    return claim_rules.claims(trends, yearly, robust, contrasts, spread)


# ------------------------------------------------------------------ agreement

_PRF = "SELECT {k} round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, n_pos_ref, n_pred_pos, round((tp + fn) / w, 6) AS prev_ref_w, round((tp + fp) / w, 6) AS prev_pred_w FROM (SELECT {k} coalesce(sum(weight) FILTER (WHERE authority AND quoted), 0) AS tp, coalesce(sum(weight) FILTER (WHERE NOT authority AND quoted), 0) AS fp, coalesce(sum(weight) FILTER (WHERE authority AND NOT quoted), 0) AS fn, sum(weight) AS w, count(*) FILTER (WHERE authority) AS n_pos_ref, count(*) FILTER (WHERE quoted) AS n_pred_pos FROM frame {g})"


@query(S(_PRF.format(k="", g="")))
def weighted_prf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.weighted_prf(frame(spark, d), F.col("r_AUTHORITY"), F.col("quoted"), F.col("weight")))


@query(S(_PRF.format(k="gender,", g="GROUP BY gender")))
def prf_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.weighted_prf(frame(spark, d), F.col("r_AUTHORITY"), F.col("quoted"), F.col("weight"), ["gender"]))


_PRED = "CASE WHEN quoted THEN gender WHEN ocr_clean THEN 'F' ELSE 'UNKNOWN' END"


@query(
    S(
        "SELECT 'precision_classified' AS metric, round(sum(weight) FILTER (WHERE k AND s AND t = p) / sum(weight) FILTER (WHERE k AND s), 6) AS value, sum(weight) FILTER (WHERE k AND s) AS n FROM x UNION ALL SELECT 'recall_reference', round(sum(weight) FILTER (WHERE k AND t = p) / sum(weight) FILTER (WHERE k), 6), sum(weight) FILTER (WHERE k) FROM x UNION ALL "
        "SELECT 'f1_F', round(2 * sum(weight) FILTER (WHERE t = 'F' AND p = 'F') / (sum(weight) FILTER (WHERE t = 'F') + sum(weight) FILTER (WHERE p = 'F')), 6), sum(weight) FILTER (WHERE t = 'F') + sum(weight) FILTER (WHERE p = 'F') FROM x UNION ALL SELECT 'f1_M', round(2 * sum(weight) FILTER (WHERE t = 'M' AND p = 'M') / (sum(weight) FILTER (WHERE t = 'M') + sum(weight) FILTER (WHERE p = 'M')), 6), sum(weight) FILTER (WHERE t = 'M') + sum(weight) FILTER (WHERE p = 'M') FROM x UNION ALL "
        "SELECT 'false_assignment', round(sum(weight) FILTER (WHERE NOT k AND s) / sum(weight) FILTER (WHERE NOT k), 6), sum(weight) FILTER (WHERE NOT k) FROM x",
        x=f"SELECT weight, gender AS t, {_PRED} AS p, gender <> 'UNKNOWN' AS k, {_PRED} <> 'UNKNOWN' AS s FROM frame",
    )
)
def gender_validation(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d).withColumn("pred", F.when(F.col("quoted"), F.col("gender")).when(F.col("ocr_clean"), "F").otherwise("UNKNOWN"))
    return rounded(agreement.gender_validation(f, "gender", "pred", F.col("weight")))


_KAPPA = "SELECT {k} round((po - pe) / (1 - pe), 6) AS kappa, round(po, 6) AS agree, n FROM (SELECT {k} avg((a = b)::INT) AS po, count(*) AS n, avg(a::INT) * avg(b::INT) + (1 - avg(a::INT)) * (1 - avg(b::INT)) AS pe FROM {src} GROUP BY {g})"


@query(S(_KAPPA.format(k="year,", src="(SELECT year, quoted AS a, ocr_clean AS b FROM frame)", g="year")))
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.cohen_kappa(frame(spark, d), F.col("quoted"), F.col("ocr_clean"), ["year"]))


@query(S(_KAPPA.format(k="pair, year,", g="pair, year", src="(SELECT 'quoted-ocr_clean' AS pair, year, quoted AS a, ocr_clean AS b FROM frame UNION ALL SELECT 'quoted-in_cap', year, quoted, in_cap FROM frame UNION ALL SELECT 'ocr_clean-in_cap', year, ocr_clean, in_cap FROM frame)")))
def pairwise_kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(agreement.pairwise_kappa(frame(spark, d), ["quoted", "ocr_clean", "in_cap"], ["year"]))


_PAIRS = "(SELECT 'quoted-ocr_clean' AS pair, year, quoted AS a, ocr_clean AS b FROM frame UNION ALL SELECT 'quoted-in_cap', year, quoted, in_cap FROM frame UNION ALL SELECT 'ocr_clean-in_cap', year, ocr_clean, in_cap FROM frame)"


@query(
    M.query(
        FRAME_SQL,
        {"y": f"SELECT pair, year, n, (po - pe) / (1 - pe) AS share FROM (SELECT pair, year, avg((a = b)::INT) AS po, count(*) AS n, avg(a::INT) * avg(b::INT) + (1 - avg(a::INT)) * (1 - avg(b::INT)) AS pe FROM {_PAIRS} GROUP BY pair, year)"} | M.hac("y", ["pair"]),
        "SELECT pair, round(slope / 100, 6) AS slope_per_decade, round(se / 100, 6) AS se, ny AS n_years FROM hac",
    )
)
def kappa_trend(spark: SparkSession, d: str) -> DataFrame:
    k = agreement.pairwise_kappa(frame(spark, d), ["quoted", "ocr_clean", "in_cap"], ["year"])
    t = trend.hac_trend(k, ["pair"], "kappa", "n", centre=CENTRE)
    return rounded(t.select("pair", (F.col("slope_pp_dec") / 100).alias("slope_per_decade"), (F.col("se") / 100).alias("se"), "n_years"))


@query(S("SELECT gender, " + ", ".join(f"round(max(kappa) FILTER (WHERE year = {y}), 6) AS \"{y}\"" for y in range(1995, 2002)) + f" FROM ({_KAPPA.format(k='gender, year,', g='gender, year', src='(SELECT gender, year, quoted AS a, ocr_clean AS b FROM frame)')}) GROUP BY 1"))
def pivot_kappa(spark: SparkSession, d: str) -> DataFrame:
    k = agreement.cohen_kappa(frame(spark, d), F.col("quoted"), F.col("ocr_clean"), ["gender", "year"])
    return rounded(k.groupBy("gender").pivot("year", list(range(1995, 2002))).agg(F.max("kappa")))


@query(S("SELECT method, year, sum(y::INT)::BIGINT AS k, count(*) AS n, round(avg(y::INT), 6) AS prevalence, round(avg(f) FILTER (WHERE y), 6) AS share FROM (SELECT year, f, 'authority' AS method, authority AS y FROM frame UNION ALL SELECT year, f, 'quoted', quoted FROM frame UNION ALL SELECT year, f, 'in_cap', in_cap FROM frame) GROUP BY 1, 2"))
def method_yearly(spark: SparkSession, d: str) -> DataFrame:
    f = frame(spark, d).select("year", "f", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("y")) for n, c in (("authority", "r_AUTHORITY"), ("quoted", "quoted"), ("in_cap", "in_cap"))])).alias("s")).select("year", "f", "s.*")
    return rounded(f.groupBy("method", "year").agg(F.sum(F.col("y").cast("int")).alias("k"), F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("int")).alias("prevalence"), F.avg(F.when(F.col("y"), F.col("f"))).alias("share")))


@query(S("SELECT section, round(min(s), 6) AS slope_min, round(max(s), 6) AS slope_max, round(max(abs(s)) / nullif(min(abs(s)), 0), 6) AS ratio, (bool_and(s > 0) OR bool_and(s < 0)) AS same_sign, count(*) FILTER (WHERE s > 0) AS n_sig_pos, count(*) FILTER (WHERE s < 0) AS n_sig_neg, array_to_string(list_sort(list_distinct(list(page_band))), ',') AS methods FROM (SELECT section, page_band, round(avg(f) - 0.5, 9) AS s FROM frame GROUP BY 1, 2) GROUP BY 1"))
def slope_spread(spark: SparkSession, d: str) -> DataFrame:
    s = frame(spark, d).groupBy("section", "page_band").agg(F.round(F.avg("f") - 0.5, 9).alias("s"))
    return rounded(agreement.slope_spread(s, "section", "s", "s", "s", "page_band"))


@query(S("SELECT article_id, count(*) AS n FROM frame WHERE NOT (quoted = ocr_clean AND ocr_clean = in_cap) GROUP BY 1"))
def disagreement(spark: SparkSession, d: str) -> DataFrame:
    return frames.disagreement(frame(spark, d), ["quoted", "ocr_clean", "in_cap"]).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ frame and filters


@query("""WITH t AS (SELECT article_id, min(topic) AS topic FROM article_topics GROUP BY 1), a AS (SELECT article_id, min(year) AS year, min(page_number) AS p FROM articles GROUP BY 1)
SELECT year, coalesce(label, 'unassigned') AS topic_label, coalesce(section, 'OTHER') AS section, coalesce(is_news, true) AS is_news, CASE WHEN p IS NULL THEN 'na' WHEN p = 1 THEN 'p1' WHEN p <= 4 THEN 'p2-4' WHEN p <= 12 THEN 'p5-12' ELSE 'p13+' END AS page_band, count(*) AS n
FROM a LEFT JOIN t USING (article_id) LEFT JOIN topic_labels l ON l.topic = t.topic GROUP BY 1, 2, 3, 4, 5""")
def frame_star_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("article_id").agg(F.min("year").alias("year"), F.min("page_number").alias("p"))
    t = topics(spark, d).groupBy("article_id").agg(F.min("topic").alias("topic"))
    s = frames.star_join(a.select("article_id"), a, t, table(spark, d, "topic_labels")).withColumn("page_band", V.page_band(F.col("p")))
    return s.groupBy("year", "topic_label", "section", "is_news", "page_band").agg(F.count(F.lit(1)).alias("n"))


@query(S("SELECT sample, count(*) AS n, count(f) AS n_classified, round(avg(f), 6) AS share FROM (SELECT f, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN NOT evening_star THEN 'excl_evening_star' END, CASE WHEN is_news THEN 'news_only' END, CASE WHEN year - 75 <= 1921 THEN 'pre_1922' END, CASE WHEN year - 75 >= 1924 THEN 'post_1923' END], lambda x: x IS NOT NULL)) AS sample FROM frame) GROUP BY 1"))
def named_samples(spark: SparkSession, d: str) -> DataFrame:
    f = frames.named_samples(frame(spark, d).withColumn("year", F.col("year") - 75))
    return rounded(f.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("n_classified"), F.avg("f").alias("share")))


@query(S("SELECT year, section, count(*) AS n FROM frame WHERE ner_ok AND NOT near_dup AND ocr_clean AND in_cap AND is_news GROUP BY 1, 2"))
def selected_spec(spark: SparkSession, d: str) -> DataFrame:
    f = mv.select_spec(frame(spark, d), {"population": "ner", "dedup": "drop_near", "ocr": "clean", "papers": "capped", "content": "news_only"})
    return f.groupBy("year", "section").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT article_id, (('0x' || substring(split_part(article_id, '-', 2), 1, 8))::BIGINT) AS h, CASE WHEN year > 1899 AND year <= 1915 THEN '1900-15' WHEN year > 1915 AND year <= 1930 THEN '1918-30' WHEN year > 1930 AND year <= 1945 THEN '1933-45' WHEN year > 1945 AND year <= 1963 THEN '1948-63' END AS period, (year // 5) * 5 AS bin5, (year // 10) * 10 AS decade, (year - 1930) / 10.0::DOUBLE AS decades FROM (SELECT DISTINCT article_id, year FROM articles)")
def derived_values(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("article_id", "year").distinct()
    y = F.col("year")
    return a.select("article_id", V.id_number(F.col("article_id")).alias("h"), V.period(y).alias("period"), V.floor_bin(y, 5).alias("bin5"), V.floor_bin(y, 10).alias("decade"), V.decades(y).alias("decades"))


_T = "['mrs', 'miss', 'misses', 'ms', 'madame', 'mme', 'mlle', 'lady']"


@query(f"""WITH t AS (SELECT l_orderkey AS id, list_sort(list_distinct(list(CASE l_linenumber % 4 WHEN 0 THEN 'mrs' WHEN 1 THEN 'capt' WHEN 2 THEN 'jr' ELSE 'miss' END))) AS titles, max(CASE l_returnflag WHEN 'A' THEN 'F' ELSE 'M' END) AS g FROM lineitem GROUP BY 1)
SELECT id, array_to_string(titles, ',') AS titles, list_has_any(titles, {_T}) AND len(list_filter(titles, lambda x: NOT list_contains(list_concat({_T}, ['jr', 'sr']), x))) > 0 AS mixed, CASE WHEN mixed THEN 'UNKNOWN' ELSE g END AS gender FROM t""")
def mixed_titles(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("l_linenumber") % 4
    title = F.when(m == 0, "mrs").when(m == 1, "capt").when(m == 2, "jr").otherwise("miss")
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(title)).alias("titles"), F.max(F.when(F.col("l_returnflag") == "A", "F").otherwise("M")).alias("g"))
    return t.select("id", F.array_join("titles", ",").alias("titles"), V.mixed_title(F.col("titles")).alias("mixed"), V.mixed_title_gender(F.col("g"), F.col("titles")).alias("gender"))


@query("""WITH e AS (SELECT user_id, list(CASE event_type WHEN 'click' THEN 'F' WHEN 'view' THEN 'M' END) AS p, list(CASE WHEN event_type = 'signup' AND value > 30 THEN 'F' WHEN event_type = 'error' AND value > 40 THEN 'M' END) AS n, CASE user_id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'N' ELSE 'F' END AS h FROM events GROUP BY user_id, date_trunc('day', ts)),
c AS (SELECT user_id, h, len(list_filter(p, lambda x: x = 'F')) AS f, len(list_filter(p, lambda x: x = 'M')) AS m, list_contains(n, 'F') AS nf, list_contains(n, 'M') AS nm FROM e),
s AS (SELECT *, CASE WHEN f > 0 AND 3 * f >= 2 * (f + m) THEN 'F' WHEN m > 0 AND 3 * m >= 2 * (f + m) THEN 'M' ELSE 'UNKNOWN' END AS pron, CASE WHEN nf AND nm THEN 'CONFLICT' WHEN nf THEN 'F' WHEN nm THEN 'M' ELSE 'UNKNOWN' END AS noun FROM c)
SELECT CASE WHEN h = 'F' THEN 'F' ELSE 'UNKNOWN' END AS gender_h, CASE WHEN h = 'F' THEN 'F' ELSE pron END AS gender_hp, CASE WHEN h = 'F' THEN 'F' WHEN noun IN ('F', 'M') THEN noun ELSE pron END AS gender_hpn, CASE WHEN h = 'F' THEN 'honorific' WHEN f + m = 0 THEN 'none' WHEN pron = 'UNKNOWN' THEN 'conflict' ELSE 'pronoun' END AS src_hp, noun AS gnoun_signal, count(*) AS n FROM s GROUP BY 1, 2, 3, 4, 5""")
def gender_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    et, v = F.col("event_type"), F.col("value")
    e = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(
        F.collect_list(F.when(et == "click", "F").when(et == "view", "M")).alias("p"), F.collect_list(F.when((et == "signup") & (v > 30), "F").when((et == "error") & (v > 40), "M")).alias("n"))
    r = rules.resolve_gender(e.withColumn("h", F.when(F.col("user_id") % 3 == 2, "F").otherwise("N")), "h", "p", "n")
    return r.groupBy("gender_h", "gender_hp", "gender_hpn", "src_hp", "gnoun_signal").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, " + ", ".join(f"max((event_type = '{t}')::INT) AS {t}" for t in ("click", "view", "signup")) + ", max((event_type IN ('error', 'purchase'))::INT) = 1 AS authority FROM events GROUP BY 1")
def role_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("r"))
    names = ["click", "view", "signup"]
    hot = V.multi_hot(F.col("r"), names)
    flags = V.role_flags(F.col("r"), "x", names, ["error", "purchase"])
    return e.select("user_id", *[hot[i].alias(n) for i, n in enumerate(names)], flags[-1].alias("authority"))


# ------------------------------------------------------------------ ranking and sampling


@query("SELECT article_id, row_number() OVER (PARTITION BY publication, year ORDER BY (('0x' || substring(split_part(article_id, '-', 2), 1, 8))::BIGINT), article_id) <= 3 AS in_cap FROM (SELECT article_id, min(publication) AS publication, min(year) AS year FROM articles GROUP BY 1)")
def paper_year_cap(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("article_id").agg(F.min("publication").alias("publication"), F.min("year").alias("year"))
    return ranking.cap_per_group(a, ["publication", "year"], [V.id_prefix(F.col("article_id")), F.col("article_id")], 3).select("article_id", "in_cap")


@query("SELECT section, o_orderkey, pop_n, least(25, pop_n) AS sample_n, round(pop_n / least(25, pop_n), 6) AS weight FROM (SELECT c_mktsegment AS section, o_orderkey, count(*) OVER (PARTITION BY c_mktsegment) AS pop_n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(o_orderkey || '|0'), o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r <= 25")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("section")), F.col("o_custkey") == F.col("c_custkey")).select("section", "o_orderkey")
    return rounded(ranking.stratified_sample(o, ["section"], "o_orderkey", 25).select("section", "o_orderkey", "pop_n", "sample_n", "weight"))


@query("SELECT article_id, year FROM (SELECT article_id, year, row_number() OVER (PARTITION BY year ORDER BY md5(article_id || '|0'), article_id) AS r FROM (SELECT DISTINCT article_id, year FROM articles)) WHERE r <= 50")
def per_year_sample(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("article_id", "year").distinct()
    return ranking.first_n(a, ["year"], [ranking.hash_order(F.col("article_id")), F.col("article_id")], 50)


@query("SELECT year, article_id, rank, row_number() OVER (ORDER BY rank, year NULLS FIRST) AS place FROM (SELECT article_id, year, row_number() OVER (PARTITION BY year ORDER BY md5(article_id || '|0'), article_id) AS rank FROM (SELECT DISTINCT article_id, year FROM articles)) WHERE rank <= 20")
def interleaved_sample(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("article_id", "year").distinct()
    return ranking.interleave(a, "year", "article_id", 20).select("year", "article_id", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


@query("SELECT DISTINCT article_id FROM articles WHERE (('0x' || substring(md5(article_id || '|7'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE < 0.2")
def fraction_sample(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fraction_sample(table(spark, d, "articles").select("article_id").distinct(), "article_id", 0.2, 7)


@query("SELECT year, scan_id, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY year ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT year, scan_id, count(DISTINCT article_id) AS n FROM articles GROUP BY 1, 2)) WHERE b < 30")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "articles").groupBy("year", "scan_id").agg(F.countDistinct("article_id").alias("n"))
    return ranking.quota_sample(s, "year", ["scan_id"], "n", 30)


@query("SELECT year, in_prefix, count(*) AS n FROM (SELECT year, row_number() OVER (PARTITION BY year ORDER BY arrived, article_id) <= 40 AS in_prefix FROM (SELECT article_id, min(year) AS year, min(arrived_at) AS arrived FROM articles GROUP BY 1)) GROUP BY 1, 2")
def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("article_id").agg(F.min("year").alias("year"), F.min("arrived_at").alias("arrived"))
    return ranking.prefix_split(a, "year", ["arrived", "article_id"], 40).groupBy("year", "in_prefix").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, o_orderkey FROM (SELECT o_orderkey, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(o_orderkey || '|0'), o_orderkey) AS r FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN 'dear' END, CASE WHEN o_orderstatus = 'F' THEN 'done' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END], lambda x: x IS NOT NULL)) AS kind FROM orders)) WHERE r <= 4")
def failure_examples(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"dear": F.col("o_totalprice") > 300000, "done": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return ranking.kinds_sample(table(spark, d, "orders"), kinds, "o_orderkey").select("kind", "o_orderkey")


@query(S("SELECT publication, mode, n, round(n / t, 6) AS share FROM (SELECT publication, role AS mode, count(*) AS n, sum(count(*)) OVER (PARTITION BY publication) AS t, row_number() OVER (PARTITION BY publication ORDER BY count(*) DESC, role) AS r FROM frame GROUP BY 1, 2) WHERE r = 1"))
def mode_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.mode_of(frame(spark, d), "publication", "role"))


# ------------------------------------------------------------------ joins, sinks, streams, models


@query("SELECT a.article_id FROM (SELECT DISTINCT article_id FROM articles) a WHERE NOT EXISTS (SELECT 1 FROM article_topics t WHERE t.article_id = a.article_id)")
def unlabelled_articles(spark: SparkSession, d: str) -> DataFrame:
    return frames.not_in(table(spark, d, "articles").select("article_id").distinct(), topics(spark, d), "article_id")


@query("SELECT s.scan_id, count(DISTINCT a.article_id) AS n FROM articles a JOIN scans s ON a.scan_id = s.scan_id GROUP BY 1")
def articles_per_scan(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").select("scan_id", "article_id").distinct()
    return a.join(table(spark, d, "scans").select("scan_id").distinct(), "scan_id").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT o_orderstatus, count(*) AS n, sha256(" + " || ':' || ".join(f"sum(('0x' || substring(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))
    + """) AS digest FROM (SELECT o_orderstatus, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS h FROM orders) GROUP BY 1"""
)
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return content_hash(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    s = streams.file_stream(spark, f"{d}/events.parquet*", table(spark, d, "events"))
    w = streams.windowed_counts(s, "ts", "event_type", "value")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, sum((o_orderstatus = 'F')::INT)::DOUBLE AS k, round(avg((o_orderstatus = 'F')::INT), 6) AS share FROM orders GROUP BY 1")
def stream_running_share(spark: SparkSession, d: str) -> DataFrame:
    s = streams.file_stream(spark, f"{d}/orders.parquet*", table(spark, d, "orders"))
    return rounded(streams.running_share(s.withColumn("year", F.year("o_orderdate")).withColumn("done", (F.col("o_orderstatus") == "F").cast("double")), "year", "done"))


@query()
def embedding_crossfit(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of a role model on embeddings."""
    e = models.with_vector(table(spark, d, "embeddings"), "embedding").withColumn("y", (F.col("label") == 0).cast("double"))
    r = models.crossfit(e, "vec_id", ["y"], models.embedding_stages, k=3)
    return rounded(r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("p_y").alias("mean_p")))


def _topic_weights(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.feature import StopWordsRemover

    from broadsheet.operators import words

    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0))
    return cut(words.tfidf(table(spark, d, "documents"), "doc_id", found, stop=StopWordsRemover.loadDefaultStopWords("english")))


@query()
def topic_stability_runs(spark: SparkSession, d: str) -> DataFrame:
    """The topic model of three seeds: how well the topics of the first run are found again by the others."""
    s = models.topic_runs(_topic_weights(spark, d), "doc_id", "word", "tfidf")[2]
    return rounded(s.groupBy("seed").agg(F.avg("cosine").alias("mean_cosine"), F.min("cosine").alias("least_cosine"), F.count(F.lit(1)).alias("topics")))


@query()
def topic_factors(spark: SparkSession, d: str) -> DataFrame:
    """Non-negative factorisation of the documents' TF-IDF table: leading terms per topic."""
    _, h = models.nmf(_topic_weights(spark, d), "doc_id", "word", "tfidf")
    return rounded(ranking.first_n(h.withColumn("_h", F.lpad(F.conv(F.format_string("%.0f", (1e9 - F.col("weight") * 1e6)), 10, 16), 10, "0")), ["topic"], [F.col("_h"), F.col("word")], 18).drop("_h"))


# ------------------------------------------------------------------ presentation and small functions


@query(S("SELECT section, " + ", ".join(f"round(max(f1) FILTER (WHERE gender = '{g}'), 6) AS \"{g}\"" for g in ("F", "M", "UNKNOWN")) + " FROM (SELECT section, gender, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (SELECT section, gender, count(*) FILTER (WHERE authority AND quoted)::DOUBLE AS tp, count(*) FILTER (WHERE NOT authority AND quoted) AS fp, count(*) FILTER (WHERE authority AND NOT quoted) AS fn FROM frame GROUP BY 1, 2)) GROUP BY 1"))
def pivot_f1(spark: SparkSession, d: str) -> DataFrame:
    r = agreement.weighted_prf(frame(spark, d), F.col("r_AUTHORITY"), F.col("quoted"), keys=["section", "gender"])
    return rounded(r.groupBy("section").pivot("gender", ["F", "M", "UNKNOWN"]).agg(F.max("f1")))


@query(
    """WITH p AS (SELECT topic, CASE WHEN year <= 1915 THEN '1900-15' WHEN year <= 1930 THEN '1918-30' WHEN year <= 1945 THEN '1933-45' ELSE '1948-63' END AS period FROM article_topics WHERE year > 1899 AND year <= 1963),
c AS (SELECT label, count(*) FILTER (WHERE period = '1900-15') AS a, count(*) FILTER (WHERE period = '1918-30') AS b, count(*) FILTER (WHERE period = '1933-45') AS e, count(*) FILTER (WHERE period = '1948-63') AS f, count(*) AS n FROM p JOIN topic_labels USING (topic) GROUP BY 1)
SELECT label, a AS "1900-15", b AS "1918-30", e AS "1933-45", f AS "1948-63", row_number() OVER (ORDER BY n DESC, label) AS place FROM c"""
)
def pivot_topic_period(spark: SparkSession, d: str) -> DataFrame:
    """Articles per topic and period, topics in order of their total."""
    names = [p[2] for p in V.PERIODS]
    t = topics(spark, d).withColumn("period", V.period(F.col("year"))).where("period is not null").join(F.broadcast(table(spark, d, "topic_labels").select("topic", "label")), "topic")  # 19 labels
    p = t.groupBy("label").pivot("period", names).count().na.fill(0)
    total = sum((F.col(f"`{n}`") for n in names), F.lit(0))
    return p.withColumn("place", F.row_number().over(Window.orderBy(total.desc(), "label")).cast("long"))


@query(S("SELECT year, printf('%.1f%%', share * 100) AS pct, printf('%+.2f', share - 0.5) AS diff, printf('[%.2f, %.2f]', share - 0.1, share + 0.1) AS ci, CASE WHEN share - 0.5 > 0 THEN 'up' WHEN share - 0.49 < 0 THEN 'down' ELSE 'none' END AS direction FROM (SELECT year, round(avg(f), 6) AS share FROM frame WHERE f IS NOT NULL GROUP BY 1)"))
def formatted_shares(spark: SparkSession, d: str) -> DataFrame:
    y = frame(spark, d).where("f is not null").groupBy("year").agg(F.round(F.avg("f"), 6).alias("share"))
    s = F.col("share")
    return y.select("year", T.percent(s).alias("pct"), T.signed(s - 0.5).alias("diff"), T.interval(s - 0.1, s + 0.1).alias("ci"), T.trend_direction(s - 0.5, s - 0.49).alias("direction"))


@query("SELECT vec_id, " + ", ".join(f"embedding[{i}] >= 0.3::FLOAT AS over_{i}" for i in (1, 2, 3)) + ", greatest(embedding[1], embedding[2], embedding[3]) >= 0.5::FLOAT AS any_over FROM embeddings")
def threshold_flags(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    p = [F.col("embedding")[i] for i in range(3)]
    return e.select("vec_id", *[V.over(x, 0.3).alias(f"over_{i + 1}") for i, x in enumerate(p)], V.over(F.greatest(*p), 0.5).alias("any_over"))


@query("SELECT event_id, substring(sha256(props), 1, 16) AS h FROM events")
def prompt_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.prompt_hash(F.col("props")).alias("h"))


@query("SELECT a.article_id, a.topic AS topic_1, b.topic AS topic_2, a.topic = b.topic AS same FROM (SELECT article_id, min(topic) AS topic FROM article_topics GROUP BY 1) a JOIN (SELECT article_id, max(topic) AS topic FROM article_topics GROUP BY 1) b USING (article_id)")
def annotation_passes(spark: SparkSession, d: str) -> DataFrame:
    """Two passes over the same items joined with suffixes."""
    one = topics(spark, d).groupBy("article_id").agg(F.min("topic").alias("topic_1"))
    two = topics(spark, d).groupBy("article_id").agg(F.max("topic").alias("topic_2"))
    return one.join(two, "article_id").withColumn("same", F.col("topic_1") == F.col("topic_2"))


@query("SELECT event_id::INT AS n, CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsure' END AS is_person, CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'UNKNOWN' END AS gender_text, CASE event_type WHEN 'click' THEN 'ARTS_SPORTS,CIVIC' WHEN 'view' THEN 'CIVIC' ELSE '' END AS roles, 1 + event_id::INT % 3 AS confidence, 'a|b' AS notes FROM events")
def compact_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label lines written from events and parsed again."""
    i = F.col("event_id")
    letters = F.when(F.col("event_type") == "click", "CA").when(F.col("event_type") == "view", "C").otherwise("-")
    line = F.concat_ws("|", i, F.when(i % 3 == 0, "y").when(i % 3 == 1, "n").otherwise("u"), F.when(i % 2 == 0, "F").otherwise("U"), letters, F.lit("n"), 1 + i % 3, F.lit("a|b"))
    r = parse_labels(table(spark, d, "events").select(line.alias("value")), F.col("value"), {"A": "ARTS_SPORTS", "C": "CIVIC"})
    return r.select("n", "is_person", "gender_text", F.array_join("roles", ",").alias("roles"), "confidence", "notes")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_extendedprice / l_discount, 5) END AS ratio FROM lineitem")
def cleaned_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Ratios whose infinities and NaN become null, rounded as results are exported."""
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / F.nullif("l_discount", F.lit(0.0)))
    return clean_numbers(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ratio.alias("ratio")))


@query("SELECT article_id, CASE WHEN year BETWEEN 1900 AND 1919 THEN 'early' WHEN year BETWEEN 1920 AND 1945 THEN 'middle' ELSE 'other' END AS period, coalesce(legibility = 'Legible' AND n_words >= 100, false) AS clean, round(least(n_chars, 400) / greatest(n_chars, 1), 4) AS rel_pos FROM (SELECT article_id, min(year) AS year, min(legibility) AS legibility, min(n_words) AS n_words, min(length(text)) AS n_chars FROM articles GROUP BY 1)")
def article_values(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "articles").groupBy("article_id").agg(F.min("year").alias("year"), F.min("legibility").alias("legibility"), F.min("n_words").alias("n_words"), F.min(F.length("text")).alias("n_chars"))
    return a.select("article_id", V.period_of(F.col("year"), [(1900, 1919, "early"), (1920, 1945, "middle")]).alias("period"), V.ocr_clean(F.col("legibility"), F.col("n_words"), 100).alias("clean"), V.relative_position(F.least(F.col("n_chars"), F.lit(400)), F.col("n_chars")).alias("rel_pos"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(headline), '\\s+')) AS word FROM (SELECT DISTINCT article_id, headline FROM articles)) WHERE regexp_full_match(word, '\\p{L}+') AND word NOT IN ('of', 'the', 'in', 'at', 'for') GROUP BY 1")
def headline_words(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "articles").select("article_id", "headline").distinct().select(F.explode(F.split(F.lower("headline"), r"\s+")).alias("word"))
    return h.where(T.content_word(F.col("word"), ["of", "the", "in", "at", "for"])).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(S("SELECT role, year, n, round(share, 6) AS share, round(share * n)::BIGINT AS n_positive FROM (SELECT role, year, count(*) AS n, avg(f) AS share FROM frame WHERE f IS NOT NULL GROUP BY 1, 2) WHERE n >= 30"))
def role_series(spark: SparkSession, d: str) -> DataFrame:
    """Series behind the roles page: groups of at least 30."""
    y = frame(spark, d).where("f is not null").groupBy("role", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("share")).where("n >= 30")
    return rounded(y.withColumn("n_positive", V.n_positive(F.col("share"), F.col("n"))))


@query(S("SELECT section, round(sum(u * n) / sum(n), 6) AS unknown_mean, sum(n)::BIGINT AS n FROM (SELECT section, year, count(*) AS n, avg((gender = 'UNKNOWN')::INT) AS u FROM frame GROUP BY 1, 2) GROUP BY 1"))
def unknown_mean(spark: SparkSession, d: str) -> DataFrame:
    """Unknown share per section, weighted by the size of each year."""
    y = frame(spark, d).groupBy("section", "year").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gender") == "UNKNOWN").cast("int")).alias("u"))
    return rounded(y.groupBy("section").agg((F.sum(F.col("u") * F.col("n")) / F.sum("n")).alias("unknown_mean"), F.sum("n").alias("n")))


@query(S("SELECT section, count(*) FILTER (WHERE s > 0) AS n_positive, count(*) AS n, round(list_sort(list(s))[count(*) // 2 + 1], 6) AS middle FROM (SELECT section, publication, avg(f) - 0.5 AS s FROM frame GROUP BY 1, 2) GROUP BY 1"))
def specification_strip(spark: SparkSession, d: str) -> DataFrame:
    """Positive cells of each strip, and its middle cell (the upper one of two)."""
    c = frame(spark, d).groupBy("section", "publication").agg((F.avg("f") - 0.5).alias("s"))
    middle = F.element_at(F.array_sort(F.collect_list("s")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int"))  # at most one value per newspaper
    return rounded(c.groupBy("section").agg(F.count_if(F.col("s") > 0).alias("n_positive"), F.count(F.lit(1)).alias("n"), middle.alias("middle")))


@query("SELECT count(DISTINCT sha1(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' '))) AS n FROM articles")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Articles of a stream without repeated token sequences."""
    s = streams.file_stream(spark, f"{d}/articles.parquet*", table(spark, d, "articles"))
    return streams.collected(streams.deduplicated_stream(s.select("article_id", "text", "arrived_at")).select("article_id")).agg(F.count(F.lit(1)).alias("n"))
