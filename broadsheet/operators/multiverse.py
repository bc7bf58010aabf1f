"""Specification grids: the frame is aggregated once by year, filter flags and role flags; every cell of the grid is then
a selection and re-aggregation of that small table, and all slopes come from one job."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import panel
from broadsheet.operators.trend import hac_trend

#: The published specification grid.
GRID = {
    "tier": ["h", "hp", "hpn"],
    "population": ["ner", "ner+pattern"],
    "dedup": ["keep", "drop_near"],
    "ocr": ["all", "clean"],
    "papers": ["all", "excl_evening_star", "capped"],
    "bins": ["year", "bin5", "decade"],
    "content": ["all", "news_only"],
    "resolution": ["mixed_unknown", "v2_merge"],
}
WIDTH = {"year": 1, "bin5": 5, "decade": 10}
#: The smaller grid of thresholded methods on the application sample, and that of models with absorbed effects.
METHOD_GRID = {"tier": ["h", "hp"], "population": ["ner"], "dedup": ["keep", "drop_near"], "ocr": ["all", "clean"], "papers": ["all", "excl_evening_star", "capped"], "bins": ["year", "bin5", "decade"], "content": ["all", "news_only"], "resolution": ["mixed_unknown"]}
EFFECT_GRID = {"tier": ["h", "hp", "hpn"], "papers": ["all", "excl_evening_star", "capped"], "ocr": ["all", "clean"]}


def select_spec(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Rows of one specification; flags: ner_ok, near_dup, ocr_clean, evening_star, in_cap, is_news. A null near_dup,
    ocr_clean, evening_star or in_cap is false, a null is_news true, a null ner_ok false."""
    f = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    keep = F.lit(True)
    if spec.get("population", "ner") == "ner":
        keep = keep & f("ner_ok", False)
    if spec.get("dedup") == "drop_near":
        keep = keep & ~f("near_dup", False)
    if spec.get("ocr") == "clean":
        keep = keep & f("ocr_clean", False)
    if spec.get("papers") == "excl_evening_star":
        keep = keep & ~f("evening_star", False)
    if spec.get("papers") == "capped":
        keep = keep & f("in_cap", False)
    if spec.get("content") == "news_only":
        keep = keep & f("is_news", True)
    return df.where(keep)


def grid_table(spark: SparkSession, grid: dict[str, list[str]] = GRID) -> DataFrame:
    names = list(grid)
    return spark.createDataFrame(list(itertools.product(*grid.values())), ", ".join(f"`{n}` string" for n in names))


def compressed(df: DataFrame, outcomes: dict[tuple[str, str], str], estimands: dict[str, Column]) -> DataFrame:
    """(year, six flags, estimand, tier, resolution, k, n): one hash aggregation over the frame. ``outcomes`` maps (tier,
    resolution) to an outcome column with nulls, ``estimands`` a name to the rows it is about."""
    d = df.select(
        "year", F.coalesce("ner_ok", F.lit(False)).alias("f_ner"), F.coalesce("near_dup", F.lit(False)).alias("f_dup"), F.coalesce("ocr_clean", F.lit(False)).alias("f_ocr"),
        F.coalesce("evening_star", F.lit(False)).alias("f_star"), F.coalesce("in_cap", F.lit(False)).alias("f_cap"), F.coalesce("is_news", F.lit(True)).alias("f_news"),
        *[c.alias(f"e_{i}") for i, c in enumerate(estimands.values())], *[F.col(c).alias(f"y_{i}") for i, c in enumerate(outcomes.values())],
    )
    flags = [c for c in d.columns if c.startswith("f_")]
    roles = [c for c in d.columns if c.startswith("e_")]
    m = [x for i in range(len(outcomes)) for x in (F.sum(f"y_{i}").alias(f"k_{i}"), F.count(f"y_{i}").alias(f"n_{i}"))]
    g = d.groupBy("year", *flags, *roles).agg(*m)
    names = F.filter(F.array(*[F.when(F.col(f"e_{i}"), F.lit(e)) for i, e in enumerate(estimands)]), lambda x: x.isNotNull())
    cells = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(r).alias("resolution"), F.col(f"k_{i}").alias("k"), F.col(f"n_{i}").alias("n")) for i, (t, r) in enumerate(outcomes)])
    return g.select("year", *flags, F.explode(names).alias("estimand"), cells.alias("c")).select("year", *flags, "estimand", F.inline("c")).where("n > 0")


def multiverse(df: DataFrame, outcomes: dict[tuple[str, str], str], estimands: dict[str, Column], grid: dict[str, list[str]] = GRID, centre: int = 1930) -> DataFrame:
    """(grid keys, estimand, slope_pp_dec, se, level, n_years, n): the trend of every cell. The grid join multiplies the
    compressed table (years x flag combinations), never the frame."""
    small = compressed(df, outcomes, estimands)
    names = list(grid)
    cells = F.broadcast(grid_table(df.sparkSession, grid))  # one row per specification
    keep = (
        ((F.col("population") == "ner+pattern") | F.col("f_ner")) & ((F.col("dedup") == "keep") | ~F.col("f_dup")) & ((F.col("ocr") == "all") | F.col("f_ocr"))
        & ((F.col("papers") != "excl_evening_star") | ~F.col("f_star")) & ((F.col("papers") != "capped") | F.col("f_cap")) & ((F.col("content") == "all") | F.col("f_news"))
    )
    rows = small.join(cells, ["tier", "resolution"]).where(keep)
    width = F.lit(1)
    for b, w in WIDTH.items():
        width = F.when(F.col("bins") == b, w).otherwise(width)
    g = rows.groupBy(*names, "estimand", F.floor(F.col("year") / width).alias("_bin")).agg(F.sum(F.col("year") * F.col("n")).alias("yn"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    series = g.select(*names, "estimand", F.expr("yn / n").alias("year"), F.expr("k / n").alias("share"), "n")
    keys = [*names, "estimand"]
    yearly = hac_trend(series.where("bins = 'year'"), keys, centre=centre, maxlags=2)
    binned = hac_trend(series.where("bins <> 'year'"), keys, centre=centre, maxlags=1)
    total = series.groupBy(*keys).agg(F.sum("n").alias("n"))
    return yearly.unionByName(binned).join(total, keys)


def effect_cells(df: DataFrame, outcomes: dict[str, str], estimands: dict[str, Column], effects: dict[str, list[str]], grid: dict[str, list[str]] = EFFECT_GRID, cluster: str = "publication", centre: int = 1930) -> DataFrame:
    """(tier, papers, ocr, estimand, adjust, slope_pp_dec, se, ci_lo, ci_hi, p, n, n_clusters): linear models with the absorbed effects of
    each entry of ``effects`` over the primary population. The frame is aggregated once, to cells of (year, clusters, effects,
    flags) that are bounded by ``panel.MAX_CELLS``; every model is solved on its part of them."""
    keys = list(dict.fromkeys(["year", cluster, *(f for fs in effects.values() for f in fs)]))
    flags = {"ocr_clean": False, "evening_star": False, "in_cap": False}
    d = df.where(F.coalesce("ner_ok", F.lit(False))).select(
        *keys, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in flags.items()], *[e.alias(f"e_{i}") for i, e in enumerate(estimands.values())], *[F.col(c).cast("double").alias(f"y_{t}") for t, c in outcomes.items()]
    )
    sums = [x for t in outcomes for x in (F.sum(f"y_{t}").alias(f"wy_{t}"), F.count(f"y_{t}").alias(f"n_{t}"))]
    c = d.groupBy(*keys, *flags, *[f"e_{i}" for i in range(len(estimands))]).agg(*sums).limit(panel.MAX_CELLS + 1).toPandas()
    if len(c) > panel.MAX_CELLS:
        raise ValueError(f"more than {panel.MAX_CELLS} cells; use coarser effects")
    rows = []
    for tier, papers, ocr in itertools.product(*(grid[k] for k in ("tier", "papers", "ocr"))):
        keep = {"all": True, "excl_evening_star": ~c["evening_star"], "capped": c["in_cap"]}[papers] & (c["ocr_clean"] | (ocr == "all"))
        for i, e in enumerate(estimands):
            part = c[keep & c[f"e_{i}"] & (c[f"n_{tier}"] > 0)]
            part = part[keys].assign(w=part[f"n_{tier}"].astype(float), wy=part[f"wy_{tier}"], n=part[f"n_{tier}"])
            part = part.groupby(keys, dropna=False, as_index=False).sum()
            for name, fe in effects.items():
                r = panel.lpm_of_cells(part, fe, cluster, "year", centre=centre)
                rows.append((tier, papers, ocr, e, name, *(r[k] for k in ("slope_pp_dec", "se", "ci_lo", "ci_hi", "p", "n", "n_clusters"))))
    return df.sparkSession.createDataFrame(rows, "tier string, papers string, ocr string, estimand string, adjust string, slope_pp_dec double, se double, ci_lo double, ci_hi double, p double, n long, n_clusters int")


def multiverse_summary(cells: DataFrame, keys: list[str], slope: str = "slope_pp_dec", lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    """Per key: n_cells and share_positive over cells with a slope, share_sig_positive and share_sig_negative over all
    cells, slope_min, slope_median, slope_max, sign_survives_all."""
    s = F.col(slope)
    share = lambda c, whole: F.try_divide(F.count_if(c).cast("double"), whole)
    return cells.groupBy(*keys).agg(
        F.count(s).alias("n_cells"), share(s > 0, F.count(s)).alias("share_positive"), share(F.col(lo) > 0, F.count(F.lit(1))).alias("share_sig_positive"),
        share(F.col(hi) < 0, F.count(F.lit(1))).alias("share_sig_negative"), F.min(s).alias("slope_min"), F.median(s).alias("slope_median"), F.max(s).alias("slope_max"),
        F.coalesce(F.bool_and(s > 0) | F.bool_and(s < 0), F.lit(False)).alias("sign_survives_all"),
    )
