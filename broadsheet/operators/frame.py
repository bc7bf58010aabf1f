"""The analysis frame: entities joined with article and topic attributes, and derived flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import values as V
from broadsheet.runtime import lookup_join


def with_topic(df: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds label, section and is_news of a topic; without one: 'unassigned', 'OTHER', true."""
    d = lookup_join(df, topics.select(topic, F.col("label").alias("topic_label"), "section", "is_news"), [topic])
    return d.withColumns({"topic_label": F.coalesce("topic_label", F.lit("unassigned")), "section": F.coalesce("section", F.lit("OTHER")), "is_news": F.coalesce("is_news", F.lit(True))})


def star_join(entities: DataFrame, meta: DataFrame, topics: DataFrame, topic_dim: DataFrame, key: str = "article_id") -> DataFrame:
    """Entities with the columns of their article and topic; columns an entity already has are not repeated."""
    fresh = lambda d, have: d.select(key, *[c for c in d.columns if c not in have])
    d = entities.join(fresh(meta, entities.columns), key, "left")
    return with_topic(d.join(fresh(topics, d.columns), key, "left"), topic_dim)


def derive(df: DataFrame, star: str = "evening star") -> DataFrame:
    """Frame columns from gender tiers, titles, roles_a/roles_b, page_number, year, legibility, dict_rate, publication and
    counts of quotes: f_* outcomes with and without the mixed-title rule, role flags, bands, bins and flags."""
    tiers = ("h", "hp", "hpn")
    return df.withColumns(
        {f"f_{t}_v2": V.is_f(F.col(f"gender_{t}")) for t in tiers}
        | {f"f_{t}": V.is_f(V.mixed_title_gender(F.col(f"gender_{t}"), F.col("titles"))) for t in tiers}
        | {
            "mixed_title": V.mixed_title(F.col("titles")), "page_band": V.page_band(F.col("page_number")), "period": V.period(F.col("year")), "bin5": V.floor_bin(F.col("year"), 5),
            "decade": V.floor_bin(F.col("year"), 10), "ner_ok": F.coalesce(F.col("n_ner_mentions") > 0, F.lit(False)), "ocr_clean": V.ocr_clean(F.col("legibility"), F.col("dict_rate")),
            "evening_star": F.coalesce(F.col("publication") == star, F.lit(False)), "quoted_name": F.coalesce(F.col("n_quotes_name") > 0, F.lit(False)),
            "quoted_any": F.coalesce(F.col("n_quotes_name") + F.col("n_quotes_pron") > 0, F.lit(False)),
        }
    ).select("*", *V.role_flags(F.col("roles_a"), "A"), *V.role_flags(F.col("roles_b"), "B"))


def named_samples(df: DataFrame) -> DataFrame:
    """Each row once per named subset it belongs to, in column ``sample``: all, excl_evening_star, news_only, pre_1922, post_1923."""
    kinds = {"all": F.lit(True), "excl_evening_star": ~F.col("evening_star"), "news_only": F.col("is_news"), "pre_1922": F.col("year") <= 1921, "post_1923": F.col("year") >= 1924}
    return df.withColumn("sample", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull())))


def disagreement(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows on which the methods' flags differ."""
    return df.where(F.size(F.array_distinct(F.array(*flags))) > 1)


def not_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the other table (for audits and resumed work)."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def assert_covered(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df``, or an error if a key of it is missing in the other table."""
    missing = not_in(df, other, key).limit(5).collect()
    if missing:
        raise ValueError(f"{key} not covered: {[r[key] for r in missing]}")
    return df
