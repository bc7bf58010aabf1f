"""Adapters that give the generic operators the tables of a data directory.

``frame`` plays the entity frame on the star schema: an order is an article, a line item an entity, the return flag the
gender signal, the customer's nation the newspaper, the market segment the section, the order priority the page band,
the part type the role. ``ARTICLES`` and the others are the article archive itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import values as V
from broadsheet.runtime import table

#: Part types as roles, and those that count as authority.
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
TOP = ["ECONOMY", "PROMO"]
CENTRE, EARLY, LATE = 1998, (1995, 1997), (1999, 2001)


def frame(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    orders = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("page_band"))
    people = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("publication"), F.col("c_mktsegment").alias("section"))  # 25 nations
    parts = t("part").select("p_partkey", F.col("p_type").alias("role"), "p_size")
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    f = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    gender = F.when(F.col("l_returnflag") == "A", "F").when(F.col("l_returnflag") == "R", "M").otherwise("UNKNOWN")
    return f.select(
        F.col("l_orderkey").alias("article_id"), "year", "publication", "section", "page_band", "role", gender.alias("gender"), V.is_f(gender).alias("f"), F.col("l_quantity").alias("weight"),
        (F.col("l_linestatus") == "O").alias("quoted"), (F.col("l_tax") < 0.05).alias("ocr_clean"), (F.col("l_discount") > 0.085).alias("near_dup"), (F.col("p_size") <= 40).alias("in_cap"),
        (F.col("section") != "BUILDING").alias("is_news"), (F.col("publication") == "FRANCE").alias("evening_star"), (F.col("l_quantity") > 2).alias("ner_ok"), *[(F.col("role") == r).alias(f"r_{r}") for r in TYPES],
        F.col("role").isin(TOP).alias("r_AUTHORITY"),
    )


#: The same frame for the oracle.
FRAME_SQL = """frame AS (
SELECT l_orderkey AS article_id, year(o_orderdate)::INTEGER AS year, n_name AS publication, c_mktsegment AS section, o_orderpriority AS page_band, p_type AS role,
 CASE l_returnflag WHEN 'A' THEN 'F' WHEN 'R' THEN 'M' ELSE 'UNKNOWN' END AS gender, CASE l_returnflag WHEN 'A' THEN 1.0::DOUBLE WHEN 'R' THEN 0.0::DOUBLE END AS f, l_quantity AS weight,
 l_linestatus = 'O' AS quoted, l_tax < 0.05 AS ocr_clean, l_discount > 0.085 AS near_dup, p_size <= 40 AS in_cap, c_mktsegment <> 'BUILDING' AS is_news, n_name = 'FRANCE' AS evening_star,
 l_quantity > 2 AS ner_ok, p_type IN ('ECONOMY', 'PROMO') AS authority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""

CONTENT = ["article_id", "publication", "publication_raw", "lccn", "state", "date", "year", "page_number", "edition", "headline", "byline", "text", "n_chars", "n_words", "legibility", "scan_url", "scan_id", "license", "processing_version"]


def articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct articles on the given content columns (repeated deliveries differ in load columns only)."""
    return table(spark, d, "articles").select(*columns).distinct()


def topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_topics")
