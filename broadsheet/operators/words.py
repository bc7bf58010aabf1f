"""Word statistics: counts, log-odds with a Dirichlet prior, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.runtime import lookup_join, with_row


def word_rows(df: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(words).alias("word"))


def word_counts(df: DataFrame, words: Column, keys: list[str]) -> DataFrame:
    """(keys, word, n): bag counts, repeats included; counted map-side."""
    return word_rows(df, words, keys).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def log_odds(counts: DataFrame, a: str, b: str, stratum: list[str] | None = None, alpha0: float = 1000.0) -> DataFrame:
    """counts(stratum, word, a, b) -> (stratum, word, n_a, n_b, delta, var, z): log-odds of a against b with an informative
    Dirichlet prior from the pooled counts. Totals come from a small aggregate joined back, not from a window over words."""
    st = stratum or []
    c = counts.select(*st, "word", F.coalesce(F.col(a), F.lit(0)).cast("double").alias("n_a"), F.coalesce(F.col(b), F.lit(0)).cast("double").alias("n_b"))
    agg = c.groupBy(*st) if st else c.groupBy()
    tot = agg.agg(F.sum("n_a").alias("ta"), F.sum("n_b").alias("tb"), F.sum(F.expr("n_a + n_b + 0.01D")).alias("tp"))
    d = lookup_join(c, tot, st) if st else with_row(c, tot)
    d = d.withColumn("al", F.lit(alpha0) * F.expr("(n_a + n_b + 0.01D) / tp"))
    side = lambda n, t: F.log((F.col(n) + F.col("al")) / (F.col(t) + alpha0 - F.col(n) - F.col("al")))
    d = d.withColumn("delta", side("n_a", "ta") - side("n_b", "tb")).withColumn("var", F.expr("1/(n_a + al) + 1/(n_b + al)"))
    return d.select(*st, "word", "n_a", "n_b", "delta", "var", (F.col("delta") / F.sqrt("var")).alias("z"))


def pooled_log_odds(counts: DataFrame, a: str, b: str, stratum: str, min_total: int = 200, min_count: int = 25, alpha0: float = 1000.0) -> DataFrame:
    """(word, n, delta, z): inverse-variance pooled log-odds over strata. Strata in which either side has fewer than
    ``min_total`` words are left out, then words with fewer than ``min_count`` uses."""
    tot = counts.groupBy(stratum).agg(F.sum(a).alias("_ta"), F.sum(b).alias("_tb")).where((F.col("_ta") >= min_total) & (F.col("_tb") >= min_total))
    lo = log_odds(counts.join(F.broadcast(tot.select(stratum)), stratum, "left_semi"), a, b, [stratum], alpha0)
    g = lo.groupBy("word").agg(F.sum(F.expr("n_a + n_b")).alias("n"), F.sum(F.expr("1/var")).alias("w"), F.sum(F.expr("delta/var")).alias("dw"))
    return g.where(F.col("n") >= min_count).select("word", "n", F.expr("dw / w").alias("delta"), F.expr("dw / w * sqrt(w)").alias("z"))


def tfidf(df: DataFrame, key: str, words: Column, max_terms: int = 25_000, min_df: int = 15, max_df: float = 0.35, stop: list[str] | None = None) -> DataFrame:
    """(key, word, tfidf): sublinear term frequency times smooth inverse document frequency, unit length per document.
    Words of ``stop`` are no terms, whatever their case in the list.
    Terms in fewer than ``min_df`` documents or more than the share ``max_df`` are left out; the ``max_terms`` most frequent stay."""
    tf = word_counts(df, words, [key])
    if stop:
        tf = tf.where(~F.col("word").isin(sorted({w.lower() for w in stop})))
    n = df.select(key).distinct().agg(F.count(F.lit(1)).alias("N"))
    dfs = with_row(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")), n)
    terms = dfs.where((F.col("df") >= min_df) & (F.col("df") <= F.col("N") * max_df)).orderBy(F.desc("total"), "word").limit(max_terms)
    terms = terms.select("word", F.expr("ln((1 + N) / (1 + df)) + 1").alias("idf"))
    d = tf.join(F.broadcast(terms), "word").withColumn("w", F.expr("(1 + ln(n)) * idf"))  # at most max_terms rows
    norm = d.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l2"))
    return d.join(norm, key).select(key, "word", (F.col("w") / F.col("l2")).alias("tfidf"))


def top_words(df: DataFrame, keys: list[str], z: str = "z", k: int = 20) -> DataFrame:
    """The k lowest and the k highest words per key, with side and rank."""
    rank = lambda o: F.row_number().over(Window.partitionBy(*keys).orderBy(o, "word"))
    low = df.withColumn("rank", rank(F.col(z))).where(F.col("rank") <= k).withColumn("side", F.lit("low"))
    high = df.withColumn("rank", rank(F.col(z).desc())).where(F.col("rank") <= k).withColumn("side", F.lit("high"))
    return low.unionByName(high)
