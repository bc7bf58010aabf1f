"""Exact and near duplicates within groups, by exact methods only.

Near duplicates: texts of which too many shingles stand in no other text of the group are put aside. Shingles of the rest are
ordered from rare to frequent within the group; two sets of similarity t must share one of the first n - ceil(t n) + 1
shingles, so an equality join on these prefixes yields every candidate, a length filter removes most, and the similarity is
then computed exactly. Exact copies are collapsed before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.text import exact_key, once, tokens
from broadsheet.runtime import BROADCAST_BYTES, BROADCAST_ROWS, cut, null_safe_join, release

#: What keeps a product of a threshold that is whole but for rounding from being taken for more.
_SLACK = 1e-9


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each connected component of edges(a, b); pointer jumping on written tables until nothing
    moves. Labels only fall, so it ends."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        step = step.join(labels.select(F.col("node").alias("new"), F.col("label").alias("far")), "new", "left")
        step = cut(step.select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            return labels


def exact_groups(df: DataFrame, key: str, text: str, within: str | None = None) -> DataFrame:
    """(key, group, size): texts with the same tokens within ``within``; the group is its smallest key. Sizes are counted
    before the join back, so a hot text is no hot window."""
    d = df.select(key, *([within] if within else []), exact_key(F.col(text)).alias("_k"))
    on = ["_k", *([within] if within else [])]
    g = d.groupBy(*on).agg(F.min(key).alias("group"), F.count(F.lit(1)).alias("size"))
    return null_safe_join(d, g, on).select(key, "group", "size")


def _shingle_hashes(t: Column, k: int) -> Column:
    """Distinct hashes of the k-grams of an array of tokens; fewer than k tokens have one of all of them, none have none. Tokens
    are hashed first, so that no k-gram is built as a string."""

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    short = F.array(F.xxhash64(F.array_join(t, " ")))
    return F.array_distinct(F.when(F.size(t) == 0, F.array().cast("array<bigint>")).when(F.size(t) < k, short).otherwise(once(F.transform(t, lambda w: F.xxhash64(w)), grams)))


def _sets(df: DataFrame, key: str, text: str, within: str, k: int) -> DataFrame:
    """(id, g, n, s): the shingles of every text that has some and a group."""
    t = df.where(F.col(within).isNotNull()).select(F.col(key).alias("id"), F.col(within).alias("g"), tokens(F.col(text)).alias("t"))
    return t.where(F.size("t") > 0).select("id", "g", _shingle_hashes(F.col("t"), k).alias("s")).select("id", "g", F.size("s").alias("n"), "s")


def _able(df: DataFrame, key: str, text: str, within: str, threshold: float, k: int) -> DataFrame:
    """(key) of the texts that can have a partner, written once. At most n - ``threshold`` n shingles are missing in a partner, so no
    more of any that are chosen by their hash (here three of four, to move fewer) may stand in no other text of the group;
    forty bits of a hash are enough to tell that one stands in no other. Of the others only the keys are read again."""
    sets = _sets(df, key, text, within, k).select(F.xxhash64("id").alias("doc"), "g", "n", F.explode(F.filter("s", lambda h: F.pmod(h, F.lit(4)) > 0)).alias("h"))
    rows = sets.select("doc", "g", "n", F.shiftrightunsigned("h", 24).alias("h"))
    alone = rows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("df"), F.min("doc").alias("doc"), F.min("n").alias("n")).where("df = 1")
    lone = alone.groupBy("doc", "g").agg(F.count(F.lit(1)).alias("u"), F.min("n").alias("n")).where(F.col("u") > F.col("n") - threshold * F.col("n") + _SLACK)
    ids = df.select(key, F.xxhash64(key).alias("doc"), F.col(within).alias("g")).where(F.col("g").isNotNull())
    return cut(ids.join(lone.select("doc", "g"), ["doc", "g"], "left_anti").select(key))


def _paired(df: DataFrame, key: str, text: str, within: str, threshold: float, k: int, among: DataFrame | None = None) -> DataFrame:
    """(id, g, doc, n, s), written once: the sets that can have a partner, of the texts whose key is ``among`` the given ones. Their
    texts are read again, for the shingles of all would take more room than the texts."""
    ids = _able(df if among is None else df.join(among, key, "left_semi"), key, text, within, threshold, k)
    release(df.sparkSession)
    few = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0)).alias("b")).first()
    few = few.n <= BROADCAST_ROWS and few.b <= BROADCAST_BYTES
    kept = cut(_sets(df.join(F.broadcast(ids) if few else ids, key, "left_semi"), key, text, within, k).withColumn("doc", F.monotonically_increasing_id()))
    release(df.sparkSession)
    return kept


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs among the sets of ``_paired``."""
    w = Window.partitionBy("doc")  # a window per document
    shared = sets.select("doc", "g", "n", F.explode("s").alias("h")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("g", "h"))).where("df > 1")
    # shingles of one set alone come first in its order and lead to no pair: they are counted, not ranked
    place = F.col("n") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("df", "h"))
    prefix = cut(shared.withColumn("r", place).where(F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n") - _SLACK) + 1).select("doc", "g", "n", "h"))
    release(sets.sparkSession)
    right = prefix.select(F.col("doc").alias("e"), "g", F.col("n").alias("m"), "h")
    cand = prefix.join(right, ["g", "h"]).where((F.col("doc") < F.col("e")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - _SLACK)).select("doc", "e").distinct()
    x, y = sets.select("doc", F.col("id").alias("x"), F.col("s").alias("sx")), sets.select(F.col("doc").alias("e"), F.col("id").alias("y"), F.col("s").alias("sy"))
    same = F.size(F.array_intersect("sx", "sy"))
    sim = F.try_divide(same.cast("double"), F.size("sx") + F.size("sy") - same)
    return cand.join(x, "doc").join(y, "e").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), sim.alias("similarity")).where(F.col("similarity") >= threshold)


def similar_pairs(df: DataFrame, key: str, text: str, within: str, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """(a, b, similarity), a < b: all pairs within ``within`` with a Jaccard similarity of at least ``threshold``. Texts without
    tokens and rows with a null ``within`` have no pairs. Keys must be unique."""
    return _verified(_paired(df, key, text, within, threshold, k), threshold)


def near_groups(df: DataFrame, key: str, text: str, within: str, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """(key, exact_group, near_group): connected components of verified pairs between exact groups, smallest keys as names.
    Texts without tokens and rows with a null ``within`` are near to none."""
    d = cut(df.select(F.col(key).alias("id"), F.col(within).alias("g"), exact_key(F.col(text)).alias("_k")))
    exact = cut(null_safe_join(d, d.groupBy("g", "_k").agg(F.min("id").alias("group")), ["g", "_k"]).select("id", "group", (F.col("g").isNotNull() & (F.col("_k") != F.sha1(F.lit("")))).alias("some")))
    release(df.sparkSession)
    reps = exact.where("id = group and some").select(F.col("id").alias(key))
    labels = components(_verified(_paired(df, key, text, within, threshold, k, reps), threshold))
    near = F.when(F.col("some"), F.coalesce("label", "group")).otherwise(F.col("id"))
    return exact.join(labels, exact["group"] == labels["node"], "left").select(F.col("id").alias(key), F.col("group").alias("exact_group"), near.alias("near_group"))


def dup_flags(df: DataFrame, group: str, order: list[Column], kind: str) -> DataFrame:
    """Adds {kind}_size and {kind}_dup: every member of a group but the first by ``order`` is a duplicate. The first is found by
    aggregation, not by sorting the group."""
    first = df.groupBy(group).agg(F.min(F.struct(*order)).alias("_f"), F.count(F.lit(1)).alias(f"{kind}_size"))
    return df.join(first, group).withColumn(f"{kind}_dup", F.struct(*order) > F.col("_f")).drop("_f")
