"""Cap the records of dominant contributors, keeping the best by a quality score.

An incremental state table holds each contributor's kept records; its cutoff is the order key of the last
record that still fits. A new batch is first filtered against the cutoffs (most records of a full contributor
end there), the rest joins the kept lists, new cutoffs are found for the contributors that overflow, and displaced records
are logged. The state is saved to and loaded from a folder, so the next delivery may be another run. A record is written
once when it is kept and once when it is displaced; no batch rewrites the lists.
A contributor is never gathered in one task: positions come from a range-sorted table whose partitions
split a hot contributor, and only one row per (partition, contributor) is aggregated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.llm.titles import known_newspapers, match_titles, norm_lccn
from broadsheet.runtime import cut, lookup_join, sorted_parts


@dataclass
class CapState:
    """log(contributor, score, id): records as they were kept, batch by batch; cutoffs(contributor, cut_score, cut_id) of the
    contributors that overflowed, by which records of the log no longer count; sizes(contributor, n) of the kept lists;
    displaced(contributor, id)."""

    log: DataFrame | None = None
    cutoffs: DataFrame | None = None
    sizes: DataFrame | None = None
    displaced: DataFrame | None = None

    @property
    def kept(self) -> DataFrame:
        """(contributor, score, id): the records within the caps."""
        return self.log if self.cutoffs is None else _within(self.log, self.cutoffs)

    def save(self, path: str) -> None:
        """Write the state as four parquet tables; the log is written without the records that no longer count."""
        for name, rows in (("log", self.kept), ("cutoffs", self.cutoffs), ("sizes", self.sizes), ("displaced", self.displaced)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CapState:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("log", "cutoffs", "sizes", "displaced")])


def cutoffs(rows: DataFrame, cap: int) -> DataFrame:
    """(contributor, cut_score, cut_id): the key of the cap-th record of every contributor with more than
    ``cap`` records (a cap of 0 gives a cutoff before every record)."""
    if cap <= 0:
        return rows.groupBy("contributor").agg((F.min("score") - 1).alias("cut_score"), F.lit("").alias("cut_id"))
    parts = sorted_parts(rows.select("contributor", "score", "id"), [F.col("contributor"), F.col("score"), F.col("id")])
    runs = parts.groupBy("contributor", "_pid").agg(F.min("_idx").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("contributor").orderBy("_pid")
    runs = runs.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("contributor")))
    at = runs.where((F.col("total") > cap) & (F.col("before") < cap) & (F.col("before") + F.col("n") >= cap))
    at = at.select("contributor", "_pid", (F.col("first") + F.lit(cap - 1) - F.col("before")).alias("_idx"))
    return parts.join(at, ["contributor", "_pid", "_idx"], "left_semi").select("contributor", F.col("score").alias("cut_score"), F.col("id").alias("cut_id"))


def _beyond() -> Column:
    return F.col("cut_score").isNotNull() & ((F.col("score") > F.col("cut_score")) | ((F.col("score") == F.col("cut_score")) & (F.col("id") > F.col("cut_id"))))


def _within(rows: DataFrame, cut_at: DataFrame) -> DataFrame:
    return lookup_join(rows, cut_at, ["contributor"]).where(~_beyond()).select("contributor", "score", "id")


def update(state: CapState, batch: DataFrame, cap: int) -> CapState:
    """Merge a batch(contributor, score, id) of new records into the state. A smaller score is better, then the
    smaller id; a null score is the worst. Ids must be unique over all batches, rows without an id are left out; a null
    contributor is never capped and passes through."""
    batch = batch.where("id is not null").select("contributor", F.coalesce(F.col("score").cast("double"), F.lit(float("inf"))).alias("score"), "id")
    out = []
    if state.cutoffs is not None:
        marked = cut(lookup_join(batch, state.cutoffs, ["contributor"]).select("contributor", "score", "id", _beyond().alias("_out")))
        out.append(marked.where("_out").select("contributor", "id"))
        fresh = marked.where("not _out").drop("_out")
    else:
        fresh = cut(batch)
    log = fresh if state.log is None else state.log.unionByName(fresh)
    came = fresh.where("contributor is not null").groupBy("contributor").agg(F.count(F.lit(1)).alias("came"))
    sizes = came.withColumn("n", F.lit(0).cast("long")) if state.sizes is None else state.sizes.join(came, "contributor", "full_outer")
    sizes = cut(sizes.select("contributor", (F.coalesce("n", F.lit(0)) + F.coalesce("came", F.lit(0))).alias("n"), F.coalesce("came", F.lit(0)).alias("came")))
    # only contributors that overflow now are sorted; their records before this batch are those within the old cutoffs
    over = sizes.where((F.col("n") > cap) & (F.col("came") > 0)).select("contributor")
    live = lookup_join(log, over, ["contributor"], "left_semi")
    live = cut(live if state.cutoffs is None else _within(live, state.cutoffs))
    new = cut(cutoffs(live, cap))
    out.append(lookup_join(live, new, ["contributor"]).where(_beyond()).select("contributor", "id"))
    gone = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    gone = cut(gone)
    kept_on = new if state.cutoffs is None else cut(new.unionByName(state.cutoffs.join(new, "contributor", "left_anti")))
    return CapState(log, kept_on, sizes.select("contributor", F.least("n", F.lit(max(cap, 0))).alias("n")), gone if state.displaced is None else state.displaced.unionByName(gone))


def cap_contributors(rows: DataFrame, cap: int, batches: int = 3, state: CapState | None = None) -> CapState:
    """Run all batches of rows(contributor, score, id, piece) through the state table. Pieces go in order into
    ``batches`` runs of about equal size; a null piece counts as the first. Empty input gives empty tables. ``state`` is
    that of an earlier run with the same cap."""
    rows = rows.withColumn("piece", F.coalesce(F.col("piece").cast("long"), F.lit(-(2**62))))
    edges = rows.agg(F.percentile_approx("piece", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(edges or [])), None]
    state = state or CapState()
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = rows if lo is None else rows.where(F.col("piece") > lo)
        state = update(state, part if hi is None else part.where(F.col("piece") <= hi), cap)
    return state


#: Order of the legibility classes.
LEGIBILITY_RANK = {"legible": 0, "questionable": 1}


def legibility_score(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x == "legible", 0).when(x == "questionable", 1).otherwise(2)


def newspaper_records(articles: DataFrame, title_list: DataFrame) -> DataFrame:
    """One row per distinct article_id: (contributor, score, id, piece). The contributor is the lccn without its
    spelling variants; an article without one takes the lccn of the newspaper its title means, else null
    (a title that means no newspaper is not capped). Null article_ids are left out."""
    best = F.struct(F.col("arrived_at"), F.col("piece_no"), norm_lccn(F.col("lccn")).alias("lccn"), F.coalesce("publication_raw", "publication").alias("raw"), "legibility")
    one = articles.where("article_id is not null").groupBy("article_id").agg(F.min(best).alias("x"), F.max(norm_lccn(F.col("lccn"))).alias("any_lccn"))
    one = cut(one.select(F.col("article_id").alias("id"), F.coalesce("x.lccn", "any_lccn").alias("lccn"), F.col("x.raw").alias("raw"), F.col("x.piece_no").alias("piece"), legibility_score(F.col("x.legibility")).alias("score")))
    bare = one.where("lccn is null and raw is not null").select("raw").distinct()
    canon = cut(known_newspapers(articles, title_list))
    named = match_titles(bare, canon).join(canon.where("lccn is not null").groupBy("publication").agg(F.min("lccn").alias("own")), "publication", "left")
    named = cut(named.select("raw", F.coalesce("own", "publication").alias("own")).where("own is not null"))
    return lookup_join(one, named, ["raw"]).select(F.coalesce("lccn", "own").alias("contributor"), "score", "id", "piece")


def capped_newspapers(articles: DataFrame, title_list: DataFrame, share: float = 0.03, batches: int = 3) -> CapState:
    """Cap every newspaper at ``share`` of the number of distinct article_ids, rounded down."""
    records = cut(newspaper_records(articles, title_list))
    cap = int(records.count() * share + 1e-9)
    return cap_contributors(records, cap, batches)
