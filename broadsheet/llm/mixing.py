"""Mix sources to target weights.

Quotas: every listed source gets its share of the total, at most ``max_repeats`` times its size; what capped sources
leave is shared among the others in proportion. Records are laid out once per use in a permuted order, cut into
blocks, and the blocks of every source are split exactly among output shards by a multivariate-hypergeometric
tree: a node's left half draws, without replacement, how many blocks of each source it receives. Blocks of a
shard are disjoint ranges of a permuted block order; inside a shard rows are shuffled by a seeded key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.llm.sampling import permute
from broadsheet.llm.tokens import VOCABULARY, token_count
from broadsheet.runtime import cut, sorted_parts


def water_fill(shares: dict[str, float], limits: dict[str, float], total: float) -> dict[str, float]:
    """Sizes per source: proportional to shares, none above its limit, summing to ``total`` or to all limits."""
    live = {s: w for s, w in shares.items() if w > 0 and limits.get(s, 0) > 0}
    out = dict.fromkeys(shares, 0.0)
    left = total
    while live and left > 0:
        weight = sum(live.values())
        full = [s for s, w in live.items() if left * w / weight >= limits[s]]
        if not full:
            out |= {s: left * w / weight for s, w in live.items()}
            break
        for s in full:
            out[s] = limits[s]
            left -= limits[s]
            del live[s]
    return out


def split_blocks(counts: dict[str, int], shards: int, seed: int) -> list[dict[str, int]]:
    """Exact block quotas per shard: a binary tree in which a node's blocks are divided over its halves in proportion to
    their shards, drawing each source's part from a multivariate hypergeometric distribution."""
    names = sorted(counts)
    rng = np.random.default_rng([seed, shards])

    def node(have: np.ndarray, n: int) -> list[dict[str, int]]:
        if n == 1:
            return [dict(zip(names, have.tolist(), strict=True))]
        left = n // 2
        take = rng.multivariate_hypergeometric(have, int(round(have.sum() * left / n)), method="marginals") if have.sum() else have
        return node(take, left) + node(have - take, n - left)

    return node(np.array([counts[s] for s in names], dtype=np.int64), shards)


def mix_sources(docs: DataFrame, targets: DataFrame, total: float | None = None, shards: int = 16, block_docs: int = 64, seed: int = 11, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: (doc_id, source, use, tokens, shard, position), one row per use of a document.
    report: (source, target_share, max_repeats, available_tokens, wanted_tokens, mixed_tokens, reached_share, uses).

    ``total`` is the wanted size in tokens (default: all tokens of the listed sources). A source not on the list or null
    is not used; a listed source without documents gets a report row with zeros; shares are normalised; null or
    negative shares and repeats count as 0; of repeated rows of a source the first by share counts. The last document
    of a quota is used only if that brings the source nearer to it."""
    want = {}
    for r in sorted(targets.select("source", "target_share", "max_repeats").collect(), key=lambda r: (r.source or "", r.target_share or 0)):
        if r.source is not None:
            want.setdefault(r.source, (max(r.target_share or 0.0, 0.0), max(r.max_repeats or 0, 0)))
    listed = docs.where(F.col("source").isin(list(want)))
    sized = cut(listed.select("doc_id", "source", token_count(F.col("text"), path).alias("tokens")).where("tokens > 0"))
    avail = {r.source: (int(r.t), int(r.n)) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    limits = {s: avail.get(s, (0, 0))[0] * m for s, (_, m) in want.items()}
    quota = water_fill({s: w for s, (w, _) in want.items()}, limits, total if total is not None else sum(t for t, _ in avail.values()))

    spark = docs.sparkSession
    plan = [(s, int(quota[s] // t), float(quota[s] - (quota[s] // t) * t)) for s, (t, _) in avail.items() if quota[s] > 0]
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, whole long, rest double"))  # one row per listed source
    # the seeded order of a source; running sizes through per-partition sums, so no source is gathered in one task
    parts = sorted_parts(sized.join(plan_df, "source").withColumn("h", F.xxhash64(F.lit(seed), "source", "doc_id")), [F.col("source"), F.col("h"), F.col("doc_id")])
    sums = parts.groupBy("source", "_pid").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("_pid", "source").orderBy("_idx")
    run = parts.join(F.broadcast(sums), ["source", "_pid"])  # one row per (partition, listed source)
    run = run.withColumn("start", F.col("_t0") + F.sum("tokens").over(inside) - F.col("tokens")).withColumn("rank", F.col("_n0") + F.row_number().over(inside) - 1)
    partial = ((F.col("start") + F.col("tokens") / 2) <= F.col("rest")).cast("long")
    uses = run.withColumn("uses", F.col("whole") + partial)
    most = F.create_map(*[F.lit(x) for s, (_, m) in want.items() for x in (s, m)])
    uses = uses.withColumn("uses", F.least("uses", most[F.col("source")].cast("long"))).where("uses > 0")
    laid = uses.withColumn("use", F.explode(F.sequence(F.lit(0), (F.col("uses") - 1).cast("int"))))
    sizes = {s: n for s, (_, n) in avail.items()}
    size_map = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, n)]) if sizes else F.create_map(F.lit(""), F.lit(0))
    laid = cut(laid.select("doc_id", "source", "use", "tokens", F.floor((F.col("use") * size_map[F.col("source")] + F.col("rank")) / block_docs).alias("block")))

    top = {r.source: int(r.b) + 1 for r in laid.groupBy("source").agg(F.max("block").alias("b")).collect()}
    per_shard = split_blocks(top, shards, seed) if top else []
    ranges = []
    for s in top:
        at = 0
        for shard, q in enumerate(per_shard):
            if q[s]:
                ranges.append((s, shard, at, at + q[s]))
                at += q[s]
    # block -> shard is one row per block (documents / block_docs), numbered through over the listed sources; an ordinary join
    names, first = list(top), np.cumsum([0, *top.values()])

    def place(batches):
        lookup: dict[str, tuple[list[int], list[int]]] = {}
        for s, shard, lo, _ in ranges:
            lookup.setdefault(s, ([], []))
            lookup[s][0].append(lo)
            lookup[s][1].append(shard)
        for b in batches:
            at = np.searchsorted(first, b["id"].to_numpy(), side="right") - 1
            b = pd.DataFrame({"source": [names[i] for i in at], "block": b["id"].to_numpy() - first[at], "shard": 0})
            for s, rows in b.groupby("source").groups.items():
                got = permute(b.loc[rows, "block"].to_numpy(), top[s], seed).astype("int64")
                b.loc[rows, "shard"] = np.array(lookup[s][1])[np.searchsorted(lookup[s][0], got, side="right") - 1]
            yield b[["source", "block", "shard"]]

    shard_of = spark.range(int(first[-1])).mapInPandas(place, "source string, block long, shard int")
    mixed = laid.join(shard_of, ["source", "block"])
    w = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id", "use")
    keyed = mixed.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "use")).withColumn("bucket", F.shiftrightunsigned("key", 54))
    heads = keyed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("c"))
    heads = heads.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    keyed = keyed.withColumn("r", F.row_number().over(w)).join(heads, ["shard", "bucket"])
    mixture = keyed.select("doc_id", "source", "use", "tokens", "shard", (F.col("base") + F.col("r") - 1).alias("position"))

    got = laid.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("uses"))
    base = spark.createDataFrame([(s, w, m, avail.get(s, (0, 0))[0], float(quota[s])) for s, (w, m) in want.items()], "source string, target_share double, max_repeats int, available_tokens long, wanted_tokens double")
    report = base.join(got, "source", "left").na.fill(0, ["mixed_tokens", "uses"])
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    report = report.withColumn("reached_share", F.coalesce(F.round(F.try_divide(F.col("mixed_tokens"), all_tokens), 6), F.lit(0.0)))
    return mixture, report.select("source", "target_share", "max_repeats", "available_tokens", "wanted_tokens", "mixed_tokens", "reached_share", "uses")
