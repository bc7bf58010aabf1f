"""Topic and role models: matrix factorisation, stability of topics, role classifiers with cross-fitting, plug-ins for
encoders and language models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.values import uniform
from broadsheet.runtime import cut

#: A role with fewer positive or negative examples is predicted by its prevalence.
MIN_POS = 4


def nmf(weights: DataFrame, key: str, term: str, weight: str, k: int = 24, rounds: int = 15, inner: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Non-negative factorisation of a sparse document-term table (multiplicative updates).

    Returns (key, topic, weight) and (topic, term, weight). A round is one pass over the grouped documents with the
    k x terms matrix broadcast (its size is k times the capped vocabulary); partial products are summed by (topic, term)
    before they reach the driver, which keeps only k x terms and k x k numbers."""
    spark = weights.sparkSession
    vocabulary = [r[0] for r in weights.select(term).distinct().orderBy(term).collect()]
    place = {t: i for i, t in enumerate(vocabulary)}
    spot = F.broadcast(spark.createDataFrame(list(place.items()), f"{term} string, _j int"))  # the capped vocabulary
    cells = weights.join(spot, term).groupBy(key).agg(F.collect_list(F.struct("_j", F.col(weight).cast("double").alias("_v"))).alias("x"))
    docs = cut(cells.select(key, F.col("x._j").alias("ids"), F.col("x._v").alias("v")))
    rng = np.random.default_rng(seed)
    h = rng.random((k, len(vocabulary))) + 0.1

    def solve(ids: np.ndarray, v: np.ndarray, g: np.ndarray, hm: np.ndarray) -> np.ndarray:
        b, w = hm[:, ids] @ v, np.full(k, 1.0 / k)
        for _ in range(inner):
            w = w * b / np.maximum(g @ w, 1e-12)
        return w

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(h)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hm = shared.value
            g, num, den = hm @ hm.T, np.zeros_like(hm), np.zeros((k, k))
            for b in batches:
                for ids, v in zip(b["ids"], b["v"], strict=True):
                    w = solve(ids, v, g, hm)
                    num[:, ids] += np.outer(w, v)
                    den += np.outer(w, w)
            a = np.argwhere(num > 0)
            top = pd.DataFrame({"t": a[:, 0], "j": a[:, 1], "v": num[a[:, 0], a[:, 1]]})
            low = pd.DataFrame({"t": np.repeat(np.arange(k), k), "j": -1 - np.tile(np.arange(k), k), "v": den.reshape(-1)})
            yield pd.concat([top, low])

        got = docs.select("ids", "v").mapInPandas(partial, "t int, j int, v double").groupBy("t", "j").agg(F.sum("v").alias("v")).toPandas()
        num, den = np.zeros_like(h), np.zeros((k, k))
        up = got[got["j"] >= 0]
        num[up["t"], up["j"]] = up["v"]
        lo = got[got["j"] < 0]
        den[lo["t"], -1 - lo["j"]] = lo["v"]
        h = np.maximum(h * num / np.maximum(den @ h, 1e-12), 1e-12)
        shared.destroy()

    shared = spark.sparkContext.broadcast(h)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hm = shared.value
        g = hm @ hm.T
        for b in batches:
            found = [solve(ids, v, g, hm) for ids, v in zip(b["ids"], b["v"], strict=True)]
            if found:
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), k), "topic": np.tile(np.arange(k), len(b)), "weight": np.concatenate(found)})

    kind = weights.schema[key].dataType.simpleString()
    rows = [(t, vocabulary[j], float(h[t, j])) for t in range(k) for j in np.flatnonzero(h[t] > 1e-9).tolist()]
    return docs.mapInPandas(assign, f"{key} {kind}, topic int, weight double"), spark.createDataFrame(rows, f"topic int, {term} string, weight double")


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest perfect matching of a square cost matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n), np.zeros(n + 1), np.full(n + 1, -1)
    for r in range(n):
        match[n] = r
        col, least, back, seen = n, np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while match[col] >= 0:
            seen[col] = True
            row = match[col]
            open_ = ~seen[:n]
            slack = cost[row] - u[row] - v[:n]
            better = open_ & (slack < least)
            least[better], back[better] = slack[better], col
            nxt = int(np.where(open_, least, np.inf).argmin())
            step = least[nxt]
            u[match[seen]] += step
            v[seen] -= step
            least[open_] -= step
            col = nxt
        while col != n:
            match[col] = match[back[col]]
            col = back[col]
    out = np.empty(n, int)
    out[match[:n]] = np.arange(n)
    return out


def topic_stability(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """(mean cosine of matched topics, matching) of two topic-term matrices."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    c = unit(a) @ unit(b).T
    m = assignment(-c)
    return float(c[np.arange(len(c)), m].mean()), m


def topic_runs(weights: DataFrame, key: str, term: str, weight: str, k: int = 24, rounds: int = 15, seeds: tuple[int, ...] = (0, 1, 2)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, terms, stability): the factorisation of the first seed, and one row (seed, topic, matched, cosine) per further seed
    and topic with the topic of that run it matches best. The topic-term matrices are k x capped vocabulary."""
    docs, terms = nmf(weights, key, term, weight, k, rounds, seed=seeds[0])
    first = _matrix(terms, term, k)
    rows = []
    for s in seeds[1:]:
        other = _matrix(nmf(weights, key, term, weight, k, rounds, seed=s)[1], term, k)
        both = first.columns.union(other.columns)
        a, b = (m.reindex(columns=both, fill_value=0.0).to_numpy() for m in (first, other))
        _, match = topic_stability(a, b)
        unit = [m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (a, b)]
        rows += [(s, t, int(match[t]), float(unit[0][t] @ unit[1][match[t]])) for t in range(k)]
    return docs, terms, weights.sparkSession.createDataFrame(rows, "seed int, topic int, matched int, cosine double")


def _matrix(terms: DataFrame, term: str, k: int) -> pd.DataFrame:
    return terms.toPandas().pivot(index="topic", columns=term, values="weight").reindex(range(k)).fillna(0.0)


def _fitted(train: DataFrame, features: str, target: str, weight: str, reg: float):
    """A fitted classifier, or the prevalence if either class is too small."""
    n = train.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("q")).first()
    if n.p < MIN_POS or n.q < MIN_POS:
        return n.p / max(n.p + n.q, 1)
    balanced = train.withColumn("_w", F.col(weight) * F.when(F.col(target) == 1, (n.p + n.q) / (2 * n.p)).otherwise((n.p + n.q) / (2 * n.q)))
    lr = LogisticRegression(featuresCol=features, labelCol=target, weightCol="_w", regParam=reg, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    return lr.fit(balanced)


def _scored(model, df: DataFrame, out: str) -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    keep = df.columns
    return model.transform(df).select(*keep, vector_to_array("_prob")[1].alias(out))


def bow_stages(text: str = "text") -> list:
    """Words and word pairs seen in at least two documents, weighted by inverse document frequency."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_t", pattern="[^a-z_]+"), NGram(n=2, inputCol="_t", outputCol="_b"), CountVectorizer(inputCol="_t", outputCol="_ct", minDF=2),
        CountVectorizer(inputCol="_b", outputCol="_cb", minDF=2), VectorAssembler(inputCols=["_ct", "_cb"], outputCol="_c"), IDF(inputCol="_c", outputCol="_f"),
    ]


def embedding_stages(features: str = "features") -> list:
    return [StandardScaler(inputCol=features, outputCol="_f", withMean=True, withStd=True)]


def with_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def crossfit(df: DataFrame, key: str, targets: list[str], stages: Callable[[], list], weight: str | None = None, k: int = 5, seed: int = 0, reg: float = 0.01) -> DataFrame:
    """``df`` with out-of-fold probabilities p_<target>; the fold is a hash of the key, so it is stable under reordering. The
    features are fitted once per fold and written to the shared folder; all targets read them there."""
    d = df.withColumn("_one", F.col(weight) if weight else F.lit(1.0)).withColumn("_fold", F.floor(uniform(F.col(key), F.lit(seed)) * k).cast("int"))
    out = None
    for fold in range(k):
        train, test = d.where(F.col("_fold") != fold), d.where(F.col("_fold") == fold)
        made = Pipeline(stages=stages()).fit(train)
        train = cut(made.transform(train).select("_f", "_one", *targets))
        test = made.transform(test).select(*d.columns, "_f")
        for t in targets:
            test = _scored(_fitted(train, "_f", t, "_one", reg), test, f"p_{t}")
        out = test if out is None else out.unionByName(test)
    return out.drop("_one", "_fold", "_f")


def pooled_embeddings(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds an embedding from a plug-in encoder, loaded once per task and called on batches."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            rows: list = []
            for i in range(0, len(s), batch):
                rows += model(s.iloc[i : i + batch].fillna("").tolist()).astype("float32").tolist()
            yield pd.Series(rows)

    return df.withColumn(out, encode(F.col(text)))


def label_replies(df: DataFrame, key: str, prompt: str, load: Callable[[], Callable[[str], str]], tries: int = 3, wait: float = 1.0, parallel: int | None = None) -> DataFrame:
    """(key, raw, error, tries): replies of a plug-in client; failures are recorded, not raised, and retried with growing waits.
    ``parallel`` caps the number of tasks that call the service."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for b in batches:
            out = []
            for k, p in zip(b[key], b[prompt], strict=True):
                raw = error = None
                n = 0
                while raw is None and n < tries:
                    n += 1
                    try:
                        raw, error = ask(p), None
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait * (4 if "429" in str(e) else 1) * 2 ** (n - 1) if n < tries else 0)
                out.append((k, raw, error, n))
            yield pd.DataFrame(out, columns=[key, "raw", "error", "tries"])

    d = df.select(key, prompt)
    return (d.repartition(parallel) if parallel else d).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, raw string, error string, tries int")
