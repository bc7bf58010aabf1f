"""Linear models with absorbed effects on compressed cells.

The year is constant in a cell of (year, effects, clusters), so counts and sums of the outcome per cell are enough for slopes,
residual scores and cluster errors: Spark aggregates the cells, a small solver works on them. ``MAX_CELLS`` guards the
collected size; beyond it ``lpm_trend`` sweeps the effects out of the cells where they are, the other models are refused."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.stats import t_quantile, t_two_sided
from broadsheet.runtime import cut, null_safe_join, with_row

MAX_CELLS = 2_000_000
#: Clusters up to which the wild bootstrap goes through all sign vectors.
EXACT_CLUSTERS = 12


def cell_table(df: DataFrame, y: str, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, w, wy, n) per cell; rows with a null outcome are left out, null keys are a value of their own."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.where(F.col(y).isNotNull()).groupBy(*dict.fromkeys(keys)).agg(F.sum(w).alias("w"), F.sum(F.col(y).cast("double") * w).alias("wy"), F.count(F.lit(1)).alias("n"))


def cells(df: DataFrame, y: str, keys: list[str], weight: str | None = None) -> pd.DataFrame:
    """The collected cells."""
    g = cell_table(df, y, keys, weight).limit(MAX_CELLS + 1).toPandas()
    if len(g) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; use coarser keys")
    return _sorted_cells(g, keys)


def _sorted_cells(g: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    return g.sort_values(list(dict.fromkeys(keys)), na_position="first", kind="stable").reset_index(drop=True)


def _codes(s: pd.Series) -> np.ndarray:
    return pd.factorize(s, use_na_sentinel=False)[0]


def absorb(x: np.ndarray, w: np.ndarray, effects: list[np.ndarray], tol: float = 1e-11, rounds: int = 5000) -> np.ndarray:
    """Columns of x without the weighted means of the effects; without effects, without the grand mean. The effects are swept
    in turn (forward and backward, so the sweep is symmetric) until nothing moves."""
    x = x - (w @ x) / w.sum()
    if not effects:
        return x
    size = [np.maximum(np.bincount(e, weights=w), 1e-300) for e in effects]
    for _ in range(rounds):
        moved = 0.0
        for i in (*range(len(effects)), *range(len(effects) - 2, 0, -1)):
            means = np.stack([np.bincount(effects[i], weights=w * x[:, c], minlength=len(size[i])) for c in range(x.shape[1])], axis=1) / size[i][:, None]
            x = x - means[effects[i]]
            moved = max(moved, float(np.abs(means).max(initial=0)))
        if moved < tol:
            break
    return x


def _meat(score: np.ndarray, codes: np.ndarray) -> tuple[float, int]:
    s = np.bincount(codes, weights=score)
    g = len(s)
    return float(s @ s) * g / max(g - 1, 1), g


def lpm_trend(df: DataFrame, y: str, fe: list[str] | None = None, cluster: str = "publication", cluster2: str | None = "year", weight: str | None = None, year: str = "year", centre: int = 1930) -> dict:
    """Slope of y on decades in percentage points with absorbed effects and one- or two-way cluster errors; the two-way variance
    is at least either one-way variance, and t has the smaller number of clusters less one degrees of freedom."""
    keys = [year, *(fe or []), cluster, *([cluster2] if cluster2 else [])]
    table = cell_table(df, y, keys, weight)
    small = table.limit(MAX_CELLS + 1).toPandas()
    if len(small) > MAX_CELLS:
        return lpm_of_table(table, fe, cluster, cluster2, year, centre)
    return lpm_of_cells(_sorted_cells(small, keys), fe, cluster, cluster2, year, centre)


def lpm_of_table(c: DataFrame, fe: list[str] | None = None, cluster: str = "publication", cluster2: str | None = "year", year: str = "year", centre: int = 1930, tol: float = 1e-9, rounds: int = 500) -> dict:
    """``lpm_of_cells`` for cells too many to collect: the weighted means of the effects are swept out by aggregations and joins, one
    written table per round, until none moves by more than ``tol``; clusters are summed where they are."""
    fe = fe or []
    d = c.withColumn("_y", F.col("wy") / F.col("w")).withColumn("_x", (F.col(year) - centre) / F.lit(10.0))
    mean = lambda v: (F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(f"_m{v}")
    take = {v: F.col(v) - F.col(f"_m{v}") for v in ("_y", "_x")}
    whole = d.agg(mean("_y"), mean("_x"), F.sum("wy").alias("wy"), F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    d = cut(with_row(d, d.agg(mean("_y"), mean("_x"))).withColumns(take).drop("_m_y", "_m_x"))
    for _ in range(rounds if fe else 0):
        moved = 0.0
        for f in fe:
            m = cut(d.groupBy(f).agg(mean("_y"), mean("_x")))
            moved = max(moved, m.agg(F.max(F.greatest(F.abs("_m_y"), F.abs("_m_x")))).first()[0] or 0.0)
            d = null_safe_join(d, m, [f]).withColumns(take).drop("_m_y", "_m_x")
        d = cut(d)
        if moved < tol or len(fe) == 1:
            break
    s = d.agg(F.sum(F.expr("w*_x*_x")).alias("xx"), F.sum(F.expr("w*_x*_y")).alias("xy")).first()
    out = {"fe": "+".join(fe) or "none", "n": int(whole.n), "slope_pp_dec": None, "se": None, "ci_lo": None, "ci_hi": None, "p": None, "n_clusters": None, "mean_y": None}
    if s.xx is None or s.xx <= 1e-12:
        return out
    b = s.xy / s.xx
    d = d.withColumn("_u", F.expr("w*_x") * (F.col("_y") - b * F.col("_x")))

    def meat(*by: str) -> tuple[float, int]:
        r = d.groupBy(*by).agg(F.sum("_u").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.count(F.lit(1)).alias("g")).first()
        return r.q * r.g / max(r.g - 1, 1), r.g

    var, g = meat(cluster)
    if cluster2:
        (v2, g2), (v12, _) = meat(cluster2), meat(cluster, cluster2)
        var, g = max(var + v2 - v12, var, v2), min(g, g2)
    return out | _interval(b, math.sqrt(var) / s.xx, g, whole.wy / whole.w)


def _interval(b: float, se: float, g: int, mean_y: float) -> dict:
    """Slope, error, interval and p in percentage points, with g clusters."""
    dof = max(g - 1, 1)
    q = t_quantile(0.975, dof)
    return {"slope_pp_dec": 100 * b, "se": 100 * se, "ci_lo": 100 * (b - q * se), "ci_hi": 100 * (b + q * se), "p": t_two_sided(b / se, dof) if se > 0 else None, "n_clusters": g, "mean_y": float(mean_y)}


def lpm_of_cells(c: pd.DataFrame, fe: list[str] | None = None, cluster: str = "publication", cluster2: str | None = "year", year: str = "year", centre: int = 1930) -> dict:
    """``lpm_trend`` on cells(keys, w, wy, n) that are already there; cells of the same keys may come in several rows."""
    fe = fe or []
    out = {"fe": "+".join(fe) or "none", "n": int(c["n"].sum()), "slope_pp_dec": None, "se": None, "ci_lo": None, "ci_hi": None, "p": None, "n_clusters": None, "mean_y": None}
    if c.empty:
        return out
    w = c["w"].to_numpy(float)
    x = (c[year].to_numpy(float) - centre) / 10
    z = absorb(np.stack([c["wy"].to_numpy(float) / w, x], axis=1), w, [_codes(c[f]) for f in fe])
    yt, xt = z[:, 0], z[:, 1]
    sxx = float(w @ (xt * xt))
    if sxx <= 1e-12:
        return out
    b = float(w @ (xt * yt)) / sxx
    score = w * xt * (yt - b * xt)
    one = _codes(c[cluster])
    var, g = _meat(score, one)
    if cluster2:
        two = _codes(c[cluster2])
        v2, g2 = _meat(score, two)
        v12, _ = _meat(score, _codes(pd.Series(list(zip(one, two, strict=True)))))
        var, g = max(var + v2 - v12, var, v2), min(g, g2)
    return out | _interval(b, math.sqrt(var) / sxx, g, c["wy"].sum() / w.sum())


def trend_table(df: DataFrame, y: str, specs: list[list[str]], **kw) -> DataFrame:
    """One row per list of absorbed effects."""
    rows = [lpm_trend(df, y, fe, **kw) for fe in specs]
    schema = "fe string, n long, slope_pp_dec double, se double, ci_lo double, ci_hi double, p double, n_clusters int, mean_y double"
    names = [p.split()[0] for p in schema.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[k] for k in names) for r in rows], schema)


def lpm_trend_plain(df: DataFrame, y: str, cluster: str, year: str = "year", centre: int = 1930) -> DataFrame:
    """The trend without effects and with one-way cluster errors, wholly as aggregations: slope_pp_dec, se, n, n_clusters."""
    d = df.where(F.col(y).isNotNull())
    c = d.groupBy(year, cluster).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s")).withColumn("x", (F.col(year) - centre) / F.lit(10.0))
    t = c.agg(F.sum("n").alias("nn"), F.expr("sum(n*x)").alias("sx"), F.sum("s").alias("sy"), F.expr("sum(n*x*x)").alias("sxx"), F.expr("sum(x*s)").alias("sxy"))
    t = t.select("nn", F.expr("sx/nn").alias("mx"), F.expr("sy/nn").alias("my"), F.expr("sxx - sx*sx/nn").alias("vxx"), F.expr("sxy - sx*sy/nn").alias("vxy")).withColumn("b", F.expr("try_divide(vxy, vxx)"))
    e = with_row(c, t)
    g = e.groupBy(cluster).agg(F.expr("sum((x - mx) * (s - n*my - b*n*(x - mx)))").alias("u"), F.first("b").alias("b"), F.first("vxx").alias("vxx"), F.first("nn").alias("nn"))
    return g.agg(
        (100 * F.first("b")).alias("slope_pp_dec"), F.expr("100 * sqrt(sum(u*u) * count(*) / greatest(count(*) - 1, 1)) / first(vxx)").alias("se"), F.first("nn").cast("long").alias("n"), F.count(F.lit(1)).alias("n_clusters")
    )


def adjusted_yearly(df: DataFrame, y: str, fe: list[str], year: str = "year", cluster: str | None = None, B: int = 0, seed: int = 0) -> DataFrame:
    """(year, adjusted[, ci_lo, ci_hi]): year means net of the effects, on the level of the overall mean. With B > 0 clusters are
    resampled with Poisson(1) weights on the cells."""
    keys = [year, *fe, *([cluster] if cluster else [])]
    c = cells(df, y, keys)
    years = _codes(c[year])
    names = [c[year].iloc[np.flatnonzero(years == i)[0]] for i in range(years.max() + 1)] if len(c) else []
    effects = [_codes(c[f]) for f in fe]

    def fit(w: np.ndarray, wy: np.ndarray) -> np.ndarray:
        on = w > 0
        yv = np.divide(wy, w, out=np.zeros_like(wy), where=on)
        resid, level = yv - (wy.sum() / w.sum()), np.zeros(len(names))
        parts = [np.zeros(e.max() + 1) for e in effects]
        for _ in range(2000):
            base = resid - sum((p[e] for p, e in zip(parts, effects, strict=True)), np.zeros(len(w)))
            new = np.bincount(years, weights=w * base, minlength=len(names)) / np.maximum(np.bincount(years, weights=w, minlength=len(names)), 1e-300)
            for i, e in enumerate(effects):
                rest = resid - new[years] - sum((p[q] for j, (p, q) in enumerate(zip(parts, effects, strict=True)) if j != i), np.zeros(len(w)))
                parts[i] = np.bincount(e, weights=w * rest, minlength=len(parts[i])) / np.maximum(np.bincount(e, weights=w, minlength=len(parts[i])), 1e-300)
            done = np.abs(new - level).max(initial=0) < 1e-10
            level = new
            if done:
                break
        share = np.bincount(years, weights=w, minlength=len(names)) / w.sum()
        return level - share @ level + wy.sum() / w.sum()

    if not len(c):
        return df.sparkSession.createDataFrame([], f"{year} int, adjusted double, ci_lo double, ci_hi double")
    w, wy = c["w"].to_numpy(float), c["wy"].to_numpy(float)
    est = fit(w, wy)
    lo = hi = [None] * len(names)
    if B and cluster:
        rng = np.random.default_rng(seed)
        cl = _codes(c[cluster])
        reps = []
        for _ in range(B):
            p = rng.poisson(1.0, cl.max() + 1)[cl]
            reps.append(fit(w * p, wy * p))
        lo, hi = np.nanquantile(np.array(reps), [0.025, 0.975], axis=0).tolist()
    rows = [(int(t), float(v), a, b) for t, v, a, b in zip(names, est, lo, hi, strict=True)]
    return df.sparkSession.createDataFrame(sorted(rows), f"{year} int, adjusted double, ci_lo double, ci_hi double")


def wild_cluster_p(df: DataFrame, y: str, fe: list[str], cluster: str = "year", B: int = 1999, seed: int = 0, year: str = "year", centre: int = 1930) -> dict:
    """Restricted wild cluster bootstrap with Rademacher signs for a zero slope; only one score and one square per cluster are needed.
    With at most ``EXACT_CLUSTERS`` clusters all sign vectors are gone through instead of ``B`` random ones, and p is exact."""
    c = cells(df, y, [year, *fe, cluster])
    w = c["w"].to_numpy(float)
    z = absorb(np.stack([c["wy"].to_numpy(float) / w, (c[year].to_numpy(float) - centre) / 10], axis=1), w, [_codes(c[f]) for f in fe])
    cl = _codes(c[cluster])
    s, q = np.bincount(cl, weights=w * z[:, 1] * z[:, 0]), np.bincount(cl, weights=w * z[:, 1] ** 2)

    def t_stat(sg: np.ndarray) -> np.ndarray:
        b = sg.sum(axis=-1) / q.sum()
        u = sg - b[..., None] * q
        return b / np.sqrt(np.maximum((u * u).sum(axis=-1), 1e-300)) * q.sum()

    t0 = float(t_stat(s))
    if len(s) <= EXACT_CLUSTERS:
        B = 1 << len(s)
        signs = 1.0 - 2 * ((np.arange(B)[:, None] >> np.arange(len(s))) & 1)
    else:
        signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(B, len(s)))
    return {"t": t0, "p": float((np.abs(t_stat(signs * s)) >= abs(t0) - 1e-9).mean()), "n_clusters": len(s), "B": B}


def logit_ame(df: DataFrame, y: str, fe: list[str] | None = None, cluster: str = "publication", year: str = "year", centre: int = 1930) -> dict:
    """Average marginal effect of a decade in a logit with dummies for the effects, in percentage points, with cluster-robust errors."""
    fe = fe or []
    c = cells(df, y, [year, *fe, cluster])
    n, k = c["w"].to_numpy(float), c["wy"].to_numpy(float)
    cols = [np.ones(len(c)), (c[year].to_numpy(float) - centre) / 10]
    for f in fe:
        codes = _codes(c[f])
        cols += [(codes == v).astype(float) for v in range(1, codes.max() + 1)]
    x = np.stack(cols, axis=1)
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-10 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (k - n * p))
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    p = 1 / (1 + np.exp(-x @ beta))
    cl = _codes(c[cluster])
    score = np.zeros((cl.max() + 1, x.shape[1]))
    np.add.at(score, cl, x * (k - n * p)[:, None])
    g, inv = len(score), np.linalg.inv(h)
    v = inv @ (score.T @ score) @ inv * g / max(g - 1, 1)
    scale = float((n * p * (1 - p)).sum() / n.sum())
    return {"ame_pp_dec": 100 * beta[1] * scale, "se": 100 * math.sqrt(v[1, 1]) * scale, "n": int(n.sum()), "n_clusters": g}
