"""SQL of the models for the oracle: Student's t in closed form, sweeps of effects, bootstraps and grids, written out as plain queries."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from broadsheet.functions.stats import t_quantile

#: Degrees of freedom that occur in the queries.
DOFS = (2, 3, 4, 5, 6)
POISSON = "CASE " + " ".join(f"WHEN u < {t!r} THEN {k}" for k, t in enumerate(accumulate(exp(-1) / factorial(i) for i in range(14)))) + " ELSE 14 END"


def t_p(t: str, dof: str) -> str:
    """Two-sided p value of Student's t for whole degrees of freedom, by the finite sums in cosines."""
    cases = []
    for v in DOFS:
        th = f"atan(abs({t}) / sqrt({v}.0))"
        term, terms = 1.0, []
        for k in range(v // 2):
            power = 2 * k + v % 2
            terms.append(f"{term!r} * cos({th}) ** {power}")
            term *= (2 * k + 2) / (2 * k + 3) if v % 2 else (2 * k + 1) / (2 * k + 2)
        body = f"sin({th}) * ({' + '.join(terms)})"
        cases.append(f"WHEN {v} THEN 1 - " + (f"2 / pi() * ({th} + {body})" if v % 2 else body))
    return f"CASE {dof} {' '.join(cases)} END"


def t_crit(dof: str) -> str:
    return f"CASE {dof} " + " ".join(f"WHEN {v} THEN {t_quantile(0.975, v)!r}::DOUBLE" for v in DOFS) + " END"


def normal_p(z: str) -> str:
    """Two-sided normal p value by Simpson's rule over the density."""
    n = 800
    h = f"(least(abs({z}), 9.0) / {n})"
    return f"greatest(1 - 2 * {h} / 3 * list_sum(list_transform(range({n + 1}), lambda i: (CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (i * {h}) * (i * {h})))) / sqrt(2 * pi()), 0)"


def weights(rows: str, cluster: str, columns: str, B: int) -> str:
    """Rows with a Poisson weight per replicate b: four replicates take the four words of one md5."""
    u = f"(('0x' || substring(md5({cluster} || '|' || b // 4 || '|0'), 8 * (b % 4)::INT + 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE"
    return f"SELECT * FROM (SELECT *, {POISSON} AS w FROM (SELECT {columns}, b, {u} AS u FROM {rows}, range({B}) t(b))) WHERE w > 0"


def sweeps(name: str, source: str, values: list[str], effects: list[str], rounds: int) -> dict[str, str]:
    """CTEs that take the weighted means of the effects out of the value columns, in turn; the last one is called ``name``."""
    keep = "* EXCLUDE (" + ", ".join(values) + ")"
    steps = [f"SELECT {keep}, " + ", ".join(f"{v} - sum(w * {v}) OVER () / sum(w) OVER () AS {v}" for v in values) + f" FROM {source}"]
    for _ in range(rounds if effects else 0):
        for e in effects:
            steps.append(f"SELECT {keep}, " + ", ".join(f"{v} - sum(w * {v}) OVER (PARTITION BY {e}) / sum(w) OVER (PARTITION BY {e}) AS {v}" for v in values) + " FROM {prev}")
    out, prev = {}, source
    for i, s in enumerate(steps):
        key = name if i == len(steps) - 1 else f"{name}_{i}"
        out[key] = s.format(prev=prev) if i else s
        prev = key
    return out


def hac(src: str, keys: list[str], lag1: str = "2.0 / 3", lag2: str = "1.0 / 3", centre: int = 1998, name: str = "hac") -> dict[str, str]:
    """CTEs of weighted trends of (keys, year, share, n) with Newey-West errors; the last is ``name``(keys, slope, se, level, ny)."""
    k, g = ", ".join(keys), ", ".join(keys)
    n = name
    return {
        f"{n}_d": f"SELECT {k}, year, (year - {centre}) / 10.0::DOUBLE AS x, share AS v, n::DOUBLE AS w FROM {src} WHERE share IS NOT NULL AND n > 0",
        f"{n}_s": f"SELECT {k}, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * v) AS t0, sum(w * x * v) AS t1, count(*) AS ny FROM {n}_d GROUP BY {g}",
        f"{n}_b": f"SELECT *, s0 * s2 - s1 * s1 AS det, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS a FROM {n}_s",
        f"{n}_g": f"SELECT {k}, year, w * (v - a - b * x) AS g0, w * (v - a - b * x) * x AS g1 FROM {n}_d JOIN {n}_b USING ({g})",
        f"{n}_l": f"SELECT *, coalesce(lag(g0, 1) OVER o, 0) AS p1, coalesce(lag(g1, 1) OVER o, 0) AS q1, coalesce(lag(g0, 2) OVER o, 0) AS p2, coalesce(lag(g1, 2) OVER o, 0) AS q2, ({lag1})::DOUBLE AS l1, ({lag2})::DOUBLE AS l2 FROM {n}_g WINDOW o AS (PARTITION BY {g} ORDER BY year)",
        f"{n}_m": f"SELECT {k}, sum(g0 * g0 + 2 * l1 * g0 * p1 + 2 * l2 * g0 * p2) AS m00, sum(g0 * g1 + l1 * (g0 * q1 + g1 * p1) + l2 * (g0 * q2 + g1 * p2)) AS m01, sum(g1 * g1 + 2 * l1 * g1 * q1 + 2 * l2 * g1 * q2) AS m11 FROM {n}_l GROUP BY {g}",
        n: f"SELECT {k}, CASE WHEN ny >= 4 THEN 100 * b END AS slope, CASE WHEN ny >= 4 THEN 100 * sqrt(greatest((s1 * s1 * m00 - 2 * s0 * s1 * m01 + s0 * s0 * m11) / (det * det) * (ny / (ny - 2.0)), 0)) END AS se, CASE WHEN ny >= 4 THEN 100 * a END AS level, ny FROM {n}_b JOIN {n}_m USING ({g})",
    }


def with_t(src: str) -> str:
    """(ci_lo, ci_hi, p) of a table with slope, se and ny, as select columns."""
    dof = "greatest(ny - 2, 1)::INT"
    return f"slope - {t_crit(dof)} * se AS ci_lo, slope + {t_crit(dof)} * se AS ci_hi, CASE WHEN se > 0 THEN {t_p('slope / se', dof)} END AS p FROM {src}"


def query(frame: str, ctes: dict[str, str], body: str) -> str:
    return "WITH " + ", ".join([frame, *(f"{k} AS ({v})" for k, v in ctes.items())]) + " " + body


# ------------------------------------------------------------------ models of the frame

CELLS = "SELECT year, section, publication, page_band, count(*)::DOUBLE AS w, avg(f) AS y, (year - 1998) / 10.0::DOUBLE AS x FROM frame WHERE f IS NOT NULL GROUP BY 1, 2, 3, 4"


def lpm(frame: str, specs: list[list[str]], rounds: int = 14) -> str:
    ctes, parts = {"c": CELLS}, []
    for i, fe in enumerate(specs):
        z = f"z{i}"
        ctes |= sweeps(z, "c", ["y", "x"], fe, rounds)
        ctes[f"{z}b"] = f"SELECT sum(w * x * x) AS sxx, sum(w * x * y) / sum(w * x * x) AS b FROM {z}"
        ctes[f"{z}u"] = f"SELECT publication, year, sum(w * x * (y - b * x)) AS u FROM {z}, {z}b GROUP BY 1, 2"
        meat = lambda by, z=z: f"(SELECT sum(s * s) * count(*) / greatest(count(*) - 1, 1) FROM (SELECT sum(u) AS s FROM {z}u GROUP BY {by}))"
        groups = f"(SELECT least(count(DISTINCT publication), count(DISTINCT year)) FROM {z}u)"
        ctes[f"{z}v"] = f"SELECT 100 * b AS slope, 100 * sqrt(greatest({meat('publication')} + {meat('year')} - {meat('publication, year')}, {meat('publication')}, {meat('year')})) / sxx AS se, {groups}::INTEGER AS g FROM {z}b"
        dof = "greatest(g - 1, 1)::INT"
        parts.append(
            f"SELECT '{'+'.join(fe) or 'none'}' AS fe, (SELECT sum(w) FROM c)::BIGINT AS n, round(slope, 6) AS slope_pp_dec, round(se, 6) AS se, round(slope - {t_crit(dof)} * se, 6) AS ci_lo, round(slope + {t_crit(dof)} * se, 6) AS ci_hi, "
            f"round({t_p('slope / se', dof)}, 6) AS p, g AS n_clusters, round((SELECT sum(w * y) / sum(w) FROM c), 6) AS mean_y FROM {z}v"
        )
    return query(frame, ctes, " UNION ALL ".join(parts))


def adjusted(frame: str, fe: list[str], rounds: int = 14) -> str:
    ctes = {"c": f"SELECT year, {', '.join(fe)}, count(*)::DOUBLE AS w, avg(f) AS y FROM frame WHERE f IS NOT NULL GROUP BY ALL"}
    ctes["a_0"] = "SELECT *, y - sum(w * y) OVER () / sum(w) OVER () AS r, 0.0::DOUBLE AS e_year, " + ", ".join(f"0.0::DOUBLE AS e_{f}" for f in fe) + " FROM c"
    at = 0
    names = ["year", *fe]
    for _ in range(rounds):
        for f in names:
            others = "".join(f" - e_{o}" for o in names if o != f)
            ctes[f"a_{at + 1}"] = f"SELECT * EXCLUDE (e_{f}), sum(w * (r{others})) OVER (PARTITION BY {f}) / sum(w) OVER (PARTITION BY {f}) AS e_{f} FROM a_{at}"
            at += 1
    return query(frame, ctes, f"SELECT DISTINCT year, round(e_year - sum(w * e_year) OVER () / sum(w) OVER () + sum(w * y) OVER () / sum(w) OVER (), 6) AS adjusted, NULL::DOUBLE AS ci_lo, NULL::DOUBLE AS ci_hi FROM a_{at}")


def wild(frame: str) -> str:
    ctes = {"c": "SELECT year, section, count(*)::DOUBLE AS w, avg(f) AS y, (year - 1998) / 10.0::DOUBLE AS x FROM frame WHERE f IS NOT NULL GROUP BY 1, 2"} | sweeps("z", "c", ["y", "x"], ["section"], 1)
    ctes["g"] = "SELECT row_number() OVER (ORDER BY year) - 1 AS i, sum(w * x * y) AS s, sum(w * x * x) AS q FROM z GROUP BY year"
    ctes["m"] = "SELECT m, i, s * CASE WHEN (m >> i) & 1 = 1 THEN -1 ELSE 1 END AS s, q FROM g, range((SELECT 1 << count(*) FROM g)) t(m)"
    ctes["b"] = "SELECT m, sum(s) / sum(q) AS b, sum(q) AS qq FROM m GROUP BY 1"
    ctes["t"] = "SELECT m, any_value(b) / sqrt(sum((s - b * q) ** 2)) * any_value(qq) AS t FROM m JOIN b USING (m) GROUP BY 1"
    return query(frame, ctes, "SELECT round((SELECT t FROM t WHERE m = 0), 6) AS t, round(avg((abs(t) >= (SELECT abs(t) FROM t WHERE m = 0) - 1e-9)::INT), 6) AS p, (SELECT count(*) FROM g)::INTEGER AS n_clusters, count(*)::INTEGER AS B FROM t")


def logit(frame: str, rounds: int = 12) -> str:
    ctes = {"c": "SELECT publication, year, (year - 1998) / 10.0::DOUBLE AS x, count(*)::DOUBLE AS n, sum(f) AS k FROM frame WHERE f IS NOT NULL GROUP BY 1, 2", "i_0": "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b"}
    for i in range(rounds):
        ctes[f"h_{i}"] = f"SELECT a, b, sum(n * p * (1 - p)) AS h0, sum(n * p * (1 - p) * x) AS h1, sum(n * p * (1 - p) * x * x) AS h2, sum(k - n * p) AS g0, sum(x * (k - n * p)) AS g1, sum(n) AS nn FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM c, i_{i}) GROUP BY 1, 2"
        ctes[f"i_{i + 1}"] = f"SELECT a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM h_{i}"
    ctes["u"] = f"SELECT publication, sum(k - n * p) AS u0, sum(x * (k - n * p)) AS u1 FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM c, i_{rounds}) GROUP BY 1"
    var = "(SELECT sum(((h0 * u1 - h1 * u0) / (h0 * h2 - h1 * h1)) ** 2) * count(*) / greatest(count(*) - 1, 1) FROM u)"
    return query(frame, ctes, f"SELECT round(100 * b * h0 / nn, 6) AS ame_pp_dec, round(100 * sqrt({var}) * h0 / nn, 6) AS se, nn::BIGINT AS n, (SELECT count(*) FROM u)::INTEGER AS n_clusters FROM h_{rounds - 1}")


def trend_intervals(frame: str, yearly: str) -> str:
    ctes = {"y": yearly} | hac("y", ["role"])
    ctes["i"] = f"SELECT role, slope, se, level, ny, {with_t('hac')}"
    ctes["q"] = "SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM i)"
    return query(frame, ctes, "SELECT role, round(slope, 6) AS slope_pp_dec, round(se, 6) AS se, round(level, 6) AS level, ny AS n_years, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(p, 6) AS p, round(q, 6) AS q FROM q")


def speaker_gap(frame: str, B: int) -> str:
    est = "100 * (sum({w}sf) / greatest(sum({w}sn), 1) - sum({w}nf) / sum({w}nn))"
    ctes = {
        "s": "SELECT article_id, CAST(year AS VARCHAR) AS period, sum(f) AS nf, count(*)::DOUBLE AS nn, coalesce(sum(f) FILTER (WHERE quoted), 0) AS sf, (count(*) FILTER (WHERE quoted))::DOUBLE AS sn FROM frame WHERE f IS NOT NULL GROUP BY 1, 2",
        "e": "SELECT * FROM s UNION ALL SELECT article_id, 'all', nf, nn, sf, sn FROM s",
        "r": weights("e", "article_id", "period, nf, nn, sf, sn, article_id", B),
        "v": f"SELECT period, b, {est.format(w='w * ')} AS v FROM r GROUP BY 1, 2",
        "i": "SELECT period, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v GROUP BY 1",
        "o": f"SELECT period, {est.format(w='')} AS d, sum(sn) AS sn, sum(nn) AS nn FROM e GROUP BY 1",
    }
    return query(frame, ctes, "SELECT period, round(d, 6) AS diff_pp, sn AS n_speakers, nn AS n_mentions, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi FROM o JOIN i USING (period)")


def shift_share(frame: str, group: str, B: int) -> str:
    part = (
        "100 * (sum(coalesce(wl * sl, 0)) - sum(coalesce(we * se, 0))) AS total_pp, 100 * coalesce(sum((wl - we) * (sl + se) / 2) FILTER (WHERE ok), 0) AS composition_pp, "
        "100 * coalesce(sum((sl - se) * (wl + we) / 2) FILTER (WHERE ok), 0) AS within_pp, 1 - coalesce(sum(we + wl) FILTER (WHERE ok), 0) / 2 AS unmatched, count(*) AS n_groups"
    )
    sums = "coalesce(sum({w}n) FILTER (WHERE NOT late), 0) AS ne, coalesce(sum({w}n) FILTER (WHERE late), 0) AS nl, coalesce(sum({w}k) FILTER (WHERE NOT late), 0) AS ke, coalesce(sum({w}k) FILTER (WHERE late), 0) AS kl"
    rates = "ne / nullif(sum(ne) OVER ({p}), 0) AS we, nl / nullif(sum(nl) OVER ({p}), 0) AS wl, ke / nullif(ne, 0) AS se, kl / nullif(nl, 0) AS sl, ne > 0 AND nl > 0 AS ok"
    ctes = {
        "a": f"SELECT article_id, min(year) >= 1999 AS late, min({group}) AS grp, count(*)::DOUBLE AS n, sum(f) AS k FROM frame WHERE f IS NOT NULL AND (year BETWEEN 1995 AND 1997 OR year BETWEEN 1999 AND 2001) GROUP BY 1",
        "g": f"SELECT grp, {sums.format(w='')} FROM a GROUP BY 1",
        "h": f"SELECT *, {rates.format(p='')} FROM g",
        "o": f"SELECT {part} FROM h",
        "r": weights("a", "article_id", "article_id, late, grp, n, k", B),
        "rg": f"SELECT b, grp, {sums.format(w='w * ')} FROM r GROUP BY 1, 2",
        "rh": f"SELECT *, {rates.format(p='PARTITION BY b')} FROM rg",
        "rp": f"SELECT b, {part} FROM rh GROUP BY 1",
    }
    ci = ", ".join(f"(SELECT round(quantile_cont({c}_pp, {q}), 6) FROM rp) AS {c}_{t}" for c in ("total", "composition", "within") for q, t in ((0.025, "lo"), (0.975, "hi")))
    return query(frame, ctes, f"SELECT round(total_pp, 6) AS total_pp, round(composition_pp, 6) AS composition_pp, round(within_pp, 6) AS within_pp, round(unmatched, 6) AS unmatched, n_groups, {ci} FROM o")

# ------------------------------------------------------------------ specification grids

#: The frame of the grids: its seven years stretched over five decades, so that wide bins have enough of them, and three tiers of the outcome.
GRID_FRAME = """gf AS (SELECT 1900 + 9 * (year - 1995) AS year, ner_ok AS f_ner, near_dup AS f_dup, ocr_clean AS f_ocr, evening_star AS f_star, in_cap AS f_cap, is_news AS f_news, quoted, weight, role, authority, section, publication,
 CASE WHEN weight % 2 = 0 THEN f END AS y_h, f AS y_hp, coalesce(f, CASE WHEN weight % 3 = 0 THEN 1.0::DOUBLE END) AS y_hpn FROM frame)"""
ESTIMANDS = {"female_share": "true", "authority_share@A": "authority", "authority_share@B": "role IN ('ECONOMY', 'PROMO', 'SMALL')", "civic_share@A": "role = 'STANDARD'", "civic_share@B": "role IN ('MEDIUM', 'STANDARD')"}
METHODS = {f"authority_share@{m}{t}": f"{v} / 50.0::DOUBLE >= {t}::DOUBLE" for m, v in (("C", "weight"), ("D", "(weight * 7) % 50")) for t in (0.3, 0.5, 0.7)} | {"authority_share@A(app)": "authority", "authority_share@B(app)": "role IN ('ECONOMY', 'PROMO', 'SMALL')"}
_FLAGS = "f_ner, f_dup, f_ocr, f_star, f_cap, f_news"


def grid_cells(grid: dict[str, list[str]], estimands: dict[str, str]) -> dict[str, str]:
    """CTEs from the grid frame to the table ``cell``(grid keys, estimand, slope, se, level, ny, n)."""
    names = list(grid)
    keys = [*names, "estimand"]
    out = {}
    measures = [(t, r, f"y_{t}" if r == "mixed_unknown" else f"CASE WHEN quoted THEN y_{t} END") for t in grid["tier"] for r in grid["resolution"]]
    out["m"] = " UNION ALL ".join(f"SELECT year, {_FLAGS}, '{e}' AS estimand, '{t}' AS tier, '{r}' AS resolution, sum({y}) AS k, count({y}) AS n FROM gf WHERE {c} GROUP BY ALL" for e, c in estimands.items() for t, r, y in measures)
    out["g"] = "SELECT * FROM " + ", ".join(f"(SELECT unnest({v!r}) AS {k})" for k, v in grid.items())
    keep = "(population <> 'ner' OR f_ner) AND (dedup = 'keep' OR NOT f_dup) AND (ocr = 'all' OR f_ocr) AND (papers <> 'excl_evening_star' OR NOT f_star) AND (papers <> 'capped' OR f_cap) AND (content = 'all' OR f_news)"
    width = "CASE bins WHEN 'year' THEN 1 WHEN 'bin5' THEN 5 ELSE 10 END"
    out["x"] = f"SELECT {', '.join('g.' + c for c in names)}, estimand, year // ({width}) AS bin, sum(year * n) / sum(n)::DOUBLE AS year, sum(k) / sum(n) AS share, sum(n) AS n FROM m JOIN g USING (tier, resolution) WHERE n > 0 AND {keep} GROUP BY ALL"
    out |= hac("x", keys, "CASE WHEN bins = 'year' THEN 2.0 / 3 ELSE 0.5 END", "CASE WHEN bins = 'year' THEN 1.0 / 3 ELSE 0 END", 1930)
    out["cell"] = f"SELECT hac.*, (SELECT sum(n) FROM x WHERE {' AND '.join(f'x.{k} = hac.{k}' for k in keys)}) AS n FROM hac"
    return out


def multiverse(frame: str, grid: dict[str, list[str]], estimands: dict[str, str]) -> str:
    keys = ", ".join([*grid, "estimand"])
    body = f"SELECT {keys}, round(slope, 6) AS slope_pp_dec, round(se, 6) AS se, round(level, 6) AS level, ny AS n_years, n::BIGINT AS n, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(p, 6) AS p FROM (SELECT *, {with_t('cell')})"
    return query(f"{frame}, {GRID_FRAME}", grid_cells(grid, estimands), body)


def multiverse_summary(frame: str, grid: dict[str, list[str]], estimands: dict[str, str], by: list[list[str]]) -> str:
    ctes = grid_cells(grid, estimands) | {"i": f"SELECT * REPLACE (round(slope, 9) AS slope, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi) FROM (SELECT *, {with_t('cell')})"}
    every = list(dict.fromkeys(k for b in by for k in b))
    parts = [
        "SELECT " + ", ".join(k if k in b else f"NULL::VARCHAR AS {k}" for k in every) + f", '{'+'.join(b)}' AS \"by\", count(slope) AS n_cells, round(count(*) FILTER (WHERE slope > 0)::DOUBLE / nullif(count(slope), 0), 6) AS share_positive, "
        "round(count(*) FILTER (WHERE ci_lo > 0)::DOUBLE / count(*), 6) AS share_sig_positive, round(count(*) FILTER (WHERE ci_hi < 0)::DOUBLE / count(*), 6) AS share_sig_negative, round(min(slope), 6) AS slope_min, round(median(slope), 6) AS slope_median, "
        f"round(max(slope), 6) AS slope_max, coalesce(bool_and(slope > 0) OR bool_and(slope < 0), false) AS sign_survives_all FROM i GROUP BY {', '.join(b)}"
        for b in by
    ]
    return query(f"{frame}, {GRID_FRAME}", ctes, " UNION ALL ".join(parts))


def claims(frame: str, grid: dict[str, list[str]], B: int) -> str:
    """(id, status) of the claims over the trends, shares and grids of the frame."""
    yearly = "SELECT 1 AS k, year, sum(n) AS n, sum(s) / sum(n) AS share FROM (SELECT year, article_id, sum({y}) AS s, count(*)::DOUBLE AS n FROM frame WHERE {y} IS NOT NULL AND {c} GROUP BY 1, 2) GROUP BY year"
    ctes = grid_cells(grid, ESTIMANDS)
    ctes |= {"cy": yearly.format(y="f", c="true"), "ca": yearly.format(y="f", c="authority"), "cu": yearly.format(y="(CASE WHEN gender = 'UNKNOWN' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", c="true")}
    ctes["cg"] = "SELECT 1 AS k, cy.year, cy.n, ca.share - cy.share AS share FROM cy JOIN ca USING (year)"
    for name in ("cy", "cg", "cu"):
        ctes |= hac(name, ["k"], name=f"h{name}") | {f"i{name}": f"SELECT {with_t(f'h{name}')}"}
    ctes["ra"] = "SELECT 'r_' || role AS role, year, count(*)::DOUBLE AS n, sum(f) / count(*) AS share FROM (SELECT role, year, f FROM frame WHERE f IS NOT NULL UNION ALL SELECT 'AUTHORITY', year, f FROM frame WHERE f IS NOT NULL AND authority) GROUP BY 1, 2"
    ctes |= hac("ra", ["role"], name="hr")
    ctes |= {
        "ss": "SELECT article_id, CAST(year AS VARCHAR) AS period, sum(f) AS nf, count(*)::DOUBLE AS nn, coalesce(sum(f) FILTER (WHERE quoted), 0) AS sf, (count(*) FILTER (WHERE quoted))::DOUBLE AS sn FROM frame WHERE f IS NOT NULL GROUP BY 1, 2",
        "se": "SELECT * FROM ss UNION ALL SELECT article_id, 'all', nf, nn, sf, sn FROM ss",
        "sr": weights("se", "article_id", "period, nf, nn, sf, sn, article_id", B),
        "sv": "SELECT period, b, sum(w * sf) / greatest(sum(w * sn), 1) - sum(w * nf) / sum(w * nn) AS v FROM sr GROUP BY 1, 2",
        "sh": "SELECT period, quantile_cont(v, 0.975) AS hi FROM sv GROUP BY 1",
        "rb": "SELECT estimand, min(slope) AS lo, coalesce(bool_and(slope > 0) OR bool_and(slope < 0), false) AS same FROM (SELECT estimand, round(slope, 9) AS slope FROM cell) WHERE slope IS NOT NULL GROUP BY 1",
    }
    status = lambda name, sup, ten: f"SELECT '{name}' AS id, CASE WHEN coalesce({sup}, false) THEN 'supported' WHEN coalesce({ten}, false) THEN 'tentative' ELSE 'unsupported' END AS status"
    rising = "(SELECT ci_lo > 0 FROM icy)"
    both = "((SELECT bool_and(ca.share < cy.share) FROM ca JOIN cy USING (year)) AND (SELECT ci_lo > 0 FROM icg))"
    parts = [
        status("H1", f"{rising} AND (SELECT same AND lo > 0 FROM rb WHERE estimand = 'female_share')", rising),
        status("H2", "false", both),  # one method only
        status("H3", "false", "false"),  # no adjusted trend among the inputs
        status("H4", "(SELECT max(abs(slope)) / min(abs(slope)) > 2 OR NOT (bool_and(slope > 0) OR bool_and(slope < 0)) FROM hr)", "false"),
        status("H5", "false", "false"),
        status("H6", "false", "(SELECT ci_lo > 0 OR ci_hi < 0 FROM icu)"),
        status("H7", "(SELECT bool_and(hi < 0) FROM sh)", "(SELECT hi < 0 FROM sh WHERE period = 'all')"),
    ]
    return query(f"{frame}, {GRID_FRAME}", ctes, " UNION ALL ".join(parts))
