"""Capping, title matching, sampling, packing and mixing against brute force and on hard small inputs."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import capping, mixing, packing, sampling, titles
from broadsheet.llm.tokens import encoding, token_count

T0 = dt.datetime(2026, 1, 1)


def records(n=3000, seed=0):
    r = random.Random(seed)
    return [("big" if r.random() < 0.4 else None if r.random() < 0.05 else f"c{r.randrange(30)}", r.randrange(3), f"id{i:05d}", r.randrange(9) if r.random() < 0.9 else None) for i in range(n)]


@pytest.mark.parametrize(("cap", "batches"), [(40, 1), (40, 4), (7, 3), (1, 2), (10**6, 2), (0, 2)])
def test_cap_matches_sort(spark, cap, batches):
    rows = records()
    d = spark.createDataFrame(rows, "contributor string, score int, id string, piece int")
    s = capping.cap_contributors(d, cap, batches)
    want = set()
    for c, g in itertools.groupby(sorted((r for r in rows if r[0]), key=lambda r: r[:3]), key=lambda r: r[0]):
        want |= {x[2] for x in list(g)[cap:]}
    got = [r.id for r in s.displaced.collect()]
    assert sorted(got) == sorted(want)
    assert {r.id for r in s.kept.collect()} == {r[2] for r in rows} - want


def test_state_outlives_the_run(spark, tmp_path):
    """A run that loads the saved state and gets the rest of the records ends where one run over all records ends."""
    rows = records()
    d = spark.createDataFrame(rows, "contributor string, score int, id string, piece int")
    first, rest = d.where("piece is null or piece < 5"), d.where("piece >= 5")
    capping.cap_contributors(first, 40, 2).save(f"{tmp_path}/state")
    again = capping.cap_contributors(rest, 40, 2, capping.CapState.load(spark, f"{tmp_path}/state"))
    whole = capping.cap_contributors(d, 40, 1)
    for a, b in ((again.displaced, whole.displaced), (again.kept, whole.kept)):
        assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    assert {r.contributor: r.n for r in again.sizes.collect()} == {r["contributor"]: r["count"] for r in whole.kept.where("contributor is not null").groupBy("contributor").count().collect()}
    again.save(f"{tmp_path}/next")
    assert capping.CapState.load(spark, f"{tmp_path}/next").kept.count() == whole.kept.count()


def test_cap_nulls(spark):
    d = spark.createDataFrame([("a", None, "x", 1), ("a", 5, "y", 2), ("a", 1, None, 1), (None, None, "z", None)], "contributor string, score int, id string, piece int").withColumn("rank", F.lit(1))
    s = capping.cap_contributors(d, 1, 2)
    assert {r.id for r in s.displaced.collect()} == {"x"} and {r.id for r in s.kept.collect()} == {"y", "z"}


def test_cap_empty(spark):
    s = capping.cap_contributors(spark.createDataFrame([], "contributor string, score int, id string, piece int"), 3)
    assert s.kept.count() == 0 and s.displaced.count() == 0


LIST = [(1, "trielville clarion", "Trielville", "Montana"), (2, "klielford evening reporter", "Klielford", "Iowa"), (3, "wrontow junction clarion", "Wrontow Junction", "Alabama"), (4, "klielford morning reporter", "Klielford", "Iowa")]
ART = "article_id string, publication string, publication_raw string, lccn string, legibility string, piece_no int, arrived_at timestamp"


def article(i, raw, pub, lccn, leg="Legible", piece=1):
    return (i, pub, raw, lccn, leg, piece, T0)


def test_newspapers(spark):
    tl = spark.createDataFrame(LIST, "title_id int, publication string, place string, state string")
    rows = [article(f"a{i}", "Trielville Clarion", "trielville clarion", ["xn1", "XN 1", "lccn:xn1", "xn-1"][i % 4], [" LEGIBLE", "questionable ", "x", None][i % 4]) for i in range(8)]
    rows += [article("b0", "The Trielvlle Clarion", "the trielvlle clarion", None), article("b1", "microfilm box", "microfilm box", ""), article("b1", "microfilm box", "microfilm box", "", piece=3), article(None, "x", "x", "xn9")]
    r = {x.id: x for x in capping.newspaper_records(spark.createDataFrame(rows, ART), tl).collect()}
    assert {r[f"a{i}"].contributor for i in range(8)} == {"xn1"} and r["b0"].contributor == "xn1" and r["b1"].contributor is None and len(r) == 10
    assert [r[f"a{i}"].score for i in range(4)] == [0, 1, 2, 2]
    s = capping.capped_newspapers(spark.createDataFrame(rows, ART), tl, share=0.5)
    assert {x.id for x in s.displaced.collect()} == {"a2", "a3", "a6", "a7"}


def test_titles(spark):
    tl = spark.createDataFrame(LIST, "title_id int, publication string, place string, state string").withColumn("raw", F.lit("clash"))
    cases = {
        "Trielville Clarion. [volume] (Trielville, Mont.) 1858-current": 1, "TRIELVILLE CLARI0N": 1, "Th eTrielville Clarion": 1, "Clarion, Trielville": 1, "The Clarion of Trielville": 1, "Clarion [Trielville]": 1, "Clarion (Trielville, Mont.)": 1,
        "Trielville, Mont., Clarion": 1, "Klielford Evening Report": 2, "KlielfordEveningReporter": 2, "Klielford Morning Reporter -- final": 4, "Kliel. Evening Reporter": 2, "Wront. Clarion": 3, "Wrontow Junctoin Clraion": 3, "Teh Klielford Evenig Reproter": 2, "Klielford Evening Rep'r": 2, "Klielford Morning Rep.": 4, "Kleil. Evening Reporter": 2, "Kliel. Mroning Reporter": 4, "see microfilm box": -1, "": -1, "?": -1,
        "Trielville Herald": -1,
    }
    d = spark.createDataFrame([(k,) for k in cases] * 2, "raw string")
    got = {r.raw: r.title_id for r in titles.match_titles(d, tl).collect()}
    assert got == cases
    assert titles.match_titles(d.limit(0), tl).count() == 0
    assert {r.title_id for r in titles.match_titles(d, tl.limit(0)).collect()} == {-1}


def test_short_names(spark):
    tl = spark.createDataFrame([(1, "sun", "Elm", "Iowa"), (2, "times", None, None)], "title_id int, publication string, place string, state string")
    cases = {"The Sun": 1, "SUN": 1, "Sum": -1, "times": 2, "": -1}
    got = {r.raw: r.title_id for r in titles.match_titles(spark.createDataFrame([(k,) for k in cases], "raw string"), tl).collect()}
    assert got == cases


def test_pigeonhole_is_complete(spark):
    r = random.Random(4)
    forms = ["".join(r.choice("abcd") for _ in range(r.randrange(6, 24))) for _ in range(60)]
    canon = spark.createDataFrame([(i, f, None, None) for i, f in enumerate(dict.fromkeys(forms))], "title_id int, publication string, place string, state string")

    def edit(s):
        s = list(s)
        for _ in range(r.randrange(5)):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice([[], [r.choice("abcd")], [s[k], r.choice("abcd")]])
        return "".join(s)

    left = [edit(f) for f in forms]
    left = [x for x in dict.fromkeys(left) if len(x) >= 5]
    d = spark.createDataFrame([(x, x) for x in left], "raw string, s string")
    got = {(x.raw, x.form) for x in titles.pigeonhole_pairs(d, titles.canon_forms(canon)).collect()}

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    k = lambda n: 4 if n >= 16 else 3 if n >= 12 else 2 if n >= 9 else 1 if n >= 6 else 0
    assert got == {(a, b) for a in left for b in set(forms) if lev(a, b) <= k(len(b))}


def test_unlisted_newspapers(spark):
    tl = spark.createDataFrame(LIST, "title_id int, publication string, place string, state string")
    a = spark.createDataFrame([article(f"x{i}", "Elmow Beacon (Elmow, Ia.)", "elmow beacon", "xn7") for i in range(3)] + [article("y", "Trielville Clarion", "trielville clarion", "xn1")], ART)
    k = {r.publication: r for r in titles.known_newspapers(a, tl).collect()}
    assert k["elmow beacon"].title_id == -1 and k["elmow beacon"].place == "elmow" and k["trielville clarion"].lccn == "xn1" and len(k) == 5


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 256, 1000, 4097])
def test_permutation(n):
    for seed in (0, 5):
        got = sampling.permute(np.arange(n), n, seed)
        assert sorted(got.tolist()) == list(range(n))
    if n > 16:
        assert (sampling.permute(np.arange(n), n, 1) != sampling.permute(np.arange(n), n, 2)).any()


def test_sample(spark):
    rows = [(f"k{i % 200}" if i else None, i % 7, T0 + dt.timedelta(days=i), "x") for i in range(500)]
    d = spark.createDataFrame(rows, "article_id string, year int, arrived_at timestamp, position string")
    s = sampling.sample_rows(d, "article_id", 50, "arrived_at")
    got = s.collect()
    assert len({r.article_id for r in got}) == 50 and sorted(r.position for r in got) == list(range(50))
    assert {r.article_id for r in sampling.fixed_sample(d.orderBy(F.rand(1)).repartition(7), "article_id", 50).collect()} == {r.article_id for r in got}
    assert sampling.fixed_sample(d, "article_id", 10**6).count() == 200
    assert sampling.fixed_sample(d.limit(0), "article_id", 5).count() == 0 and sampling.fixed_sample(d, "article_id", 0).count() == 0
    first = min(r[2] for r in rows if r[0] == got[0].article_id)
    assert got[0].arrived_at == first


def test_sample_is_uniform():
    hits = np.zeros(60)
    for seed in range(2000):
        hits += sampling.permute(np.arange(60), 60, seed) < 6
    assert abs(hits.mean() - 200) < 1e-9 and hits.std() < 25 and 120 < hits.min() and hits.max() < 290


def test_complete_is_optimal():
    r = random.Random(1)
    for _ in range(200):
        sizes = sorted(r.randrange(1, 40) for _ in range(r.randrange(1, 10)))
        room = r.randrange(0, 90)
        best = max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room)
        got = packing.complete(sizes, room, 10**6)
        assert len(set(got)) == len(got) and sum(sizes[i] for i in got) == best


def test_pack():
    r = random.Random(2)
    items = [(i, r.randrange(0, 101)) for i in range(400)]
    boxes = packing.pack(items, 100)
    assert sorted(x for b in boxes for x in b) == sorted(items) and all(sum(s for _, s in b) <= 100 for b in boxes)
    assert len(boxes) <= sum(s for _, s in items) / 100 * 1.05 + 1
    assert packing.pack([], 10) == [] and packing.pack([(1, 0)], 10) == [[(1, 0)]]


def test_pack_branches():
    """Here the fullest filling around the largest item costs a container; another one must be tried."""
    for sizes in ([6, 9, 15, 20, 20, 24, 26, 27, 29], [6, 12, 13, 17, 23, 24, 24, 27, 28], [7, 9, 15, 21, 22, 24, 25, 28, 29]):
        boxes = packing.pack(list(enumerate(sizes)), 60)
        assert len(boxes) == packing.least_containers(sizes, 60) == 3 and sorted(x for b in boxes for x in b) == list(enumerate(sizes)) and all(sum(s for _, s in b) <= 60 for b in boxes)
    for f in packing.fillings([5, 6, 10, 12, 20], 26):
        left = 26 - sum([5, 6, 10, 12, 20][j] for j in f)
        assert left >= 0 and not any(v < s <= v + left for v in [0, *([5, 6, 10, 12, 20][j] for j in f)] for i, s in enumerate([5, 6, 10, 12, 20]) if i not in f)
    assert packing.least_containers([40, 60, 60, 60], 100) == 3 and packing.least_containers([], 100) == 0


def test_pack_is_optimal_on_small_instances():
    """Against every partition of up to seven documents."""
    r = random.Random(5)

    def fewest(sizes, cap):
        boxes = [[]]
        best = [len(sizes)]

        def place(k, boxes):
            if len(boxes) >= best[0] and k < len(sizes):
                return
            if k == len(sizes):
                best[0] = min(best[0], len(boxes))
                return
            for i in range(len(boxes)):
                if sum(boxes[i]) + sizes[k] <= cap:
                    place(k + 1, [*boxes[:i], [*boxes[i], sizes[k]], *boxes[i + 1 :]])
            place(k + 1, [*boxes, [sizes[k]]])

        place(0, boxes[:0])
        return best[0]

    for _ in range(150):
        cap = r.randrange(20, 60)
        sizes = sorted(r.randrange(1, cap + 1) for _ in range(r.randrange(1, 8)))
        assert len(packing.bin_completion(sizes, cap, 10**6, 10**6)) == fewest(sizes, cap)


def test_pack_documents(spark):
    texts = ["", None, "one", "word " * 50, "word " * 700, "a b c", "a b c"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tokens string")
    sizes = spark.createDataFrame([("s", 64), ("bad", 0), ("s", 64), ("none", None)], "size_name string, capacity_tokens int")
    got = packing.pack_documents(d, sizes).collect()
    enc = encoding()
    for i, t in enumerate(texts):
        parts = [r for r in got if r.doc_id == i]
        n = len(enc.encode_ordinary(t)) if t else 0
        assert sum(r.tokens for r in parts) == n and (len(parts) == 1 or n > 64)
    load = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.tokens
    assert max(load.values()) <= 64
    assert packing.pack_documents(d.limit(0), sizes).count() == 0
    report = packing.packing_report(packing.pack_documents(d, sizes, steps=5000, nodes=5000)).first()
    assert report.tokens == sum(len(enc.encode_ordinary(t)) for t in texts if t) and report.gap == report.containers - report.lower_bound >= 0


def test_token_counts(spark):
    d = spark.createDataFrame([("héllo wörld",), (None,), ("",), ("<|endoftext|>",)], "t string")
    assert [r.n for r in d.select(token_count(F.col("t")).alias("n")).collect()] == [len(encoding().encode_ordinary("héllo wörld")), 0, 0, len(encoding().encode_ordinary("<|endoftext|>"))]


def test_water_fill():
    assert mixing.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, 100) == {"a": 10, "b": 90}
    assert mixing.water_fill({"a": 0.5, "b": 0.5, "c": 1.0}, {"a": 10, "b": 20}, 100) == {"a": 10, "b": 20, "c": 0}
    assert mixing.water_fill({"a": 0.0}, {"a": 5}, 10) == {"a": 0}


def test_split_is_exact():
    have = {"a": 103, "b": 7, "c": 0}
    for n in (1, 2, 5, 16):
        parts = mixing.split_blocks(have, n, 3)
        assert len(parts) == n and {s: sum(p[s] for p in parts) for s in have} == have
        assert max(sum(p.values()) for p in parts) - min(sum(p.values()) for p in parts) <= max(2, n.bit_length())


def test_mix(spark):
    r = random.Random(3)
    docs = [(i, "word " * r.randrange(1, 40), s) for i, s in enumerate(["a"] * 400 + ["b"] * 40 + [None] * 5 + ["other"] * 20)] + [(9999, None, "a"), (9998, "", "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("missing", 0.2, 2), ("a", 0.9, 9), (None, 0.3, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    m, rep = mixing.mix_sources(d, t, total=6000, shards=5, block_docs=8)
    rows, report = m.collect(), {x.source: x for x in rep.collect()}
    assert set(report) == {"a", "b", "missing", "zero"} and report["missing"].uses == 0
    uses = {}
    for x in rows:
        uses.setdefault(x.doc_id, []).append(x.use)
    assert all(sorted(u) == list(range(len(u))) for u in uses.values())
    assert max(len(u) for k, u in uses.items() if k < 400) == 1 and max(len(u) for k, u in uses.items() if 400 <= k < 440) <= 3
    assert {x.source for x in rows} == {"a", "b"} and abs(report["a"].mixed_tokens - report["a"].wanted_tokens) <= 40
    for s in {x.shard for x in rows}:
        assert sorted(x.position for x in rows if x.shard == s) == list(range(sum(x.shard == s for x in rows)))
    assert sorted(map(tuple, mixing.mix_sources(d.repartition(3), t, total=6000, shards=5, block_docs=8)[0].collect())) == sorted(map(tuple, rows))
    none, rep0 = mixing.mix_sources(d.limit(0), t)
    assert none.count() == 0 and {x.uses for x in rep0.collect()} == {0}
