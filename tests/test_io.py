import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.operators import duplicates, frame, models
from broadsheet.sources import readers, sinks
from broadsheet.streaming import articles as streams


def scan(**kw):
    base = {
        "lccn": {"title": "Elmow beacon. [volume] (Elmow, Ia.) 1871-1944", "lccn": "sn1", "state": "IA"}, "edition": {"date": "1930-05-01", "edition": "ed-1"}, "page_number": "na", "scan_url": "u1",
        "bboxes": [{"id": 1, "legibility": "Legible"}, {"id": 2, "legibility": "Illegible"}],
        "full articles": [
            {"object_ids": [1], "article": "x" * 300, "headline": " A  b ", "byline": None, "full_article_id": "1"}, {"object_ids": [2], "article": "y" * 300, "full_article_id": "2"},
            {"object_ids": [1], "article": "short", "full_article_id": "3"},
        ],
    }
    return json.dumps(base | kw)


def test_parse_scan(spark):
    rows = [("d/1930-05-01_p7_sn1_1.json", scan()), ("weird.json", "{not json"), ("nodate_p1_.json", scan(edition={"date": "n/a"})), ("none_p1_.json", None)]
    got = readers.parse_scans(spark.createDataFrame(rows, "m string, p string"), "m", "p", license_text="CC0").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.page_number, r.year, r.publication, r.legibility, r.headline, r.n_words, r.license) == (7, 1930, "elmow beacon", "Legible", "A b", 1, "CC0")
    import hashlib

    assert r.article_id == "as1-" + hashlib.sha1(b"u1::1").hexdigest()[:16]


def test_tar_members(spark, tmp_path):
    p = tmp_path / "a.tar.gz"
    with tarfile.open(p, "w:gz") as t:
        for i in range(3):
            data = scan().encode()
            info = tarfile.TarInfo(f"x/1930-05-01_p{i}_sn_{i}.json")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    d = readers.read_tar_members(spark, str(p))
    assert d.count() == 3
    assert readers.read_tar_members(spark, str(p), max_bytes=40).count() == 0
    (tmp_path / "broken.tar.gz").write_bytes(p.read_bytes()[:60])
    with pytest.raises(Exception, match=r"EOF|[Ee]nd|truncat"):
        readers.read_tar_members(spark, f"{tmp_path}/broken.tar.gz").count()
    assert readers.parse_scans(d, "member", "payload").count() == 3


def test_fetch_year(spark, tmp_path):
    from broadsheet.sources import fetch

    with tarfile.open(tmp_path / "y.tar.gz", "w:gz") as t:
        for i in range(6):
            data = scan(scan_url=f"u{i}", edition={"date": "1931-05-01" if i == 5 else "1930-05-01", "edition": "e"}).encode()
            info = tarfile.TarInfo(f"x/1930-05-01_p{i}_sn_{i}.json")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    m = fetch.fetch_year(spark, f"{tmp_path}/y.tar.gz", 1930, 3, f"{tmp_path}/out").first()
    assert (m.year, m.quota, m.scans_read, m.scans_kept, m.n_articles, m.n_chars) == (1930, 3, 5, 3, 3, 900) and m.key == fetch.request_key(1930, 3)
    assert spark.read.json(f"{tmp_path}/out/articles/1930").count() == 3
    (tmp_path / "y.tar.gz").unlink()  # the same request is not read again, another one is
    assert fetch.fetch_year(spark, f"{tmp_path}/y.tar.gz", 1930, 3, f"{tmp_path}/out").first() == m
    with pytest.raises(Exception, match="no archive"):
        fetch.fetch_year(spark, f"{tmp_path}/y.tar.gz", 1930, 4, f"{tmp_path}/out").first()


def test_labels(spark):
    lines = spark.createDataFrame([("1|y|F|AC|n|3|a|b note",), ("",), ("2|n|U|-|n|1|",), ("2|n|U|-|n|1|",)], "value string")
    got = readers.parse_labels(lines, F.col("value"), {"A": "ARTS_SPORTS", "C": "CIVIC"})
    r = got.orderBy("n").first()
    assert (r.is_person, r.gender_text, r.roles, r.quoted, r.confidence, r.notes) == ("yes", "F", ["ARTS_SPORTS", "CIVIC"], "no", 3, "a|b note")
    assert readers.repeated_labels(got).first().n == 2


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 1900, float("nan")), (2, "b", 1903, 1.234567)], "id int, t string, year int, x double")
    sinks.write_stage(d, f"{tmp_path}/s", "id")
    assert spark.read.parquet(f"{tmp_path}/s").where("year = 1900").count() == 1
    sinks.write_jsonl(d.drop("x"), f"{tmp_path}/j")
    assert readers.read_articles(spark, f"{tmp_path}/j").where("year = 1903").count() == 1
    pruned = readers.read_articles(spark, f"{tmp_path}/j", [1903])
    assert pruned.count() == 1 and "_p" not in pruned.columns and "PartitionFilters: [_p" in pruned._jdf.queryExecution().executedPlan().toString().replace("isnotnull(_p#", "[_p#").replace("[[", "[")
    sinks.write_csv(d, f"{tmp_path}/c")
    assert readers.read_table_csv(spark, f"{tmp_path}/c").where("id = '2'").first().t == "b"
    sinks.write_text(d, f"{tmp_path}/x", F.concat_ws("|", "id", "t"))
    assert {r.value for r in spark.read.text(f"{tmp_path}/x").collect()} == {"1|a", "2|b"}
    (tmp_path / "r.jsonl").write_text('{"entity_id": "a", "parse_ok": true}\n\n{"entity_id": "b", "parse_ok": false}\n')
    assert [r.entity_id for r in readers.read_replies(spark, f"{tmp_path}/r.jsonl", "entity_id string, parse_ok boolean").collect()] == ["a"]
    import hashlib

    (tmp_path / "big.bin").write_bytes(b"ab" * (1 << 20))
    assert sinks.file_hashes(spark, str(tmp_path), "big.bin").first().sha256 == hashlib.sha256(b"ab" * (1 << 20)).hexdigest()
    assert sinks.append_missing(d, f"{tmp_path}/p", "id") == 2
    assert sinks.append_missing(d.union(d.select(F.lit(3), "t", "year", "x").limit(1)), f"{tmp_path}/p", "id") == 1
    assert sinks.export_json(d, f"{tmp_path}/r.json") == 2
    assert json.load(open(f"{tmp_path}/r.json"))[0]["x"] is None
    a = sinks.content_hash(d, ["year"]).collect()
    assert sorted(a) == sorted(sinks.content_hash(d.orderBy(F.desc("id")), ["year"]).collect())
    assert sinks.folder_hash(spark, f"{tmp_path}/p").first().files >= 1
    assert sinks.folder_hash(spark, f"{tmp_path}/p").first().digest == sinks.folder_hash(spark, f"{tmp_path}/p").first().digest
    (tmp_path / "lex.txt").write_text("Walk\n\nthe \nThe\n")
    assert {r.word for r in readers.read_lexicon(spark, f"{tmp_path}/lex.txt").collect()} == {"walk", "the"}
    assert readers.target_years({"tiers": {"s": {"years": {"start": 1900, "stop": 1906, "step": 3}}}}, "s") == [1900, 1903, 1906]


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark woods tonight"
    rows = [("a", base, 1900), ("b", base.upper() + "!!", 1900), ("c", base.replace("lazy", "sleepy"), 1900), ("d", "something else entirely is written here", 1900), ("e", base, 1903), ("f", "", 1900), ("g", None, 1900)]
    d = spark.createDataFrame(rows, "id string, t string, y int")
    g = {r.id: r for r in duplicates.near_groups(d, "id", "t", "y", 0.5).collect()}
    assert g["a"].exact_group == g["b"].exact_group == "a" and g["a"].near_group == g["c"].near_group == "a" and g["d"].near_group == "d" and g["e"].near_group == "e"
    flags = {r.id: r for r in duplicates.dup_flags(duplicates.near_groups(d, "id", "t", "y", 0.5), "near_group", [F.col("id")], "near").collect()}
    assert not flags["a"].near_dup and flags["c"].near_dup and flags["a"].near_size == 3
    empty = d.limit(0)
    assert duplicates.near_groups(empty, "id", "t", "y").count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101)], "a int, b int")
    got = {r.node: r.label for r in duplicates.components(e).collect()}
    assert set(got.values()) == {1, 100} and len(got) == 32


def test_frame(spark):
    rows = [("e1", "a", ["mrs"], ["CIVIC"], None, "F", "UNKNOWN", "F", 1, 0, 0), ("e2", "a", ["capt", "mrs"], [], ["MILITARY"], "F", "F", "F", 0, 1, 0)]
    e = spark.createDataFrame(rows, "entity_id string, article_id string, titles array<string>, roles_a array<string>, roles_b array<string>, gender_h string, gender_hp string, gender_hpn string, n_ner_mentions int, n_quotes_name int, n_quotes_pron int")
    meta = spark.createDataFrame([("a", 1921, 3, "Legible", 0.8, "evening star")], "article_id string, year int, page_number int, legibility string, dict_rate double, publication string")
    topics = spark.createDataFrame([("a", 1)], "article_id string, topic int")
    dim = spark.createDataFrame([(2, "x", "Y", False)], "topic int, label string, section string, is_news boolean")
    f = {r.entity_id: r for r in frame.derive(frame.star_join(e, meta, topics, dim)).collect()}
    assert f["e1"].f_h == 1.0 and f["e2"].f_h is None and f["e2"].f_h_v2 == 1.0 and f["e1"].section == "OTHER" and f["e1"].is_news and f["e1"].period == "1918-30"
    assert f["e1"].ner_ok and not f["e2"].ner_ok and f["e1"].ocr_clean and f["e1"].evening_star and f["e2"].quoted_name and f["e1"].A_CIVIC and f["e2"].B_MILITARY


def test_stream_dedup(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    d = spark.createDataFrame([("a", "A b", t), ("b", "a  b", t), ("c", "c", t)], "article_id string, text string, arrived_at timestamp")
    d.write.parquet(f"{tmp_path}/in")
    s = streams.deduplicated_stream(streams.file_stream(spark, f"{tmp_path}/in", d))
    assert streams._run(s, "append").count() == 2


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"{'senator' if i % 2 == 0 else 'baker'} w{i % 7} spoke", float(i % 2 == 0), 0.0) for i in range(80)]
    d = spark.createDataFrame(rows, "id int, text string, office double, never double")
    r = models.crossfit(d, "id", ["office", "never"], models.bow_stages, k=4).groupBy("office").agg(F.avg("p_office").alias("p"), F.max("p_never").alias("n")).collect()
    p = {x.office: x for x in r}
    assert p[1.0].p > 0.7 and p[0.0].p < 0.3 and p[1.0].n == 0
    c = rng.random((6, 6))
    from itertools import permutations

    best = min(permutations(range(6)), key=lambda q: sum(c[i, q[i]] for i in range(6)))
    assert list(models.assignment(c)) == list(best)
    a = rng.random((4, 9))
    s, m = models.topic_stability(a, a[[2, 0, 3, 1]])
    assert abs(s - 1) < 1e-12 and list(m) == [1, 3, 0, 2]
    t = spark.createDataFrame([(i, w, 1.0) for i in range(20) for w in (("x", "y") if i % 2 else ("u", "v"))], "d int, w string, s double")
    docs, terms = models.nmf(t, "d", "w", "s", k=2, rounds=20)
    top = docs.groupBy("d").agg(F.max_by("topic", "weight").alias("t")).collect()
    assert len({x.t for x in top if x.d % 2}) == 1 and {x.t for x in top if x.d % 2} != {x.t for x in top if not x.d % 2}


def test_plug_ins(spark):
    d = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    got = models.pooled_embeddings(d, "t", lambda: lambda xs: np.array([[len(x), 1.0] for x in xs])).orderBy("id").collect()
    assert got[0].embedding == [2.0, 1.0] and got[1].embedding == [0.0, 1.0]

    def ask():
        def f(p):
            if p == "ab":
                return "{}"
            raise OSError("429")

        return f

    r = {x.id: x for x in models.label_replies(d, "id", "t", ask, tries=2, wait=0.0).collect()}
    assert r[1].raw == "{}" and r[1].error is None and r[2].raw is None and "429" in r[2].error and r[2].tries == 2


def test_plans_push_down(spark, data):
    from broadsheet.plans.registry import QUERIES

    plan = QUERIES["yearly_share"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "PushedFilters" in plan and "BatchEvalPython" not in plan and "CartesianProduct" not in plan


def test_similar_pairs_equal_direct_comparison(spark):
    import random

    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(30)] for _ in range(6)]
    texts = [" ".join(w if rng.random() > 0.03 else "zz" for w in rng.choice(base)[: rng.randint(2, 30)]) for _ in range(80)]
    # fourteen shingles of 25: a similarity of 0.56, whose product with 25 is more than fourteen by rounding
    words = [f"w{i}" for i in range(29)]
    texts += [" ".join(words), " ".join(words[:18]), "", "!"]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.strip("! ") else set()
    sets = [grams(t) for t in texts]
    d = spark.createDataFrame([(i, t, 1900) for i, t in enumerate(texts)], "id int, t string, y int")
    for threshold in (0.56, 0.8):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
        assert {(r.a, r.b) for r in duplicates.similar_pairs(d, "id", "t", "y", threshold).collect()} == want
        assert (threshold == 0.56) == ((80, 81) in want)


def test_few_texts_are_compared(spark):
    """Of unlike texts no shingle is moved after the count."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), 1900) for i in range(50)]
    rows.append((50, rows[7][1] + " more", 1900))
    d = spark.createDataFrame(rows, "id int, t string, y int")
    assert {r.id for r in duplicates._paired(d, "id", "t", "y", 0.8, 5).collect()} == {7, 50}


def test_texts_without_tokens_are_near_to_none(spark):
    d = spark.createDataFrame([("a", "", 1900), ("b", None, 1900), ("c", "!!", 1900), ("d", "one text", None), ("e", "one text", None), ("f", "one text", 1900), ("g", "One text.", 1900)], "id string, t string, y int")
    g = {r.id: r for r in duplicates.near_groups(d, "id", "t", "y").collect()}
    assert {k: r.near_group for k, r in g.items()} == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "e", "f": "f", "g": "f"}
