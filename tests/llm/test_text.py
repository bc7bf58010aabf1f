"""Subjects, prose rules, near duplicates, page repair and residue on small and hard inputs."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import neardup, pagescan, prose, residue, subjects

PROSE = "The committee of the town met on Tuesday and it was said by the chairman that the work on the bridge would not be done before the end of the year."


def test_prose(spark):
    cases = {
        "prose": (PROSE, True), "caps": (PROSE.upper(), True), "german": ("Der Bürgermeister sprach vor der Versammlung in der Kirche und alle hörten zu, als er von dem Feuer in der Stadt sprach.", True),
        "table": ("Wheat 1.20 3.40\nCorn 2.20 0.45\nOats 0.33 1.10\nRye 4.10 2.20\nHogs 9.99 4.11", False), "names": ("Mrs. A. Bell, Miss Cora Dunn, Mr. E. Fox, Miss Gale Hart, Mrs. I. Jones, Mr. K. Lamb, Miss M. North", False),
        "other": ("Le maire a dit hier que les élèves de la ville et des villages voisins seront reçus en fête.", True), "dots": ("The end of the line with the men and...\nthe start of the next that have...\nmore of it to be read", False), "junk": ("|I+\\•° ,i~l< i_,f~: \\¶lt +\\f\\~«. {@~= ~ t^ ~; ]~ '|+>", False), "loop": ("of the town sixty-five " * 30, False), "empty": ("", False), "null": (None, False),
        "mixed": (PROSE + " " + PROSE + "\nWheat 1.20 3.40\nCorn 2.20 0.45", True),
    }
    d = spark.createDataFrame([(k, t, 5) for k, (t, _) in cases.items()], "id string, text string, n_words int").withColumn("stats", F.lit("kept"))
    out = {r.id: r for r in prose.prose_rules(prose.text_statistics(d)).collect()}
    assert {k: out[k].is_prose for k in cases} == {k: w for k, (_, w) in cases.items()}
    assert out["null"].reasons == ["no_words"] and out["null"].n_words == 0 and out["prose"].stats == "kept" and out["prose"].n_words == len(re.findall(r"[^\W\d_]+", PROSE))
    assert out["loop"].reasons == ["repetition"] and out["dots"].reasons == ["ellipses"] and "stop_words" in out["names"].reasons and out["table"].line_reasons == ["punctuation", "short_lines"] and out["prose"].archive_reasons == []
    loose = {r.id: r for r in prose.prose_rules(prose.text_statistics(d), {"document": {"min_stop_words": 0}}).collect()}
    assert loose["names"].is_prose and not loose["loop"].is_prose
    assert prose.prose_rules(prose.text_statistics(d.limit(0))).count() == 0
    huge = spark.createDataFrame([("x", PROSE * 5000)], "id string, text string")
    assert prose.prose_rules(prose.text_statistics(huge)).first().n_chars == len(PROSE) * 5000


def brute(rows, k, t):
    sets = {}
    for i, x in rows:
        w = re.findall("[a-z0-9]+", (x or "").lower())
        if i is not None and w:
            sets[i] = {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed=0, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        base = [r.choice(words) for _ in range(r.randrange(40, 90))]
        for c in range(r.choice([1, 1, 2, 4])):
            x = base[:]
            for _ in range(r.randrange(0, 9)):
                x[r.randrange(len(x))] = r.choice(words)
            rows.append((f"d{i:04d}-{c}", " ".join(x)))
    return rows


@pytest.mark.parametrize(("k", "t"), [(3, 0.6), (5, 0.8)])
def test_near_duplicates(spark, k, t, monkeypatch):
    rows = corpus() + [("e1", ""), ("e2", None), ("s1", "just two"), ("s2", "Just, TWO!"), (None, "just two")]
    rows += [("d0000-0", rows[0][1])]  # a repeated delivery
    d = spark.createDataFrame(rows, "id string, text string").withColumn("rep", F.lit("clash"))
    want = brute(rows, k, t)
    got = {(r.a, r.b) for r in neardup.near_duplicate_pairs(d, "id", "text", k, t).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and ("s1", "s2") in got
    monkeypatch.setattr(neardup, "HOT_CELL", 2)  # every cell is split into blocks
    monkeypatch.setattr(neardup, "COPY_BLOCK", 1)
    monkeypatch.setattr(neardup, "HELD_ROWS", 7)  # and searched in small pieces
    assert {(r.a, r.b) for r in neardup.near_duplicate_pairs(d, "id", "text", k, t).collect()} == got
    classes = {r.id: r for r in neardup.near_duplicate_classes(d, "id", "text", k, t).collect()}
    assert len(classes) == len({i for i, x in rows if i and x})
    for a, b in got:
        assert classes[a].group == classes[b].group
    assert classes["s2"].copies_group == "s1" and classes["s1"].links == 0
    assert neardup.near_duplicate_classes(d.limit(0), "id", "text").count() == 0


def test_hot_group(spark):
    r = random.Random(1)
    rows = [(f"x{i}", PROSE) for i in range(400)] + [(f"y{i}", PROSE.replace("Tuesday", r.choice(["Monday", "Friday", "Sunday"]))) for i in range(200)] + corpus(3, 300)
    c = {x.id: x for x in neardup.near_duplicate_classes(spark.createDataFrame(rows, "id string, text string"), "id", "text", 3, 0.6).collect()}
    assert len({c[f"x{i}"].group for i in range(400)} | {c[f"y{i}"].group for i in range(200)}) == 1 and c["x7"].copies_group == "x0" and c["x7"].links == 3


def test_gray_index():
    import numpy as np

    rng = np.random.default_rng(0)
    code = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
    code[150:] = code[:150] ^ (np.uint64(1) << rng.integers(0, 63, (150, 2)).astype(np.uint64))
    group = np.sort(rng.integers(0, 5, 300))
    for bound in (0, 2, 30, 60):
        got = {tuple(sorted(p)) for i, j in neardup.GrayIndex(group, code).pairs(bound, 37) for p in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and sum(bin(int(x)).count("1") for x in code[i] ^ code[j]) <= bound}
        assert got == want
    r = neardup.gray_rank(np.array([[0, g ^ (g >> 1)] for g in range(64)], dtype=np.uint64))
    assert r[:, 1].tolist() == list(range(64))


SENT = ["the train ran along the river to the old station", "people walked down to the market before the rain", "every member of the party was present for the dinner", "an old-fashioned stove was sold in the market place"]


def test_pages(spark):
    base = [(f"b{i}", " ".join(SENT) + ". " + PROSE, None, "elmow beacon") for i in range(60)]
    page = "the train ran along the ri-\nver (the wide one) to the old sta­\ntion, people wal- ked down\nTHE ELMOW BEACON, FRIDAY, MARCH 16, 1906.\nto the rnarket before the\n(3)\nrain, an old-\nfashioned stove and a two- or three-room pla(e"
    rows = base + [("p", page, "Peo- ple walked", "elmow beacon"), ("t", "Ward 1 . 12 34\nWard 2 . 33 91\n3\n4", None, None), ("j", "xq zzk vvr-\nqq jjx kkw pqq zxx wrr mmk vvx qrz", None, None), ("n", None, None, None), ("e", "", "", ""), (None, "x", None, None)]
    d = spark.createDataFrame(rows, "article_id string, text string, headline string, publication string").withColumn("traces", F.lit(1))
    out = {r.article_id: r for r in pagescan.repair_pages(d).collect()}
    got = {(t.kind, t.piece) for t in out["p"].traces}
    assert got == {("break", "river"), ("break", "station"), ("break", "walked"), ("break", "people"), ("break", "old-fashioned"), ("glyph", "market"), ("glyph", "place"), ("header", "THE ELMOW BEACON, FRIDAY, MARCH 16, 1906."), ("folio", "(3)")}
    assert out["p"].text == "the train ran along the river (the wide one) to the old station, people walked down to the market before the rain, an old-fashioned stove and a two- or three-room place"
    assert out["p"].headline == "People walked" and out["n"].text == "" and out["j"].traces == [] and out["j"].text == rows[-4][1] and None not in out
    assert len(pagescan.page_traces(d.union(d)).where("article_id = 'p'").collect()) == len(got)
    assert pagescan.page_traces(d.limit(0)).count() == 0


def test_heads_of_any_form(spark):
    """Heads with misread capitals, or of no listed form, are found by their likeness to the title or to repeated lines."""
    text = " ".join(SENT) + ".\n{}\n" + PROSE
    heads = ["5    THE ELMOW EVEN1NG BEACON", "ELMOW EVENING BEACON   P4GE 1", "P4GE 15.  QUILFIELD, MINN.  1939", "Elmow Evening Beacon -- July 16, 1954", "3 THE ELMOW EVENING BEAC0N"]
    other = ["Elmow Junction   263", "PRICES OF GRAIN   12", "ELMOW, Jan. 5", "The beacon of Elmow was lit", "Quilfield, Minn."]
    rows = [(f"b{i}", text.format("PAGE 3.  QUILFIELD, MINN.  1939"), None, "elmow evening beacon") for i in range(20)]
    rows += [(f"h{i}", text.format(x), None, "elmow evening baecon") for i, x in enumerate(heads)] + [(f"o{i}", text.format(x), None, "elmow evening beacon") for i, x in enumerate(other)]
    rows += [("untitled", text.format("7    THE ELM0W EVENING BEACON"), None, None)]
    got = pagescan.page_traces(spark.createDataFrame(rows, "article_id string, text string, headline string, publication string")).where("kind = 'header'").collect()
    assert {(r.article_id, r.piece) for r in got if r.article_id[0] != "b"} == {(f"h{i}", x) for i, x in enumerate(heads)} | {("untitled", "7    THE ELM0W EVENING BEACON")}


def test_heads_need_repetition(spark):
    """Without the names that repeat over the corpus no head is found; bare numbers must continue the article's pages."""
    text = " ".join(SENT) + ".\n{}\n{}\n" + PROSE
    heads = ["* * ELMOW EVENING BEACON * *", "PAGE 4.  QUILFIELD, MINN.  1939", "Quilfield, Minnesota, Friday, March 16, 1906", "12    THE QUILFIELD ARGUS"]
    rows = [(f"h{i}", text.format(heads[i % 4], n), None, ["elmow evening beacon", "quilfield argus"][i % 4 > 0], p) for i, (n, p) in enumerate([("4", 4), ("5", 4), ("44", 4), ("(44)", 4), ("7", None), ("4", "x"), ("Page Four", 9), ("4", 4)])]
    d = spark.createDataFrame(rows, "article_id string, text string, headline string, publication string, page_number string")
    got = {(r.article_id, r.kind, r.piece) for r in pagescan.page_traces(d).collect()}
    assert {x[0] for x in got if x[1] == "header"} == {r[0] for r in rows}
    assert {(x[0], x[2]) for x in got if x[1] == "folio"} == {("h0", "4"), ("h1", "5"), ("h3", "(44)"), ("h4", "7"), ("h5", "4"), ("h6", "Page Four"), ("h7", "4")}
    none = pagescan.study_corpus(d, names=spark.createDataFrame([], "name string, kind string"))
    assert pagescan.page_traces(d, none).where("kind = 'header'").count() == 0


def test_rare_words_are_counted(spark):
    """Breaks are decided by the exact counts of words far below the share of words that are broadcast."""
    filler = [(f"f{i}", (PROSE + " ") * 40, None, None) for i in range(60)]
    rows = filler + [("once", PROSE + " A quandlewick and a moss-grown stile.", None, None), ("a", PROSE + " The quandle- wick and the moss- grown wall, the nothing- else wall.", None, None), ("b", "quandle- wick " + PROSE, None, None)]
    d = spark.createDataFrame(rows, "article_id string, text string, headline string, publication string")
    c = pagescan.study_corpus(d)
    assert "quandlewick" not in c.low and len(c.low) < 60
    got = {(r.article_id, r.piece) for r in pagescan.page_traces(d, c).where("kind = 'break'").collect()}
    assert got == {("a", "quandlewick"), ("a", "moss-grown"), ("a", "nothingelse"), ("b", "quandlewick")}
    out = {r.article_id: r for r in pagescan.repair_pages(d, c).collect()}
    assert out["a"].text == PROSE + " The quandlewick and the moss-grown wall, the nothingelse wall." and len(out) == len(rows)


def test_subjects(spark, data):
    topics = {0: ["wheat", "corn", "bushel", "price"], 1: ["inning", "pitcher", "team", "score"], 2: ["bride", "wedding", "veil", "gown"]}
    r = random.Random(0)
    neutral = ["it was told in the town on monday", "some of them left before noon", "no one could explain the delay"]

    def sents(t, n):
        return [" ".join(["the", r.choice(topics[t]), "and", r.choice(topics[t]), "of", r.choice(topics[t])]) for _ in range(n)] + r.sample(neutral, 1)

    arts, labels = [], []
    for i in range(240):
        t = i % 3
        s = sents(t, 5)
        arts.append((f"a{i}", ". ".join(s) + ".", "p"))
        labels.append((f"a{i}", t if i % 20 else (t + 1) % 3))
    arts += [("two", ". ".join(sents(0, 4) + sents(1, 4)) + ".", "p"), ("some", ". ".join(sents(0, 9) + sents(1, 1)) + ".", "p"), ("none", "it was told in the town on monday. no one could explain the delay.", "p"), ("junk", "xq zzk vvr qq", None), ("null", None, None), ("two", None, "p")]
    a = spark.createDataFrame(arts, "article_id string, text string, publication string").withColumn("share", F.lit(0))
    lab = spark.createDataFrame(labels + [(None, 1), ("zz", None)], "article_id string, topic int")
    tp = spark.createDataFrame(list(topics.items()), "topic int, top_terms array<string>")
    got = {}
    for x in subjects.document_subjects(a, lab, tp).collect():
        got.setdefault(x.article_id, set()).add(x.topic)
    assert sum(got.get(f"a{i}") == {i % 3} for i in range(240)) >= 232
    assert got["two"] == {0, 1} and got["some"] == {0} and not {"none", "junk", "null"} & set(got)
    assert subjects.document_subjects(a.limit(0), lab, tp).count() == 0
    assert subjects.document_subjects(a, lab.limit(0), tp).count() == 0  # nothing learned, nothing claimed


def test_chain_order(monkeypatch):
    """The chain is decoded in the order it was trained in, the most frequent topic first, whatever the topics' numbers."""
    r = random.Random(0)
    words = {0: ["wheat", "corn", "bushel", "price"], 1: ["inning", "pitcher", "team", "score"], 2: ["bride", "wedding", "veil", "gown"]}
    docs = [(". ".join(" ".join(["the", r.choice(words[t]), "and", r.choice(words[t])]) for _ in range(5)) + ".", t, "p") for t in [2] * 60 + [1] * 20 + [0] * 40]
    seen = []
    features = subjects._features
    monkeypatch.setattr(subjects, "_features", lambda share, j, *rest: seen.append(int(j)) or features(share, j, *rest))
    model = subjects.fit_subjects(docs, words)
    trained = seen[:]
    seen.clear()
    subjects.predict(model, pa.array([d[0] for d in docs[:4]]), ["p"] * 4)
    n = len(model.order)
    assert trained[:n] == trained[n : 2 * n] == seen == [2, 0, 1]


def test_chain_is_calibrated():
    """On mixtures of documents the chain never saw, its probabilities are as often right as they say; targets are the labels."""
    import numpy as np

    r = random.Random(3)
    words = {0: ["wheat", "corn", "bushel", "price"], 1: ["inning", "pitcher", "team", "score"], 2: ["bride", "wedding", "veil", "gown"]}
    doc = lambda t: ". ".join(" ".join(["the", r.choice(words[t]), "and", r.choice(words[t if r.random() < 0.8 else (t + 1) % 3])]) for _ in range(6)) + "."
    docs = [(doc(i % 3), i % 3, "p") for i in range(300)]
    model = subjects.fit_subjects(docs[:200], words)
    d, length, seg, ids, _ = subjects._segments(pa.array([x[0] for x in docs[200:]]), model.words)
    post = subjects._posteriors(model.logp, model.prior, seg, ids, len(length))
    mixed = subjects.Mixtures(d, length, post, np.array([x[1] for x in docs[200:]]), [np.zeros(3)] * 100, 3)
    rows = mixed.draw(mixed.usable, 1500, np.random.default_rng(1))
    z, y = subjects.chain_odds(model, *rows)
    p = 1 / (1 + np.exp(-(model.scale[0] + model.scale[1] * z)))
    cell = np.minimum((p * 5).astype(int), 4)
    assert sum(abs(p[cell == c].mean() - y[cell == c].mean()) * (cell == c).mean() for c in range(5) if (cell == c).any()) < 0.05
    assert (rows[1].sum(axis=1) >= 1).all() and (subjects.decode(model, rows[0], *rows[2:])[0] == rows[1]).mean() > 0.93


def test_subjects_held_out(spark, data):
    """Fitted on half of the labels, the other half's topic is among the subjects for most articles (labels are partly wrong)."""
    d = data.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{d}/article_topics.parquet").where("topic >= 0")
    side = F.pmod(F.xxhash64("article_id"), F.lit(2))
    articles = spark.read.parquet(f"{d}/articles.parquet").join(labels.select("article_id"), "article_id", "left_semi")
    found = subjects.document_subjects(articles, labels.where(side == 0), spark.read.parquet(f"{d}/topic_labels.parquet"))
    test = labels.where(side == 1).join(found.groupBy("article_id").agg(F.collect_set("topic").alias("t")), "article_id", "left")
    r = test.agg(F.avg(F.coalesce(F.expr("array_contains(t, topic)"), F.lit(False)).cast("int")).alias("hit"), F.avg(F.size("t")).alias("n")).first()
    assert r.hit > 0.88 and r.n < 1.35


def test_residue(spark):
    cases = {
        1: ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True), 2: ("HTTP error 404 - the page was not found.", True), 3: (PROSE + " Mr. {{ article.editor }} spoke.", True), 4: ("Please allow scripting to use the page viewer.", True),
        5: (PROSE + ' Readers wrote that the words "please enable\nJavaScript" came up when opening the volumes.', False), 6: ("Room 404 of the courthouse was not found by the visitors.", False), 7: (PROSE, False), 8: (None, False), 9: ("", False),
        10: ("The form letter once carried a line of dummy type, but the printed issue was correct.", False), 11: ("Acceso denegado. Vuelva a intentarlo.", True), 12: ("This section is under construction.\n" + PROSE, True), 13: ("Query timed out after thirty s.", True),
    }
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, (t, _) in cases.items()]
    d = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string").withColumn("kinds", F.lit("clash"))
    got = [r.doc_id for r in residue.flag_residue(d).collect()]
    assert sorted(got) == [i for i, (_, w) in cases.items() if w]
    assert {r.doc_id for r in residue.clean_documents(d).collect()} == {i for i, (_, w) in cases.items() if not w}
    assert residue.flag_residue(d.limit(0)).count() == 0
    g = {r.message: r for r in residue.residue_messages(d).collect()}
    assert g["query timed out after # s."].kind == "phrase" and residue.residue_messages(d.limit(0)).count() == 0


def test_open_slots(spark):
    slots = ["{1}", "{0:d}", "{firstName}", "{ First Name }", "(your editor goes\nhere)", "(insert the price here)", "your first name goes here", "XXXX", "xxxxx", "[FIRST NAME]"]
    real = ["{.«lj ':;}", "(your readers know it)", "(enter by the side door)", "Chapter XXX", "[BY TELEGRAPH]", "[11]", "who goes here and there"]
    rows = [(i, f"Scholarships went to {x} and Miss Bell of Elmow on Friday.", "s") for i, x in enumerate(slots + real)]
    got = residue.flag_residue(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got} == set(range(len(slots))) and all(r.kinds == ["placeholder"] for r in got)


def test_weak_messages_need_sources(spark):
    m = "The scan viewer is busy, please reload."
    one = spark.createDataFrame([(1, m, "a"), (2, m, "a")], "doc_id long, text string, source string")
    two = one.unionByName(one.select(F.col("doc_id") + 10, "text", F.lit("b").alias("source")).toDF(*one.columns))
    assert residue.flag_residue(one).count() == 0 and residue.flag_residue(two).count() == 4


def test_company_of_residue(spark):
    """A message without any phrase is residue if it recurs over the sources and stands nearly always beside residue."""
    menu = "Titles | shelves | help for readers"
    rows = [(i, f"Page not found.\n\nTicket {i} was filed.\n\n{menu}", f"s{i % 3}") for i in range(8)] + [(100 + i, f"{PROSE} {i} men came. The elders voted {i} cents.", f"s{i % 3}") for i in range(8)]
    rows += [(200, f"Hier fehlt etwas {PROSE[:0]}.\n\n{menu}", "s1"), (300, PROSE + " {{name}} spoke. The elders voted 9 cents.", "s2")]
    rows += [(400 + i, f"Page not found.\n\nA copied notice stands here.{PROSE[:0]}", "s1") for i in range(9)] + [(450, "A copied notice stands here.", "s2")]  # copies count once
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kinds for r in residue.flag_residue(d).collect()}
    assert set(got) == {*range(8), 200, 300, *range(400, 409)} and got[200] == ["company"] and got[0] == ["company", "phrase"]
    lone = d.where("doc_id = 200 or doc_id >= 100 and doc_id < 200")
    assert residue.flag_residue(lone).count() == 0


def test_held_out_phrases(spark, data, monkeypatch):
    """Without the phrases for missing pages, part of their documents still comes out by the company of their messages."""
    d = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/documents.parquet")
    every = {r.doc_id for r in residue.flag_residue(d).collect()}
    for gone in (5, 7):
        left = "|".join(f"(?:{p})" for k, p in enumerate(residue.STRONG) if k != gone)
        monkeypatch.setattr(residue, "_STRONG", left)
        rules = {r.doc_id for r in residue.document_messages(d).where(F.exists("signed", lambda x: x["sign"] != "weak")).select("doc_id").collect()}
        got = {r.doc_id for r in residue.flag_residue(d).collect()}
        assert rules < got <= every and len(rules) < len(every)


def test_masks():
    x = residue.masked(residue.unquoted(pa.array(['Mr. Amos Bell of Elmow counted 1,204 on May 3 and said "no" to forty-two men at www.elm.org/x or a.b@elm.org.'])))
    assert x.to_pylist() == ["mr. amos n of n counted # on n # and said q to # men at a or a"]
    row, m = residue.cut_messages(pa.array(["One line\nbroken. Two!\n\nThree", None, ""]))
    assert [v for v in m.to_pylist() if v] == ["One line broken.", "Two!", "Three"]
