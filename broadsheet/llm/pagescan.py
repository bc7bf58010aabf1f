"""Repair text that was read from scanned pages.

Corpus pass: counts of all words, titles of all pages, and the lines that could be the head or foot of a page (short words in
capitals with a page number, a date, ornaments or a number at an edge). Page heads are found by repetition: the letters of
such a line, dates and numbers masked and digits in words read as letters, must be, but for a few edits, a name that other
pages of the corpus show too, as their title or in a line of their own. The search is an equality join on segments
(``titles.pigeonhole_pairs``) over distinct lines. Page numbers must continue the sequence of pages the article is on.

Document pass: removes heads and page numbers and lists the places where a word may be broken and the lower-case words that
may be misread. Distinct candidates are decided by joins with the counts of the whole vocabulary, however large; only
words with a share of at least ``SOLID`` of all words (at most 1 / SOLID words) and hashes of words with a share of
at least ``KNOWN`` (at most 1 / KNOWN numbers) are broadcast. Breaks are joined as the corpus writes the word, misread
words put right through known confusions if the corpus knows the corrected word far better. A last pass applies the
decisions of an article to its text, in which line ends become blanks within paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.prose import COMMON
from broadsheet.llm.titles import pigeonhole_pairs
from broadsheet.runtime import cut, lookup_join

#: A corrected word must be this many times as frequent as the misread one and have this share of all lower-case words.
RATIO, SOLID = 40, 1e-5
#: A text of eight words or more is unreadable, and left as it is, if less than ``READABLE`` of its words are known to the
#: corpus, by their share of all words and at least three times.
READABLE, KNOWN = 0.55, 1e-6
#: Shortest name, in letters, by which a head is recognised, and shortest name that may differ from the corpus by a few edits.
MIN_NAME, FUZZY_NAME = 6, 8

#: Misreadings (as read, as printed).
CONFUSIONS = [
    ("é", "e"), ("c", "e"), ("i", "r"), ("5", "s"), ("f", "t"), ("u", "a"), ("u", "n"), ("cl", "d"), ("0", "o"), ("l", "i"),
    ("vv", "w"), ("1", "l"), ("1", "i"), ("n", "u"), ("rn", "m"), ("m", "rn"), ("b", "h"), ("9", "g"), ("lc", "k"), ("6", "b"),
    ("v", "y"), ("m", "in"), ("ſ", "f"), ("ſ", "s"), ("n", "ri"), ("li", "h"), ("ii", "n"), ("8", "b"),
]
#: Words after a suspended hyphen ("two- or three-room").
SUSPENDED = {"or", "and", "to", "und", "oder", "bis", "y", "o", "e", "et", "ou", "nor", "but"}

#: Function words of the archive's other languages are no misread English words.
FOREIGN = {w for lang in ("de", "es", "fr") for w in COMMON[lang]}

WORD = re.compile(r"(?<![\w'’¬\xad=-])[^\W\d_][\w]*(?:-[^\W\d_]+)*(?![\w'’¬\xad=-])")
LOWER = re.compile(r"(?<![\w'’¬\xad=-])(?=[a-z0-9à-ÿſ]*[a-zà-ÿ])[a-z0-9à-ÿſ]{3,}(?![\w'’¬\xad=-])")
#: A bracket read for a c; a bracket that is closed later is one.
OPEN = re.compile(r"(?<![\w(])(?:\([a-zà-ÿ]{2,}|[a-zà-ÿ]+\([a-zà-ÿ]+)(?![\w)])(?![^()]{0,80}\))")
MARK = re.compile(r"( ?)(--?|¬|\xad|=)(\xad?[ \t\r]*\n\s*| +)(?=[^\W\d_])")
LEFT = re.compile(r"[^\W\d_](?:[\w'’-]*\w)?$")
RIGHT = re.compile(r"[^\W\d_][\w'’]*(?:-[^\W\d_]+)*")
DIGIT = re.compile(r"\d")
FOLIO = re.compile(r"^(\(\d{1,3}\)|\[\d{1,3}\]|\d{1,3}|p\. ?\d{1,3}|[—–-] ?\d{1,3}( ?[—–-])?|(page|PAGE|Page) (\d{1,3}( of \d{1,3})?|[A-Za-z]{3,9}))$")
_MASKED = re.compile(r"(?i)\b(mon|tues|wednes|thurs|fri|satur|sun)day\b|\b(january|february|march|april|may|june|july|august|september|october|november|december)\b|\bpage\b|\bthe\b|[^a-z]")
#: Digits read for letters, put back in words that are mostly letters.
_FOLD = str.maketrans("0134568", "oieasbb")
_MIXED = re.compile(r"\b(?:[^\W\d_]+\d|\d[^\W\d_])\w*")
#: Lines with two words in lower case are running text (also as a pattern of Arrow's).
_RUNNING = r"(^|[ (])[a-zà-ÿ].*[ (][a-zà-ÿ]"
#: What a line shows of a page head besides the name, whatever its form: a page number or a whole date; ornaments or a number at an edge.
_DATED = re.compile(r"(?i)\bpage \w{1,5}\b|\b\w{3,9}\.? \w{1,2}[,.] *[\dlioszb]{4}\b|\b[\dlio]{1,2}-[\dlio]{1,2}-[\dlio]{2,4}\b")
_ORNATE = re.compile(r"^\*.*\*$| \| |^(\d\w{0,2} +|\w{1,3} {2,})[^a-z]+$|^[^a-z]+ {2,}\w{1,4}$")
#: Marks between the parts of a head line.
_PARTS = re.compile(r"\s*[,|*]\s*|\s{2,}|\s--?\s|\.\s{2,}")


def folded(line: str) -> str:
    """The line with digits in words that are mostly letters put back to letters ('P4GE' is 'page')."""

    def word(m: re.Match[str]) -> str:
        w = m.group(0)
        return w.lower().translate(_FOLD) if 2 * len(DIGIT.findall(w)) <= len(w) else w

    return _MIXED.sub(word, line)


def head_key(line: str) -> str:
    """The letters of a head line without dates, numbers and page words; digits misread for letters count as letters."""
    return _MASKED.sub("", folded(line).lower())


def head_mark(line: str) -> int:
    """2: a line with a page number or a whole date, 1: with ornaments or a number at an edge, else 0."""
    return 2 if _DATED.search(folded(line)) else 1 if _ORNATE.search(line) else 0


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(text of each piece, piece numbers, pieces); a piece that is no free-standing word is None. Pieces are the runs of letters,
    digits and the marks that tie words together."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), pattern=r"[^\pL\pN_'’¬\x{AD}=-]+")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = pc.dictionary_encode(pc.list_flatten(lists))
    pieces = [w if WORD.fullmatch(w) else None for w in coded.dictionary.to_pylist()]
    return pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy(), pieces


CORPUS = "kind string, item string, n long, low long, article_id string, line string, parts array<string>"


def corpus_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """One narrow pass. Kind 'word': a word in lower case, how often it stands (n) and how often in lower case (low). Kind 'title':
    the key of a title and its pages. Kind 'head': a line that could be a page head, with its key (item), mark (n) and parts."""
    title = F.col("publication") if "publication" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, list[int]] = {}
        names: Counter[str] = Counter()

        def drain() -> pa.RecordBatch:
            rows = [("word", w, n, low, None, None, None) for w, (n, low) in words.items()] + [("title", k, n, 0, None, None, None) for k, n in names.items()]
            words.clear(), names.clear()
            return batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in CORPUS.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            names.update(head_key(p) for p in b.column(2).to_pylist() if p)
            _, codes, pieces = _words(b.column(1))
            for w, n in zip(pieces, np.bincount(codes, minlength=len(pieces)).tolist(), strict=True):
                if w is not None:
                    c = words.setdefault(w.lower(), [0, 0])
                    c[0] += n
                    c[1] += n if w == w.lower() else 0
            lists = pc.split_pattern(pc.fill_null(b.column(1), ""), "\n")
            lines, doc = pc.utf8_trim_whitespace(pc.list_flatten(lists)), pc.list_parent_indices(lists)
            alone = pc.equal(pc.list_value_length(lists), 1).take(doc)
            fit = pc.and_(pc.greater_equal(pc.utf8_length(lines), MIN_NAME), pc.invert(pc.or_(alone, pc.match_substring_regex(lines, _RUNNING))))
            rows = []
            for line, d in zip(lines.filter(fit).to_pylist(), doc.filter(fit).to_pylist(), strict=True):
                if mark := head_mark(line):
                    parts = [k for k in dict.fromkeys(head_key(x) for x in _PARTS.split(line)) if len(k) >= MIN_NAME]
                    rows.append(("head", head_key(line), mark, 0, b.column(0)[d].as_py(), line, parts))
            if rows:
                yield batch(rows)
            if len(words) > 200_000:
                yield drain()
        yield drain()

    return docs.select("article_id", text, title.alias("_title")).mapInArrow(run, CORPUS)


def head_names(rows: DataFrame) -> DataFrame:
    """(name, kind): the keys that repeat over the pages of the corpus: 'title' of a page (its head is the second mention), 'line'
    for a line that two pages or more show, 'start' for the leading letters of a title (the place a newspaper is called after)."""
    long = F.length("item") >= MIN_NAME
    pages = rows.where((F.col("kind") == "title") & long).groupBy("item").agg(F.sum("n").alias("n"))
    lines = rows.where((F.col("kind") == "head") & long).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    starts = pages.select(F.explode(F.transform(F.sequence(F.lit(MIN_NAME), F.greatest(F.length("item") - 1, F.lit(MIN_NAME))), lambda n: F.substr(F.col("item"), F.lit(1), n))).alias("item")).distinct()
    return cut(pages.select(F.col("item").alias("name"), F.lit("title").alias("kind")).unionByName(lines.select(F.col("item").alias("name"), F.lit("line").alias("kind"))).unionByName(starts.select(F.col("item").alias("name"), F.lit("start").alias("kind"))))


def head_lines(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(article_id, lines): the lines of each article that repeat a page head. A line or one of its parts must be a title, a line with
    a page number or date may also be a repeated line or name the place a title starts with; titles and lines may differ by
    a few edits. All searches run on distinct readings."""
    heads = rows.where("kind = 'head'").select("article_id", "line", F.col("item").alias("key"), F.col("n").alias("mark"), "parts", F.xxhash64("item", "n", "parts").alias("cid"))
    forms = heads.select("cid", "key", "mark", "parts").distinct()
    readings = cut(forms.select("cid", "mark", F.explode(F.array_union(F.array("key"), "parts")).alias("s"), "key").where(F.length("s") >= MIN_NAME).select("cid", "mark", "s", (F.col("s") == F.col("key")).alias("whole")))
    wanted = F.when(F.col("kind") == "title", True).when(F.col("kind") == "line", (F.col("mark") == 2) & F.col("whole")).otherwise(F.col("mark") == 2)
    exact = readings.join(names, readings["s"] == names["name"]).where(wanted).select("cid")
    open_ = readings.join(exact.distinct(), "cid", "left_anti").where(F.length("s") >= FUZZY_NAME)
    near = pigeonhole_pairs(open_.select(F.col("s").alias("raw"), "s").distinct(), names.where(f"kind <> 'start' and length(name) >= {FUZZY_NAME}").select(F.col("name").alias("form"), F.lit(0).alias("title_id"), F.col("kind").alias("publication")))
    fuzzy = open_.join(near.select(F.col("raw").alias("s"), F.col("publication").alias("kind")).distinct(), "s").where(wanted).select("cid")
    good = exact.unionByName(fuzzy).distinct()
    return cut(lookup_join(heads, good, ["cid"], "left_semi").groupBy("article_id").agg(F.collect_set("line").alias("lines")))


@dataclass
class PageCorpus:
    """What the corpus pass found: counts(w, n, low) of all words, heads(article_id, lines), and the bounded part of the vocabulary
    that every task gets: counts of solid words in lower case and sorted hashes of known words."""

    counts: DataFrame
    heads: DataFrame
    low: dict[str, int]
    solid: float
    known: np.ndarray


def study_corpus(docs: DataFrame, text: str = "text", names: DataFrame | None = None) -> PageCorpus:
    """The corpus statistics of docs(article_id, text[, publication]). ``names`` replaces the repeated names found there."""
    rows = cut(corpus_rows(docs.where("article_id is not null"), text))
    counts = cut(rows.where("kind = 'word'").groupBy(F.col("item").alias("w")).agg(F.sum("n").alias("n"), F.sum("low").alias("low")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("low"), F.lit(0)).alias("low")).first()
    solid = max(5.0, total.low * SOLID)
    low = {r.w: r.low for r in counts.where(F.col("low") >= solid).select("w", "low").collect()}  # at most 1 / SOLID words
    known = counts.where(F.col("n") >= max(3.0, total.n * KNOWN)).select(F.xxhash64("w").alias("h")).toPandas()["h"].to_numpy()  # at most 1 / KNOWN
    return PageCorpus(counts, head_lines(rows, head_names(rows) if names is None else names), low, solid, np.sort(known))


class Fixer:
    """Misread words, put right through one or two known confusions. Targets are solid words, so their counts are enough."""

    def __init__(self, low: dict[str, int], solid: float):
        self.low, self.solid = low, solid
        self.longest = max(map(len, low), default=0)
        self.cache: dict[tuple[str, int], str | None] = {}

    def fix(self, w: str, n: int) -> str | None:
        """The right word if ``w``, seen ``n`` times in lower case, is a misreading, else None."""
        if (w, n) in self.cache:
            return self.cache[w, n]
        best, best_n = None, max(self.solid, RATIO * max(n, 1)) - 1
        if w not in FOREIGN and (n < 20 * self.solid or n * 400 < self.low.get("the", 0)) and len(w) <= self.longest + 2:
            level = {w}
            for _ in range(2):
                nxt = set()
                for x in level:
                    for bad, good in CONFUSIONS:
                        i = x.find(bad)
                        while i >= 0:
                            nxt.add(x[:i] + good + x[i + len(bad) :])
                            i = x.find(bad, i + 1)
                nxt.discard(w)
                for x in sorted(nxt):
                    if self.low.get(x, 0) > best_n:
                        best, best_n = x, self.low[x]
                if best or n >= 5:
                    break
                level = nxt
        if len(self.cache) < 500_000:
            self.cache[w, n] = best
        return best

    def maybe(self, w: str) -> bool:
        """Whether ``w`` could be a misreading, however rare it is; a rare count only makes corrections easier."""
        return self.fix(w, 1) is not None


def bare_text(text: str, heads: set[str], page: int | None) -> tuple[str, list[tuple[str, str]]]:
    """(text without page heads and page numbers, traces). A bare number is a page number only if it continues the article's
    pages or these are unknown; in a text that is mostly figures it is none."""
    lines = text.split("\n")
    if len(lines) < 2:
        return text, []
    traces: list[tuple[str, str]] = []
    kept: list[str] = []
    figures = len(DIGIT.findall(text)) > 0.12 * len(text)
    removed = False
    for raw in lines:
        line = raw.strip()
        kind = "header" if line in heads else None
        if kind is None and line and FOLIO.match(line) and not (line.isdigit() and (figures or page is not None and int(line) not in (page, page + 1))):
            kind = "folio"
        if kind:
            traces.append((kind, line))
            removed = True
            continue
        if removed and not line and kept and not kept[-1].rstrip().endswith((".", '"', "!", "?", ":")):
            continue  # the blank line round a removed head inside a sentence
        removed = False
        kept.append(raw)
    return "\n".join(kept), traces


def break_spots(body: str) -> Iterator[tuple[int, int, int, int, str, str, str, str, bool]]:
    """(start of the left part, start and end of the gap, end of the right part, left, blank before, mark, right, at a line end) of all
    places where a word may be broken: a mark and a blank between letters."""
    at = 0
    for m in MARK.finditer(body):
        start = max(at, m.start() - 60)
        left = LEFT.search(body, start, m.start())
        if left and left.start() == start > at:
            left = LEFT.search(body, at, m.start())
        if not left or left.start() > at and body[left.start() - 1] in "-'’":
            continue
        right = RIGHT.match(body, m.end()).group(0)
        if right.lower() in SUSPENDED:
            continue
        at = m.end()
        yield left.start(), m.start(), m.end(), m.end() + len(right), left.group(0), m.group(1), m.group(2), right, "\n" in m.group(3)


SCAN = "article_id string, kind string, piece string, hyphened string, lead string, tail string, gap boolean, mark string, at_end boolean, keep boolean"


class Scanner:
    """Lists what an article shows of the page, without deciding what the counts of rare words must decide."""

    def __init__(self, low: dict[str, int], solid: float):
        self.low, self.solid = low, solid
        self.fixer = Fixer(low, solid)

    def brackets(self, body: str, traces: list[tuple[str, str]]) -> str:
        def closed(m: re.Match[str]) -> str:
            good = m.group(0).replace("(", "c")
            if self.low.get(good, 0) < self.solid:
                return m.group(0)
            traces.append(("glyph", good))
            return good

        return OPEN.sub(closed, body) if "(" in body else body

    def scan(self, text: str, heads: set[str], page: int | None) -> Iterator[tuple]:
        """Rows of ``SCAN`` without the article: final traces, 'break' candidates (piece: joined, keep: both parts are words of their
        own) and 'word' candidates."""
        body, traces = bare_text(text, heads, page)
        rest, at = [], 0
        for a, _, _, z, left, gap, mark, right, end in break_spots(body):
            tail = left.rsplit("-", 1)[-1].lower()
            keep = right[0].isupper() and left[:1].isupper() or tail in self.low and right.lower() in self.low
            yield ("break", (left + right).lower(), f"{left}-{right}".lower(), left, right, bool(gap), mark, end, keep)
            rest.append(body[at:a])
            at = max(at, z)
        rest.append(body[at:])
        body = self.brackets(" ".join(rest), traces)
        for w in set(LOWER.findall(body)):
            if (n := self.low.get(w)) is not None:
                if good := self.fixer.fix(w, n):
                    traces.append(("glyph", good))
            elif self.fixer.maybe(w):
                yield ("word", w, *[None] * 7)
        for t in dict.fromkeys(traces):
            yield (*t, *[None] * 7)


def _readable(texts: pa.Array, known: np.ndarray) -> np.ndarray:
    import xxhash

    doc, codes, pieces = _words(texts)
    word = np.array([w is not None for w in pieces], bool)
    hashes = np.array([0 if w is None else xxhash.xxh64_intdigest(w.lower(), 42) for w in pieces], np.uint64).view(np.int64)
    seen = word & (known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes) if len(known) else np.zeros(len(pieces), bool)
    n, k = (np.bincount(doc[f[codes]], minlength=len(texts)) for f in (word, seen)) if len(pieces) else (np.zeros(len(texts)), np.zeros(len(texts)))
    return (n < 8) | (k >= READABLE * n)


def _with_heads(articles: DataFrame, corpus: PageCorpus) -> DataFrame:
    """The columns a pass over the texts needs; the heads of an article are joined to it (one row per article, broadcast only if few)."""
    for c in ("headline", "page_number"):
        if c not in articles.columns:
            articles = articles.withColumn(c, F.lit(None).cast("string"))
    docs = articles.where("article_id is not null").select("article_id", "text", "headline", F.expr("try_cast(page_number as int)").alias("page"))
    return lookup_join(docs, corpus.heads, ["article_id"], "left")


def scan_pages(articles: DataFrame, corpus: PageCorpus) -> DataFrame:
    """Rows of ``SCAN`` of texts and headlines."""
    shared = articles.sparkSession.sparkContext.broadcast((corpus.low, corpus.solid, corpus.known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, solid, known = shared.value
        s = Scanner(low, solid)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_())
        names = [c.split()[0] for c in SCAN.split(", ")]
        for b in batches:
            if not b.num_rows:
                continue
            rows: list[tuple] = []
            key, page, heads = b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            for col, own in ((1, True), (2, False)):
                fine = _readable(b.column(col), known)
                for i, t in enumerate(b.column(col).to_pylist()):
                    if t and fine[i]:
                        rows.extend((key[i], *r) for r in s.scan(t, set(heads[i] or ()) if own else set(), page[i]))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    return _with_heads(articles, corpus).mapInArrow(run, SCAN)


def _low_word(c: Column) -> Column:
    """Whether a string is one lower-case word as ``LOWER`` finds them."""
    return c.rlike("^(?=[a-z0-9à-ÿſ]*[a-zà-ÿ])[a-z0-9à-ÿſ]{3,}$")


BREAK = ["lead", "tail", "gap", "mark", "at_end"]


def decide(rows: DataFrame, corpus: PageCorpus) -> tuple[DataFrame, DataFrame]:
    """(breaks, fixes): breaks(lead, tail, gap, mark, at_end, word, words) gives for every distinct break candidate of ``rows`` its word,
    null if it is none, and the lower-case words it leaves to be checked; fixes(w, good) the right word of misread words.
    Counts of candidates come from joins with the whole vocabulary."""
    spots = cut(rows.where("kind = 'break'").select(*BREAK, "piece", "hyphened", "keep").distinct())
    asked = spots.select(F.explode(F.array("piece", "hyphened")).alias("w")).distinct()
    seen = cut(corpus.counts.join(asked, "w", "left_semi").select("w", "n"))
    d = lookup_join(lookup_join(spots, seen.select(F.col("w").alias("piece"), F.col("n").alias("nj")), ["piece"]), seen.select(F.col("w").alias("hyphened"), F.col("n").alias("nh")), ["hyphened"])
    d = d.na.fill(0, ["nj", "nh"])
    none = (~F.col("at_end") & (F.col("gap") | F.col("mark").isin("=", "--")) & (F.col("nj") == 0)) | (F.col("gap") & F.col("at_end") & F.col("mark").isin("--", "-") & (F.col("nj") == 0) & (F.col("nh") == 0))
    keep = (F.col("nh") > F.col("nj")) | ((F.col("nj") == 0) & (F.col("nh") == 0) & F.col("keep"))
    whole = F.concat("lead", "tail")
    left = F.filter(F.array(F.when(none & F.col("gap"), F.col("lead")).when(~none & ~keep, whole), F.when(none, F.col("tail"))), lambda w: w.isNotNull() & _low_word(w))
    breaks = cut(d.select(*BREAK, F.when(~none, F.when(keep, F.col("hyphened")).otherwise(F.col("piece"))).alias("word"), left.alias("words")))
    wanted = rows.where("kind = 'word'").select(F.col("piece").alias("w")).unionByName(breaks.select(F.explode("words").alias("w"))).unionByName(breaks.where("word is not null").select(F.col("word").alias("w"))).distinct()
    shared = rows.sparkSession.sparkContext.broadcast((corpus.low, corpus.solid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fixer(*shared.value)
        for b in batches:
            good = [f.fix(w, n or 0) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(good, pa.string())], names=["w", "good"])

    fixes = wanted.join(corpus.counts.select("w", "low"), "w", "left").mapInArrow(run, "w string, good string").where("good is not null")
    return breaks, cut(fixes)


def decided(rows: DataFrame, breaks: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final traces, breaks of each article with their word, words of each article with the right word)."""
    final = rows.where("kind not in ('break', 'word')").select("article_id", "kind", "piece")
    spots = lookup_join(rows.where("kind = 'break'").select("article_id", *BREAK), breaks, BREAK)
    spots = lookup_join(spots, fixes.select(F.col("w").alias("word"), "good"), ["word"])
    words = rows.where("kind = 'word'").select("article_id", F.col("piece").alias("w")).unionByName(spots.select("article_id", F.explode("words").alias("w")))
    return final, spots, lookup_join(words, fixes, ["w"], "inner")


def page_traces(articles: DataFrame, corpus: PageCorpus | None = None) -> DataFrame:
    """Distinct (article_id, kind, piece). Unreadable, null and empty texts have no traces, rows without an article_id none either;
    repeated deliveries count once; an empty table gives no rows."""
    corpus = study_corpus(articles) if corpus is None else corpus
    rows = cut(scan_pages(articles, corpus))
    final, spots, words = decided(rows, *decide(rows, corpus))
    broken = spots.where("word is not null").select("article_id", F.lit("break").alias("kind"), F.coalesce("good", "word").alias("piece"))
    return final.unionByName(broken).unionByName(words.select("article_id", F.lit("glyph").alias("kind"), F.col("good").alias("piece"))).distinct()


class Repairer(Scanner):
    """Applies the decisions of an article to its texts."""

    def repair(self, text: str, heads: set[str], page: int | None, breaks: dict[tuple, str | None], fixes: dict[str, str]) -> tuple[str, list[tuple[str, str]]]:
        """(repaired text, traces (kind, piece))."""
        body, traces = bare_text(text, heads, page)
        out, at = [], 0
        for _, gap_at, gap_end, _, left, gap, mark, right, end in break_spots(body):
            word = breaks.get((left, right, bool(gap), mark, end))
            if word is None:
                continue
            traces.append(("break", fixes.get(word, word)))
            out.append(body[at:gap_at] + ("-" if word[len(left) : len(left) + 1] == "-" else ""))
            at = gap_end
        body = self.brackets("".join(out) + body[at:], traces)

        def right_word(w: str) -> str | None:
            return self.fixer.fix(w, self.low[w]) if w in self.low and w not in fixes else fixes.get(w)

        wrong = {w: good for w in set(LOWER.findall(body)) if (good := right_word(w))}
        if wrong:
            traces.extend(("glyph", good) for good in wrong.values())
            body = LOWER.sub(lambda m: wrong.get(m.group(0), m.group(0)), body)
        body = re.sub(r"[ \t\r]*\n[ \t\r]*(?!\s)", "\n", body)
        body = re.sub(r"(?<!\n)\n(?!\n)", " ", body)
        return re.sub(r"\n{2,}", "\n\n", re.sub(r"[ \t]+", " ", body)).strip(), traces


REPAIRED = "article_id string, text string, headline string, traces array<struct<kind:string,piece:string>>"


def repair_pages(articles: DataFrame, corpus: PageCorpus | None = None) -> DataFrame:
    """(article_id, text, headline, traces) for every row with an article_id. Null texts and headlines become empty;
    unreadable texts stay unchanged and have no traces; rows are not merged. The decisions of an article are joined to its rows."""
    corpus = study_corpus(articles) if corpus is None else corpus
    rows = cut(scan_pages(articles, corpus))
    _, spots, words = decided(rows, *decide(rows, corpus))
    per = spots.where("word is not null").groupBy("article_id").agg(F.collect_set(F.struct(*BREAK, "word", "good")).alias("breaks"))
    per = cut(per.join(words.groupBy("article_id").agg(F.collect_set(F.struct("w", "good")).alias("fixes")), "article_id", "full_outer"))
    shared = articles.sparkSession.sparkContext.broadcast((corpus.low, corpus.solid, corpus.known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, solid, known = shared.value
        r = Repairer(low, solid)
        for b in batches:
            fine = {c: _readable(pa.array(b[c], pa.string(), from_pandas=True), known) for c in ("text", "headline")} if len(b) else {}
            out = []
            for n, (i, t, h, page, heads, breaks, fixes) in enumerate(zip(b["article_id"], b["text"], b["headline"], b["page"], b["lines"], b["breaks"], b["fixes"], strict=True)):
                at = {tuple(x[c] for c in BREAK): x["word"] for x in (breaks if breaks is not None else ())}
                good = {x["word"]: x["good"] for x in (breaks if breaks is not None else ()) if x["good"]} | {x["w"]: x["good"] for x in (fixes if fixes is not None else ())}
                page = None if pd.isna(page) else int(page)
                body, traces = r.repair(t, set(heads if heads is not None else ()), page, at, good) if t and fine["text"][n] else (t or "", [])
                head, more = r.repair(h, set(), page, at, good) if h and fine["headline"][n] else (h or "", [])
                out.append((i, body, head, [{"kind": k, "piece": x} for k, x in dict.fromkeys(traces + more)]))
            yield pd.DataFrame(out, columns=["article_id", "text", "headline", "traces"])

    return _with_heads(articles, corpus).join(per, "article_id", "left").mapInPandas(run, REPAIRED)
