"""Subject areas of documents: classifier chains over term, structure and source features, decoded by beam search.

Term features: a mixture over the words of each sentence with one component per topic and one for remarks that could
stand under any subject, fitted by expectation maximisation on a bounded sample of labelled documents (the label
only weights the components, so a second subject and wrong labels do not spoil the term tables). A document's share
of a topic is the part of its topical words in sentences of that topic.

Chain: one logistic classifier per topic, in order of frequency, over the topic's share, the largest other share,
structure (number of sentences, topical part), the prior of the source and the labels already decided
with their co-occurrence weights. Its training documents are mixtures of sentences of two labelled documents, and their targets
come from the labels: a label counts from a third of the mixture's topical words on. Documents whose words speak against
their label are left out, for some labels are wrong. A quarter of the documents is held out of the chain; on mixtures of these
its log odds are calibrated. Beam search keeps the most probable label sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.prose import COMMON
from broadsheet.runtime import lookup_join

#: Labelled documents used for fitting; words kept; rounds of the mixture; width of the beam; share that makes a subject.
MAX_LABELLED, MAX_WORDS, ROUNDS, BEAM, SUBJECT_SHARE = 4000, 20_000, 3, 4, 1 / 3
#: Pseudo-words by which a component's word table is drawn to that of the corpus.
SMOOTHING = 3.0
#: Labelled documents of the chain have at least this share of their label; one of ``HELD_OUT`` of them is kept for calibration.
PURE, HELD_OUT = 0.75, 4
#: Part of the sentences that is taken for remarks before anything is known.
NEUTRAL = 0.6
#: Least topical words and their least part of the document for it to have a subject at all.
MIN_TOPICAL, MIN_PART = 0.9, 0.015
#: A word is solid if it makes up this share of the sample's words (or occurs five times in a small sample); a text is readable if
#: it has at least ``READABLE`` solid words for each of its words in lower case.
SOLID_SHARE, READABLE = 5e-5, 0.4
#: Features of a step of the chain.
N_FEATURES = 11
_END = "zzendzz"
_CHUNK = 2000
_FUNCTION = {w for ws in COMMON.values() for w in ws}


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(document of each sentence, first token of each sentence, dictionary, codes): lower-case words of whole texts; line-layout
    breaks are closed and dots of titles and initials do not end sentences."""
    t = pc.fill_null(texts, "")
    t = pc.replace_substring_regex(t, r"(\pL)[-¬\x{AD}=]{1,2}[ \t\r]*\n\s*(\pL)", r"\1\2")
    t = pc.replace_substring_regex(t, r"\b(Mrs|Mr|Dr|Prof|Rev|Capt|No|Gov|Sen|Gen|St|Co|[A-Z]|[ap]\. ?m)\.", " ")
    t = pc.replace_substring_regex(t, r"[.!?;]['\"]?\s+|\n\s*\n|\s(--|\.)\s", f" {_END} ")
    lists = pc.split_pattern_regex(pc.utf8_lower(t), pattern=r"[^\pL]+")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    end = words.index(_END) if _END in words else -1
    starts = np.union1d(offsets[:-1] - offsets[0], np.flatnonzero(codes == end))
    starts = starts[starts < len(codes)]
    doc = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
    return doc, starts, words, codes


@dataclass
class SubjectModel:
    topics: list[int]
    words: dict[str, int]
    logp: np.ndarray  # words + 1 (unknown) x topics + 1 (neutral)
    prior: np.ndarray
    chain: np.ndarray  # topics x features
    cooc: np.ndarray
    source: dict[str, np.ndarray]
    solid: np.ndarray
    order: np.ndarray  # topics in the order in which the chain was trained and is decoded
    scale: np.ndarray  # calibrated log odds are scale[0] + scale[1] x log odds


def _readable(texts: pa.Array, doc: np.ndarray, seg: np.ndarray, ids: np.ndarray, solid: np.ndarray) -> np.ndarray:
    low = pc.count_substring_regex(pc.fill_null(texts, ""), r"[^\pL]\p{Ll}").to_numpy(zero_copy_only=False)
    known = np.bincount(doc[seg[solid[ids]]], minlength=len(texts)) if len(ids) else np.zeros(len(texts))
    return known >= READABLE * low


def _segments(texts: pa.Array, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    doc, starts, names, codes = tokenised(texts)
    to = np.array([words.get(w, -1) if w and w != _END else -2 for w in names] or [-2], dtype=np.int64)
    ids = to[codes] if len(codes) else codes
    seg = np.searchsorted(starts, np.arange(len(ids)), side="right") - 1
    known = ids >= 0  # invented names, misread words and junk have no weight
    length = np.bincount(seg[known], minlength=len(starts)).astype(float)
    return doc, length, seg[known], ids[known], np.arange(len(starts))


def _posteriors(logp: np.ndarray, prior: np.ndarray, seg: np.ndarray, ids: np.ndarray, n: int, extra: np.ndarray | None = None) -> np.ndarray:
    score = np.zeros((n, logp.shape[1]))
    if len(seg):
        heads = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        score[seg[heads]] = np.add.reduceat(logp[ids], heads, axis=0)
    score += np.log(prior) if extra is None else extra
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def _shares(doc: np.ndarray, length: np.ndarray, post: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share per topic, topical words, topical part) per document."""
    w = post[:, :-1] * length[:, None]
    mass = np.zeros((n_docs, w.shape[1]))
    np.add.at(mass, doc, w)
    total = np.bincount(doc, weights=length, minlength=n_docs)
    topical = mass.sum(axis=1)
    return mass / np.maximum(topical, 1e-9)[:, None], topical, topical / np.maximum(total, 1)


def _features(share: np.ndarray, j: int, part: np.ndarray, n_seg: np.ndarray, prior: np.ndarray, prev_n: np.ndarray, prev_share: np.ndarray, cooc: np.ndarray) -> np.ndarray:
    s = share[:, j]
    other = np.delete(share, j, axis=1).max(axis=1) if share.shape[1] > 1 else np.zeros(len(s))
    return np.stack([np.ones(len(s)), s, np.maximum(s - SUBJECT_SHARE, 0), np.minimum(s, 0.15), other, part, np.log1p(n_seg), prior, prev_n, prev_share, cooc], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, centre: np.ndarray) -> np.ndarray:
    w = centre.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * (w - centre)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_subjects(labelled: list[tuple[str, int, str]], terms: dict[int, list[str]], seed: int = 5, n_mix: int = 12_000) -> SubjectModel:
    """Fit on (text, topic or -1, source) rows and the listed terms of each topic."""
    topics = sorted(terms)
    k = len(topics)
    rng = np.random.default_rng(seed)
    texts = pa.array([t or "" for t, _, _ in labelled], pa.string())
    doc, starts, names, codes = tokenised(texts)
    counts: dict[str, int] = {}
    for w, n in zip(names, np.bincount(codes, minlength=len(names)) if len(codes) else [], strict=False):
        if w and w != _END:
            counts[w] = counts.get(w, 0) + int(n)
    listed = {w.lower() for ts in terms.values() for w in ts}
    kept = sorted((w for w in counts if counts[w] >= 2 and w not in listed), key=lambda w: (-counts[w], w))[:MAX_WORDS]
    words = {w: i for i, w in enumerate(sorted(listed) + kept)}
    doc, length, seg, ids, _ = _segments(texts, words)
    n_seg, v = len(length), len(words)
    whole = sum(counts.values())
    solid = np.array([counts.get(w, 0) >= max(5, SOLID_SHARE * whole) for w in words] or [False])
    if n_seg:  # unreadable texts teach nothing
        fine = _readable(texts, doc, seg, ids, solid)
        keep = fine[doc[seg]]
        seg, ids = seg[keep], ids[keep]
    boost = np.zeros((v, k + 1))
    for j, t in enumerate(topics):
        for w in terms[t]:
            boost[words[w.lower()], j] += 3.0
    label = np.array([topics.index(t) if t in terms else -1 for _, t, _ in labelled], dtype=int)
    base = np.full((len(labelled), k + 1), 0.15 / k)
    base[:, k] = NEUTRAL
    base[label >= 0, label[label >= 0]] = 0.85 - NEUTRAL
    base[label < 0, :k] = (1 - NEUTRAL) / k
    extra = np.log(base[doc]) if n_seg else np.zeros((0, k + 1))
    total = np.bincount(ids, minlength=v).astype(float)
    background = (total + 0.5) / (total.sum() + 0.5 * v)
    # Start: a word that most topics use alike belongs to the remarks, what a topic uses beyond that to the topic. Function
    # words stand in every sentence and tell nothing; they keep a weight of zero.
    content = np.array([w not in _FUNCTION for w in words])
    by_label = np.zeros((v, k))
    own = label[doc[seg]] if len(seg) else np.zeros(0, int)
    np.add.at(by_label, (ids[own >= 0], own[own >= 0]), 1.0)
    by_label = (by_label + 0.01) / (by_label + 0.01).sum(axis=0)
    usual = np.median(by_label, axis=1)
    mass = np.concatenate([np.maximum(by_label - usual[:, None], 0), usual[:, None]], axis=1)
    mass = mass / np.maximum(mass.sum(axis=0), 1e-12) * max(total.sum() / (k + 1), 1.0) + boost
    for _ in range(ROUNDS):
        p = (mass + SMOOTHING * background[:, None]) / (mass.sum(axis=0) + SMOOTHING)
        logp = np.log(p / background[:, None]) * content[:, None]
        post = _posteriors(logp, None, seg, ids, n_seg, extra)
        mass = boost.copy()
        np.add.at(mass, ids, post[seg])
    prior = np.full(k + 1, 0.5 / k)
    prior[k] = 0.5

    freq = np.bincount(label[label >= 0], minlength=k) + 1.0
    src = [s for _, _, s in labelled]
    source: dict[str, np.ndarray] = {}
    for d, s in enumerate(src):
        if label[d] >= 0 and s:
            source.setdefault(s, np.zeros(k))[label[d]] += 1
    base_rate = freq / freq.sum()
    source = {s: np.log((c + 5 * base_rate) / (c.sum() + 5) / base_rate) for s, c in source.items()}
    free = _posteriors(logp, prior, seg, ids, n_seg)
    mixed = Mixtures(doc, length, free, label, [source.get(s, np.zeros(k)) for s in src], k)
    order = np.argsort(-freq, kind="stable")
    start = np.zeros(N_FEATURES)
    start[[0, 1]] = (-8.0, 24.0)  # without training rows: a subject from a third on
    model = SubjectModel(topics, words, np.vstack([logp, np.zeros(k + 1)]), prior, np.tile(start, (k, 1)), np.zeros((k, k)), source, solid, order, np.array([0.0, 1.0]))
    rows = mixed.draw(mixed.usable[np.arange(len(mixed.usable)) % HELD_OUT > 0], n_mix, rng)
    if rows is not None:
        fit_chain(model, *rows, start)
    held = mixed.draw(mixed.usable[np.arange(len(mixed.usable)) % HELD_OUT == 0], n_mix // 2, rng)
    if rows is not None and held is not None:
        z, y = chain_odds(model, *held)
        model.scale = _logistic(np.stack([np.ones(len(z)), z], axis=1), y, 1.0, model.scale)
    return model


class Mixtures:
    """Documents made of the sentences of two labelled documents, with the labels that make up a third of their topical words."""

    def __init__(self, doc: np.ndarray, length: np.ndarray, post: np.ndarray, label: np.ndarray, prior: list[np.ndarray], k: int):
        self.length, self.post, self.label, self.prior, self.k = length, post, label, prior, k
        self.by_doc = [np.flatnonzero(doc == d) for d in range(len(label))] if len(doc) else []
        share = _shares(doc, length, post, len(label))[0] if len(doc) else np.zeros((len(label), k))
        pure = [d for d in range(len(label)) if self.by_doc and label[d] >= 0 and len(self.by_doc[d]) >= 3 and share[d, label[d]] >= PURE]
        self.usable = np.array(pure, int)

    def draw(self, docs: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, ...] | None:
        """(shares, labels, topical parts, numbers of sentences, source priors) of up to ``n`` mixtures."""
        out: list[tuple] = []
        for _ in range(n if len(docs) else 0):
            a, b = rng.choice(docs, 2)
            f = rng.random() if rng.random() < 0.6 else 1.0
            both = [s[rng.random(len(s)) < q] for s, q in ((self.by_doc[a], f), (self.by_doc[b], 1 - f))]
            pick = np.concatenate(both)
            if len(pick) < 2:
                continue
            mass = [float((self.length[s] * (1 - self.post[s, -1])).sum()) for s in both]
            if sum(mass) < MIN_TOPICAL:
                continue
            share, _, part = _shares(np.zeros(len(pick), int), self.length[pick], self.post[pick], 1)
            true = np.zeros(self.k)
            np.add.at(true, self.label[[a, b]], np.array(mass) / sum(mass))
            out.append((share[0], true >= SUBJECT_SHARE, part[0], float(len(pick)), self.prior[a]))
        return tuple(np.array(x) for x in zip(*out, strict=True)) if out else None


def _steps(model: SubjectModel, share: np.ndarray, true: np.ndarray, part: np.ndarray, n_seg: np.ndarray, prior: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(topic, features) along the chain, with the true labels of the topics before."""
    prev_n, prev_share, prev_co = np.zeros(len(true)), np.zeros(len(true)), np.zeros((len(true), len(model.topics)))
    for j in model.order:
        yield j, _features(share, j, part, n_seg, prior[:, j], prev_n, prev_share, prev_co[:, j])
        prev_n = prev_n + true[:, j]
        prev_share = prev_share + true[:, j] * share[:, j]
        prev_co = prev_co + true[:, [j]] * model.cooc[j]


def fit_chain(model: SubjectModel, share: np.ndarray, true: np.ndarray, part: np.ndarray, n_seg: np.ndarray, prior: np.ndarray, start: np.ndarray) -> None:
    """Fit co-occurrence weights and one classifier per topic, each drawn to the classifier of all topics together."""
    both = true.astype(float).T @ true + 0.5
    ones = true.sum(axis=0) + 1.0
    model.cooc = np.log(both * len(true) / np.outer(ones, ones)).clip(-3, 3)
    steps = list(_steps(model, share, true, part, n_seg, prior))
    pooled = _logistic(np.concatenate([x for _, x in steps]), np.concatenate([true[:, j].astype(float) for j, _ in steps]), 1.0, start)
    for j, x in steps:
        model.chain[j] = _logistic(x, true[:, j].astype(float), 30.0, pooled)


def chain_odds(model: SubjectModel, share: np.ndarray, true: np.ndarray, part: np.ndarray, n_seg: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, labels) of all topics of all rows, before calibration."""
    z, y = zip(*[(x @ model.chain[j], true[:, j].astype(float)) for j, x in _steps(model, share, true, part, n_seg, prior)], strict=True)
    return np.concatenate(z), np.concatenate(y)


def decode(model: SubjectModel, share: np.ndarray, part: np.ndarray, n_seg: np.ndarray, prior: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(label matrix, log probability) of the best label set found by beam search for each row."""
    n, k = share.shape
    lab = np.zeros((n, 1, k), bool)
    logp = np.zeros((n, 1))
    prev_n, prev_share, prev_co = np.zeros((n, 1)), np.zeros((n, 1)), np.zeros((n, 1, k))
    for j in model.order:
        w = logp.shape[1]
        base = _features(share, j, part, n_seg, prior[:, j], np.zeros(n), np.zeros(n), np.zeros(n)) @ model.chain[j]
        z = base[:, None] + prev_n * model.chain[j][8] + prev_share * model.chain[j][9] + prev_co[:, :, j] * model.chain[j][10]
        z = model.scale[0] + model.scale[1] * z
        yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
        logp = np.concatenate([logp + no, logp + yes], axis=1)
        keep = np.argsort(-logp, axis=1, kind="stable")[:, :width]
        rows = np.arange(n)[:, None]
        old, took = keep % w, keep >= w
        logp = logp[rows, keep]
        lab = lab[rows, old]
        lab[:, :, j] = took
        prev_n = prev_n[rows, old] + took
        prev_share = prev_share[rows, old] + took * share[:, [j]]
        prev_co = prev_co[rows, old] + took[:, :, None] * model.cooc[j]
    return lab[:, 0], logp[:, 0]


def predict(model: SubjectModel, texts: pa.Array, sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(label matrix, shares) of whole texts. A text without enough topical words has no label."""
    n, k = len(texts), len(model.topics)
    doc, length, seg, ids, _ = _segments(texts, model.words)
    post = _posteriors(model.logp, model.prior, seg, ids, len(length))
    share, topical, part = _shares(doc, length, post, n)
    n_seg = np.bincount(doc, minlength=n).astype(float)
    zero = np.zeros(k)
    pri = np.array([model.source.get(s or "", zero) for s in sources]).reshape(n, k)
    lab, _ = decode(model, share, part, n_seg, pri)
    top = share.argmax(axis=1)
    sure = share[np.arange(n), top] >= SUBJECT_SHARE
    lab[np.flatnonzero(~lab.any(axis=1) & sure), top[~lab.any(axis=1) & sure]] = True
    lab[(topical < MIN_TOPICAL) | (part < MIN_PART) | ~_readable(texts, doc, seg, ids, model.solid)] = False
    return lab, share


def labelled_sample(articles: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, margin: float | None = None) -> list[tuple[str, int, str]]:
    """At most ``limit`` labelled documents (text, topic, source), chosen by a hash of their id."""
    few = labels.where("article_id is not null and topic is not null").groupBy("article_id").agg(F.min("topic").alias("topic"))
    few = few.orderBy(F.xxhash64("article_id"), "article_id").limit(limit)
    one = lookup_join(articles.select("article_id", "text", "publication"), few, ["article_id"], "inner").groupBy("article_id").agg(F.first("text").alias("text"), F.first("topic").alias("topic"), F.first("publication").alias("publication"))
    return [(r.text or "", int(r.topic), r.publication or "") for r in sorted(one.collect(), key=lambda r: r.article_id)]


def document_subjects(articles: DataFrame, labels: DataFrame, topics: DataFrame, model: SubjectModel | None = None) -> DataFrame:
    """Distinct (article_id, topic, share). Null and meaningless texts have no row; repeated deliveries come out once."""
    if model is None:
        terms = {int(r.topic): [w for w in r.top_terms or [] if w] for r in topics.select("topic", "top_terms").collect() if r.topic is not None}
        model = fit_subjects(labelled_sample(articles, labels), terms)
    shared = articles.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SubjectModel(**shared.value)
        names = np.array(m.topics)
        for big in batches:
            for at in range(0, big.num_rows, _CHUNK):
                b = big.slice(at, _CHUNK)
                lab, share = predict(m, b.column(1), b.column(2).to_pylist())
                row, col = np.nonzero(lab)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(names[col].astype(np.int32)), pa.array(share[row, col])], names=["article_id", "topic", "share"])

    found = articles.where("article_id is not null").select("article_id", "text", "publication").mapInArrow(run, "article_id string, topic int, share double")
    return found.groupBy("article_id", "topic").agg(F.max("share").alias("share"))
