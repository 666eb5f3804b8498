"""Language of each text and of each line of a mixed text, by a mixture of n-gram models.

1. Character n-gram models are fitted on at most `SAMPLE` labelled records a language (a bound; the labels may be wrong and
   the texts mixed: lines are relabelled by the models themselves, with a bonus for the given label, and counted again).
2. A text is a mixture of languages: each line comes from one of them. Expectation-maximisation estimates the proportions
   from the lines' likelihoods, over a set of languages that starts with the best single one and takes in another as long
   as the likelihood grows by more than the penalty.
3. A line gets the language with the greatest posterior, which is its confidence; a text the language of most letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.session import materialize

# The languages, and the spellings of their labels (two and three letters, English name).
LANGUAGES = ("de", "en", "fr", "es", "nl", "it")
SPELLINGS = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "it": ("it", "ita", "italian"),
}
#: Labelled records a language that the models are fitted on at most.
SAMPLE = 800
#: Characters of their titles and bodies at most, in the order of the hash; a record is in the sample whole or not at all.
SAMPLE_CHARS = 64_000_000
GRAM, BUCKETS, ALPHA = 3, 1 << 16, 0.1
#: n-grams overlap, so each counts as this share of an independent observation.
TEMPER = 1 / GRAM
#: What another language has to add to the log-likelihood of a text: PENALTY and half the logarithm of its lines.
PENALTY = 1.0
#: Log-odds in favour of a record's label while the models are fitted.
BONUS, ROUNDS = 6.0, 5
EM_STEPS = 25
LETTERS = re.compile(r"[^\W\d_]+")
LINE = re.compile(r"\r\n|\n|\r")
FENCE = re.compile(r"\s*(```|~~~)")
CODE = re.compile(r"\s*(?:[A-Za-z_][\w.\[\]]*\s*(?:[-+*/]|:)?=\s*\S.*|[{}()\[\];]+|.*[;{}]|(?:def|class|import|from|return|SELECT|INSERT|UPDATE|DELETE|function|const|let|var)\b.*[(:=;*{].*|\$ .*|#!.*)\s*$")


def label_language(label: Column) -> Column:
    """The language that a label names, in any spelling of case, region, code or English name; else null."""
    table = F.create_map(*[F.lit(x) for lang, names in SPELLINGS.items() for name in names for x in (name, lang)])
    return table[F.lower(F.trim(F.split(F.trim(label), "[-_]")[0]))]


def lines_of(body: str) -> list[tuple[str, bool]]:
    """Non-blank lines, and whether each is code: between a pair of fences, or by its form."""
    lines = [x for x in LINE.split(body) if x.strip()]
    fences = [i for i, x in enumerate(lines) if FENCE.match(x)]
    fenced = np.zeros(len(lines), bool)
    for a, b in zip(fences[::2], fences[1::2], strict=False):
        fenced[a : b + 1] = True
    return [(x, bool(f) or bool(CODE.match(x))) for x, f in zip(lines, fenced, strict=True)]


def gram_buckets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the letters of each text, where each text starts in them, and its number of letters."""
    plain = [LETTERS.findall(t.lower()) for t in texts]
    letters = np.array([sum(map(len, w)) for w in plain], np.int64)
    joined = [" " * (GRAM - 1) + " ".join(w) + " " if w else " " * GRAM for w in plain]
    c = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(x) for x in joined])
    h = np.zeros(len(c), np.uint64)
    for i in range(GRAM):
        h[: len(c) - i] = h[: len(c) - i] * np.uint64(0x9E3779B1) + c[i:]
    h = ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.int64)
    keep = np.ones(len(c), bool)
    for i in range(1, GRAM):
        keep[ends - i] = False
    starts = np.append(0, np.cumsum(np.array([len(x) - GRAM + 1 for x in joined])))[:-1]
    return h[keep], starts, letters


def likelihoods(texts: Sequence[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-likelihood of each text in each language, and its letters. A text without letters says nothing."""
    if not len(texts):
        return np.zeros((0, table.shape[1])), np.zeros(0, np.int64)
    h, starts, letters = gram_buckets(texts)
    ll = np.add.reduceat(table[h], starts, axis=0).astype(np.float64) * TEMPER
    ll[letters == 0] = 0
    return ll, letters


def fit(texts: Sequence[str], labels: Sequence[int]) -> np.ndarray:
    """Log-probabilities of the n-grams by language, from lines and their records' labels, some of which are wrong."""
    h, starts, letters = gram_buckets(texts)
    given = np.asarray(labels)
    own, k = given.copy(), len(LANGUAGES)
    sizes = np.diff(np.append(starts, len(h)))
    for _ in range(ROUNDS):
        counts = np.stack([np.bincount(h[np.repeat((own == x) & (letters > 0), sizes)], minlength=BUCKETS) for x in range(k)], 1).astype(np.float64)
        total = counts.sum(0)
        table = np.log((counts + ALPHA) / (total + ALPHA * BUCKETS))
        table[:, total == 0] = -50.0  # a language without any record
        table = table.astype(np.float32)
        ll = np.add.reduceat(table[h], starts, axis=0).astype(np.float64) * TEMPER
        ll[np.arange(len(given)), given] += BONUS
        own = ll.argmax(1)
    return table


def _em(ll: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of each text over its allowed languages, its log-likelihood, and the posterior of each line."""
    pi = allowed / allowed.sum(1, keepdims=True)
    top = np.where(allowed[doc], ll, -np.inf).max(1, keepdims=True)
    like = np.exp(ll - top) * allowed[doc]
    starts = np.searchsorted(doc, np.arange(n))
    lines = np.bincount(doc, minlength=n)[:, None]
    for _ in range(EM_STEPS):
        joint = like * pi[doc]
        post = joint / joint.sum(1, keepdims=True)
        pi = np.add.reduceat(post, starts, axis=0) / lines
    joint = like * pi[doc]
    evidence = joint.sum(1, keepdims=True)
    return pi, np.add.reduceat((np.log(evidence) + top)[:, 0], starts), joint / evidence


def mixtures(ll: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each line and proportions of each of n texts; doc: the text of each line, ascending, none empty."""
    starts = np.searchsorted(doc, np.arange(n))
    total = np.add.reduceat(ll, starts, axis=0)
    k = ll.shape[1]
    allowed = np.eye(k)[total.argmax(1)]
    pi, post = allowed.copy(), None
    # only a line that prefers another language can make it worth adding
    told = np.abs(ll).sum(1) > 0
    prefers = np.zeros((n, k), bool)
    prefers[doc[told], ll[told].argmax(1)] = True
    open_docs = np.flatnonzero((prefers & (allowed == 0)).any(1))
    now = np.take_along_axis(total, total.argmax(1)[:, None], 1)[:, 0]
    penalty = PENALTY + 0.5 * np.log(np.bincount(doc, minlength=n))
    while len(open_docs):
        mine = np.isin(doc, open_docs)
        sub_ll, sub_doc = ll[mine], np.searchsorted(open_docs, doc[mine])
        gain, with_c = np.full((len(open_docs), k), -np.inf), {}
        for c in range(k):
            can = np.flatnonzero(prefers[open_docs, c] & (allowed[open_docs, c] == 0))
            if not len(can):
                continue
            rows = np.isin(sub_doc, can)
            more = allowed[open_docs[can]].copy()
            more[:, c] = 1
            p, value, _ = _em(sub_ll[rows], np.searchsorted(can, sub_doc[rows]), len(can), more)
            gain[can, c] = value - now[open_docs[can]]
            with_c[c] = dict(zip(can.tolist(), zip(p, value, strict=True), strict=True))
        best = gain.argmax(1)
        taken = np.flatnonzero(gain[np.arange(len(best)), best] > penalty[open_docs])
        for i in taken:
            d, c = open_docs[i], best[i]
            allowed[d, c] = 1
            pi[d], now[d] = with_c[c][i]
        open_docs = open_docs[taken]
        open_docs = open_docs[(prefers[open_docs] & (allowed[open_docs] == 0)).any(1)]
    many = np.flatnonzero(allowed.sum(1) > 1)
    post = np.where(allowed[doc] > 0, 1.0, 0.0)
    if len(many):
        rows = np.isin(doc, many)
        pi[many], _, post[rows] = _em(ll[rows], np.searchsorted(many, doc[rows]), len(many), allowed[many])
    return post, pi


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


SEGMENTS = "id string, seg_no int, lang string, confidence double"


def segmenter(table: np.ndarray):
    """A function over batches of (id, title, body)."""

    def one(ids: list, titles: list, bodies: list) -> pa.RecordBatch:
        out_id, out_no, out_lang, out_conf = [], [], [], []
        segments, doc, order = [], [], []
        counted = []
        for i, (title, body) in enumerate(zip(titles, bodies, strict=True)):
            lines = lines_of(body) if body else []
            own = [(no + 1, x) for no, (x, code) in enumerate(lines) if not code]
            from_body = any(LETTERS.search(x) for _, x in own)
            own = own if from_body else [(0, title or "")]
            counted.append(from_body)
            segments += [x for _, x in own]
            order += [no for no, _ in own]
            doc += [i] * len(own)
        doc, order = np.array(doc), np.array(order)
        ll, letters = likelihoods(segments, table)
        post, pi = mixtures(ll, doc, len(ids))
        own = post.argmax(1)
        weight = np.zeros((len(ids), table.shape[1]))
        np.add.at(weight, (doc, own), letters)
        main = weight.argmax(1)
        starts = np.searchsorted(doc, np.arange(len(ids)))
        whole = _softmax(np.add.reduceat(ll, starts, axis=0))
        mixed = (np.add.reduceat(np.eye(table.shape[1])[own] * (letters > 0)[:, None], starts, axis=0) > 0).sum(1) > 1
        for i in range(len(ids)):
            told = weight[i].sum() > 0
            out_id.append(ids[i])
            out_no.append(0)
            out_lang.append(LANGUAGES[main[i]] if told else None)
            out_conf.append(float(pi[i, main[i]] if mixed[i] else whole[i, main[i]]) if told else None)
        for j in np.flatnonzero(mixed[doc] & (order > 0)):
            out_id.append(ids[doc[j]])
            out_no.append(int(order[j]))
            out_lang.append(LANGUAGES[own[j]])
            out_conf.append(float(post[j, own[j]]))
        return pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out_no, pa.int32()), pa.array(out_lang, pa.string()), pa.array(out_conf, pa.float64())], ["id", "seg_no", "lang", "confidence"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                yield one(*[whole.column(c).slice(at, 500).to_pylist() for c in ("id", "title", "body")])

    return run


def _records(df: DataFrame, id_column: str, title: str, body: str) -> DataFrame:
    return df.filter(F.col(f"`{id_column}`").isNotNull()).select(*[F.col(f"`{c}`").cast("string").alias(a) for c, a in ((id_column, "id"), (title, "title"), (body, "body"))])


def current_labels(labels: DataFrame, id_column: str, label: str, at: str) -> DataFrame:
    """(id, named: the language of the latest label, or null), one row an id."""
    latest = labels.groupBy(F.col(f"`{id_column}`").cast("string").alias("id")).agg(F.max(F.struct(F.col(f"`{at}`").alias("t"), F.col(f"`{label}`").alias("l"))).alias("s"))
    return latest.select("id", label_language(F.col("s.l")).alias("named"))


def fit_models(records: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Models from at most `sample` labelled records a language, chosen by the hash of their id; None if there are none."""
    known = labels.filter("named is not null").withColumn("h", F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)))
    counts = {r["named"]: r["count"] for r in known.groupBy("named").count().collect()}
    if not counts:
        return None
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, sample / n) * (1 << 30)))])
    chosen = materialize(known.filter(F.col("h") < bound[F.col("named")]).limit(2 * sample * len(LANGUAGES)).select("id", "named"))
    drawn = materialize(records.join(F.broadcast(chosen), "id").select("id", "title", "body", "named", (F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("body", F.lit("")))).alias("n")))
    run = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))  # over the sample, which is bounded
    kept = drawn.select("id", "n").distinct().withColumn("run", run).filter(F.col("run") <= SAMPLE_CHARS).select("id")
    rows = drawn.join(kept, "id", "left_semi").select("id", "title", "body", "named").toArrow().sort_by("id").to_pylist()
    texts, given = [], []
    for r in rows:
        lines = [x for x, code in lines_of(r["body"] or "") if not code] + [r["title"] or ""]
        texts += lines
        given += [LANGUAGES.index(r["named"])] * len(lines)
    return fit(texts, given) if texts else None


def languages(df: DataFrame, labels: DataFrame, id_column: str = "id", title: str = "title", body: str = "body", label_id: str = "node_id", label: str = "lang", labelled_at: str = "labelled_at") -> DataFrame:
    """(id, seg_no, lang, confidence): segment 0 is the main language of each record, segments 1, 2, ... the non-blank lines of a mixed body.

    Language and confidence are null where there is no letter at all. The title counts if the body has no letters. Code
    has no language. The confidence of segment 0 is the posterior of the language, for a mixed body its proportion.
    Without any usable label there is no model and the result is empty. Rows without an id are left out; a row that
    comes twice comes out twice; other columns are ignored."""
    records = _records(df, id_column, title, body)
    table = fit_models(records, current_labels(labels, label_id, label, labelled_at))
    if table is None:
        return df.sparkSession.createDataFrame([], SEGMENTS)
    return records.mapInArrow(segmenter(table), SEGMENTS)


def wrong_labels(segments: DataFrame, labels: DataFrame, label_id: str = "node_id", label: str = "lang", labelled_at: str = "labelled_at") -> DataFrame:
    """Segments 0 whose record has no label, a meaningless one or one of another language, and all other segments."""
    named = current_labels(labels, label_id, label, labelled_at)
    joined = segments.join(named, "id", "left")
    return joined.filter("seg_no > 0 or (lang is not null and (named is null or named != lang))").select(*segments.columns)
