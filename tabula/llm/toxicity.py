"""Toxicity scores from a learned lexicon, matched with a Levenshtein automaton.

Fit (labels of the training fold only).  Of the labelled documents, near copies
are counted once and at most ``FIT_ROWS`` of each label, by least hash, are the
sample; that bound is the only one.  Near copies have a label and one of
``SIGNATURES`` whole signatures in common, each of ``HASHES`` min-hashes over the
shingles of ``SHINGLE`` words; a common word or line alone joins no documents.  Words, and word beginnings that many toxic words share, become terms
if toxic documents hold them significantly more often (Chernoff bound of the
binomial tail, corrected for the number of terms looked at).  A short list of common
insults seeds the lexicon; a seed that clean documents use too is dropped.  A
misspelled form that clean documents use is a word of its own and no match, and
a term with several such forms around it matches exactly only.  A logistic
regression weighs exact and misspelled matches, inside and outside quotations;
a form met in one clean document only still counts there while weights are
fitted, as it will for documents not seen yet.

Score (every document, whole text).  Each distinct word walks through the
automaton once per task; matches are then looked up in their context: a match
between quotation marks of its line, or with words of reporting around it,
counts as quoted.  Features are saturating counts, so that a long document that
quotes one word is not a rant.

Edge cases: null and empty texts have no match and get the base score; without
toxic training rows the seeds and the prior weights stand;
labels other than 0 and 1 are left out, and a document with both is toxic; a
null id is in the training fold and has no label; repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.common import stored
from tabula.llm.lexicon import LOOKALIKES, Lexicon

FOLDS = 5
FIT_ROWS = 20_000      # documents of each label in the sample
SHINGLE = 3            # words
SIGNATURES, HASHES = 3, 8
STEM_LENGTHS = (4, 5, 6, 7)
STEM_WORDS = 3         # different toxic words that make their common beginning a stem
MIN_PURITY = 0.95
CHANCE = 0.01          # of any term by luck
CONTEXT = 6            # words on either side
_WORD = re.compile(r"[@$]?\w+(?:[@$]+\w+)*")  # look-alike signs inside or before a word, not a run of them after it
_QUOTES = '"“”„«»'
#: Fixed word list: verbs and nouns that announce a quotation.
REPORTING = frozenset("said says wrote writes called calls quote quoted quoting word words term sagte schrieb nannte wort dijo "
                      "escribió llamó palabra dit écrit appelé mot".split())
#: Fixed word list: common insults.
SEEDS = ("bastard", "clown", "coward", "degenerate", "disgusting", "dumbass", "filth", "garbage", "idiot", "imbecile", "jerk", "loser",
         "maggot", "moron", "parasite", "pathetic", "scum", "scumbag", "stupid", "trash", "vermin", "worthless")
MAX_CLEAN_FORMS = 2    # misspelled forms of a term that clean documents may use before it matches exactly only
FEATURES = ("base", "exact", "exact_quoted", "near", "near_quoted", "density")
PRIOR = np.array([-4.0, 5.0, 1.0, 2.5, 0.5, 0.5])  # weights before any row is seen
PRIOR_WEIGHT = 0.5
_MAX_KNOWN = 300_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    clean_forms: frozenset[str] = frozenset()
    exact: frozenset[str] = frozenset()
    weights: tuple[float, ...] = tuple(PRIOR)


class Scorer:
    """Features and scores of texts; keeps what it has found out about words, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.words, model.stems, model.exact)
        self.known: dict[str, int] = {}

    def _match(self, word: str) -> tuple[int, str] | None:
        m = self.lexicon.match(word)
        plain = word.translate(LOOKALIKES)
        if plain != word and (m is None or m[0] > 0):
            alike = self.lexicon.match(plain)
            m = (max(1, alike[0]), alike[1]) if alike else m
        return m

    def nearest(self, word: str) -> str | None:
        m = self._match(word)
        return m[1] if m else None

    def kind(self, word: str) -> int:
        """0: no match, 1: exact, 2: misspelled."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= _MAX_KNOWN:
                self.known.clear()
            m = self._match(word)
            got = 0 if m is None else 1 if m[0] == 0 else 0 if word in self.model.clean_forms else 2
            self.known[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = _WORD.findall(low)
        kinds = {w: k for w in set(words) if (k := self.kind(w))}
        count = [0, 0, 0, 0]
        if kinds:
            found = list(_WORD.finditer(low))
            for i, m in enumerate(found):
                k = kinds.get(m[0])
                if k:
                    line = low[low.rfind("\n", 0, m.start()) + 1:m.start()]
                    quoted = sum(map(line.count, _QUOTES)) % 2 == 1
                    near = words[max(0, i - CONTEXT):i] + words[i + 1:i + 1 + CONTEXT]
                    count[2 * (k - 1) + (quoted or not REPORTING.isdisjoint(near))] += 1
        density = 100.0 * (count[0] + count[2]) / max(len(words), 20)
        return [1.0, *(math.log1p(min(c, 20)) for c in count), math.log1p(density)]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.model.weights, self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


# ── Fit ───────────────────────────────────────────────────────────────────
def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


_RNG = np.random.default_rng(42)
_MIX = _RNG.integers(1, 1 << 63, size=(2, SIGNATURES * HASHES, 1), dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, size=max(SHINGLE, HASHES), dtype=np.uint64) | np.uint64(1)
_SHIFT = np.uint64(32)


def signatures(hashes: list[int]) -> list[int]:
    """SIGNATURES numbers of a text, given the hashes of its words in order; each stands for HASHES min-hashes of the shingles."""
    h = np.array(hashes, np.uint64)
    least = np.full(SIGNATURES * HASHES, np.iinfo(np.uint64).max, np.uint64)
    size = min(SHINGLE, len(h))
    for lo in range(0, len(h) - size + 1 if size else 0, 1 << 14):
        part = h[lo:lo + (1 << 14) + size - 1]
        x = sum((part[i:len(part) - size + 1 + i] * _PLACE[i] for i in range(size)), np.zeros(len(part) - size + 1, np.uint64))
        x = (x ^ (x >> _SHIFT)) * _PLACE[-1]
        least = np.minimum(least, ((x ^ (x >> _SHIFT)) * _MIX[0] + _MIX[1]).min(1))
    least ^= least >> _SHIFT
    return (least.reshape(SIGNATURES, HASHES) * _PLACE[:HASHES]).sum(1, dtype=np.uint64).view(np.int64).tolist()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        sig = []
        for t in batch.column("text").to_pylist():
            words = words_of(t or "")
            for w in set(words):
                if w not in known:
                    known[w] = zlib.crc32(w.encode())
            sig.append(signatures([known[w] for w in words]))
            if len(known) >= _MAX_KNOWN:
                known.clear()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([s[i] for s in sig], pa.int64()) for i in range(SIGNATURES))],
                                         ["doc_id", *(f"s{i}" for i in range(SIGNATURES))])


def fit_sample(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> DataFrame:
    """(doc_id, y): at most FIT_ROWS training documents of each label, one of each set of near copies."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    y = labels.where(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    names = [f"s{i}" for i in range(SIGNATURES)]
    sigs = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").mapInArrow(
        _signatures, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))
    one = sigs.join(y, "doc_id").withColumn("order", F.xxhash64("doc_id"))
    # A near copy that one signature misses agrees in the next with what the first left.
    for i, n in enumerate(names):
        one = one.groupBy("y", n).agg(F.min(F.struct("order", "doc_id", *names[i + 1:])).alias("d")).select("y", "d.*")
    one = stored(one.distinct(), "fit_documents")
    part = [one.where(F.col("y") == v).orderBy("order", "doc_id").limit(FIT_ROWS) for v in (0, 1)]
    return stored(part[0].union(part[1]).select("doc_id", "y"), "fit_sample")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            terms = {w for w in words_of(text or "") if len(w) < 40}
            seen[y].update(terms)
            seen[y].update({w[:n] + "*" for w in terms for n in STEM_LENGTHS if len(w) >= n})
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([c[t] for t in terms], pa.int64()) for c in (seen[1], seen[0])]],
                                         ["term", "toxic", "clean"])


def _surprise(toxic: int, clean: int, share: float) -> float:
    """Exponent of the Chernoff bound on so many toxic documents among all that hold the term."""
    n = toxic + clean
    p = toxic / n
    rest = (1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0
    return n * (p * math.log(p / share) + rest) if p > share else 0.0


def choose_terms(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int, looked_at: int) -> tuple[list[str], list[str]]:
    """(words, stems) among (term, toxic documents, clean documents); a term that ends in ``*`` is a beginning."""
    share = n_toxic / max(n_toxic + n_clean, 1)
    need = math.log(max(looked_at, 1) / CHANCE)

    def good(t: int, c: int) -> bool:
        pure = t / n_toxic / (t / n_toxic + c / max(n_clean, 1))
        return pure >= MIN_PURITY and _surprise(t, c, share) >= need

    own = {t: n for t, n, c in rows if not t.endswith("*") and n / n_toxic / (n / n_toxic + c / max(n_clean, 1)) >= MIN_PURITY}
    stems: list[str] = []
    for t, n, c in sorted(rows, key=lambda r: len(r[0])):
        stem = t[:-1]
        if t.endswith("*") and good(n, c) and not stem.startswith(tuple(stems) or ("\0",)):
            sizes = {w: k for w, k in own.items() if w.startswith(stem)}
            if len(sizes) >= STEM_WORDS and max(sizes.values()) <= 0.5 * sum(sizes.values()):
                stems.append(os.path.commonprefix(list(sizes)))
    words = [t for t, n, c in rows if not t.endswith("*") and good(n, c) and not t.startswith(tuple(stems) or ("\0",))]
    return sorted(words), sorted(stems)


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a normal prior around ``PRIOR`` (Newton's method; a bounded sample)."""
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + PRIOR_WEIGHT / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + PRIOR_WEIGHT * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRIOR_WEIGHT * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = fit_sample(docs, labels)
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Model(words=list(SEEDS))
    # two rows of an id and a flag for each label at most: bounded by FIT_ROWS
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y"), "fit_texts")
    terms = stored(texts.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term")
                   .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "fit_terms")
    pure = F.col("toxic") / n_toxic >= MIN_PURITY * (F.col("toxic") / n_toxic + F.col("clean") / max(n_clean, 1))
    rows = [tuple(r) for r in terms.where(pure & (F.col("toxic") >= 2)).collect()]  # of the bounded sample
    words, stems = choose_terms(rows, n_toxic, n_clean, terms.count())
    impure = {r.term for r in terms.where(F.col("term").isin(*SEEDS) & ~pure).collect()}
    words = sorted({*words, *(w for w in SEEDS if w not in impure and not w.startswith(tuple(stems) or ("\0",)))})
    draft = Model(words, stems)

    def near_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(draft)
        for batch in batches:
            near = [(t, scorer.nearest(t), n) for t, n in zip(batch.column("term").to_pylist(), batch.column("clean").to_pylist()) if scorer.kind(t) == 2]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in near], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                             ["form", "term", "clean"])

    forms = terms.where("clean > 0 and term not like '%*'").mapInArrow(near_forms, "form string, term string, clean long").collect()
    around = Counter(r.term for r in forms)
    exact = frozenset(t for t, n in around.items() if n > MAX_CLEAN_FORMS)
    model = Model(words, stems, frozenset(r.form for r in forms if r.clean > 1), exact)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y").cast(pa.float64())], ["x", "y"])

    points = texts.mapInArrow(weigh, "x array<double>, y double").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.repeat(np.array([r.x for r in points]), [r.n for r in points], axis=0)
    weights = fit_weights(x, np.repeat(np.array([r.y for r in points]), [r.n for r in points]))
    return Model(words, stems, frozenset(r.form for r in forms), exact, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row, from its whole text and nothing else."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([scorer.score(t) for t in batch.column("text").to_pylist()], pa.float64())],
                                             ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document row."""
    s = score(docs, fit(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
