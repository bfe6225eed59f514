"""Toxicity scores: boosted trees over dense text features, isotonic
calibration (operator 10).

1. A bounded sample of labelled rows (``max_labelled``, chosen by a hash of the
   id) teaches a lexicon: words and word beginnings that are far commoner in
   toxic than in clean documents, weighted by smoothed log-odds.
2. Every document becomes one row of dense features: lexicon densities and
   weights, nearness of second-person words to lexicon hits, capitals,
   punctuation and obfuscation rates.  The sample's own features use a lexicon
   learned from the other half of the sample, so the trees never see a word
   they helped to list.
3. Gradient-boosted trees are fitted on 4/5 of the sample, isotonic regression
   maps their margins to probabilities on the rest.

All documents are scored in one pass; nothing but the sample is shuffled.

Edge cases: null text counts as empty; empty texts get the score of a document
without words; labels that are null or not 0/1 and repeated label rows of one
id (the largest counts) are handled; if the sample lacks a class, the score is
its share of toxic rows (0 without labels).  Extra columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LABELLED = 20_000         # expected size of the labelled sample
LEXICON_ENTRIES = 4_000       # per lexicon
MIN_SUPPORT = 4               # toxic documents that hold the entry
MIN_LOG_ODDS = 2.5
STEM_CHARS = (4, 5, 6)
STRONG = 4.5                  # log-odds from which an entry counts as strong
NEAR_WORDS = 4
WORD_TABLE_ENTRIES = 150_000
SLICE_ROWS = 64               # texts whose words are summed together

# fixed values: second-person words of the four languages of the corpus
SECOND_PERSON = ("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
                 "ihr euch euer tú ti tuyo usted ustedes vosotros os vuestro").split()
# fixed values: characters written in place of letters
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "l"})

FEATURES = ["log_words", "hit_density", "strong_density", "log_hits", "log_strong", "weight_density",
            "max_weight", "second_weight", "log_distinct_strong", "near_second_person", "second_person_rate",
            "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "obfuscated_rate",
            "masked_hits", "spelled_hits"]

_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    return _EDGE.sub("", word.lower())


def entries(word: str) -> Iterator[str]:
    """What a plain word can match in the lexicon: itself and its beginnings."""
    yield word
    for k in STEM_CHARS:
        if len(word) > k:
            yield word[:k] + "*"


class Lexicon:
    """Word properties through a bounded table: each distinct word form is
    analysed once per task, a text is then a few array sums."""

    WEIGHT, STRONG, SECOND, LETTERS, CAPS, SHOUT, PUNCT, EXCLAM, OBFUSCATED, MASKED, SINGLE = range(11)

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.heads = {e[:STEM_CHARS[0]] for e in weights if len(e) > STEM_CHARS[0]}
        self.short = {e for e in weights if len(e) <= STEM_CHARS[0]}
        self.second = frozenset(SECOND_PERSON)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.array = np.zeros((4_096, 11), dtype=np.float32)      # grows by doubling; a row for each word of the index

    def weight(self, word: str) -> float:
        if word[:STEM_CHARS[0]] not in self.heads and word not in self.short:
            return 0.0
        get = self.weights.get
        return max((get(e, 0.0) for e in entries(word)), default=0.0)

    def analyse(self, word: str) -> tuple:
        core = word.rstrip(".,")
        if core.isalpha():                          # nearly all words
            low = core.lower()
            w = self.weight(low)
            caps = 0 if low == core else sum(map(str.isupper, core))
            return (w, w >= STRONG, low in self.second, len(core), caps, caps > 1 and caps == len(core),
                    len(word) - len(core), 0, False, False, len(core) == 1)
        p = plain(word)
        w = self.weight(p)
        masked = False
        inner = not p.isalpha()
        if inner and w < STRONG and len(p) <= 64:
            for form in {_INNER.sub("", p.translate(LEET)), _INNER.sub("", p)}:
                v = self.weight(form)
                if v > w and v >= STRONG:
                    w, masked = v, True
        letters = sum(map(str.isalpha, word))
        caps = sum(map(str.isupper, word))
        return (w, w >= STRONG, p in self.second, letters, caps, caps > 1 and caps == letters,
                len(word) - sum(map(str.isalnum, word)), word.count("!") + word.count("?"),
                inner and letters > 0, masked, len(p) == 1 and not inner)

    def features(self, texts: list[str]) -> list[list[float]]:
        """Feature rows of some texts, summed over all their words at once."""
        words = [t.split() for t in texts]
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if len(self.index) > WORD_TABLE_ENTRIES:
            self.clear()
        index = self.index
        known = len(index)
        fresh: list[tuple] = []
        for ws in words:
            for w in ws:
                if w not in index:
                    index[w] = known + len(fresh)
                    fresh.append(self.analyse(w))
        if fresh:
            while len(self.array) < known + len(fresh):
                self.array = np.concatenate([self.array, np.zeros_like(self.array)])
            self.array[known:known + len(fresh)] = fresh
        ids = np.fromiter((index[w] for ws in words for w in ws), dtype=np.int64, count=int(counts.sum()))
        ends = np.cumsum(counts)
        starts = ends - counts
        some = counts > 0
        sums = np.zeros((len(texts), 11))
        if some.any():
            sums[some] = np.add.reduceat(self.array[ids], starts[some], axis=0, dtype=np.float64)
        return [self._row(ws, ids[a:b], s) if b > a else [0.0] * len(FEATURES)
                for ws, a, b, s in zip(words, starts.tolist(), ends.tolist(), sums)]

    def _row(self, words: list[str], ids: np.ndarray, s: np.ndarray) -> list[float]:
        n = len(words)
        s = s.tolist()
        hits = strong = distinct = near = spelled = 0
        first = second_best = 0.0
        if s[self.WEIGHT] > 0:
            a = self.array[ids]
            weight = a[:, self.WEIGHT]
            at = np.flatnonzero(weight > 0)
            hits = len(at)
            top = np.sort(weight[at])[-2:].tolist()
            first, second_best = top[-1], top[0] if hits > 1 else 0.0
            where = np.flatnonzero(a[:, self.STRONG] > 0)
            strong, distinct = len(where), len(np.unique(ids[where]))
            person = np.flatnonzero(a[:, self.SECOND] > 0)
            if strong and len(person):
                near = int((np.searchsorted(person, where + NEAR_WORDS, side="right")
                            > np.searchsorted(person, where - NEAR_WORDS)).sum())
        if s[self.SINGLE] >= 4:
            spelled = self.spelled(words, self.array[ids, self.SINGLE])
        return [math.log1p(n), hits / n, strong / n, math.log1p(hits), math.log1p(strong),
                s[self.WEIGHT] / n, first, second_best, math.log1p(distinct), near / n, s[self.SECOND] / n,
                s[self.CAPS] / max(1.0, s[self.LETTERS]), s[self.SHOUT] / n,
                s[self.PUNCT] / max(1.0, s[self.PUNCT] + s[self.LETTERS]), s[self.EXCLAM] / n,
                s[self.OBFUSCATED] / n, math.log1p(s[self.MASKED]), math.log1p(spelled)]

    def spelled(self, words: list[str], single: np.ndarray) -> int:
        """Lexicon words written letter by letter ("i d i o t")."""
        edge = np.diff(np.concatenate([[0], (single > 0).astype(np.int8), [0]]))
        found = 0
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a >= 4:
                found += self.weight("".join(plain(w) for w in words[a:b])) >= STRONG
        return found


def text_features(text: Column, weights: dict[str, float]) -> Column:
    """``array<double>`` in the order of FEATURES; null text counts as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(weights)
        for batch in batches:
            rows: list[list[float]] = []
            for start in range(0, len(batch), SLICE_ROWS):
                rows += lexicon.features([t or "" for t in batch.slice(start, SLICE_ROWS).to_pylist()])
            yield pa.array(rows, pa.list_(pa.float64()))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(text)


def _entry_counts(sample: DataFrame) -> DataFrame:
    """(entry, half, toxic) -> documents that hold the entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        for batch in batches:
            counts: Counter = Counter()
            for text, half, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = {e for w in {plain(w) for w in (text or "").split()} if w for e in entries(w)}
                counts.update((e, half, toxic) for e in found if len(e) <= 64)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
                names=["entry", "half", "toxic", "n"])

    return (sample.select("text", "half", "toxic").mapInArrow(run, "entry string, half int, toxic int, n long")
            .groupBy("entry").agg(*[F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{h}{t}")
                                    for h in (0, 1) for t in (0, 1)]))


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Lexicons without half 0, without half 1 and from all rows; each holds at
    most LEXICON_ENTRIES entries, so they are small enough for the driver."""
    totals = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    counts = _entry_counts(sample).filter((F.col("n01") + F.col("n11")) >= 2).checkpoint()
    out = []
    for halves in ((1,), (0,), (0, 1)):
        pos = sum((F.col(f"n{h}1") for h in halves), F.lit(0))
        neg = sum((F.col(f"n{h}0") for h in halves), F.lit(0))
        n_pos = sum(totals.get((h, 1), 0) for h in halves)
        n_neg = sum(totals.get((h, 0), 0) for h in halves)
        odds = F.log((pos + 0.5) / F.lit(n_pos + 1.0)) - F.log((neg + 0.5) / F.lit(n_neg + 1.0))
        support = MIN_SUPPORT if n_pos >= 200 else 2
        rows = (counts.filter(pos >= support).select("entry", odds.alias("w"), pos.alias("pos"))
                .filter(F.col("w") >= MIN_LOG_ODDS)
                .orderBy(F.desc(F.col("w") * F.log1p("pos")), "entry").limit(LEXICON_ENTRIES).collect())
        out.append({r.entry: r.w for r in rows})
    return out


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; ``trees`` is None without two classes."""

    weights: dict[str, float]
    trees: object | None
    calibration: object | None
    base_rate: float

    def score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """Adds ``out`` (double, 0 to 1) to every row."""
        from pyspark.ml.functions import array_to_vector
        if self.trees is None:
            return docs.withColumn(out, F.lit(float(self.base_rate)))
        # the row travels as one struct, so no column of the input can clash
        # with the columns that the fitted stages add
        x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out]).alias("__row"),
                        array_to_vector(text_features(F.col(f"`{text}`"), self.weights)).alias("__x"))
        scored = self.calibration.transform(_margins(self.trees, x))
        return scored.select("__row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__p"))).alias(out))


def _margins(trees, x: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return (trees.transform(x).withColumn("__margin", vector_to_array("rawPrediction")[1])
            .drop("rawPrediction", "probability", "prediction"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_labelled: int = MAX_LABELLED,
        doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fits on labelled rows for which ``train`` (an expression over the id) is
    true.  The sample's size is ``max_labelled`` in expectation at most; it is
    joined by broadcast for that reason."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    known = (labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).filter(train)
             .groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("toxic")))
    n = known.count()
    mix = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    keep = min(1.0, max_labelled / n) if n else 1.0
    ids = known.filter(mix < int(keep * (1 << 30))).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int"))
    sample = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
              .join(F.broadcast(ids), "id").checkpoint())
    classes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        return ToxicityModel({}, None, None, 1.0 if classes.get(1) else 0.0)
    without0, without1, weights = learn_lexicons(sample)
    slot = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5))
    part = [sample.filter(F.col("half") == h).withColumn("__x", array_to_vector(text_features(F.col("text"), w)))
            for h, w in ((0, without0), (1, without1))]
    x = (part[0].unionByName(part[1]).select("__x", F.col("toxic").cast("double").alias("toxic"), slot.alias("slot"))
         .coalesce(4).checkpoint())
    grown = x.filter("slot > 0")
    if grown.select("toxic").distinct().count() < 2:
        grown = x
    trees = GBTClassifier(featuresCol="__x", labelCol="toxic", maxIter=20, maxDepth=4, stepSize=0.3, maxBins=64,
                          minInstancesPerNode=3, seed=7).fit(grown)
    rest = x.filter("slot = 0")
    if rest.select("toxic").distinct().count() < 2:
        rest = x
    calibration = IsotonicRegression(featuresCol="__margin", labelCol="toxic", predictionCol="__p").fit(_margins(trees, rest))
    total = sum(classes.values())
    return ToxicityModel(weights, trees, calibration, classes.get(1, 0) / total)
