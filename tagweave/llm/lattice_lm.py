"""Marginal document probability over all subword segmentations (operator 5).

A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), then an end.
Every word with its start mark is spelled by pieces of an existing vocabulary
(a public tokenizer model; it is not trained) with 256 byte pieces for
characters outside it.  One unigram distribution over pieces and the end gives
each segmentation the product of its pieces; a word's probability is the sum
over *all* its segmentations, by a forward recursion in log space, and a text's
log probability is the sum over its words and the end.

The piece weights are the vocabulary's own, by a fixed rule: this vocabulary's
scores are ranks, so the piece of rank r (from 0) weighs ``1 / (r + 2.7)``, a
byte piece ``BYTE_WEIGHT`` and the end ``END_WEIGHT``, all divided by their sum.

With ``learned`` the training rows are learned from as well.  A word that occurs
in them gets one more arc from its start to its end, of probability (c - d) / N
(absolute discounting; c: its training count, N: all training tokens), and the
pieces share what the discount leaves, d * V / N.  d is n1 / (n1 + 2 * n2), of the
words that occur once and twice.  The end is a token as well.  The sum over all
segmentations is then (c - d) / N + d * V / N * (the sum over pieces), a
distribution over words.  The pieces have to spell words that training lacks, so
their weights become the expected counts (one forward-backward round from the
weights above, which stay as ``PRIOR`` counts) in every training word that occurs
once: without its one occurrence only the pieces would spell it.  Rows outside
training only read the model.

A word's probability depends on the word alone, so every distinct word of the
corpus is scored once, in a table beside its training count; the recursion runs
over all words of one length together.  Words of a text then get both numbers
from that table: the ``FREQUENT_WORDS`` commonest are broadcast (a fixed bound),
the rest go to the table by a join on the word, so no table that grows is
broadcast and no frequent word makes a hot key.

Edge cases: null text counts as empty (only the end); null ids count as
training rows; with no training rows N = V = 0 and the base is uniform;
repeated rows keep their own results, equal counts need no order; an empty
table gives an empty result; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.bounded import commonest
from tagweave.llm.store import Scratch
from tagweave.llm.token_counts import read_model_file

FREQUENT_WORDS = 300_000
BYTE_WEIGHT = 1e-6
END_WEIGHT = 1e-2
PRIOR = 1_000.0
TOGETHER = 65_536             # words scored together
LONG_WORD = 64                # longer words are scored one by one
WORD_TABLE_ENTRIES = 300_000
MARK = "▁"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
NEG = -1e300
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def read_pieces(model: bytes) -> list[str]:
    """The vocabulary's pieces in score order (best first), without control and
    byte pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    found = [(-p.score, i, p.piece) for i, p in enumerate(proto.pieces) if p.type == 1]
    return [piece for _, _, piece in sorted(found)]


class Lattice:
    """Piece log probabilities (natural); index len(pieces) + b is byte b, the
    last index is the end."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.logp = logp.tolist()
        self.bytes0 = len(pieces)
        self.end = len(pieces) + 256
        self.longest = max(map(len, pieces), default=1)
        self.hashed: list | None = None
        self.first = {}
        for p in pieces:                            # longest piece by first character
            self.first[p[0]] = max(self.first.get(p[0], 0), len(p))

    def arcs(self, s: str) -> list[list[tuple[int, float, tuple]]]:
        """Arcs into each position: (from, log probability, piece indices)."""
        n, get, logp = len(s), self.index.get, self.logp
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + self.first.get(s[i], 0)) + 1):
                k = get(s[i:j])
                if k is not None:
                    into[j].append((i, logp[k], (k,)))
                    single |= j == i + 1
            if not single:                          # a character outside the vocabulary: its bytes
                ks = tuple(self.bytes0 + b for b in s[i].encode("utf-8", "replace"))
                into[i + 1].append((i, sum(logp[k] for k in ks), ks))
        return into

    def forward(self, s: str, into=None) -> list[float]:
        alpha = [0.0] + [NEG] * len(s)
        for j, arcs in enumerate(into if into is not None else self.arcs(s)):
            if len(arcs) == 1:
                alpha[j] = alpha[arcs[0][0]] + arcs[0][1]
            elif arcs:
                terms = [alpha[i] + lp for i, lp, _ in arcs]
                top = max(terms)
                alpha[j] = top + math.log(sum([math.exp(t - top) for t in terms]))
        return alpha

    def word(self, word: bytes) -> float:
        """Log probability of a word: the sum over all segmentations."""
        return self.forward(MARK + word.decode("utf-8", "replace"))[-1]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log probabilities of many words, those of one length together."""
        out = np.zeros(len(words))
        marked = [MARK + w.decode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            if n > LONG_WORD:
                out[at] = [self.forward(marked[i])[-1] for i in at]
            else:
                out[at] = self._together("".join([marked[i] for i in at]), len(at), int(n))
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected counts of pieces and bytes over all segmentations of many words."""
        counts = np.zeros(len(self.logp))
        marked = [MARK + w.decode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            if n > LONG_WORD:
                for i in at:
                    self._expected_alone(marked[i], counts)
            else:
                self._together("".join([marked[i] for i in at]), len(at), int(n), counts)
        return counts

    def _expected_alone(self, s: str, counts: np.ndarray) -> None:
        into = self.arcs(s)
        alpha, beta = self.forward(s, into), [NEG] * len(s) + [0.0]
        for j in range(len(s), 0, -1):
            for i, lp, ks in into[j]:
                beta[i] = float(np.logaddexp(beta[i], beta[j] + lp))
                share = math.exp(alpha[i] + lp + beta[j] - alpha[-1])
                for k in ks:
                    counts[k] += share

    def _pieces_by_hash(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sorted hashes, log probabilities, indices) of the pieces of each length."""
        if self.hashed is None:
            self.hashed = [(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0, dtype=np.int64))]
            for n in range(1, self.longest + 1):
                some = [(p, k) for p, k in self.index.items() if len(p) == n]
                codes = np.frombuffer("".join(p for p, _ in some).encode("utf-32-le"), dtype="<u4").reshape(len(some), n)
                h = np.zeros(len(some), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(n):
                        h = h * _BASE + _spread(codes[:, i])
                order = np.argsort(h)
                self.hashed.append((h[order], np.array([self.logp[k] for _, k in some])[order],
                                    np.array([k for _, k in some], dtype=np.int64)[order]))
        return self.hashed

    def _together(self, text: str, rows: int, n: int, counts: np.ndarray | None = None) -> np.ndarray:
        """Forward recursion over the columns of ``rows`` words of ``n`` characters;
        the expected counts of their pieces are added to ``counts``."""
        tables = self._pieces_by_hash()
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").reshape(rows, n)
        char, inverse = np.unique(codes, return_inverse=True)
        spelled = [[self.index[c]] if c in self.index else [self.bytes0 + b for b in c.encode("utf-8", "replace")]
                   for c in map(chr, char.tolist())]
        inverse = inverse.reshape(rows, n)
        single = np.array([sum(self.logp[k] for k in ks) for ks in spelled])[inverse]
        spread = _spread(codes)
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0.0
        arcs: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for i in range(n):
                np.logaddexp(alpha[i + 1], alpha[i] + single[:, i], out=alpha[i + 1])
                h = spread[:, i].copy()
                for m in range(2, min(self.longest, n - i) + 1):
                    h = h * _BASE + spread[:, i + m - 1]
                    hashes, logp, _ = tables[m]
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                        hit = np.flatnonzero(hashes[at] == h)
                        if len(hit):
                            alpha[i + m][hit] = np.logaddexp(alpha[i + m][hit], alpha[i][hit] + logp[at[hit]])
                            if counts is not None:
                                arcs[i].append((m, hit, at[hit]))
        if counts is not None:
            beta = np.full((n + 1, rows), -np.inf)
            beta[n] = 0.0
            of_char = np.zeros(len(char))
            for i in range(n - 1, -1, -1):
                beta[i] = beta[i + 1] + single[:, i]
                of_char += np.bincount(inverse[:, i], np.exp(alpha[i] + beta[i] - alpha[n]), len(char))
                for m, hit, at in arcs[i]:
                    _, logp, index = tables[m]
                    rest = beta[i + m][hit] + logp[at]
                    beta[i][hit] = np.logaddexp(beta[i][hit], rest)
                    counts += np.bincount(index[at], np.exp(alpha[i][hit] + rest - alpha[n][hit]), len(counts))
            for x, ks in zip(of_char.tolist(), spelled):
                for k in ks:
                    counts[k] += x
        return alpha[n]


def _spread(codes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def piece_weights(n_pieces: int) -> np.ndarray:
    """Natural log probabilities of pieces (best first), bytes and the end."""
    p = np.concatenate([1.0 / (np.arange(n_pieces) + 2.7), np.full(256, BYTE_WEIGHT), [END_WEIGHT]])
    return np.log(p / p.sum())


def _word_counts(rows: DataFrame) -> DataFrame:
    """rows(text, train) -> (word binary, c, a): occurrences in training rows
    and in all, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        trained, other = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(trained.keys() | other.keys())
            c = np.fromiter((trained[w] for w in words), dtype=np.int64, count=len(words))
            a = c + np.fromiter((other[w] for w in words), dtype=np.int64, count=len(words))
            trained.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(a)], names=["word", "c", "a"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for t, train in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    (trained if train else other).update(words_of(t))
                if len(trained) + len(other) > WORD_TABLE_ENTRIES:
                    yield out()
        yield out()

    return rows.select("text", "train").mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def fitted_weights(words: DataFrame, model) -> np.ndarray:
    """Natural log probabilities of pieces, bytes and the end: expected counts in
    the words with one training occurrence.  One number a piece reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.value, piece_weights(len(model.value)))
        counts = np.zeros(len(lattice.logp))
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                counts += lattice.expected(whole.slice(start, TOGETHER).column(0).to_pylist())
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["piece", "n"])

    got = words.where("c = 1").select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    prior = np.exp(piece_weights(len(model.value)))
    p = PRIOR * prior
    p[got.column("piece").to_numpy()] += got.column("n").to_numpy()
    p[-1] = 0.0
    p *= (1.0 - prior[-1]) / p.sum()
    p[-1] = prior[-1]
    return np.log(p)


def _scored_words(words: DataFrame, model, weights: np.ndarray) -> DataFrame:
    """Adds ``x``, the natural log probability of each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.value, weights)
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(start, TOGETHER)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lattice.words(b.column(0).to_pylist()))], names=["word", "c", "a", "x"])

    return words.mapInArrow(run, "word binary, c long, a long, x double")


def _with_word_arcs(x: Column, c: Column, n_train: int, discount: float, left: float) -> Column:
    """Log probability of a token from that of its pieces and its training count."""
    pieces = F.lit(math.log(left)) + x
    return F.when(c > 0, F.log((c - F.lit(discount)) / F.lit(float(n_train)) + F.exp(pieces))).otherwise(pieces)


def score_documents(docs: DataFrame, train: Column, model_file: str, doc_id: str = "doc_id", text: str = "text",
                    learned: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every
    row; counts come from the rows for which ``train`` holds.  ``learned`` adds the
    training words as arcs and fits the pieces' weights; without it the score is
    that of the pieces alone, by the vocabulary's own weights."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    pieces = read_pieces(read_model_file(model_file))
    model, weights = spark.sparkContext.broadcast(pieces), piece_weights(len(pieces))
    words = _word_counts(rows)
    if learned:
        words = scratch.put(words, "lm-counts")
        weights = fitted_weights(words, model)
    words = scratch.put(_scored_words(words, model, weights), "lm-words")
    n_texts = rows.filter("train").count()
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count(F.lit(1)).alias("all"),
                     F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n_train, v_train = seen.n + n_texts, seen.v + (n_texts > 0)
    denominator = float(n_train + v_train + 1)
    end = float(weights[-1])
    if learned and n_train:
        once, twice = seen.once + (n_texts == 1), seen.twice + (n_texts == 2)
        discount = once / (once + 2 * twice) if 0 < once and 0 < twice else 0.5
        left = discount * v_train / n_train
        words = words.withColumn("x", _with_word_arcs(F.col("x"), F.col("c"), n_train, discount, left))
        end = math.log((n_texts - discount) / n_train + left * math.exp(end)) if n_texts else math.log(left) + end
    # the commonest words, a bounded list
    frequent = commonest(words, "a", FREQUENT_WORDS).select("word", "c", "x").toArrow()
    complete = frequent.num_rows == seen.all
    state = spark.sparkContext.broadcast(frequent)
    end_base, end_known = math.log10((n_texts + 1) / denominator), int(n_texts > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        table = state.value
        number = {w: i for i, w in enumerate(table.column("word").to_pylist())}
        c = table.column("c").to_numpy()
        base_of, known_of, score_of = np.log10((c + 1) / denominator), (c > 0).astype(np.int64), table.column("x").to_numpy()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                n, n_known, base, score, rare = [], [], [], [], []
                for t in batch.column(2).to_pylist():
                    ws = words_of(t)
                    at = np.fromiter([number.get(w, -1) for w in ws], dtype=np.int64, count=len(ws))
                    hit = at[at >= 0]
                    n.append(len(ws) + 1)
                    n_known.append(end_known + int(known_of[hit].sum()))
                    base.append(end_base + float(base_of[hit].sum()))
                    score.append(end + float(score_of[hit].sum()))
                    rest = Counter([ws[i] for i in np.flatnonzero(at < 0)]) if len(hit) < len(ws) else {}
                    rare.append([{"word": w, "tf": tf} for w, tf in rest.items()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                     pa.array(rare, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))],
                    names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = (rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
              .mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, "
                               "rare array<struct<word:binary,tf:bigint>>"))
    ln10 = math.log(10.0)
    if not complete:
        scored = scratch.put(scored, "lm-scored")        # fixes the row numbers for the join below
        rest = (scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(words.select("word", "c", "x"), "word")
                .groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
                                    F.sum(F.col("tf") * F.log10((F.col("c") + 1) / F.lit(denominator))).alias("more_base"),
                                    F.sum(F.col("tf") * F.col("x")).alias("more_score")))
        scored = (scored.drop("rare").join(rest, "row", "left")
                  .withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0)))
                  .withColumn("base_score", F.col("base_score") + F.coalesce("more_base", F.lit(0.0)))
                  .withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0))))
    out = scored.select("doc_id", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score",
                        (F.col("score") / F.lit(ln10)).alias("score"))
    kept = Scratch(spark).put(out, "lm-result")
    scratch.clear()
    return kept
