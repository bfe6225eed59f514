"""Ranked lexical search by range maxima (operator 11).

Every item is a query; its terms are words of ASCII letters, digits and all
characters beyond ASCII, with A-Z lower-cased.  A document's score is the sum of
``weight * impact`` over the item's terms (``weights`` and ``impacts`` below;
integers throughout).

Index.  One pass over all texts counts the items' terms and all words of each
document; document frequencies, the number of documents and of words come from
all of them.  Documents then stand in shards (as many as a task reads, up to
``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings), in the order of their
ids.  A shard holds the posting lists behind one another and a sparse table
over their impacts: level k names the place of the largest of 2^k postings, so
two look-ups give the largest impact of a term in any interval of documents.

Search.  An interval of documents is bounded by the sum of its terms' largest
weighted impacts.  The best intervals are taken first (in growing batches);
each is split at the document with the largest weighted impact, that document
is scored exactly, and the two intervals beside it get their own bounds.
Intervals of at most ``LEAF_DOCS`` documents are scored exactly as a whole.  It
ends when no bound reaches the k-th score so far, which goes on from shard to
shard of a task.  Tasks return the k best of each item; a window ranks them.

Nothing is shuffled but df counts and those k rows an item and task.  The items'
terms are the only broadcast; items whose terms exceed ``MAX_TERM_BYTES`` together
are searched in blocks of that size.

Edge cases: null texts and texts without a term have no score and don't count;
a null document id takes part and ranks behind equal scores with an id; repeated
document rows are documents of their own; repeated item rows count once, and an
item id with several texts is ranked for each; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagweave.llm.store import Scratch

SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 20
LEAF_DOCS = 32
FIRST_BATCH, LAST_BATCH = 8, 256
MAX_TERM_BYTES = 32 << 20
PIECE_BYTES = 4 << 20

# lower-cases A-Z and turns every ASCII sign but letters and digits to a space
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end between terms."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE_BYTES:
            end = at + PIECE_BYTES
            while end < len(text) and _TABLE[text[end]] != 32:
                end += 1
        yield text[at:end].translate(_TABLE).split()
        at = end


def count_terms(text: bytes) -> tuple[int, Counter]:
    n, found = 0, Counter()
    for piece in words(text):
        n += len(piece)
        found.update(piece)
    return n, found


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1)))"""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def lengths(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m = 100 - 25 + (25 n N) div L, exact beyond 64 bits too."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 62:
        return np.array([75 + 25 * int(x) * n_docs // n_words for x in n], dtype=np.int64)
    return 75 + 25 * n.astype(np.int64) * n_docs // n_words


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 12 m)"""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Shard:
    """Posting lists of some documents with a sparse table over their impacts."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, term))
        self.doc, self.n_docs = doc[order].astype(np.int32), n_docs
        self.impact = np.append(impact[order], 0).astype(np.int32)
        self.key = term[order].astype(np.int64) * n_docs + self.doc
        self.doc = np.append(self.doc, -1).astype(np.int32)
        longest = int(np.bincount(term).max()) if len(term) else 0
        place = np.arange(len(self.impact), dtype=np.int32)
        self.table = [place]
        step = 1
        while 2 * step <= longest:
            before = self.table[-1]
            left, right = before[:-step], before[step:]
            level = before.copy()
            level[:len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.table.append(level)
            step *= 2
        self.table = np.stack(self.table)

    def start(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of each term's list."""
        return (np.searchsorted(self.key, terms * self.n_docs).astype(np.int32),
                np.searchsorted(self.key, (terms + 1) * self.n_docs).astype(np.int32))

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the largest impact in every range [lo, hi); the empty
        place at the end for an empty range."""
        size = hi - lo
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        a, b = self.table[level, lo], self.table[level, np.maximum(lo, hi - (1 << level))]
        return np.where(size > 0, np.where(self.impact[a] >= self.impact[b], a, b), len(self.impact) - 1)


class Top:
    """The k best (score, place) of a shard: larger scores, then smaller
    places; scores below ``floor`` are of no use."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.floor = k, floor
        self.score, self.place = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def least(self) -> int:
        return max(self.floor, int(self.score[-1])) if len(self.score) == self.k else self.floor

    def add(self, score: np.ndarray, place: np.ndarray) -> None:
        good = score >= self.least()
        if good.any():
            s, p = np.concatenate([self.score, score[good]]), np.concatenate([self.place, place[good]])
            order = np.lexsort((p, -s))[:self.k]
            self.score, self.place = s[order], p[order]


def search(shard: Shard, terms: np.ndarray, factor: np.ndarray, top: Top, visits: list | None = None) -> None:
    """Adds a shard's best documents for one item to ``top``; ``factor`` is
    weight times the term's repeats in the item."""
    lo0, hi0 = shard.start(terms)
    present = (hi0 > lo0) & (factor > 0)
    terms, factor, lo0, hi0 = terms[present], factor[present], lo0[present], hi0[present]
    if not len(terms):
        return
    base = terms * shard.n_docs

    def bounded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = shard.largest(lo, hi)
        value = shard.impact[place] * factor
        return value.sum(axis=1), shard.doc[place[np.arange(len(place)), value.argmax(axis=1)]]

    first, last = np.zeros(1, dtype=np.int64), np.full(1, shard.n_docs)
    lo, hi = lo0[None, :], hi0[None, :]
    bound, split = bounded(lo, hi)
    batch = FIRST_BATCH
    while True:
        open_ = bound >= top.least()
        if not open_.all():
            first, last, lo, hi, bound, split = (x[open_] for x in (first, last, lo, hi, bound, split))
        if not len(bound):
            return
        best = np.argpartition(-bound, batch)[:batch] if len(bound) > batch else np.arange(len(bound))
        rest = np.ones(len(bound), dtype=bool)
        rest[best] = False
        leaf = last[best] - first[best] <= LEAF_DOCS
        small, wide = best[leaf], best[~leaf]
        if visits is not None:
            visits.append(int((last[small] - first[small]).sum()) + len(wide))
        made = []
        if len(small):
            n = (hi[small] - lo[small]).ravel()
            at = np.repeat(lo[small].ravel() - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            doc, inverse = np.unique(shard.doc[at], return_inverse=True)
            score = np.zeros(len(doc), dtype=np.int64)
            np.add.at(score, inverse, shard.impact[at] * np.repeat(np.tile(factor, len(small)), n))
            top.add(score, doc)
        if len(wide):
            d = split[wide].astype(np.int64)
            at = np.searchsorted(shard.key, base[None, :] + d[:, None]).astype(np.int32)
            hit = (at < hi[wide]) & (shard.doc[at] == d[:, None])
            top.add((np.where(hit, shard.impact[at], 0) * factor).sum(axis=1), d)
            for f, t, a, b in ((first[wide], d, lo[wide], at), (d + 1, last[wide], at + hit, hi[wide])):
                some = np.flatnonzero((b > a).any(axis=1))
                if len(some):
                    made.append((f[some], t[some], a[some], b[some], *bounded(a[some], b[some])))
        first, last, lo, hi, bound, split = (np.concatenate([x[rest], *(m[i] for m in made)])
                                             for i, x in enumerate((first, last, lo, hi, bound, split)))
        batch = min(2 * batch, LAST_BATCH)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind)))


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms, counts, size): the terms of every distinct item row."""
    key = items.schema[item_id]
    schema = T.StructType([T.StructField("item_id", key.dataType), T.StructField("terms", T.ArrayType(T.BinaryType())),
                           T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [count_terms(t or b"")[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                 pa.array([sum(len(t) + 32 for t in c) for c in found], pa.int64())], names=schema.names)

    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text")).distinct()
    return rows.mapInArrow(run, schema).filter("size > 0")


def _counted(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term."""
    key = docs.schema[doc_id]
    schema = T.StructType([T.StructField("doc_id", key.dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for whole in batches:
            for cut in range(0, whole.num_rows, 512):
                b = whole.slice(cut, 512)
                n, terms, tfs = [], [], []
                for i in range(b.num_rows):
                    count, found = count_terms(b.column(1)[i].as_py())
                    n.append(count)
                    known = found.keys() & number.keys()
                    terms.append(np.fromiter(map(number.__getitem__, known), dtype=np.int32, count=len(known)))
                    tfs.append(np.fromiter(map(found.__getitem__, known), dtype=np.int64, count=len(known)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), _lists(terms, np.int32), _lists(tfs, np.int64)],
                                                 names=schema.names)

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).filter("text is not null")
    return rows.mapInArrow(run, schema).filter("n > 0")


def _statistics(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, words, and the documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, dtype=np.int64), 0, 0
        for b in batches:
            docs, total = docs + b.num_rows, total + int(b.column(0).to_numpy().sum())
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at]), pa.int64()),
                                          pa.array(np.concatenate([[docs, total], df[at]]), pa.int64())], names=["term", "c"])

    sums = counted.select("n", "terms").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).toArrow()
    term, c = sums.column("term").to_numpy(), sums.column("c").to_numpy()
    df = np.zeros(n_terms + 2, dtype=np.int64)
    df[term + 2] = c
    return int(df[0]), int(df[1]), df[2:]


def _ranked(counted: DataFrame, asked, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item and task."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), counted.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, n_words = asked.value
        best: list[tuple[np.ndarray, pa.Array] | None] = [None] * len(items)
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def flush() -> None:
            nonlocal docs, postings
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
            held.clear()
            docs = postings = 0
            ids = t.column("doc_id").combine_chunks()
            lists = t.column("terms").combine_chunks()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(t.num_rows), size)
            m = np.repeat(lengths(t.column("n").to_numpy(), n_docs, n_words), size)
            tf = t.column("tfs").combine_chunks().flatten().to_numpy()
            shard = Shard(doc, lists.flatten().to_numpy(), impacts(tf, m), t.num_rows)
            for i, (terms, counts) in enumerate(items):
                before = best[i]
                # the k-th score of earlier shards bounds the search; equal scores are still told apart by id
                top = Top(k, int(before[0][-1]) if before is not None and len(before[0]) == k else 1)
                search(shard, terms, weight[terms] * counts, top)
                if not len(top.score):
                    continue
                score, found = top.score, ids.take(pa.array(top.place))
                if before is not None:
                    score, found = np.concatenate([before[0], score]), pa.concat_arrays([before[1], found])
                    order = pc.sort_indices(pa.table({"score": score, "id": found}), null_placement="at_end",
                                            sort_keys=[("score", "descending"), ("id", "ascending")]).slice(0, k)
                    score, found = score[order.to_numpy()], found.take(order)
                best[i] = score, found

        for b in batches:
            for cut in range(0, b.num_rows, 1024):
                part = b.slice(cut, 1024)
                held.append(part)
                docs, postings = docs + part.num_rows, postings + len(part.column("terms").flatten())
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    flush()
        if held:
            flush()
        for i, found in enumerate(best):
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), i), pa.int32()), found[1], pa.array(found[0])],
                                                 names=schema.names)

    return counted.mapInArrow(run, schema)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", max_term_bytes: int = MAX_TERM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score
    above 0 for every item, ranked from 1; equal scores by ascending id."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())])
    scratch, kept = Scratch(spark), Scratch(spark)
    asked = scratch.put(_item_terms(items, item_id, item_text), "rank-items")
    size = asked.agg(F.sum("size")).first()[0] or 0
    blocks = -(-size // max_term_bytes)
    out = None
    for block in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block)
        rows = mine.collect()                                # at most about max_term_bytes
        if not rows:
            continue
        number: dict[bytes, int] = {}
        lists = [(np.array([number.setdefault(bytes(t), len(number)) for t in r.terms], dtype=np.int64), np.array(r.counts, dtype=np.int64))
                 for r in rows]
        counted = scratch.put(_counted(docs, spark.sparkContext.broadcast(number), doc_id, text), "rank-counted")
        n_docs, n_words, df = _statistics(counted, len(number))
        if not n_docs:
            continue
        plan = spark.sparkContext.broadcast((lists, weights(df, n_docs), n_docs, n_words))
        found = _ranked(counted, plan, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)],
                                      T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", schema["item_id"].dataType)]))
        part = kept.put(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "rank-result")
        out = part if out is None else out.unionByName(part)
    scratch.clear()
    return spark.createDataFrame([], schema) if out is None else out
