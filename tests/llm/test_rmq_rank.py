import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import rmq_rank

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _plain(docs, items, k=20):
    """Every document scored for every item: multiset of result rows."""
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for i, c, size in counted:
            m = 100 - 25 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        for r, (s, _, _, i) in enumerate(sorted(scores)[:k]):
            out[item, r + 1, i, -s] += 1
    return out


def _rows(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def _texts(rng, n, words):
    weight = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weight, k=rng.choice([0, 1, 3, 20, 200]))) for _ in range(n)]


WORDS = [w + x for w in ("the", "of", "Straße", "éa", "x1", "ÄB", "night") for x in ("", "a", "bo", "cum", "dex", "9", "ü")]


def test_equals_scoring_every_document(spark):
    rng = random.Random(3)
    docs = list(enumerate(_texts(rng, 900, WORDS)))
    docs += [(2000 + i, docs[7][1] + " rare") for i in range(400)]                # copies: ties by id
    items = list(enumerate(_texts(rng, 25, WORDS))) + [(90, "rare the THE"), (91, "nothing?"), (92, "")]
    got = rmq_rank.rank_documents(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS))
    assert _rows(got) == _plain(docs, items)


def test_small_shards_and_blocks_of_items(spark, monkeypatch):
    rng = random.Random(4)
    docs = list(enumerate(_texts(rng, 300, WORDS)))
    items = list(enumerate(_texts(rng, 30, WORDS)))
    got = rmq_rank.rank_documents(spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(items, ITEMS), k=7, max_term_bytes=4000)
    assert _rows(got) == _plain(docs, items, k=7)


def test_ties_between_shards_of_a_task(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(rmq_rank, "SHARD_DOCS", 1)                                # a shard for each slice of 1,024 documents
    texts = _texts(rng, 40, WORDS)
    docs = [(i, texts[i % 40]) for i in rng.sample(range(9000), 4000)] + [(None, texts[0])] * 3
    items = list(enumerate(texts[:20]))
    got = rmq_rank.rank_documents(spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(items, ITEMS))
    assert _rows(got) == _plain(docs, items)


def test_nulls_long_texts_repeats_and_other_columns(spark):
    docs = [(1, None), (2, ""), (3, "...,"), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (5, "ALPHA\x00beta\tÉ"),
            (6, "alpha " * 50_000 + "gamma"), (7, "x" * 100_000), (8, "gamma")]
    items = [(1, "Alpha gamma É"), (1, "Alpha gamma É"), (2, None), (None, "beta"), (3, "x" * 100_000), (4, "alpha alpha"), (4, "gamma")]
    d = spark.createDataFrame(docs, DOCS).withColumn("n", F.lit("z")).withColumn("terms", F.lit(1)).withColumn("score", F.lit(0)).repartition(3)
    i = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(3)).withColumn("size", F.lit(3))
    assert _rows(rmq_rank.rank_documents(d, i)) == _plain(docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_empty_tables(spark, docs, items):
    got = rmq_rank.rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_pieces_end_between_terms(monkeypatch):
    monkeypatch.setattr(rmq_rank, "PIECE_BYTES", 7)
    text = "Ab cdefghijklmnop É, qr  stu-vw xyz".encode()
    assert [w for piece in rmq_rank.words(text) for w in piece] == [w.encode() for w in TERM.findall(text.decode().translate(LOWER))]


def test_search_of_shards_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    n_docs, n_terms = 4000, 40
    doc = np.repeat(np.arange(n_docs), 8)
    term = rng.integers(0, n_terms, len(doc))
    doc, term = np.unique(np.stack([doc, term]), axis=1)
    impact = rng.integers(1, 1000, len(doc))
    impact[(doc > 500) & (doc < 520)] *= 50
    shard = rmq_rank.Shard(doc, term, impact, n_docs)
    for terms in ([3], [1, 2, 39], list(range(0, 40, 3))):
        terms = np.array(terms)
        factor = rng.integers(0, 9, len(terms)) + 1
        score = np.zeros(n_docs, dtype=np.int64)
        for t, f in zip(terms, factor):
            score[doc[term == t]] += impact[term == t] * f
        top, visits = rmq_rank.Top(10), []
        rmq_rank.search(shard, terms, factor, top, visits)
        order = np.lexsort((np.arange(n_docs), -score))[:10]
        assert top.score.tolist() == score[order].tolist() and top.place.tolist() == order.tolist()
        assert sum(visits) < n_docs / 2


def test_query_keeps_64_bit_lengths():
    n = np.array([10 ** 12, 5])
    assert rmq_rank.lengths(n, 10 ** 9, 10 ** 12).tolist() == [75 + 25 * 10 ** 9, 75]
