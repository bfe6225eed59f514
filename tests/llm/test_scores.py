"""Operators 5, 7 and 10."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tagweave.llm import crosspoly, toxicity
from tagweave.llm import lattice_lm as LM
from tagweave.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 257)))
    lat = LM.Lattice(pieces, logp)
    for word in ("ab", "aab", "abab", "xé", "a" * 9):
        s = LM.MARK + word
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            p = 1.0
            for a, b in zip(at, at[1:]):
                part = s[a:b]
                if part in lat.index:
                    p *= math.exp(lat.logp[lat.index[part]])
                elif len(part) == 1:
                    p *= math.prod(math.exp(lat.logp[lat.bytes0 + x]) for x in part.encode())
                else:
                    p = 0.0
            total += p
        assert math.isclose(lat.word(word.encode()), math.log(total), rel_tol=1e-9)


def test_words_of_one_length_together(monkeypatch):
    import random
    rng = random.Random(3)
    pieces = LM.read_pieces(LM.read_model_file(__import__("public_tokenizers").path("piece_bpe_32k.model")))
    lat = LM.Lattice(pieces, LM.piece_weights(len(pieces)))
    assert math.isclose(np.exp(LM.piece_weights(len(pieces))).sum(), 1.0)
    words = ["".join(rng.choices("abcdeéß日本the\x00😀", k=rng.randint(1, 20))).encode() for _ in range(800)]
    words += [b"", b"\xff\xfe", "é".encode(), b"international", b"x" * 63, b"x" * 64, b"y" * 500]
    assert np.allclose(lat.words(words), [lat.word(w) for w in words], rtol=1e-9)


def test_scores_equal_word_by_word(spark, monkeypatch):
    from pyspark.sql import functions as F
    import public_tokenizers as PT
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").limit(40).collect()] + [(1, None), (2, ""), (3, "Zz zz " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit("x")).withColumn("row", F.lit(1)).withColumn("word", F.lit(2))
    pieces = LM.read_pieces(LM.read_model_file(PT.path("piece_bpe_32k.model")))
    lat = LM.Lattice(pieces, LM.piece_weights(len(pieces)))
    want = sorted((i, round((sum(lat.word(w) for w in LM.words_of(t)) + lat.logp[lat.end]) / math.log(10), 6)) for i, t in rows)
    for frequent in (300_000, 40):
        monkeypatch.setattr(LM, "FREQUENT_WORDS", frequent)
        out = LM.score_documents(df, F.col("doc_id") % 3 != 0, PT.path("piece_bpe_32k.model")).collect()
        assert np.allclose([s for _, s in sorted((r.doc_id, r.score) for r in out)], [s for _, s in want], atol=1e-4)
    assert LM.score_documents(df.limit(0), F.lit(True), PT.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("frequent", [300_000, 50])
def test_base_scores_equal_brute_force(spark, table_dir, monkeypatch, frequent):
    monkeypatch.setattr(LM, "FREQUENT_WORDS", frequent)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").limit(60).collect()]
    rows += [(9000, None), (9001, ""), (9002, "A a\x0ba b\x1cc"), (9002, "A a\x0ba b\x1cc"), (None, "zz zz"), (9003, "q" * 3000)]
    d = table_dir(spark, "documents", rows, "doc_id long, text string")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [LM.words_of(t) for i, t in rows if not held(i)]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()) + len(train), len(c) + 1
    base = lambda ws: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
    want = sorted((-1 if i is None else i, held(i), len(ws) + 1, sum(w in c for w in ws) + 1, n, round(base(ws), 5))
                  for i, t in rows for ws in [LM.words_of(t)])
    got = Q.op5_lattice(spark, d).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_no_training_rows(spark):
    from pyspark.sql import functions as F
    import public_tokenizers as PT
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = LM.score_documents(df, F.lit(False), PT.path("piece_bpe_32k.model")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0.0 and r.score < 0


@pytest.mark.parametrize("frequent", [300_000, 500])
def test_learned_scores_follow_the_base_on_held_out_rows(spark, monkeypatch, frequent):
    import public_tokenizers as PT
    monkeypatch.setattr(LM, "FREQUENT_WORDS", frequent)
    got = Q.op5_lattice(spark, SF).collect()
    texts = spark.read.parquet(SF + "/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [LM.words_of(r.text) for r in texts if not held(r.doc_id)]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()) + len(train), len(c) + 1
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    pieces = LM.read_pieces(LM.read_model_file(PT.path("piece_bpe_32k.model")))
    lat = LM.Lattice(pieces, LM.piece_weights(len(pieces)))
    prior = np.exp(lat.logp)
    p = 1000 * prior + lat.expected([w for w in c if c[w] == 1])
    p[-1] = 0
    p = p / p.sum() * (1 - prior[-1])
    p[-1] = prior[-1]
    lat = LM.Lattice(pieces, np.log(p))
    all_words = list({w for r in texts for w in LM.words_of(r.text)})
    x = dict(zip(all_words, lat.words(all_words)))
    log10 = lambda count, lp: (math.log10((count - d) / n + d * v / n * math.exp(lp)) if count
                               else (math.log(d * v / n) + lp) / math.log(10))
    want = {r.doc_id: sum(log10(c[w], x[w]) for w in LM.words_of(r.text)) + log10(len(train), lat.logp[lat.end]) for r in texts}
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in got) and len(got) == len(texts)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 1.4 * sum(r.base_score for r in out)


def test_expected_counts_over_all_segmentations(monkeypatch):
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 257)))
    lat = LM.Lattice(pieces, logp)
    words = ["ab", "aab", "abab", "xé", "a" * 9, "ab"]
    want = np.zeros(len(logp))
    for word in words:
        s, found = LM.MARK + word, []
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:])]
            if all(p in lat.index or len(p) == 1 for p in parts):
                ks = [k for p in parts for k in ([lat.index[p]] if p in lat.index else [lat.bytes0 + x for x in p.encode()])]
                found.append((math.exp(sum(lat.logp[k] for k in ks)), ks))
        total = sum(p for p, _ in found)
        for p, ks in found:
            np.add.at(want, ks, p / total)
    assert np.allclose(lat.expected([w.encode() for w in words]), want)
    monkeypatch.setattr(LM, "LONG_WORD", 0)
    assert np.allclose(lat.expected([w.encode() for w in words]), want)


def brute_nearest(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for i in ids[ids % 20 == 0].tolist():
        s = x @ x[ids == i][0]
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
        out[i] = [int(b) for _, b in order]
    return out


def recall_of(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for rows in found.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(rows, rows[1:]))
    return sum(len({x[1] for x in found.get(q, [])} & set(w)) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(SF + "/embeddings.parquet").collect()]
    got = Q.op7_crosspoly(spark, SF).collect()
    want = brute_nearest(rows)
    assert recall_of(got, want) >= 0.9 and len(got) == 20 * len(want)


def test_norms_copies_and_bad_vectors(spark, table_dir):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * rng.uniform(0.2, 3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(120)]                    # a hot vector
    bad = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [None] + [1.0] * 11), (2080, [1.0]), (None, [1.0] * 12)]
    d = table_dir(spark, "embeddings", rows + bad, "vec_id long, embedding array<float>")
    got = Q.op7_crosspoly(spark, d).collect()
    want = brute_nearest(rows)
    assert {r.query_id for r in got} == set(want)
    assert recall_of(got, want) >= 0.9
    mine = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 40]
    assert mine[:1] == [1000] or rows[40][1] is not None


def test_few_rows_and_none(spark, table_dir):
    d = table_dir(spark, "embeddings", [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(Q.op7_crosspoly(spark, d).collect())] == [(0, 1, 1), (0, 2, 2)]
    d = table_dir(spark, "embeddings", [(0, None)], "vec_id long, embedding array<float>")
    assert Q.op7_crosspoly(spark, d).count() == 0


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = crosspoly.rotate(x, 3)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(x @ x.T, y @ y.T)
    assert (crosspoly.axes(np.eye(4) - 2 * np.diag([0, 1, 0, 0]), 1)[:, 0] == [0, 3, 4, 6]).all()


def test_lexicon_features():
    lex = toxicity.Lexicon({"idiot": 8.0, "idio*": 8.0, "mor*": 3.0, "lowei*": 7.0})
    f = dict(zip(toxicity.FEATURES, lex.features(["You i d i o t!! 1d10t loweisch idiot."])[0]))
    assert f["masked_hits"] > 0 and f["spelled_hits"] > 0 and f["max_weight"] == 8.0 and f["strong_density"] > 0
    assert lex.features(["", " "]) == [[0.0] * len(toxicity.FEATURES)] * 2


def test_toxicity_held_out_accuracy_and_edges(spark, table_dir):
    import random
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        w = [word() for _ in range(rng.randint(10, 60))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zorkish", "zorkling", "plomp", "quaxed"])
        docs.append((i, " ".join(w), "extra"))
        labels.append((i, int(bad)))
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "plomp zorker quaxed plomp", "x"), (None, "zz", "x")]
    labels += [(3, None), (None, 1), (1000, 0), (0, 1), (0, 0)]
    table_dir(spark, "documents", docs, "doc_id long, text string, prediction string")
    d = table_dir(spark, "labels", labels, "doc_id long, toxic int")
    rows = Q.op10_toxicity(spark, d).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(700) if got[i].held_out} == set(held)
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) / len(held) > 0.95
    assert got[1002].predicted == 1 and got[1001].predicted == 0


def test_toxicity_without_labels(spark, table_dir):
    table_dir(spark, "documents", [(1, "a")], "doc_id long, text string")
    d = table_dir(spark, "labels", [], "doc_id long, toxic int")
    assert Q.op10_toxicity(spark, d).first().score == 0.0
