import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tagweave.operators import decode as D
from tagweave.operators.evaluate import argmax_decode, masked_cross_entropy


def _score(em, path, tr, st, en):
    return st[path[0]] + en[path[-1]] + sum(em[t][path[t]] for t in range(len(path))) + \
        sum(tr[path[t - 1]][path[t]] for t in range(1, len(path)))


def _case(seed, K, lens):
    rng = np.random.default_rng(seed)
    tr = rng.normal(size=(K, K)).round(3).tolist()
    st = rng.normal(size=K).round(3).tolist()
    en = rng.normal(size=K).round(3).tolist()
    ems = [rng.normal(size=(L, K)).round(3).tolist() for L in lens]
    return tr, st, en, ems


def test_viterbi_brute_force(spark):
    for K in (2, 3, 4):
        tr, st, en, ems = _case(K, K, [1, 2, 3, 5, 6, 4])
        df = spark.createDataFrame([(i, e) for i, e in enumerate(ems)], "sid long, em array<array<double>>")
        got = {r.sid: list(r.path) for r in D.viterbi_decode(df, "em", tr, st, en).collect()}
        for i, em in enumerate(ems):
            best = max(itertools.product(range(K), repeat=len(em)), key=lambda p: _score(em, p, tr, st, en))
            assert math.isclose(_score(em, got[i], tr, st, en), _score(em, best, tr, st, en), abs_tol=1e-9)


def test_sequence_nll_brute_force(spark):
    K = 3
    tr, st, en, ems = _case(11, K, [1, 4, 2])
    labels = [[(t * 2 + i) % K for t in range(len(e))] for i, e in enumerate(ems)]
    df = spark.createDataFrame([(i, e, y) for i, (e, y) in enumerate(zip(ems, labels))],
                               "sid long, em array<array<double>>, y array<int>")
    got = D.sequence_nll(df, "em", "y", tr, st, en).collect()[0].nll
    exp = 0.0
    for em, y in zip(ems, labels):
        logz = math.log(sum(math.exp(_score(em, p, tr, st, en))
                            for p in itertools.product(range(K), repeat=len(em))))
        exp += logz - _score(em, y, tr, st, en)
    assert math.isclose(got, exp, rel_tol=1e-9)


def test_argmax_and_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 2), ([0.0, 0.0, 5.0], -1)], "logits array<double>, label int")
    assert [r.pred_id for r in argmax_decode(df).collect()] == [1, 2]
    r = masked_cross_entropy(df).collect()[0]
    x = [1.0, 3.0, 3.0]
    exp = math.log(sum(math.exp(v) for v in x)) - x[2]
    assert r.n_tokens == 1 and math.isclose(r.loss, exp)


def _model(spark, seed=1):
    import random

    from tagweave.operators import tagger as TG
    rng = random.Random(seed)
    words, tags = [f"w{i}" for i in range(12)], ["O", "B-X", "I-X", "B-Y"]
    rows = [(s, i, rng.choice(words), rng.choice(tags)) for s in range(20) for i in range(rng.randint(1, 9))]
    return TG.train_tag_model(spark.createDataFrame(rows, "sent_id long, pos int, token string, tag string"))


def test_blocks_decode_as_one_piece():
    rng = np.random.default_rng(4)
    for n, k in ((1, 3), (7, 3), (40, 4)):
        for high in (3, 1000):                                     # small whole numbers: many ties
            em, trans = rng.integers(-high, 0, (n, k)).astype(float), rng.integers(-high, 0, (k, k)).astype(float)
            start, end = rng.integers(-high, 0, k).astype(float), rng.integers(-high, 0, k).astype(float)
            want = D._viterbi_one(em, trans, start, end)
            cuts = [em[i:i + 5] for i in range(0, n, 5)]
            entry, before, after = start, [], []
            for c in cuts:
                before.append(entry)
                score = (entry[:, None] + D.block_product(c, trans)).max(axis=0)
                assert (score == D.block_forward(c, trans, entry)[0]).all()
                after.append(score)
                entry = (score[:, None] + trans).max(axis=0)
            last, path = int((after[-1] + end).argmax()), []
            for b in range(len(cuts) - 1, -1, -1):
                back = D.block_forward(cuts[b], trans, before[b])[1]
                path = D.block_trace(back, last).tolist() + path
                if b:
                    last = int((after[b - 1] + trans[:, D.block_firsts(back)[last]]).argmax())
            assert path == want.tolist()


def test_predict_tags_in_blocks_and_by_joins(spark):
    import random

    from tagweave.operators import tagger as TG
    rng = random.Random(2)
    model = _model(spark).checkpoint()
    lines = [(i, " ".join(rng.choices(["w1", "W2", "w3", "w11", "new", ""], k=rng.choice([1, 2, 5, 60])))) for i in range(25)]
    lines += [(100, ""), (101, "  "), (102, None), (103, "w1\u3000w2 w3 ")]
    df = spark.createDataFrame(lines, "sent_id long, text string").repartition(3)
    rows = lambda d: sorted(map(tuple, d.collect()))
    whole = rows(TG.predict_tags(df, model))
    assert sorted({r[0] for r in whole}) == [*range(25), 100, 101, 103] and len(whole) == sum(len(t.strip().split(" ")) for _, t in lines if t is not None)
    assert rows(TG.predict_tags(df, model, block_tokens=7)) == whole
    assert rows(TG.predict_tags(df, model, max_shipped=0)) == whole
    assert rows(TG.predict_tags(df, model, block_tokens=7, max_shipped=0)) == whole
    # no path scores better: brute force over short lines
    tags = TG.model_tags(model)
    trans, start, end = (np.round(np.array(m) / TG.SCORE_UNIT) for m in TG._small_matrices(model, tags))
    em = {r.w: r.em for r in TG._emission_table(model, tags)[0].collect()}
    unknown = TG._emission_table(model, tags)[1]
    for i, text in lines:
        words = (text or "").strip().split(" ")
        if text is None or len(words) > 5:
            continue
        e = np.array([em.get(w.lower(), unknown) for w in words])
        score = lambda p: start[p[0]] + end[p[-1]] + sum(e[t][x] for t, x in enumerate(p)) + sum(trans[a][b] for a, b in zip(p, p[1:]))
        best = max(score(p) for p in itertools.product(range(len(tags)), repeat=len(words)))
        assert score([tags.index(r[3]) for r in whole if r[0] == i]) == best
    assert TG.predict_tags(df.limit(0), model).count() == 0 and TG.predict_tags(df, model.limit(0)).count() == 0
