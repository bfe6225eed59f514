import itertools
import math
import random

from tagweave.operators import evaluate as EV
from tagweave.operators import labels as L
from tagweave.operators import runlog as RL


def _chunks(tags):
    """Independent re-statement of the non-strict IOB2 chunk rule."""
    out, cur = set(), None
    for i, t in enumerate(tags + ["O"]):
        typ = t[2:] if t != "O" else None
        cont = cur is not None and t.startswith("I-") and typ == cur[0]
        if cur is not None and not cont:
            out.add((cur[0], cur[1], i))
            cur = None
        if t != "O" and not cont:
            cur = (typ, i)
    return out


def _tokens(spark, gold, pred):
    rows = [(s, i, g, p) for s, (gs, ps) in enumerate(zip(gold, pred)) for i, (g, p) in enumerate(zip(gs, ps))]
    return spark.createDataFrame(rows, "sent_id long, pos int, gold string, pred string")


def test_metrics_against_reference_rule(spark):
    rnd = random.Random(3)
    tags = ["O", "B-A", "I-A", "B-B", "I-B"]
    gold = [[rnd.choice(tags) for _ in range(rnd.randint(1, 9))] for _ in range(60)]
    pred = [[t if rnd.random() < 0.7 else rnd.choice(tags) for t in g] for g in gold]
    gc = [(s,) + c for s, g in enumerate(gold) for c in _chunks(g)]
    pc = [(s,) + c for s, p in enumerate(pred) for c in _chunks(p)]
    correct = len(set(gc) & set(pc))
    df = _tokens(spark, gold, pred)
    o = EV.entity_metrics_overall(df).collect()[0]
    assert (o.n_correct, o.n_pred, o.n_gold) == (correct, len(pc), len(gc))
    p, r = correct / len(pc), correct / len(gc)
    assert math.isclose(o.f1, 2 * p * r / (p + r))
    n_tok = sum(len(g) for g in gold)
    assert math.isclose(o.accuracy, sum(a == b for g, q in zip(gold, pred) for a, b in zip(g, q)) / n_tok)
    by = {r.type: r for r in EV.entity_metrics_by_type(df).collect()}
    for t in ("A", "B"):
        assert by[t].n_gold == sum(1 for c in gc if c[1] == t)
        assert by[t].n_correct == sum(1 for c in set(gc) & set(pc) if c[1] == t)


def test_batched_chunks_cross_sentences(spark):
    from pyspark.sql import functions as F
    df = _tokens(spark, [["O", "B-A"], ["I-A", "O"]], [["O", "B-A"], ["I-A", "O"]]).withColumn("batch_id", F.lit(0))
    assert EV.entity_metrics_batched(df).collect()[0].n_gold == 1
    assert EV.entity_metrics_overall(df).collect()[0].n_gold == 2


def test_flatten_metrics(spark):
    df = _tokens(spark, [["B-A", "O", "B-B"]], [["B-A", "O", "O"]])
    by = EV.entity_metrics_by_type(df)
    wide = EV.flatten_metrics(by, EV.overall_from_type_counts(by)).collect()[0].asDict()
    assert wide["A_f1"] == 1.0 and wide["B_recall"] == 0.0 and wide["overall_precision"] == 1.0


def test_best_checkpoint_tolerance(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.500005), (1, 3, 0.500012)], "run_id long, step long, value double")
    r = RL.best_checkpoint(df, "f1").collect()[0]
    assert (r.step, r.value) == (3, 0.500012)
    df2 = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.500005), (1, 3, 0.500009)], "run_id long, step long, value double")
    assert RL.best_checkpoint(df2, "f1").collect()[0].step == 1
    loss = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 3, 1.5), (1, 4, 0.999995)],
                                 "run_id long, step long, value double")
    assert RL.best_checkpoint(loss, "loss").collect()[0].step == 2


def test_windowed_and_nth(spark):
    df = spark.createDataFrame([(1, s, float(s)) for s in range(1, 10)], "run_id long, step long, value double")
    w = sorted((r.window_id, r.mean_loss) for r in RL.windowed_mean_loss(df, 4).collect())
    assert w == [(0, 2.5 / 4), (1, 6.5 / 4)]
    assert [r.step for r in RL.every_nth_step(df, 4).orderBy("step").collect()] == [4, 8]


def test_label_ops(spark):
    sents = spark.createDataFrame([(0, ["O", "B-X", "I-X"]), (1, ["B-Y", "O"])], "sent_id long, tags array<string>")
    ll = L.label_list(sents)
    assert [(r.id, r.tag) for r in ll.orderBy("id").collect()] == [(0, "B-X"), (1, "B-Y"), (2, "I-X"), (3, "O")]
    b2i = {r.tag: r.inside_id for r in L.begin_to_inside(ll).collect()}
    assert b2i == {"B-X": 2, "B-Y": 1, "I-X": 2, "O": 3}
    model = L.labels_table(spark, ["O", "B-X", "I-X", "B-Y"])
    rec = {r.tag: (r.id, r.status) for r in L.reconcile_labels(ll, model).collect()}
    assert rec["O"] == (0, "reordered")
    model2 = L.labels_table(spark, ["O", "B-Z"])
    assert {r.status for r in L.reconcile_labels(ll, model2).collect()} == {"mismatch"}


def test_encode_unknown_tag_raises(spark):
    import pytest
    df = spark.createDataFrame([("B-Nope",)], "tag string")
    with pytest.raises(Exception):
        L.encode_labels(df).collect()
