"""File scoring and the strict reader at size: what is sorted, written and read."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import decode as D
from tagweave.operators import evaluate as EV
from tagweave.operators import tagger as TG
from tagweave.plans import fixtures
from tagweave.plans.score import evaluate_files
from tagweave.sources import conll as CN

SMOKE = "/root/testdata/sf0.001"


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentence_rows_score_as_token_rows(spark):
    tags = [None, "O", "B-X", "I-X", "B-Y", "I-Y", "I-", "B", "X-Y", "I-X-Z"]
    rows = [(s, [tags[(s * 7 + i * i + i * s) % 10] for i in range(n)], [tags[(s * 3 + i * i * s + i) % 10] for i in range(n)])
            for s, n in enumerate([1, 0, 2, 5, 40, 3, 1, 17, 29, 30] * 6)]
    d = spark.createDataFrame(rows, "sent_id long, gold array<string>, pred array<string>")
    flat = d.select("sent_id", F.posexplode(F.arrays_zip("gold", "pred")).alias("pos", "x")).select("sent_id", "pos", "x.gold", "x.pred")
    one = EV.scored_tokens(d).groupBy("sent_id", "gold_type", "pred_type", "correct", "equal").count().collect()
    two = EV.scored_tokens(flat).groupBy("sent_id", "gold_type", "pred_type", "correct", "equal").count().collect()
    assert len(one) > 100 and sorted(map(str, one)) == sorted(map(str, two))


def test_evaluate_files_sorts_no_token_rows(spark, tmp_path, write_text):
    g = write_text(tmp_path / "g.conll", "a\tB-X\nb\tI-X\nc\tO\n\n\nd\tB-Y\n\n")
    p = write_text(tmp_path / "p.conll", "a\tB-X\nb\tO\nc\tO\n\n\nd\tB-Y")
    r = evaluate_files(spark, g, p)
    plan = _plan(r)
    plan = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.index("MapInArrow") < (plan.index("Window") if "Window" in plan else len(plan))    # scored above every window
    assert "RunningWindow" not in plan and "lag(" not in plan and "sort_array" not in plan
    x = r.first()
    assert (x.n_correct, x.n_pred, x.n_gold, x.n_tokens, x.accuracy) == (1, 2, 2, 4, 0.75)


@pytest.mark.parametrize("pred, where", [("a\tO\n\nb\tO\n\n", "sentence 1 position 1"), ("a\tO\n\n", "sentence 1 position 0"),
                                         ("a\tO\n\nb\tO\nz\tO\n\n", "sentence 1 position 1"), ("a\tO\n\nb\tO\nc\tO\n\nd\tO\n\n", "sentence 2 position 0")])
def test_evaluate_files_names_the_first_difference(spark, tmp_path, write_text, pred, where):
    g = write_text(tmp_path / "g.conll", "a\tO\n\nb\tO\nc\tO\n\n")
    with pytest.raises(Exception, match=f"token mismatch at {where}"):
        evaluate_files(spark, g, write_text(tmp_path / "p.conll", pred)).collect()


def test_strict_reader_takes_lines_of_any_bytes(spark, tmp_path):
    (tmp_path / "a.conll").write_bytes(b"\xa0\xff -X- _ O \n\xe3\x80\x80b -X- _ B-X\n\nc -X- _ O\x1c\n\nd -X- _ O\n")
    got = CN.read_conll_strict(spark, str(tmp_path)).select("sent_id", "pos", F.hex("token").alias("t"), "tag").orderBy("sent_id", "pos").collect()
    assert [tuple(r) for r in got] == [(0, 0, "EFBFBDEFBFBD", "O"), (0, 1, "62", "B-X"), (1, 0, "63", "O")]


def test_file_queries_write_compressed_files_in_one_sort(spark, scratch):
    rows = fixtures.doc_sentences(spark, SMOKE, ranged=True)
    blocks = CN.render_conll(rows, "\t", token_col="tokens", tag_col="tags").orderBy("sent_id")
    assert _plan(blocks).split("Initial Plan")[0].count("Exchange") == 1
    plain, gz = scratch("plain"), scratch("gz")
    CN.write_conll(rows, plain, token_col="tokens", tag_col="tags")
    CN.write_conll(rows, gz, token_col="tokens", tag_col="tags", compression="gzip")
    size = [sum(os.path.getsize(f"{p}/{f}") for f in os.listdir(p) if f.startswith("part")) for p in (plain, gz)]
    assert 3 * size[1] < size[0]
    a, b = (CN.read_conll_strict(spark, p, "\t") for p in (plain, gz))
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_tags_of_sentence_rows_count_as_token_rows(spark):
    rows = [(0, ["a", "B", "a"], ["X", "Y", "X"]), (1, [], []), (2, ["c"], ["O"]), (3, ["a", "b", "c", "d"], ["O", None, "Y", "Y"]), (4, None, None)]
    d = spark.createDataFrame(rows, "sent_id long, token array<string>, tag array<string>")
    flat = d.select("sent_id", F.posexplode(F.arrays_zip("token", "tag")).alias("pos", "x")).select("sent_id", "pos", "x.token", "x.tag")
    counts = lambda df: sorted(map(str, TG.tag_counts(df).collect()))
    assert counts(d) == counts(flat) and len(counts(d)) > 10
    assert "Window" not in _plan(TG.tag_counts(d))


def test_predict_tags_scans_lines_twice_at_most(spark, monkeypatch):
    words = ["a", "İx", "ΟΔΟΣ", "Σ", "rare", "", "É"]
    lines = [(i, " ".join(words[(i * j + j) % 7] for j in range(i % 9 + 1))) for i in range(80)]
    tokens = [(i, p, w, ("X", "Y", "O")[(i + p) % 3]) for i, t in lines[:40] for p, w in enumerate(t.strip().split(" "))]
    model = TG.train_tag_model(spark.createDataFrame(tokens, "sent_id long, pos int, token string, tag string")).checkpoint()
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    asked = spark.createDataFrame(lines, "sent_id long, text string").mapInArrow(count, "sent_id long, text string")
    want = sorted(map(tuple, TG.predict_tags(asked, model).collect()))
    # each word is lower-cased alone in the model and with its line in the tagger
    assert sorted((r[0], r[1], r[2]) for r in want) == sorted((i, p, w) for i, t in lines for p, w in enumerate(t.strip().split(" ")))
    one = sorted(map(tuple, TG.predict_tags(asked, model, block_tokens=1).collect()))
    assert one == want
    monkeypatch.setattr(TG, "SLICE_TOKENS", 5)
    assert sorted(map(tuple, TG.predict_tags(asked, model, max_shipped=300).collect())) == want
    read.value = 0
    TG.predict_tags(asked, model, max_shipped=300).collect()
    assert read.value == 2 * len(lines)


def test_paths_without_back_pointers():
    rng = np.random.default_rng(3)
    for high, k in ((2, 4), (1000, 3), (3, 1)):                 # small whole numbers: many ties
        scores, trans = rng.integers(-high, 1, (20, k)).astype(float), rng.integers(-high, 1, (k, k)).astype(float)
        start, end = rng.integers(-high, 1, k).astype(float), rng.integers(-high, 1, k).astype(float)
        size = rng.integers(0, 12, 60)
        place = rng.integers(0, 20, int(size.sum()))
        want = [D._viterbi_one(scores[p], trans, start, end) for p in np.split(place, np.cumsum(size)[:-1]) if len(p)]
        for cells in (1, 100, 1_000_000):
            assert D.viterbi_rows(size, place, scores, trans, start, end, cells).tolist() == np.concatenate(want).tolist()
