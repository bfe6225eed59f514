"""Hand cases for faults found in review: silent drops, caps and text rules."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagweave.functions.text import py_strip
from tagweave.operators import batchmap as BM
from tagweave.operators import labels as L
from tagweave.operators import runlog as RU
from tagweave.operators import pieces as P
from tagweave.operators import relational as RL
from tagweave.operators import sampling as SA
from tagweave.operators import sentences as SE
from tagweave.operators import spans as SP
from tagweave.operators import tagger as TG
from tagweave.plans.score import evaluate_files
from tagweave.sources import conll as CO
from tagweave.sources import formats as FM
from tagweave.sources import html as H


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(path)


def test_evaluate_files_scores_a_last_unclosed_block(spark, tmp_path):
    gold = write(tmp_path / "g.txt", "a\tB-X\nb\tI-X\n\nc\tB-X\nd\tO\ne\tB-X")
    pred = write(tmp_path / "p.txt", "a\tB-X\nb\tI-X\n\nc\tO\nd\tO\ne\tB-X")
    r = evaluate_files(spark, gold, pred).first()
    assert r.n_tokens == 5 and r.n_gold == 3 and r.n_pred == 2 and r.n_correct == 2


def test_strict_reader_still_drops_it(spark, tmp_path):
    p = write(tmp_path / "g.txt", "a\tX\n\nb\tY\n")
    assert [r.token for r in CO.read_conll_strict(spark, p, "\t").orderBy("sent_id", "pos").collect()] == ["a"]
    kept = CO.read_conll_strict(spark, p, "\t", keep_last=True).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.token) for r in kept] == [(0, "a"), (1, "b")]


def test_readers_number_in_file_order_without_a_range_exchange(spark, tmp_path):
    for j in range(3):
        write(tmp_path / f"f{j}.txt", "".join(f"w{j}{i} X\n\n" for i in range(4)))
    df = CO.read_conll_lenient(spark, str(tmp_path))
    assert "rangepartitioning" not in df._jdf.queryExecution().toString().lower()
    got = sorted((int(r.id), r.tokens[0]) for r in df.collect())
    assert got == [(4 * j + i, f"w{j}{i}") for j in range(3) for i in range(4)]


def test_bibtex_keeps_every_record(spark, tmp_path):
    p = write(tmp_path / "x.bib", '@a{k1,\n  booktitle = "V1",\n  year = "2001",\n  url = "u1",\n  }\n'
              '@a{k2,\n  booktitle = "V2",\n  year = "2002",\n  url = "u2"\n}\n'
              '  @a{k3,\n booktitle = "V3",\n url = "u3"\n}, trailing = "x"\n}\n')
    got = {r.venue: (r.year, r.url) for r in FM.read_bibtex(spark, p).collect()}
    assert got == {"V1": (2001, "u1.pdf"), "V2": (2002, "u2.pdf"), "V3": (None, "u3.pdf")}


def _plain_bibtex(text):
    """Records between closing lines, one line after another."""
    out, item, any_field = [], {}, False
    for line in text.split("\n"):
        parts = line.strip().split(" = ")
        if line.strip() == "}":
            out += [item] if any_field else []
            item, any_field = {}, False
        elif len(parts) > 1:
            any_field = True
            item[parts[0]] = parts[-1].strip('",')
    out += [item] if any_field else []
    return sorted(((i.get("booktitle"), int(i["year"]) if i.get("year", "x").isdigit() else None,
                    i["url"] + ".pdf" if "url" in i else None) for i in out), key=repr)


def test_bibtex_of_splits_of_any_size(spark, tmp_path):
    import random
    rng = random.Random(5)
    lines = []
    for i in range(120):
        lines += [f"@inproceedings{{k{i},", f'    title = "T{i}",']
        lines += rng.sample([f'  booktitle = "@V{i}",', '@odd = "line",', f'@V{i} goes on', f'  year = "{1900 + i}",', f'url = "u{i}" = "w{i}"',
                             "year = \"soon\"", "", "  note = {", "plain"], k=rng.randint(0, 8))
        lines += ["  }  " if i % 3 else "}"] * rng.choice([1, 1, 1, 2])
    for tail in ("\n", "", '\n@x{\n booktitle = "last"'):
        text = "\n".join(lines) + tail
        p = write(tmp_path / f"b{len(tail)}.bib", text)
        write(tmp_path / f"b{len(tail)}.second", "nothing")
        want = _plain_bibtex(text)
        for size in ("128m", "900", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                got = FM.read_bibtex(spark, p).collect()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert sorted(((r.venue, r.year, r.url) for r in got), key=repr) == want
            assert len({r.src_pos for r in got}) == len(want)


def test_bibtex_value_line_that_begins_with_at(spark, tmp_path):
    p = write(tmp_path / "at.bib", '@a{k1,\n  booktitle = "V1",\n@note = "x",\n  url = "u1",\n}\n')
    assert [(r.venue, r.year, r.url) for r in FM.read_bibtex(spark, p).collect()] == [("V1", None, "u1.pdf")]


def test_strict_reader_equals_a_plain_loop(spark, tmp_path):
    import random
    rng = random.Random(6)

    def plain(text, keep_last):
        out, sent = [], []
        lines = text.split("\n")
        for line in lines[:-1] if lines[-1] == "" else lines:
            if line.strip() == "":
                out.append(sent)
                sent = []
            else:
                sent.append(line.strip())
        return out + ([sent] if sent and keep_last else [])

    for n in range(30):
        d = tmp_path / f"d{n}"
        d.mkdir()
        texts = ["".join(rng.choice(["w X\n", "w X\n", "v Y\n", "\n", "\n\n", " \n", "\t\n\n"]) for _ in range(rng.randint(0, 25)))
                 + rng.choice(["", "u Z", "u Z\n", "u Z\n\n", "u Z\n \n\n", " ", "\n"]) for _ in range(rng.randint(1, 3))]
        for i, t in enumerate(texts):
            write(d / f"f{i}.txt", t)
        keep = n % 2 == 0
        want = [s for t in texts for s in plain(t, keep)]
        spark.conf.set("spark.sql.files.maxPartitionBytes", rng.choice(["128m", "37"]))
        try:
            got = {}
            for r in CO.read_conll_strict(spark, str(d), " ", keep_last=keep).collect():
                got.setdefault(r.sent_id, []).append((r.pos, f"{r.token} {r.tag}"))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        have = [[x for p, x in sorted(got[k]) if p is not None] if got[k] != [(None, "None None")] else [] for k in sorted(got)]
        assert sorted(got) == list(range(len(want))) and have == want, (texts, keep)


def test_strict_reader_of_compressed_files(spark, tmp_path):
    import gzip
    for name, text in (("a", "x X\n\ny Y\n\n" * 50), ("b", "x X\n\ny Y\n")):
        with gzip.open(tmp_path / f"{name}.txt.gz", "wt") as f:
            f.write(text)
    assert CO.read_conll_strict(spark, str(tmp_path), " ").count() == 101


def test_write_conll_of_sentence_rows(spark, scratch):
    rows = [(i, [f"t{i}", "u"], ["O", "B-X"]) for i in range(50)]
    df = spark.createDataFrame(rows, "sent_id long, token array<string>, tag array<string>").repartition(5)
    a, b = scratch("wide"), scratch("long")
    CO.write_conll(df, a)
    CO.write_conll(df.select("sent_id", F.posexplode(F.arrays_zip("token", "tag")).alias("pos", "x")).select("sent_id", "pos", "x.token", "x.tag"), b)
    assert [r.value for r in FM.read_lines(spark, a).orderBy("line_id").collect()] == [r.value for r in FM.read_lines(spark, b).orderBy("line_id").collect()]


def test_try_map_keeps_the_record_and_the_whole_error(spark):
    def fn(r):
        if r["x"] == 2:
            raise ValueError("e" * 2000)
        return {"y": r["x"] * 10}

    ok, bad = BM.try_map(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x long, s string"), fn, "y long")
    assert sorted(r.y for r in ok.collect()) == [10, 30]
    row = bad.collect()
    assert len(row) == 1 and (row[0].x, row[0].s) == (2, "b") and len(row[0]["__error"]) > 2000


def test_materialize_ignores_an_unfinished_folder(spark, scratch):
    import os
    p = scratch("half")
    df = spark.range(100).repartition(4)
    df.write.parquet(p)
    os.remove(os.path.join(p, "_SUCCESS"))
    for f in sorted(x for x in os.listdir(p) if x.startswith("part-"))[1:]:
        os.remove(os.path.join(p, f))
    assert BM.materialize(df, p).count() == 100
    assert BM.materialize(spark.range(5), p).count() == 100          # finished: used again


def test_map_batches(spark):
    out = BM.map_batches(spark.range(5), lambda b: pd.DataFrame({"y": b["id"] * 2}), "y long")
    assert sorted(r.y for r in out.collect()) == [0, 2, 4, 6, 8]


def test_lexicon_keeps_long_names(spark):
    name = " ".join(f"n{i}" for i in range(9))
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate(f"x {name} y".split())], "doc_id int, pos int, token string")
    lex = spark.createDataFrame([(name,), ("y",)], "name string")
    got = sorted((r.start, r.end) for r in SP.lexicon_match(toks, lex, "M").collect())
    assert got == [(1, 10), (10, 11)]
    with pytest.raises(ValueError):
        SP.lexicon_match(toks, lex, "M", max_words=8)


def test_filter_venues_list_and_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "venue string")
    assert [r.venue for r in RL.filter_venues(df, ["a", "a", "z"]).collect()] == ["a"]
    assert [r.venue for r in RL.filter_venues(df, spark.createDataFrame([("b",)], "v string")).collect()] == ["b"]


def test_labels_raise_on_unknown(spark):
    df = spark.createDataFrame([(0,), (999,)], "label_id int")
    with pytest.raises(Exception, match="unknown label id"):
        L.decode_labels(df).collect()
    assert [r.tag for r in L.decode_labels(df, unknown="null").orderBy("label_id").collect()][1] is None
    bad = spark.createDataFrame([(["a"], ["B-Nothing"])], "tokens array<string>, tags array<string>")
    with pytest.raises(Exception, match="unknown tag"):
        P.expand_pieces(bad, P.fixed_width_splitter(4)).collect()


def test_pad_batches_keeps_labels_of_kept_words(spark):
    rows = [(0, 0, [101, 1, 2, 3, 102], [0, 1, 1, 1, 0], [5, 6, 7]), (1, 0, [101, 4, 102], [0, 1, 0], [8])]
    df = spark.createDataFrame(rows, "sent_id int, batch_id int, input_ids array<int>, token_starts array<int>, labels array<int>")
    got = {r.sent_id: r for r in P.pad_batches(df, max_len=3, multiple_of=8).collect()}
    assert got[0].token_starts == [0, 1, 1] and got[0].labels == [5, 6] and got[0].width == 3
    assert got[1].input_ids == [101, 4, 102] and got[1].labels == [8, -1]


def test_regex_spans_refuses_what_it_cannot_restart(spark):
    df = spark.createDataFrame([(1, "ab ab ab")], "doc_id int, text string")
    with pytest.raises(ValueError):
        SP.regex_spans(df, "text", r"(?<!b )ab")
    assert SP.regex_spans(df, "text", "ab").count() == 3


def _plain_overrides(texts, idx):
    out = list(texts)
    for i in idx:
        if i < len(out):
            out[i:i + 2] = ["".join(out[i:i + 2])]
    return out


def test_overrides_in_any_order(spark, monkeypatch):
    import random
    rng = random.Random(8)
    df = lambda n: spark.createDataFrame([(0, i, f"s{i},") for i in range(n)], "doc_id int, ord int, sentence string")
    monkeypatch.setattr(SE.Islands, "BLOCK", 4)
    for n, idx in ((5, [3, 1]), (5, [1, 3]), (6, [4, 4, 0, 0]), (4, [3, 2, 1, 0]), (3, [2, 7, 1, 1, 1]), (4, []),
                   (60, [rng.randrange(60) for _ in range(50)])):
        want = _plain_overrides([f"s{i}," for i in range(n)], idx)
        got = SE.apply_merge_overrides(df(n), idx).orderBy("line_id").collect()
        assert [(r.line_id, r.sentence) for r in got] == list(enumerate(want))
    table = spark.createDataFrame([(9, 1), (2, 3)], "step int, at int")
    for limit in (SE.MAX_SHIPPED_MERGES, 0):                         # shipped, and by a join
        monkeypatch.setattr(SE, "MAX_SHIPPED_MERGES", limit)
        got = SE.apply_merge_overrides(df(5), table, index_col="at", seq_col="step").orderBy("line_id").collect()
        assert [(r.line_id, r.sentence) for r in got] == [(0, "s0,"), (1, "s1,s2,"), (2, "s3,s4,")]


def test_files_are_compared_by_line(spark, tmp_path):
    a = [f"w{i}\tO" if i % 7 else "" for i in range(1000)]
    b = list(a)
    b[500], b[14], b[15] = "other\tO", "x", "w15\tB-X"
    pa_, pb = write(tmp_path / "a.txt", "\n".join(a) + "\n"), write(tmp_path / "b.txt", "\n".join(b + ["more"]) + "\n")
    got = sorted((r.line, r.token_a, r.token_b) for r in SE.check_file_alignment(spark, pa_, pb, block_lines=16).collect())
    assert got == [(14, "", "x"), (500, "w500", "other"), (1000, None, "more")]
    assert SE.check_file_alignment(spark, pa_, pa_).count() == 0


def test_strip_removes_what_python_removes(spark):
    cases = ["\xa0x　", "\x85a b\x1f", " plain ", "", " "]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    got = [r.t for r in df.orderBy("i").select(py_strip(F.col("s")).alias("t")).collect()]
    assert got == [c.strip() for c in cases]


def test_numeric_entities(spark):
    df = spark.createDataFrame([(1, "<h1>caf&#233; &#x1F600; &#38;lt; &amp; &#xD800;</h1>")], "page_id int, html string")
    assert H.extract_headings(df).first().name == "café 😀 &lt; & &#xD800;"


def test_model_keeps_tags_that_only_the_base_saw(spark):
    base = TG.train_tag_model(spark.createDataFrame([(1, 0, "a", "B-Old"), (1, 1, "b", "O")], "sent_id int, pos int, token string, tag string"))
    new = TG.train_tag_model(spark.createDataFrame([(2, 0, "c", "O")], "sent_id int, pos int, token string, tag string"))
    assert TG.model_tags(TG.merge_tag_models(base, new)) == ["B-Old", "O"]


def test_sampling_and_batches(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert SA.sample_n(df, "k", 5).count() == 5 and SA.sample_n(df, "k", 50).count() == 20
    first = SA.take_first_n(df, "k", 3).collect()
    assert sorted(r.k for r in first) == [0, 1, 2] and {r.n_used for r in first} == {3}
    assert {r.k: r.batch_id for r in SA.sequential_batches(df, "k", 8).collect()} == {k: k // 8 for k in range(20)}
    sizes = sorted(r["count"] for r in SA.shuffled_batches(df, "k", 8).groupBy("batch_id").count().collect())
    assert sizes == [4, 8, 8]


def test_begin_to_inside(spark):
    lab = spark.createDataFrame([(0, "O"), (1, "B-X"), (2, "I-X"), (3, "B-Y")], "id int, tag string")
    assert {r.id: r.inside_id for r in L.begin_to_inside(lab).collect()} == {0: 0, 1: 2, 2: 2, 3: 3}


def test_viterbi_traces_unequal_lengths_together():
    import itertools

    import numpy as np

    from tagweave.operators.decode import _viterbi_batch
    rng = np.random.default_rng(2)
    trans, start, end = rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    ems = [rng.normal(size=(n, 3)) for n in (1, 4, 2, 5, 1, 3)]
    for em, got in zip(ems, _viterbi_batch(ems, trans, start, end)):
        def score(p):
            return (start[p[0]] + end[p[-1]] + sum(em[t][k] for t, k in enumerate(p))
                    + sum(trans[a][b] for a, b in zip(p, p[1:])))
        assert list(got) == list(max(itertools.product(range(3), repeat=len(em)), key=score))


def test_marker_characters_in_texts(spark, tmp_path):
    m = "\u0001"
    df = spark.createDataFrame([(1, f"One{m}two. Three! Four")], "doc_id int, text string")
    assert [r.sentence for r in SE.split_sentences(df).orderBy("ord").collect()] == [f"One{m}two.", "Three!", "Four"]
    toks = spark.createDataFrame([([f"ab{m}cd", "efghi"], ["O", "B-" + "Task"])], "tokens array<string>, tags array<string>")
    from tagweave import constants as C
    tag = next(t for t in C.LABELS if t.startswith("B-"))
    toks = toks.withColumn("tags", F.array(F.lit("O"), F.lit(tag)))
    r = P.expand_pieces(toks, P.fixed_width_splitter(4)).first()
    assert r.pieces == ["[CLS]", f"ab{m}c", "##d", "efgh", "##i", "[SEP]"] and r.token_starts == [0, 1, 0, 1, 0, 0]
    p = write(tmp_path / "m.txt", f"a{m}b X\n\n{m} Y\nc Z\n")
    assert [r.tokens for r in CO.read_conll_lenient(spark, p).orderBy("id").collect()] == [[f"a{m}b"], [m, "c"]]


def test_abbreviation_breaks_and_exceptions(spark):
    rows = [(0, 0, "A et al ."), (0, 1, "B i.e."), (0, 2, "C"), (0, 3, "D i.e."), (0, 4, "E")]
    df = spark.createDataFrame(rows, "doc_id int, ord int, sentence string")
    got = [r.sentence for r in SE.merge_abbreviation_breaks(df, exceptions=[4]).orderBy("first_index").collect()]
    assert got == ["A et al . B i.e. C", "D i.e.", "E"]


def test_container_by_class_with_nested_elements(spark):
    page = ('<div class="x"><h1>no</h1></div><div id="q" class="a main-part b"><h1>one</h1><div><h1>two</h1></div><h1>three</h1></div>'
            "<h1>after</h1>")
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    names = lambda c: [r.name for r in H.extract_headings(df, container=c).orderBy("ord").collect()]
    assert names("div.main-part") == names(".main-part") == ["one", "two", "three"]
    assert names("div") == ["no"] and names("section") == [] and names(None) == ["no", "one", "two", "three", "after"]


def test_try_map_keeps_values(spark):
    rows = [(9007199254740993, float("nan"), None, [1, None]), (2, 1.5, "b", None), (3, None, "bad", [9])]
    df = spark.createDataFrame(rows, "x long, y double, s string, a array<long>")

    def fn(r):
        if r["s"] == "bad":
            raise KeyError("s")
        return {"x": r["x"], "y": r["y"], "n": r["s"], "a": r["a"]}

    ok, bad = BM.try_map(df, fn, "x long, y double, n string, a array<long>")
    got = {r.x: r for r in ok.collect()}
    assert got[9007199254740993].y != got[9007199254740993].y and got[9007199254740993].n is None and got[9007199254740993].a == [1, None]
    assert got[2].y == 1.5 and got[2].a is None
    assert [(r.x, r.y, r.s, r.a) for r in bad.collect()] == [(3, None, "bad", [9])]
    ok, bad = BM.try_map(df, lambda r: {"x": "not a number"} if r["x"] == 2 else {"x": r["x"]}, "x long")
    assert sorted(r.x for r in ok.collect()) == [3, 9007199254740993]
    assert [(r.x, r.s) for r in bad.collect()] == [(2, "b")]
    exact = BM.try_map(df, lambda r: 1 // 0, "x long")[1].collect()
    assert sorted(r.x for r in exact) == [2, 3, 9007199254740993] and {r["__error"].split(":")[0] for r in exact} == {"ZeroDivisionError"}
    assert BM.try_map(df.limit(0), fn, "x long")[0].count() == 0


def test_try_columns_names_what_failed(spark):
    df = spark.createDataFrame([(1, '{"k": 9007199254740993}', "5"), (2, '{"k": ', "x"), (3, None, "7")], "i int, p string, n string")
    out = BM.try_columns(df, {"k": F.try_variant_get(F.try_parse_json("p"), "$.k", "bigint"), "m": F.expr("try_cast(n as int)")}).orderBy("i").collect()
    assert [(r.k, r.m, r.status) for r in out] == [(9007199254740993, 5, "ok"), (None, None, "failed: k,m"), (None, 7, "failed: k")]


def _plain_best(values, eps):
    best, at = float("-inf"), None
    for i, v in enumerate(values):
        if v is not None and v == v and v > best + eps:
            best, at = v, i
    return at


def test_best_checkpoint_equals_a_plain_fold(spark):
    import random
    rng = random.Random(3)
    runs = {}
    for run in range(25):
        x, vs = 0.5, []
        for _ in range(rng.choice([1, 2, 40, 200])):
            x += rng.choice([-1e-3, 2e-6, 4e-6, 9e-6, 1e-5, 1.1e-5, 3e-5])
            vs.append(rng.choice([x, x, None, float("nan")]) if run % 5 == 0 else x)
        runs[run] = vs
    df = spark.createDataFrame([(r, i, v) for r, vs in runs.items() for i, v in enumerate(vs)], "run_id long, step long, value double").repartition(6)
    got = {r.run_id: r.step for r in RU.best_checkpoint(df).collect()}
    assert got == {r: _plain_best(vs, 1e-5) for r, vs in runs.items() if _plain_best(vs, 1e-5) is not None}
    down = {r.run_id: r.step for r in RU.best_checkpoint(df.withColumn("value", -F.col("value")), mode="loss").collect()}
    assert down == got


def test_best_checkpoint_of_a_long_improving_run(spark):
    n = 1_000_000
    slow = spark.range(0, n, 1, 8).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("step"), (F.col("id") * 3e-7).alias("value"))
    r = RU.best_checkpoint(slow).collect()
    best, at = float("-inf"), None
    for i in range(n):
        if i * 3e-7 > best + 1e-5:
            best, at = i * 3e-7, i
    assert [(x.run_id, x.step, x.value) for x in r] == [(1, at, best)]


def test_few_lines_meet_where_one_in_a_thousand_differs():
    from tagweave.operators import sentences as SE
    lines = range(0, 1_000_000, 1_000)
    meeting = len({n // SE.BLOCK_LINES for n in lines}) * SE.BLOCK_LINES
    assert meeting < 100_000


def test_corpus_statistics_joins_no_tokens(spark):
    from tagweave.plans.q_evaluate import q_corpus_statistics
    plan = q_corpus_statistics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1                       # of the two results, a row per split each


def test_list_functions_work_in_slices():
    import pyarrow as pa
    from tagweave.functions.arrays import _running_sum_rows, in_slices
    rows = [[1, 2, 3], None, [], list(range(50)), [5], [None, 4]] * 4
    arr = pa.array(rows, pa.list_(pa.int64())).slice(1)
    longest = []

    def fn(a):
        longest.append(sum(len(x) for x in a.to_pylist() if x))
        return _running_sum_rows(a)

    assert in_slices(fn, arr, 8).to_pylist() == _running_sum_rows(arr).to_pylist()
    assert max(longest) == 50 and len(longest) > 4


def test_only_lines_with_rare_words_travel(spark, monkeypatch):
    from tagweave.operators import tagger as TG
    lines = [(i, "a b c a" if i % 10 else f"a rare{i} b") for i in range(60)]
    tokens = [(i, p, w, ("X", "Y", "O")[(i + p) % 3]) for i, t in lines for p, w in enumerate(t.split())]
    model = TG.train_tag_model(spark.createDataFrame(tokens, "sent_id long, pos int, token string, tag string"))
    asked = spark.createDataFrame([*lines, (90, "a new rare10 b"), (91, ""), (92, None)], "sent_id long, text string")
    want = sorted(map(tuple, TG.predict_tags(asked, model).collect()), key=str)
    stored, cut = [], TG.cut_lineage

    def seen(df):
        out = cut(df)
        if "words" in df.columns:
            stored.append(out.count())
        return out

    monkeypatch.setattr(TG, "cut_lineage", seen)
    assert sorted(map(tuple, TG.predict_tags(asked, model, max_shipped=400).collect()), key=str) == want
    assert stored == [7 + 1]                             # six rare words of lines, one new line, and the empty word
    assert sorted(map(tuple, TG.predict_tags(asked, model, max_shipped=0).collect()), key=str) == want
    assert sorted(map(tuple, TG.predict_tags(asked, model, max_shipped=400, block_tokens=2).collect()), key=str) == want


def test_entity_types_need_no_regular_expression(spark):
    from pyspark.sql import functions as F
    from tagweave.operators.spans import entity_type
    d = spark.createDataFrame([("B-X-Y",), ("O",), ("X",), (None,), ("I-",)], "t string")
    out = d.select(entity_type(F.col("t")).alias("x"))
    assert [r.x for r in out.collect()] == ["X-Y", "", "", "", ""]
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def _restore(spark, sizes, paras, gap=0):
    words = [f"w{i}" for i in range(sum(sizes))]
    flat = iter(words)
    pred = spark.createDataFrame([(s, p, next(flat), f"t{s}") for s, n in enumerate(sizes) for p in range(n)], "sent_id long, pos int, token string, tag string")
    tmpl = spark.createDataFrame([(f"p{k:03d}", j * (1 + gap), "x") for k, n in enumerate(paras) for j in range(n)], "para_id string, pos int, token string")
    return words, pred, tmpl


def test_restored_tokens_are_not_sorted_or_joined_on_ordinals(spark, monkeypatch):
    monkeypatch.setattr(SE, "SEGMENT_BLOCK", 8, raising=False)
    monkeypatch.setattr(SE, "POSITION_BLOCK", 4, raising=False)
    sizes, paras = [3, 1, 40, 2, 9, 1, 1], [1, 1, 20, 2, 3, 17, 1, 9, 5]        # the template is longer by two
    words, pred, tmpl = _restore(spark, sizes, paras)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = SE.restore_paragraphs(pred, tmpl)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.orderBy("para_id", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    places = [(f"p{k:03d}", j) for k, n in enumerate(paras) for j in range(n)]
    tags = [f"t{s}" for s, n in enumerate(sizes) for _ in range(n)]
    assert [tuple(r) for r in got] == [(*at, w, t) for at, w, t in zip(places, words, tags)]
    assert out.schema["pos"].dataType == tmpl.schema["pos"].dataType


def test_restoring_by_positions_with_gaps_keeps_their_ordinals(spark):
    _, pred, tmpl = _restore(spark, [4], [4], gap=1)
    got = SE.restore_paragraphs(pred, tmpl).orderBy("pos").collect()
    assert [(r.pos, r.token) for r in got] == [(0, "w0"), (2, "w2")]


def test_vocabulary_splitter_gives_its_pieces_in_slices(spark, monkeypatch):
    import pyarrow as pa
    from tagweave.operators import vocabulary as V
    monkeypatch.setattr(V, "SLICE_WORDS", 8, raising=False)
    made = []
    monkeypatch.setattr(V.F, "arrow_udf", lambda fn, kind: lambda tokens: made.append(fn))
    vocab = spark.createDataFrame([("ab", 1), ("##c", 2), ("d", 3)], "piece string, id int")
    V.VocabularySplitter(vocab).column(None)
    rows = [["abc", "d"], None, [], ["ab"] * 20, ["x"], ["d", "", None]] * 3
    out = list(made[0](iter([pa.array(rows, pa.list_(pa.string())), pa.array([], pa.list_(pa.string()))])))
    assert max(sum(len(x["pieces"]) for x in o.to_pylist() if x) for o in out) == 20 and len(out) > 6
    got = pa.concat_arrays(out).to_pylist()
    assert len(got) == len(rows) and got[0] == {"pieces": ["ab", "##c", "d"], "ids": [1, 2, 3], "starts": [1, 0, 1], "counts": [2, 1]}
    assert got[1] is None and got[2]["pieces"] == [] and got[5]["pieces"] == ["d", "[UNK]", "[UNK]"]


def test_rows_with_unknown_pieces_are_aligned_together(spark, monkeypatch):
    import random
    import pyarrow as pa
    rnd = random.Random(5)
    slow = []
    plain = P.align_unknown
    monkeypatch.setattr(P, "align_unknown", lambda words, pieces: slow.append(words) or plain(words, pieces))
    monkeypatch.setattr(P, "SLICE_PIECES", 40, raising=False)
    words, pieces, starts, tags = [], [], [], []
    for _ in range(400):
        ws, ps, st = [rnd.choice(["a", "abc", "", "é", "x##y", "##b", "abab"]) for _ in range(rnd.randint(0, 7))], ["[CLS]"], [0]
        for w in ws:
            cut = sorted(rnd.sample(range(1, len(w)), rnd.randint(0, len(w) - 1))) if len(w) > 1 else []
            made = [w[i:j] for i, j in zip([0, *cut], [*cut, len(w)])] if w and rnd.random() < .7 else ["[UNK]"] if w else [""]
            if rnd.random() < .04:
                made[-1] = rnd.choice(["[UNK]", "Q", made[-1].upper()])          # disagrees, or another case
            ps += [m if k == 0 or m == "[UNK]" else "##" + m for k, m in enumerate(made)]
            st += [1] + [0] * (len(made) - 1)
        if rnd.random() < .1:
            ps, st = ps[:len(ps) // 2 + 1], st[:len(st) // 2 + 1]                # truncated
        words.append(ws), pieces.append(ps + ["[SEP]"]), starts.append(st + [0]), tags.append([f"t{i}" for i in range(len(ps) + 1)])
    cols = [pa.array(x, pa.list_(k)) for x, k in ((pieces, pa.string()), (tags, pa.string()), (starts, pa.int32()), (words, pa.string()))]
    run = P._word_tags_udf("##", ("[CLS]", "[SEP]"), "[UNK]", True).func
    got = pa.concat_arrays(list(run(iter([tuple(cols)])))).to_pylist()
    unknown = [r for r, ps in enumerate(pieces) if "[UNK]" in ps]
    assert len(slow) < len(unknown) / 2
    for r in unknown:
        at = [i for i, x in enumerate(pieces[r]) if x not in ("[CLS]", "[SEP]", "") and (x != "##" or starts[r][i])]
        text = [None if pieces[r][i] == "[UNK]" else pieces[r][i][2:] if pieces[r][i].startswith("##") and not starts[r][i] else pieces[r][i] for i in at]
        assert got[r] == [tags[r][at[k]] if k >= 0 else "O" for k in plain(words[r], text)], (words[r], pieces[r])


def test_tokens_travel_once_to_their_spans(spark):
    rows = [(d, p, f"w{p}", 3 * p, 3 * p + 2, None if p % 2 else f"n{p}") for p in (4, 0, 3, 1, 2) for d in (2, 1, 3)]
    tokens = spark.createDataFrame(rows, "doc_id int, pos int, token string, start int, end int, note string").repartition(3)
    spans = spark.createDataFrame([(1, 4, 7, "A"), (1, 4, 5, "B"), (3, 100, 101, "A"), (1, 9, 10, None), (9, 0, 1, "A")], "doc_id long, start int, end int, label string")
    out = SP.spans_to_bio(tokens, spans)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == [*tokens.columns, "tag"] and [f.dataType for f in out.schema][:6] == [f.dataType for f in tokens.schema]
    assert "Sort [__k0" in plan and "ASC NULLS FIRST, __" not in plan
    got = {(r.doc_id, r.pos): (r.token, r.start, r.end, r.note, r.tag) for r in out.collect()}
    assert len(got) == 15
    for d, p, *rest in rows:
        assert got[d, p] == (*rest, {(1, 1): "B-A", (1, 2): "I-A"}.get((d, p), "O"))


def test_aligned_tokens_travel_in_blocks_of_positions(spark, monkeypatch):
    import random
    from collections import Counter
    monkeypatch.setattr(SE, "PACKED_POSITIONS", 4)
    monkeypatch.setattr(SE, "PACKED_ROWS", 3)
    rnd = random.Random(3)
    side = lambda n: [(rnd.choice(["p", "q", None]), rnd.choice([*range(-9, 40), None]), rnd.choice(["x", "y", "", None])) for _ in range(n)]
    a, b = side(150), side(150)
    df = lambda rows: spark.createDataFrame(rows, "name string, pos int, token string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = SE.check_token_alignment(df(a), df(b), keys=["name", "pos"])
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got = Counter(tuple(r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = Counter()
    meets = lambda x, y: None not in x[:2] and x[:2] == y[:2]
    for x in a:
        want.update([(*x, y[2]) for y in b if meets(x, y)] or [(*x, None)])
    want.update((*y[:2], None, y[2]) for y in b if not any(meets(x, y) for x in a))
    assert got == Counter({k: n for k, n in want.items() if k[2] != k[3]})
    assert out.columns == ["name", "pos", "token_a", "token_b"] and out.schema["pos"].dataType.simpleString() == "int"
    empty = df(a).limit(0)
    assert SE.check_token_alignment(empty, empty, keys=["name", "pos"]).count() == 0
    assert SE.check_token_alignment(df([("p", 5, "x")]), df([("p", 5, "z")]).withColumn("pos", F.col("pos").cast("long")), keys=["name", "pos"]).count() == 1
    one = SE.check_token_alignment(df([("p", 5, "x"), ("q", 6, "y")]).select("pos", "token"), df([("p", 5, "z")]).select("pos", "token"), keys=["pos"])
    assert sorted(map(tuple, one.collect())) == [(5, "x", "z"), (6, "y", None)]
