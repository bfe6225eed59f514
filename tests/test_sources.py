import pytest
from pyspark.sql import functions as F

from tagweave.sources import conll as CN
from tagweave.sources import formats as FM
from tagweave.sources import html as H


def _sents(rows):
    out = {}
    for r in rows:
        out.setdefault(r.sent_id, [])
        if r.pos is not None:
            out[r.sent_id].append((r.pos, r.token, r.tag))
    return [[(t, g) for _, t, g in sorted(v)] for _, v in sorted(out.items())]


def test_strict_repeated_blank_and_unclosed(spark, tmp_path, write_text):
    p = write_text(tmp_path / "a.conll", "a -X- _ O\nb -X- _ B-X\n\n\nc -X- _ O\n\nd -X- _ O\n")
    got = _sents(CN.read_conll_strict(spark, p).collect())
    assert got == [[("a", "O"), ("b", "B-X")], [], [("c", "O")]]     # d is unclosed -> dropped


def test_strict_terminated_last_block(spark, tmp_path, write_text):
    p = write_text(tmp_path / "b.conll", "a -X- _ O\n\nc -X- _ B-Y\n\n")
    assert _sents(CN.read_conll_strict(spark, p).collect()) == [[("a", "O")], [("c", "B-Y")]]


def test_strict_whitespace_blank_line(spark, tmp_path, write_text):
    p = write_text(tmp_path / "c.conll", "a -X- _ O\n   \nb -X- _ O\n\n")
    assert _sents(CN.read_conll_strict(spark, p).collect()) == [[("a", "O")], [("b", "O")]]


def test_strict_bad_line_raises(spark, tmp_path, write_text):
    p = write_text(tmp_path / "d.conll", "a -X- _ O\nbroken line\n\n")
    with pytest.raises(Exception):
        CN.read_conll_strict(spark, p).collect()


def test_lenient_reader(spark, tmp_path, write_text):
    p = write_text(tmp_path / "e.conll", "-DOCSTART- -X- O O\n\na x y B-X\nb O\n\n\n\nc I-X\n-DOCSTART-\nd O")
    got = sorted((r.id, list(r.tokens), list(r.ner_tags)) for r in CN.read_conll_lenient(spark, p).collect())
    assert got == [("0", ["a", "b"], ["B-X", "O"]), ("1", ["c"], ["I-X"]), ("2", ["d"], ["O"])]


def _numbered_after_join(node):
    """Whether a row id is evaluated above a join."""
    text = node.toString()
    if "monotonically_increasing_id" in node.expressions().mkString() and "Join" in text:
        return True
    kids = node.children()
    return any(_numbered_after_join(kids.apply(i)) for i in range(kids.size()))


def test_ids_do_not_depend_on_the_join(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    end = ["", "\n", "\n\n", "\n\n\n", "\n \n"]
    want, lenient = [], []
    for j in range(10):
        names = [f"f{j}s{i}" for i in range(200)]
        (d / f"p{j}.conll").write_text("\n\n".join(f"{n} -X- _ O\nx -X- _ O" for n in names) + end[j % 5])
        lenient += names
        # a block without a blank line after it is dropped; a second blank line is an empty sentence
        want += names[:-1] if j % 5 < 2 else names + [None] if j % 5 == 3 else names
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "300"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        strict, loose = CN.read_conll_strict(spark, str(d)), CN.read_conll_lenient(spark, str(d))
        for df in (strict, loose):
            assert not _numbered_after_join(df._jdf.queryExecution().optimizedPlan())
        first = {r.sent_id: r.token for r in strict.where("coalesce(pos, 0) = 0").collect()}
        ids = {int(r.id): r.tokens[0] for r in loose.collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [first[i] for i in range(len(first))] == want
    assert [ids[i] for i in range(len(ids))] == lenient


def test_write_conll_round_trip(spark, scratch):
    rows = [(0, 0, "x", "O"), (0, 1, "y", "B-A"), (1, 0, "z", "I-A")]
    df = spark.createDataFrame(rows, "sent_id long, pos int, token string, tag string")
    p = scratch("rt")
    CN.write_conll(df, p, sep="\t")
    back = CN.read_conll_strict(spark, p, sep="\t").orderBy("sent_id", "pos").collect()
    assert [tuple(r) for r in back] == rows


def test_bibtex(spark, tmp_path, write_text):
    text = ('@inproceedings{k1,\n    title = "A = B",\n    booktitle = "Proc = Venue X",\n    year = "2021",\n'
            '    url = "https://x/1",\n}\n@inproceedings{k2,\n    title = "No year",\n}\n')
    p = write_text(tmp_path / "a.bib", text)
    got = [(r.venue, r.year, r.url) for r in FM.read_bibtex(spark, p).orderBy("src_pos").collect()]
    assert got == [("Venue X", 2021, "https://x/1.pdf"), (None, None, None)]


def test_json_array_round_trip(spark, scratch):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id long, title string")
    p = scratch("ja")
    FM.write_json_array(df, p, "id", chunk_rows=3)
    back = FM.read_json_array(spark, p, "id long, title string").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(i, f"t{i}") for i in range(7)]


def test_lines_and_lexicon(spark, tmp_path, write_text):
    p = write_text(tmp_path / "lex.txt", "Machine Translation\n\n  Parsing \nParsing\n")
    assert sorted(r.name for r in FM.read_lexicon(spark, p).collect()) == ["Machine Translation", "Parsing",
                                                                          "Parsing"]
    lines = FM.read_paragraph_lines(spark, p).orderBy("line_id").collect()
    assert [r.text for r in lines] == ["Machine Translation", "", "Parsing", "Parsing"]
    assert list(lines[0].words) == ["Machine", "Translation"]


def test_load_by_extension_rejects(spark):
    with pytest.raises(ValueError):
        FM.load_by_extension(spark, {"train": "/x/data.parquet"})


def test_headings_and_aliases(spark):
    pages = spark.createDataFrame([(1, "<div><h1 class='t'>A &amp; <b>B</b> </h1><h1>C</h1></div>")],
                                  "page_id long, html string")
    got = [(r.ord, r.name) for r in H.extract_headings(pages).orderBy("ord").collect()]
    assert got == [(0, "A & B"), (1, "C")]
    names = spark.createDataFrame([(1, "SQuAD (Stanford Question Answering Dataset)"), (2, "CoNLL")],
                                  "src_id long, name string")
    got = sorted(tuple(r) for r in H.extract_alias_names(names).collect())
    assert got == [(1, 0, "SQuAD", "abbreviation"), (1, 1, "Stanford Question Answering Dataset", "full"),
                   (2, 0, "CoNLL", "name")]


def test_evaluate_files(spark, tmp_path, write_text):
    from tagweave.plans.score import evaluate_files
    g = write_text(tmp_path / "g.conll", "a\tB-X\nb\tI-X\nc\tO\n\nd\tB-Y\n\n")
    p = write_text(tmp_path / "p.conll", "a\tB-X\nb\tO\nc\tO\n\nd\tB-Y\n\n")
    r = evaluate_files(spark, g, p).collect()[0]
    assert (r.n_correct, r.n_pred, r.n_gold, r.n_tokens) == (1, 2, 2, 4)
    bad = write_text(tmp_path / "q.conll", "a\tB-X\nz\tO\nc\tO\n\nd\tB-Y\n\n")
    with pytest.raises(Exception):
        evaluate_files(spark, g, bad).collect()
