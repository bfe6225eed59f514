from pyspark.sql import functions as F

from tagweave.operators import spans as S

# FIXTURES §2 golden spans (true offsets, half-open)
SENTENCES = [
    "Figure 1: Denotation experiment finds ...",
    "FiD-base and FiD-large contain L = 12 and 24 layers respectively, and we set the budget B = Lk.",
    "We consider various regularization parameters for SVM and logistic regression "
    "(e.g., c=[0.01, 0.1, 0.25, 0.5, 0.75, 1.0].",
    "The learning rate is 1e-4 and the batch size is 32.",
    "We have 1 term, ",
    "In 2019 we got 40.25 F1 and 98.5% at 3, see Table 12 and Section 4.2 (5).",
    "x 12000 y 33 z 10e-4 3E5, 2ed",
    "1234567 12:30 7% 7.5% 1.2.3.4.5",
]
METRIC = {
    1: [],
    2: [("12", 35, 37), ("24", 42, 44)],
    3: [("0.01", 88, 92), ("0.1", 94, 97), ("0.25", 99, 103), ("0.5", 105, 108), ("0.75", 110, 114),
        ("1.0", 116, 119)],
    4: [("32", 48, 50)],
    5: [],
    6: [("40", 15, 17), ("25", 18, 20), ("98", 28, 30), ("5%", 31, 33), ("3,", 37, 39), ("5)", 70, 72)],
    7: [("33", 10, 12), ("10", 15, 17)],
    8: [("1234567", 0, 7), ("12", 8, 10), ("30", 11, 13), ("7%", 14, 16), ("7.5%", 17, 21), ("1.2", 22, 25),
        ("3.4", 26, 29)],
}
HYPER = {4: [("1e-4", 21, 25)], 7: [("10e-4", 15, 20), ("3E5", 21, 24), ("2e", 26, 28)]}
LEGACY_6 = [(8, 10), (11, 13), (21, 23), (24, 26), (30, 32), (63, 65)]


def _docs(spark):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(SENTENCES)], "doc_id long, text string")


def _by_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.ord, r.text, r.start, r.end))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def test_metric_values_golden(spark):
    got = _by_doc(S.annotate_metric_values(_docs(spark)).collect())
    for i, exp in METRIC.items():
        assert got.get(i, []) == exp, i


def test_hyperparameter_values_golden(spark):
    got = _by_doc(S.annotate_hyperparameter_values(_docs(spark)).collect())
    for i in range(1, 9):
        assert got.get(i, []) == HYPER.get(i, []), i


def test_legacy_offsets(spark):
    got = S.annotate_metric_values(_docs(spark).where("doc_id = 6"), legacy_offsets=True).orderBy("ord").collect()
    assert [(r.start, r.end) for r in got] == LEGACY_6


def test_span_text_matches_offsets(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = S.annotate_metric_values(d).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    assert len(rows) == 51
    for r in rows:
        assert texts[r.doc_id][r.start:r.end] == r.text


def test_merge_annotations_first_metric_only(spark):
    m = spark.createDataFrame([(1, 0, 0, 2, "12"), (1, 1, 5, 7, "12"), (1, 2, 9, 10, "5")],
                              "doc_id long, ord int, start int, end int, text string")
    h = spark.createDataFrame([(1, 0, 0, 2, "12"), (1, 1, 20, 24, "1e-4")],
                              "doc_id long, ord int, start int, end int, text string")
    got = sorted((r.ord, r.text, tuple(r.labels)) for r in S.merge_annotations(m, h).collect())
    assert got == [(0, "12", ("MetricValue", "HyperparameterValue")), (1, "12", ("MetricValue",)),
                   (2, "5", ("MetricValue",)), (3, "1e-4", ("HyperparameterValue",))]


def test_to_annotation_struct(spark):
    sp = spark.createDataFrame([(1, 1, 5, 7, "33", ["MetricValue"]), (1, 0, 0, 2, "12", ["MetricValue"])],
                               "doc_id long, ord int, start int, end int, text string, labels array<string>")
    r = S.to_annotation_struct(sp).collect()[0]
    a = r.annotations
    assert [x.value.text for x in a] == ["12", "33"]
    assert a[0].from_name == "label" and a[0].to_name == "text" and a[0].type == "labels"


def _bio(spark, seqs):
    rows = [(s, i, t) for s, tags in enumerate(seqs) for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "sent_id long, pos int, tag string")


def test_bio_to_spans_hand_cases(spark):
    seqs = [["O", "I-X"], ["B-X", "I-Y"], ["B-X", "B-X"], ["O", "B-X", "I-X"], ["I-X", "I-X", "O", "B-Y"]]
    got = sorted(tuple(r) for r in S.bio_to_spans(_bio(spark, seqs)).collect())
    assert got == sorted([(0, "X", 1, 2), (1, "X", 0, 1), (1, "Y", 1, 2), (2, "X", 0, 1), (2, "X", 1, 2),
                          (3, "X", 1, 3), (4, "X", 0, 2), (4, "Y", 3, 4)])


def test_spans_to_bio_round_trip(spark):
    text = "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    toks = S.tokenize_whitespace(docs, "text", "doc_id")
    # spans: "beta gamma" (6..16) and "zeta" (31..35), non-overlapping
    sp = spark.createDataFrame([(1, 6, 16, "X"), (1, 31, 35, "Y")], "doc_id long, start int, end int, label string")
    tagged = S.spans_to_bio(toks, sp).orderBy("pos").collect()
    assert [r.tag for r in tagged] == ["O", "B-X", "I-X", "O", "O", "B-Y"]
    back = S.bio_to_spans(S.spans_to_bio(toks, sp).withColumnRenamed("doc_id", "sent_id")).collect()
    assert sorted(tuple(r) for r in back) == [(1, "X", 1, 3), (1, "Y", 5, 6)]


def test_spans_to_bio_overlap_rule(spark):
    docs = spark.createDataFrame([(1, "x 10e-4 y")], "doc_id long, text string")
    toks = S.tokenize_whitespace(docs, "text", "doc_id")
    sp = spark.createDataFrame([(1, 2, 4, "MetricValue"), (1, 2, 7, "HyperparameterValue")],
                               "doc_id long, start int, end int, label string")
    got = [r.tag for r in S.spans_to_bio(toks, sp).orderBy("pos").collect()]
    assert got == ["O", "B-HyperparameterValue", "O"]   # same start: the longer span wins


def test_tokenize_offsets(spark):
    docs = spark.createDataFrame([(1, "  a  bb c "), (2, "")], "doc_id long, text string")
    got = [(r.doc_id, r.pos, r.token, r.start, r.end) for r in
           S.tokenize_whitespace(docs, "text", "doc_id").orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "a", 2, 3), (1, 1, "", 4, 4), (1, 2, "bb", 5, 7), (1, 3, "c", 8, 9), (2, 0, "", 0, 0)]


def test_lexicon_match_longest_left_to_right(spark):
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate("the Machine translation of text".split())],
                                 "doc_id long, pos int, token string")
    lex = spark.createDataFrame([("machine translation",), ("translation of text",), ("text",)], "name string")
    got = sorted(tuple(r) for r in S.lexicon_match(toks, lex, "TaskName").collect())
    assert got == [(1, 1, 3, "TaskName"), (1, 4, 5, "TaskName")]


def _plain_bio(tokens, spans):
    """Every token against every span."""
    tags = {}
    over = lambda t, s: t[2] < s[1] and t[3] > s[0]
    for t in tokens:
        hits = sorted({s for s in spans if over(t, s)}, key=lambda s: (s[0], s[0] - s[1], s[2]))
        if hits:
            first = min(u[0] for u in tokens if over(u, hits[0]))
            tags[t[0]] = ("B-" if t[0] == first else "I-") + hits[0][2]
    return tags


def test_spans_to_bio_equals_all_pairs(spark):
    import random
    rng = random.Random(7)
    docs, toks, spans, want = [], [], [], {}
    for d in range(40):
        at, mine = rng.randint(0, 3), []
        for pos in range(rng.randint(0, 60)):
            n = rng.choice([0, 1, 3, 8])
            mine.append((pos, "w", at, at + n))
            at += n + 1
        s = [(a, a + rng.randint(0, 25), rng.choice("XYZ")) for a in (rng.randint(0, at + 5) for _ in range(rng.choice([0, 0, 2, 9])))]
        s += s[:1]
        toks += [(d, f"k{d}", *t, "keep") for t in mine]
        spans += [(d, f"k{d}", *x) for x in s]
        want |= {(d, pos): tag for pos, tag in _plain_bio(mine, s).items()}
    spans += [(99, "k99", 0, 5, "X"), (None, "k0", 0, 5, "X")]
    t = spark.createDataFrame(toks, "doc_id long, part string, pos int, token string, start int, end int, own string").repartition(5)
    s = spark.createDataFrame(spans, "doc_id long, part string, start int, end int, label string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = S.spans_to_bio(t, s, ["doc_id", "part"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(toks) and {r.own for r in got} == {"keep"}
    assert {(r.doc_id, r.pos): r.tag for r in got if r.tag != "O"} == want
    assert S.spans_to_bio(t.limit(0), s, ["doc_id", "part"]).count() == 0


def test_offsets_after_unicode_space(spark):
    texts = ["\u3000\u3000x y", "\x1f a", "\xa0\t b  c", "plain", " \u2028"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.tokenize_whitespace(df).collect():
        assert texts[r.doc_id][r.start:r.end] == r.token
    assert [(r.start, r.end) for r in S.tokenize_whitespace(df.where("doc_id = 0")).orderBy("pos").collect()] == [(2, 3), (4, 5)]


def _plain_lexicon(words, names):
    out, at = [], 0
    while at < len(words):
        n = max((len(x) for x in names if words[at:at + len(x)] == x), default=0)
        if n:
            out.append((at, at + n))
        at += n or 1
    return out


def test_lexicon_match_equals_a_plain_scan(spark):
    import random
    rng = random.Random(11)
    names = [[rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 4, 12]))] for _ in range(12)] + [list("abcabcabc"), list("bcab"), ["c"] * 30]
    docs = [[rng.choice("aabbccx") for _ in range(rng.randint(0, 150))] for _ in range(30)] + [["c"] * 100]
    toks = spark.createDataFrame([(d, i, w.upper() if rng.random() < 0.3 else w) for d, ws in enumerate(docs) for i, w in enumerate(ws)],
                                 "doc_id long, pos int, token string").repartition(4)
    lex = spark.createDataFrame([(" ".join(n),) for n in names] + [("",)], "name string")
    want = sorted((d, s, e) for d, ws in enumerate(docs) for s, e in _plain_lexicon(ws, names))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        for max_bytes in (1 << 20, 300):                       # one automaton, and blocks of the lexicon
            got = S.lexicon_match(toks, lex, "M", max_bytes=max_bytes).collect()
            assert sorted((r.doc_id, r.start, r.end) for r in got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert S.lexicon_match(toks, lex.limit(0), "M").count() == 0 and S.lexicon_match(toks.limit(0), lex, "M").count() == 0
