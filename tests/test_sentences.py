from tagweave.operators import sentences as SE


def _sents(spark, texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id long, ord int, sentence string")


def _reference_abbrev(sentences, exceptions=()):
    out = []
    for i, s in enumerate(sentences):
        if i == 0:
            out.append(s)
            continue
        prev = out[-1]
        if prev[-7:] == "et al ." or prev[-4:] == "e.g." or (prev[-4:] == "i.e." and i not in exceptions):
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def test_abbreviation_merges(spark):
    texts = ["Smith et al .", "showed it.", "See e.g.", "this one.", "That is i.e.", "that.", "x e.g.", "y i.e.",
             "z.", "i.e.", "kept apart."]
    got = [r.sentence for r in SE.merge_abbreviation_breaks(_sents(spark, texts), exceptions=[10])
           .orderBy("first_index").collect()]
    assert got == _reference_abbrev(texts, exceptions=[10])


def test_first_sentence_never_merged(spark):
    texts = ["e.g.", "a", "b"]
    got = [r.sentence for r in SE.merge_abbreviation_breaks(_sents(spark, texts)).orderBy("first_index").collect()]
    assert got == ["e.g. a", "b"]


def test_merge_across_paragraphs(spark):
    df = spark.createDataFrame([(0, 0, "end e.g."), (1, 0, "next"), (1, 1, "other")],
                               "doc_id long, ord int, sentence string")
    got = [r.sentence for r in SE.merge_abbreviation_breaks(df).orderBy("first_index").collect()]
    assert got == ["end e.g. next", "other"]
    got = [r.sentence for r in SE.merge_abbreviation_breaks(df, within_paragraph=True)
           .orderBy("first_index").collect()]
    assert got == ["end e.g.", "next", "other"]


def test_merge_overrides_match_sequential_rule(spark):
    texts = [f"s{i}" for i in range(10)]
    idx = [1, 1, 4]
    ref = list(texts)
    for i in idx:
        ref[i:i + 2] = ["".join(ref[i:i + 2])]
    got = SE.apply_merge_overrides(_sents(spark, texts), idx).orderBy("line_id").collect()
    assert [r.sentence for r in got] == ref
    assert [r.line_id for r in got] == list(range(len(ref)))


def test_split_sentences(spark):
    df = spark.createDataFrame([(1, " One. Two!  Three? four\nfive. "), (2, "   ")], "doc_id long, text string")
    got = [(r.doc_id, r.ord, r.sentence) for r in SE.split_sentences(df).orderBy("doc_id", "ord").collect()]
    assert got == [(1, 0, "One."), (1, 1, "Two!"), (1, 2, "Three?"), (1, 3, "four\nfive.")]


def test_restore_and_alignment(spark):
    pred = spark.createDataFrame([(0, 0, "a", "O"), (0, 1, "b", "B-X"), (1, 0, "c", "I-X"), (2, 0, "d", "O")],
                                 "sent_id long, pos int, token string, tag string")
    tmpl = spark.createDataFrame([(7, 0, "a"), (7, 1, "b"), (7, 2, "c"), (9, 0, "d")],
                                 "para_id long, pos int, token string")
    got = [tuple(r) for r in SE.restore_paragraphs(pred, tmpl).orderBy("para_id", "pos").collect()]
    assert got == [(7, 0, "a", "O"), (7, 1, "b", "B-X"), (7, 2, "c", "I-X"), (9, 0, "d", "O")]
    assert SE.check_token_alignment(pred, tmpl.withColumnRenamed("para_id", "sent_id"),
                                    b_order=("sent_id", "pos")).count() == 0
    bad = tmpl.withColumnRenamed("para_id", "sent_id").replace("c", "q")
    assert SE.check_token_alignment(pred, bad, b_order=("sent_id", "pos")).count() == 1
