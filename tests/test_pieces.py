from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.operators import pieces as P


def _sent(spark):
    return spark.createDataFrame([(0, ["abcdefghij", "x", "hello"], ["B-MethodName", "I-MethodName", "O"])],
                                 "sent_id long, tokens array<string>, tags array<string>")


def test_expand_pieces(spark):
    r = P.expand_pieces(_sent(spark), P.fixed_width_splitter(4)).collect()[0]
    assert list(r.pieces) == ["[CLS]", "abcd", "##efgh", "##ij", "x", "hell", "##o", "[SEP]"]
    assert list(r.token_starts) == [0, 1, 0, 0, 1, 1, 0, 0]
    assert list(r.labels) == [1, 2, 0]
    assert list(r.word_piece_counts) == [3, 1, 2]
    g = P.expand_pieces(_sent(spark), lambda w: P.FixedWidthSplitter(4)(w)).collect()[0]   # per-word form
    assert list(g.pieces) == list(r.pieces) and list(g.token_starts) == list(r.token_starts)
    e = spark.createDataFrame([(0, ["ab", "", "c"], ["O", "O", "O"]), (1, [], [])],
                              "sent_id long, tokens array<string>, tags array<string>")
    got = {x.sent_id: list(x.pieces) for x in P.expand_pieces(e, P.fixed_width_splitter(4)).collect()}
    assert got == {0: ["[CLS]", "ab", "", "c", "[SEP]"], 1: ["[CLS]", "[SEP]"]}


def test_align_piece_labels_both_settings(spark):
    e = P.expand_pieces(_sent(spark), P.fixed_width_splitter(4))
    off = P.align_piece_labels(e, label_all_tokens=False).collect()[0].aligned_labels
    on = P.align_piece_labels(e, label_all_tokens=True).collect()[0].aligned_labels
    assert list(off) == [-100, 1, -100, -100, 2, 0, -100, -100]
    assert list(on) == [-100, 1, 2, 2, 2, 0, 0, -100]        # B-MethodName -> I-MethodName on continuations
    short = P.align_piece_labels(e, label_all_tokens=False, max_len=4).collect()[0].aligned_labels
    assert list(short) == [-100, 1, -100, -100]


def test_pad_batches(spark):
    df = spark.createDataFrame([(0, 0, [101, 5, 6, 102], [0, 1, 1, 0], [3, 4]),
                                (1, 0, [101, 7, 102], [0, 1, 0], [2])],
                               "sent_id long, batch_id long, input_ids array<int>, token_starts array<int>, "
                               "labels array<int>")
    got = {r.sent_id: r for r in P.pad_batches(df, max_len=3, multiple_of=None).collect()}
    assert list(got[1].input_ids) == [101, 7, 102] and list(got[1].attention_mask) == [1, 1, 1]
    full = {r.sent_id: r for r in P.pad_batches(df, max_len=512, multiple_of=8).collect()}
    assert list(full[1].input_ids) == [101, 7, 102, 0, 0, 0, 0, 0]
    assert list(full[1].attention_mask) == [1, 1, 1, 0, 0, 0, 0, 0]
    assert list(full[1].labels) == [2, -1]


def test_gather_first_pieces(spark):
    e = P.expand_pieces(_sent(spark), P.fixed_width_splitter(4))
    r = P.gather_first_pieces(e, "pieces").collect()[0]
    assert list(r.first_values) == ["abcd", "x", "hell"]


def test_pieces_to_words_first_piece_tag(spark):
    pieces = spark.createDataFrame([(0, ["[CLS]", "abc", "##de", "##f", "x", "[SEP]"],
                                     ["O", "B-X", "I-X", "O", "B-Y", "O"])],
                                   "sent_id long, pieces array<string>, piece_tags array<string>")
    words = spark.createDataFrame([(0, ["abcdef", "x"])], "sent_id long, words array<string>")
    got = [(r.pos, r.word, r.tag) for r in P.pieces_to_words(pieces, words).orderBy("pos").collect()]
    assert got == [(0, "abcdef", "B-X"), (1, "x", "B-Y")]
    both = pieces.join(words, "sent_id")
    got = [(r.pos, r.word, r.tag) for r in P.pieces_to_words(both).orderBy("pos").collect()]
    assert got == [(0, "abcdef", "B-X"), (1, "x", "B-Y")]


def _reference_split(word, first, rest, unk):
    out, at = [], 0
    while at < len(word):
        table = first if at == 0 else rest
        n = max((k for k in range(1, len(word) - at + 1) if word[at:at + k] in table), default=0)
        if not n:
            return [unk]
        out.append(table[word[at:at + n]])
        at += n
    return out or [unk]


def _vocabulary():
    return [("un", 1), ("aff", 2), ("##aff", 3), ("##able", 4), ("##a", 5), ("##ble", 6), ("una", 7), ("x", 8), ("##ffable", 9), ("é", 10),
            ("[UNK]", 50), ("[CLS]", 51), ("##", 11), ("#", 12), ("###", 13)]


def test_vocabulary_splitter_equals_a_plain_loop(spark):
    import random
    rng = random.Random(1)
    vocab = _vocabulary()
    first = {p: i for p, i in vocab if not (p.startswith("##") and len(p) > 2) and p != "[UNK]"}
    rest = {p[2:]: i for p, i in vocab if p.startswith("##") and len(p) > 2}
    names = {i: p for p, i in vocab}
    words = ["unaffable", "unable", "x", "xx", "", "日本", "[UNK]", "é", "##", "####", "una" * 3, "affa"]
    words += ["".join(rng.choices(["un", "aff", "able", "a", "ble", "x", "#"], k=rng.randint(1, 5))) for _ in range(60)]
    rows = [(i, rng.choices(words, k=rng.randint(0, 9))) for i in range(40)] + [(99, words)]
    df = spark.createDataFrame(rows, "sent_id long, tokens array<string>").withColumn("tags", F.transform("tokens", lambda t: F.lit("O")))
    table = spark.createDataFrame(vocab, "piece string, id int")
    for max_bytes in (P.VocabularySplitter.__init__.__defaults__[-1], 0):         # shipped, and by joins
        got = P.expand_pieces(df, P.VocabularySplitter(table, max_bytes=max_bytes)).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = [_reference_split(w, first, rest, 50) for w in r.tokens]
            assert r.piece_ids == [51, *[i for x in ids for i in x], 102]
            assert r.pieces == ["[CLS]", *[names[i] for x in ids for i in x], "[SEP]"]
            assert r.word_piece_counts == [len(x) for x in ids]
            assert r.token_starts == [0, *[int(k == 0) for x in ids for k in range(len(x))], 0]


def test_vocabulary_splitter_edge_rows(spark):
    df = spark.createDataFrame([(0, None, None), (1, [], []), (2, [None, "x"], ["O", "O"])], "sent_id long, tokens array<string>, tags array<string>")
    table = spark.createDataFrame(_vocabulary() + [(None, 3), ("x", 99)], "piece string, id int")
    for max_bytes in (1 << 20, 0):
        got = {r.sent_id: (r.pieces, r.piece_ids) for r in P.expand_pieces(df, P.VocabularySplitter(table, max_bytes=max_bytes)).collect()}
        assert got[1] == (["[CLS]", "[SEP]"], [51, 102]) and got[2] == (["[CLS]", "[UNK]", "x", "[SEP]"], [51, 50, 8, 102])
        assert got[0][0] is None
    empty = spark.createDataFrame([], "piece string, id int")
    assert P.expand_pieces(df.where("sent_id = 2"), P.VocabularySplitter(empty)).first().pieces == ["[CLS]", "[UNK]", "[UNK]", "[SEP]"]


def _mapped(spark, words, pieces, tags, **kw):
    df = spark.createDataFrame([(0, words, pieces, tags)], "sent_id long, words array<string>, pieces array<string>, piece_tags array<string>")
    return [r.tag for r in P.pieces_to_words(df, **kw).orderBy("pos").collect()]


def test_an_unknown_piece_covers_its_word(spark):
    words = ["日本語", "x", "y"]
    assert _mapped(spark, words, ["[UNK]", "x", "y"], ["B-X", "B-Y", "I-Y"]) == ["B-X", "B-Y", "I-Y"]
    assert _mapped(spark, words, ["[CLS]", "[UNK]", "[UNK]", "[UNK]", "x", "y", "[SEP]"], ["O", "B-X", "O", "O", "B-Y", "I-Y", "O"]) == ["B-X", "B-Y", "I-Y"]
    assert _mapped(spark, words, ["[UNK]", "[UNK]", "y"], ["B-X", "B-Y", "I-Y"]) == ["B-X", "B-Y", "I-Y"]
    assert _mapped(spark, ["ab日c", "x"], ["ab", "[UNK]", "x"], ["B-X", "O", "B-Y"]) == ["B-X", "B-Y"]
    assert _mapped(spark, ["ab日c", "x"], ["ab", "[UNK]", "##c", "x"], ["B-X", "O", "O", "B-Y"]) == ["B-X", "B-Y"]
    assert _mapped(spark, ["É日", "Straße", "z"], ["e", "[UNK]", "strasse"], ["B-X", "O", "B-Y"]) == ["B-X", "B-Y", "O"]
    assert _mapped(spark, ["日", "", "x"], ["[UNK]", "x"], ["B-X", "B-Y"]) == ["B-X", "O", "B-Y"]
    assert _mapped(spark, ["日本", "語"], ["[UNK]"], ["B-X"]) == ["B-X", "O"]
    assert _mapped(spark, ["a"], [], []) == ["O"] and _mapped(spark, [], ["a"], ["O"]) == []
    assert _mapped(spark, ["日" * 30, "a"], ["[UNK]"] * 12 + ["a", "b"], ["B-X"] + ["O"] * 13)[0] == "B-X"      # texts that disagree


def test_words_keep_their_first_pieces_through_the_vocabulary(spark):
    import random
    rng = random.Random(4)
    vocab = spark.createDataFrame(_vocabulary(), "piece string, id int")
    words = ["unaffable", "x", "日本", "una", "", "éx", "#", "unx", "##"]
    tags = ["O", "B-TaskName", "I-TaskName", "B-MetricName"]
    rows = [(i, w, [rng.choice(tags) for _ in w]) for i in range(60) for w in [rng.choices(words, k=rng.randint(0, 12))]]
    e = P.expand_pieces(spark.createDataFrame(rows, "sent_id long, tokens array<string>, tags array<string>"), P.VocabularySplitter(vocab))
    per_piece = F.concat(F.array(F.lit("O")), P.repeat_per_word(F.col("tags"), F.col("word_piece_counts")), F.array(F.lit("O")))
    got = P.pieces_to_words(e.select("sent_id", "pieces", "token_starts", per_piece.alias("piece_tags")),
                            e.select("sent_id", F.col("tokens").alias("words")), starts_col="token_starts").collect()
    # an empty word is an unknown piece here: it takes part of the next word's row only where nothing else fits
    plain = {(i, k): t for i, w, ts in rows if "" not in w for k, t in enumerate(ts)}
    assert {(r.sent_id, r.pos): r.tag for r in got if (r.sent_id, r.pos) in plain} == plain


def test_fill_truncated(spark):
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate("a b c d".split())],
                                  "sent_id long, pos int, token string")
    preds = spark.createDataFrame([(0, 0, "B-X"), (0, 1, "I-X")], "sent_id long, pos int, tag string")
    got = [r.tag for r in P.fill_truncated(words, preds).orderBy("pos").collect()]
    assert got == ["B-X", "I-X", "O", "O"]
