"""Operators 4 and 9 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm import jaccard, oracles, shingles
from tagweave.llm import queries as Q
from tagweave.llm import suffix_index as SI
from tagweave.llm.graph import components

SF = "/root/testdata/sf0.001"


def brute_repeats(docs, length=200):
    texts = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[k:k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[:len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("buffer,hot", [(1 << 20, 256), (2048, 20)])
def test_suffix_index_equals_brute_force(spark, table_dir, monkeypatch, buffer, hot):
    monkeypatch.setattr(SI, "BUFFER", buffer)
    monkeypatch.setattr(SI, "HOT", hot)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc de") for _ in range(n))
    shared = [word(300) for _ in range(3)] + [word(199), word(200), word(201)]
    docs = [(i, word(rng.randint(0, 120)) + rng.choice(shared) + word(rng.randint(0, 80))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "a" * 1000), (1003, "ab" * 400), (1004, word(400)), (1005, docs[3][1]), (1005, docs[3][1]),
             (1006, "日本語" * 90), (1007, "x" + "日本語" * 90), (1008, word(5000) + shared[0])]
    hot_text = word(250)
    docs += [(2000 + i, word(30) + hot_text + word(30)) for i in range(60)]
    d = table_dir(spark, "documents", docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op4_suffix_index(spark, d).collect())
    assert got == brute_repeats(docs)


def test_suffix_levels_merge_geometrically(spark):
    index = SI.SuffixIndex(spark)
    sizes = []
    for b in range(5):
        index.add(spark.createDataFrame([(b, b, 1, 1, 0, 1, 0)], "akey long, h long, k1 long, k2 long, lo int, n short, off short"))
        sizes.append(sorted(index.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]
    assert index.entries().count() == 5


def test_suffix_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert SI.remove_repeats(empty).count() == 0
    r = SI.remove_repeats(spark.createDataFrame([(1, "abc", "own", 5)], "doc_id long, text string, x string, n_bytes int")).first()
    assert bytes(r.kept) == b"abc" and r.x == "own" and r.n_bytes == 3


def test_suffix_batches_are_scanned_against_the_levels(spark):
    """Each batch reports its own repeats and, once, the earlier suffix it repeats."""
    index = SI.SuffixIndex(spark)
    schema = "akey long, h long, k1 long, k2 long, lo int, n short, off short"
    batch = lambda *rows: index.add(spark.createDataFrame([(a, h, t, t, 0, 5, 1) for a, h, t in rows], schema))
    texts = lambda found: sorted(r.k1 for r in found[0].collect())
    sharing = lambda found: sorted((r.h, r.k1, r.twice) for r in found[1].collect())
    first = batch((1, 10, 100), (2, 20, 101), (3, 30, 102), (3, 30, 103))
    assert texts(first) == [102, 103] and sharing(first) == []
    second = batch((1, 10, 200), (2, 21, 201), (3, 30, 202))          # 10 again: with its lone copy; 30: copies known
    assert texts(second) == [100, 200, 202] and sharing(second) == [(20, 101, False), (21, 201, False)]
    third = batch((9, 90, 300))
    assert texts(third) == [] and sharing(third) == []
    fourth = batch((2, 20, 400), (9, 91, 401))                        # found two levels down
    assert texts(fourth) == [101, 400]
    assert sharing(fourth) == [(20, 101, True), (21, 201, False), (90, 300, False), (91, 401, False)]
    assert sorted(index.levels) == [2] and sum(r.c for r in index.entries().collect()) == 10


def test_suffix_clashing_columns_and_long_repeats(spark, monkeypatch):
    monkeypatch.setattr(SI, "SLICE", 700)
    monkeypatch.setattr(SI, "MAX_BROADCAST_BYTES", 1)
    a, b = "".join(f"{i:04d}" for i in range(200)), "".join(f"{i * 7:05d}" for i in range(100))
    rows = [(i, t, i, i, "p", "q") for i, t in enumerate([a, b, a + b, None, "", "x" + a[:300], b * 3])]
    df = spark.createDataFrame(rows, "id long, text string, k1 int, t int, packed string, cut string")
    out = SI.remove_repeats(df)
    assert out.columns == [*df.columns, "kept", "n_bytes", "n_removed", "n_spans"]
    got = sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect())
    assert got == brute_repeats([(i, t) for i, t, *_ in rows])
    assert sorted(map(tuple, out.select(*df.columns).collect()), key=lambda r: r[0]) == rows


def test_suffix_common_anchors_make_a_few_rows_a_run(spark, table_dir, monkeypatch):
    """Many different runs at one anchor: equal to brute force, and no step makes a row for each window."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, common = word(500), word(60)
    docs = [(i, word(150) + common + word(150)) for i in range(80)]         # one anchor, nothing repeated
    for i in range(100, 220):                                               # near copies, edited at up to three places
        t = list(core)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(500)] = "é"
        docs.append((i, "".join(t)))
    docs += [(300 + i, word(rng.randint(0, 90)) + core[120:120 + rng.randint(195, 300)]) for i in range(60)]
    docs += [(400 + i, core[:120 + rng.randint(60, 120)] + word(60)) for i in range(40)]
    monkeypatch.setattr(SI, "HOT", 3)
    made = {}
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def counted(self, func, schema, *args, **kwargs):
        out = plain(self, func, schema, *args, **kwargs)
        made.setdefault(func.__qualname__, []).append(out.count())
        return out

    monkeypatch.setattr(frame, "mapInArrow", counted)
    d = table_dir(spark, "documents", docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op4_suffix_index(spark, d).collect())
    assert got == brute_repeats(docs)
    runs = sum(made["_run_rows.<locals>.run"])
    assert max(max(n) for n in made.values()) <= 2 * runs


def brute_components(docs, width=3, percent=90):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().translate(shingles._LOWER).split()
        sets[i] = set() if not w else ({tuple(w)} if len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)})
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_set = defaultdict(list)
    for i in sorted(sets):
        if sets[i]:
            by_set[frozenset(sets[i])].append(i)
    for same in by_set.values():
        for x in same[1:]:
            parent[find(x)] = find(same[0])
    reps = sorted((v[0] for v in by_set.values()), key=lambda i: len(sets[i]))
    for a, x in enumerate(reps):
        for y in reps[a + 1:]:
            if 100 * len(sets[x]) < percent * len(sets[y]):
                break
            both = len(sets[x] & sets[y])
            if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    least = {}
    for i in sorted(sets):
        least.setdefault(find(i), i)
    return {i: (len(sets[i]), least[find(i)]) for i in sets}


def near_copies():
    rng = random.Random(5)
    core = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    docs = []
    for i in range(250):
        w = list(core)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"x{rng.randint(0, 50)}"
        docs.append((i, " ".join(w)))
    boiler = " ".join(f"h{i}" for i in range(60))
    docs += [(i, boiler + " " + " ".join(f"z{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 20)))) for i in range(250, 500)]
    return docs + [(2000, None), (2001, ""), (2002, "a"), (2003, "A"), (2004, "a b"), (2005, " a  b\n"), (2006, "a b c")]


def test_jaccard_equals_brute_force(spark, table_dir, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "HOT_BUCKET", 8)
    docs = near_copies()
    d = table_dir(spark, "documents", docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op9_jaccard(spark, d).collect()}
    assert got == brute_components(docs)


def test_shingles_of_buffers_of_any_size(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["A", "bé", "ccc", "日本", "\x0b", ""]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", " ", "x" * 500, "y z" * 300]
    whole = shingles.Shingler(3).sets(texts)
    monkeypatch.setattr(shingles, "BUFFER", 700)
    assert all((a == b).all() for a, b in zip(whole, shingles.Shingler(3).sets(texts)))
    monkeypatch.undo()
    for t, s in zip(texts, whole):
        w = (t or "").encode().translate(shingles._LOWER).split()
        assert len(s) == (0 if not w else 1 if len(w) < 3 else len({tuple(w[i:i + 3]) for i in range(len(w) - 2)}))
        assert (np.diff(s.astype(object)) > 0).all()
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 300).astype(np.uint64))
    bits = np.zeros(128, dtype=bool)
    bits[(a & np.uint64(127)).astype(int)] = True
    assert [len(shingles.signature(a[:k])) for k in (1, 9, 300)] == [8, 16, 256]
    assert (shingles.folded([shingles.signature(a)], 16)[0].view(np.uint8) == np.packbits(bits)).all()


def test_text_ids_and_clashing_columns(spark):
    docs = near_copies()
    name = lambda i: f"d{i:05d}"
    df = (spark.createDataFrame([(name(i), t) for i, t in docs], "doc_id string, text string")
          .withColumn("id", F.lit(1)).withColumn("token", F.lit(2)).withColumn("component_id", F.lit("z")).withColumn("__id", F.lit(0)))
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(df).collect()}
    assert got == {name(i): (n, name(c)) for i, (n, c) in brute_components(docs).items()}


def test_jaccard_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = sorted(con.execute(oracles.OP9_JACCARD).fetchall())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in Q.op9_jaccard(spark, SF).collect()) == want


def test_keep_first_keeps_one_of_each_group(spark):
    docs = near_copies() + [(7, near_copies()[7][1])]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, id string")
    kept = jaccard.keep_first(df, width=5, percent=80)
    assert kept.columns == df.columns
    comp = brute_components(docs, 5, 80)
    want = sorted(i for i, (_, c) in comp.items() if c == i)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert jaccard.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_first_with_an_id_of_several_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    docs = [(3, b), (5, a), (5, b + " tail"), (6, a), (7, a + " tail"),     # 5 names the group of a and is a near copy of 3
            (8, c), (8, d), (9, d), (9, c + " tail"),                       # two groups with the same smallest id
            (10, a + " more words"), (11, None), (11, ""), (None, a)]
    kept = jaccard.keep_first(spark.createDataFrame(docs * 2, "doc_id long, text string"), width=5, percent=80).collect()
    none = [(11, None), (11, ""), (None, a)]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(3, b), (5, a), (8, c), (8, d), *none * 2]))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 600)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 600: 500}
