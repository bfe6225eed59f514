"""Operator 8: masks, hand cases and the DuckDB statement."""

from itertools import combinations

import duckdb

from tagweave.llm import leaks
from tagweave.llm import oracles
from tagweave.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_masks_find_any_two_substitutions():
    for bad in combinations(range(leaks.WINDOW), leaks.WINDOW - leaks.MIN_EQUAL):
        assert any(all(o + x not in bad for x in m) for m in leaks.MASKS for o in range(leaks.WINDOW - m[-1]))


def words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


def test_hand_cases(spark):
    item = words("q", 30)
    sub2 = item[:3] + ["zz"] + item[4:9] + ["yy"] + item[10:13]          # 13 words, two replaced
    sub3 = sub2[:6] + ["xx"] + sub2[7:]
    docs = [(1, " ".join(words("a", 5) + item + words("b", 5))), (2, " ".join(sub2)), (3, " ".join(sub3)),
            (4, None), (5, ""), (6, " ".join(item[:6])), (7, "Short ITEM, here!"), (8, "short item her"), (1, " ".join(words("a", 5) + item + words("b", 5)))]
    bench = [(10, " ".join(item)), (11, "short item here"), (12, None), (13, "..."), (10, " ".join(item))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = leaks.find_leaks(d, b)
    pairs = {(r.doc_id, r.item_id, r.doc_start, r.n_equal) for r in leaks.leaked_documents(d, found).collect()}
    assert pairs == {(1, 10, 5, 30), (2, 10, 0, 11), (7, 11, 0, 3)}
    assert sorted(r.doc_id for r in leaks.drop_leaked(d, found).collect()) == [3, 4, 5, 6, 8]
    # the blocked way gives the same
    again = leaks.find_leaks(d, b, max_broadcast=7)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in found.collect()}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert leaks.find_leaks(d, b).count() == 0 and leaks.drop_leaked(full, leaks.find_leaks(full, b)).count() == 1


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = sorted(con.execute(oracles.OP8_LEAKS).fetchall())
    df = Q.op8_leaks(spark, SF)
    got = sorted((r.doc_id, r.item_id, r.doc_start, r.n_equal, r.n_item) for r in df.collect())
    assert got == want and got


def test_clashing_columns_and_salted_joins(spark):
    item = words("q", 30)
    text = " ".join(words("a", 5) + item)
    names = ["doc_id", "text", "text_key", "item_id", "c0", "c1", "key", "salt__", "__row", "__key", "words"]
    rows = [(i, text if i < 40 else f"clean {i}", *[f"{n}{i}" for n in names[2:]]) for i in range(50)]
    d = spark.createDataFrame(rows, names)
    b = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(words("b", 4)))], "item_id long, text string")
    plain = d.select("doc_id", "text")
    for max_bytes in (leaks.MAX_BROADCAST_BYTES, 0):
        found = leaks.find_leaks(d, b, max_bytes=max_bytes)
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in leaks.find_leaks(plain, b).collect()}
    hit = leaks.leaked_documents(d, found)
    assert {(r.doc_id, r.item_id, r.doc_start, r.text_key, r.words) for r in hit.collect()} == {(i, 10, 5, f"text_key{i}", f"words{i}") for i in range(40)}
    clean = leaks.drop_leaked(d, found)
    assert clean.columns == names and sorted(map(tuple, clean.collect())) == rows[40:]


def test_an_item_that_reaches_over_the_ends_of_a_text(spark):
    item = words("q", 40)
    d = spark.createDataFrame([(1, " ".join(item[10:30])), (2, " ".join(item[:20])), (3, " ".join(item[25:] + ["x"]))], "doc_id long, text string")
    b = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    found = leaks.leaked_documents(d, leaks.find_leaks(d, b))
    assert {(r.doc_id, r.doc_start, r.n_equal) for r in found.collect()} == {(1, -10, 20), (2, 0, 20), (3, -25, 15)}
