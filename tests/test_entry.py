import os
import re
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["lang", "label", "n_spans"]
    assert len(rows) > 0 and sum(r.n_spans for r in rows) >= 51


def test_registry_consistent():
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    # the training-data queries are optional and have tests of their own
    core = {n for n in qs if not re.match(r"op\d+_|pipeline$", n)}
    assert core <= set(os_)
    assert len(core) >= 74


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def test_sample_of_queries_match_oracles(spark):
    con = duckdb.connect()
    for t in ["documents", "events", "embeddings", "pages", "benchmark", "conversations", "part"]:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name in ["annotate_metric_values", "bio_to_spans", "entity_metrics_by_type", "split_sentences",
                 "read_conll_strict", "viterbi_decode", "best_checkpoint"]:
        df = E.queries()[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
        res = con.execute(E.oracle_sql()[name])
        ocols = [d[0] for d in res.description]
        exp = sorted(tuple(_norm(row[ocols.index(c)]) for c in cols) for row in res.fetchall())
        assert got == exp, name
