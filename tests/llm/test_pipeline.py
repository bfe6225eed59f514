"""The chain of stages against its single operators on the smallest tables."""

import duckdb

import corpus_pipeline as CP
from tagweave.llm import oracles
from tagweave.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    kept, columns = docs, docs.columns
    steps = {}
    for name, stage in CP.STAGES:
        kept = stage(spark, kept, SF).checkpoint()
        steps[name] = {r.doc_id: r for r in kept.collect()}
        if name != CP.STAGES[-1][0]:
            assert kept.columns == columns
    toxic = {r.doc_id for r in Q.op10_toxicity(spark, SF).collect() if r.predicted}
    assert set(steps["toxicity"]) == {r.doc_id for r in docs.collect()} - toxic
    # one of each group of exact copies is left
    texts = [r.text for r in steps["near-duplicates"].values()]
    assert len(texts) == len(set(texts))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    leaked = {r[0] for r in con.execute(oracles.OP8_LEAKS).fetchall()}
    assert set(steps["decontamination"]) == set(steps["near-duplicates"]) - leaked
    assert set(steps["identifiers"]) == set(steps["tokens"]) == set(steps["decontamination"])
    assert all("@mail" not in r.text and r.n_chars == len(r.text) for r in steps["identifiers"].values())
    assert all(r.n_tokens == len(r.token_ids) for r in steps["tokens"].values())


def test_run_returns_the_last_stage(spark):
    out = CP.run(spark, SF)
    assert "token_ids" in out.columns and out.count() > 0
