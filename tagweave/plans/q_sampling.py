"""Queries: sampling, first-n, batching (ordered and seeded-shuffled)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions.hashing import mix_hash_sql
from tagweave.operators import sampling as SA
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import table

SAMPLE_N, SAMPLE_SEED = 100, 7
FIRST_N = 250
BATCH, SHUFFLE_SEED = 8, 42


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang")


@register("sample_n", f"""select doc_id, lang from documents
order by {mix_hash_sql('doc_id', SAMPLE_SEED)}, doc_id limit {SAMPLE_N}""")
def q_sample_n(spark, sf_dir):
    return SA.sample_n(_docs(spark, sf_dir), "doc_id", SAMPLE_N, SAMPLE_SEED)


@register("take_first_n", f"""select doc_id, count(*) over () as n_used
from (select doc_id from documents order by doc_id limit {FIRST_N})""")
def q_take_first_n(spark, sf_dir):
    return SA.take_first_n(_docs(spark, sf_dir).select("doc_id"), "doc_id", FIRST_N)


@register("sequential_batches", f"""select doc_id, ((row_number() over (order by doc_id) - 1) // {BATCH})::BIGINT
as batch_id from documents""")
def q_sequential_batches(spark, sf_dir):
    return SA.sequential_batches(_docs(spark, sf_dir).select("doc_id"), "doc_id", BATCH)


@register("shuffled_batches", f"""select doc_id,
((row_number() over (order by {mix_hash_sql('doc_id', SHUFFLE_SEED)}, doc_id) - 1) // {BATCH})::BIGINT as batch_id
from documents""")
def q_shuffled_batches(spark, sf_dir):
    return SA.shuffled_batches(_docs(spark, sf_dir).select("doc_id"), "doc_id", BATCH, SHUFFLE_SEED)
