"""Queries: batched user functions, skip-on-failure map, stored results,
the streaming annotator."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from tagweave.operators import batchmap as BM
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import doc_tokens, normalized_documents, table
from tagweave.plans.q_annotate import metric_cte
from tagweave.plans.q_tokens import DOC_TOKENS_SQL, NDOCS_SQL
from tagweave.session import scratch_path
from tagweave.streaming.annotate import annotate_stream


def _word_counts(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": b["doc_id"], "n_words": b["text"].str.split().str.len().astype("int64")})


@register("map_batches", r"""select doc_id,
len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))::BIGINT as n_words from documents""")
def q_map_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return BM.map_batches(d, _word_counts, "doc_id long, n_words long")


# every 50th record is cut short, so that it does not parse
_EVENT_PROPS_SQL = """ev as (select event_id, case when event_id % 50 = 0 then substr(props, 1, length(props) - 1) else props end as props from events)"""


def _event_props(spark, sf_dir):
    cut = F.when(F.pmod("event_id", F.lit(50)) == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", cut.alias("props"))


def _parse_props(rec: dict) -> dict:
    return {"event_id": rec["event_id"], "k": int(json.loads(rec["props"])["k"])}


@register("try_map", f"""with {_EVENT_PROPS_SQL}
select event_id, case when json_valid(props) then try_cast(json_extract(props, '$.k') as BIGINT) end as k,
       case when json_valid(props) and try_cast(json_extract(props, '$.k') as BIGINT) is not null then null else props end as failed_props
from ev""")
def q_try_map(spark, sf_dir):
    ok, errors = BM.try_map(_event_props(spark, sf_dir), _parse_props, "event_id long, k long")
    return (ok.withColumn("failed_props", F.lit(None).cast("string"))
            .unionByName(errors.select("event_id", F.lit(None).cast("long").alias("k"), F.col("props").alias("failed_props"))))


@register("try_columns", f"""with {_EVENT_PROPS_SQL},
t as (select event_id, case when json_valid(props) then try_cast(json_extract(props, '$.k') as BIGINT) end as k from ev)
select event_id, k, case when k is null then 'failed: k' else 'ok' end as status from t""")
def q_try_columns(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return BM.try_columns(_event_props(spark, sf_dir), {"k": k}).select("event_id", "k", "status")


@register("materialize", f"""with {DOC_TOKENS_SQL}
select sent_id as doc_id, count(*) as n_tokens from dtok group by 1""")
def q_materialize(spark, sf_dir):
    counts = (doc_tokens(spark, sf_dir, with_tags=False).groupBy(F.col("sent_id").alias("doc_id"))
              .agg(F.count(F.lit(1)).alias("n_tokens")))
    p = scratch_path(spark, "materialized")
    BM.materialize(counts, p)                      # computes and stores
    return BM.materialize(counts, p)               # re-uses the stored result


_STREAM_SQL = metric_cte("ndocs_src").replace(
    "with recursive", f"with recursive {NDOCS_SQL.replace('ndocs as', 'ndocs_src as')},", 1) + r"""
, hits as (select doc_id, s-1 as st, m from st where hit and not regexp_matches(m,'(19|20)\d{2}'))
select doc_id, (row_number() over (partition by doc_id order by st) - 1)::INTEGER as ord,
       st::INTEGER as start, (st+length(m))::INTEGER as "end", m as text, 'MetricValue' as label
from hits
"""


@register("annotate_stream", _STREAM_SQL)
def q_annotate_stream(spark, sf_dir):
    in_dir = scratch_path(spark, "stream_in")
    nd = normalized_documents(spark, sf_dir)
    nd.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.col("text")).alias("value")) \
      .write.text(in_dir)
    return annotate_stream(spark, in_dir, scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt"),
                           max_files_per_trigger=2)
