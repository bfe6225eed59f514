"""Queries: label vocabulary operators over tags derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.operators import labels as L
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import doc_sentences, doc_tokens
from tagweave.plans.q_tokens import TAGGED_SQL

LABELS_SQL_LIST = "[" + ", ".join(f"'{t}'" for t in C.LABELS) + "]"

LABEL_LIST_SQL = f"""with {TAGGED_SQL},
ll as (select (row_number() over (order by tag) - 1)::INTEGER as id, tag
       from (select distinct gold as tag from tagged))"""


def _label_list(spark, sf_dir):
    return L.label_list(doc_sentences(spark, sf_dir), "tags")


@register("label_list", LABEL_LIST_SQL + " select * from ll")
def q_label_list(spark, sf_dir):
    return _label_list(spark, sf_dir)


@register("encode_labels", f"""with {TAGGED_SQL}
select sent_id, pos, gold as tag, (list_position({LABELS_SQL_LIST}, gold) - 1)::INTEGER as label_id from tagged
""")
def q_encode_labels(spark, sf_dir):
    t = doc_tokens(spark, sf_dir).select("sent_id", "pos", F.col("gold").alias("tag"))
    return L.encode_labels(t, C.LABELS, "tag", "label_id")


@register("decode_labels", f"""with {TAGGED_SQL}
select sent_id, pos, ((sent_id + pos) % 15)::INTEGER as label_id,
       {LABELS_SQL_LIST}[((sent_id + pos) % 15) + 1] as tag from tagged
""")
def q_decode_labels(spark, sf_dir):
    t = doc_tokens(spark, sf_dir, with_tags=False).select(
        "sent_id", "pos", F.pmod(F.col("sent_id") + F.col("pos"), F.lit(15)).cast("int").alias("label_id"))
    return L.decode_labels(t, C.LABELS, "label_id", "tag")


@register("begin_to_inside", LABEL_LIST_SQL + """
select a.id, a.tag, coalesce(b.id, a.id)::INTEGER as inside_id
from ll a left join ll b on a.tag like 'B-%' and b.tag = replace(a.tag, 'B-', 'I-')
""")
def q_begin_to_inside(spark, sf_dir):
    return L.begin_to_inside(_label_list(spark, sf_dir))


@register("reconcile_labels", LABEL_LIST_SQL + f""",
ml as (select (i - 1)::INTEGER as id, {LABELS_SQL_LIST}[i] as tag from range(1, {len(C.LABELS) + 1}) t(i)),
j as (select coalesce(d.tag, m.tag) as tag, d.id as data_id, m.id as model_id from ll d full outer join ml m on d.tag = m.tag),
s as (select min(case when data_id is not null and model_id is not null then 1 else 0 end) as same from j)
select tag, data_id, model_id, (case when same = 1 then model_id else data_id end)::INTEGER as id,
       case when same = 1 then 'reordered' else 'mismatch' end as status
from j, s
""")
def q_reconcile_labels(spark, sf_dir):
    model = L.labels_table(spark)
    return L.reconcile_labels(_label_list(spark, sf_dir), model)
