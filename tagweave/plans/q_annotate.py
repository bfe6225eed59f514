"""Queries: regex annotation of documents (collect-and-pre-annotate stage)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import spans as S
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import table

# --- oracle SQL pieces -------------------------------------------------------
# DuckDB's RE2 has no lookbehind; the number scan is re-stated as a recursive
# CTE that restarts after every match, exactly like the documented loop.
def metric_cte(source: str = "documents") -> str:
    return METRIC_CTE.replace("from documents where", f"from {source} where")


METRIC_CTE = r"""
with recursive st(doc_id,text,base,pos,m,s,hit) as (
 select doc_id,text,1,1,null::varchar,null::int,false from documents where regexp_matches(text,'\d')
 union all
 select doc_id,text, case when blk then base else p+length(mm) end,
        case when blk then p+1 else p+length(mm) end, mm, p, not blk from (
  select *, regexp_matches(substr(text,base,p-base),'(?i)(table\s|fig\s|figure\s|section\s|\d.)$') blk from (
   select *, pos-1+strpos(substr(text,pos),mm) p from (
    select doc_id,text,base,pos, regexp_extract(substr(text,pos),'(?i)\d[.]?[^a-z\s]\d*%?') mm from st)
   where mm<>'')))
"""

METRIC_SPANS_SQL = METRIC_CTE + r"""
, hits as (select doc_id, s-1 as st, m from st where hit and not regexp_matches(m,'(19|20)\d{2}'))
select doc_id, (row_number() over (partition by doc_id order by st) - 1)::INTEGER as ord,
       st::INTEGER as start, (st+length(m))::INTEGER as "end", m as text, 'MetricValue' as label
from hits
"""

HYPER_SPANS_SQL = r"""
with m as (
  select doc_id, regexp_extract_all(text, '(?i)\d+[e][-]?[\d]*') ms,
         string_split_regex(text, '(?i)\d+[e][-]?[\d]*') gs
  from documents where regexp_matches(text, '(?i)\de')
), u as (
  select doc_id, i, ms[i] as mt, length(gs[i]) as gl
  from (select doc_id, ms, gs, unnest(generate_series(1, len(ms))) as i from m)
), o as (
  select doc_id, i, mt, sum(gl + length(mt)) over (partition by doc_id order by i) - length(mt) as st from u
)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::INTEGER as ord,
       st::INTEGER as start, (st + length(mt))::INTEGER as "end", mt as text, 'HyperparameterValue' as label
from o where not regexp_matches(mt, '(19|20)\d{2}')
"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@register("annotate_metric_values", METRIC_SPANS_SQL)
def q_annotate_metric_values(spark, sf_dir):
    return S.annotate_metric_values(_docs(spark, sf_dir))


@register("annotate_hyperparameter_values", HYPER_SPANS_SQL)
def q_annotate_hyperparameter_values(spark, sf_dir):
    return S.annotate_hyperparameter_values(_docs(spark, sf_dir))


# legacy offsets: a dropped (year-like) match does not advance the offset base
@register("regex_spans", METRIC_CTE + r"""
, hits as (select doc_id, s-1 as st, s-1+length(m) as en, m,
                  regexp_matches(m,'(19|20)\d{2}') as dropped from st where hit),
w as (select *, coalesce(lag(en) over (partition by doc_id order by st), 0) as prev_en from hits),
x as (select *, coalesce(sum(case when dropped then 0 else en - prev_en end)
                  over (partition by doc_id order by st rows between unbounded preceding and 1 preceding), 0)
                + (st - prev_en) as lst from w)
select doc_id, (row_number() over (partition by doc_id order by st) - 1)::INTEGER as ord,
       lst::INTEGER as start, (lst + length(m))::INTEGER as "end", m as text
from x where not dropped
""")
def q_regex_spans(spark, sf_dir):
    from tagweave import constants as C
    return S.regex_spans(_docs(spark, sf_dir), "text", C.METRIC_VALUE_PATTERN, "doc_id",
                         drop_pattern=C.YEAR_LIKE_PATTERN, legacy_offsets=True, prefilter=r"\d")


@register("drop_year_like", r"""
with m as (
  select doc_id, regexp_extract_all(text, '\d+') ms, string_split_regex(text, '\d+') gs
  from documents where regexp_matches(text, '\d')
), u as (
  select doc_id, i, ms[i] as mt, length(gs[i]) as gl
  from (select doc_id, ms, gs, unnest(generate_series(1, len(ms))) as i from m)
), o as (
  select doc_id, i, mt, sum(gl + length(mt)) over (partition by doc_id order by i) - length(mt) as st from u
)
select doc_id, (i - 1)::INTEGER as ord, st::INTEGER as start, (st + length(mt))::INTEGER as "end", mt as text
from o where not regexp_matches(mt, '(19|20)\d{2}')
""")
def q_drop_year_like(spark, sf_dir):
    spans = S.regex_spans(_docs(spark, sf_dir), "text", r"\d+", "doc_id", prefilter=r"\d")
    return S.drop_year_like(spans)


MERGE_SQL = f"""
with mv as ({METRIC_SPANS_SQL.replace('with recursive', 'select * from (with recursive', 1)})),
hv as ({HYPER_SPANS_SQL}),
mf as (select doc_id, text, min(ord) as ord from mv group by doc_id, text),
hit as (select h.doc_id, h.text, count(*) as n_extra from hv h join mf using (doc_id, text) group by 1, 2),
nm as (select doc_id, count(*) as n_metric from mv group by doc_id),
rest as (select h.* from hv h where not exists (select 1 from mf where mf.doc_id = h.doc_id and mf.text = h.text))
select mv.doc_id, mv.ord, mv.start, mv."end", mv.text,
       'MetricValue' || repeat(',HyperparameterValue', coalesce(x.n_extra, 0)::INTEGER) as labels
from mv left join (select mf.doc_id, mf.ord, hit.n_extra from mf join hit using (doc_id, text)) x
  on mv.doc_id = x.doc_id and mv.ord = x.ord
union all
select r.doc_id, (coalesce(nm.n_metric, 0) + row_number() over (partition by r.doc_id order by r.ord) - 1)::INTEGER,
       r.start, r."end", r.text, 'HyperparameterValue'
from rest r left join nm using (doc_id)
"""


@register("merge_annotations", MERGE_SQL)
def q_merge_annotations(spark, sf_dir):
    d = _docs(spark, sf_dir)
    merged = S.merge_annotations(S.annotate_metric_values(d), S.annotate_hyperparameter_values(d))
    return merged.withColumn("labels", F.array_join("labels", ","))


@register("to_annotation_struct", f"""
with mg as ({MERGE_SQL})
select doc_id, count(*)::INTEGER as n_annotations,
       string_agg(text, '|' order by ord) as texts,
       string_agg(start::VARCHAR || '-' || "end"::VARCHAR, '|' order by ord) as offsets,
       string_agg(labels, '|' order by ord) as labels
from mg group by doc_id
""")
def q_to_annotation_struct(spark, sf_dir):
    d = _docs(spark, sf_dir)
    merged = S.merge_annotations(S.annotate_metric_values(d), S.annotate_hyperparameter_values(d))
    ann = S.to_annotation_struct(merged)
    return ann.select(
        "doc_id",
        F.size("annotations").cast("int").alias("n_annotations"),
        F.array_join(F.transform("annotations", lambda a: a["value"]["text"]), "|").alias("texts"),
        F.array_join(F.transform("annotations", lambda a: F.concat(a["value"]["start"].cast("string"), F.lit("-"),
                                                                     a["value"]["end"].cast("string"))), "|")
        .alias("offsets"),
        F.array_join(F.transform("annotations", lambda a: F.array_join(a["value"]["labels"], ",")), "|")
        .alias("labels"),
    )


def annotate_numbers_by_lang(spark, sf_dir):
    """Flagship: number and hyperparameter spans over all documents, merged,
    counted per (lang, label)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    keys = ["doc_id", "lang"]        # lang rides along with the spans: no join back to documents
    merged = S.merge_annotations(S.annotate_metric_values(docs, keys=keys),
                                 S.annotate_hyperparameter_values(docs, keys=keys), keys=keys)
    return (merged.select("lang", F.explode("labels").alias("label"))
            .groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n_spans")))


register("annotate_numbers_by_lang", f"""
with mg as ({MERGE_SQL}), lab as (select doc_id, unnest(string_split(labels, ',')) as label from mg)
select d.lang, lab.label, count(*) as n_spans from lab join documents d using (doc_id) group by 1, 2
""")(annotate_numbers_by_lang)
