"""Queries: sentence segmentation/repair, paragraph restore, alignment,
paper projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.operators import relational as R
from tagweave.operators import sentences as SE
from tagweave.operators.evaluate import argmax_expr
from tagweave.operators.sampling import pick_nth
from tagweave.operators.spans import tokenize_whitespace
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import doc_sentences, doc_tokens, normalized_documents, papers, table
from tagweave.plans.q_evaluate import LOGITS_SQL, logits_table
from tagweave.session import scratch_path
from tagweave.sources.conll import write_conll
from tagweave.plans.q_tokens import DOC_TOKENS_SQL, NDOCS_SQL, TAGGED_SQL

SPLIT_SQL_TMPL = r"""{name} as (
  select doc_id, (i - 1)::INTEGER as ord, parts[i] as sentence
  from (select doc_id, parts, unnest(generate_series(1, len(parts))) as i
        from (select doc_id, string_split(regexp_replace(st, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as parts
              from (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as st from {src}) where st <> ''))
)"""


def _sentences(spark, sf_dir):
    return SE.split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@register("split_sentences", "with " + SPLIT_SQL_TMPL.format(name="ss", src="documents") + " select * from ss")
def q_split_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir)


OVERRIDES = [10, 20, 20, 500]
_ORIG_TARGETS = ", ".join(str(i + k + 1) for k, i in enumerate(sorted(OVERRIDES)))


@register("apply_merge_overrides", "with " + SPLIT_SQL_TMPL.format(name="ss", src="documents") + f""",
g as (select *, row_number() over (order by doc_id, ord) - 1 as g from ss),
f as (select *, sum(case when g in ({_ORIG_TARGETS}) then 0 else 1 end) over (order by g) as grp from g)
select (min(g) - (select count(*) from (values {", ".join(f"({t})" for t in _ORIG_TARGETS.split(", "))}) v(t)
                  where v.t <= min(g)))::BIGINT as line_id,
       arg_min(doc_id, g) as doc_id, arg_min(ord, g) as ord, string_agg(sentence, '' order by g) as sentence
from f group by grp
""")
def q_apply_merge_overrides(spark, sf_dir):
    return SE.apply_merge_overrides(_sentences(spark, sf_dir), OVERRIDES)


# indices from the benchmark's ids, applied from the last item to the first: in no order
@register("apply_merge_overrides_table", "with recursive " + SPLIT_SQL_TMPL.format(name="ss", src="documents") + """,
ov as (select row_number() over (order by item_id desc) as k, (item_id * 7919) % 400 as i from benchmark),
st(k, m) as (
  select 0::BIGINT, []::BIGINT[]
  union all
  select ov.k, list_sort(list_append(st.m, ov.i + 1 + len(list_filter(st.m, lambda x, n: x - (n - 1) <= ov.i + 1))))
  from st join ov on ov.k = st.k + 1),
mg as (select unnest(m) as g from st where k = (select max(k) from ov)),
g as (select *, row_number() over (order by doc_id, ord) - 1 as g from ss),
f as (select *, sum(case when g in (select g from mg) then 0 else 1 end) over (order by g) as grp from g)
select (grp - 1)::BIGINT as line_id, arg_min(doc_id, g) as doc_id, arg_min(ord, g) as ord, string_agg(sentence, '' order by g) as sentence
from f group by grp
""")
def q_apply_merge_overrides_table(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    overrides = b.select((-F.col("item_id")).alias("seq"), F.pmod(F.col("item_id") * 7919, F.lit(400)).alias("index"))
    return SE.apply_merge_overrides(_sentences(spark, sf_dir), overrides)


ABBREV_SUFFIXES = ("et al .", "e.g.", "i.e.", "the.")
ABBREV_EXCEPTIONS = [3, 50]


@register("merge_abbreviation_breaks", "with " + SPLIT_SQL_TMPL.format(name="ss", src="documents") + f""",
g as (select *, row_number() over (order by doc_id, ord) - 1 as g from ss),
p as (select *, lag(sentence) over (order by g) as prev from g),
f as (select *, coalesce(prev is not null and (suffix(prev, 'et al .') or suffix(prev, 'e.g.') or suffix(prev, 'the.')
                  or (suffix(prev, 'i.e.') and g not in ({", ".join(map(str, ABBREV_EXCEPTIONS))}))), false) as flag from p),
h as (select *, sum(case when flag then 0 else 1 end) over (order by g) as grp from f)
select min(g)::BIGINT as first_index, arg_min(doc_id, g) as doc_id, arg_min(ord, g) as ord,
       string_agg(sentence, ' ' order by g) as sentence
from h group by grp
""")
def q_merge_abbreviation_breaks(spark, sf_dir):
    return SE.merge_abbreviation_breaks(_sentences(spark, sf_dir), exceptions=ABBREV_EXCEPTIONS,
                                        suffixes=ABBREV_SUFFIXES)


@register("restore_paragraphs", f"""with {DOC_TOKENS_SQL},
{SPLIT_SQL_TMPL.format(name="ss", src="ndocs")},
st as (select doc_id, ord, (i - 1) as pos, w[i] as token
       from (select doc_id, ord, w, unnest(generate_series(1, len(w))) as i
             from (select doc_id, ord, string_split(sentence, ' ') as w from ss))),
pn as (select token, case when regexp_matches(token, '\\d') then 'B-MetricValue' else 'O' end as tag,
              row_number() over (order by doc_id, ord, pos) as n from st),
tn as (select sent_id as para_id, pos, row_number() over (order by sent_id, pos) as n from dtok)
select tn.para_id, tn.pos, pn.token, pn.tag from tn join pn using (n)
""")
def q_restore_paragraphs(spark, sf_dir):
    nd = normalized_documents(spark, sf_dir)
    sents = SE.split_sentences(nd, "text", "doc_id")
    st = sents.select("doc_id", "ord", F.posexplode(F.split("sentence", " ", -1)).alias("pos", "token"))
    st = st.withColumn("tag", F.when(F.col("token").rlike(r"\d"), F.lit("B-MetricValue")).otherwise(F.lit("O")))
    tmpl = doc_tokens(spark, sf_dir, with_tags=False).withColumnRenamed("sent_id", "para_id")
    return SE.restore_paragraphs(st.select("doc_id", "ord", "pos", "token", "tag"), tmpl,
                                 pred_order=("doc_id", "ord", "pos"), template_order=("para_id", "pos"))


@register("check_token_alignment", r"""with raw as (
  select doc_id, (i - 1)::INTEGER as pos, ws[i] as token
  from (select doc_id, ws, unnest(generate_series(1, len(ws))) as i
        from (select doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ') as ws from documents))
), """ + DOC_TOKENS_SQL.strip() + """
select coalesce(raw.doc_id, dtok.sent_id) as doc_id, coalesce(raw.pos, dtok.pos) as pos,
       raw.token as token_a, dtok.token as token_b
from raw full outer join dtok on raw.doc_id = dtok.sent_id and raw.pos = dtok.pos
where raw.token is distinct from dtok.token
""")
def q_check_token_alignment(spark, sf_dir):
    raw = tokenize_whitespace(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    norm = doc_tokens(spark, sf_dir, with_tags=False).withColumnRenamed("sent_id", "doc_id")
    return SE.check_token_alignment(raw.select("doc_id", "pos", "token"), norm, keys=["doc_id", "pos"])


CHANGED = 1000      # every so many tokens differ between the two files


@register("check_file_alignment", f"""with {DOC_TOKENS_SQL},
ln as (select sent_id, pos, token as token_a, case when (sent_id * 31 + pos) % {CHANGED} = 0 then token || '~' else token end as token_b from dtok
       union all select sent_id, max(pos) + 1, '', '' from dtok group by sent_id),
nl as (select *, (row_number() over (order by sent_id, pos) - 1)::BIGINT as line from ln)
select line, token_a, token_b from nl where token_a <> token_b
""")
def q_check_file_alignment(spark, sf_dir):
    t = doc_sentences(spark, sf_dir)
    first = F.pmod(F.col("sent_id") * 31, F.lit(CHANGED)).alias("first")
    changed = F.transform("tokens", lambda w, i: F.when(F.pmod(F.col("first") + i, F.lit(CHANGED)) == 0, F.concat(w, F.lit("~"))).otherwise(w))
    a, b = scratch_path(spark, "lines_a"), scratch_path(spark, "lines_b")
    write_conll(t, a, token_col="tokens", tag_col="tags")
    write_conll(t.select("*", first).withColumn("tokens", changed), b, token_col="tokens", tag_col="tags")
    return SE.check_file_alignment(spark, a, b)


PAPERS_SQL = """pp as (select 'conv://' || conv_id::VARCHAR as url, conv_id, 'conversation ' || conv_id::VARCHAR as title,
       arg_min(text, turn) as abstract, string_agg(text, chr(10) || '---' || chr(10) order by turn) as content,
       count(*) as n_sections, arg_min(text, turn) as first_text from conversations group by conv_id)"""


@register("first_section_sentences", f"""with {PAPERS_SQL}
select url, (i - 1)::INTEGER as ord, parts[i] as sentence
from (select url, parts, unnest(generate_series(1, len(parts))) as i
      from (select url, string_split(replace(first_text, 'et al.', 'et al'), '. ') as parts from pp))
""")
def q_first_section_sentences(spark, sf_dir):
    return SE.first_section_sentences(papers(spark, sf_dir))


@register("pick_nth", f"""with {PAPERS_SQL}
select url, string_split(replace(first_text, 'et al.', 'et al'), '. ')[3] as picked from pp
""")
def q_pick_nth(spark, sf_dir):
    p = papers(spark, sf_dir)
    s = p.select("url", F.split(F.replace(F.get(F.col("sections"), 0)["text"], F.lit("et al."), F.lit("et al")),
                                r"\. ", -1).alias("sents"))
    return pick_nth(s, "sents", 2).select("url", "picked")


@register("project_papers", f"""with {PAPERS_SQL}
select url, title, abstract, content, n_sections::INTEGER as n_content from pp
""")
def q_project_papers(spark, sf_dir):
    pr = R.project_papers(papers(spark, sf_dir))
    return pr.select("url", "title", F.array_join("abstract", "|").alias("abstract"),
                     F.array_join("content", "\n---\n").alias("content"),
                     F.size("content").cast("int").alias("n_content"))


VENUES = ["src1", "src4", "src7", "src11"]


@register("filter_venues", f"""select doc_id, source as venue from documents
where source in ({", ".join(f"'{v}'" for v in VENUES)})""")
def q_filter_venues(spark, sf_dir):
    bib = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("venue"))
    return R.filter_venues(bib, VENUES)


LABELS_SQL_LIST = "[" + ", ".join(f"'{t}'" for t in C.LABELS) + "]"


@register("mask_ignored", f"""with {LOGITS_SQL},
lp as (select *, (list_position(logits, list_max(logits)) - 1) as pid from lg)
select sent_id, coalesce(string_agg({LABELS_SQL_LIST}[pid + 1], ' ' order by vec_id)
                           filter (where label <> -1), '') as pred_tags,
       coalesce(string_agg({LABELS_SQL_LIST}[label + 1], ' ' order by vec_id) filter (where label <> -1), '') as gold_tags
from lp group by sent_id
""")
def q_mask_ignored(spark, sf_dir):
    lg = logits_table(spark, sf_dir)
    seqs = (lg.groupBy("sent_id")
            .agg(F.array_sort(F.collect_list(F.struct("vec_id", argmax_expr(F.col("logits")).alias("p"), "label")))
                 .alias("xs"))
            .select("sent_id", F.transform("xs", lambda x: x["p"]).alias("preds"),
                    F.transform("xs", lambda x: x["label"]).alias("labels")))
    m = R.mask_ignored(seqs, "preds", "labels", -1, C.LABELS)
    return m.select("sent_id", F.array_join("pred_tags", " ").alias("pred_tags"),
                    F.array_join("gold_tags", " ").alias("gold_tags"))


@register("resolve_columns", f"""with {TAGGED_SQL}
select sent_id, string_agg(token, ' ' order by pos) as text, string_agg(gold, ' ' order by pos) as label
from tagged group by sent_id
""")
def q_resolve_columns(spark, sf_dir):
    ds = doc_sentences(spark, sf_dir).withColumnRenamed("tags", "ner_tags")
    r = R.resolve_columns(ds, task="ner", keep=["sent_id"])
    return r.select("sent_id", F.array_join("text", " ").alias("text"), F.array_join("label", " ").alias("label"))
