"""Queries: tokens with offsets, spans <-> BIO, lexicon matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave import constants as C
from tagweave.functions.text import normalize_ws
from tagweave.operators import spans as S
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import doc_tokens, normalized_documents, table
from tagweave.plans.q_annotate import metric_cte

# --- shared oracle fragments ---------------------------------------------------
NDOCS_SQL = "ndocs as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from documents)"

DOC_TOKENS_SQL = f"""
{NDOCS_SQL},
dtok as (
  select doc_id as sent_id, (i - 1)::INTEGER as pos, w[i] as token
  from (select doc_id, w, unnest(generate_series(1, len(w))) as i
        from (select doc_id, string_split(text, ' ') as w from ndocs))
)"""

GOLD_SQL = """case when ((sent_id * 7 + (pos // 3) * 5) % 10) >= 7 then 'O'
  else (case when pos % 3 = 0 then 'B-' else 'I-' end) ||
       ['MethodName','HyperparameterName','HyperparameterValue','MetricName','MetricValue','TaskName','DatasetName']
       [((sent_id * 7 + (pos // 3) * 5) % 10) + 1] end"""

PRED_SQL = f"case when (sent_id + pos) % 11 = 0 then 'O' else {GOLD_SQL} end"

TAGGED_SQL = f"""{DOC_TOKENS_SQL},
tagged as (select sent_id, pos, token, {GOLD_SQL} as gold, {PRED_SQL} as pred from dtok)"""


def chunks_sql(src: str, tag: str, part: str = "sent_id", order: str = "pos") -> str:
    """Non-strict IOB2 chunks of column ``tag`` as (part, type, start, end)."""
    et = "(case when {t} is null or {t} = 'O' then '' else regexp_extract({t}, '^[^-]*-(.*)$', 1) end)"
    cur, prv, nxt = et.format(t=tag), et.format(t="pv"), et.format(t="nx")
    return f"""(select {part}, typ as type, st::INTEGER as start, (ix_end)::INTEGER as "end" from (
  select *, max(case when is_s then ix end) over (partition by {part} order by {order}
            rows between unbounded preceding and current row) as st, ix + 1 as ix_end
  from (select *, ({tag} is not null and {tag} <> 'O') and not (
                     {tag} like 'I-%' and pv is not null and pv <> 'O' and {prv} = {cur}) as is_s,
               ({tag} is not null and {tag} <> 'O') and not (
                     nx is not null and nx like 'I-%' and {nxt} = {cur}) as is_e,
               {cur} as typ
        from (select *, lag({tag}) over (partition by {part} order by {order}) as pv,
                        lead({tag}) over (partition by {part} order by {order}) as nx,
                        {order.split(',')[-1].strip()} as ix
              from {src})))
  where is_e)"""


@register("tokenize_whitespace", r"""
with s as (
  select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as st,
         length(text) - length(regexp_replace(text, '^\s+', '')) as lead from documents
), w as (
  select doc_id, lead, (i - 1)::INTEGER as pos, ws[i] as token
  from (select doc_id, lead, ws, unnest(generate_series(1, len(ws))) as i
        from (select doc_id, lead, string_split(st, ' ') as ws from s))
), o as (
  select *, lead + coalesce(sum(length(token) + 1) over (partition by doc_id order by pos
            rows between unbounded preceding and 1 preceding), 0) as start from w
)
select doc_id, pos, token, start::INTEGER as start, (start + length(token))::INTEGER as "end" from o
""")
def q_tokenize_whitespace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return S.tokenize_whitespace(docs, "text", "doc_id")


def _norm_spans(spark, sf_dir):
    nd = normalized_documents(spark, sf_dir)
    m = S.annotate_metric_values(nd)
    h = S.annotate_hyperparameter_values(nd)
    return nd, m.unionByName(h)


_SPANS_TO_BIO_SQL = metric_cte("ndocs_src").replace(
    "with recursive", f"with recursive {NDOCS_SQL.replace('ndocs as', 'ndocs_src as')},", 1) + r"""
, ms as (select doc_id, s-1 as s_start, s-1+length(m) as s_end, 'MetricValue' as s_label
         from st where hit and not regexp_matches(m,'(19|20)\d{2}')),
hm as (select doc_id, regexp_extract_all(text, '(?i)\d+[e][-]?[\d]*') ms,
              string_split_regex(text, '(?i)\d+[e][-]?[\d]*') gs from ndocs_src where regexp_matches(text, '(?i)\de')),
hu as (select doc_id, i, ms[i] as mt, length(gs[i]) as gl
       from (select doc_id, ms, gs, unnest(generate_series(1, len(ms))) as i from hm)),
ho as (select doc_id, mt, sum(gl + length(mt)) over (partition by doc_id order by i) - length(mt) as s_start from hu),
hs as (select doc_id, s_start, s_start + length(mt) as s_end, 'HyperparameterValue' as s_label
       from ho where not regexp_matches(mt, '(19|20)\d{2}')),
sp as (select * from ms union all select * from hs),
tw as (select doc_id, (i - 1)::INTEGER as pos, ws[i] as token
       from (select doc_id, ws, unnest(generate_series(1, len(ws))) as i
             from (select doc_id, string_split(text, ' ') as ws from ndocs_src))),
tk as (select *, coalesce(sum(length(token) + 1) over (partition by doc_id order by pos
             rows between unbounded preceding and 1 preceding), 0) as t_start from tw),
pr as (select tk.doc_id, tk.pos, sp.s_start, sp.s_end, sp.s_label,
              min(tk.pos) over (partition by tk.doc_id, sp.s_start, sp.s_end, sp.s_label) as first_pos,
              row_number() over (partition by tk.doc_id, tk.pos
                                 order by sp.s_start, sp.s_end - sp.s_start desc, sp.s_label) as rk
       from tk join sp on tk.doc_id = sp.doc_id and tk.t_start < sp.s_end
                       and tk.t_start + length(tk.token) > sp.s_start),
ch as (select doc_id, pos, (case when pos = first_pos then 'B-' else 'I-' end) || s_label as tag from pr where rk = 1)
select tk.doc_id, tk.pos, tk.token, tk.t_start::INTEGER as start, (tk.t_start + length(tk.token))::INTEGER as "end",
       coalesce(ch.tag, 'O') as tag
from tk left join ch using (doc_id, pos)
"""


@register("spans_to_bio", _SPANS_TO_BIO_SQL)
def q_spans_to_bio(spark, sf_dir):
    nd, sp = _norm_spans(spark, sf_dir)
    toks = S.tokenize_whitespace(nd, "text", "doc_id")
    return S.spans_to_bio(toks, sp)


@register("bio_to_spans", f"""
with {TAGGED_SQL}
select * from {chunks_sql('tagged', 'gold')}
""")
def q_bio_to_spans(spark, sf_dir):
    return S.bio_to_spans(doc_tokens(spark, sf_dir), "sent_id", "pos", "gold")


LEXICON_SQL = """lex as (select distinct lower(concat_ws(' ', w[1], w[2])) as gram
            from (select string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from benchmark))"""


@register("lexicon_match", f"""
with recursive {DOC_TOKENS_SQL},
{LEXICON_SQL},
nt as (select sent_id as doc_id, pos, lower(token) as tok,
              lead(lower(token)) over (partition by sent_id order by pos) as tok2 from dtok),
cand as (select doc_id, pos, max(n) as n, pos + max(n) as en from (
           select doc_id, pos, 1 as n from nt join lex on nt.tok = lex.gram
           union all
           select doc_id, pos, 2 as n from nt join lex on nt.tok2 is not null and nt.tok || ' ' || nt.tok2 = lex.gram)
         group by doc_id, pos),
g(doc_id, pos, en) as (
  select c.doc_id, c.pos, c.en from cand c where c.pos = (select min(c2.pos) from cand c2 where c2.doc_id = c.doc_id)
  union all
  select c.doc_id, c.pos, c.en from cand c join (
     select g.doc_id, min(c2.pos) as np from g join cand c2 on c2.doc_id = g.doc_id and c2.pos >= g.en group by g.doc_id
  ) nx on c.doc_id = nx.doc_id and c.pos = nx.np
)
select doc_id, pos::INTEGER as start, en::INTEGER as "end", 'TaskName' as label from g
""")
def q_lexicon_match(spark, sf_dir):
    toks = doc_tokens(spark, sf_dir, with_tags=False).withColumnRenamed("sent_id", "doc_id")
    b = table(spark, sf_dir, "benchmark")
    w = F.split(normalize_ws(F.col("text")), " ", -1)
    lex = b.select(F.concat_ws(" ", F.get(w, 0), F.get(w, 1)).alias("name"))
    return S.lexicon_match(toks, lex, "TaskName", "doc_id", max_words=8)
