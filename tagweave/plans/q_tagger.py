"""Queries: count-based tagger training, continuation, prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import tagger as TG
from tagweave.operators.sentences import split_sentences
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import doc_sentences, normalized_documents
from tagweave.plans.q_sentences import SPLIT_SQL_TMPL
from tagweave.plans.q_tokens import TAGGED_SQL


def _gold(spark, sf_dir):
    return doc_sentences(spark, sf_dir).select("sent_id", F.col("tokens").alias("token"), F.col("tags").alias("tag"))


def _events_sql(src: str) -> str:
    return f"""(select 'start' as kind, '' as a, gold as b from {src} where pos = 0
  union all select 'end', gold, '' from {src} t where pos = (select max(pos) from {src} u where u.sent_id = t.sent_id)
  union all select 'trans', lag_gold, gold from (select *, lag(gold) over (partition by sent_id order by pos)
                                                  as lag_gold from {src}) where lag_gold is not null
  union all select 'emit', gold, lower(token) from {src})"""


def _normalize_sql(counts: str) -> str:
    return f"""c as (select kind, a, b, n, case when kind in ('start', 'end') then '' else a end as cond from {counts}),
sz as (select count(distinct a) filter (where kind = 'emit') as kk,
              count(distinct b) filter (where kind = 'emit') as vv from c),
tot as (select kind, cond, sum(n) as tt from c group by 1, 2)
select c.kind, c.a, c.b, c.n::BIGINT as n,
       round(ln((c.n + 1.0) / (tot.tt + (case when c.kind = 'emit' then sz.vv else sz.kk end))), 6) as logp
from c join tot using (kind, cond), sz
union all
select tot.kind || '_unk', tot.cond, '', 0::BIGINT,
       round(ln(1.0 / (tot.tt + (case when tot.kind = 'emit' then sz.vv else sz.kk end))), 6)
from tot, sz"""


@register("train_tag_model", f"""with {TAGGED_SQL},
cnt as (select kind, a, b, count(*) as n from {_events_sql('tagged')} group by 1, 2, 3),
{_normalize_sql('cnt')}
""")
def q_train_tag_model(spark, sf_dir):
    m = TG.train_tag_model(_gold(spark, sf_dir))
    return m.select("kind", "a", "b", "n", F.round("logp", 6).alias("logp"))


@register("merge_tag_models", f"""with {TAGGED_SQL},
ev_base as (select kind, a, b, count(*) as n from {_events_sql('(select * from tagged where sent_id % 2 = 0)')}
            group by 1, 2, 3),
ev_new as (select kind, a, b, count(*) as n from {_events_sql('(select * from tagged where sent_id % 2 = 1)')}
           group by 1, 2, 3),
cnt as (select kind, a, b, sum(n) as n from (select * from ev_base where kind <> 'emit'
                                             union all select * from ev_new) group by 1, 2, 3),
{_normalize_sql('cnt')}
""")
def q_merge_tag_models(spark, sf_dir):
    g = _gold(spark, sf_dir)
    base = TG.train_tag_model(g.where(F.pmod("sent_id", F.lit(2)) == 0))
    new = TG.train_tag_model(g.where(F.pmod("sent_id", F.lit(2)) == 1))
    m = TG.merge_tag_models(base, new, exclude=("emit",))
    return m.select("kind", "a", "b", "n", F.round("logp", 6).alias("logp"))


# Whole-number scores, then the best path of every sentence: a step for each
# position, over all sentences together.  A score is kept times 64 with the tag
# before it in the last digits, so that of equal scores the first tag wins.
_PREDICT_SQL = f"""with recursive {TAGGED_SQL.lstrip()},
cnt as (select kind, a, b, count(*) as n from {_events_sql('tagged')} group by 1, 2, 3),
c as (select kind, a, b, n, case when kind in ('start', 'end') then '' else a end as cond from cnt),
sz as (select count(distinct a) filter (where kind = 'emit') as kk, count(distinct b) filter (where kind = 'emit') as vv from c),
tot as (select kind, cond, sum(n) as tt from c group by 1, 2),
lp as (select c.kind, c.a, c.b, round(ln((c.n + 1.0) / (tot.tt + (case when c.kind = 'emit' then sz.vv else sz.kk end))) / 1e-6)::BIGINT as s
       from c join tot using (kind, cond), sz),
un as (select kind, cond, round(ln(1.0 / (tt + (case when kind = 'emit' then vv else kk end))) / 1e-6)::BIGINT as s from tot, sz),
tg as (select row_number() over (order by a) - 1 as y, a as tag from (select distinct a from lp where kind = 'emit')),
start_ as (select y, coalesce((select s from lp where kind = 'start' and b = tag), (select s from un where kind = 'start')) as s from tg),
end_ as (select y, coalesce((select s from lp where kind = 'end' and a = tag), (select s from un where kind = 'end')) as s from tg),
tr as (select p.y as p, q.y as q, coalesce(lp.s, un.s, (select min(s) from start_)) as s
       from tg p cross join tg q left join lp on lp.kind = 'trans' and lp.a = p.tag and lp.b = q.tag
       left join un on un.kind = 'trans' and un.cond = p.tag),
{SPLIT_SQL_TMPL.format(name="ss", src="ndocs")},
wd as (select doc_id, ord, (i - 1)::INTEGER as pos, w[i] as word
       from (select doc_id, ord, w, unnest(generate_series(1, len(w))) as i from (select doc_id, ord, string_split(sentence, ' ') as w from ss))),
el as (select w, list(s order by y) as e from (
         select dw.w, tg.y, coalesce(lp.s, un.s) as s from (select distinct lower(word) as w from wd) dw cross join tg
         left join lp on lp.kind = 'emit' and lp.a = tg.tag and lp.b = dw.w join un on un.kind = 'emit' and un.cond = tg.tag) group by w),
tm as (select list(col order by q) as m from (select q, list(s order by p) as col from tr group by q)),
sv as (select list(s order by y) as v from start_), ev as (select list(s order by y) as v from end_), names as (select list(tag order by y) as t from tg),
sn as (select row_number() over () as sid, doc_id, ord, n from (select doc_id, ord, max(pos) as n from wd group by 1, 2)),
tok as (select sid, pos, e from wd join sn using (doc_id, ord) join el on el.w = lower(wd.word)),
fw(sid, pos, v) as (
  select sid, pos, list_transform(e, lambda x, i: (x + sv.v[i]) * 64) from tok, sv where pos = 0
  union all
  select fw.sid, fw.pos + 1, list_transform(tm.m, lambda col, q:
           list_max(list_transform(col, lambda s, p: (fw.v[p] - fw.v[p] % 64) + s * 64 + (64 - p))) + tok.e[q] * 64)
  from fw join tok on tok.sid = fw.sid and tok.pos = fw.pos + 1, tm),
fin as (select sid, pos, list_transform(fw.v, lambda x, i: (x - x % 64) + ev.v[i] * 64 + (64 - i)) as f
        from fw join sn using (sid), ev where fw.pos = sn.n),
bk(sid, pos, y) as (
  select sid, pos, 64 - ((list_max(f) % 64) + 64) % 64 from fin
  union all
  select bk.sid, bk.pos - 1, 64 - ((fw.v[bk.y] % 64) + 64) % 64 from bk join fw on fw.sid = bk.sid and fw.pos = bk.pos where bk.pos > 0)
select sn.doc_id, sn.ord, bk.pos, wd.word, names.t[bk.y] as tag
from bk join sn using (sid) join wd on wd.doc_id = sn.doc_id and wd.ord = sn.ord and wd.pos = bk.pos, names
"""


@register("predict_tags", _PREDICT_SQL)
def q_predict_tags(spark, sf_dir):
    # sentences of all documents, as lines
    model = TG.train_tag_model(_gold(spark, sf_dir))
    lines = split_sentences(normalized_documents(spark, sf_dir), "text", "doc_id")
    return TG.predict_tags(lines, model, "sentence", ["doc_id", "ord"])
