"""Queries: linear-chain decoding and sequence log-likelihood over per-token
scores taken from ``embeddings`` (10 tags, as many as there are labels;
sentences of 8 vectors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import decode as D
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import table

K = 10
SENT = 8
# transition / start / end scores from a rule (not data)
TRANS = [[((i * 3 + j * 5) % 7 - 3) / 4.0 for j in range(K)] for i in range(K)]
START = [((i % 3) - 1) / 2.0 for i in range(K)]
END = [(((j * 2) % 5) - 2) / 3.0 for j in range(K)]


def emission_sentences(spark, sf_dir):
    """(sent_id, emissions array<array<double>>, labels array<int>) with
    sentence = vec_id div 8, scores = first K dims, label = label mod K."""
    e = table(spark, sf_dir, "embeddings")
    tok = e.select(F.floor(F.col("vec_id") / SENT).alias("sent_id"), "vec_id",
                   F.transform(F.slice("embedding", 1, K), lambda x: x.cast("double")).alias("em"),
                   F.pmod(F.col("label"), F.lit(K)).cast("int").alias("y"))
    g = tok.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "em", "y"))).alias("xs"))
    return g.select("sent_id", F.transform("xs", lambda x: x["em"]).alias("emissions"),
                    F.transform("xs", lambda x: x["y"]).alias("labels"))


def _values(rows):
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


_EM = "[" + ", ".join(f"embedding[{k + 1}]::DOUBLE" for k in range(K)) + "]"
_BASE = f"""e as (select vec_id // {SENT} as s, vec_id % {SENT} as t, {_EM} as em, label % {K} as y from embeddings),
n as (select s, max(t) as tl from e group by s),
tr(i, j, v) as (values {_values([(i, j, TRANS[i][j]) for i in range(K) for j in range(K)])}),
st(j, v) as (values {_values([(j, START[j]) for j in range(K)])}),
en(j, v) as (values {_values([(j, END[j]) for j in range(K)])}),
k(j) as (values {_values([(j,) for j in range(K)])})"""


def _viterbi_sql() -> str:
    parts = [_BASE, """d0 as (select e.s, k.j, st.v + e.em[k.j + 1] as sc, k.j::VARCHAR as path
              from e join k on true join st on st.j = k.j where e.t = 0)"""]
    for t in range(1, SENT):
        parts.append(f"""d{t} as (select p.s, k.j, max(p.sc + tr.v) + any_value(e.em[k.j + 1]) as sc,
              arg_max(p.path || ',' || k.j::VARCHAR, p.sc + tr.v) as path
              from d{t - 1} p join tr on tr.i = p.j join k on k.j = tr.j join e on e.s = p.s and e.t = {t}
              group by p.s, k.j)""")
    fin = " union all ".join(f"select d{t}.* from d{t} join n on n.s = d{t}.s and n.tl = {t}" for t in range(SENT))
    parts.append(f"fin as ({fin})")
    return ("with " + ",\n".join(parts) +
            "\nselect s as sent_id, arg_max(path, sc + en.v) as path from fin join en on en.j = fin.j group by s")


def _nll_sql() -> str:
    parts = [_BASE, "a0 as (select e.s, k.j, st.v + e.em[k.j + 1] as a from e join k on true join st on st.j = k.j "
                    "where e.t = 0)"]
    for t in range(1, SENT):
        parts.append(f"""x{t} as (select p.s, k.j, p.a + tr.v as x, e.em[k.j + 1] as em
              from a{t - 1} p join tr on tr.i = p.j join k on k.j = tr.j join e on e.s = p.s and e.t = {t}),
a{t} as (select s, j, max(x) + ln(sum(exp(x - mx))) + any_value(em) as a
         from (select *, max(x) over (partition by s, j) as mx from x{t}) group by s, j)""")
    fin = " union all ".join(f"select a{t}.* from a{t} join n on n.s = a{t}.s and n.tl = {t}" for t in range(SENT))
    parts.append(f"fin as ({fin})")
    parts.append("""lz as (select s, max(z) + ln(sum(exp(z - mz))) as logz
         from (select fin.s, fin.a + en.v as z, max(fin.a + en.v) over (partition by fin.s) as mz
               from fin join en on en.j = fin.j) group by s)""")
    parts.append("""ps as (select e.s, sum(e.em[e.y + 1]) + sum(coalesce(tr.v, 0))
                + max(case when e.t = 0 then st.v end) + max(case when e.t = n.tl then en.v end) as score
         from e join n using (s)
         left join e p on p.s = e.s and p.t = e.t - 1
         left join tr on tr.i = p.y and tr.j = e.y
         join st on st.j = e.y join en on en.j = e.y
         group by e.s)""")
    return ("with " + ",\n".join(parts) +
            "\nselect round(sum(logz - score), 4) as nll, count(*) as n_sequences from lz join ps using (s)")


@register("viterbi_decode", _viterbi_sql())
def q_viterbi_decode(spark, sf_dir):
    d = D.viterbi_decode(emission_sentences(spark, sf_dir), "emissions", TRANS, START, END, "path")
    return d.select("sent_id", F.array_join("path", ",").alias("path"))


@register("sequence_nll", _nll_sql())
def q_sequence_nll(spark, sf_dir):
    r = D.sequence_nll(emission_sentences(spark, sf_dir), "emissions", "labels", TRANS, START, END)
    return r.select(F.round("nll", 4).alias("nll"), "n_sequences")
