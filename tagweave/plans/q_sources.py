"""Queries: file sources and sinks.  Each job renders data derived from the
driver tables into the session's shared checkpoint folder and reads it back
through the operator under test, so the work grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.operators import evaluate as EV
from tagweave.operators.relational import filter_venues
from tagweave.operators.sampling import dense_ids
from tagweave.operators.sentences import split_sentences
from tagweave.plans.catalog import register
from tagweave.plans.fixtures import doc_sentences, doc_tokens, normalized_documents, papers, table
from tagweave.plans.q_evaluate import PRF_SQL
from tagweave.plans.q_sentences import PAPERS_SQL, SPLIT_SQL_TMPL, VENUES
from tagweave.plans.q_tokens import DOC_TOKENS_SQL, TAGGED_SQL, chunks_sql
from tagweave.session import scratch_path
from tagweave.sources import conll as CN
from tagweave.sources import formats as FM
from tagweave.sources import html as H


def _gold_sentences(spark, sf_dir, ranged=False):
    return doc_sentences(spark, sf_dir, ranged).select("sent_id", F.col("tokens").alias("token"), F.col("tags").alias("tag"))


@register("write_conll", f"""with {TAGGED_SQL},
ln as (select sent_id, pos, token || chr(9) || gold as value from tagged
       union all select sent_id, max(pos) + 1, '' from tagged group by sent_id)
select (row_number() over (order by sent_id, pos) - 1)::BIGINT as line_id, value from ln
""")
def q_write_conll(spark, sf_dir):
    p = scratch_path(spark, "write_conll")
    CN.write_conll(_gold_sentences(spark, sf_dir), p, sep="\t")
    return FM.read_lines(spark, p)


@register("read_conll_strict", f"""with {TAGGED_SQL}
select (dense_rank() over (order by sent_id) - 1)::BIGINT as sent_id, pos, token, gold as tag from tagged
""")
def q_read_conll_strict(spark, sf_dir):
    p = scratch_path(spark, "strict")
    CN.write_conll(_gold_sentences(spark, sf_dir, ranged=True), p, sep=" -X- _ ", compression="gzip")
    return CN.read_conll_strict(spark, p, sep=" -X- _ ")


@register("read_conll_lenient", f"""with {TAGGED_SQL}
select (dense_rank() over (order by sent_id) - 1)::VARCHAR as id, count(*)::INTEGER as n_tokens,
       string_agg(token, ' ' order by pos) as tokens, string_agg(gold, ' ' order by pos) as ner_tags
from tagged group by sent_id
""")
def q_read_conll_lenient(spark, sf_dir):
    p = scratch_path(spark, "lenient")
    CN.write_conll(_gold_sentences(spark, sf_dir, ranged=True), p, sep=" ", compression="gzip")
    r = CN.read_conll_lenient(spark, p)
    return r.select("id", F.size("tokens").cast("int").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("ner_tags"))


def _bib_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.select(
        "doc_id",
        F.concat(F.lit("Paper "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.pmod("doc_id", F.lit(17)) == 0, F.concat(F.lit("Alpha = "), F.col("source")))
        .otherwise(F.col("source")).alias("booktitle"),
        F.when(F.pmod("doc_id", F.lit(13)) == 0, F.lit(None))
        .otherwise(F.lit(2000) + F.pmod("doc_id", F.lit(25))).alias("year"),
        F.concat(F.lit("https://example.org/anthology/"), F.col("doc_id").cast("string")).alias("url"))


BIB_SQL = """bib as (select doc_id, source as venue,
       (case when doc_id % 13 = 0 then null else 2000 + doc_id % 25 end)::INTEGER as year,
       'https://example.org/anthology/' || doc_id::VARCHAR || '.pdf' as url from documents)"""


def _read_bib(spark, sf_dir):
    p = scratch_path(spark, "bib")
    FM.write_bibtex(_bib_source(spark, sf_dir), p, "doc_id",
                    {"title": "title", "booktitle": "booktitle", "year": "year", "url": "url"})
    return FM.read_bibtex(spark, p)


@register("read_bibtex", f"with {BIB_SQL} select venue, year, url from bib")
def q_read_bibtex(spark, sf_dir):
    return _read_bib(spark, sf_dir).select("venue", "year", "url")


@register("dense_ids", f"""with {BIB_SQL}
select (row_number() over (order by doc_id) - 1)::BIGINT as id, venue, year, url from bib
where venue in ({", ".join(f"'{v}'" for v in VENUES)})
""")
def q_dense_ids(spark, sf_dir):
    kept = filter_venues(_read_bib(spark, sf_dir), VENUES)
    return dense_ids(kept, "src_pos", "id").select("id", "venue", "year", "url")


PAPER_SCHEMA = ("url string, conv_id long, title string, abstract string, "
                "sections array<struct<heading:string,text:string>>")


def _flat_papers(df):
    return df.select("url", "title", "abstract", F.size("sections").cast("int").alias("n_sections"),
                     F.array_join(F.transform("sections", lambda s: s["heading"]), ",").alias("headings"))


FLAT_PAPERS_SQL = f"""with {PAPERS_SQL}, hd as (select 'conv://' || conv_id::VARCHAR as url,
       string_agg(role, ',' order by turn) as headings from conversations group by conv_id)
select url, title, abstract, n_sections::INTEGER as n_sections, headings from pp join hd using (url)"""


@register("read_json_array", FLAT_PAPERS_SQL)
def q_read_json_array(spark, sf_dir):
    p = scratch_path(spark, "json_array")
    FM.write_json_array(papers(spark, sf_dir), p, "conv_id", chunk_rows=50)
    return _flat_papers(FM.read_json_array(spark, p, PAPER_SCHEMA))


@register("write_json", FLAT_PAPERS_SQL)
def q_write_json(spark, sf_dir):
    p = scratch_path(spark, "json_lines")
    FM.write_json(papers(spark, sf_dir), p)
    return _flat_papers(spark.read.schema(PAPER_SCHEMA).json(p))


@register("read_paragraph_lines", r"""
with l as (select doc_id, i, parts[i] as line
           from (select doc_id, parts, unnest(generate_series(1, len(parts))) as i
                 from (select doc_id, string_split(text, chr(10)) as parts from documents)))
select (row_number() over (order by doc_id, i) - 1)::BIGINT as line_id,
       regexp_replace(line, '^\s+|\s+$', '', 'g') as text,
       len(string_split(regexp_replace(line, '^\s+|\s+$', '', 'g'), ' '))::INTEGER as n_words
from l
""")
def q_read_paragraph_lines(spark, sf_dir):
    p = scratch_path(spark, "paragraphs")
    FM.write_lines(table(spark, sf_dir, "documents"), p, "text", "doc_id")
    r = FM.read_paragraph_lines(spark, p)
    return r.select("line_id", "text", F.size("words").cast("int").alias("n_words"))


@register("write_lines", f"""with ndocs as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text
                                           from documents),
{SPLIT_SQL_TMPL.format(name="ss", src="ndocs")}
select (row_number() over (order by doc_id, ord) - 1)::BIGINT as line_id, sentence as value from ss
""")
def q_write_lines(spark, sf_dir):
    p = scratch_path(spark, "lines")
    sents = split_sentences(normalized_documents(spark, sf_dir), "text", "doc_id")
    FM.write_lines(sents, p, "sentence", ["doc_id", "ord"])
    return FM.read_lines(spark, p)


LEX_NAMES_SQL = """ln as (select item_id, concat_ws(' ', w[1], w[2]) as name
  from (select item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from benchmark))"""


def _lexicon_names(spark, sf_dir):
    from tagweave.functions.text import normalize_ws
    b = table(spark, sf_dir, "benchmark")
    w = F.split(normalize_ws(F.col("text")), " ", -1)
    return b.select("item_id", F.concat_ws(" ", F.get(w, 0), F.get(w, 1)).alias("name"))


@register("write_lexicon", f"""with {LEX_NAMES_SQL}
select (row_number() over (order by item_id) - 1)::BIGINT as line_id, name as value from ln
""")
def q_write_lexicon(spark, sf_dir):
    p = scratch_path(spark, "lexicon_w")
    FM.write_lexicon(_lexicon_names(spark, sf_dir).orderBy("item_id"), p)
    return FM.read_lines(spark, p)


@register("read_lexicon", f"""with {LEX_NAMES_SQL}
select regexp_replace(name, '^\\s+|\\s+$', '', 'g') as name from ln
where regexp_replace(name, '^\\s+|\\s+$', '', 'g') <> ''
""")
def q_read_lexicon(spark, sf_dir):
    p = scratch_path(spark, "lexicon_r")
    FM.write_lexicon(_lexicon_names(spark, sf_dir), p)
    return FM.read_lexicon(spark, p)


@register("extract_headings", r"""
select page_id, (i - 1)::INTEGER as ord,
       regexp_replace(replace(replace(replace(replace(replace(replace(
          regexp_replace(hs[i], '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''),
          '&nbsp;', ' '), '&amp;', '&'), '^\s+|\s+$', '', 'g') as name
from (select page_id, hs, unnest(generate_series(1, len(hs))) as i
      from (select page_id, regexp_extract_all(html, '(?s)<h1\b[^>]*>(.*?)</h1>', 1) as hs from pages))
""")
def q_extract_headings(spark, sf_dir):
    return H.extract_headings(table(spark, sf_dir, "pages"), "h1", "page_id", "html")


@register("extract_alias_names", r"""
with n as (select p_partkey as src_id, p_brand, p_name, p_partkey % 3 = 0 as plain from part)
select src_id, 0 as ord, p_name as name, 'name' as kind from n where plain
union all select src_id, 0, p_brand, 'abbreviation' from n where not plain
union all select src_id, 1, p_name, 'full' from n where not plain
""")
def q_extract_alias_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("src_id"),
                     F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.col("p_name"))
                     .otherwise(F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))).alias("name"))
    return H.extract_alias_names(names, "name", "src_id")


@register("load_splits", f"""with {DOC_TOKENS_SQL},
s as (select case when sent_id % 5 = 0 then 'validation' else 'train' end as split, sent_id from dtok)
select split, count(distinct sent_id) as n_sentences, count(*) as n_tokens from s group by split
union all
select 'test', count(distinct sent_id), count(*) from s where split = 'validation'
""")
def q_load_splits(spark, sf_dir):
    toks = _gold_sentences(spark, sf_dir, ranged=True)
    tr, va = scratch_path(spark, "train"), scratch_path(spark, "validation")
    is_val = F.pmod(F.col("sent_id"), F.lit(5)) == 0
    CN.write_conll(toks.where(~is_val), tr, sep=" -X- _ ", compression="gzip")
    CN.write_conll(toks.where(is_val), va, sep=" -X- _ ", compression="gzip")
    d = FM.load_splits(spark, {"train": tr, "validation": va, "test": va}, CN.read_conll_strict)
    return d.groupBy("split").agg(F.countDistinct("sent_id").alias("n_sentences"),
                                  F.count(F.lit(1)).alias("n_tokens"))


@register("load_by_extension", """
select case when doc_id % 2 = 0 then 'train' else 'validation' end as split, doc_id, n_chars from documents
""")
def q_load_by_extension(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    csv_p = scratch_path(spark, "train") + ".csv"
    json_p = scratch_path(spark, "validation") + ".json"
    d.where(F.pmod("doc_id", F.lit(2)) == 0).write.option("header", True).csv(csv_p)
    d.where(F.pmod("doc_id", F.lit(2)) == 1).write.json(json_p)
    r = FM.load_by_extension(spark, {"train": csv_p, "validation": json_p}, "doc_id long, n_chars long")
    return r.select("split", "doc_id", "n_chars")


def _overall_sql_for(where: str) -> str:
    return f"""(select n_correct, n_pred, n_gold, {PRF_SQL} from (
  select (select count(*) from g join p using (sent_id, type, start, "end") where {where})::BIGINT as n_correct,
         (select count(*) from p where {where})::BIGINT as n_pred,
         (select count(*) from g where {where})::BIGINT as n_gold))"""


@register("write_metrics", f"""with {TAGGED_SQL},
g as {chunks_sql('tagged', 'gold')},
p as {chunks_sql('tagged', 'pred')}
select 'train' as split, * from {_overall_sql_for('sent_id % 5 <> 0')}
union all select 'eval', * from {_overall_sql_for('sent_id % 5 = 0')}
""")
def q_write_metrics(spark, sf_dir):
    toks = doc_tokens(spark, sf_dir)
    is_val = F.pmod(F.col("sent_id"), F.lit(5)) == 0
    # one pass over the tokens for both splits
    scored = EV.scored_tokens(toks)
    metrics = EV.overall_scores(scored, [F.when(is_val, "eval").otherwise("train").alias("split")]).drop("n_tokens", "accuracy")
    for c in ("precision", "recall", "f1"):
        metrics = metrics.withColumn(c, F.round(c, 6))
    p = scratch_path(spark, "metrics")
    FM.write_metrics(metrics, p)
    back = spark.read.schema("n_correct long, n_pred long, n_gold long, precision double, recall double, "
                             "f1 double, split string").json(p)
    return back.select("split", "n_correct", "n_pred", "n_gold", "precision", "recall", "f1")
