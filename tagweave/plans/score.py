"""Composed jobs: score a predicted CoNLL file against a gold CoNLL file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators.evaluate import overall_scores, scored_tokens
from tagweave.sources.conll import strict_sentences


def evaluate_files(spark: SparkSession, gold_path: str, pred_path: str, sep: str = "\t") -> DataFrame:
    """Read both files (strict dialect, but with the last block kept even if no
    blank line closes it, so every token is scored), require the same token on every
    line, and return the micro scores plus token accuracy.  Both files are
    numbered by the same file-order rule; their sentences meet as whole rows, by
    one join on the sentence id: their tokens are compared as one text, their
    tags are scored in the row.  A missing sentence or a
    different token raises inside that same pass (no separate checking job)."""
    def side(path: str, words: str, tags: str) -> DataFrame:
        return strict_sentences(spark, path, sep, keep_last=True).select("sent_id", F.col("tokens").alias(words), F.col("tags").alias(tags))

    both = side(gold_path, "__gw", "gold").join(side(pred_path, "__pw", "pred"), "sent_id", "full")
    # lines hold no newline, so equal texts are equal tokens
    lines = lambda c: F.coalesce(F.split(c, "\n", -1), F.array().cast("array<string>"))
    differs = F.zip_with(lines("__gw"), lines("__pw"), lambda g, p: ~g.eqNullSafe(p))
    failed = F.raise_error(F.concat(F.lit("token mismatch at sentence "), F.col("sent_id").cast("string"), F.lit(" position "),
                                    (F.array_position(differs, True) - 1).cast("string"))).cast("string")
    gold = F.when(F.col("__gw").eqNullSafe(F.col("__pw")), F.col("gold")).otherwise(failed)
    checked = both.select("sent_id", gold.alias("gold"), "pred")
    tags = checked.where("gold is not null").select("sent_id", F.split("gold", "\n", -1).alias("gold"), F.split("pred", "\n", -1).alias("pred"))
    return overall_scores(scored_tokens(tags, "gold", "pred", "sent_id"))
