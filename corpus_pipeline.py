"""The corpus pipeline: rules, line dedup, near-dedup, mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  A stage's result is written before the next one
starts, which deletes what the stages before it have stashed.

Defined results, for every stage: an empty table gives no rows; other columns but those
whose names begin with ``__tv_`` pass through; repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common, line_dedup, minhash, mixing, quality_rules, sp_wfst
from terravane.llm.queries import PIECES, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their language's perplexity band reject go.

    A null or empty text fails the rules; a null language has a band of its own.
    """
    common.drop_tables(spark)
    return quality_rules.judge(docs).where("__tv_rules.kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated chunks of lines leave the texts; n_chars follows.

    A document that this leaves without a word is a copy of others and goes; one
    without a word before stays.
    """
    common.drop_tables(spark)
    out = line_dedup.dedup_line_chunks(docs)
    out = out.where((F.col("__tv_lines.n_removed_lines") == 0) | F.regexp_like("__tv_lines.text", F.lit(line_dedup.WORD)))
    new = {"text": F.col("__tv_lines.text"), "n_chars": F.length("__tv_lines.text").cast("long")}
    changed = F.col("__tv_lines.n_removed_lines") > 0
    return out.select(*(F.when(changed, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id; null and blank texts are in no group."""
    common.drop_tables(spark)
    return minhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document appears once for each time it is taken.

    A null or blank text counts no words; a null source is a source of its own.
    """
    common.drop_tables(spark)
    return mixing.mix_sources(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``token_ids``; a null or empty text has none."""
    common.drop_tables(spark)
    return sp_wfst.encode_documents(docs, PIECES)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", minhash_stage),
    ("mixing", mixing_stage),
    ("SentencePiece", encoding_stage),
]

#: The perplexity model, the near-duplicate search and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "-").lower(), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
