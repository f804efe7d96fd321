"""From raw documents to token files: quality, near-duplicates, benchmark passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents; the mix stage fixes the order in which its files hold the rows,
and the token stage encodes them in that order.

Defined results: a null text is empty, in every stage; texts of any length are read whole. Without labels of both classes nothing is rejected.
Of texts with equal word shingles one row stays, the one with the least doc_id (of equal ids, the first by a hash of the row); rows without a doc_id
all stay in that stage. Rows that share a doc_id are judged by their own text in every stage, and each is a row of the token files. A null source is a
source of its own. Empty tables give empty results. Other columns, whatever their names, go through to the mix stage unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atlasforge.llm import bagminhash, pfair, phrase_index, quality, token_store
from atlasforge.llm.common import materialize, scratch_path
from atlasforge.llm.queries import table, tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrase_index.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair.in_mixed_order(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pipeline-tokens")
    token_store.write_tokens(docs, path, tokenizer_file(), order=token_store.file_order(docs))
    return token_store.token_digests(token_store.read_tokens(spark, path))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: Models, signatures, the schedule and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
