"""The opN_ queries: each applies its operator to its whole table and derives the result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, license_rules, line_dedup, partenum, pfair, phrase_index, prefix_trie, quality, quote_threads, spelling, token_store, toxicity, webp
from .calibrate import held_out
from .common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.threads(table(spark, sf_dir, "conversations")).withColumn("quoted_turns", F.array_join("quoted_turns", ","))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_store.token_digests(token_store.read_tokens(spark, path))


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("kept_sha256"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.interleave(rows).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    webp.store_texts(table(spark, sf_dir, "documents"), path)
    return webp.media_digests(spark.read.schema(webp.STORED).parquet(path))


def op8_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.match_digests(phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "evidence")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_head_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.linked(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quote_threads": op1_quote_threads,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_store": op3_token_store,
    "op4_license_rules": op4_license_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_pfair_mix": op6_pfair_mix,
    "op7_webp": op7_webp,
    "op8_phrase_index": op8_phrase_index,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_partenum_join": op13_partenum_join,
}

ORACLES: dict[str, str] = {
    "op1_quote_threads": quote_threads.ORACLE.replace("coalesce(h.quoted_turns, []) AS", "array_to_string(coalesce(h.quoted_turns, []), ',') AS"),
    "op2_near_duplicates": bagminhash.ORACLE,
    "op4_license_rules": license_rules.oracle(),
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_pfair_mix": pfair.ORACLE,
    "op8_phrase_index": phrase_index.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_partenum_join": partenum.ORACLE,
}
