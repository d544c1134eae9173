"""The thin queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workloom.llm import decontaminate, divergence, langid, licenses, mixing, ngram_join, quality, secrets, sharding, spelling, token_counts, token_records, warc
from workloom.llm.runtime import documents, table


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def frequent_words(path: str, most: int = 2000) -> list[str]:
    """The first words of 4 to 10 small letters in a vocabulary by rank."""
    from tokenizers import Tokenizer

    ranked = sorted(Tokenizer.from_file(path).get_vocab().items(), key=lambda kv: kv[1])
    return [w[1:] for w, _ in ranked if w[:1] == "Ġ" and re.fullmatch("[a-z]{4,10}", w[1:])][:most]


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 40)


def op2_pigeonhole_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op4_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(documents(spark, sf_dir))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "source AS path")
    return secrets.secrets(docs, dictionary=(*secrets.DICTIONARY, *frequent_words(tokenizer_file("byte_bpe_50k.json"))))


def op6_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, mixing.label_weights(table(spark, sf_dir, "labels"))).drop("source")


def op11_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run in globals().items() if name.startswith("op") and callable(run)}


def oracles() -> dict[str, str]:
    return {
        "op4_token_group_join": ngram_join.ORACLE_SQL,
        "op7_quality_rules": quality.ORACLE_SQL,
        "op8_license_diagonals": licenses.ORACLE_SQL,
        "op10_source_mix": mixing.oracle_sql(),
        "op11_content_addressed_warc": warc.ORACLE_SQL,
        "op12_spelling_variants": spelling.ORACLE_SQL,
        "op13_source_divergence": divergence.ORACLE_SQL,
    }
