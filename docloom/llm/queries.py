"""The ``opN_<name>`` queries: each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chains, chat, decontaminate, fingerprints, language, packing, quality, secrets, simhash, suffixes
from docloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = secrets.train(secrets.labelled_samples(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), weights)


QUERIES["op6_secrets"] = op6_secrets
ORACLES["op6_secrets"] = secrets.oracle_sql()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


QUERIES["op1_simhash"] = op1_simhash


def public_tokenizer() -> tuple[str, str, str]:
    """Files of the public byte-level BPE vocabulary and its pattern, as installed on every executor."""
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
            public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack(table(spark, sf_dir, "documents"), *public_tokenizer()))


QUERIES["op3_packing"] = op3_packing


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


QUERIES["op4_fingerprints"] = op4_fingerprints


#: A conversation that holds the template's own marks.
PROBE = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(rows.unionByName(probe), tokens=chat.vocabulary_tokens(*public_tokenizer())))


QUERIES["op8_chat"] = op8_chat


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES["op9_language"] = op9_language


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hamming")


QUERIES["op5_decontaminate"] = op5_decontaminate
ORACLES["op5_decontaminate"] = decontaminate.ORACLE_SQL


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


QUERIES["op10_quality"] = op10_quality


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.cleaned(table(spark, sf_dir, "documents")))


QUERIES["op2_suffixes"] = op2_suffixes
ORACLES["op2_suffixes"] = suffixes.ORACLE_SQL


def op7_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(table(spark, sf_dir, "documents"))


QUERIES["op7_chains"] = op7_chains
