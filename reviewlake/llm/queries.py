"""The operators over whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlake.llm import (
    align, chat_format, decontaminate, html_text, jaccard_join, language_id, lexical_search, line_dedup, mixing,
    quality_rules, sharding, suffix_dedup, warc,
)
from reviewlake.llm.common import whole

PLANTED = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_sharding(spark, sf_dir):
    shards = sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"))
    text = whole(F.col("text"))
    return shards.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_chat_formatting(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string"
    )
    turns = turns.unionByName(planted).withColumn("parts", chat_format.text_part(F.col("text")))
    read = chat_format.read_back(chat_format.format_chats(turns))
    turn = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    return read.select(
        "conv_id", F.size("texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_quality_rules(spark, sf_dir):
    judged = quality_rules.verdicts(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_words",
    )


def op7_decontamination(spark, sf_dir):
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", "copy", "copies", F.round("rate", 9).alias("rate"), "shuffle_key",
        F.octet_length(whole(F.col("text"))).alias("n_bytes"),
    )


def op10_jaccard_join(spark, sf_dir):
    joined = jaccard_join.components(_table(spark, sf_dir, "documents"), n=3, percent=90)
    return joined.select("doc_id", "n_shingles", "component_id")


def op11_warc_bundles(spark, sf_dir):
    records = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_lexical_search(spark, sf_dir):
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark, sf_dir):
    return align.align_documents(_table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}
