"""The registered queries of the operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import chat, decontamination, jaccard, language, mixing, perplexity, pii, sharding, token_files, toxicity
from shelfscope.llm.repair_queries import REPAIR_SQL, op11_conversation_repair
from shelfscope.llm.spelling_queries import SPELLING_SQL, op12_spelling_variants
from shelfscope.llm.url_queries import URL_SQL, op13_url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from learning; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_chat(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        formatted.withColumn("turns", chat.turns_of(F.col("formatted")))
        .withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(8 + length(regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) + 1
      + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) + 8) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM whole
"""


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in its text; in production the key comes from a secret store."""
    rewritten = pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), b"surrogates of the registered query")
    return rewritten.select("doc_id", "text", F.size("entities").alias("n_entities"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~held_out(F.col("doc_id"))))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that holds benchmark items, with the items and their edit distances."""
    found = decontamination.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("benchmark_items") > 0).select(
        "doc_id",
        F.array_sort(F.col("benchmark_items.item_id")).alias("item_ids"),
        F.array_min(F.col("benchmark_items.distance")).alias("least_distance"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select(
        "doc_id", *perplexity.BASE, "base_failed", "kept", "log_perplexity"
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = utf8(F.col("text"))
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id",
        (F.length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_chat_formatting": (op1_chat_formatting, CHAT_SQL),
    "op2_pii_surrogates": (op2_pii_surrogates, None),
    "op3_jaccard_join": (op3_jaccard_join, None),
    "op4_language_id": (op4_language_id, None),
    "op5_decontamination": (op5_decontamination, None),
    "op6_token_files": (op6_token_files, None),
    "op7_perplexity": (op7_perplexity, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_sharding": (op9_sharding, None),
    "op10_mixing": (op10_mixing, None),
    "op11_conversation_repair": (op11_conversation_repair, REPAIR_SQL),
    "op12_spelling_variants": (op12_spelling_variants, SPELLING_SQL),
    "op13_url_filter": (op13_url_filter, URL_SQL),
}
