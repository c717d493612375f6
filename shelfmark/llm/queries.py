"""The queries of the operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.alignment import alignments
from shelfmark.llm.cotrain import scored
from shelfmark.llm.dart import near_classes
from shelfmark.llm.decontaminate import leaks
from shelfmark.llm.fingerprint import fingerprints
from shelfmark.llm.laesa import codes_sql, vector_codes
from shelfmark.llm.licences import scanned
from shelfmark.llm.packing import packed_sequences
from shelfmark.llm.recurrent import scored as language_scores
from shelfmark.llm.ring import sharded
from shelfmark.llm.secrets import secret_digests, secrets_sql
from shelfmark.llm.substring import without_repeats
from shelfmark.llm.warc import archived
from shelfmark.session import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after every repeated window of 20 words is taken out of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC archives and read back in byte ranges."""
    records = archived(table(spark, sf_dir, "pages"))
    number = lambda c: F.when(F.col(c) != "None", F.col(c)).cast("long")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents`` by both views and together, and whether they stay."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return scored(docs, labels).select("doc_id", "p_text", "p_meta", "p_good", "keep")


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 40 shards whose row counts differ by one at most."""
    rows = sharded(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "home_shard",
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of each of ``documents``, named by its least id."""
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "first")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of ``benchmark`` items in ``documents``, word for word or edited."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of all ``documents`` under word counts and under the recurrent network."""
    return language_scores(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, as a file in a folder tree.

    A tree has folders for each thousand, hundred and ten of ids; ids divisible by ten are the
    licence files of a folder on the level that their last zeros tell.
    """
    n = F.col("doc_id")
    thousand, hundred, ten = (F.floor(n / k).cast("string") for k in (1000, 100, 10))
    path = (
        F.when(n % 1000 == 0, F.concat_ws("/", thousand, F.lit("LICENSE")))
        .when(n % 100 == 0, F.concat_ws("/", thousand, hundred, F.lit("LICENSE")))
        .when(n % 10 == 0, F.concat_ws("/", thousand, hundred, ten, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", thousand, hundred, ten, F.concat(n.cast("string"), F.lit(".txt"))))
    )
    return scanned(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as token pieces in windows of at most 2048 tokens."""
    return packed_sequences(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all ``embeddings`` with their errors."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``."""
    return secret_digests(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers give all ``documents``."""
    return alignments(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup, "op2_warc": op2_warc, "op3_quality": op3_quality,
    "op4_ring_shards": op4_ring_shards, "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination, "op7_recurrent_scores": op7_recurrent_scores, "op8_fingerprints": op8_fingerprints, "op9_licences": op9_licences,
    "op10_packing": op10_packing, "op11_vector_codes": op11_vector_codes, "op12_secret_scan": op12_secret_scan,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op11_vector_codes": codes_sql(), "op12_secret_scan": secrets_sql()}
