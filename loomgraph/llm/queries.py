"""The operators of this subpackage over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import (
    bag_minhash, chat_snapshots, lexical_blas, license_scan, merkle_log, packing, piece_offsets, posting_ann, quality_mcd, sql_twins, suffix_buckets,
    token_counts, unit_dedup, warc_zstd,
)
from loomgraph.llm.shared import scratch_folder, table, tokenizer_path

QUERIES, SQL = {}, {}


def register(fn, sql: str | None = None):
    QUERIES[fn.__name__] = fn
    if sql is not None:
        SQL[fn.__name__] = sql
    return fn


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the robust estimates for every document."""
    judged = quality_mcd.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", *quality_mcd.COUNTS, "base_failed", "kept")


register(op2_quality_outliers, sql_twins.quality_sql())


@register
def op4_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their decoding, as digests."""
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = piece_offsets.encode_pieces(table(spark, sf_dir, "documents"), model, decode=True)
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens for the pieces of every document."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document through a cache of its own, empty at the start."""
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), scratch_folder(spark, "token_counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (d)"""


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back from them."""
    folder = scratch_folder(spark, "warc")
    warc_zstd.archive_pages(table(spark, sf_dir, "pages"), folder)
    return warc_zstd.page_records(spark, folder)


register(op8_warc_zstd, _WARC_SQL)


@register
def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20."""
    return posting_ann.nearest(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)


_UNITS_SQL = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?:[^\n.!?]|[.!?]+[^\n.!? ])*(?:[.!?]+ |[.!?]*\n|[.!?]*$)') AS us FROM documents),
u AS (SELECT doc_id, unnest(us) AS u, unnest(generate_series(1, len(us))) AS i FROM cut),
n AS (SELECT *, lower(trim(regexp_replace(u, '\s+', ' ', 'g'))) AS k, sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u WHERE u <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place, len(string_split(k, ' ')) AS words FROM n),
m AS (SELECT *, words >= 6 AND place > 1 AS gone FROM r),
a AS (SELECT doc_id, string_agg(u, '' ORDER BY i) FILTER (NOT gone) AS kept,
  string_agg((e - length(u)) || ':' || e, ',' ORDER BY i) FILTER (gone) AS spans, count(*) FILTER (gone) AS n FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(kept, '') AS text, coalesce(n, 0) AS n_removed, coalesce(spans, '') AS removed_spans FROM documents LEFT JOIN a USING (doc_id)"""


def op10_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that an earlier document, or itself before, holds."""
    found = unit_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size("removed").cast("bigint").alias("n_removed"), F.array_join(span, ",").alias("removed_spans"))


register(op10_unit_dedup, _UNITS_SQL)


@register
def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


_SNAPSHOT_SQL = """
WITH c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn, role, text) AS l,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(len(l) AS BIGINT) AS n_turns, t AS text FROM c AS a
WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.l[1] = a.l[1] AND (len(b.l) > len(a.l) AND b.l[1:len(a.l)] = a.l OR b.l = a.l AND b.conv_id < a.conv_id))"""


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that are no prefix of another, rendered."""
    return chat_snapshots.collapse(table(spark, sf_dir, "conversations"))


register(op9_chat_snapshots, _SNAPSHOT_SQL)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences whose notices each document holds."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


register(op1_license_scan, sql_twins.license_sql())


def op11_merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, and what it gives for texts of which some have lost their line ends."""
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proofs, _ = merkle_log.manifest(docs, changed)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle_log.proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


register(op11_merkle_log, sql_twins.merkle_sql())


def op12_lexical_blas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents with the highest scores for every benchmark item."""
    return lexical_blas.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


register(op12_lexical_blas, sql_twins.lexical_sql())


@register
def op13_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start anywhere else too."""
    found = suffix_buckets.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "row.doc_id", (F.length("kept") + lost).cast("bigint").alias("n_bytes"), lost.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
