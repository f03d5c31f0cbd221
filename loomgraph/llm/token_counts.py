"""Token counts through a cache of digests.

Every text is reduced to the SHA-256 of its UTF-8 bytes (null counts as the empty
text; nothing else may be normalised without changing counts).  Together with the
digest of the tokenizer file that is the key of a stored count.  Only distinct
texts without a stored count are encoded; their counts are appended to the cache,
and all rows take theirs from it by a join.

A copy that many rows share leaves each map task once (``first`` combines there).
Rows that repeat each get their count.  An empty table gives an empty result and
an empty cache.  Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import named, whole_text, written
from loomgraph.llm.word_cache import JsonTokenizer, worker_once

ship_by_value(__name__)

CACHE_SCHEMA = "content_digest string, n_tokens bigint, tokenizer_digest string"


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file: another version never meets counts of this one."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def stored_counts(spark, cache: str, version: str) -> DataFrame:
    """One row per content digest known for this tokenizer; a cache that does not exist is empty."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    else:
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    # Two runs at a time may have appended the same digest; their counts agree.
    return rows.filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """``content_digest, n_tokens`` for rows of ``content_digest, text``."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_once(("json", path), lambda: JsonTokenizer(path))
        for batch in batches:
            counts = [len(ids) // 4 for ids in tokenizer.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content_digest", "n_tokens"])

    return texts.select("content_digest", "text").mapInArrow(stage, "content_digest string, n_tokens bigint")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens`` for every row of ``docs``; ``cache`` is a shared Parquet folder."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    body = whole_text(text)
    # Grouped before the anti-join, so that copies are folded in the task that reads them.
    distinct = docs.groupBy(F.sha2(body, 256).alias("content_digest")).agg(F.first(body).alias("text"))
    misses = distinct.join(stored_counts(spark, cache, version), "content_digest", "left_anti")
    encode_counts(misses, tokenizer).withColumn("tokenizer_digest", F.lit(version)).write.partitionBy("tokenizer_digest").mode("append").parquet(cache)
    rows = docs.select(named(key).alias("key"), F.sha2(body, 256).alias("content_digest"), F.octet_length(body).cast("bigint").alias("n_bytes"))
    # Read from a table of their own, the counts leave the copies of one text free to be split over tasks.
    counted = rows.join(written(stored_counts(spark, cache, version), "known_counts"), "content_digest")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens")
