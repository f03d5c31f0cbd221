"""Substring deduplication by hashing lines, paragraphs or the sentences of lines.

Every text is cut into units, each with the delimiter that ends it.  A unit of at
least ``MIN_WORDS`` words, where each character of a script written without spaces
counts as a word, is normalised (case folded, white space as single spaces)
and digested with 128 bits.  Digests are grouped over all documents; the document
with the smallest key keeps a unit, where it occurs there first, and every other
occurrence is removed.  The removed spans are returned as code point offsets of the
original text, so texts can be rebuilt.

A document sends each of its digests once, and a digest that a third of all
documents share is counted on the map side; its rows are matched by a join that
adaptive execution can split.  Only digests that occur in two documents come back.

Null text is empty.  Rows with equal keys rank as one document: none of them loses a
unit to another of them, repeats inside a text excepted.  A null key ranks last.  An
empty table gives an empty result.  The other columns stay as they are.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import as_row, named, written
from loomgraph.llm.word_cache import chunks

ship_by_value(__name__)

MIN_WORDS = 6
#: What ends a unit; its match belongs to the unit.
DELIMITERS = {"line": r"\n", "paragraph": r"\n[^\S\n]*\n\s*", "sentence": r"[.!?] |[。！？｡]|\n"}
#: A character of a script written without spaces (Thai, Lao, Burmese, Khmer, kana, Han), or a run of others.
_WORDS = re.compile(
    "[{0}]|[^\\s{0}]+".format("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
)
BATCH_CHARS = 2 << 20


def cut_units(text: str, ends: re.Pattern) -> Iterator[tuple[int, int]]:
    """Start and end of every unit."""
    start = 0
    for found in ends.finditer(text):
        yield start, found.end()
        start = found.end()
    if start < len(text):
        yield start, len(text)


def unit_digests(text: str, ends: re.Pattern, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and digest of the units with enough words."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for start, end in cut_units(text, ends):
        words = text[start:end].lower().split()
        if len(words) >= min_words or words and not text[start:end].isascii() and len(_WORDS.findall(text[start:end])) >= min_words:
            yield start, end, digest(" ".join(words).encode("utf-8", "surrogatepass"))


def _digest_rows(docs: DataFrame, key: str, text: str, unit: str, min_words: int) -> DataFrame:
    """``h1, h2, key``: each digest of a text once."""
    pattern = DELIMITERS[unit]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = re.compile(pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in chunks((len(t or "") for t in texts), BATCH_CHARS):
                sets = [dict.fromkeys(d for _, _, d in unit_digests(t or "", ends, min_words)) for t in texts[first:last]]
                words = np.frombuffer(b"".join(d for found in sets for d in found), "<i8").reshape(-1, 2)
                counts = np.array([len(found) for found in sets])
                keys = batch.column(0).slice(first, last - first).take(pa.array(np.repeat(np.arange(len(sets)), counts)))
                yield pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1]), keys], names=["h1", "h2", "key"])

    schema = f"h1 bigint, h2 bigint, key {docs.schema[key].dataType.simpleString()}"
    return docs.select(named(key).alias("key"), named(text).cast("string").alias("text")).mapInArrow(stage, schema)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS, removed: str = "removed",
) -> DataFrame:
    """``docs`` with repeated units gone from ``text``, and a column ``removed`` of the spans ``start, end``."""
    if removed in docs.columns:
        raise ValueError(f"the input has a column {removed}; name another one")
    rows = _digest_rows(docs, key, text, unit, min_words)
    keepers = rows.groupBy("h1", "h2").agg(F.min("key").alias("first_key"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written, as a join with a plain table can split the rows of a unit that very many documents hold.
    keepers = written(keepers, "kept_units")
    gone = rows.join(keepers, ["h1", "h2"]).filter(~F.col("key").eqNullSafe(F.col("first_key")))
    lost = gone.groupBy("key").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    rows = docs.select(as_row(docs), named(text).cast("string").alias("body"), named(key).alias("key"))
    met = rows.join(lost, rows["key"].eqNullSafe(lost["key"]), "left").select("row", "body", "gone")
    pattern = DELIMITERS[unit]
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([met.schema["row"], T.StructField("body", T.StringType()), T.StructField("cuts", spans)])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = re.compile(pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in chunks((len(t or "") for t in texts), BATCH_CHARS):
                kept, cuts = [], []
                part = batch.slice(first, last - first)
                for body, gone in zip(texts[first:last], part.column(2).to_pylist(), strict=True):
                    lost, seen, out, spans, at = {(g["h1"], g["h2"]) for g in gone or ()}, set(), [], [], 0
                    for start, end, digest in unit_digests(body or "", ends, min_words):
                        if digest in seen or struct.unpack("<qq", digest) in lost:
                            out.append(body[at:start])
                            spans.append({"start": start, "end": end})
                            at = end
                        seen.add(digest)
                    kept.append(body if not spans else "".join([*out, body[at:]]))
                    cuts.append(spans)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(cuts, span_type)], names=["row", "body", "cuts"])

    found = met.mapInArrow(stage, schema)
    return found.select(*[(F.col("body") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns], F.col("cuts").alias(removed))
