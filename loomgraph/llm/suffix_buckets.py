"""Suffix-array dedup by bucket-pointer refinement.

Every byte that a string of ``LENGTH`` bytes covers goes, if that string starts anywhere else
too.  So the suffixes need not be sorted to the end: suffixes that agree on ``LENGTH`` bytes
share a bucket, and a bucket with one suffix is final.

* Initial buckets.  The bucket of a place is the identifier of its ``GRAM`` bytes, a 64-bit hash.
  Identifiers are refined by those of later offsets, each result being reused in the next
  round: bytes give those of 2 bytes, these of 4, and so on up to the gram and to ``LENGTH``.
  That needs no sort, as equal strings get equal identifiers everywhere.  A
  string of ``LENGTH`` bytes is represented by one place in it, the first with the smallest gram identifier,
  its anchor; equal strings have theirs at the same offset.  So only anchors, one in
  some 80 places, are put in buckets and sorted over the cluster; a bucket of one
  anchor is final, and all strings that it represents are unique.
* First refinement.  The anchors left are sorted by the identifiers of the bytes before and behind them, as
  far as the strings reach that an anchor represents (its stretch).  Equal stretches are one
  sub-bucket: with two members or more, all their strings repeat.  A bucket that is one
  sub-bucket is done.
* Second refinement.  Where a bucket holds different stretches, one member of each is cut into pieces of
  ``PIECE`` strings at fixed offsets from the anchor.  The bytes that all strings of such a
  piece hold, its core, refine the bucket; a core of one piece is final, equal pieces repeat.
* Third refinement.  Where a core has different pieces, their strings are compared by anchor, offset and
  identifier.  What two pieces hold repeats.

Buckets are counted on the map side, and rows meet written tables of buckets in joins that
adaptive execution can split, so a passage in a third of all texts costs one row a text.  Texts
are told apart by 128 bits; equal texts have equal results.  Within a gram's bucket 64 bits tell strings apart.

Null text is empty; texts shorter than ``LENGTH`` bytes lose nothing.  Rows that repeat are texts
each, so all their strings repeat.  Very long texts are hashed in overlapping parts.  An empty table gives an empty
result.  The other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import as_row, forget, whole_text, written

ship_by_value(__name__)

#: Bytes of a string that may not occur twice.
LENGTH = 200
#: Bytes of an anchor's gram; every string of LENGTH bytes holds LENGTH - GRAM + 1 of them.
GRAM = 40
#: Strings of a piece in the second refinement.
PIECE = 16
#: Bytes hashed at a time.
PART_BYTES = 1 << 18
#: Up to this number of bucket or text keys (at most 24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 18

_U = np.uint64
_PLACE = _U((1 << 20) - 1)


def _of_bytes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_IDS = _of_bytes()


def refined(one: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The identifier of a string from that of its start and that of a later offset."""
    x = one * _U(0xD6E8FEB86659FD93) + later
    x ^= x >> _U(32)
    x *= _U(0x9FB21C651E98DF25)
    x ^= x >> _U(29)
    return x


def identifiers(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Identifiers of all strings of these lengths (ascending) in ``data``, by their starts."""
    ids = {1: BYTE_IDS[data]}
    size = 1
    while size * 2 <= max(lengths):
        ids[size * 2] = refined(ids[size][:-size] if len(ids[size]) > size else ids[size][:0], ids[size][size:])
        size *= 2
    out = {}
    for length in lengths:
        if length not in ids:
            # The largest power of two, then the rest by its own powers.
            done = 1 << (length.bit_length() - 1)
            found = ids[done]
            while done < length:
                step = 1 << ((length - done).bit_length() - 1)
                many = max(0, len(data) - done - step + 1)
                found = refined(found[:many], ids[step][done : done + many])
                done += step
            ids[length] = found
        out[length] = ids[length]
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, *more: int):
    """``at, low, high`` of the anchors in texts that end at ``ends`` in ``data``, and identifiers by length.

    ``low`` and ``high`` are the first and last start of the strings that an anchor represents.
    """
    ids = identifiers(data, (gram, *more, length))
    grams, strings = ids[gram], ids[length]
    many = len(strings)
    none = np.zeros(0, np.int64)
    if not many:
        return none, none, none, ids
    # The smallest identifier with its place; the leftmost of equal ones.
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    anchor = (least & _PLACE).astype(np.int64)
    start = np.arange(many)
    inside = ends[np.searchsorted(ends, start, side="right")] - start >= length
    cut = np.ones(many, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    # Texts follow each other: where one ends, no string is inside, so runs end there too.
    first = np.flatnonzero(cut)
    last = np.append(first[1:], many) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    return anchor[first], first, last, ids


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def _parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of ``row, start, end`` of about PART_BYTES together; long texts in overlapping parts."""
    held, size = [], 0
    for row, text in enumerate(texts):
        start = 0
        while len(text) - start >= length:
            end = min(len(text), start + PART_BYTES + length - 1)
            held.append((row, start, end))
            size += end - start
            if size >= PART_BYTES:
                yield held
                held, size = [], 0
            if end == len(text):
                break
            start = end - length + 1
    if held:
        yield held


def _hashed(texts: list[bytes], length: int, gram: int, *more: int):
    """For each list of parts: row and base of every anchor, with ``anchors`` of the parts."""
    for parts in _parts(texts, length):
        data = np.frombuffer(b"".join(texts[row][start:end] for row, start, end in parts), np.uint8)
        sizes = np.array([end - start for _, start, end in parts])
        ends = np.cumsum(sizes)
        at, low, high, ids = anchors(data, ends, length, gram, *more)
        part = np.searchsorted(ends, low, side="right")
        rows = np.array([row for row, _, _ in parts])[part]
        # From a place in the data to one in the text.
        shift = (np.array([start for _, start, _ in parts]) - (ends - sizes))[part]
        yield rows, shift, at, low, high, ids


def anchor_rows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``t1, t2, a``: the anchors of every text with its gram and stretch identifiers."""
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("g", pa.int64()), ("v", pa.int64())]))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                bodies = part.column(2).to_pylist()
                found = []
                for rows, shift, at, low, high, ids in _hashed(bodies, length, gram):
                    grams, strings = ids[gram], ids[length]
                    stretch = refined(refined(strings[low], strings[high]), ((at - low) * 4096 + (high - at)).astype(np.uint64))
                    found.append((rows, low + shift, high + shift, grams[at].view(np.int64), stretch.view(np.int64)))
                columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
                offsets = np.searchsorted(columns[0], np.arange(part.num_rows + 1)).astype(np.int32)
                inner = [columns[n].astype(np.int32) for n in (1, 2)] + list(columns[3:])
                struct = pa.StructArray.from_arrays([pa.array(c) for c in inner], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), struct)], names=["t1", "t2", "a"])

    return texts.select("t1", "t2", "body").mapInArrow(
        stage, "t1 bigint, t2 bigint, a array<struct<low: int, high: int, g: bigint, v: bigint>>"
    )


def piece_rows(wanted: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``g, k, core, v, t1, t2, off, p, ws``: the pieces of stretches with the identifiers of their strings.

    ``off`` is the anchor's offset in the first string, ``p`` that string's start; ``wanted``:
    ``t1, t2, body, stretches``, texts with the first starts of the stretches to send.
    """

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                starts = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), starts.value_lengths().to_numpy())
                sent = owner << 32 | starts.flatten().to_numpy().astype(np.int64)
                for rows, shift, at, low, high, ids in _hashed(part.column(2).to_pylist(), length, gram, length - PIECE + 1):
                    send = np.isin(rows << 32 | (low + shift), sent)
                    if not send.any():
                        continue
                    rows, shift, at, low, high = (x[send] for x in (rows, shift, at, low, high))
                    grams, strings, cores = ids[gram], ids[length], ids[length - PIECE + 1]
                    least, most = (at - high) // PIECE, (at - low) // PIECE
                    many = most - least + 1
                    k = np.repeat(least, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    at, low, high, row, base = (np.repeat(x, many) for x in (at, low, high, rows, shift))
                    core = at - k * PIECE
                    one, last = np.maximum(low, core - PIECE + 1), np.minimum(high, core)
                    size = last - one + 1
                    places = np.repeat(one, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    v = refined(refined(strings[one], strings[last]), ((at - one) * 4096 + size).astype(np.uint64))
                    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(grams[at].view(np.int64)), pa.array(k.astype(np.int32)), pa.array(cores[core].view(np.int64)), pa.array(v.view(np.int64)),
                        part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array((at - one).astype(np.int32)),
                        pa.array((one + base).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(strings[places].view(np.int64))),
                    ], names=["g", "k", "core", "v", "t1", "t2", "off", "p", "ws"])

    return wanted.select("t1", "t2", "body", "stretches").mapInArrow(
        stage, "g bigint, k int, core bigint, v bigint, t1 bigint, t2 bigint, off int, p int, ws array<bigint>"
    )


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in the written table ``keys``."""
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, keys.columns, "left_semi")


def repeated_starts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``t1, t2, starts``: ranges ``low, high`` of starts of strings that start anywhere else too.

    ``texts``: ``t1, t2, body``, a row for every text.
    """

    def several(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return written(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), name)

    rows = written(anchor_rows(texts, length, gram), "suffix_anchors")
    # Initial buckets: only those of two anchors or more stay open.
    grams = several(rows.select(F.explode("a.g").alias("g")), ["g"], "suffix_buckets")
    flat = rows.select("t1", "t2", F.explode("a").alias("a")).select("t1", "t2", "a.low", "a.high", "a.g", "a.v")
    shared = written(_with_keys(flat, grams), "suffix_shared")
    forget(rows, grams)
    # First refinement, by stretches.
    stretch = shared.groupBy("g", "v").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "low")).alias("first"))
    stretch = written(stretch, "suffix_stretches")
    full = shared.join(stretch.filter("n > 1").select("g", "v"), ["g", "v"], "left_semi").select("t1", "t2", "low", "high")
    full = written(full.groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("starts")), "suffix_starts1")
    # Second refinement: buckets of several stretches, by the cores of pieces.
    opened = _with_keys(stretch, several(stretch, ["g"], "suffix_mixed")).select("first.*")
    opened = written(opened.groupBy("t1", "t2").agg(F.collect_set("low").alias("stretches")), "suffix_open")
    forget(shared, stretch)
    keys = written(opened.select("t1", "t2"), "suffix_texts")
    bodies = _with_keys(texts, keys).groupBy("t1", "t2").agg(F.first("body").alias("body"))
    pieces = written(piece_rows(bodies.join(opened, ["t1", "t2"]), length, gram), "suffix_pieces")
    kinds = written(pieces.groupBy("g", "k", "core", "v").agg(F.count("*").alias("n")), "suffix_cores")
    equal = pieces.select("g", "k", "core", "v", "t1", "t2", "p", F.size("ws").alias("size"))
    equal = equal.join(kinds.filter("n > 1").select("g", "k", "core", "v"), ["g", "k", "core", "v"], "left_semi")
    # Third refinement: cores of several pieces, by strings.  A piece holds a string once, so two rows are two pieces.
    mixed = _with_keys(pieces.select("g", "k", "core", "t1", "t2", "off", "p", "ws"), several(kinds, ["g", "k", "core"], "suffix_mixed_cores"))
    strings = mixed.select("g", "t1", "t2", "off", "p", F.posexplode("ws").alias("i", "w"))
    strings = written(strings.select("g", (F.col("off") - F.col("i")).alias("off"), "w", "t1", "t2", (F.col("p") + F.col("i")).alias("p")), "suffix_strings")
    points = _with_keys(strings, several(strings, ["g", "off", "w"], "suffix_twice"))
    rest = equal.select("t1", "t2", F.col("p").alias("low"), (F.col("p") + F.col("size") - 1).alias("high")).unionByName(
        points.select("t1", "t2", F.col("p").alias("low"), F.col("p").alias("high"))
    )
    rest = written(rest.groupBy("t1", "t2").agg(F.collect_set(F.struct("low", "high")).alias("starts")), "suffix_starts2")
    forget(pieces, kinds, strings)
    found = written(full.unionByName(rest).groupBy("t1", "t2").agg(F.flatten(F.collect_list("starts")).alias("starts")), "suffix_starts")
    forget(full, rest)
    return found


def remove_repeats(docs: DataFrame, text: str = "text", removed: str = "removed", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``row`` (the given columns), ``kept`` (bytes left) and ``removed``: spans ``start, end`` of bytes."""
    body = whole_text(text).cast("binary")
    texts = docs.select(*text_key(body), body.alias("body"))
    found = repeated_starts(texts.filter(F.length("body") >= length), length, gram)
    met = docs.select(as_row(docs), body.alias("body"), *text_key(body)).join(found, ["t1", "t2"], "left").select("row", "body", "starts")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([
        met.schema["row"], T.StructField("kept", T.BinaryType()),
        T.StructField(removed, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])

    def merged(starts: pa.ListScalar) -> list[tuple[int, int]]:
        if not starts.is_valid:
            return []
        low, high = (starts.values.field(n).to_numpy().astype(np.int64) for n in (0, 1))
        order = np.argsort(low, kind="stable")
        low, end = low[order], np.maximum.accumulate(high[order] + length)
        new = np.flatnonzero(np.concatenate([[True], low[1:] > end[:-1]]))
        return list(zip(low[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                kept, gone = [], []
                for n, whole in enumerate(part.column(1).to_pylist()):
                    spans = merged(part.column(2)[n])
                    out, at = [], 0
                    for start, end in spans:
                        out.append(whole[at:start])
                        at = end
                    kept.append(b"".join([*out, whole[at:]]) if spans else whole)
                    gone.append([{"start": start, "end": end} for start, end in spans])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(gone, span)], names=["row", "kept", removed])

    return met.mapInArrow(stage, schema)
