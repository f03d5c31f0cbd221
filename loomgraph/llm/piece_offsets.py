"""SentencePiece encoding that keeps, for every piece, the source bytes it stands for.

A text is first normalised here: at every position the longest entry of the
model's compiled character map that starts there is replaced, anything else is
copied, and for every normalised byte the source byte it came from is kept.  The
normalised text is encoded by the same model with its own normalisation switched
off, and the pieces' lengths are projected through the alignment to byte spans of
the source.  The ids equal those of the library on the source text.

Null text is the empty text, which has no pieces.  Repeated rows are encoded like
any other; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.shipping import ship_by_value
from loomgraph.llm.shared import whole_text
from loomgraph.llm.word_cache import WordCache, blocks, chunks, worker_once

ship_by_value(__name__)

SPACE = "▁"
#: Characters of source text per Arrow batch of results.
BATCH_CHARS = 1 << 20
_SPACED = re.compile(" +[^ ]*")
_BPE, _USER_DEFINED, _BYTE = 2, 4, 6


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys and their replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if size else ()
        self.texts = compiled[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key at ``at`` and the key's length."""
        units, found, length = self.units, None, 0
        if not units:
            return None
        unit = units[0]
        place = (unit >> 10) << ((unit & 0x200) >> 6)
        for step in range(at, len(source)):
            label = source[step]
            if not label:
                break
            place ^= label
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != label:
                break
            place ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found, length = units[place] & 0x7FFFFFFF, step + 1 - at
        if found is None:
            return None
        return self.texts[found : self.texts.index(b"\0", found)], length


def _char_bytes(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def normalise(text: str, charmap: CharacterMap, spec) -> tuple[bytes, list[int]]:
    """The normalised bytes, and for each of them and the end the source byte it starts at."""
    source, out, origin = text.encode(), bytearray(), []
    mark = SPACE.encode() if spec.escape_whitespaces else b" "

    def units() -> Iterator[tuple[bytes, int, int]]:
        at = 0
        while at < len(source):
            got = charmap.longest(source, at)
            if got is None:
                width = _char_bytes(source[at])
                got = source[at : at + width], width
            yield got[0], at, at + got[1]
            at += got[1]

    def add(piece: bytes, at: int) -> None:
        piece = piece.replace(b" ", mark)
        out.extend(piece)
        origin.extend([at] * len(piece))

    trim = spec.remove_extra_whitespaces
    after_space, started, end = trim, False, 0
    for piece, at, after in units():
        if not started:
            # Leading spaces fall away before the mark that stands for the start of the text.
            if trim and piece == b" ":
                end = after
                continue
            started = True
            if spec.add_dummy_prefix:
                add(b" ", at)
        if after_space:
            piece = piece.lstrip(b" ")
        if piece:
            add(piece, at)
            after_space = trim and piece.endswith(b" ")
        elif not trim:
            after_space = False
        end = after
    if trim:
        while out.endswith(mark):
            end = origin[len(out) - len(mark)]
            del out[len(out) - len(mark) :], origin[len(origin) - len(mark) :]
    return bytes(out), [*origin, end]


class PieceEncoder:
    """One model: ids and source byte spans of texts, and texts of ids."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            raw = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        self.spec = sentencepiece_model_pb2.NormalizerSpec()
        self.spec.CopyFrom(proto.normalizer_spec)
        self.charmap = CharacterMap(self.spec.precompiled_charsmap)
        plain = proto.normalizer_spec
        plain.Clear()
        plain.name, plain.add_dummy_prefix, plain.remove_extra_whitespaces = "identity", False, False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = [(p.piece, p.type) for p in proto.pieces]
        self.is_byte = np.array([kind == _BYTE for _, kind in pieces])
        self.width = np.array([1 if kind == _BYTE else len(p.encode()) for p, kind in pieces], np.int64)
        # In the source the mark of a space is one byte.
        self.source_width = self.width - 2 * np.array([0 if kind == _BYTE else p.count(SPACE) for p, kind in pieces])
        spec, trainer = self.spec, proto.trainer_spec
        self.by_word = (
            not self.charmap.units and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
            and not trainer.treat_whitespace_as_suffix and trainer.byte_fallback and trainer.model_type == _BPE
            and not any(kind == _USER_DEFINED or SPACE in p.lstrip(SPACE) for p, kind in pieces)
        )
        self.cache = WordCache(self._encode_words)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        marked = [SPACE + w.replace(" ", SPACE) for w in words]
        return [np.array(ids, "<i4").tobytes() for ids in self.inner.encode(marked, num_threads=1)]

    def _words(self, block: str) -> list[str]:
        """The words of a block that starts with a space, each without its first space.

        No piece of such a model holds a space after anything else, so none reaches from a word to the next.
        """
        if "  " in block or block.endswith(" "):
            return [w[1:] for w in _SPACED.findall(block)]
        return block[1:].split(" ")

    def _aligned(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        normal, origin = normalise(text, self.charmap, self.spec)
        if not normal:
            return np.zeros(0, "<i4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        body = normal.decode("utf-8", "replace")
        ids = np.array(self.inner.encode(body), "<i4")
        surfaces = self.inner.encode(body, out_type=str)
        width = [1 if self.is_byte[i] else len(s.encode()) for i, s in zip(ids, surfaces, strict=True)]
        ends, where = np.cumsum(width, dtype=np.int64), np.array(origin, np.int64)
        return ids, where[ends - width], where[ends]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``ids, starts, ends`` of every text."""
        for first, last in chunks(map(len, texts)):
            part = texts[first:last]
            simple = [self.by_word and bool(t) and SPACE not in t for t in part]
            parts = [(row, b) for row, t in enumerate(part) if simple[row] for b in blocks(" " + t)]
            rows: list[list[bytes]] = [[] for _ in part]
            for (row, _), ids in zip(parts, self.cache.joined([self._words(b) for _, b in parts]), strict=True):
                rows[row].append(ids)
            for row, text in enumerate(part):
                if not simple[row]:
                    yield self._aligned(text)
                    continue
                ids = np.frombuffer(b"".join(rows[row]), "<i4")
                ends = np.cumsum(self.source_width[ids]) - 1
                starts = np.zeros_like(ends)
                starts[1:] = ends[:-1]
                yield ids, starts, ends


def _list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat).cast(kind))


def encode_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", offsets: bool = True, decode: bool = False) -> DataFrame:
    """``key, ids`` of every row, with ``offsets`` the source bytes ``starts, ends`` of every piece, with ``decode`` the ids' text."""
    names = [key, "ids", *["starts", "ends"] * offsets, *["decoded"] * decode]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_once(("pieces", model), lambda: PieceEncoder(model))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in chunks(map(len, texts), BATCH_CHARS):
                found = list(encoder.encode(texts[first:last]))
                columns = [batch.column(0).slice(first, last - first), _list_column([f[0] for f in found], pa.int32())]
                if offsets:
                    columns += [_list_column([f[n] for f in found], pa.int64()) for n in (1, 2)]
                if decode:
                    columns.append(pa.array([encoder.library.decode(f[0].tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>"
    schema += ", starts array<bigint>, ends array<bigint>" * offsets + ", decoded string" * decode
    return docs.select(F.col(key), whole_text(text).alias("text")).mapInArrow(stage, schema)


def decode_pieces(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """``key, ids, decoded``: what the model makes of the ids; null ids decode as none."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = worker_once(("pieces", model), lambda: PieceEncoder(model)).library
        for batch in batches:
            ids = batch.column(1)
            lengths = [len(x) if x.is_valid else 0 for x in ids]
            for first, last in chunks(lengths, BATCH_CHARS // 4):
                texts = [library.decode(ids[row].values.tolist() if ids[row].is_valid else []) for row in range(first, last)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[key, "ids", "decoded"])

    schema = f"`{key}` {encoded.schema[key].dataType.simpleString()}, ids array<int>, decoded string"
    return encoded.select(key, "ids").mapInArrow(stage, schema)
