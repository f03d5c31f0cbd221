"""Encode texts word by word with a bounded cache in front of a public tokenizer.

The tokenizers used here never merge over the space before a word, so the ids of
a text are the ids of its parts one after another.  Frequent words are then
encoded once per worker instead of once per use.  Texts with characters whose
class two engines might dispute, and texts that hold special strings, go to the
library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np

from loomgraph.functions.shipping import ship_by_value

ship_by_value(__name__)

#: Words kept per worker; the cache is emptied when it is full.
CACHE_WORDS = 400_000
#: Characters handled at a time, so that the words of a very long text are never all in memory.
BLOCK_CHARS = 1 << 20
PART_WORDS = 900_000
#: Longer words are encoded without being kept.
KEPT_CHARS = 64
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
# Code points whose class (letter, digit, space, other) no Unicode version or engine disputes.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ–-…]*")
_LOWER_WORD = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# Lower-case texts that single points and commas part from their words.
_SIMPLE = re.compile(r"(?:[^\W\d_]++|[.,](?![.,])|[ \n\t\r]++)*+")
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def blocks(text: str, limit: int = BLOCK_CHARS) -> Iterator[str]:
    """Parts of about ``limit`` characters, cut before a space between two plain letters.

    No token reaches over such a place.  A text without one is a single block.
    """
    start = 0
    while len(text) - start > limit:
        cut = _CUT.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def chunks(lengths: Iterable[int], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with about ``limit`` characters in total."""
    first, held, row = 0, 0, -1
    for row, length in enumerate(lengths):
        held += length
        if held >= limit:
            yield first, row + 1
            first, held = row + 1, 0
    if first <= row:
        yield first, row + 1


class WordCache(dict):
    """Words and the bytes ``encode_many`` makes of them, at most ``limit`` at a time."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = CACHE_WORDS):
        super().__init__()
        self.encode_many, self.limit = encode_many, limit

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """For every list of words what its words become, one after another."""
        found = [list(map(self.get, words)) for words in lists]
        gaps = []
        for words, got in zip(lists, found, strict=True):
            for _ in range(got.count(None)):
                at = got.index(None, at + 1 if gaps and gaps[-1][0] is got else 0)
                gaps.append((got, at, words[at]))
        missing = list({gap[2] for gap in gaps})
        fresh = dict(zip(missing, self.encode_many(missing), strict=True)) if missing else {}
        if len(self) + len(fresh) > self.limit:
            self.clear()
        self.update((w, b) for w, b in fresh.items() if len(w) <= KEPT_CHARS)
        for got, at, word in gaps:
            got[at] = fresh[word]
        return list(map(b"".join, found))


def _packed(ids: list[int]) -> bytes:
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class JsonTokenizer:
    """A tokenizer file of the ``tokenizers`` library; ids come as little-endian 32-bit words.

    No special ids are added; special strings in a text are handled as the library does by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = self._kind()
        self.cache = WordCache(self._encode_parts if self.kind == "lower" else self._encode_many)
        self.parts = WordCache(self._encode_run, PART_WORDS)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _kind(self) -> str:
        """Whether words are told apart by the space before them, or spaces are dropped and case folded."""
        import json

        shape = json.loads(self.library.to_str())
        normal, pre = shape["normalizer"], shape["pre_tokenizer"] or {}
        if normal is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            return "spaced"
        steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers") or [{}]
        split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern") == {"Regex": split}:
            return "lower"
        return "whole"

    def _encode_many(self, words: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [_packed(e.ids) for e in found]

    def _encode_parts(self, words: list[str]) -> list[bytes]:
        """Through a second cache: a word and the same word with a comma share a part."""
        return self.parts.joined([_LOWER_WORD.findall(w) for w in words])

    def _encode_run(self, parts: list[str]) -> list[bytes]:
        """All parts in one call, told apart by the ids that end a word."""
        ids = np.array(self.library.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if len(ends) != len(parts):
            return self._encode_many(parts)
        data, stops = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _words(self, block: str) -> list[tuple[WordCache, list[str]]] | None:
        """Runs of words in order, each with the cache that has them; none if the library should see the whole."""
        if self.kind == "whole" or not _PLAIN.fullmatch(block) or any(s in block for s in self.specials):
            return None
        if self.kind == "spaced":
            return [(self.cache, _SPACED.findall(block))]
        block = block.lower()
        # A second look, because folding case may leave the plain characters.
        if not _PLAIN.fullmatch(block):
            return None
        runs: list[tuple[WordCache, list[str]]] = []
        for line in [block] if _SIMPLE.fullmatch(block) else block.split("\n"):
            simple = _SIMPLE.fullmatch(line)
            cache, words = (self.parts, line.replace(".", " . ").replace(",", " , ").split()) if simple else (self.cache, line.split())
            if runs and runs[-1][0] is cache:
                runs[-1][1].extend(words)
            else:
                runs.append((cache, words))
        return runs

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text."""
        for first, last in chunks(map(len, texts)):
            cut = [(row, b, self._words(b)) for row in range(first, last) for b in blocks(texts[row])]
            known = {
                id(c): iter(c.joined([words for _, _, runs in cut for own, words in runs or () if own is c]))
                for c in (self.cache, self.parts)
            }
            rows: list[list[bytes]] = [[] for _ in range(first, last)]
            for row, block, runs in cut:
                rows[row - first] += self._encode_many([block]) if runs is None else [next(known[id(own)]) for own, _ in runs]
            yield from map(b"".join, rows)


def worker_once(key: tuple, make: Callable[[], Any]) -> Any:
    """One ``make()`` per Python worker and key, kept for the tasks that follow."""
    kept = sys.modules.setdefault("_loomgraph_worker", type(sys)("_loomgraph_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
