import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import packing, piece_offsets, token_counts, word_cache
from loomgraph.llm.shared import scratch_folder, tokenizer_path, written

ALPHABET = list("aB  c\n\t'sré5²ß½_.,<|>İ▁🙂\x85\x1c世") + ["<|endoftext|>", "don't", "'ll", "  ", "ﬁ", "Ａ"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return [None, "", " ", "x" * 5000, "the cat sat " * 3000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_give_the_ids_of_the_library(name):
    tokenizer = word_cache.JsonTokenizer(tokenizer_path(name))
    texts = [t or "" for t in random_texts(3000)]
    assert list(tokenizer.encode(texts)) == tokenizer._encode_many(texts)


def test_blocks_and_a_full_cache_change_nothing(monkeypatch):
    monkeypatch.setattr(word_cache, "BLOCK_CHARS", 50)
    text = "one two, three 4 five's six " * 40
    assert "".join(word_cache.blocks(text, 50)) == text and len(list(word_cache.blocks(text, 50))) > 5
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tokenizer = word_cache.JsonTokenizer(tokenizer_path(name))
        tokenizer.cache.limit = tokenizer.parts.limit = 3
        assert list(tokenizer.encode([text] * 3)) == tokenizer._encode_many([text] * 3)


def test_pieces_equal_the_library_and_project_to_the_source(docs):
    import sentencepiece

    model = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = random_texts(300)
    rows = piece_offsets.encode_pieces(docs(texts), model, decode=True).collect()
    assert len(rows) == len(texts)
    again = {r.doc_id: r.decoded for r in piece_offsets.decode_pieces(piece_offsets.encode_pieces(docs(texts), model), model).collect()}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert list(r.ids) == library.encode(text)
        assert r.decoded == again[r.doc_id] == library.decode(list(r.ids))
        source = text.encode()
        assert not r.ids or r.ends[-1] == len(source)
        assert list(r.starts[1:]) == list(r.ends[:-1])
        for i, a, b in zip(r.ids, r.starts, r.ends):
            if not library.is_byte(i):
                assert library.id_to_piece(i).replace("▁", " ").strip() in (source[a:b].decode().strip(), source[a:b].decode().replace("▁", " ").strip())


@pytest.mark.parametrize("trim", [True, False])
def test_character_map_and_spans_equal_the_library(tmp_path, trim):
    """With the compiled map of the usual compatibility normalisation in the model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    source = pb.ModelProto()
    source.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model = pb.ModelProto()
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.precompiled_charsmap = source.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = trim
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    encoder = piece_offsets.PieceEncoder(str(path))
    assert not encoder.by_word
    texts = [t or "" for t in random_texts(800, 3) if len(t or "") < 1000]
    for text, (ids, starts, ends) in zip(texts, encoder.encode(texts), strict=True):
        want = encoder.library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], repr(text)
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], repr(text)


def test_counts_come_from_the_cache(docs, spark):
    path, cache = tokenizer_path("byte_bpe_50k.json"), scratch_folder(spark, "counts")
    library = word_cache.JsonTokenizer(path)
    texts = random_texts(200) * 2
    want = {i: (len((t or "").encode()), len(library._encode_many([t or ""])[0]) // 4) for i, t in enumerate(texts)}
    for _ in range(2):
        rows = token_counts.count_tokens(docs(texts), path, cache).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == len(texts)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    # A stored count is used, another tokenizer's is not.
    stored.filter(F.col("content_digest") == hashlib.sha256(b" ").hexdigest()).withColumn("n_tokens", F.lit(-5).cast("bigint")).write.partitionBy("tokenizer_digest").mode("append").parquet(cache)
    assert {r.n_tokens for r in token_counts.count_tokens(docs([" "]), path, cache).collect()} == {-5}
    assert token_counts.count_tokens(docs(["aB"]), tokenizer_path("word_bpe_49k.json"), cache).first().n_tokens == 1
    assert token_counts.count_tokens(docs([]), path, cache).count() == 0
    assert token_counts.count_tokens(docs(["a", "a"], ids=[None, None]), path, cache).count() == 2


def check_packing(rows, texts, capacity):
    library = word_cache.JsonTokenizer(tokenizer_path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert len(pieces) == len(texts)
    for i, text in enumerate(texts):
        ids = library._encode_many([text or ""])[0] + (1).to_bytes(4, "little")
        cut = [ids[a : a + 4 * capacity] for a in range(0, len(ids), 4 * capacity)]
        found = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in found] == [(n, n * capacity, len(c) // 4, zlib.crc32(c)) for n, c in enumerate(cut)]
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append(r)
    for group in held.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(held)


def test_packing_is_whole_and_tight(docs):
    rng = random.Random(5)
    texts = [None, ""] + [" ".join(rng.choice(["cat", "dog", "unusualword"]) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    rows = packing.pack_documents(docs(texts), tokenizer_path("word_bpe_49k.json"), capacity=64).collect()
    used = check_packing(rows, texts, 64)
    assert used <= -(-sum(r.length for r in rows) // 64) * 1.02 + 1


def test_shards_meet_again(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, rng.randint(1, 99)) for i in range(900)], "uid bigint, length int")
    rows = packing.pack(items, capacity=100, shard_items=100).join(items, "uid").collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 900 and max(fill.values()) <= 100
    # Lengths from 1 to 99 leave room for a tenth more than the sum at most.
    assert len(fill) <= 1.1 * sum(fill.values()) / 100


def test_packing_edges(docs, spark):
    path = tokenizer_path("word_bpe_49k.json")
    assert packing.pack_documents(docs([]), path).count() == 0
    rows = packing.pack_documents(docs(["a b", "a b"], ids=[None, None]), path).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2
    cut = packing.cut_pieces(docs(["a b c d e"] * 4), path, capacity=4, with_ids=True).withColumn("uid", F.monotonically_increasing_id())
    cut = written(cut, "cut")
    whole = packing.sequences(cut.join(packing.pack(cut, 4), "uid")).collect()
    assert sorted(r.length for r in whole) == [4] * 6 and all(len(r.ids) == 4 * r.length for r in whole)


def test_crossover_keeps_every_piece_once():
    rng = random.Random(7)
    lengths = [rng.randint(1, 60) for _ in range(200)]
    one, two = packing.evolve(lengths, [], 1, 100), packing.evolve(lengths, [], 2, 100)
    child = packing.crossover(one, two, lengths, 100, rng)
    assert sorted(i for b in child for i in b) == list(range(200))
    assert all(sum(lengths[i] for i in b) <= 100 for b in child)
    assert np.ceil(sum(lengths) / 100) <= len(packing.evolve(lengths, [one, two], 3, 100)) <= min(len(one), len(two))
