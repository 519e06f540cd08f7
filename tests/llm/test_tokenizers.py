"""Token store, BPE replay and packing against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from codeframes.llm import bpe, packing, tokenstore
from codeframes.llm.pieces import PieceEncoder, byte_level_encoder, word_end_encoder

from .helpers import empty_docs, odd_docs, odd_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE, MULTI = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


def plain(path):
    """The library's plain call."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# every code point with White_Space, and the two look-alikes that have it not
WHITE = [chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x200B, 0x1C)]
CASED = ["İ", "ǅ", "ſ", "K", "Å", "ﬁ", "יִ", "ΐ", "ŉ", "ǰ", "ẞ", "Ω", "i̇", "Σ", "ς", "é", "e\u0301", "\u0301", "Я", "ї"]
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext"]


def hostile(n=400, seed=0):
    rng = random.Random(seed)
    parts = [*WHITE, *CASED, *SPECIAL, *" .,;:!?", " ", " ", " ", "  ", "\n", "\r\n", "a", "Word", "und", "'s", "'LL", "12", "½", "ß", "ΣΑΣ", "漢字", "!?", "\U0001f600", "_", "-", "\x00", "\x01", ". "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def around(marks):
    """Every mark between letters, white space and punctuation."""
    sides = ["", "a", " ", "\n", "  ", "x.", "'s", "İ", "<|endoftext|>"]
    return [a + m + b for m in marks for a in sides for b in sides]


@pytest.mark.parametrize(("path", "make"), [(WORD, word_end_encoder), (BYTE, byte_level_encoder)])
def test_pieces_give_the_ids_of_whole_texts(path, make):
    texts = around(WHITE) + around(CASED) + around(SPECIAL) + hostile(10_000) + [r[1] for r in odd_rows()]
    texts += [f"{a}{m}{b}" for a in CASED for m in ".,;:!?" for b in (" a", "  b", " ", "\n.", "")]
    encode, whole = make(path), plain(path)
    for text, got in zip(texts, encode.encode(texts), strict=True):
        assert got.tolist() == whole(text), text


def test_the_cache_only_saves_time():
    seen = []
    enc = PieceEncoder(False, lambda p: (seen.extend(p), [np.array([ord(c) for c in x], "<u4").tobytes() for x in p])[1], limit=600)
    texts = lambda t: ["".join(map(chr, x)) for x in enc.encode(t)]
    assert texts(["a b a"]) == ["aba"] and texts(["c a", None]) == ["ca", ""] and texts(["a"]) == ["a"] and texts([]) == []
    assert sorted(seen) == ["a", "b", "c"]
    for i in range(9):
        for _ in range(3):
            assert texts([f"a x{i}"]) == [f"ax{i}"]
    assert seen.count("a") == 1  # what is in use moves to the younger generation
    assert len(enc.known) + len(enc.older) < 12 and enc.weight <= 600 + 400


def tiktoken_encoding():
    import tiktoken

    with open(MULTI, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_is_tiktoken(spark):
    enc = tiktoken_encoding()
    texts = around(WHITE) + around(CASED) + hostile(10_000, 1) + [r[1] for r in odd_rows()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, MULTI, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == enc.encode_ordinary(text or ""), text


def test_words_are_encoded_once():
    ranks = bpe.load_ranks(MULTI)
    seen = []
    replay = bpe.MergeReplay(ranks)
    whole = replay.encode
    replay.encode = lambda words: seen.extend(words) or whole(words)
    slices = [[w.encode() for w in (" hello", " world", "漢字", f" w{i}")] for i in range(7)] + [[]]
    found = bpe.encode_cell(replay, [(i, *bpe._pack_words(words)) for i, words in enumerate(slices)])
    assert len(seen) == len(set(seen)) == 10
    for (owner, sizes, ids), words in zip(found, slices, strict=True):
        ids, ends = bpe._unpacked(ids).tolist(), np.cumsum(bpe._unpacked(sizes)).tolist()
        assert [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [bpe.encode_alone(w, ranks) for w in words] and words == slices[owner]


def test_words_behind_a_space_do_without_the_pattern(monkeypatch):
    from codeframes.llm import pieces

    make, slow = pieces.joined_encoder, []

    def watched(*args):
        encoder = make(*args)
        encode_many = encoder.encode_many
        encoder.encode_many = lambda some: slow.extend(some) or encode_many(some)
        return encoder

    monkeypatch.setattr(pieces, "joined_encoder", watched)
    letters = [chr(c) for c in range(0x3000) if pieces.LED_WORD.fullmatch(" " + chr(c))]
    words = [" " + a + b for a in letters for b in "aZ\u00e9\u03b1\u044f"] + [" " + "".join(letters)] + [" it" + "x" * n for n in range(700)]
    others = ["it", " it's", " a1", " don\u2019t", " \u4e2d\u6587", " \u0301a", " a\u0301", " ", "\n", " \u00d7", " \u00f7", " \u0360", " \u0488", ""]
    found = byte_level_encoder(BYTE).look_up([*words, *others])
    assert not set(words) & set(slow) and set(others[:-1]) == set(slow)
    whole = plain(BYTE)
    assert [np.frombuffer(v, "<u4").tolist() for v in found] == list(map(whole, [*words, *others]))
    texts = ["".join(words[i::7]) + o + "".join(words[i::11]) for i, o in enumerate(others * 3)]
    assert [v.tolist() for v in byte_level_encoder(BYTE).encode(texts)] == list(map(whole, texts))


def test_word_numbers_survive_packing():
    rng = np.random.default_rng(0)
    for numbers in ([], [0], [255], [1 << 24], range(70_000), rng.zipf(1.3, 50_000) % 10**6, [191, 192, 447, 448, 16319, 16320, 16321]):
        numbers = np.array(numbers, np.int32)
        assert bpe._unpacked_ranks(bpe._packed_ranks(numbers)).tolist() == numbers.tolist()
        assert bpe._unpacked(bpe._packed(numbers)).tolist() == numbers.tolist()


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 9001}é" for i in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id long, text string").repartition(1)
    enc = tiktoken_encoding()
    assert {r.doc_id: r.ids for r in bpe.encode(docs, MULTI, public_tokenizers.PATTERN).collect()} == {1: enc.encode_ordinary(text), 2: enc.encode_ordinary("short"), 3: []}


def test_replay_with_ranks_out_of_order():
    rng = random.Random(2)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        made = [b"a", b"b", b"c"]
        numbers = rng.sample(range(256, 400), 25)
        for number in numbers:
            token = rng.choice(made) + rng.choice(made)
            if token not in ranks:
                ranks[token] = number
                made.append(token)
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))).encode() for _ in range(80)]
        got = bpe.MergeReplay(ranks).encode(words)
        assert got == [[ranks[w]] if w in ranks else bpe.encode_alone(w, ranks) for w in words]


def test_bpe_round_trip(spark):
    enc = tiktoken_encoding()
    want = []
    for i, text, *_ in odd_rows():
        ids = enc.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(odd_docs(spark), MULTI, public_tokenizers.PATTERN).collect())) == sorted(want)
    assert bpe.round_trip(empty_docs(spark), MULTI, public_tokenizers.PATTERN).count() == 0
    ids = {r.doc_id: r.ids for r in bpe.encode(odd_docs(spark), MULTI, public_tokenizers.PATTERN).collect()}
    assert ids[4] == enc.encode_ordinary(odd_rows()[4][1]) and ids[0] == []


def test_store_round_trip(spark):
    whole = plain(WORD)
    store = tokenstore.write_store(odd_docs(spark), WORD)
    rows = sorted(odd_rows(), key=lambda r: r[0])
    streams = [(r[0], [*whole(r[1]), 1]) for r in rows]
    want, start = [], 0
    for i, ids in streams:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenstore.read_documents(store).collect())) == sorted(want)
    got = {r.doc_id: r.ids for r in tokenstore.reconstruct(store, store.recipes.filter("doc_id in (4, 7)")).collect()}
    assert got == {i: ids for i, ids in streams if i in (4, 7)}
    n_steps = sum(len(r.digests) for r in store.recipes.collect())
    assert store.chunks.count() == store.chunks.select("digest").distinct().count() < n_steps
    assert tokenstore.read_documents(tokenstore.write_store(empty_docs(spark), WORD)).count() == 0


def test_store_of_awkward_rows(spark):
    passage = " ".join(f"word{i % 977}x{i % 31}" for i in range(4000))
    rows = [(i, passage) for i in range(300)] + [(None, "no id"), (None, None), (7, passage + " again"), (900, "y " * 200_000), (901, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS bucket", "3 AS kind", "4 AS digests")
    store = tokenstore.write_store(docs, WORD)
    whole = plain(WORD)
    got = tokenstore.read_documents(store).collect()
    want = sorted((-1 if i is None else i, zlib.crc32(np.array([*whole(t), 1], "<u4").tobytes())) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def damaged(store, spark, change):
    """The store with changed chunks."""
    path = store.path + "-damaged"
    rows = spark.read.parquet(f"{store.path}/parts")
    change(rows).sortWithinPartitions("kind", "bucket", "key").write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{path}/parts")
    return store._replace(path=path)


def test_store_notices_damage(spark):
    from pyspark.sql import functions as F

    store = tokenstore.write_store(spark.createDataFrame([(i, f"some words here {i}") for i in range(9)], "doc_id long, text string"), WORD)
    assert tokenstore.read_documents(store).count() == 9
    with pytest.raises(Exception, match="damaged"):
        tokenstore.read_documents(damaged(store, spark, lambda rows: rows.withColumn("ids", F.concat("ids", F.lit(b"\x00\x00"))))).collect()
    with pytest.raises(Exception, match="lack"):
        tokenstore.read_documents(damaged(store, spark, lambda rows: rows.filter("kind <> 'chunks'"))).collect()
    with pytest.raises(Exception, match="manifest"):
        tokenstore.read_documents(store._replace(recipes=store.recipes.filter("doc_id <> 3"))).collect()
    with pytest.raises(Exception, match="manifest"):
        tokenstore.read_documents(store._replace(recipes=store.recipes.withColumn("doc_id", F.col("doc_id") + 1))).collect()
    swapped = store.recipes.withColumn("digests", F.reverse(F.concat("digests", "digests")))
    with pytest.raises(Exception, match="recipe"):
        tokenstore.read_documents(store._replace(recipes=swapped)).collect()


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 49_000, 20_000)
    a, b = np.concatenate((rng.integers(0, 49_000, 777), shared)), np.concatenate((rng.integers(0, 49_000, 2), shared))
    cuts = [{x[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)} for x in (a, b) for ends in tokenstore.boundaries(x)]
    assert len(cuts[0] & cuts[1]) > 0.8 * len(cuts[1])
    for ids in (a, np.zeros(10_000, np.int64), np.array([5])):
        ends = tokenstore.boundaries(ids)[0]
        sizes = np.diff([0, *ends])
        assert tokenstore.boundaries(np.concatenate((a, ids)), np.array([len(a), len(ids)]))[1] == ends
        assert ends[-1] == len(ids) and sizes.max() <= tokenstore.MOST and (sizes[:-1] >= tokenstore.LEAST).all()


def test_packing(spark):
    whole = plain(BYTE)
    got = packing.pack_documents(odd_docs(spark), BYTE).collect()
    want = []
    for i, text, *_ in odd_rows():
        ids = [*whole(text), 0]
        for k, (s, n) in enumerate(packing.piece_bounds(len(ids))):
            want.append((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    check_sequences([(r.sequence_id, r.offset, r.length) for r in got])
    assert packing.pack_documents(empty_docs(spark), BYTE).count() == 0


def check_sequences(rows, capacity=2048):
    at = {}
    for seq, offset, length in sorted(rows):
        assert offset == at.get(seq, 0)
        at[seq] = offset + length
    assert max(at.values()) <= capacity
    return at


@pytest.mark.parametrize(("lookahead", "over"), [(1024, 1.005), (1, 1.02)])
def test_sequences_are_nearly_full(spark, lookahead, over):
    rng = random.Random(0)
    lengths = [min(2048, int(rng.lognormvariate(6.2, 1.1)) + 1) for _ in range(9000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE_SCHEMA)
    got = packing.pack(pieces, lookahead=lookahead).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    fill = check_sequences([(r.sequence_id, r.offset, r.length) for r in got])
    assert len(fill) <= over * sum(lengths) / 2048 + 1


def test_pieces_are_placed_as_they_arrive(spark):
    rng = random.Random(3)
    lengths = [rng.randint(1, 2048) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE_SCHEMA)
    got = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(pieces, open_bins=7).collect()}
    order = pieces.selectExpr("doc_id", "length", "xxhash64(doc_id, ids_crc32) AS o").orderBy("o", "doc_id").collect()
    packer = packing.Packer(2048, 7)
    assert got == {r.doc_id: packer.place(r.length) for r in order}


def test_bounds():
    assert packing.piece_bounds(2048) == [(0, 2048)] and packing.piece_bounds(4096) == [(0, 2048), (2048, 2048)]
    assert packing.piece_bounds(2049) == [(0, 1), (1, 2048)] and packing.piece_bounds(1) == [(0, 1)]


@pytest.mark.parametrize("open_bins", [1, 8, 256])
def test_packer_against_plain_best_fit(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.choice([1, 2048, rng.randint(1, 2048), rng.randint(1, 400)]) for _ in range(4000)]
    packer, rows = packing.Packer(2048, open_bins), []
    bins: dict[int, int] = {}  # open ones: free space
    for n in lengths:
        b, offset = packer.place(n)
        fitting = [f for f in bins.values() if f >= n]
        if fitting:
            assert bins[b] == min(fitting)
        else:
            assert b not in bins
            bins[b] = 2048
            if len(bins) > open_bins:
                left = bins[b] - n
                fullest = min(f for k, f in bins.items() if k != b)
                if left > fullest:
                    del bins[next(k for k, f in sorted(bins.items(), reverse=True) if f == fullest and k != b and k not in packer_open(packer))]
        assert offset == 2048 - bins[b]
        bins[b] -= n
        bins = {k: f for k, f in bins.items() if k in packer_open(packer)}
        assert packer.count == len(bins) <= open_bins
        rows.append((b, offset, n))
    fill = check_sequences(rows)
    if open_bins == 256:
        assert sum(fill.values()) / (2048 * len(fill)) > 0.95


def packer_open(packer):
    return {b for bins in packer.by_free for b in bins}
