"""Op 11 against the plain calls of both libraries and a loop over every document."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from codeframes.llm import alignment
from codeframes.llm.queries import vocabulary
from tests.llm.helpers import DOCS, empty_docs, odd_docs, odd_rows

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ROWS = odd_rows() + [
    (900, "<|endoftext|> and <s>x</s> <unk> <0x41>", None, None, 0),
    (901, "a▁b loses its mark", None, None, 0),
    (902, " leads, trails  and  doubles \n\t tabs ", None, None, 0),
    (903, "naïve façade 漢字かな交じり文 \U0001f600\U0001f680 \x00\x1f end", None, None, 0),
    (904, "aaaa" * 300 + "ñ" * 200 + "==" * 333, None, None, 0),
    (None, "no id at all", None, None, 0),
    (None, "no id at all", None, None, 0),
]


def groups_of(text, a_model, a_bytes, b_model):
    """[(A ids, B ids)] of every group."""
    a = a_model.encode(" " + text, add_special_tokens=False).ids
    b = b_model.encode(text)
    of_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    of_a = [a_bytes[i] for i in a]
    if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return []

    def ends(parts):
        out, n = [], 0
        for p in parts:
            n += len(p)
            out.append(n)
        return out

    ea, eb = ends(of_a), ends(of_b)
    shared = sorted(set(ea) & set(eb))
    out, i, j = [], 0, 0
    for cut in shared:
        k, m = i, j
        while k < len(a) and ea[k] <= cut:
            k += 1
        while m < len(b) and eb[m] <= cut:
            m += 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    char = alignment.byte_of_char()
    a_bytes = {i: bytes(char.get(c, 0) for c in t) for t, i in a_model.get_vocab().items()}
    found = [(r[0], groups_of(r[1] or "", a_model, a_bytes, b_model)) for r in rows]
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in found]
    count = Counter(p for one in linked for p in one)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, groups), links in zip(found, linked, strict=True):
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""
        best = sum(n for (x, y), n in links.items() if count[x, y] == most[x])
        total = sum(n * count[p] for p, n in links.items())
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), best, total, digest))
    return sorted(out, key=repr)


def test_rows_equal_the_loop(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = sorted((tuple(r) for r in alignment.report(docs, A, B).collect()), key=repr)
    assert got == brute(ROWS)


@pytest.mark.parametrize("block,cuts", [(64, True), (64, False), (3, False)])
def test_blocks_and_whole_texts(monkeypatch, block, cuts):
    """Small blocks, and texts that are one chunk each, as with vocabularies whose pieces hold spaces inside."""
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", block)
    aligner = alignment.Aligner(A, B)
    assert aligner.cuts
    aligner.cuts = cuts
    rows = [r for r in ROWS if len(r[1] or "") < 6000]
    values = aligner.aligned(pa.array([r[1] for r in rows], pa.string()))
    got = [(r[0], *(values[c][i] for c in ("n_a", "n_b", "n_groups", "n_links")), values["digests"][i]) for i, r in enumerate(rows)]
    assert sorted(got, key=repr) == sorted(((*r[:5], r[7]) for r in brute(rows)), key=repr)


def test_all_kinds_of_space():
    """Chunks give the ids of whole texts around every kind of white space."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("a b. \n\r\t\u00a0\u2003'sé1,;\x01") for _ in range(40)), None, None, 0) for i in range(400)]
    aligner = alignment.Aligner(A, B)
    values = aligner.aligned(pa.array([r[1] for r in rows]))
    whole = {r[0]: r for r in brute(rows)}
    assert all((values["n_a"][i], values["n_b"][i], values["n_groups"][i], values["digests"][i]) == (*whole[i][1:4], whole[i][7]) for i in whole)


def test_slices_share_counts(spark, monkeypatch):
    """Documents of several partitions count together."""
    docs = spark.createDataFrame(ROWS, DOCS).repartition(5)
    assert sorted((tuple(r) for r in alignment.report(docs, A, B).collect()), key=repr) == brute(ROWS)


def test_pairs_are_those_of_the_loop(spark):
    rows = ROWS[:8]
    _, pairs = alignment.align(spark.createDataFrame(rows, DOCS), A, B)
    assert pairs.groupBy("pair").count().filter("count > 1").count() == 0
    assert pairs.filter("best").count() > 0


def test_odd_columns_and_empty(spark):
    assert alignment.report(odd_docs(spark), A, B).count() == len(odd_rows())
    empty = alignment.report(empty_docs(spark), A, B)
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "n_a"]
