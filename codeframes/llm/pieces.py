"""Whole-text encoding by pieces: a text is cut where every tokenizer here cuts anyway, and each distinct piece is
encoded once while it stays in a bounded cache.

Cutting, finding distinct pieces and putting ids back in order work on whole Arrow columns; Python sees a piece
once per slice, and the tokenizer gets those that the cache lacks in one joined text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the characters with Unicode White_Space, as \s of the tokenizers' patterns has it, for a class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Pieces for patterns in which one space may lead a word: an optional space and a run without white space, or
#: white space up to where the next such piece begins.  No match of those patterns crosses a piece's border.
SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_WHITE = re.compile(f"[{WHITE}]")
# A space between other white space: only without it are a text's pieces those that single spaces lead.
_MIXED = f"[{WHITE}] (?:[{WHITE}]|$)"
GLUE = "\x01"
_MARK = "[.,;:!?]"
_MARKS = frozenset(".,;:!?")

# Letters whose lower case in normal form is one letter again, so that a mark behind them is a match of its own:
# basic Latin after ASCII lower-casing, Latin without U+0130, Greek and Cyrillic letters.
_STEADY = "[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f\u03ac-\u03ce\u0430-\u045f]"

#: A space and letters that every version of Unicode has as letters: one match of the patterns in which a space may lead.
LED_WORD = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f]+")

#: Bytes of one generation of a cache: characters, ids, and ``_ENTRY`` for two objects and their place in it.
CACHE_BYTES = 24 << 20
_ENTRY = 190


class PieceEncoder:
    """``encode_many`` gives the ids of pieces as little-endian unsigned 32-bit bytes.

    With ``led``, the space before a piece belongs to it; else spaces and line breaks only separate, and a mark after
    a word is a piece of its own.  ``lower`` is for vocabularies that lower-case anyway.
    The cache only saves time: it has two generations of ``limit`` bytes, and what the older one holds and is
    asked for again moves to the younger.  Strings of ``specials`` are cut out of a text before all else and are their id,
    as the library's plain call has it."""

    def __init__(self, led: bool, encode_many: Callable[[list[str]], Iterable[bytes]], limit: int = CACHE_BYTES, lower: bool = False, specials: dict[str, int] | None = None):
        self.led, self.encode_many, self.limit, self.lower = led, encode_many, limit, lower
        self.specials = specials or {}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.weight = 0

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if self.weight > self.limit:
            self.known, self.older, self.weight = {"": b""}, self.known, 0
        known, older = self.known, self.older
        found = list(map(known.get, pieces))
        missing = [i for i, v in enumerate(found) if v is None]
        kept, weight = len(known), 0
        if missing:
            unseen = []
            for i, p in zip(missing, [pieces[i] for i in missing], strict=True):
                v = older.get(p)
                if v is None:
                    unseen.append(i)
                else:
                    found[i] = known[p] = v
                    weight += len(p) + len(v)
            names = [pieces[i] for i in unseen]
            for i, p, v in zip(unseen, names, self.encode_many(names), strict=True):
                found[i] = known[p] = v
                weight += len(p) + len(v)
        self.weight += weight + (len(known) - kept) * _ENTRY
        return found

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null texts are empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.specials:
            odd = pc.match_substring_regex(column, self._special.pattern).to_numpy(zero_copy_only=False)
            if odd.any():
                return self._around_specials(column, odd)
        return self._encode(column)

    def _around_specials(self, column: pa.Array, odd: np.ndarray) -> list[np.ndarray]:
        """Texts with strings of special tokens, part by part, and the others."""
        out: list = [None] * len(column)
        rest = np.flatnonzero(~odd)
        for i, ids in zip(rest, self._encode(column.take(pa.array(rest))) if len(rest) else (), strict=True):
            out[i] = ids
        for i in np.flatnonzero(odd):
            parts = self._special.split(column[int(i)].as_py())  # every other one is a special token's string
            ids = self._encode(pa.array(parts[::2], pa.string()))
            marks = [np.array([self.specials[p]], "<u4") for p in parts[1::2]]
            out[i] = np.concatenate([x for pair in zip(ids, [*marks, ids[0][:0]], strict=True) for x in pair])
        return out

    def _encode(self, column: pa.Array) -> list[np.ndarray]:
        cut = led_pieces(column) if self.led else bare_pieces(column, self.lower)
        values = self.look_up(cut.pieces)
        sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
        ids, ends = gathered(cut.index, sizes, np.frombuffer(b"".join(values), "<u4"))
        bounds = np.concatenate(([0], ends))[cut.bounds]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class Cut(NamedTuple):
    """Texts as pieces: ``index`` has the piece of every place, ``bounds`` where each text begins in it."""

    pieces: list[str]
    index: np.ndarray
    bounds: np.ndarray


def gathered(index: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``flat``, of ``sizes`` each, in the order of ``index``; and where each part ends."""
    starts = np.cumsum(sizes, dtype=np.int32) - sizes.astype(np.int32)  # a slice of texts is far below 2^31 ids
    each = sizes[index].astype(np.int32)
    ends = np.cumsum(each, dtype=np.int32)
    at = np.repeat(starts[index] - (ends - each), each)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], ends


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, list[str], np.ndarray]:
    coded, offsets = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
    return coded.indices.to_numpy().astype(np.int32), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), offsets - offsets[0]


def bare_pieces(column: pa.Array, lower: bool = False) -> Cut:
    """Pieces for patterns that drop white space: between spaces and line breaks, a mark behind a word on its own."""
    plain = pc.replace_substring(pc.ascii_lower(column) if lower else column, "\n", " ")
    index, parts, bounds = _coded(pc.split_pattern(pc.replace_substring_regex(plain, f"({_STEADY})({_MARK}) ", r"\1 \2 "), " "))
    return Cut(parts, index, bounds)


def led_pieces(column: pa.Array) -> Cut:
    """Pieces for patterns in which one space may lead a word: those of ``SPACED``, further cut at marks and line breaks
    behind words."""
    mixed = pc.or_(pc.match_substring_regex(column, _MIXED), pc.match_substring(column, GLUE)).to_numpy(zero_copy_only=False)
    if not mixed.any():
        return _glued(column)
    # texts with other white space go one by one; all share one list of pieces
    plain = np.flatnonzero(~mixed)
    cut = _glued(column.take(pa.array(plain)))
    number = {p: i for i, p in enumerate(cut.pieces)}
    runs: list = [None] * len(column)
    for k, i in enumerate(plain.tolist()):
        runs[i] = cut.index[cut.bounds[k] : cut.bounds[k + 1]]
    for i in np.flatnonzero(mixed):
        found = SPACED.findall(column[int(i)].as_py())
        runs[i] = np.fromiter((number.setdefault(p, len(number)) for p in found), np.int32, len(found))
    return Cut(list(number), np.concatenate(runs), np.concatenate(([0], np.cumsum([len(r) for r in runs]))))


def _glued(column: pa.Array) -> Cut:
    """Parts between single spaces; a mark after a word, a line break and the word after it become parts of their
    own, which a leading ``GLUE`` tells from those that a space leads."""
    marked = pc.replace_substring_regex(column, rf"(\pL)({_MARK})([ \n])", rf"\1 {GLUE}\2\3")
    broken = pc.replace_substring_regex(marked, f"([^{WHITE}])\n([^{WHITE}])", rf"\1 {GLUE}\n {GLUE}\2".replace(r"\n", "\n"))
    index, parts, bounds = _coded(pc.split_pattern(broken, " "))
    pieces = [p[1:] if p[:1] == GLUE else " " + p for p in parts]
    # a text's first part has no space before it
    number = {p: i for i, p in enumerate(pieces)}
    firsts = bounds[:-1]
    heads, back = np.unique(index[firsts], return_inverse=True)
    index[firsts] = np.array([number.setdefault(parts[h], len(number)) for h in heads], np.int32)[back]
    return Cut(list(number), index, bounds)


def quick_cut(find: Callable[[str], list[str]]) -> Callable[[str], list[str]]:
    """``find`` with a short cut for what most pieces are: letters behind a space, before one mark or none."""

    def cut(p: str) -> list[str]:
        core = p[1:] if p[0] == " " else p
        if core.isalpha():
            return [p]
        if core[-1:] in _MARKS and core[:-1].isalpha():
            return [p[:-1], p[-1]]
        return find(p)

    return cut


def exact_white(pattern: str) -> str:
    """A tokenizer's pattern with its white space spelt out, as Python's differs by some control characters."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def loaded(path: str):
    """The tokenizers library's tokenizer of a file, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def joined_encoder(tokenizer, led: bool, separator: str, mark: str) -> PieceEncoder:
    """Pieces through the tokenizers library, many in one text.

    ``separator`` holds ``mark``, whose single id occurs in no piece without it: ids are cut there.  Pieces with
    the mark or white space inside go one by one, as do all if the count of cuts doesn't come out."""
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    tokenizer.encode_special_tokens = True  # the encoder has cut their strings out: no piece can be made one
    marks = tokenizer.encode(mark, add_special_tokens=False).ids

    def alone(some: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def odd(piece: str) -> bool:
        return mark in piece or (not piece.isalpha() and bool(_WHITE.search(piece, 1 if led and len(piece) > 1 and piece[0] == " " else 0)))

    def encode_many(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        singles = [i for i, p in enumerate(pieces) if odd(p)]
        skip = set(singles)
        plain = [i for i in range(len(pieces)) if i not in skip] if skip else list(range(len(pieces)))
        for k in range(0, len(plain), 2048):
            some = plain[k : k + 2048]
            ids = np.array(tokenizer.encode_batch_fast([separator.join([pieces[i] for i in some])], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == marks[0]) if len(marks) == 1 else ids[:0]
            if len(at) != len(some) - 1:
                singles += some
                continue
            data = ids.tobytes()
            for i, a, b in zip(some, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True):
                out[i] = data[4 * a : 4 * b]
        for i, v in zip(singles, alone([pieces[i] for i in singles]), strict=True):
            out[i] = v
        return out

    return PieceEncoder(led, encode_many, specials=specials)


def _words_apart(others: Callable, sure: Callable[[str], object], plain, separator: str, stops: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """``encode_many`` that gives ``sure`` pieces to ``plain``, many in one text, and the rest to ``others``.

    ``stops`` has where each piece ends in the ids; pieces whose count doesn't come out go to ``others``, too."""

    def encode_many(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        fits = np.fromiter((bool(v) for v in map(sure, pieces)), bool, len(pieces))
        rest, words = np.flatnonzero(~fits).tolist(), np.flatnonzero(fits).tolist()
        for k in range(0, len(words), 512):
            some = words[k : k + 512]
            ids = np.array(plain.encode_batch_fast([separator.join([pieces[i] for i in some])], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * stops(ids)).tolist()
            if len(ends) != len(some):
                rest += some
                continue
            data = ids.tobytes()
            for i, a, b in zip(some, [0, *ends[:-1]], ends, strict=True):
                out[i] = data[a:b]
        for i, v in zip(rest, others([pieces[i] for i in rest]), strict=True):
            out[i] = v
        return out

    return encode_many


def word_end_encoder(path: str) -> PieceEncoder:
    """For a lower-casing vocabulary that drops white space and whose words end in ``</w>``.

    A piece of small letters in normal form is one word that normalisation leaves alone: such pieces go through a
    tokenizer without it, many at once, and are told apart by word ends.  For others a zero byte between spaces is
    a word of its own."""
    from tokenizers import normalizers, pre_tokenizers

    encoder = joined_encoder(loaded(path), False, " \x00 ", "\x00")
    plain = loaded(path)
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(plain.get_vocab_size(), bool)
    for token, i in plain.get_vocab().items():
        ends[i] = token.endswith("</w>")

    def steady(p: str) -> bool:
        return p.isalpha() and p.lower() == p and (p.isascii() or unicodedata.is_normalized("NFC", p))

    encoder.encode_many = _words_apart(encoder.encode_many, steady, plain, " ", lambda ids: np.flatnonzero(ends[ids]) + 1)
    encoder.lower = True
    return encoder


def byte_level_encoder(path: str) -> PieceEncoder:
    """For a byte-level vocabulary with the common pattern, in which a line break between words stands alone.

    A space and letters are one match of the pattern: such pieces go to the same merges without the pattern, cut at line
    breaks, and are told apart by the tokens that begin with the space, which no other token of theirs holds."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = loaded(path)
    encoder = joined_encoder(tokenizer, True, "\n", "\n")
    if tokenizer.normalizer is not None:
        return encoder
    plain = Tokenizer(tokenizer.model)  # the same vocabulary in memory
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    space = tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]
    vocabulary = tokenizer.get_vocab()
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        begins[i] = token.startswith(space)

    def stops(ids: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(begins[ids])[1:], len(ids))

    encoder.encode_many = _words_apart(encoder.encode_many, LED_WORD.fullmatch, plain, "\n", stops)
    return encoder
