"""Byte-level BPE through the tokenizers library, with a memo of word pieces.

A Latin-1 text is cut by the vocabulary's own pattern; any other only where that pattern
always cuts: before a space between two other characters, and around white space. Each piece
is encoded once per worker and looked up afterwards. Pieces of Latin letters go straight to
the library's BPE model in byte characters; all others go through its whole pipeline.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex

#: Pieces that a worker remembers; the memo starts anew beyond that (about 60 MB).
MEMO = 250_000

# The code points with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The vocabularies' patterns over Latin-1, whose letters, numbers and white space these are.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
PLAIN_BYTES = re.compile(f" ?[{_L}]+|{_ENDINGS}| ?[{_N}]+| ?[^{_L}{_N}{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
PLAIN_WORDS = re.compile(f"[{_L}]+|{_ENDINGS}|[{_N}]|[^{_L}{_N}{_S}]+")
#: The patterns that these two stand for; any other pattern serves as it is.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Below this code point every Unicode version agrees on letters and digits.
LATIN = "ɐ"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


BYTE_CHARS = byte_characters()
_TO_CHARS = {i: c for i, c in enumerate(BYTE_CHARS)}
_TO_BYTES = {c: i for i, c in enumerate(BYTE_CHARS)}


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def to_bytes(chars: str) -> bytes:
    return bytes(_TO_BYTES[c] for c in chars)


class Memo(dict):
    """Ids by piece. A full memo keeps what it has, and starts anew after as many misses again."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.missed = 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) < MEMO:
            self[piece] = ids
        else:
            self.missed += 1
            if self.missed > 8 * MEMO:
                self.missed = 0
                self.clear()
        return ids


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids. Null and empty texts have none.

    plain: the tokenizer's own pattern as Python's re has it for Latin-1 texts, whose matches
    go straight to the model; other texts are cut into coarser pieces. marked: the tokenizer that
    encodes whole texts in which one of its special tokens is spelled out.
    """

    def __init__(self, tokenizer, pattern: str, normalize: bool, marked=None):
        self.tok, self.marked = tokenizer, marked
        names = [t.content for t in marked.get_added_tokens_decoder().values()] if marked else []
        self.marks = re.compile("|".join(map(re.escape, names)), re.I) if names else None
        start = os.path.commonprefix(names)
        self.start = start[: next((k for k, c in enumerate(start) if c.isalpha()), len(start))]
        self.pattern = regex.compile(pattern)
        self.plain = {WORD_PATTERN: PLAIN_WORDS, BYTE_PATTERN: PLAIN_BYTES}.get(pattern, self.pattern)
        self.normalize = normalize
        model = tokenizer.model.tokenize
        self.tokens = Memo(lambda token: np.array([t.id for t in model(to_characters(token.encode()))], dtype="<u4").tobytes())
        self.pieces = Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() or max(piece) < LATIN:
            if self.normalize:
                piece = unicodedata.normalize("NFC", piece).lower()
            return b"".join(map(self.tokens.__getitem__, self.pattern.findall(piece)))
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.marks and self.start in text and self.marks.search(text):
            return np.array(self.marked.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pieces = text.split(" ") if self.normalize else PIECE.findall(text)
            return b"".join(map(self.pieces.__getitem__, pieces))
        return b"".join(map(self.tokens.__getitem__, self.plain.findall(text.lower() if self.normalize else text)))


@functools.lru_cache(maxsize=4)
def library_encoder(path: str) -> PieceEncoder:
    """The encoder of a tokenizers file; as the library does it, a special token's string in a text is that token."""
    import json

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    spec = json.loads(tok.to_str())
    pre = spec["pre_tokenizer"]
    steps = pre.get("pretokenizers", [pre])
    split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
    if split is None:
        split = BYTE_PATTERN
    return PieceEncoder(tok, split, normalize=spec["normalizer"] is not None, marked=Tokenizer.from_file(path))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> PieceEncoder:
    """A tokenizers BPE with the merges that a rank file implies.

    Two neighbours merge whenever their concatenation has a rank, lowest rank first, so every
    split of a token into two tokens is a merge with that token's priority.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    names = {data: to_characters(data) for data in ranks}
    merges = [
        (names[data[:k]], names[data[k:]])
        for data in sorted(ranks, key=ranks.__getitem__)
        for k in range(1, len(data))
        if data[:k] in ranks and data[k:] in ranks
    ]
    vocab = {names[data]: rank for data, rank in ranks.items()}
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return PieceEncoder(tok, pattern, normalize=False)


class ByteDecoder:
    """ids to bytes. A character may be split over several ids, so text is decoded only at the end."""

    def __init__(self, pieces: dict[int, bytes]):
        self.pieces = pieces

    @classmethod
    def of(cls, encoder: PieceEncoder) -> ByteDecoder:
        return cls({i: to_bytes(name) for name, i in encoder.tok.get_vocab(with_added_tokens=False).items()})

    def data(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> str:
        return self.data(ids).decode("utf-8", errors="replace")

    def offsets(self, ids: Iterable[int]) -> np.ndarray:
        """First byte of each id in the decoded bytes."""
        lengths = np.fromiter((len(self.pieces[i]) for i in ids), dtype=np.int64)
        return np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths


@functools.lru_cache(maxsize=4)
def rank_decoder(path: str, pattern: str) -> ByteDecoder:
    return ByteDecoder.of(rank_encoder(path, pattern))
