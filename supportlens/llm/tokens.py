"""Token ids of whole texts from public vocabulary files, with a cache of words.

A text is cut at every single blank between two characters that are not white space. In both
kinds of vocabulary a token starts there and no merge crosses it, so the pieces are encoded one
by one, each with the blank before it, and looked up when they come again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

CUT = re.compile(r" (?<=\S )(?=\S)")
#: Pieces held at a time, and as many that were used before.
CACHED_WORDS = 200_000
ID = np.dtype("<u4")
#: The character that stands for a blank in the pieces of a sentence-piece vocabulary.
BLANK = "▁"


class UnequalBytes(ValueError):
    """The bytes of a text's tokens are not the text's own."""


class Words:
    """Little-endian 32-bit token ids of pieces, each with the blank before it.

    The pieces of a text that are not known yet are encoded together, as the text that they
    make, and cut apart by the bytes of their tokens. When ``limit`` pieces are held, those
    not used since the last time are forgotten.
    """

    def __init__(self, encode, token_bytes: list[bytes], limit: int = CACHED_WORDS):
        self.encode, self.token_bytes, self.limit = encode, token_bytes, limit
        self.lengths = np.array([len(token) for token in token_bytes], dtype=np.int64)
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, pieces: list[str]) -> bytes:
        try:
            return b"".join(map(self.held.__getitem__, pieces))
        except KeyError:
            self._learn(pieces)
            return b"".join(map(self.held.__getitem__, pieces))

    def _learn(self, pieces: list[str]) -> None:
        if len(self.held) >= self.limit:
            self.older, self.held = self.held, {}
        new = set(pieces).difference(self.held)
        known = [piece for piece in new if piece in self.older]
        self.held.update((piece, self.older[piece]) for piece in known)
        new.difference_update(known)
        # Pieces with white space at an end would be cut in other places beside their neighbours.
        whole = [piece for piece in new if piece and piece.strip() == piece]
        if not self._together(whole):
            self._one_by_one(whole)
        if len(whole) < len(new):
            self._one_by_one(new.difference(whole))

    def _together(self, pieces: list[str]) -> bool:
        text = "".join([" " + piece for piece in pieces])
        data = text.encode()
        ids = np.array(self.encode(text), dtype=ID) if pieces else np.zeros(0, dtype=ID)
        if b"".join([self.token_bytes[i] for i in ids.tolist()]) != data:
            return False
        ends = np.cumsum(self.lengths[ids])
        sizes = map(len, pieces if len(text) == len(data) else [piece.encode() for piece in pieces])
        borders = np.cumsum(np.fromiter(sizes, np.int64, len(pieces)) + 1)
        cuts = np.searchsorted(ends, borders)
        if (ends[cuts] != borders).any():
            return False
        raw, at = ids.tobytes(), 0
        for piece, cut in zip(pieces, ((cuts + 1) * ID.itemsize).tolist(), strict=True):
            self.held[piece] = raw[at:cut]
            at = cut
        return True

    def _one_by_one(self, pieces: Iterable[str]) -> None:
        for piece in pieces:
            ids = self.encode(" " + piece)
            if b"".join([self.token_bytes[i] for i in ids]) != (" " + piece).encode():
                raise UnequalBytes(piece)
            self.held[piece] = np.array(ids, dtype=ID).tobytes()


class ByteVocabulary:
    """A byte-level vocabulary file with its own order of merges.

    ``special`` maps the file's added tokens to their ids; ``plain`` reads their strings in a
    text as ordinary text, ``marked`` as these ids.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        added = described["added_tokens"]
        if any(token[flag] for token in added for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take the blanks around them are not supported")
        self.special = {token["content"]: token["id"] for token in added}
        vocabulary = {t: i for t, i in described["model"]["vocab"].items() if t not in self.special}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
        self.encoding = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for token, i in ranks.items():
            self.bytes[i] = token
        self.words = Words(self.encoding.encode_ordinary, self.bytes)

    def plain(self, text: str) -> bytes:
        first, *pieces = CUT.split(text)
        head = np.array(self.encoding.encode_ordinary(first), dtype=ID).tobytes()
        return head + self.words(pieces)

    def marked(self, text: str) -> bytes:
        if self.marks is None or not any(mark in text for mark in self.special):
            return self.plain(text)
        out, at = [], 0
        for found in self.marks.finditer(text):
            out += [self.plain(text[at : found.start()]), np.array([self.special[found[0]]], dtype=ID).tobytes()]
            at = found.end()
        return b"".join([*out, self.plain(text[at:])])


class PieceVocabulary:
    """A sentence-piece vocabulary that adds a blank before a text and changes nothing else.

    No piece may hold a blank behind another character, so that no merge crosses a word's start.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        if any(BLANK in piece.lstrip(BLANK) for piece in pieces):
            raise ValueError("a piece holds a blank behind another character")
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(BLANK, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self.words = Words(self._encode, self.bytes)

    def _encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a blank, which the vocabulary adds, but not to an empty text."""
        return self.model.encode(text[1:]) if len(text) > 1 else [self.model.piece_to_id(BLANK)]


@lru_cache(maxsize=4)
def byte_vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


@lru_cache(maxsize=4)
def piece_vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)
