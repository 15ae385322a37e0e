"""Byte-level BPE of whole texts with the tokenizers library, memoised by piece.

A byte-level BPE of this family first splits a text by a pattern none of whose matches runs from a character that is
not white space into white space, or from a letter into a character that is none. A text may therefore be cut before
every run of spaces or newlines, and between a letter and an ASCII mark or digit that follows it; its pieces are encoded
alone, and their ids are those of the whole text. Texts with any other white space, or with the text of a special token, are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import compress
from operator import not_

import numpy as np

from .common import held

#: Pieces are kept up to this number in each of two generations of a worker's memory.
MAX_PIECES = 600_000
#: Characters of the texts that learn their new pieces together.
GROUP_CHARS = 1 << 18

_PIECES = re.compile(r"[ \n]*[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-\x7F])|[ \n]*[^ \n]+|[ \n]+")
#: All white space but space and newline. A test for each is a search for one byte pattern, much faster than a pattern of all.
_OTHER_SPACE = tuple(map(chr, (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _byte_of_letter() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PieceEncoder:
    """``encode(text)`` and ``encode_all(texts)`` give the ids as bytes: unsigned 32-bit, little-endian."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        alphabet = _byte_of_letter()
        sizes = {i: len(w) for w, i in self._tok.get_vocab(with_added_tokens=True).items()}
        # each letter of a token's name is one byte of text, so lengths of names are lengths of text
        self._bytes = np.zeros(max(sizes) + 1, np.int64)
        self._bytes[list(sizes)] = list(sizes.values())
        self._letters = all(c in alphabet for w in self._tok.get_vocab(with_added_tokens=False) for c in w)
        self._special = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._max = max_pieces
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Remember the ids of pieces that are not among the young."""
        young, old = self._young, self._old
        known = list(filter(old.__contains__, new))  # an intersection with a dict would pass over all of it
        young.update(zip(known, map(old.__getitem__, known)))
        unknown = new.difference(known)
        inner = [p for p in unknown if p[0] in " \n" and p[-1] not in " \n"] if self._letters else []
        if len(inner) > 1:  # a row of pieces is one text, cut again where the pieces end
            raw = self._whole(["".join(inner)])[0]
            ids = np.frombuffer(raw, "<u4")
            sizes = np.fromiter(map(len, map(str.encode, inner)), np.int64, len(inner))
            ends = (4 * np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(sizes), "left") + 4).tolist()
            young.update(zip(inner, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            unknown.difference_update(inner)
        if unknown:
            rest = list(unknown)
            young.update(zip(rest, self._whole(rest)))

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        odd = [any(c in t for c in _OTHER_SPACE) or any(s in t for s in self._special) for t in texts]
        cut = [() if o else _PIECES.findall(t) for o, t in zip(odd, texts)]
        found = [list(map(self._young.get, pieces)) for pieces in cut]
        if new := set().union(*(compress(pieces, map(not_, ids)) for pieces, ids in zip(cut, found) if None in ids)):
            self._learn(new)
        for pieces, ids in zip(cut, found):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = self._young[pieces[at]]
        if len(self._young) > self._max:
            self._old, self._young = self._young, {}
        return [self._whole([t])[0] if o else b"".join(ids) for o, t, ids in zip(odd, texts, found)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; texts of GROUP_CHARS characters learn their new pieces together."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def encoder(path: str | None = None, max_pieces: int = MAX_PIECES) -> PieceEncoder:
    """One encoder per worker and vocabulary; None: the public 50k byte-level vocabulary."""
    return held(("encoder", path, max_pieces), lambda: PieceEncoder(path or default_path(), max_pieces))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
