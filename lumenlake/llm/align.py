"""Alignment of the tokens of two tokenisers, and how well their ids stand for one another over a corpus.

Both tokenisers cut the same bytes. A transducer reads the two sequences of tokens: its state is the side that leads and
the bytes by which it does, the dangling suffix of the last token of that side. It always reads the next token of the side
behind, which must begin with the dangling bytes or be a beginning of them; what is left over dangles next, on the one side
or the other. Where nothing dangles a group of tokens closes. Each token that is read while something dangles overlaps the
leading token, and no other one of that side: that is a link. Transitions are remembered by state and token, residuals
being numbered as they come up.

Both tokenisers must cut a text before a run of spaces and newlines, so a group never spans such a place, and the groups
of a word with the white space before it are remembered too. New words of a text are joined and go through both
tokenisers and the transducer at once. Texts with other white space go through as a whole.

A pair of ids counts once for each document that links it. Counts are summed in the shuffle; the pairs that hold the
most (document, pair) rows, HOT of them at most because the counts sum to the rows, are broadcast, and the rows of the rest
are shuffled by their pair. The highest count of each id of the first side is a table of at most its vocabulary.

Cases: null and empty texts, and texts whose bytes one of the tokenisers does not give back, have no tokens and no links;
repeated rows and null ids are documents of their own; texts of any length are aligned whole; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialise, spread_join, texts_of
from .tokens import _OTHER_SPACE, _byte_of_letter

#: Pairs whose counts are broadcast, at most: 24 bytes each.
HOT = 1 << 18
#: Words and transitions kept in each of two generations, and in all.
MAX_WORDS, MAX_STEPS = 300_000, 4_000_000
#: Links of the documents that go out in one batch, about.
LOT = 1 << 20
_SHIFT = 32

_WORDS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")

#: Links, the ids of both sides in one number, and for each group the tokens of both sides up to its end.
Alignment = tuple[list[int], list[tuple[int, int]]]


class SuffixTransducer:
    """Aligns two sequences of token ids, given each id's bytes."""

    def __init__(self, first: Sequence[bytes], second: Sequence[bytes], max_steps: int = MAX_STEPS):
        self._bytes = (first, second)
        self._max = max_steps
        self._forget()

    def _forget(self) -> None:
        self._states: dict[tuple[int, bytes], int] = {}
        self._of: list[tuple[int, bytes]] = [(0, b"")]  # number 0: nothing dangles
        self._steps: dict[int, int | None] = {}
        self._opened: dict[int, int | None] = {}

    def _state(self, side: int, residual: bytes) -> int:
        """The number of a state: positive where the first side leads, negative where the second does."""
        n = self._states.get((side, residual))
        if n is None:
            n = len(self._of)
            self._of.append((side, residual))
            self._states[side, residual] = n
        return n if side == 0 else -n

    def _step(self, state: int, token: int) -> int | None:
        """The state after the side behind has read a token; None if the bytes differ."""
        side, residual = self._of[abs(state)]
        read = self._bytes[1 - side][token]
        if not read:
            return None
        if residual.startswith(read):
            rest = residual[len(read) :]
            return self._state(side, rest) if rest else 0
        return self._state(1 - side, read[len(residual) :]) if read.startswith(residual) else None

    def run(self, a: Sequence[int], b: Sequence[int]) -> Alignment | None:
        """The links of two sequences and where their groups end; None if their bytes differ."""
        if len(self._steps) > self._max:
            self._forget()
        steps, opened, links, ends = self._steps, self._opened, [], []
        i = j = 0
        try:
            while i < len(a):
                lead = a[i]
                i += 1
                state = opened.get(lead)
                if state is None:
                    state = opened[lead] = self._state(0, self._bytes[0][lead]) if self._bytes[0][lead] else None
                while state:
                    if state > 0:  # the first side leads, the second is read
                        x = b[j]
                        j += 1
                        links.append((lead << _SHIFT) + x)
                        key = (state << _SHIFT) + x
                        now = steps.get(key)
                        if now is None:
                            now = steps[key] = self._step(state, x)
                        if now and now < 0:
                            lead = x
                    else:
                        x = a[i]
                        i += 1
                        links.append((x << _SHIFT) + lead)
                        key = (state << _SHIFT) + x
                        now = steps.get(key)
                        if now is None:
                            now = steps[key] = self._step(state, x)
                        if now and now > 0:
                            lead = x
                    state = now
                if state is None:
                    return None
                ends.append((i, j))
        except IndexError:  # one side ends while the other dangles
            return None
        return (links, ends) if j == len(b) else None


class WordAligner:
    """Aligns texts word by word. A word's entry is (groups as text, links as bytes, tokens of the first side), or None if bytes differ."""

    def __init__(self, byte_level_path: str, piece_path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_level_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = _byte_of_letter()
        vocabulary = self._a.get_vocab(with_added_tokens=True)
        self._first = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            self._first[i] = bytes(map(alphabet.__getitem__, name)) if all(c in alphabet for c in name) else b""
        special = lambda i: self._b.is_control(i) or self._b.is_unknown(i) or self._b.is_unused(i)
        piece = lambda i: bytes([int(self._b.id_to_piece(i)[3:5], 16)]) if self._b.is_byte(i) else self._b.id_to_piece(i).replace("▁", " ").encode()
        self._second = [b"" if special(i) else piece(i) for i in range(self._b.get_piece_size())]
        self._names = [list(map(str, range(len(x)))) for x in (self._first, self._second)]
        self._transducer = SuffixTransducer(self._first, self._second)
        self._ahead = len(self._b.encode("\n"))
        self._max = max_words
        self._young: dict[str, tuple[str, bytes, int] | None] = {}
        self._old: dict[str, tuple[str, bytes, int] | None] = {}

    def _entries(self, text: str, sizes: list[int]) -> list[tuple[str, bytes, int]] | None:
        """The entries of a text's words, given their sizes in bytes. The text begins with white space, as the space before a text."""
        a = self._a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self._b.encode("\n" + text)[self._ahead :]  # no piece holds a newline, so what follows one is cut as if it came first
        if b"".join(map(self._first.__getitem__, a)) != text.encode() or (found := self._transducer.run(a, b)) is None:
            return None
        links, ends = found
        (sa, sb), written, i, j = self._names, [], 0, 0
        for k, m in ends:
            if k - i == 1 == m - j:
                written.append(f"{sa[a[i]]}|{sb[b[j]]}")
            else:
                written.append(f"{','.join([sa[x] for x in a[i:k]])}|{','.join([sb[y] for y in b[j:m]])}")
            i, j = k, m
        if len(sizes) == 1:
            return [(";".join(written), array("q", links).tobytes(), len(a))]
        at = np.array([(0, 0), *ends])
        to = np.cumsum(np.fromiter(map(len, map(self._first.__getitem__, a)), np.int64, len(a)))[at[1:, 0] - 1]
        cuts = np.searchsorted(to, np.cumsum(sizes))
        if not np.array_equal(to[cuts], np.cumsum(sizes)):
            raise ValueError("a group spans two words")
        groups = np.concatenate([[0], cuts + 1])
        raw, n_a = array("q", links).tobytes(), at[groups, 0].tolist()
        upto = (8 * (at[groups].sum(1) - groups)).tolist()  # a group has as many links as tokens, but one
        groups = groups.tolist()
        return [(";".join(written[g:h]), raw[u:v], n - m) for g, h, u, v, m, n in zip(groups, groups[1:], upto, upto[1:], n_a, n_a[1:])]

    def _learn(self, words: list[str]) -> None:
        young, old = self._young, self._old
        unknown = list(filterfalse(young.__contains__, dict.fromkeys(words)))
        if old:
            young.update((w, old[w]) for w in unknown if w in old)
            unknown = list(filterfalse(young.__contains__, unknown))
        row = [w for w in unknown if w[-1] not in " \n"]
        if len(row) > 1 and (entries := self._entries("".join(row), list(map(len, map(str.encode, row))))):
            young.update(zip(row, entries))
            unknown = list(filterfalse(young.__contains__, unknown))
        for w in unknown:
            entries = self._entries(w, [len(w.encode())])
            young[w] = entries[0] if entries else None

    def align(self, text: str | None) -> tuple[str, bytes, int] | None:
        """(groups as text, links as bytes of 64-bit numbers, tokens of the first side); None for texts without tokens."""
        if not text:
            return None
        text = f" {text}"
        if any(c in text for c in _OTHER_SPACE):
            entries = self._entries(text, [len(text.encode())])
            return entries[0] if entries else None
        words = _WORDS.findall(text)
        try:
            found = [self._young[w] for w in words]
        except KeyError:
            self._learn(words)
            found = [self._young[w] for w in words]
            if len(self._young) > self._max:
                self._old, self._young = self._young, {}
        if None in found:
            return None
        return ";".join([f[0] for f in found]), b"".join([f[1] for f in found]), sum([f[2] for f in found])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligner(byte_level_path: str | None = None, piece_path: str | None = None) -> WordAligner:
    """One aligner per worker and pair of vocabularies; None: the public 50k byte-level and 32k piece vocabularies."""

    def make() -> WordAligner:
        a, b = default_paths() if byte_level_path is None or piece_path is None else ("", "")
        return WordAligner(byte_level_path or a, piece_path or b)

    return held(("aligner", byte_level_path, piece_path), make)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def _align_batches(byte_level_path: str | None, piece_path: str | None, keep_groups: bool):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(byte_level_path, piece_path)
        row = TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in ALIGNED.split(", ")]

        def batch_of(rows: list[tuple], pairs: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * 8
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            flat, n = np.concatenate([np.zeros(0, np.int64), *pairs]), np.concatenate([np.zeros(0, np.int32), *times])
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (flat >> _SHIFT, flat & ((1 << _SHIFT) - 1), n)]
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.string()] * 2)), *lists], names=names)

        rows, pairs, times, size = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = worker.align(text.as_py())
                if found is None:
                    rows.append((row, doc_id.as_py(), 0, 0, 0, 0, "", ""))
                    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int32)
                else:
                    written, links, n_a = found
                    groups, keys = written.count(";") + 1, np.frombuffer(links, np.int64)
                    rows.append((row, doc_id.as_py(), n_a, len(keys) + groups - n_a, groups, len(keys), written if keep_groups else None, sha256(written.encode()).hexdigest()))
                    keys, n = np.unique(keys, return_counts=True)
                pairs.append(keys)
                times.append(n.astype(np.int32))
                row, size = row + 1, size + len(keys) + 1
                if size > LOT:
                    yield batch_of(rows, pairs, times)
                    rows, pairs, times, size = [], [], [], 0
        yield batch_of(rows, pairs, times)

    return align


def align(docs: DataFrame, byte_level_path: str | None = None, piece_path: str | None = None, keep_groups: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: numbers of tokens, groups and links, the groups (``a1,a2|b1;a3|b2``) and their digest, and the linked pairs of ids with their numbers of times.

    ``row`` is unique and settled once the result is written.
    """
    return texts_of(docs, id_col, text_col).mapInArrow(_align_batches(byte_level_path, piece_path, keep_groups), ALIGNED)


def _links(aligned: DataFrame) -> DataFrame:
    links = aligned.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    return links.select("row", (F.shiftleft(F.col("a").cast("long"), _SHIFT) + F.col("b")).alias("pair"), "times")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): for each linked pair of ids, a << 32 | b, the documents that hold it, and whether no pair of its first id has more."""
    counts, _ = materialise(_links(aligned).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    counts = counts.withColumn("id", F.shiftright("pair", _SHIFT))
    top = counts.groupBy("id").agg(F.max("n").alias("top"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(top), "id").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scores(aligned: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, n_best, count_sum): of each document with links those that are best for their first id, and the sum of their counts."""
    met = spread_join(_links(aligned), counts.withColumn("__weight", F.col("n")), ["pair"], "__weight", most=hot)
    return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def align_and_score(docs: DataFrame, byte_level_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    aligned, _ = materialise(align(docs, byte_level_path, piece_path, False, id_col, text_col), "aligned")
    counts, _ = materialise(pair_counts(aligned), "pairs")
    sums = scores(aligned, counts).withColumnRenamed("row", "of")
    zero = F.lit(0).cast("long")
    found = aligned.drop("a", "b", "times").join(sums, F.col("row") == F.col("of"), "left")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
