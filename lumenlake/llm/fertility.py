"""Quality rules by tokeniser fertility.

Two public vocabularies measure every whole text: the byte-level BPE gives characters per token, the BPE with byte
fallback gives the share of tokens that are bare bytes and the entropy of the text's tokens. A text is kept if its plain
counts pass and every measure lies within the band of its language, or, if it has none or is not in a script of that
language, within the band of its script. Words are encoded one by one
and remembered, so the cost follows the number of different words; each row is judged alone, without a shuffle.

Cases: a null text has no words and fails, as does an empty one; a null or unknown language takes its script's band;
repeated rows get equal results; a text of any length is measured whole, in memory in proportion to it; other columns are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, slices
from .tokens import default_path

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Lower and upper bound of characters per byte-level token, most bytes per fallback token, least and most entropy in
#: bits per token, by language, then by script; a text of fewer than MIN_TOKENS tokens is too short for the last three.
#: Measured on about 30,000 texts of 500 characters or more, the translated messages of public programs in 100 languages,
#: on random letters of each script, and on the documents of the sf0.1 tables that pass the plain counts. Bounds of
#: languages lie just outside what their own texts reach (the tables' least: en 1.92, de 1.85, fr 1.67, es 1.61), those
#: of scripts outside what the other languages of the script reach. Random letters reach 1.46 to 1.60 characters a token
#: in Latin (base64 1.32), 0.64 in Cyrillic, 0.71 in Greek; rare ideographs, cuneiform and emoji 0.91 or more bytes.
BANDS = {
    "en": (1.75, 6.5, 0.20, 4.2, 11.0),
    "de": (1.70, 6.5, 0.25, 4.2, 11.0),
    "fr": (1.60, 6.5, 0.25, 4.2, 11.0),
    "es": (1.58, 6.5, 0.25, 4.2, 11.0),
    "it": (1.90, 6.5, 0.20, 4.2, 11.0),
    "pt": (1.80, 6.5, 0.20, 4.2, 11.0),
    "nl": (1.80, 6.5, 0.20, 4.2, 11.0),
    "sv": (1.62, 6.5, 0.20, 4.2, 11.0),
    "da": (1.80, 6.5, 0.20, 4.2, 11.0),
    "pl": (1.40, 6.0, 0.20, 4.2, 11.5),
    "cs": (1.25, 6.0, 0.25, 4.2, 11.5),
    "hu": (1.38, 6.0, 0.25, 4.2, 11.5),
    "tr": (1.42, 6.0, 0.20, 4.2, 11.5),
    "vi": (0.75, 4.0, 0.35, 4.2, 11.5),
    "ru": (0.70, 3.5, 0.15, 4.5, 11.5),
    "uk": (0.68, 3.5, 0.15, 4.5, 11.5),
    "el": (0.72, 3.5, 0.15, 4.0, 11.5),
    "ja": (0.65, 3.5, 0.30, 4.5, 12.5),
    "zh": (0.42, 3.0, 0.50, 4.5, 12.5),
    "ko": (0.33, 3.0, 0.45, 4.5, 12.5),
    "Latin": (1.35, 7.0, 0.35, 3.8, 12.5),
    "Latin with marks": (0.70, 7.0, 0.50, 3.8, 12.5),
    "Cyrillic": (0.65, 5.0, 0.35, 4.5, 12.5),
    "Greek": (0.72, 5.0, 0.30, 3.8, 12.5),
    "CJK": (0.33, 4.0, 0.60, 4.5, 13.5),
    "Other": (0.24, 6.0, 0.955, 3.0, 13.5),
}
#: A Latin text is one with marks if of its letters this share or more is not A to Z.
MARKED = 0.08
MIN_TOKENS = 64
#: Plain Latin text of fewer characters a token than the first at fewer bits a token than the second is no language: of
#: 4,164 such texts of 92 languages' messages none under 1.7 characters has less than 5.54 bits, and hexadecimal has 1.61
#: to 1.65 at 4.6 to 4.7.
LATIN_TOGETHER = (1.7, 4.8)

_WORD = re.compile(r"[^ \t-\r]+")
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_LETTER = re.compile(r"[^\W\d_]")
#: Ranges of code points of each script's characters, ends included.
_SCRIPTS = {
    "Cyrillic": ((0x400, 0x52F),),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "CJK": ((0x2E80, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF)),
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
}
#: Scripts that a text of the language is in; a text of another script is judged by its script, whatever its label says.
_WRITTEN = {
    **dict.fromkeys(("en", "de", "fr", "es", "it", "pt", "nl", "sv", "da", "pl", "cs", "hu", "tr", "vi"), ("Latin", "Latin with marks")),
    **dict.fromkeys(("ru", "uk"), ("Cyrillic",)),
    "el": ("Greek",),
    **dict.fromkeys(("ja", "zh", "ko"), ("CJK",)),
}


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    dup = 0
    if "\n" in text:
        dup = sum(n - 1 for line, n in Counter(text.split("\n")).items() if n > 1 and _WORD.search(line))
    if len(words) < 4:
        return chars, symbols, dup, 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(code) + ids[1:]
    if len(code) > 2_000_000:  # the product of three would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(code) + ids[2:]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= twice
    return chars, symbols, dup, int(covered.sum())


class Fertility:
    """Measures of words under both vocabularies, remembered in two bounded generations."""

    MAX_WORDS = 300_000

    def __init__(self, bpe_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._bpe = Tokenizer.from_file(bpe_path)
        self._sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        n = self._sp.get_piece_size()
        self._is_byte = np.fromiter((self._sp.is_byte(i) for i in range(n)), bool, n)
        self._young: dict[str, tuple[int, bytes]] = {}
        self._old: dict[str, tuple[int, bytes]] = {}

    def _learn(self, words: list[str]) -> None:
        unknown = []
        for w in words:
            if w not in self._young:
                if w in self._old:
                    self._young[w] = self._old[w]
                else:
                    unknown.append(w)
        if unknown:
            bpe = self._bpe.encode_batch_fast([" " + w for w in unknown], add_special_tokens=False)
            pieces = self._sp.encode(unknown, num_threads=1)
            self._young.update((w, (len(a), np.asarray(b, "<u4").tobytes())) for w, a, b in zip(unknown, bpe, pieces))

    def measure(self, words: list[str], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, byte-fallback share, entropy in bits per token."""
        try:
            got = list(map(self._young.__getitem__, words))
        except KeyError:
            self._learn(list(dict.fromkeys(words)))
            got = list(map(self._young.__getitem__, words))
        tokens = sum(x[0] for x in got)
        ids = np.frombuffer(b"".join([x[1] for x in got]), "<u4")
        if len(self._young) > self.MAX_WORDS:
            self._old, self._young = self._young, {}
        if not tokens or not len(ids):
            return tokens, 0.0, 0.0, 0.0
        ranked = np.sort(ids)
        n = np.diff(np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))))
        p = n / len(ids)
        return tokens, chars / tokens, float(self._is_byte[ids].mean()), float(-(p * np.log2(p)).sum())


_MARKED, _PLAIN = bytes(range(0xC0, 0x100)), string.ascii_letters.encode()
_ODD = "".join(c for c in map(chr, range(0x80, 0xC0)) if _LETTER.match(c)).encode("latin-1")


def _latin_script(data: bytes) -> str:
    """The script of a text of code points under 256, of which the letters are Latin but for a few signs."""
    marked, plain, odd = (len(data) - len(data.translate(None, some)) for some in (_MARKED, _PLAIN, _ODD))
    if not marked + plain or odd > marked + plain:
        return "Other"
    return "Latin with marks" if marked >= MARKED * (marked + plain) else "Latin"


def script_of(text: str) -> str:
    """The script of most letters of the text, letters of scripts that are not in the list taken together; of equal ones the first."""
    if text.isascii():
        return "Latin" if _LETTER.search(text) else "Other"
    try:
        return _latin_script(text.encode("latin-1"))
    except UnicodeEncodeError:
        pass
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wide = points[points > 127]
    within = {name: [(wide >= a) & (wide <= b) for a, b in ranges if b > 127] for name, ranges in _SCRIPTS.items()}
    counts = {name: sum(int(m.sum()) for m in found) for name, found in within.items()}
    marked = counts["Latin"]
    rest = wide[~np.logical_or.reduce([m for found in within.values() for m in found])]
    low = points[points <= 127] | 32
    counts["Latin"] += int(((low >= 0x61) & (low <= 0x7A)).sum())
    counts["Other"] = len(_LETTER.findall(rest.tobytes().decode("utf-32-le", "surrogatepass"))) if len(rest) else 0
    most = max(counts, key=counts.__getitem__)
    if not counts[most]:
        return "Other"
    return "Latin with marks" if most == "Latin" and marked >= MARKED * counts[most] else most


def band_of(script: str, lang: str | None, bands: dict = BANDS) -> tuple:
    """The band of a text's language, if its script is one of that language's, or else of its script."""
    return bands[lang if lang in bands and script in _WRITTEN.get(lang, (script,)) else script]


def in_band(text: str, lang: str | None, tokens: int, per_token: float, bytes_share: float, entropy: float, bands: dict = BANDS) -> bool:
    script = script_of(text)
    low, high, most_bytes, least, most = band_of(script, lang, bands)
    if not low <= per_token <= high:
        return False
    if tokens < MIN_TOKENS:
        return True
    thin = script == "Latin" and per_token < LATIN_TOGETHER[0] and entropy < LATIN_TOGETHER[1]
    return not thin and bytes_share <= most_bytes and least <= entropy <= most


def _fertility(bpe_path: str | None, piece_path: str | None) -> Fertility:
    import public_tokenizers

    return held(("fertility", bpe_path, piece_path), lambda: Fertility(bpe_path or default_path(), piece_path or public_tokenizers.path("piece_bpe_32k.model")))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double"


def judge(text: str | None, lang: str | None, measures: Fertility) -> tuple:
    text = text or ""
    words = _WORD.findall(text)
    chars, symbols, dup, repeat = base_counts(text, words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    found = measures.measure(words, chars)
    return len(words), chars, symbols, dup, repeat, failed, not failed and in_band(text, lang, *found), *found


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bpe_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """A row for each row of docs: the plain counts, the measures and the verdict."""

    def judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = _fertility(bpe_path, piece_path)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3
        for batch in slices(batches):
            rows = [judge(t, g, measures) for t, g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = list(zip(*rows)) or [()] * 11
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _lang(docs, lang_col).alias("lang")).mapInArrow(judge_batches, SCHEMA)


def _lang(docs: DataFrame, lang_col: str | None) -> Column:
    return F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", bpe_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """The rows of docs that are kept, with the same columns."""
    names = docs.columns
    text_at, lang_at = names.index(text_col), names.index(lang_col) if lang_col in names else None
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # any name can be in docs, not in a function over batches

    def keep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = _fertility(bpe_path, piece_path)
        for batch in slices(batches):
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
            yield batch.filter(pa.array([judge(t, g, measures)[6] for t, g in zip(batch.column(text_at).to_pylist(), langs)], pa.bool_()))

    return plain.mapInArrow(keep_batches, plain.schema).toDF(*names)
