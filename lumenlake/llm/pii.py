"""PII with offset-preserving deobfuscation.

Plain identifiers are found in the source text itself. Then three transducers rewrite disguises, one after the other:
homoglyphs and zero-width characters by tables, escapes of signs, spelled digits by the runs they stand in, at and dot words by the
address around them. Each keeps a map of positions, piece by piece, and the maps are composed. The same detectors run on
the last text; a span found there counts if it holds something rewritten, and is mapped back to the characters of the
source. All of it is per row: no shuffle, no state, memory bounded by one Arrow batch. No rule has an upper limit of
length; every scan is linear in the text.

What a spelled run becomes: four groups with dots between are an IP address; 16 to 19 digits that pass Luhn a card; 8 to
15 digits after "plus", or 7 to 15 not all equal of which most are words, a phone number. A run that is none of these is tried again in
the parts between its commas, full stops and line ends. An address needs a mark for "at" (a bracketed word, "@" or a bare
word) and a dot that is plain, bracketed or a bare word, at least one of them disguised. Its last label may be any word
if "at" or a dot is bracketed or "@" is plain; a bare "at" before plain dots needs one of ENDS, and before bare dot words
labels that are no common words.

Cases: a null or empty text has no spans; null ids, repeated rows and ties pass through; other columns of the input
are not read; an empty table gives an empty table; a span is never longer than the text it lies in.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, texts_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# Digits that start inside a run cannot match where the run's first digit does not, so a match may only begin a run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each is found from its @, so long runs of letters cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        else:  # no later start can use this run either: it ends in the same @
            end = max(end, start)
        at = text.find("@", max(end, at + 1))
    return out


def detect(text: str, least_phone: int = 8) -> dict[str, list[tuple[int, int]]]:
    """Identifiers that stand plainly in the text, by kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGITS.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if least_phone <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return found


# Letters of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "․": ".", "。": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
# Letters and digits that Unicode says are another form of an ASCII one: mathematical, circled, superscript, full-width.
_FOLD |= {c: n for c in range(0x100, 0x20000) if c not in _FOLD and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii() and (n.isalnum() or n in "@.+-_%")}
_FOLD |= {start + i: str(i) for start in (0x0660, 0x06F0, 0x0966) for i in range(10)}  # Arabic-Indic, Persian, Devanagari digits
# Characters without width.
_ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Fixed values: "@" and "." as character references and percent escapes.
_ESCAPED = r"(?i:(?P<at>&#0*64;|&#x0*40;|&commat;|%40)|(?P<dot>&#0*46;|&#x0*2e;|&period;|%2e))"
_FOLDED = re.compile(f"(?P<none>[{_ZERO_WIDTH}]+)|{_ESCAPED}|[{''.join(re.escape(chr(c)) for c in _FOLD)}]+")

# Digits spelled in the four languages of the corpus.
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
# Digits that are common words besides; alone they make no run.
SPELLED_WEAK = {"oh": 0, "null": 0, "un": 1, "une": 1, "ein": 1, "eine": 1}
_DIGIT_OF = {**SPELLED, **SPELLED_WEAK}

# Words for the signs of addresses, without and with other common meanings.
_AT_WORDS, _DOT_WORDS, _DOT_WEAK = ("at", "arroba", "arobase"), ("dot", "punto", "punkt"), ("point",)
# Ends of names that a bare "at" with plain dots must have.
ENDS = frozenset("com org net edu gov info biz io co dev app de fr es uk it nl eu ch at us ca jp pl ru se me ai example test invalid".split())
# Words that are no part of an address whose signs are bare words; "look at this dot here" is none.
_COMMON = frozenset(
    "the a an this that these those one some any every each which what his her its our their my your and or then us me him them it you i we he she they look is are was were be not here there now".split()
) | frozenset(_DIGIT_OF)


def _any(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


# All patterns from here on are for texts in lower case.
_OPEN, _CLOSE = r"[\[({<]\s*+", r"\s*+[\])}>]"
_IN_DOT = rf"{_OPEN}(?:{_any(_DOT_WORDS + _DOT_WEAK)}|\.){_CLOSE}"
_DOT = rf"(?:\s*+{_IN_DOT}\s*+|\s++(?:{_any(_DOT_WORDS + _DOT_WEAK)})\s++|\.)"
_AT_MARK = re.compile(rf"{_OPEN}(?:{_any(_AT_WORDS)}|@){_CLOSE}|(?<=\s)(?:{_any(_AT_WORDS)})(?=\s)|@")
_AT_IN = re.compile(rf"\s*+{_OPEN}(?:{_any(_AT_WORDS)}|@){_CLOSE}")
_DOMAIN_MARKED = re.compile(rf"\s*+[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++")
_STEP = re.compile(rf"{_DOT}|[A-Za-z0-9_%+-]++")
# The same from right to left, on the text turned round.
_TOD = rf"(?:\s*+[\])}}>]\s*+(?:{_any(w[::-1] for w in _DOT_WORDS + _DOT_WEAK)}|\.)\s*+[\[({{<]\s*+|\s++(?:{_any(w[::-1] for w in _DOT_WORDS + _DOT_WEAK)})\s++|\.)"
_LOCAL_TURNED = re.compile(rf"\s*+[A-Za-z0-9_%+-]++(?:{_TOD}[A-Za-z0-9_%+-]++)*+")
_SIGN = re.compile(rf"{_OPEN}(?:{_any(_AT_WORDS + _DOT_WORDS + _DOT_WEAK)}|[@.]){_CLOSE}")

_NUMERAL = rf"(?:(?:{_any(_DIGIT_OF)})(?!\w)|[0-9]++(?![^\W0-9_]))"
_BETWEEN = rf"(?:\s*+{_IN_DOT}\s*+|\s++(?:{_any(_DOT_WORDS + _DOT_WEAK)})\s++|[\s,./-]++)"
_RUN = re.compile(rf"(?<![\w+])(?:(?:plus\s++|\+\s*+))?{_NUMERAL}(?:{_BETWEEN}{_NUMERAL})++")
_RUN_STEP = re.compile(rf"(?P<dot>\s*+{_IN_DOT}\s*+|\s++(?:{_any(_DOT_WORDS + _DOT_WEAK)})\s++)|(?P<gap>[\s,./-]++)|(?P<word>[^\W\d_]++)|(?P<digits>[0-9]++)|(?P<plus>\+)")
_MARKS = ",./-;:!?()[]{}<>\"'"

Edit = tuple[int, int, str, bool]


class Rewrite:
    """A text after edits (start, end, new text, aligned), with the way back.

    Positions inside an aligned edit, and outside of edits, map to the character they came from, others to the whole edit.
    """

    def __init__(self, source: str, edits: list[Edit]):
        out, self.starts, self.spans, at, size = [], [], [], 0, 0
        self.edited: list[tuple[int, int]] = []
        for a, b, new, aligned in [*edits, (len(source), len(source), "", True)]:
            for piece, x, y, kept in ((source[at:a], at, a, True), (new, a, b, aligned)):
                if piece:
                    self.starts.append(size)
                    self.spans.append((x, y, kept))
                    out.append(piece)
                    size += len(piece)
            if a < b:
                self.edited.append((size - len(new), size))
            at = b
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, _, kept), (c, d, kept_end) = self.spans[i], self.spans[j]
        return a + (start - self.starts[i]) * kept, c + end - self.starts[j] if kept_end else d

    def touched(self, start: int, end: int) -> bool:
        """Whether a span of the text holds or borders on something rewritten."""
        i = bisect_right(self.edited, (end, len(self.text) + 1)) - 1
        return i >= 0 and self.edited[i][1] >= start and (self.edited[i][0] < end or self.edited[i][0] == self.edited[i][1])


def fold_edits(text: str) -> list[Edit]:
    """Runs of homoglyphs become the letters they look like, escapes the signs they stand for; characters without width go."""
    plain = {"none": "", "at": "@", "dot": "."}
    return [(*m.span(), plain[m.lastgroup], False) if m.lastgroup else (*m.span(), m[0].translate(_FOLD), True) for m in _FOLDED.finditer(text)]


def _number(tokens: list[tuple[str, int, int, str]]) -> str | None:
    """What the tokens (kind, start, end, text) of a run stand for, None if nothing."""
    words = [t for k, _, _, t in tokens if k == "word"]
    digits = "".join(str(_DIGIT_OF[t]) if k == "word" else t for k, _, _, t in tokens if k in ("word", "digits"))
    if not any(w in SPELLED for w in words):
        return None
    if 16 <= len(digits) <= 19 and luhn(digits):
        return digits
    if any(k == "plus" for k, *_ in tokens):
        return "+" + digits if 8 <= len(digits) <= 15 else None
    groups = sum(k == "digits" for k, *_ in tokens)
    return "+" + digits if 7 <= len(digits) <= 15 and len(set(digits)) > 1 and len(words) > groups and 2 * sum(w in SPELLED for w in words) >= len(words) else None


def _addresses(tokens: list[tuple[str, int, int, str]]) -> list[Edit]:
    """IP addresses in a run: four groups in a row with dots between, of which something is disguised."""
    groups: list[list] = []  # [start, end, digits, disguised, a dot follows, the dot is disguised]
    for k, a, b, t in tokens:
        if k in ("word", "digits"):
            d = str(_DIGIT_OF[t]) if k == "word" else t
            if groups and groups[-1][4] is None and groups[-1][3] == (k == "word"):  # words and figures make no group together
                groups[-1][1:3] = b, groups[-1][2] + d
            else:
                groups.append([a, b, d, k == "word", None, False])
        elif groups:
            groups[-1][4:] = (True, True) if k == "dot" else (True, False) if t == "." else (None, False) if not t.strip() else (False, False)
    out, i = [], 0
    while i + 4 <= len(groups):
        g = groups[i : i + 4]
        if all(x[4] for x in g[:3]) and all(len(x[2].lstrip("0")) <= 3 and int(x[2]) <= 255 for x in g) and (any(x[3] for x in g) or any(x[5] for x in g[:3])):
            out.append((g[0][0], g[3][1], ".".join(x[2] for x in g), False))
            i += 4
        else:
            i += 1
    return out


def number_edits(text: str) -> list[Edit]:
    """Runs of spelled digits become what they stand for."""
    edits: list[Edit] = []
    text = lowered(text)
    for m in _RUN.finditer(text):
        tokens = []
        for x in _RUN_STEP.finditer(text, *m.span()):
            kind, word = x.lastgroup, x[0]
            tokens.append(("plus" if word == "plus" else kind, *x.span(), word))
        found = _addresses(tokens)
        if not found and (new := _number(tokens)):
            found = [(*m.span(), new, False)]
        if not found and (m[0][-1].isalpha() or m[0][0].isalpha()) and (mark := _AT_IN.match(text, m.end())):  # the end of an address's first part
            tail = [i for i, t in enumerate(tokens) if t[0] == "dot" or t[0] == "gap" and t[3].strip()]
            last = tokens[tail[-1] + 1 if tail else 0 :]
            digits = [str(_DIGIT_OF.get(t, t)) for k, _, _, t in last if k in ("word", "digits")]
            if mark and len(digits) > 1:
                found = [(last[0][1], last[-1][2], "".join(digits), False)]
        if not found:  # part by part
            part: list = []
            for t in [*tokens, ("gap", m.end(), m.end(), "\n")]:
                if t[0] == "dot" or t[0] == "gap" and any(c in t[3] for c in ",./\n"):
                    if len(part) > 1 and (new := _number(part)):
                        found.append((part[0][1], part[-1][2], new, False))
                    part = []
                elif t[0] != "gap" or part:
                    part.append(t)
        edits += found
    return edits


def _domain(text: str, at: int, sign: str) -> tuple[int, int, str] | None:
    """(start, end, plain form) of the name after a sign for "at": "in" (bracketed), "bare" or "@"."""
    if not (m := _DOMAIN_MARKED.match(text, at)):
        return None
    steps = [x for x in _STEP.finditer(text, *m.span()) if x[0].strip()]
    labels, dots = steps[::2], steps[1::2]
    kind = ["plain" if d[0] == "." else "in" if d[0].strip()[0] in "[({<" else "bare" for d in dots]
    n = len(labels)
    fits = lambda w: len(w) > 1 and w[0].isalpha()
    while n > 1:
        last, used = labels[n - 1][0], kind[: n - 1]
        if sign == "bare" and "in" not in used:
            if "bare" in used:
                weak = any(d[0].strip() in _DOT_WEAK for d in dots[: n - 1])
                good = last in ENDS if weak else fits(last)
                good &= not any(x[0] in _COMMON for x in labels[: n - 1]) and (last in ENDS or last not in _COMMON)
            else:
                good = last in ENDS and labels[0][0] not in _COMMON
        else:
            good = fits(last) and not (kind[n - 2] == "bare" and last in _COMMON - ENDS)
        if good and (sign != "@" or set(used) != {"plain"}):
            return labels[0].start(), labels[n - 1].end(), ".".join(x[0] for x in labels[:n])
        n -= 1
    return None


def address_edits(text: str) -> list[Edit]:
    """Addresses with words or brackets for their signs become plain ones."""
    edits: list[Edit] = []
    text = lowered(text)
    turned, end = text[::-1], 0
    for m in _AT_MARK.finditer(text):
        if m.start() < end:
            continue
        sign = "@" if m[0] == "@" else "in" if m[0][0] in "[({<" else "bare"
        low = _LOCAL_TURNED.match(turned, len(text) - m.start(), len(text) - end)
        if not low or sign == "@" and low[0][0].isspace():
            continue
        if (name := _domain(text, m.end(), sign)) is None and sign != "@":
            continue
        parts = [x for x in _STEP.finditer(text, len(text) - low.end(), m.start()) if x[0].strip()]
        words, dots = parts[::2], parts[1::2]
        first = len(words) - 1  # bare dot words join no common words
        while first > 0 and (dots[first - 1][0] == "." or dots[first - 1][0].strip()[0] in "[({<" or words[first - 1][0] not in _COMMON):
            first -= 1
        marked = any(d[0] != "." for d in dots[first:])
        if name is None:
            if not marked or not (plain := _DOMAIN.match(text, m.end())):
                continue
            name = (*plain.span(), plain[0])
        if sign == "bare" and not marked and words[-1][0] in _COMMON and first == len(words) - 1:
            continue
        if sign == "bare" and not any(c.isalpha() for x in words[first:] for c in x[0]):
            continue
        a, end = words[first].start(), name[1]
        edits.append((a, end, ".".join(x[0] for x in words[first:]) + "@" + name[2], False))
    return edits


def lowered(text: str) -> str:
    """The text in lower case, character by character: none becomes two."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_NUMERALS, _DOTS, _SIGN_WORDS = frozenset(SPELLED), frozenset(_DOT_WORDS + _DOT_WEAK), frozenset(_AT_WORDS + _DOT_WORDS + _DOT_WEAK)


def deobfuscated(text: str) -> list[Rewrite]:
    """The rewrites, each of the text of the one before it, that change anything."""
    chain: list[Rewrite] = []

    def step(hint: bool, edits) -> None:
        now = chain[-1].text if chain else text
        if hint and (made := edits(now)):
            chain.append(Rewrite(now, made))

    escaped = any(x in text for x in ("&#", "%40", "%2", "&commat;", "&period;"))
    step(escaped or not _latin(text) or "\u00ad" in text, fold_edits)  # no homoglyph is a Latin-1 character
    now = chain[-1].text if chain else text
    low = plain = lowered(now)
    for c in _MARKS:
        plain = plain.replace(c, " ")
    words, signs = set(plain.split()), _SIGN.search(low) is not None
    step(signs or not words.isdisjoint(_NUMERALS) or not words.isdisjoint(_DOTS) and _DIGIT.search(now) is not None, number_edits)
    step(signs or not words.isdisjoint(_SIGN_WORDS), address_edits)
    return chain


def find(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(plain spans, spans that only deobfuscation shows), by kind, in code points of the source, ends exclusive."""
    text = text or ""
    base = detect(text)
    more: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if chain := deobfuscated(text):
        taken = sorted(x for spans in base.values() for x in spans)
        for kind, spans in detect(chain[-1].text, 7).items():
            for start, end in spans:
                new = False
                for rewrite in reversed(chain):
                    new |= rewrite.touched(start, end)
                    start, end = rewrite.back(start, end)
                # a span may widen plain ones that a disguise cut short, but not repeat them or cut across
                if new and not any(a < end and start < b and not (start <= a and b <= end and b - a < end - start) for a, b in taken):
                    more[kind].append((start, end))
    return base, more


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first wins and widens."""
    if not text:
        return text
    base, more = find(text)
    spans = sorted((a, b, k) for x in (base, more) for k, v in x.items() for a, b in v)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


SPAN_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string, spans string, n_added long"


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column(0), []
        for text in batch.column(1).to_pylist():
            base, more = find(text)
            plain = _written(base)
            rows.append((*(len(base[k]) for k in KINDS), plain, sha256(plain.encode()).hexdigest(), _written({k: base[k] + more[k] for k in KINDS}), sum(map(len, more.values()))))
        cols = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), t) for c, t in zip(cols, kinds))], names=[x.split()[0] for x in SPAN_SCHEMA.split(", ")])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: plain spans counted and digested, and all spans with those that were disguised."""
    return texts_of(docs, id_col, text_col).mapInArrow(_find_batches, SPAN_SCHEMA)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the same columns, personal data in text_col replaced by its kind."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # any name can be in docs, not in a function over batches
    plain = plain.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    def mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            yield batch.set_column(at, f"c{at}", pa.array([masked(t) for t in batch.column(at).to_pylist()], pa.string()))

    return plain.mapInArrow(mask_batches, plain.schema).toDF(*docs.columns)
