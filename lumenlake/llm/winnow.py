"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A window is 13 consecutive words of a benchmark item (an item with fewer words is one window). Each text keeps the
least hash of every K-gram window of W positions, so any 13 shared words share a kept fingerprint. Kept fingerprints of
the documents pass a bit array of the benchmark's (of bounded size; a larger benchmark fills it further), join
the benchmark's by hash, and each hit is extended to its whole window of words, which are compared one by one. Windows
that touch or overlap join into spans.

Everything of a document happens inside its row up to the join; after it only hits are shuffled, one key a document, so
neither a passage that most documents share nor one hot source gathers in a task. Equal windows of many items meet the
documents once, with the list of their items.

Cases: a null or empty text has no words and is clean; an item without words has no window, a null item_id counts as a
hit but not as an item; repeated rows of documents are judged alike and each returned; an empty benchmark finds nothing;
texts with the same id are told apart by their hash; a text of any length is worked on whole, within its row; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitset import filter_of, may_hold
from .common import free_name, materialise, texts_of
from .reputation import LOWER, UPPER

SPAN, K = 13, 5
W = SPAN - K + 1  # any SPAN words hold W K-grams, one of which is kept
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Low bits of a fingerprint tell its place, the others its hash.
PLACE_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often a lambda in body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _upto(n: Column) -> Column:
    """0 to n - 1, empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _grams(words: Column) -> Column:
    """For each K-gram of words its hash above its place, so that the least of a window is its leftmost least hash."""
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    mask = F.lit((1 << PLACE_BITS) - 1)
    gram = lambda h, i: F.xxhash64(*(F.get(h, i + j) for j in range(K)))
    return let(hashes, lambda h: F.transform(_upto(F.size(h) - K + 1), lambda i: F.shiftleft(F.shiftright(gram(h, i), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long").bitwiseAND(mask))))


def _least(grams: Column) -> Column:
    """The least gram of each window of W."""
    return let(grams, lambda g: F.transform(_upto(F.size(g) - W + 1), lambda i: F.array_min(F.slice(g, i + 1, F.lit(W)))))


def _hash(gram: Column) -> Column:
    return F.shiftright(gram, PLACE_BITS)


def _place(gram: Column, window: Column) -> Column:
    """The place of a window's least gram, which is at or after the window's."""
    size = 1 << PLACE_BITS
    return window + F.pmod(gram.bitwiseAND(F.lit(size - 1)) - window, F.lit(size)).cast("int")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, words, items): the different windows of all items, each with the sorted ids of the items that hold it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    n = F.size("w")
    starts = F.when(n < SPAN, F.array(F.lit(0))).otherwise(_upto(n - SPAN + 1))
    windows = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s") + 1, F.lit(SPAN)).alias("words"))
    return windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("size", F.size("words"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, key (hash of the text), n_words, n_hit, items (sorted ids), spans (runs of hit words)."""
    windows = benchmark_windows(benchmark, item_col, item_text_col)
    long_ones = windows.where(F.col("size") == SPAN).select("words", "items", "size", _least(_grams(F.col("words")))[0].alias("v"))
    long_ones = long_ones.select(_hash(F.col("v")).alias("f"), "size", _place(F.col("v"), F.lit(0)).alias("off"), F.col("words").alias("want"), "items")
    short_ones = windows.where(F.col("size") < SPAN).select(F.xxhash64("words").alias("f"), "size", F.lit(0).alias("off"), F.col("words").alias("want"), "items")
    # counts of the benchmark, not of the documents: they choose the plan
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}

    found, bits = filter_of(long_ones, sizes.pop(SPAN, 0))
    rows = texts_of(docs, id_col, text_col).withColumn("set", found)
    passes = lambda f: may_hold(F.col("set"), f, bits)

    def hit_of(w: Column, least: Column, i: Column) -> Column:
        p = _place(F.get(least, i), i)
        low = F.greatest(p - (SPAN - K), F.lit(0))
        return _candidate(_hash(F.get(least, i)), SPAN, p, low, F.slice(w, low + 1, p + SPAN - low))

    def long_hits(w: Column) -> Column:
        changes = lambda least, i: (i == 0) | (F.get(least, i) != F.get(least, i - 1))
        kept = lambda least: F.filter(_upto(F.size(least)), lambda i: changes(least, i) & passes(_hash(F.get(least, i))))
        return let(_least(_grams(w)), lambda least: F.transform(kept(least), lambda i: hit_of(w, least, i)))

    short_hits = []
    if sizes:
        found_short, bits_short = filter_of(short_ones, sum(sizes.values()))
        rows = rows.withColumn("short_set", found_short)
        for m in sorted(sizes):

            def of_size(w: Column, m: int = m) -> Column:
                gram = lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(m)))
                at = F.filter(_upto(F.size(w) - m + 1), lambda i: may_hold(F.col("short_set"), gram(i), bits_short))
                return F.transform(at, lambda i: _candidate(gram(i), m, i, i, F.slice(w, i + 1, F.lit(m))))

            short_hits.append(of_size)
    # a document's first row is itself: of size 0, so that it meets no window, and with a hash that spreads
    itself = F.array(_candidate(F.xxhash64("doc_id", "text"), 0, F.lit(0), F.lit(0), F.array().cast("array<string>")))
    found_in = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.concat(itself, long_hits(w), *(h(w) for h in short_hits)).alias("hits")))
    each = rows.select("doc_id", F.xxhash64("text").alias("key"), found_in.alias("x")).select("doc_id", "key", "x.n_words", F.explode("x.hits").alias("hit")).select("doc_id", "key", "n_words", "hit.*")

    marks = (long_ones.unionByName(short_ones) if sizes else long_ones).withColumnsRenamed({"f": "want_f", "size": "want_size"})
    start = F.col("p") - F.col("off") - F.col("low")
    same = F.when(start >= 0, F.slice("near", F.greatest(start, F.lit(0)) + 1, F.col("want_size"))) == F.col("want")
    met = each.join(marks, (F.col("f") == F.col("want_f")) & (F.col("size") == F.col("want_size")) & same, "left").where("size = 0 or want is not null")
    hit = F.when(F.col("size") > 0, F.struct((F.col("p") - F.col("off")).alias("s"), (F.col("p") - F.col("off") + F.col("want_size")).alias("e")))
    by_doc = met.groupBy("doc_id", "key", "n_words").agg(F.collect_set(hit).alias("at"), F.collect_set("items").alias("lists"), F.count_if(F.col("size") == 0).alias("copies"))
    return by_doc.select(
        "doc_id", "key", F.col("n_words").cast("long").alias("n_words"), _covered(F.array_sort("at")).alias("spans"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"), F.explode(_upto(F.col("copies"))).alias("copy")
    ).select("doc_id", "key", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"]).alias("n_hit"), "items", "spans")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with the same columns."""
    found = contamination(docs, benchmark, id_col, text_col)
    bad, _ = materialise(found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct(), "contaminated")
    marks, bits = filter_of(bad.select(F.xxhash64("bad_id", "bad_key").alias("f")), bad.count())
    own, key = free_name(docs, "set"), F.xxhash64(docs[text_col].cast("string"))
    # most rows are none of the bad ones by the bit array, and are not shuffled
    marked = docs.withColumn(own, may_hold(marks, F.xxhash64(docs[id_col].cast("long"), key), bits))
    near = marked.where(F.col(own)).drop(own)
    same = near[id_col].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(near[text_col].cast("string")) == bad["bad_key"])
    return marked.where(~F.col(own)).drop(own).unionByName(near.join(bad, same, "left_anti"))


def _candidate(f: Column, size: int, p: Column, low: Column, near: Column) -> Column:
    """A fingerprint of hash f at word p and the words near it, from word low on."""
    return F.struct(f.alias("f"), F.lit(size).alias("size"), p.cast("int").alias("p"), low.cast("int").alias("low"), near.alias("near"))


def _covered(sorted_hits: Column) -> Column:
    """Spans of hit words: sorted hits that touch or overlap joined."""
    kind = "array<struct<s:int,e:int>>"
    joined = lambda a, h: F.when(
        (F.size(a) > 0) & (h["s"] <= F.element_at(a, -1)["e"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.named_struct(F.lit("s"), F.element_at(a, -1)["s"], F.lit("e"), F.greatest(F.element_at(a, -1)["e"], h["e"])))),
    ).otherwise(F.concat(a, F.array(h)))
    return F.aggregate(sorted_hits, F.array().cast(kind), joined)
