"""Secret scans over a history of files, with a ledger of what has been scanned.

Every version of a file is known by the SHA-256 of its text, its blob. The ledger, Parquet files in a folder, has a row for
each scan of a blob: the rules that ran, each with its version, and the spans they found. A scan takes the blobs of the
versions at hand, leaves out the pairs of blob and rule version that the ledger has, reads the texts of the others once
each, however many paths and versions hold them, appends what it finds, and joins the ledger's findings back to all paths.
A new rule, or a new version of one, is run alone on the blobs that older rules have seen.

Only digests are shuffled to find out what is unseen. Of each unseen blob one version is its carrier; a bit array of the
carriers keeps most other texts from the shuffle that brings each blob's text to one task, and copies are merged before
it. Findings are joined back by ``common.spread_join``, so one blob may be at any number of paths. Files are appended by
Spark's commit: a scan that fails leaves the ledger as it was, and rows that two scans at once both add are merged on reading.

Cases: a null text is empty; null paths and versions are paths and versions of their own; repeated rows are one blob and
give a row each; texts of any length are scanned whole, in time linear in it; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitset import filter_of, may_hold
from .common import materialise, spread_join


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are secrets if its group ``group`` has ``least`` characters; ``hints``: one of these stands in any text with a match."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    ignore_case: bool = False

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


# The three kinds of the contract, then token formats that their issuers publish.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "api"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",)),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]++", 0, 32),
)
ISSUED = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+-----END [A-Z ]*PRIVATE KEY-----)?", hints=("PRIVATE KEY-----",)),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", hints=("eyJ",)),
    Rule("github", 1, r"(?<![A-Za-z0-9])(?:gh[oprsu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82})(?![A-Za-z0-9_])", hints=("gh",)),
    Rule("slack", 1, r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{20,}+", hints=("xox",)),
    Rule("google", 1, r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", hints=("AIza",)),
)
RULES = BASE + ISSUED

LEDGER = "blob binary, rules array<string>, found array<struct<rule:string,start:long,end:long>>"


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self._rules = {r.id: (r, re.compile(self._longest(r), re.ASCII | (re.IGNORECASE if r.ignore_case else 0))) for r in rules}

    @staticmethod
    def _longest(rule: Rule) -> str:
        return rule.pattern[:-2] + "{%d,}+" % rule.least if rule.pattern.endswith("++") and rule.group == 0 and rule.least else rule.pattern

    def scan(self, text: str, todo: Sequence[str]) -> list[tuple[str, int, int]]:
        """(rule, start, end) in code points: leftmost matches of each rule that do not overlap and are long enough."""
        out, low = [], None
        for name in todo:
            rule, pattern = self._rules[name]
            if rule.ignore_case and low is None:
                low = text.lower()
            if rule.hints and not any(h in (low if rule.ignore_case else text) for h in rule.hints):
                continue
            for m in pattern.finditer(text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out.append((name, *m.span()))
        return out


_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan_batches(rules: Sequence[Rule]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = [[{"rule": r, "start": a, "end": b} for r, a, b in scanner.scan(t, todo)] for t, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, _FOUND)], names=["blob", "rules", "found"])

    return scan


class Ledger:
    """The scans of blobs in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)

    def rows(self) -> DataFrame:
        return self._spark.read.schema(LEDGER).parquet(self.path)

    def unseen(self, blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """blobs, whose column blob is unique, with todo: the rules' ids that have not run on a blob; rows without any are left out."""
        known = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))  # a blob has a row for each scan with a new rule
        ids = F.array(*(F.lit(r.id) for r in rules))
        todo = F.array_except(ids, F.coalesce("known", F.array().cast("array<string>")))
        return blobs.join(known, "blob", "left").withColumn("todo", todo).drop("known").where(F.size("todo") > 0)

    def append(self, scanned: DataFrame) -> None:
        scanned.write.mode("append").parquet(self.path)

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """(blob, spans): what the rules, in their versions, have found; a row for each blob with a find, spans in order of place and rule."""
        names = F.array(*(F.lit(r.name) for r in rules))
        of = self.rows().select("blob", F.filter("found", lambda x: F.array_contains(F.array(*(F.lit(r.id) for r in rules)), x["rule"])).alias("found")).where(F.size("found") > 0)
        plain = lambda x: F.element_at(F.split(x["rule"], "@"), 1)
        keyed = F.transform(F.array_distinct(F.flatten(F.collect_list("found"))), lambda x: F.struct(x["start"].alias("start"), F.array_position(names, plain(x)).alias("nth"), x["end"].alias("end"), plain(x).alias("rule")))
        spans = F.transform(F.array_sort(keyed), lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end")))
        return of.groupBy("blob").agg(spans.alias("spans"))


def scan_history(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES, path_col: str = "path", version_col: str | None = None, text_col: str = "text") -> DataFrame:
    """(path, version, blob, spans) for every row of versions; what the ledger does not know is scanned and added to it."""
    version = F.col(version_col) if version_col else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), version.alias("version"), text.alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2("text", 256)))
    ids, _ = materialise(rows.select("path", "version", "blob"), "versions")
    blobs, _ = materialise(ids.groupBy("blob").agg(F.count("*").alias("n"), F.min(F.struct("path", "version")).alias("carrier")), "blobs")
    unseen, _ = materialise(ledger.unseen(blobs, rules).drop("n"), "unseen")
    carrier = lambda p, v: F.xxhash64("blob", p, v)
    found, bits = filter_of(unseen.select(carrier("carrier.path", "carrier.version").alias("f")), unseen.count())
    carried = rows.withColumn("set", found).where(may_hold(F.col("set"), carrier("path", "version"), bits))
    texts = carried.groupBy("blob").agg(F.any_value("text").alias("text")).join(unseen.select("blob", "todo"), "blob")
    ledger.append(texts.select("blob", "text", "todo").mapInArrow(_scan_batches(rules), LEDGER))
    known = ledger.findings(rules).join(blobs.select("blob", F.col("n").alias("__weight")), "blob")
    known, _ = materialise(known, "findings")
    none = F.array().cast(known.schema["spans"].dataType)
    back = spread_join(ids, known, ["blob"], "__weight", "left")
    return back.select("path", "version", F.lower(F.hex("blob")).alias("blob"), F.coalesce("spans", none).alias("spans"))
