"""Registered queries opN_<name> and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, fertility, ledger, packing, pii, probminhash, reputation, sstable, substrings, trie, warc, winnow
from .common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derive(warc.responses_of(table(spark, sf_dir, "pages")))
    lengths = (F.octet_length("block").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"))
    return found.select(F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", *lengths, "block_digest", "payload_digest")


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_maximal(table(spark, sf_dir, "conversations"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        winnow.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"))


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.encode_and_read(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


#: Fixed by the query's contract.
URL_RULES = tuple(reputation.Rule(*x) for x in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    found = reputation.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicate_classes(table(spark, sf_dir, "documents"), with_links=True).drop("node", "kept_node")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents")).drop("base_spans")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    lent = trie.with_lent_heads(turns, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)
    conversations = table(spark, sf_dir, "conversations").select("conv_id").where("conv_id is not null")
    return trie.prefix_trie(lent, conversations).drop("position", "end_position")


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.scan_history(table(spark, sf_dir, "documents"), ledger.Ledger(spark, scratch_path(spark, "ledger")), path_col="doc_id")
    of = lambda *kinds: F.filter("spans", lambda x: x["rule"].isin(*kinds))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = [r.name for r in ledger.BASE]
    counts = (F.size(of(k)).cast("long").alias(f"n_{k}") for k in base)
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(written(of(*base)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_and_score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_snapshot_collapse": op2_snapshot_collapse,
    "op3_winnowing": op3_winnowing,
    "op4_fertility": op4_fertility,
    "op5_sstable": op5_sstable,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_host_reputation": op7_host_reputation,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_probminhash": op9_probminhash,
    "op10_pii": op10_pii,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_blob_ledger": op12_blob_ledger,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_snapshot_collapse": """
        with c as (
            select conv_id, list_sort(list(distinct struct_pack(turn := turn, role := role, text := text))) as raw from conversations where conv_id is not null group by conv_id
        ),
        t as (select conv_id, raw, list_transform(raw, lambda x: struct_pack(role := x.role, text := x.text)) as turns from c),
        w as (select turns, min(conv_id) as conv_id, count(*) as copies from t group by turns)
        select conv_id, cast(len(turns) as bigint) as n_turns, copies,
            array_to_string(list_transform(turns, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), '') as text
        from w where not exists (select 1 from w as o where len(o.turns) > len(w.turns) and o.turns[1] = w.turns[1] and list_slice(o.turns, 1, len(w.turns)) = w.turns)""",
    "op3_winnowing": rf"""
        with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
        wins as (
            select item, list_slice(w, s, s + 12) as win
            from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from b where len(w) > 0)
        ),
        sizes as (select distinct len(win) as m from wins),
        spots as (select r, w, m, unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) as s from d, sizes),
        hits as (select r, s, m, item from spots join wins on wins.win = list_slice(spots.w, spots.s, spots.s + spots.m - 1)),
        places as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + m)) as p from (select distinct r, s, m from hits)) group by r),
        items as (select r, count(distinct item) as n, string_agg(distinct item, ',' order by item) as list from hits group by r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
            sha256(coalesce(items.list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join places using (r) left join items using (r)""",
    "op7_host_reputation": r"""
        with p as (
            select page_id,
                coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
            from pages
        ),
        known as (
            select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 when quality is null or toxic is null then null else 0 end) as bad
            from labels where doc_id is not null group by doc_id
        ),
        h0 as (select host, count(bad) as n, cast(sum(coalesce(bad, 0)) as bigint) as k, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') as bare from p left join known using (page_id) group by host),
        h1 as (
            select *, string_split(bare, '.') as parts, case
                when regexp_matches(bare, '(^|\.)[0-9]+$') or starts_with(bare, '[') then 0
                when regexp_matches(bare, '(^|\.)(ac|co|com|edu|go|gob|gouv|gov|govt|gub|info|ltd|me|mil|ne|net|nhs|nom|or|org|plc|police|sch)\.[a-z][a-z]$') then 2 else 1 end as lab from h0
        ),
        h as (
            select host, n, k, case when lab = 0 then bare else list_aggregate(parts[greatest(len(parts) - lab, 1):], 'string_agg', '.') end as domain,
                case when lab = 0 then bare else list_aggregate(parts[greatest(len(parts) - lab + 1, 1):], 'string_agg', '.') end as suffix from h1
        ),
        d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by domain, suffix),
        s as (select suffix, sum(n) as n, sum(k) as k from d group by suffix),
        levels as (select 1 as lv, n, k from s union all select 2, n, k from (select sum(n) as n, sum(k) as k from d group by domain) union all select 3, n, k from h),
        m as (
            select lv, cast(sum(n) as double) as nn, sum(k) / sum(n) as q, count(*) as g, sum(n * n) as n2, sum(k * k / n) as kk from levels where n > 0 group by lv
        ),
        rho as (
            select lv, g, case when q * (1 - q) * (nn - n2 / nn - (g - 1)) > 0
                then (kk - nn * q * q - q * (1 - q) * (g - 1)) / (q * (1 - q) * (nn - n2 / nn - (g - 1))) else 0 end as rho from m
        ),
        st as (select lv, case when g < 2 or rho <= 0 then 1000 else least(1000, greatest(2, (1 - rho) / rho)) end as st from rho),
        pr as (
            select (select case when sum(n) > 0 then (sum(k) + 1) / (sum(n) + 2) else 0.1 end from h) as rate,
                coalesce((select st from st where lv = 1), 1000) as s1, coalesce((select st from st where lv = 2), 1000) as s2, coalesce((select st from st where lv = 3), 1000) as s3
        ),
        du as (select domain, d.n as dn, d.k as dk, (s.k - d.k + s1 * rate) / (s.n - d.n + s1) as up from d join s using (suffix), pr),
        hu as (select host, n, k, s3, (dk - k + s2 * up) / (dn - n + s2) as m from h join du using (domain), pr),
        ab as (select host, k + s3 * m as a, n - k + s3 * (1 - m) as b, ln(0.35 / 0.65) as u from hu),
        st2 as (select *, a / (a + b) as mean, ln(a / b) as md, sqrt(1 / a + 1 / b) as wide, least(sqrt(1 / a + 1 / b), 1) / 10 as step from ab),
        su as (select *, (md + 12 * wide + 20 / b - u) / step as hi, (u - md + 12 * wide + 20 / a) / step as lo, -a * ln(1 + exp(-md)) - b * ln(1 + exp(md)) as top from st2),
        tl as (
            select *, exp(-a * ln(1 + exp(-u)) - b * ln(1 + exp(u)) - top) / 2 as half,
                list_sum(list_transform(range(1, greatest(cast(ceil(hi) as bigint), 1) + 1), lambda j: exp(-a * ln(1 + exp(-(u + j * step))) - b * ln(1 + exp(u + j * step)) - top))) as o,
                list_sum(list_transform(range(1, greatest(cast(ceil(lo) as bigint), 1) + 1), lambda j: exp(-a * ln(1 + exp(-(u - j * step))) - b * ln(1 + exp(u - j * step)) - top))) as v
            from su
        ),
        b as (
            select host, case when mean < 0.95 * 0.35 then 0 when 1 - mean <= 0.05 * 0.65 then 1 when hi <= 0 then 0 when lo <= 0 then 1 else (o + half) / (o + v + 2 * half) end as tail from tl
        ),
        r as (
            select p.*, case
                when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from p
        )
        select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when tail >= 0.95 then 'block' else 'allow' end as verdict
        from r left join b using (host)""",
    "op11_prefix_trie": r"""
        with t as (
            select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as nth,
                struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as x
            from conversations where conv_id is not null
        ),
        o as (select c, list(x order by nth) as own from t group by c),
        crc as (
            select c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast(c as varchar), ''), lambda s: cast(ascii(s) as bigint))),
                lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end))) % 6 as h
            from o
        ),
        r as (select o.c, list_concat(list_slice(coalesce(l.own, []), 1, h), list_slice(o.own, h + 1, len(o.own))) as p from o join crc using (c) left join o as l on l.c = o.c - o.c % 100),
        m as (select c, p, unnest(range(0, len(p) + 1)) as d from r),
        n as (
            select d, list_slice(p, 1, d) as s, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(case when d = len(p) then c end, ',' order by c), '')) as ends_sha256
            from m group by d, list_slice(p, 1, d)
        ),
        k as (select n.*, list_slice(s, 1, d - 1) as up, case when d = 0 then 0 else (n_convs - 1) * length(s[d].text) end as own from n),
        kids as (select d - 1 as d, up as s, count(*) as n_children from k where d > 0 group by d, up),
        a as (select k.*, coalesce(n_children, 0) as n_children from k left join kids using (d, s)),
        below as (select unnest(range(0, d + 1)) as d, s, own, n_children from a),
        sums as (select d, list_slice(s, 1, d) as s, sum(own) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from below group by d, list_slice(s, 1, d))
        select a.conv_id, a.d as depth, p.conv_id as parent_conv_id, a.n_convs, cast(a.n_children as bigint) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, a.ends_sha256
        from a join sums using (d, s) left join n as p on p.d = a.d - 1 and p.s = a.up""",
}
