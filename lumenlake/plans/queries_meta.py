"""Names, times, notes, catalogues, sets, sessions and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.display import lerp_hex, ramp
from ..functions.palettes import CHANNEL_COLOURS
from ..operators import annotations as an
from ..operators import roi as rg
from ..operators import session as ss
from ..sources import ome, raster, tables
from .registry import query, rounded, table
from .standins import SQL_DENSE, SQL_IMAGE_PARAMS, SQL_IMAGE_ROIS, SQL_NOTES, SQL_PARAMS, SQL_ROIS, SQL_RPARAMS, WIDTH, dense, height, image_params, image_rois, notes, params, raster_params, rois
from .standins import raster as made
from .queries_raster import PIXELS_IN_ROIS


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors write; it goes with the session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    at = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


_BASE = "regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1')"


@query("S7 P11", f"with u as (select page_id, '/data/' || replace(replace(split_part(url, '://', 2), '?', '_'), '#', '-') || '.tif' as path from pages) select page_id, string_split(path, '/')[-1] as base, string_split({_BASE}, '_')[-1] as token, string_split(replace({_BASE}, '-', '_'), '_')[-1] as merge_token, regexp_matches(lower(path), 'dapi|hoechst|nuclear|page') as nuclear from u")
def channel_name_from_path(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.translate(F.split_part("url", F.lit("://"), F.lit(2)), "?#", "_-"), F.lit(".tif"))
    u = table(spark, d, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return u.select("page_id", tx.basename(p).alias("base"), tx.channel_token(p).alias("token"), tx.channel_token(p, dashes=True).alias("merge_token"), (tx.is_nuclear(p) | F.lower(p).contains("page")).alias("nuclear"))


@query("M2", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as long_time, strftime(o_orderdate, '%m/%d %H:%M') as short_time, 'no date at all h' as bad from orders")
def note_time_format(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", tx.pretty_time(iso).alias("long_time"), tx.pretty_time(iso, "MM/dd HH:mm").alias("short_time"), tx.pretty_time(F.lit("no date at all here")).alias("bad"))


_FENCED = "'see' || chr(10) || '```python:a' || item_id || '.py' || chr(10) || text || chr(10) || '```' || chr(10) || 'and ```:b.txt' || chr(10) || 'x```' || ' end'"


@query("G10", f"select item_id, 2 as n, 'a' || item_id || '.py' as first_path, text || chr(10) as first_body, 'b.txt' as second_path, 'x' as second_body, 'see' || chr(10) || chr(10) || 'and  end' as rest from benchmark")
def extract_fenced_edits(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("see\n```python:a"), F.col("item_id").cast("string"), F.lit(".py\n"), F.col("text"), F.lit("\n```\nand ```:b.txt\nx``` end"))
    got = table(spark, d, "benchmark").select("item_id", body.alias("t")).select("item_id", tx.fenced_edits(F.col("t")).alias("e"), tx.without_edits(F.col("t")).alias("rest"))
    at = lambda k, c: F.get("e", k)[c]
    return got.select("item_id", F.size("e").alias("n"), at(0, "path").alias("first_path"), at(0, "body").alias("first_body"), at(1, "path").alias("second_path"), at(1, "body").alias("second_body"), "rest")


@query("T8", "select conv_id, substring(text, 1, 22) as head, case when length(text) > 24 then substring(text, 1, 24) || '...' else text end as title from conversations where turn = 0")
def clipped_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("turn = 0").select("conv_id", tx.clipped(F.col("text"), 22).alias("head"), tx.clipped(F.col("text"), 24, "...").alias("title"))


@query("T10 R10", "with z as (select p_partkey, p_size / 10.0::double as zoom, 2.0::double as ds, case when p_partkey % 3 = 0 then 0.0::double else 0.1::double + p_partkey % 7 end as um from part), s as (select *, greatest(zoom / greatest(ds, 1), 0.001) as fz from z), q as (select *, case when um > 0 then fz / um end as pu, list_filter([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000], lambda w: w * (fz / um) >= 60 and w * (fz / um) <= 250)[1] as fit from s) select p_partkey, (case when um > 0 and fit is not null then trunc(fit * pu) else 100 end)::int as bar_px, case when um > 0 then (case when coalesce(fit, trunc(100 / greatest(pu, 0.001))::bigint) >= 1000 then (coalesce(fit, trunc(100 / greatest(pu, 0.001))::bigint) // 1000) || ' mm' else coalesce(fit, trunc(100 / greatest(pu, 0.001))::bigint) || ' µm' end) else trunc(100 / fz)::bigint || ' px' end as label from q")
def scale_bar_pick(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "part").selectExpr("p_partkey", "p_size / 10d as zoom", "case when p_partkey % 3 = 0 then 0d else 0.1d + p_partkey % 7 end as um")
    return z.select("p_partkey", tx.scale_bar(F.col("zoom"), F.lit(2.0), F.col("um")).alias("s")).select("p_partkey", "s.*")


@query("P21", f"with {SQL_NOTES}, m as (select conv_id, list_concat(['system:be brief'], list(case role when 'assistant' then 'model' else role end || ':' || text order by turn)) as l from conversations where text is not null and role <> 'system' group by 1) select conv_id, array_to_string(l, '|') as shaped from m")
def chat_message_shape(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    got = an.shaped(F.transform("m", lambda s: F.struct(s["role"].alias("role"), s["content"].alias("content"))), "be brief", {"assistant": "model"})
    return m.select("conv_id", F.array_join(F.transform(got, lambda s: F.concat(s["role"], F.lit(":"), s["content"])), "|").alias("shaped"))


@query("T8 K13", "select user_id, array_to_string(list(event_id order by event_id)[greatest(count(*) - 49, 1):], ',') as last_fifty from events group by user_id")
def tail50(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    return got.select("user_id", F.array_join(F.transform(an.tail(F.col("l")), lambda e: e.cast("string")), ",").alias("last_fifty"))


_PREF = ["Brand#13", "Brand#22", "Nope#1"]


@query("T7 P14", "with i as (select distinct p_brand as id from part), c as (select id, list_position(['Brand#13', 'Brand#22', 'Nope#1'], id) as p from i where contains(lower(id), '#1') or contains(lower(id), '#2')) select id, row_number() over (order by coalesce(nullif(p, 0), 1000000), id)::int as rank from c")
def model_preferred_sort(spark: SparkSession, d: str) -> DataFrame:
    return an.preferred_first(table(spark, d, "part").select(F.col("p_brand").alias("id")).distinct(), _PREF, ["#1", "#2"])


@query("T7", "select id, rank::int as rank from (select id, row_number() over (order by id) as rank from (select distinct p_brand as id from part)) where rank <= 50")
def model_fallback(spark: SparkSession, d: str) -> DataFrame:
    return an.preferred_first(table(spark, d, "part").select(F.col("p_brand").alias("id")).distinct(), _PREF, ["absent"])


@query("T11", "with c as (select conv_id, 'chat_' || lpad((conv_id * 37 % 1000)::varchar, 4, '0') || '_' || conv_id || '.json' as path, max(text) filter (turn = 0) as title, count(*)::int as messages, 1700000000 + conv_id * 3600 as ts from conversations group by 1) select path, case when length(title) > 24 then substring(title, 1, 24) || '...' else title end as title, messages, strftime(to_timestamp(ts) at time zone 'UTC', '%m/%d %H:%M') as saved from c order by path desc limit 20")
def saved_chats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"), F.collect_list("turn").alias("messages"))
    name = F.concat(F.lit("chat_"), F.lpad((F.col("conv_id") * 37 % 1000).cast("string"), 4, "0"), F.lit("_"), "conv_id", F.lit(".json"))
    return an.saved_chats(c.select(name.alias("path"), "title", "messages", (F.col("conv_id") * 3600 + 1700000000).alias("ts")))


@query("J6 D8", f"with {SQL_ROIS}, {SQL_NOTES} select name, coalesce(n, '') as notes from ro left join (select linked_roi, string_agg(text, ' | ' order by pos) as n from no where linked_roi is not null group by 1) q on q.linked_roi = name")
def notes_linked(spark: SparkSession, d: str) -> DataFrame:
    return rg.linked_notes(rois(spark), notes(spark, d))


@query("J7 U6", f"with {SQL_ROIS}, {SQL_NOTES} select name, pos, id, 1 as source from ro join no on linked_roi = name union all select name, pos, id, 2 from ro join no on linked_roi is null and x >= x1 and x <= x2 and y >= y1 and y <= y2")
def notes_in_roi(spark: SparkSession, d: str) -> DataFrame:
    return rg.notes_of(rois(spark), notes(spark, d))


_TIME = "substring(replace(created, 'T', ' '), 1, 16)"


@query(
    "M3 K5",
    f"with {SQL_ROIS}, {SQL_NOTES}, q as (select name, pos, id, 1 as source from ro join no on linked_roi = name union all select name, pos, id, 2 from ro join no on linked_roi is null and x >= x1 and x <= x2 and y >= y1 and y <= y2), "
    "rp as (select pos, string_agg('  ↳ [' || author || '] 02/03 04:05: ' || text || chr(10), '' order by turn) as t from re group by pos), "
    f"e as (select q.name, q.source, q.pos, '[' || author || '] ' || {_TIME} || chr(10) || text || chr(10) || coalesce(rp.t, '') || chr(10) as entry from q join no using (id) left join rp on rp.pos = q.pos) "
    "select name, 'Notes for ' || name || chr(10) || repeat('=', 40) || chr(10) || chr(10) || string_agg(entry, '' order by source, pos) as text from e group by name",
)
def notes_text(spark: SparkSession, d: str) -> DataFrame:
    return rg.notes_text(rois(spark), notes(spark, d))


@query("M2 P15", f"with {SQL_NOTES}, rp as (select pos, string_agg(chr(10) || '  ↳ ' || author || ' (02/03 04:05): ' || text, '' order by turn) as t from re group by pos) select id, author || '  •  ' || {_TIME} || '  •  ' || case when machine_id = 'm1' then 'You' else '🔒 Locked' end || chr(10) || text || coalesce(rp.t, '') as thread from no left join rp on rp.pos = no.pos")
def thread_text(spark: SparkSession, d: str) -> DataFrame:
    return an.thread_text(notes(spark, d), "m1")




def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "author", "text", F.array_join(F.transform("replies", lambda r: F.concat_ws(":", r["author"], r["text"])), "|").alias("replies"))


@query("P16", f"with {SQL_NOTES}, rp as (select pos, string_agg(case when machine_id = 'm1' then 'Me' else author end || ':' || text, '|' order by turn) as t from re group by pos) select id, case when machine_id = 'm1' then 'Me' else author end as author, text, coalesce(rp.t, '') as replies from no left join rp on rp.pos = no.pos")
def author_rename(spark: SparkSession, d: str) -> DataFrame:
    return _flat(an.rename_author(notes(spark, d), "m1", "Me"))


@query("M1 P15", f"with {SQL_NOTES} select id, case when id = 'n3' then 'new' else text end as text from no where not (id = 'n5' and machine_id = 'm1') union all select 'z', 'added'")
def annotation_crud(spark: SparkSession, d: str) -> DataFrame:
    n = an.edit_text(an.edit_text(notes(spark, d), "n3", "new", "m1"), "n4", "not mine", "m1")
    n = an.delete(an.delete(n, "n5", "m1"), "n6", "m1").select("id", "text")
    return an.add(n, spark.createDataFrame([("z", "added")], "id string, text string"))


@query("M9", f"with {SQL_NOTES}, r2 as (select pos, turn, case when pos = 3 and turn = 1 then 'changed' else text end as text from re where not (pos = 2 and turn = 1) union all select 1, 1000, 'hello' where exists (select 1 from no where pos = 1)), rp as (select pos, string_agg(text, '|' order by turn) as t from r2 group by pos) select id, coalesce(rp.t, '') as replies from no left join rp on rp.pos = no.pos")
def reply_edits(spark: SparkSession, d: str) -> DataFrame:
    new = F.struct(F.lit(1000).cast("bigint").alias("turn"), F.lit("x").alias("id"), F.lit("hello").alias("text"), F.lit("").alias("created"), F.lit("a").alias("author"), F.lit("m1").alias("machine_id"))
    n = an.add_reply(an.add_reply(notes(spark, d), "n1", new, "hello"), "n2", new, "  ")
    n = an.delete_reply(an.edit_reply(n, "n3", 0, "changed", "m1"), "n2", 0, "m1")
    return n.select("id", F.array_join(F.transform("replies", lambda r: r["text"]), "|").alias("replies"))


@query("M4", f"with {SQL_IMAGE_ROIS} select * from ir")
def roi_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    r = image_rois(spark, d)
    packed = r.select(F.to_json(F.struct(*r.columns)).alias("j"))
    return packed.select(F.from_json("j", r.schema).alias("r")).select("r.*")


@query("D4 R8", f"with {SQL_IMAGE_PARAMS} select image_id, ch_idx, visible, mn as min, mx as max, brightness, gamma from ip")
def params_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = image_params(spark, d)
    return p.select(F.to_json(F.struct(*p.columns)).alias("j")).select(F.from_json("j", p.schema).alias("p")).select("p.*")


@query("S14", "select event_id, (props ->> '$.k')::bigint as k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("M5", f"with {SQL_PARAMS} select 'some' as which, ch_idx, ch_idx in (0, 3) as visible from pr union all select 'All', ch_idx, true from pr union all select 'none', ch_idx, false from pr")
def channel_groups(spark: SparkSession, d: str) -> DataFrame:
    p = params(spark).select("ch_idx", "visible")
    groups = an.group_of_visible(p.withColumn("visible", F.col("ch_idx").isin(0, 3)), "some")
    out = [an.visible_by_group(p, groups, n).select(F.lit(n).alias("which"), "ch_idx", "visible") for n in ("some", "All", "none")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("U1 U2 D9", "select group_name, cell_id from (select p_brand as group_name, p_partkey as cell_id from part where p_size < 10 union select p_brand, p_partkey from part where p_size < 12 and p_partkey <> 0)")
def group_union(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").selectExpr("p_brand as group_name", "p_partkey as cell_id", "p_size")
    return an.group_union(g.where("p_size < 10"), g.where("p_size < 12"))


@query("W12", "select p_partkey, p_type || case when k > 1 then ' (' || k || ')' else '' end as name from (select p_partkey, p_type, row_number() over (partition by p_type order by p_partkey) as k from part)")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    return an.unique_names(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("name")), "p_partkey")


_PATHS = "p as (select page_id, '/img/' || case when page_id % 5 = 0 then 'f' || (page_id % 7) || '.tif' when page_id % 5 = 1 then 'f' || (page_id % 11) || '.tif/c' || page_id || '.tif' else 'd' || (page_id % 9) || '/sub/c' || page_id || '.tif' end as path from pages)"


@query("S4 T9 U3 J14 D3", f"with {_PATHS}, r as (select distinct path, string_split(substring(path, 6), '/') as s from p), fo as (select s[1] as name, 'folder' as kind, string_agg(path, ',' order by path) as paths from r where len(s) > 1 group by 1) select * from fo union all select s[1], 'multi', path from r where len(s) = 1 and s[1] not in (select name from fo)")
def scan_anti_basename(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("f"), F.col("page_id") % 7, F.lit(".tif"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("f"), F.col("page_id") % 11, F.lit(".tif/c"), "page_id", F.lit(".tif")))
    path = F.concat(F.lit("/img/"), F.coalesce(path, F.concat(F.lit("d"), F.col("page_id") % 9, F.lit("/sub/c"), "page_id", F.lit(".tif"))))
    found = an.scanned(table(spark, d, "pages").select(path.alias("path")).distinct(), "/img")
    return found.select("name", "kind", F.array_join("paths", ",").alias("paths"))


@query("M8", "select 'img' || p_partkey as name from part where p_size >= 20")
def catalog_remove(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("concat('img', p_partkey) as name", "p_size")
    return an.remove_images(p.select("name"), p.where("p_size < 20"))


@query("P17", f"with {SQL_PARAMS} select r_name as name, ch_idx, mn as min, brightness from region, pr where r_name <> 'ASIA'")
def settings_for_others(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "region").select(F.col("r_name").alias("name"))
    return an.settings_for_others(params(spark).select("ch_idx", "min", "brightness"), images, "ASIA")


@query("J12", f"with {SQL_PARAMS} select 'same' as which, ch_idx, 5.0::double as min from pr union all select 'fewer', ch_idx, mn from pr")
def settings_restored(spark: SparkSession, d: str) -> DataFrame:
    p = params(spark).select("ch_idx", "min")
    saved = p.withColumn("min", F.lit(5.0))
    one, two = (an.restored(p, s).select(F.lit(n).alias("which"), "ch_idx", "min") for n, s in (("same", saved), ("fewer", saved.where("ch_idx > 0"))))
    return one.unionByName(two)


@query("J13 K11", "select version_id, seq, payload from (select 'v' || (event_id % 10) as version_id, event_id as seq, event_type as payload from events) where version_id = 'v7' order by seq limit 1")
def version_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").selectExpr("concat('v', event_id % 10) as version_id", "event_id as seq", "event_type as payload")
    return an.first_version(m, "v7")


@query("K11 S16", "select p_partkey, p_size + 1 as p_size from part")
def version_restore(spark: SparkSession, d: str) -> DataFrame:
    at = work_dir(spark, "versions")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    ss.append_version(p, at, "20240101_1")
    ss.append_version(p.withColumn("p_size", F.col("p_size") + 1), at, "20240102_1")
    return ss.restore_version(spark, at, "20240102_1")


_EDIT = "case when l_orderkey = 1 and l_linenumber = 1 then l_quantity + 1 else l_quantity end"


def _line_log(spark: SparkSession, d: str) -> ss.VersionLog:
    """lineitem as it is, with one row edited, and back again."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    log = ss.VersionLog(spark, work_dir(spark, "log"), ["l_orderkey", "l_linenumber"], 64)
    log.commit(rows, "a")
    log.commit(rows.withColumn("l_quantity", F.expr(_EDIT)), "b")
    log.commit(rows, "c")
    return log


@query("K11 S16", f"select l_orderkey, l_linenumber, {_EDIT} as l_quantity from lineitem")
def version_log_restore(spark: SparkSession, d: str) -> DataFrame:
    return _line_log(spark, d).restore("b")


@query("K11 S16", f"select '-' as change, l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey = 1 and l_linenumber = 1 union all select '+', l_orderkey, l_linenumber, {_EDIT} from lineitem where l_orderkey = 1 and l_linenumber = 1")
def version_log_changes(spark: SparkSession, d: str) -> DataFrame:
    return _line_log(spark, d).changes("c", "b")


@query("K10 S13 M6 D12", "select c_custkey, c_name from customer")
def session_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = work_dir(spark, "session")
    ss.save_session(spark, at, {"cells": table(spark, d, "customer").select("c_custkey", "c_name"), "rois": rois(spark)}, {"zoom": 1.5})
    found, _ = ss.load_session(spark, at)
    return found["cells"]


_XML = "'<OME xmlns=\"http://www.openmicroscopy.org/Schemas/OME/2016-06\"><Image><Pixels PhysicalSizeX=\"0.' || (p_size + 1) || '\"><Channel ID=\"0\" Name=\"DAPI\"/><Channel ID=\"1\"/><Channel ID=\"2\" Name=\"' || p_brand || '\"/></Pixels></Image></OME>'"


@query("S9 S10", "select p_partkey, ('0.' || (p_size + 1))::double as um, 'DAPI,Ch1,' || p_brand as names, 2.0::double as by_cm, 25.4::double as by_inch, 0.0::double as unknown from part")
def ome_channels(spark: SparkSession, d: str) -> DataFrame:
    xml = F.concat(F.lit('<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image><Pixels PhysicalSizeX="0.'), F.col("p_size") + 1, F.lit('"><Channel ID="0" Name="DAPI"/><Channel ID="1"/><Channel ID="2" Name="'), "p_brand", F.lit('"/></Pixels></Image></OME>'))
    none = F.lit("<a/>")
    return table(spark, d, "part").select(
        "p_partkey", ome.pixel_size_um(xml, F.lit(0.0), F.lit(1)).alias("um"), F.array_join(ome.channel_names(xml), ",").alias("names"),
        ome.pixel_size_um(none, F.lit(5000.0), F.lit(3)).alias("by_cm"), ome.pixel_size_um(none, F.lit(1000.0), F.lit(2)).alias("by_inch"), ome.pixel_size_um(none, F.lit(0.0), F.lit(1)).alias("unknown"),
    )


@query("D4", "select * from (values " + ", ".join(f"('{n}', {r}, {g}, {b})" for n, (r, g, b) in CHANNEL_COLOURS.items()) + ") t(color_name, r, g, b)")
def colour_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, *c) for n, c in CHANNEL_COLOURS.items()], "color_name string, r int, g int, b int")


@query("O4", "with v as (select i / 20.0::double as v from range(21) t(i)) select round(v, 4) as v, round(least(greatest(v * 3, 0), 1), 4) as r, round(least(greatest(v * 3 - 1, 0), 1), 4) as g, round(least(greatest(v * 3 - 2, 0), 1), 4) as b, '#' || printf('%02x%02x%02x', trunc(10 + (255 - 10) * v)::int, trunc(132 + (69 - 132) * v)::int, trunc(255 + (58 - 255) * v)::int) as mix from v")
def colour_ramp(spark: SparkSession, d: str) -> DataFrame:
    v = spark.range(21).select((F.col("id") / 20).alias("v"))
    parts = ramp("Fire", F.col("v"))
    return rounded(v.select("v", *(p.alias(c) for c, p in zip("rgb", parts)), lerp_hex(F.lit("#0a84ff"), F.lit("#ff453a"), F.col("v")).alias("mix")))


@query("S1 S2 S8 S11 S6 K6 K7 K14", f"with {SQL_DENSE} select 'm' || (y % 4) as name, (y // 4)::int as y, x::int as x, v::bigint as v from dr")
def raster_source_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth row of the raster is an image of its own; the images are written, planned and read as tiles."""
    at, h = work_dir(spark, "raster"), height(spark, d)
    px = dense(spark, d).selectExpr("concat('m', y % 4) as name", "cast(y div 4 as int) as y", "x", "v")
    raster.write_tiff(px, at, -(-h // 4), WIDTH, group="name").count()
    read = raster.pixels(raster.tiles_of(raster.planned(spark, at), 48))
    found = read.select(F.regexp_extract("image_id", r"([^/]+)\.tif$", 1).alias("name"), "y", "x", F.col("v").cast("long").alias("v"))
    return found.where(F.col("y") * 4 + F.substring("name", 2, 1).cast("int") < h)  # a last row of fewer than four is filled up


@query("S7 J1", "with r as (select (i // 40)::int as y, (i % 40)::int as x from range(30 * 40) t(i)) select 0 as ch_idx, sum(y * 40 + x)::double as total from r union all select 1, sum(x)::double from r")
def merged_channel_files(spark: SparkSession, d: str) -> DataFrame:
    at = work_dir(spark, "merge")
    px = spark.range(30 * 40).selectExpr("cast(id div 40 as int) as y", "cast(id % 40 as int) as x")
    raster.write_tiff(px.selectExpr("y", "x", "cast(y * 40 + x as double) as v"), f"{at}/s_DAPI.tif", 30, 40).count()
    raster.write_tiff(px.selectExpr("y", "x", "cast(x as double) as v"), f"{at}/s_CD3.tif", 30, 40).count()
    raster.register(spark)
    tiles = raster.merged_channels(spark, [f"{at}/s_DAPI.tif", f"{at}/s_CD3.tif"])
    return raster.pixels(tiles).groupBy("ch_idx").agg(F.sum("v").alias("total"))


@query("S15 S5 S3", "select 'a.py' as name union all select 'c.PNG' union all select 'd.ome.tif'")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    at = work_dir(spark, "tree")
    fs, folder = raster.open_path(at)
    for name in ("a.py", ".versions/b.py", "c.PNG", "d.ome.tif", "e.txt"):
        fs.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(f"{folder}/{name}") as sink:
            sink.write(b"x = 1")
    found = tables.image_files(spark, at).unionByName(tables.source_files(spark, at).select("path"))
    return found.select(tx.basename(F.col("path")).alias("name"))


_N = "least(greatest((v - mn) / (case when mx <= mn then mn + 1 else mx end - mn), 0), 1)"


@query(
    "K3 A6 M3",
    f"{PIXELS_IN_ROIS}, {SQL_RPARAMS}, {SQL_NOTES}, held as (select roi_name, ch_idx, v from mb join ra using (y, x)), "
    f"ad as (select roi_name, ch_idx, least(greatest({_N} * brightness, 0), 1) as n from held join rp using (ch_idx)), "
    "g as (select roi_name, ch_idx, coalesce(avg(n) filter (n > 0.01), 0) as mean, coalesce(stddev_pop(n) filter (n > 0.01), 0) as std, coalesce(median(n) filter (n > 0.01), 0) as median, coalesce(min(n) filter (n > 0.01), 0) as min_v, coalesce(max(n) filter (n > 0.01), 0) as max_v from ad group by 1, 2), "
    "rf as (select roi_name, mean as rm from g where ch_idx = 0), "
    "nt as (select linked_roi, string_agg(text, ' | ' order by pos) as notes from no where linked_roi is not null group by 1) "
    "select g.roi_name, roi_type, (x1 + x2) / 2 as center_x, (y1 + y2) / 2 as center_y, x2 - x1 as width_px, y2 - y1 as height_px, 'ch' || (ch_idx + 1) as channel, 'White' as color_name, "
    "round(mean, 4) as mean, round(std, 4) as std, round(median, 4) as median, round(min_v, 4) as min_v, round(max_v, 4) as max_v, round(case when ch_idx = 0 then 1.0 else mean / greatest(coalesce(rm, 0), 0.001) end, 4) as ratio, "
    "mn as adj_min, mx as adj_max, brightness, coalesce(notes, '') as notes from g join rp using (ch_idx) join ro on ro.name = g.roi_name left join rf on rf.roi_name = g.roi_name left join nt on linked_roi = g.roi_name",
)
def roi_table_csv(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.stats import adjusted_stats

    p = raster_params(spark).withColumns({"name": F.format_string("ch%d", F.col("ch_idx") + 1), "color_name": F.lit("White")})
    held = rg.members_or_box(made(spark, d).select("y", "x", "ch_idx", "v"), rois(spark), height(spark, d), WIDTH)
    return rounded(tables.roi_table(adjusted_stats(held, p, ["roi_name"]), rois(spark), p, rg.linked_notes(rois(spark), notes(spark, d))))


@query("U7", "with i as (select distinct p_brand as id from part) select id, id in ('Brand#13', 'Brand#22') as preferred from i")
def preferred_partition(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").select(F.col("p_brand").alias("id")).distinct()
    return an.split_preferred(ids, _PREF)
