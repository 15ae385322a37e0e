"""Annotations with replies, channel groups and catalogues of images: row edits as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pretty_time

REPLY = "struct<id:string,text:string,created:string,author:string,machine_id:string>"
ANNOTATION = f"id string, text string, x double, y double, linked_roi string, color string, created string, author string, machine_id string, replies array<{REPLY}>"


def owned(machine: str) -> Column:
    return F.col("machine_id") == machine


def add(notes: DataFrame, new: DataFrame) -> DataFrame:
    return notes.unionByName(new)


def edit_text(notes: DataFrame, note_id: str, text: str, machine: str) -> DataFrame:
    """A new text for a note, by its owner only."""
    return notes.withColumn("text", F.when((F.col("id") == note_id) & owned(machine), text).otherwise(F.col("text")))


def delete(notes: DataFrame, note_id: str, machine: str) -> DataFrame:
    return notes.where(~((F.col("id") == note_id) & owned(machine)))


def rename_author(notes: DataFrame, machine: str, name: str) -> DataFrame:
    """The author of all of a machine's notes and replies."""
    reply = F.transform("replies", lambda r: F.when(r["machine_id"] == machine, r.withField("author", F.lit(name))).otherwise(r))
    return notes.withColumns({"author": F.when(owned(machine), name).otherwise(F.col("author")), "replies": reply})


def add_reply(notes: DataFrame, note_id: str, reply: Column, text: str) -> DataFrame:
    """A reply at the end of a note's replies; a blank one is not added."""
    if not text.strip():
        return notes
    return notes.withColumn("replies", F.when(F.col("id") == note_id, F.array_append("replies", reply)).otherwise(F.col("replies")))


def edit_reply(notes: DataFrame, note_id: str, k: int, text: str, machine: str) -> DataFrame:
    change = F.transform("replies", lambda r, i: F.when((i == k) & (r["machine_id"] == machine), r.withField("text", F.lit(text))).otherwise(r))
    return notes.withColumn("replies", F.when(F.col("id") == note_id, change).otherwise(F.col("replies")))


def delete_reply(notes: DataFrame, note_id: str, k: int, machine: str) -> DataFrame:
    kept = F.filter("replies", lambda r, i: ~((i == k) & (r["machine_id"] == machine)))
    return notes.withColumn("replies", F.when(F.col("id") == note_id, kept).otherwise(F.col("replies")))


def thread_text(notes: DataFrame, machine: str) -> DataFrame:
    """(id, thread): heading, text, and a line for each reply."""
    own = F.when(owned(machine), F.lit("You")).otherwise(F.lit("\U0001f512 Locked"))
    head = F.concat_ws("  •  ", F.col("author"), pretty_time(F.col("created")), own)
    lines = F.transform("replies", lambda r: F.concat(F.lit("  ↳ "), r["author"], F.lit(" ("), pretty_time(r["created"], "MM/dd HH:mm"), F.lit("): "), r["text"]))
    return notes.select("id", F.array_join(F.concat(F.array(head, F.col("text")), lines), "\n").alias("thread"))


def visible_by_group(channels: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """channels with visible set by a channel group (group_name, idx array); "All" shows all, an unknown one none."""
    if name == "All":
        return channels.withColumn("visible", F.lit(True))
    want = groups.where(F.col("group_name") == name).select("idx")
    members = want.agg(F.coalesce(F.max("idx"), F.array().cast("array<int>")).alias("__idx"))
    return channels.join(F.broadcast(members)).withColumn("visible", F.array_contains("__idx", F.col("ch_idx"))).drop("__idx")


def group_of_visible(channels: DataFrame, name: str) -> DataFrame:
    return channels.where("visible").agg(F.lit(name).alias("group_name"), F.array_sort(F.collect_list("ch_idx")).alias("idx"))


def group_union(groups: DataFrame, painted: DataFrame) -> DataFrame:
    """Cell groups (group_name, cell_id) with painted cells (background left out), each once."""
    return groups.select("group_name", "cell_id").unionByName(painted.where("cell_id <> 0").select("group_name", "cell_id")).distinct()


def unique_names(names: DataFrame, order_col: str, pattern: str = " (%d)") -> DataFrame:
    """name with a number for its second and further use."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy(order_col))
    return names.withColumn("name", F.when(nth > 1, F.concat("name", F.format_string(pattern, nth))).otherwise(F.col("name")))


def scanned(paths: DataFrame, root: str) -> DataFrame:
    """(name, kind, paths) of image files under a folder: each sub-folder is one image of several files; a loose file is
    one image unless a folder has its name."""
    rel = F.substring(F.col("path"), F.length(F.lit(root.rstrip("/"))) + 2, 1 << 20)
    rows = paths.select("path", F.split(rel, "/").alias("p"))
    folders = rows.where(F.size("p") > 1).groupBy(F.get("p", 0).alias("name")).agg(F.array_sort(F.collect_set("path")).alias("paths")).withColumn("kind", F.lit("folder"))
    loose = rows.where(F.size("p") == 1).select(F.get("p", 0).alias("name"), F.lit("multi").alias("kind"), F.array("path").alias("paths"))
    return folders.select("name", "kind", "paths").unionByName(loose.join(folders.select("name"), "name", "left_anti"))


def remove_images(images: DataFrame, names: DataFrame) -> DataFrame:
    return images.join(names.select("name"), "name", "left_anti")


def settings_for_others(settings: DataFrame, images: DataFrame, current: str) -> DataFrame:
    """The current image's settings (one row a channel, broadcast) for every other image."""
    return images.where(F.col("name") != current).join(F.broadcast(settings.drop("name"))).select(F.col("name"), *settings.drop("name").columns)


def restored(settings: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved settings by channel, but only if there are as many as channels; else the present ones."""
    n, m = settings.agg(F.count("*").alias("__n")), saved.agg(F.count("*").alias("__m"))
    both = settings.alias("a").join(saved.alias("b"), "ch_idx", "left").join(F.broadcast(n)).join(F.broadcast(m))
    pick = lambda c: F.when(F.col("__n") == F.col("__m"), F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))).otherwise(F.col(f"a.{c}")).alias(c)
    return both.select("ch_idx", *(pick(c) for c in settings.columns if c != "ch_idx"))


def preferred_first(ids: DataFrame, preferred: list[str], keywords: list[str], fallback: int = 50) -> DataFrame:
    """(id, rank) of model ids: those with a keyword, preferred ones first in their order, others by name; none: the first ids."""
    from ..functions.text import has_any

    place = F.array_position(F.array(*map(F.lit, preferred)), F.col("id"))
    order = Window.orderBy(F.when(place > 0, place).otherwise(1 << 30), "id")
    chat = ids.where(has_any(F.col("id"), keywords)).select("id", F.row_number().over(order).alias("rank"))
    plain = ids.select("id", F.row_number().over(Window.orderBy("id")).alias("rank")).where(F.col("rank") <= fallback)
    none = chat.agg(F.count("*").alias("__n"))
    return chat.unionByName(plain.join(F.broadcast(none)).where("__n = 0").select("id", "rank"))


def split_preferred(ids: DataFrame, preferred: list[str]) -> DataFrame:
    """(id, preferred): ids told apart by whether they are among the preferred ones."""
    return ids.select("id", F.col("id").isin(preferred).alias("preferred"))


def tail(messages: Column, n: int = 50) -> Column:
    """The last n of an array (slice with a negative start is empty on shorter arrays)."""
    return F.slice(messages, F.greatest(F.size(messages) - n + 1, F.lit(1)), F.lit(n))


def shaped(messages: Column, system: str, roles: dict[str, str]) -> Column:
    """Chat messages with the system message first, empty ones left out and roles renamed."""
    renamed = lambda role: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)), role), role)
    rest = F.transform(F.filter(messages, lambda m: m["content"].isNotNull() & (m["role"] != "system")), lambda m: F.struct(renamed(m["role"]).alias("role"), m["content"].alias("content")))
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), rest)


def saved_chats(chats: DataFrame, n: int = 20) -> DataFrame:
    """(path, title, messages, saved): the newest chats by file name; titles are cut at 24 characters."""
    title = F.when(F.length("title") > 24, F.concat(F.substring("title", 1, 24), F.lit("..."))).otherwise(F.col("title"))
    return chats.orderBy(F.desc("path")).limit(n).select("path", title.alias("title"), F.size("messages").alias("messages"), F.date_format(F.timestamp_seconds("ts"), "MM/dd HH:mm").alias("saved"))


def first_version(manifest: DataFrame, version_id: str) -> DataFrame:
    """The first manifest row of a version; none: an error when it is read."""
    return manifest.where(F.col("version_id") == version_id).orderBy("seq").limit(1)
