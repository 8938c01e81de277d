"""Which files are current: picking, discovering and merging schedule sources.

A listing has (inbox_id, folder, list_pos, name, url, uploaded_at); list_pos is the order in
which files were listed and decides ties. Everything is grouped by inbox and folder and
aggregated with partial sums before the shuffle; no window holds a folder's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

FILE = ("list_pos", "name", "url", "uploaded_at")


def _file_order(dated: Column) -> Column:
    """Of a meeting's files the largest counts: the highest version, then the newest, then the last by name, then the first listed."""
    return F.struct(N.file_version(F.col("name")).alias("v"), F.col("uploaded_at").alias("t"), F.when(dated, F.lower("name")).otherwise("").alias("n"), (-F.col("list_pos")).alias("p"))


def _meeting_order(wish: Column) -> Column:
    """Of a folder's meetings (__dated, __meeting, __newest, __first) the largest counts: the one wished for, the highest-ranked regular one, the newest."""
    rank = N.meeting_rank(F.col("__meeting"))
    return F.struct("__dated", F.coalesce(F.col("__meeting") == wish, F.lit(False)).alias("w"), rank.isNotNull().alias("k"), rank.alias("r"), F.when(rank.isNull(), F.col("__newest")).alias("t"), (-F.col("__first")).alias("p"))


def latest(files: DataFrame, keys: list[str], preferred: str | None = None) -> DataFrame:
    """The current file per keys (K1): columns of files.

    If any file is dated, undated ones are ignored. The winning meeting is the preferred one
    if present, else the highest-ranked regular one, else that with the newest upload; within
    it the highest version, then the newest, then the last by name wins. Undated files: the
    highest version, else the first listed.
    """
    dated = F.col("uploaded_at").isNotNull()
    wish = F.col(preferred) if preferred else F.lit(None).cast("string")
    extra = [c for c in files.columns if c not in keys]
    best = (
        files.withColumn("__meeting", F.when(dated, N.meeting_id(F.col("name"))))
        .groupBy(*keys, dated.alias("__dated"), "__meeting")
        .agg(F.max_by(F.struct(*extra), _file_order(dated)).alias("__file"), F.max("uploaded_at").alias("__newest"), F.min("list_pos").alias("__first"), F.max(wish).alias("__wish"))
    )
    return best.groupBy(*keys).agg(F.max_by("__file", _meeting_order(F.col("__wish"))).alias("__file")).select(*keys, "__file.*")


def latest_schedule(listing: DataFrame, keys: list[str] | None = None, preferred: str | None = None) -> DataFrame:
    return latest(listing.where(N.is_schedule_file(F.col("name"))), keys or ["inbox_id", "folder"], preferred)


def latest_chair_notes(listing: DataFrame) -> DataFrame:
    """The current chair notes of each inbox (K2): of each folder, then of those."""
    of_folder = latest(listing.where(N.is_chair_notes_file(F.col("name"))), ["inbox_id", "folder"])
    return latest(of_folder, ["inbox_id"])


def latest_agenda(listing: DataFrame) -> DataFrame:
    """The newest document of each inbox (K3), the first listed if none is dated."""
    order = F.struct("uploaded_at", -F.col("list_pos"))
    documents = listing.where(N.supported_document(F.col("name")))
    return documents.groupBy("inbox_id").agg(F.max_by(F.struct("folder", *FILE), order).alias("f")).select("inbox_id", "f.*")


def latest_by_mtime(files: DataFrame, keys: list[str], accepted: Column) -> DataFrame:
    """The newest local file per keys (K4); files has path and modified."""
    return files.where(accepted).groupBy(*keys).agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def is_chair_folder(folder: Column) -> Column:
    return F.lower(folder).contains("chair")


def discover_sources(listing: DataFrame, root: str = "Inbox") -> DataFrame:
    """Schedule sources of every inbox (U7), in order `ord`.

    listing holds the folders' files, and the inbox's own with folder = root. The first chair
    folder by name gives the main file and pins the meeting for the other folders; files of the root
    count for persons not yet known, unless of an older meeting. Any further chair folder is a
    main source too, so looking at Chair_notes alone would add nothing.

    One pass sums the listing up by folder and meeting (of the root, by person and meeting);
    all choices are made on these few rows of an inbox.
    """
    at_root, name = F.col("folder") == root, F.col("name")
    schedule, dated = N.is_schedule_file(name), F.col("uploaded_at").isNotNull() & ~at_root
    person = F.when(at_root, N.person_of_file(name))
    used = listing.where(F.when(at_root, schedule & person.isNotNull()).otherwise(N.is_listed_folder(F.col("folder"))))
    used = used.withColumns({"__person": person, "__schedule": schedule, "__dated": dated & schedule, "__meeting": F.when(schedule & (at_root | dated), N.meeting_id(name))})
    first = F.struct(F.lit(None).alias("v"), F.lit(None).alias("t"), F.lit("").alias("n"), (-F.col("list_pos")).alias("p"))
    groups = used.groupBy("inbox_id", "folder", "__person", "__schedule", "__dated", "__meeting").agg(
        F.max_by(F.struct(*FILE), F.when(at_root, first).otherwise(_file_order(F.col("uploaded_at").isNotNull()))).alias("__file"), F.max("uploaded_at").alias("__newest"), F.min("list_pos").alias("__first")
    )
    inbox = Window.partitionBy("inbox_id")
    chair = F.min(F.when(~at_root & is_chair_folder(F.col("folder")), F.col("folder"))).over(inbox)
    groups = groups.repartition("inbox_id").withColumn("__chair", chair).where("__schedule")
    of_chair = F.coalesce(F.col("folder") == F.col("__chair"), F.lit(False))
    main = F.max_by("__file", F.when(of_chair, _meeting_order(F.lit(None).cast("string")))).over(inbox)
    groups = groups.withColumn("__pin", N.meeting_id(main["name"]))
    older = F.coalesce(N.meeting_rank(F.col("__meeting")) < N.meeting_rank(F.col("__pin")), F.lit(False))
    nothing = F.struct(F.lit(False).alias("__dated"), F.lit(False).alias("w"), F.lit(False).alias("k"), F.lit(None).alias("r"), F.lit(None).alias("t"), (-F.col("__first")).alias("p"))
    order = F.when(at_root, nothing).otherwise(_meeting_order(F.when(~of_chair, F.col("__pin"))))
    found = groups.where(~(at_root & older)).groupBy("inbox_id", "folder", "__person", "__chair").agg(F.max_by("__file", order).alias("__file"))
    known = F.coalesce("__person", F.when(~of_chair, N.person_of_folder(F.col("folder"))))
    found = found.select("inbox_id", "folder", "__file.*", known.alias("person"), (~at_root & is_chair_folder(F.col("folder"))).alias("is_main"))
    others = F.collect_set(F.when(~at_root, F.col("person"))).over(inbox)
    found = found.withColumn("__others", others).where(~at_root | ~F.array_contains("__others", F.col("person"))).drop("__others")
    rank = F.struct((~F.col("is_main")).alias("a"), at_root.alias("b"), "folder", "list_pos")
    return found.withColumn("ord", rank)


def union_sources(inboxes: DataFrame, extra: DataFrame) -> DataFrame:
    """Sources of inboxes, then those of extra folders."""
    return inboxes.withColumn("part", F.lit(0)).unionByName(extra.withColumn("part", F.lit(1)))


def dedup_sources(sources: DataFrame, key: str = "meeting_id") -> DataFrame:
    """One main source, one a person, one a folder (U2): the newest, the first of equals.

    sources has (key, ord, folder, person, is_main, uploaded_at). Main sources that lose turn
    into sources of their folder.
    """
    newest = F.struct(F.col("uploaded_at").isNotNull(), "uploaded_at", -F.col("ord"))
    main = F.max_by("ord", F.when(F.col("is_main"), newest)).over(Window.partitionBy(key))
    marked = sources.withColumn("__was", F.col("is_main")).withColumn("is_main", F.coalesce(F.col("is_main") & (F.col("ord") == main), F.lit(False)))
    person = F.when(~F.coalesce("__was", F.lit(False)), F.nullif("person", F.lit("")))
    kind = F.when(F.col("is_main"), 0).when(person.isNotNull(), 1).otherwise(2)
    name = F.when(kind == 0, "").when(kind == 1, person).otherwise(F.col("folder"))
    rest = [c for c in sources.columns if c != key]
    kept = marked.withColumns({"kind": kind, "__name": name}).groupBy(key, "kind", "__name").agg(F.max_by(F.struct(*rest), newest).alias("s"))
    return kept.select(key, "kind", "s.*")


def dedup_listing(listing: DataFrame) -> DataFrame:
    """The change scan's files (U3): the current file of each folder, newest per folder and name over inboxes."""
    current = latest_schedule(listing.where(N.is_listed_folder(F.col("folder"))))
    newest = F.struct(F.col("uploaded_at").isNotNull(), "uploaded_at", -F.col("list_pos"))
    return current.groupBy("folder", "name").agg(F.max("uploaded_at").alias("uploaded_at"), F.max_by("url", newest).alias("url"))


def split_main_and_detail(sources: DataFrame, key: str = "meeting_id") -> DataFrame:
    """The main document and one a person (U8): sources without a person that aren't main are not used, a person's last counts."""
    used = sources.where("is_main OR (person IS NOT NULL AND person != '')")
    role = F.when(F.col("is_main"), F.lit("")).otherwise(F.col("person"))
    return used.groupBy(key, F.col("is_main"), role.alias("person")).agg(F.max_by("url", "ord").alias("url"))


