"""Metadata versions of drives, their history, snapshots, and reconciliation of local and remote state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.errors import CairnError
from cairn.session import Scratch


def current(versions: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """The last version of each drive."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("v")
    return versions.groupBy("drive").agg(last, F.count("*").alias("n_versions")).select("drive", *[f"v.{c}" for c in columns], "n_versions")


def original(versions: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """The first version of each drive."""
    return versions.groupBy("drive").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("v")).select("drive", *[f"v.{c}" for c in columns])


def previous(versions: DataFrame, order: list[str], column: str, span: Column | None = None) -> DataFrame:
    """Each version with the one recorded before it on its drive.

    With span, a non-decreasing function of the order (such as the day), a drive's versions are looked at span by span, so that
    one drive with most of all versions is spread; the first version of a span takes the last one of the drive's span before.
    """
    if span is None:
        return versions.withColumn("previous", F.lag(column).over(Window.partitionBy("drive").orderBy(*order)))
    rows = versions.withColumn("__span", span)
    inner = Window.partitionBy("drive", "__span").orderBy(*order)
    rows = rows.withColumn("__before", F.lag(column).over(inner)).withColumn("__first", F.row_number().over(inner) == 1)
    ends = rows.groupBy("drive", "__span").agg(F.max_by(column, F.struct(*order)).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy("drive").orderBy("__span")))
    out = rows.join(ends, ["drive", "__span"])
    return out.withColumn("previous", F.when(F.col("__first"), F.col("__end")).otherwise(F.col("__before"))).drop("__span", "__before", "__first", "__end")


def history(versions: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(id, original, depth): the version that a chain of previous pointers (id, previous) ends at, and how far it is.

    Pointers are doubled, so a chain of d versions takes log2(d) joins on unique ids. Each round is written once, and holds
    the versions alone whose end the rounds before didn't find. A chain longer than limit, or a cycle, is an error.
    """
    scratch, rounds = Scratch(versions.sparkSession, "history"), 0
    first = F.col("previous").isNull()
    rows = versions.select("id", F.col("previous").alias("at"), F.when(first, 0).otherwise(1).cast("long").alias("steps"), F.coalesce("previous", "id").alias("end"))
    rows = scratch.write(rows, "round-0")
    done, active = rows.filter("at IS NULL"), rows.filter("at IS NOT NULL")
    while not active.isEmpty():
        if 1 << rounds > limit:
            raise CairnError(f"a history has more than {limit} versions")
        every = done.unionByName(active)
        nxt = every.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("more"), F.col("end").alias("end2"))
        active = active.join(nxt, "at", "left").select(
            "id", F.col("at2").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("end2", "end").alias("end")
        )
        rounds += 1
        rows = scratch.write(active, f"round-{rounds}")
        done, active = done.unionByName(rows.filter("at IS NULL")), rows.filter("at IS NOT NULL")
    too_long = done.filter(F.col("steps") >= limit)
    if (1 << rounds) > limit and not too_long.isEmpty():
        raise CairnError(f"a history has more than {limit} versions")
    return done.select("id", F.col("end").alias("original"), F.col("steps").alias("depth"))


def snapshot_cids(*sources: DataFrame) -> DataFrame:
    """Distinct live contents of all sources (cid)."""
    out = sources[0].select("cid")
    for s in sources[1:]:
        out = out.unionByName(s.select("cid"))
    return out.filter("cid IS NOT NULL").distinct()


def sync_state(local_metadata: Column, local_root: Column, remote_metadata: Column, remote_root: Column, has_local: Column, known: Column) -> Column:
    """State of a drive; known: whether any remote version has the local metadata root."""
    return (
        F.when(remote_metadata.isNull(), "unpublished")
        .when(~has_local, "unlocalized")
        .when((local_metadata == remote_metadata) & (local_root == remote_root), "all_synced")
        .when(local_metadata == remote_metadata, "metadata_synced")
        .when(known, "behind")
        .otherwise("ahead")
    )


def reconcile(local: DataFrame, remote: DataFrame, versions: DataFrame) -> DataFrame:
    """Full outer join of local drives (drive, metadata, root) and current remote versions (drive, metadata, root), with the state.

    Drives that were never published have no remote id and keep a row each.
    """
    mine = local.select("drive", F.col("metadata").alias("lm"), F.col("root").alias("lr"), F.lit(True).alias("has_local"))
    theirs = remote.select("drive", F.col("metadata").alias("rm"), F.col("root").alias("rr"))
    seen = versions.select("drive", F.col("metadata").alias("lm")).distinct().withColumn("known", F.lit(True))
    both = mine.join(theirs, "drive", "full_outer").join(seen, ["drive", "lm"], "left")
    state = sync_state(F.col("lm"), F.col("lr"), F.col("rm"), F.col("rr"), F.coalesce("has_local", F.lit(False)), F.coalesce("known", F.lit(False)))
    return both.select("drive", F.col("lm").alias("local_metadata"), F.col("rm").alias("remote_metadata"), state.alias("state"))


def push(versions: DataFrame, new: DataFrame) -> DataFrame:
    """The versions with new ones; each drive's older ones become outdated."""
    drives = new.select("drive").distinct().withColumn("__new", F.lit(1))
    old = versions.join(drives, "drive", "left").withColumn("state", F.when((F.col("__new") == 1) & (F.col("state") == "current"), "outdated").otherwise(F.col("state"))).select(*versions.columns)
    return old.unionByName(new.withColumn("state", F.lit("current")).select(*versions.columns))


def restore_snapshot(versions: DataFrame, snapshots: DataFrame, snapshot_id: str) -> DataFrame:
    """The versions with the snapshot's one as its drive's current."""
    chosen = snapshots.filter(F.col("id") == snapshot_id).select(F.col("drive").alias("drive"), F.col("metadata_id").alias("__id"))
    out = versions.join(chosen, "drive", "left")
    state = F.when(F.col("__id").isNull(), F.col("state")).when(F.col("id") == F.col("__id"), "current").when(F.col("state") == "current", "outdated").otherwise(F.col("state"))
    return out.withColumn("state", state).select(*versions.columns)


def create_snapshot(snapshots: DataFrame, versions_: DataFrame, version_id: str, snapshot_id: str, cids: DataFrame) -> DataFrame:
    """The snapshots with one of a version: its size is that of the live contents (cid, len)."""
    size = cids.dropDuplicates(["cid"]).agg(F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("size"))
    new = versions_.filter(F.col("id") == version_id).crossJoin(F.broadcast(size)).select(  # one row each
        F.lit(snapshot_id).alias("id"), "drive", F.col("id").alias("metadata_id"), "size", F.col("created_at")
    )
    return snapshots.unionByName(new.select(*snapshots.columns))


def resolve_id(drives: DataFrame) -> DataFrame:
    """Drives with the id that requests use: the remote one, else the one that the local drive remembers; none is an error."""
    return drives.withColumn("use_id", F.coalesce("remote_id", "local_remote_id", F.raise_error(F.lit("a drive that was never published has no id")).cast("string")))


def listing(drives: DataFrame, columns: list[str]) -> DataFrame:
    """One text of all drives, a line each, in order; for people, so for as many as they read."""
    line = F.concat_ws("\t", *columns)
    return drives.select(line.alias("line")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
