"""Change logs and incremental updates, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Watched suffixes and ignored folders.
WATCHED = r"\.(py|java|js|jsx|ts|tsx|go|json|yaml|yml|properties|sh)$"
IGNORED = r"(^|/)(\.git|node_modules|__pycache__|\.venv|venv|dist|build|target|\.idea|\.vscode|\.pytest_cache)(/|$)"


def clean_changes(changes: DataFrame) -> DataFrame:
    """Changes once each, kinds in lower case; rows without path or time are left out."""
    c = changes.where("path IS NOT NULL AND ts IS NOT NULL").select("path", F.lower(F.trim("change_type")).alias("change_type"), "ts", "old_path", "file_hash", "received_at")
    return c.dropDuplicates(["path", "change_type", "ts", "old_path", "file_hash"])


def watched(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("path").rlike(WATCHED) & ~F.col("path").rlike(IGNORED))


def detect(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two snapshots (path, hash): created, modified, deleted."""
    a, b = before.select("path", F.col("hash").alias("h1"), F.lit(1).alias("in1")), after.select("path", F.col("hash").alias("h2"), F.lit(1).alias("in2"))
    kind = F.when(F.col("in1").isNull(), "created").when(F.col("in2").isNull(), "deleted").when(~F.col("h1").eqNullSafe(F.col("h2")), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change_type")).where("change_type IS NOT NULL")


def debounced(changes: DataFrame, seconds: float = 0.5) -> DataFrame:
    """The last change of each burst: one that no change of its path follows within ``seconds``."""
    w = W.partitionBy("path").orderBy("ts", "change_type", F.coalesce("file_hash", F.lit("")))
    x = changes.withColumn("_next", F.lead("ts").over(w))
    return x.where(F.col("_next").isNull() | (F.col("_next").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double") >= seconds)).select("path", "change_type", "ts")


def snapshot(changes: DataFrame) -> DataFrame:
    """The state of each path after all changes: its last change, moves counted as deletion of the old path."""
    moved = changes.where("change_type = 'moved' AND old_path IS NOT NULL").select(F.col("old_path").alias("path"), F.lit("deleted").alias("change_type"), "ts", F.lit(None).cast("string").alias("file_hash"))
    every = changes.select("path", "change_type", "ts", "file_hash").unionByName(moved)
    # max over a struct is combined before the shuffle: a busy path is no hot spot
    last = every.groupBy("path").agg(F.max(F.struct("ts", "change_type", F.coalesce("file_hash", F.lit("")).alias("file_hash"))).alias("r"))
    return last.select("path", "r.change_type", "r.ts", "r.file_hash")


def file_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an update of files changes, by element id: added, removed, updated. old and new: file_path, id."""
    a, b = old.select("file_path", "id", F.lit(1).alias("o")), new.select("file_path", "id", F.lit(1).alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("updated")
    return a.join(b, ["file_path", "id"], "full_outer").select("file_path", "id", kind.alias("action"))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones in place of those with the same (graph_id, source_id, target_id, type)."""
    key = ["graph_id", "source_id", "target_id", "type"]
    return edges.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(*edges.columns))


def file_mapping(elements: DataFrame) -> DataFrame:
    """Elements per file: number, least and greatest id."""
    return elements.groupBy("file_path").agg(F.countDistinct("id").alias("elements"), F.min("id").alias("first"), F.max("id").alias("last"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events per window and type; on a stream ``late`` sets the watermark."""
    e = events.withWatermark("ts", late) if late else events
    win = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(win.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: start, end (of the last event) and events."""
    s = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return s.select("user_id", F.col("w.start").alias("start"), "last", "events")


def stream(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run_updates(changes: DataFrame, handler, checkpoint: str, once: bool = True):
    """Hand each micro-batch of cleaned, watched changes to ``handler(batch, id)``; state lies in the checkpoint folder."""
    w = changes.writeStream.foreachBatch(lambda b, i: handler(watched(clean_changes(b)), i)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
