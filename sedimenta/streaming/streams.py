"""Structured Streaming: windowed counts with late data, first-seen rows, and integrity of numbered batches."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.sources.shared import shared_dir


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A table (a folder of files, or one file) as a stream, some files a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    part = spark.read.parquet(path).select("_metadata.file_path").first()
    single_file = part is not None and part[0].rpartition("/")[2] == name
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    stream = stream.option("pathGlobFilter", name).parquet(folder) if single_file else stream.parquet(path)
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]  # watermarks need an instant
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and keys; the watermark bounds the state."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and read what it wrote to the shared folder.

    In complete mode each batch replaces the table; in append mode rows are added.
    """
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/sedimenta/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        writer = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/table"))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/table")
    query = writer.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def batch_faults(batches: DataFrame, stream: str = "stream_id", index: str = "batch_index") -> DataFrame:
    """stream, fault of streams of numbered batches: an index that repeats, or one that is missing from 0 on."""
    by = batches.groupBy(stream).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("d"), F.max(index).alias("last"))
    faults = F.filter(F.array(F.when(F.col("n") > F.col("d"), "duplicate"), F.when(F.col("last") + 1 > F.col("d"), "gap")), lambda x: x.isNotNull())
    return by.select(stream, F.explode(faults).alias("fault"))


def numbered_events(spark: SparkSession, path: str) -> DataFrame:
    """id, line_no, event_no of log lines (id, line_no, line) that come file by file, in the order of their numbers.

    The number of events that a source has had is its state, so an event goes on in the next batch. A batch's lines of one
    source are numbered in one task.
    """
    from sedimenta.operators.physical import recognised_line

    schema = spark.read.parquet(path).schema
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    marked = lines.select("id", "line_no", recognised_line(F.col("line"))["grammar"].isNotNull().alias("opens"))
    kinds = {c: schema[c].dataType.simpleString() for c in ("id", "line_no")}

    def number(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("line_no")
        before = state.get[0] if state.exists else 0
        rows["event_no"] = before + rows["opens"].astype("int64").cumsum()
        state.update((int(rows["event_no"].iloc[-1]),))
        yield rows[["id", "line_no", "event_no"]]

    out = f"id {kinds['id']}, line_no {kinds['line_no']}, event_no long"
    return run_to_table(marked.groupBy("id").applyInPandasWithState(number, out, "event_no long", "append", "NoTimeout"), "append")


def manifest_integrity(messages: DataFrame, stream: str = "stream_id", time: str = "ts", late: str = "1 hour", lease: float = 3600.0) -> DataFrame:
    """stream, batches, rows, faults of numbered batches that come in any order and end with a manifest.

    ``messages``: stream, kind (batch or manifest), number (a batch's index from 0, a manifest's count of batches), rows (of the
    batch, of all batches) and event time. A stream is done, and its state goes, once its manifest is there and every
    index below its count was seen; faults are then, in order: duplicate (an index came twice), beyond (an index not
    below the count), rows (the batches' rows are not the manifest's). A stream that is not done ``lease`` seconds of event
    time after its last message is given up: gap (with a manifest) or unterminated (without), and the same faults.

    Seen indexes are kept as ranges, so that a stream in order costs one range, however long it is.
    """
    kind = messages.schema[stream].dataType.simpleString()

    def judge(key, frames, state):
        begins, ends, rows, twice, total, told, last = state.get if state.exists else ([], [], 0, 0, None, None, 0)
        seen = Ranges(begins, ends)
        if not state.hasTimedOut:
            for f in frames:
                batches, manifests = f[f["kind"] == "batch"], f[f["kind"] == "manifest"]
                twice += seen.add(batches["number"].to_numpy("int64"))
                rows += int(batches["rows"].sum())
                if len(manifests):
                    total, told = int(manifests["number"].iloc[-1]), int(manifests["rows"].iloc[-1])
                last = max(last, int(f[time].max().timestamp() * 1000))
        done = total is not None and seen.covers(total)
        if done or state.hasTimedOut:
            state.remove()
            faults = [] if done else ["gap" if total is not None else "unterminated"]
            faults += ["duplicate"] * bool(twice) + ["beyond"] * (total is not None and seen.end() > total) + ["rows"] * (total is not None and rows != told)
            yield pd.DataFrame({stream: [key[0]], "batches": [seen.count()], "rows": [rows], "faults": [",".join(faults)]})
        else:
            state.update((seen.begins, seen.ends, rows, twice, total, told, last))
            state.setTimeoutTimestamp(last + int(lease * 1000))

    held = "begins array<long>, ends array<long>, rows long, twice long, total long, told long, last long"
    timed = messages.select(stream, "kind", "number", "rows", time).withWatermark(time, late)
    return timed.groupBy(stream).applyInPandasWithState(judge, f"{stream} {kind}, batches long, rows long, faults string", held, "append", "EventTimeTimeout")


class Ranges:
    """A set of whole numbers as sorted ranges, ends exclusive."""

    def __init__(self, begins, ends):
        self.begins, self.ends = [int(x) for x in begins], [int(x) for x in ends]

    def add(self, numbers: np.ndarray) -> int:
        """Put numbers in; how many of them were there before, or came more than once."""
        if not len(numbers):
            return 0
        fresh, counts = np.unique(numbers, return_counts=True)
        begins, ends = np.array(self.begins, np.int64), np.array(self.ends, np.int64)
        at = np.searchsorted(begins, fresh, "right") - 1
        there = (at >= 0) & (fresh < ends[np.maximum(at, 0)]) if len(begins) else np.zeros(len(fresh), bool)
        new = fresh[~there]
        all_begins, all_ends = np.concatenate((begins, new)), np.concatenate((ends, new + 1))
        order = np.argsort(all_begins)
        all_begins, all_ends = all_begins[order], all_ends[order]
        starts = np.ones(len(all_begins), bool)
        starts[1:] = all_begins[1:] > all_ends[:-1]
        last = np.append(np.flatnonzero(starts)[1:], len(all_begins)) - 1
        self.begins, self.ends = all_begins[starts].tolist(), all_ends[last].tolist()
        return int(there.sum() + (counts - 1).sum())

    def covers(self, total: int) -> bool:
        return total == 0 or bool(self.begins) and self.begins[0] <= 0 and self.ends[0] >= total

    def count(self) -> int:
        return sum(self.ends) - sum(self.begins)

    def end(self) -> int:
        return self.ends[-1] if self.ends else 0
