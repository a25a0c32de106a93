"""Ingest of hook events: the same functions serve batch and streaming frames.

A stream is read from files, typed, scrubbed and deduplicated under a watermark;
sessions close after a gap; small per-session states find follow-ups and fill
buffers.  State is keyed by session, so it spreads with the sessions.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.functions import text

HOOK_SCHEMA = "session_id string, hook_type string, ts timestamp, project string, cwd string, data string"

# Hooks and tools that say what an observation is.
HOOK_TYPES = {"prompt_submit": "conversation", "post_tool_failure": "error", "subagent_start": "subagent", "subagent_stop": "subagent",
              "notification": "notification", "task_completed": "task"}
TOOL_TYPES = {"Read": "file_read", "Write": "file_write", "Edit": "file_edit", "MultiEdit": "file_edit", "NotebookEdit": "file_edit", "Bash": "command_run",
              "Grep": "search", "Glob": "search", "WebFetch": "web_fetch", "WebSearch": "web_fetch", "Task": "subagent"}
# The fields of a tool's input that name files.
FILE_KEYS = ["file_path", "filepath", "path", "filePath", "file", "pattern"]


def hook_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON hook events as files arrive; a line that isn't JSON gives nulls and is dropped by ``observations``."""
    return spark.readStream.schema(HOOK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def observation_type(hook: Column, tool: Column) -> Column:
    return F.coalesce(_lookup(HOOK_TYPES, F.coalesce(hook, F.lit(""))), _lookup(TOOL_TYPES, F.coalesce(tool, F.lit(""))), F.lit("other"))


def files_of(data: Column) -> Column:
    """Distinct file names in a tool's input, of 1 to 511 characters."""
    found = F.array(*[F.get_json_object(data, f"$.tool_input.{k}") for k in FILE_KEYS])
    return F.array_distinct(F.filter(found, lambda f: f.isNotNull() & (F.char_length(f) > 0) & (F.char_length(f) < 512)))


def observations(events: DataFrame) -> DataFrame:
    """Typed, scrubbed observations with a content id; events without session, hook or time are dropped."""
    whole = events.where("session_id IS NOT NULL AND hook_type IS NOT NULL AND ts IS NOT NULL")
    tool = F.get_json_object("data", "$.tool_name")
    clean = text.scrub(F.coalesce("data", F.lit("")))
    id_ = F.substring(F.sha2(F.concat_ws("\x1f", "session_id", "hook_type", F.coalesce(tool, F.lit("")), F.left(F.coalesce("data", F.lit("")), F.lit(500)), F.sha2(F.coalesce("data", F.lit("")), 256)), 256), 1, 32)
    return whole.select(id_.alias("dedup_hash"), "session_id", "ts", "project", "cwd", "hook_type", tool.alias("tool_name"), observation_type(F.col("hook_type"), tool).alias("type"),
                        F.coalesce(files_of(F.col("data")), F.array().cast("array<string>")).alias("files"), clean.alias("narrative"))


def deduplicated(rows: DataFrame, within: str = "5 minutes") -> DataFrame:
    """A stream without repeats of an observation that come within the watermark; ``ordered.dedup_ttl`` is the exact batch form."""
    return rows.withWatermark("ts", within).dropDuplicatesWithinWatermark(["dedup_hash"])


def session_windows(rows: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap; rows up to an hour late still join theirs."""
    found = rows.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("session_id", F.col("w.start").alias("first_at"), F.col("w.end").alias("closes_at"), "n")


def follow_ups(searches: DataFrame, seconds: float = 30, late: str = "1 minute") -> DataFrame:
    """(session_id, ts, follow_up) of searches in a stream.

    The state of a session is its latest time.  It leaves the state store once the watermark has
    passed the time within which a follow-up could come; a late search never moves it back.
    """
    wait = int(seconds * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [], "ts": [], "follow_up": []}).astype({"session_id": str, "ts": "datetime64[us]", "follow_up": bool})
            return
        ts = pd.concat(list(frames))["ts"].sort_values()
        before = ts.shift(1)
        if state.exists:
            before.iloc[0] = pd.Timestamp(state.get[0], unit="us")
        gap = ts - before
        latest = max(int(ts.iloc[-1].value // 1000), state.get[0] if state.exists else 0)
        state.update((latest,))
        state.setTimeoutTimestamp(max(latest // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        follow = (gap >= pd.Timedelta(0)) & (gap <= pd.Timedelta(seconds=seconds))
        yield pd.DataFrame({"session_id": key[0], "ts": ts, "follow_up": follow.to_numpy()})

    return searches.select("session_id", "ts").withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(
        step, "session_id string, ts timestamp, follow_up boolean", "last_us long", "append", GroupStateTimeout.EventTimeTimeout)


def buffered(rows: DataFrame, most: int = 6, characters: int = 24_000, idle_ms: int = 5000) -> DataFrame:
    """(session_id, n, body): observations of a session gathered until six, 24,000 characters or five idle seconds."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int, str]] = []
        held, n = state.get if state.exists else ("", 0)
        if not state.hasTimedOut:
            for frame in frames:
                for body in frame.sort_values("ts")["narrative"]:
                    held, n = (f"{held}\n{body}" if n else body), n + 1
                    if n >= most or len(held) >= characters:
                        out.append((key[0], n, held))
                        held, n = "", 0
        elif n:
            out.append((key[0], n, held))
            n = 0
        if n:
            state.update((held, n))
            state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "n", "body"])

    return rows.select("session_id", "ts", "narrative").groupBy("session_id").applyInPandasWithState(
        step, "session_id string, n int, body string", "held string, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def land(rows: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts a query that appends a stream to Parquet files; without ``every`` it takes what is there and stops."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
