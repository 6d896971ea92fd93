"""Structured Streaming forms of the log and monitoring analyses."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import logs as G
from ..sources.logs import parse_log_lines, parse_tagged, shape_of


def stream_log_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """file, at_block, line of the files that arrive in ``folder``."""
    return (spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at_block"),
                    F.trim("value").alias("line"))
            .filter(F.col("line") != ""))


TAGGED = "file string, format string, line string, header string"


class FileHead(StatefulProcessor):
    """Keeps the format of a file and its last ``#Fields:`` line, and hands them to its
    lines. ``days``: how long a silent file is remembered, without end if None.

    Lines of one micro-batch are put in order of block and place. A file without a
    header so far has the shape of its first content line for a format; one that fits
    nothing is left open until a later line tells.
    """

    def __init__(self, days: float | None):
        self.ttl = None if days is None else int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "format string, header string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        format, header = self.head.get() if self.head.exists() else (None, None)
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["at_block", "place"], kind="stable")
        headers, formats = [], []
        for line in frame["line"]:
            if line[:8].lower() == "#fields:":
                format, header = "iis", line
            elif line[:19].lower() == "#software: microsoft":
                format = "iis"
            elif format is None and not line.startswith("#"):
                format = shape_of(line)
            headers.append(header)
            formats.append(format or "unknown")
        self.head.update((format, header))
        yield pd.DataFrame({"file": key[0], "format": formats, "line": frame["line"].to_numpy(), "header": headers})

    def close(self) -> None:
        pass


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each line in its task, which reads a split in order."""
    n = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(n, n + b.num_rows), pa.int64())], [*b.schema.names, "place"])
        n += b.num_rows


def stream_tagged_lines(lines: DataFrame, days: float | None = None) -> DataFrame:
    """file, format, line, fields of a stream of lines: state per file holds its format and
    header, so a header change or a batch that starts amid a file is read as in one
    piece. With ``days``, files silent for so long are forgotten; such a query runs batches
    all the time, so it suits a continuous trigger only. Needs the RocksDB state store."""
    placed = lines.select("file", F.col("at_block").cast("long").alias("at_block"), "line").mapInArrow(
        _placed, "file string, at_block long, line string, place long")
    tagged = placed.groupBy("file").transformWithStateInPandas(
        FileHead(days), outputStructType=TAGGED, outputMode="Append", timeMode="None" if days is None else "ProcessingTime")
    names = F.split(F.trim(F.regexp_replace("header", "(?i)^#Fields:", "")), r"\s+")
    return tagged.select("file", "format", "line", names.alias("fields"))


def stream_hits(lines: DataFrame, format: str | None = None, days: float | None = None, tz: str = "ignore") -> DataFrame:
    """Hits of a stream of lines: of one format, or by file with ``stream_tagged_lines``.
    The latter is a query of its own: write its rows, and aggregate the table as a stream."""
    parsed = parse_log_lines(lines, format, tz) if format not in (None, "iis") else parse_tagged(stream_tagged_lines(lines, days), tz)
    return parsed.filter(F.col("hit").isNotNull()).select("file", "hit.*")


def stream_crawl_waste(lines: DataFrame, window: str = "1 hour", slide: str | None = None,
                       watermark: str = "1 hour", format: str = "combined") -> DataFrame:
    """Waste shares per bot and event-time window of lines of one format; rows later than
    the watermark are dropped and counted (``late_rows``). State holds counters per open
    window and bot only."""
    return windowed_waste(stream_hits(lines, format), window, slide, watermark)


def late_rows(query: StreamingQuery) -> int:
    """What came after its window had closed, over the batches that the query still reports:
    rows of one task, window and bot are summed before they are found late, and count once."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def windowed_waste(hits: DataFrame, window: str = "1 hour", slide: str | None = None,
                   watermark: str | None = "1 hour") -> DataFrame:
    tagged = G.with_bot(hits).filter(F.col("bot").isNotNull() & F.col("at").isNotNull())
    if watermark and hits.isStreaming:
        tagged = tagged.withWatermark("at", watermark)
    span = F.window("at", window, slide) if slide else F.window("at", window)
    out = tagged.groupBy(span.alias("w"), "bot").agg(*G.waste_columns())
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "bot",
                      *[c for c in out.columns if c not in ("w", "bot")])


_RANK = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
RUN_SCHEMA = "site string, run_id string, run_at timestamp, rule string, severity string, n_urls bigint"
ALERT_SCHEMA = "site string, run_id string, change string, rule string, severity string, from_severity string"


class RunDiff(StatefulProcessor):
    """Keeps a site's last two runs and emits what got worse in the newer one.

    One finding per rule bounds the state of a site. A run older than the current one
    is dropped. Rows of one run may arrive
    in several micro-batches.
    """

    def __init__(self, alert_on: tuple[str, ...]):
        self.alert_on = alert_on

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.earlier = handle.getMapState("earlier", "rule string", "severity string")
        self.current = handle.getMapState("current", "rule string", "severity string")
        self.run = handle.getValueState("run", "run_id string, run_at timestamp, baseline boolean")

    def _turn_over(self) -> None:
        old = {k[0]: v[0] for k, v in self.current.iterator()}
        self.earlier.clear()
        self.current.clear()
        for rule, severity in old.items():
            self.earlier.updateValue((rule,), (severity,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        out = []
        for (run_at, run_id), run in frame.groupby(["run_at", "run_id"], sort=True):
            seen = self.run.get() if self.run.exists() else None
            if seen is not None and seen[0] != run_id and run_at < pd.Timestamp(seen[1]):
                continue  # a late older run never becomes the current one
            baseline = seen is None or (seen[0] == run_id and seen[2])
            if seen is not None and seen[0] != run_id:
                self._turn_over()
            self.run.update((run_id, run_at, baseline))
            for rule, severity in zip(run["rule"], run["severity"]):
                self.current.updateValue((rule,), (severity,))
                if baseline or severity not in self.alert_on:
                    continue
                was = self.earlier.getValue((rule,))[0] if self.earlier.containsKey((rule,)) else None
                if was is None:
                    out.append((key[0], run_id, "appeared", rule, severity, None))
                elif _RANK[severity] < _RANK[was]:
                    out.append((key[0], run_id, "worsened", rule, severity, was))
        yield pd.DataFrame(out, columns=["site", "run_id", "change", "rule", "severity", "from_severity"])

    def close(self) -> None:
        pass


def stream_run_alerts(runs: DataFrame, alert_on: tuple[str, ...] = ("Critical", "High")) -> DataFrame:
    """Regressions per run of a stream of findings (``RUN_SCHEMA``); the first run
    of a site is the baseline and stays silent. Needs the RocksDB state store."""
    return runs.groupBy("site").transformWithStateInPandas(
        RunDiff(tuple(alert_on)), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="None")
