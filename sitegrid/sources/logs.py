"""Access logs in four formats to one table of hits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import bind
from ..session import stage_table

_JSON = ("url string, uri string, request string, ClientRequestURI string, path string, ip string, "
         "remote_addr string, ClientIP string, time string, timestamp string, "
         "EdgeStartTimestamp string, method string, ClientRequestMethod string, status string, "
         "EdgeResponseStatus string, response_code string, bytes string, EdgeResponseBytes string, "
         "body_bytes_sent string, user_agent string, ua string, ClientRequestUserAgent string, duration string, "
         "request_time string")


def read_log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, block start, line: whatever size the files are, splits are read in parallel."""
    return (spark.read.text(paths)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("at_block"),
                    F.trim("value").alias("line")).filter(F.col("line") != ""))


def looks_combined(line: Column) -> Column:
    return line.rlike(V.COMBINED_LINE)


#: Shapes by which a content line tells its format, in the order they are tried.
SHAPES = ("json", "combined", "combined-vhost")
_HEADER = "(?i)^#Fields:"


def line_shape(line: Column) -> Column:
    return (F.when(line.startswith("{"), "json").when(looks_combined(line), "combined")
            .when(looks_combined(F.regexp_replace(line, r"^\S+\s+", "")), "combined-vhost"))


def shape_of(line: str) -> str | None:
    """``line_shape`` of one line."""
    if line.startswith("{"):
        return "json"
    if re.match(V.COMBINED_LINE, line):
        return "combined"
    return "combined-vhost" if re.match(V.COMBINED_LINE, re.sub(r"^\S+\s+", "", line)) else None


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with their order within a split as column i."""
    return lines if "i" in lines.columns else lines.withColumn("i", F.monotonically_increasing_id())


def split_heads(lines: DataFrame) -> DataFrame:
    """One row per split (file, at_block): its first content line, its last ``#Fields:``
    line and whether a line marks it as IIS. All partial aggregates of one scan, which
    reads no line twice and sends one row per split and task."""
    at = F.struct("i", "line")
    line = F.col("line")
    return numbered_lines(lines).groupBy("file", "at_block").agg(
        F.min(F.when(~line.startswith("#"), at)).alias("first"),
        F.max(F.when(line.rlike(_HEADER), at))["line"].alias("header"),
        F.bool_or(line.rlike("(?i)^#Fields:|^#Software: Microsoft")).alias("iis"))


def _formats(heads: DataFrame, lines: DataFrame) -> DataFrame:
    plain = F.when(F.col("first").isNotNull(), F.struct("at_block", "first"))
    per = heads.groupBy("file").agg(F.bool_or("iis").alias("iis"), F.min(plain)["first"]["line"].alias("head"))
    known = per.select("file", F.when(F.col("iis"), "iis").when(F.col("head").isNull(), "empty")
                       .otherwise(line_shape(F.col("head"))).alias("format"))
    odd = known.filter(F.col("format").isNull()).select("file")
    # files whose first line fits nothing: the shape that most of their lines have
    seen = lines.join(odd, "file", "left_semi").filter(~F.col("line").startswith("#")).groupBy("file").agg(
        *[F.count_if(line_shape(F.col("line")) == s).alias(s) for s in SHAPES])
    most = F.greatest(*[F.col(f"`{s}`") for s in SHAPES])
    voted = seen.select("file", F.coalesce(*[F.when((most > 0) & (F.col(f"`{s}`") == most), s) for s in SHAPES]).alias("voted"))
    return known.join(voted, "file", "left").select("file", F.coalesce("format", "voted", F.lit("unknown")).alias("format"))


def detect_log_format(lines: DataFrame) -> DataFrame:
    """file, format: IIS where any line says so, else the shape of the first content
    line; where that is broken, the shape of most lines."""
    return _formats(stage_table(split_heads(lines)), lines)


def _clf_time(stamp: Column, tz: str) -> Column:
    local = F.try_to_timestamp(F.substring(stamp, 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    if tz == "ignore":
        return local
    sign = F.when(F.substring(stamp, 22, 1) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(stamp, 23, 2).try_cast("int") * 60 + F.substring(stamp, 25, 2).try_cast("int"))
    return F.timestamp_seconds(F.unix_timestamp(local) - F.coalesce(minutes, F.lit(0)) * 60)


def _number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0)).cast("bigint")


def _hit(**cols: Column) -> Column:
    order = ["ip", "at", "method", "url", "status", "bytes", "referrer", "ua", "ms"]
    types = dict(ip="string", at="timestamp", method="string", url="string", status="int", bytes="bigint",
                 referrer="string", ua="string", ms="bigint")
    return F.struct(*[cols.get(c, F.lit(None)).cast(types[c]).alias(c) for c in order])


_GROUPS = "\u0001".join(f"${i}" for i in range(1, 11))


def combined_hit(line: Column, tz: str = "ignore") -> Column:
    """Hit of a combined-format line; NULL when the line does not fit. All groups
    come from one pass of the pattern."""
    fields = F.split(F.regexp_replace(line, V.COMBINED_LINE + ".*$", _GROUPS), "\u0001")
    return bind(fields, lambda f: F.when(F.size(f) == 10, _hit(
        ip=f[0], at=_clf_time(f[2], tz), method=f[3], url=f[4], status=f[6], bytes=_number(f[7]),
        referrer=f[8], ua=f[9])))


def json_hit(line: Column) -> Column:
    """Hit of a JSON line, coalescing the field names of several vendors."""
    return bind(F.from_json(line, _JSON), lambda j: _json_fields(j, line))


def _json_fields(j: Column, line: Column) -> Column:
    def any_of(*names: str) -> Column:
        return F.coalesce(*[F.nullif(j[n], F.lit("")) for n in names])

    url = any_of("url", "uri", "request", "ClientRequestURI", "path")
    stamp = any_of("time", "timestamp", "EdgeStartTimestamp")
    epoch = stamp.try_cast("double")
    at = F.when(epoch.isNotNull(), F.timestamp_millis(epoch.cast("bigint"))).otherwise(stamp.try_cast("timestamp"))
    empty = F.lit("")
    return F.when(url.isNotNull(), _hit(
        ip=F.coalesce(any_of("ip", "remote_addr", "ClientIP"), F.get_json_object(line, "$.clientIp"), empty), at=at,
        method=F.coalesce(any_of("method", "ClientRequestMethod"), F.lit("GET")), url=url,
        status=_number(any_of("status", "EdgeResponseStatus", "response_code")),
        bytes=_number(any_of("bytes", "EdgeResponseBytes", "body_bytes_sent")),
        ua=F.coalesce(any_of("user_agent", "ua", "ClientRequestUserAgent"), empty),
        ms=F.nullif(_number(any_of("duration", "request_time")), F.lit(0).cast("bigint"))))


def iis_hit(line: Column, fields: Column) -> Column:
    """Hit of a W3C line under the column names of its file's header."""
    return bind(F.split(line, r"\s+"), lambda parts: _iis_fields(parts, fields))


def _iis_fields(parts: Column, fields: Column) -> Column:
    def get(name: str) -> Column:
        at = F.array_position(fields, name).cast("int")
        return F.when(at > 0, F.get(parts, at - 1))

    stem, query = get("cs-uri-stem"), get("cs-uri-query")
    url = F.when(query.isNotNull() & (query != "-"), F.concat(stem, F.lit("?"), query)).otherwise(stem)
    empty = F.lit("")
    return F.when(stem.isNotNull(), _hit(
        ip=F.coalesce(get("c-ip"), empty),
        at=F.concat_ws(" ", get("date"), get("time")).try_cast("timestamp"),
        method=F.coalesce(get("cs-method"), F.lit("GET")), url=url, status=_number(get("sc-status")),
        bytes=_number(get("sc-bytes")), ua=F.coalesce(F.translate(get("cs(User-Agent)"), "+", " "), empty),
        ms=F.nullif(_number(get("time-taken")), F.lit(0).cast("bigint"))))


def carried_headers(heads: DataFrame) -> DataFrame:
    """file, at_block, before: the nearest ``#Fields:`` line above each split. The last
    header of every split is carried on over the splits of its file, of which there is
    one row each."""
    above = W.partitionBy("file").orderBy("at_block").rowsBetween(W.unboundedPreceding, -1)
    return heads.select("file", "at_block", F.last("header", ignorenulls=True).over(above).alias("before"))


def _within_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``header``: the nearest header line above within the split. Lines of a split
    come in order, in one task; only headers and changes of split are looked at singly."""
    split, header = None, None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        files, blocks, lines = b.column("file"), b.column("at_block"), b.column("line")
        mark = pc.match_substring_regex(lines, _HEADER).to_numpy(zero_copy_only=False).astype(bool)
        new = np.ones(n, bool)
        for c in (files, blocks):
            new[1:] &= pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        new[1:] = ~new[1:]
        event = np.nonzero(mark | new)[0]
        in_force = []
        for i in event.tolist():
            at = (files[i].as_py(), blocks[i].as_py())
            if at != split:
                split, header = at, None
            if mark[i]:
                header = lines[i].as_py()
            in_force.append(header)
        which = np.cumsum(mark | new) - 1
        yield pa.RecordBatch.from_arrays([files, blocks, lines, pa.array(in_force, pa.string()).take(pa.array(which))],
                                         ["file", "at_block", "line", "header"])


def with_headers(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``splits`` (file, at_block, before, ...) and ``fields``,
    the column names in force: those of the nearest header above in the split, else those
    carried from the splits before. Work is linear in the lines, however often a file
    repeats its header, and no key holds more than a split. Lines that come with a place
    ``i`` are put in that order first; those of ``read_log_lines`` are read in order."""
    if "i" in lines.columns:
        lines = lines.repartition("file", "at_block").sortWithinPartitions("file", "at_block", "i")
    near = lines.select("file", F.col("at_block").cast("long").alias("at_block"), "line").mapInArrow(
        _within_splits, "file string, at_block long, line string, header string")
    names = F.split(F.trim(F.regexp_replace(F.coalesce("header", "before"), _HEADER, "")), r"\s+")
    return near.join(splits, ["file", "at_block"]).withColumn("fields", names).drop("header", "before", "at_block")


def parse_log_lines(lines: DataFrame, formats: DataFrame | str, tz: str = "ignore", heads: DataFrame | None = None) -> DataFrame:
    """Every content line with its parsed hit (NULL when malformed).

    ``formats`` is one format for all files or the table of ``detect_log_format``
    (one row per file). An IIS line is read under the nearest ``#Fields:`` line before
    it, by block and place; a file has a new one at each restart of the server.
    ``heads`` is the table of ``split_heads`` where it is known already.
    """
    if isinstance(formats, str) and formats != "iis":
        tagged = lines.select("file", "line", F.lit(formats).alias("format"), F.array().cast("array<string>").alias("fields"))
    else:
        splits = carried_headers(stage_table(split_heads(lines)) if heads is None else heads).withColumn("at_block", F.col("at_block").cast("long"))
        named = splits.withColumn("format", F.lit("iis")) if isinstance(formats, str) else splits.join(formats, "file")
        tagged = with_headers(lines, named)
    return parse_tagged(tagged, tz)


def parse_tagged(tagged: DataFrame, tz: str) -> DataFrame:
    """Hits of lines with ``format`` and ``fields`` (file, format, line, hit; NULL when malformed)."""
    line, format = F.col("line"), F.col("format")
    hit = (F.when(format == "iis", iis_hit(line, F.col("fields"))).when(format == "json", json_hit(line))
           .when(format == "combined-vhost", combined_hit(F.regexp_replace(line, r"^\S+\s+", ""), tz))
           .otherwise(combined_hit(line, tz)))
    content = ~((format == "iis") & line.startswith("#"))
    return tagged.filter(content).select("file", "format", "line", hit.alias("hit"))


def hits_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("hit").isNotNull()).select("file", "hit.*")


def parse_totals(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("file", "format").agg(
        F.count("*").alias("total"), F.count("hit").alias("parsed"),
        F.count_if(F.col("hit").isNull()).alias("skipped"))


def read_access_logs(spark: SparkSession, paths: str | list[str], format: str | None = None,
                     tz: str = "ignore") -> tuple[DataFrame, DataFrame]:
    """(hits, totals per file)."""
    lines = read_log_lines(spark, paths)
    heads = stage_table(split_heads(lines))
    parsed = parse_log_lines(lines, format or _formats(heads, lines), tz, heads)
    return hits_of(parsed), parse_totals(parsed)
