"""Feed readers: headerless tab-separated files, plain, compressed or zipped."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswire import schemas
from presswire.functions import fixed_values as V
from presswire.functions.numeric import to_double

CSV_OPTIONS = {"sep": "\t", "header": "false", "mode": "PERMISSIVE", "quote": '"', "escape": '"'}
LINES_PER_FRAME = 10_000


def type_event_columns(feed: DataFrame) -> DataFrame:
    """Cast the text columns of the event feed; bad cells become NULL."""
    return feed.select(
        *[
            (to_double(F.col(c)) if c in schemas.NUMERIC_EVENT_COLUMNS else F.col(c)).alias(c)
            for c in V.EVENT_FEED_COLUMNS.values()
        ]
    )


def type_gkg_columns(feed: DataFrame) -> DataFrame:
    """Cast the text columns of the emotion feed; bad cells become NULL."""
    return feed.select(
        *[
            (F.col(c).try_cast("bigint") if c == "DATE" else F.col(c)).alias(c)
            for c in V.GKG_FEED_COLUMNS.values()
        ]
    )


def event_feed_schema():
    return schemas.feed_schema(V.EVENT_FEED_COLUMNS, V.EVENT_FEED_WIDTH)


def gkg_feed_schema():
    return schemas.feed_schema(V.GKG_FEED_COLUMNS, V.GKG_FEED_WIDTH)


def read_event_feed(spark: SparkSession, path: str) -> DataFrame:
    """Event feed files; only the nine used fields are parsed out of each line."""
    return type_event_columns(spark.read.schema(event_feed_schema()).options(**CSV_OPTIONS).csv(path))


def read_gkg_feed(spark: SparkSession, path: str) -> DataFrame:
    """Emotion feed files; short lines give NULLs, long ones are cut."""
    return type_gkg_columns(spark.read.schema(gkg_feed_schema()).options(**CSV_OPTIONS).csv(path))


def unzip_lines(files: DataFrame) -> DataFrame:
    """Lines of every member of each archive in a `content` column.

    Archives are one feed slot each, so files are the unit of parallelism; a member is
    streamed, never held as one string.
    """

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blob in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                    for name in archive.namelist():
                        with archive.open(name) as member:
                            text = io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline="\n")
                            chunk: list[str] = []
                            for line in text:
                                chunk.append(line.rstrip("\r\n"))
                                if len(chunk) == LINES_PER_FRAME:
                                    yield pd.DataFrame({"line": chunk})
                                    chunk = []
                            if chunk:
                                yield pd.DataFrame({"line": chunk})

    return files.select("content").mapInPandas(extract, "line string")


def _parse_lines(lines: DataFrame, schema) -> DataFrame:
    parsed = F.from_csv(F.col("line"), schema.simpleString()[len("struct<"):-1].replace(":", " "),
                        {k: v for k, v in CSV_OPTIONS.items() if k != "header"})
    return lines.filter(F.col("line") != "").select(parsed.alias("f")).select("f.*")


def zipped_events(files: DataFrame) -> DataFrame:
    return type_event_columns(_parse_lines(unzip_lines(files), event_feed_schema()))


def zipped_gkg(files: DataFrame) -> DataFrame:
    return type_gkg_columns(_parse_lines(unzip_lines(files), gkg_feed_schema()))


def read_zipped(spark: SparkSession, glob: str, feed: str = "events") -> DataFrame:
    """Feed rows of all archives below `glob`; `feed` is `events` or `gkg`."""
    files = spark.read.format("binaryFile").load(glob)
    return {"events": zipped_events, "gkg": zipped_gkg}[feed](files)


# -- slots --------------------------------------------------------------------

def slot_start(moment: dt.datetime, lag_minutes: int = 20) -> dt.datetime:
    """Start of the newest quarter hour that is at least `lag_minutes` old."""
    settled = moment - dt.timedelta(minutes=lag_minutes)
    return settled.replace(minute=settled.minute // 15 * 15, second=0, microsecond=0)


def slot_name(slot: Column, feed: str) -> Column:
    suffix = {"events": V.EVENT_SLOT_SUFFIX, "gkg": V.GKG_SLOT_SUFFIX}[feed]
    return F.concat(F.date_format(slot, "yyyyMMddHHmm00"), F.lit(suffix))


def missing_slots(
    landed: DataFrame, start: dt.datetime, end: dt.datetime, feed: str = "events"
) -> DataFrame:
    """Expected quarter-hour files from `start` to `end` that are not in `landed.file_name`."""
    slots = max(0, (end - start) // dt.timedelta(minutes=15) + 1)
    at = F.lit(start).cast("timestamp_ntz") + F.col("id") * F.expr("interval 15 minutes")
    expected = landed.sparkSession.range(slots).select(at.alias("slot_ts")).select("slot_ts", F.lit(feed).alias("feed"), slot_name(F.col("slot_ts"), feed).alias("file_name"))
    return expected.join(landed.select("file_name"), "file_name", "left_anti").select(
        "slot_ts", "feed", "file_name"
    )
