"""Reading raw streams and writing matches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import cut


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and seq of a text file, or of a folder of files in the order of their paths: 0 for the first line, one more for each further line.

    Lines are numbered inside each split of a file as they are read; what comes before a split is summed over a table of
    one row for each split. Only that table is sorted, and no line is shuffled. An empty folder gives no rows.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    upto = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(cut(splits), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("value", (F.col("id") + F.col("shift")).alias("seq"))


def from_items(spark: SparkSession, items: Iterable[str]) -> DataFrame:
    """A stream put together by hand."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(items)], "value string, seq long")


#: Bits of a stream's numbers that count the lines of a file.
LINE_BITS = 22


def stream_lines(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A streaming source of lines: value and seq of files that arrive in a folder, up to so many in a batch.

    A stream has no count of what came before, so seq is the millisecond of the file's modification, then the line in the file:
    lines are in order, and those of a file follow each other without a gap. Files have to differ in that millisecond. A file
    is read whole by one task; one of more than 2^LINE_BITS lines fails the query.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n", -1)
    rows = raw.where("value <> ''").select(F.unix_millis("_metadata.file_modification_time").alias("ms"), F.posexplode(lines).alias("line", "value"))
    too_long = F.raise_error(F.lit(f"a file of a stream has more than {1 << LINE_BITS} lines")).cast("long")
    return rows.select("value", F.when(F.col("line") < 1 << LINE_BITS, F.shiftleft("ms", LINE_BITS) + F.col("line")).otherwise(too_long).alias("seq"))


def first(events: DataFrame) -> Row | None:
    return events.orderBy("seq").first()


def last(events: DataFrame) -> Row | None:
    return events.orderBy(F.desc("seq")).first()


def matches(df: DataFrame) -> Iterator[Row]:
    """The matches one by one, a partition at a time on the driver."""
    return df.toLocalIterator()


def write_text(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """Write match texts (see match_lines), a match followed by an empty line."""
    out = lines.select(F.concat("value", F.lit("\n")).alias("value"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def stream_text(lines: DataFrame, path: str, checkpoint: str):
    """Write match texts as they are found."""
    return lines.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def generate_sensors(spark: SparkSession, rows: int, seed: int = 0, start: str = "2024-01-01 00:00:00", step_s: int = 10) -> DataFrame:
    """Invented sensor lines (value, seq), one every step_s seconds: the same ones for the same seed."""
    r = lambda k: F.rand(seed * 31 + k)
    ts = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("id") * step_s), "MM/dd/yyyy HH:mm:ss")
    kind = F.element_at(F.array(F.lit("PressTemp"), F.lit("Accelerometer"), F.lit("Magnetometer")), (F.floor(r(1) * 3) + 1).cast("int"))
    x = [F.round(r(k) * 10, 2).cast("string") for k in (2, 3, 4, 5)]
    df = spark.range(rows).select(F.col("id").alias("seq"), kind.alias("kind"), ts.alias("t"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
    tail = F.when(F.col("kind") == "PressTemp", F.concat_ws(",", "x1", "x2")).otherwise(F.concat_ws(",", "x1", "x2", "x3"))
    return df.select(F.concat_ws(",", "kind", "t", "x0", tail).alias("value"), "seq")
