"""Formats of raw streams: a formatter turns lines (a DataFrame with value and seq) into events; a classifier is a column."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Formatter(Protocol):
    """A formatter: lines in, events with seq, event_type, us and attributes out."""

    def __call__(self, lines: DataFrame) -> DataFrame: ...


def number(value: Column) -> Column:
    """A number from text, null where it is none; integers keep their value in a double."""
    return F.trim(value).try_cast("double")


class StockFormatter:
    """Lines ticker,yyyyMMddHHmm,open,peak,low,close,volume[,probability]; the ticker is the type."""

    FIELDS = ["opening_price", "peak_price", "lowest_price", "close_price"]

    def __init__(self, classifier: Column | None = None) -> None:
        self.classifier = classifier

    def __call__(self, lines: DataFrame) -> DataFrame:
        v = F.split("value", ",")
        at = lambda i: F.get(v, F.lit(i))
        df = lines.where("trim(value) <> ''").select(
            "seq", F.trim(at(0)).alias("ticker"), F.trim(at(1)).try_cast("long").alias("date"),
            *[number(at(i + 2)).alias(n) for i, n in enumerate(self.FIELDS)], F.trim(at(6)).try_cast("long").alias("volume"), number(at(7)).alias("prob"),
        )
        ts = F.to_timestamp(F.col("date").cast("string"), "yyyyMMddHHmm")
        return df.withColumn("event_type", F.col("ticker") if self.classifier is None else self.classifier).withColumn("us", F.unix_micros(ts))


class SensorFormatter:
    """Lines type,MM/dd/yyyy HH:mm:ss,amplitude,... with a layout for each type; attributes of other layouts are null."""

    LAYOUTS = {"PressTemp": ["pressure", "temperature"], "Accelerometer": ["acc_x", "acc_y", "acc_z"], "Magnetometer": ["mag_x", "mag_y", "mag_z"]}

    def __call__(self, lines: DataFrame) -> DataFrame:
        v = F.split("value", ",")
        kind = F.trim(F.get(v, F.lit(0)))
        cols = [number(F.when(kind == k, F.get(v, F.lit(i + 3)))).alias(n) for k, names in self.LAYOUTS.items() for i, n in enumerate(names)]
        ts = F.to_timestamp(F.trim(F.get(v, F.lit(1))), "MM/dd/yyyy HH:mm:ss")
        return lines.where("trim(value) <> ''").select("seq", kind.alias("event_type"), F.unix_micros(ts).alias("us"), number(F.get(v, F.lit(2))).alias("amplitude"), *cols)


class TweetFormatter:
    """JSON lines of one type, Tweet; place and retweeted_status are flattened to place.full_name and retweeted_status.id."""

    SCHEMA = T.StructType(
        [
            T.StructField("id", T.LongType()), T.StructField("created_at", T.StringType()), T.StructField("text", T.StringType()),
            T.StructField("truncated", T.BooleanType()), T.StructField("in_reply_to_status_id", T.LongType()), T.StructField("in_reply_to_user_id", T.LongType()),
            T.StructField("in_reply_to_screen_name", T.StringType()), T.StructField("user", T.StructType([T.StructField("id", T.LongType()), T.StructField("screen_name", T.StringType()), T.StructField("followers_count", T.LongType())])),
            T.StructField("is_quote_status", T.BooleanType()), T.StructField("retweet_count", T.LongType()), T.StructField("favorite_count", T.LongType()),
            T.StructField("favorited", T.BooleanType()), T.StructField("retweeted", T.BooleanType()), T.StructField("filter_level", T.StringType()), T.StructField("lang", T.StringType()),
            T.StructField("quoted_status_id", T.LongType()), T.StructField("quote_count", T.LongType()), T.StructField("reply_count", T.LongType()),
            T.StructField("place", T.StructType([T.StructField("full_name", T.StringType())])), T.StructField("retweeted_status", T.StructType([T.StructField("id", T.LongType())])),
        ]
    )

    def __init__(self, words: list[str] | None = None) -> None:
        self.words = words

    def __call__(self, lines: DataFrame) -> DataFrame:
        j = F.from_json("value", self.SCHEMA)
        df = lines.withColumn("j", j).where("j.id is not null").select("seq", "j.*")
        # Sun Nov 10 12:00:00 +0000 2024: the weekday says nothing, and all times are UTC.
        ts = F.to_timestamp(F.regexp_replace("created_at", "^\\w+ (\\w+ \\d+ [\\d:]+) \\+0000 (\\d+)$", "$1 $2"), "MMM dd HH:mm:ss yyyy")
        df = df.withColumn("place", F.col("place.full_name")).withColumn("retweeted_status", F.col("retweeted_status.id"))
        if self.words:
            some = F.lit(False)
            for w in self.words:
                some = some | F.contains(F.lower("text"), F.lit(w.lower()))
            df = df.where(some)
        return df.withColumn("event_type", F.lit("Tweet")).withColumn("us", F.unix_micros(ts))
