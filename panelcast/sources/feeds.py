"""Market XML documents and JSON quote feeds as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.dedupe import keep_one

_POINT = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("price.amount", T.DoubleType()),
    T.StructField("quantity", T.DoubleType()),
])
_PERIOD = T.StructType([
    T.StructField("timeInterval", T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])),
    T.StructField("resolution", T.StringType()),
    T.StructField("Point", T.ArrayType(_POINT)),
])
SERIES = T.StructType([
    T.StructField("MktPSRType", T.StructType([T.StructField("psrType", T.StringType())])),
    T.StructField("Period", T.ArrayType(_PERIOD)),
])
DOCUMENT = T.StructType([T.StructField("TimeSeries", T.ArrayType(SERIES))])


def _points(series: DataFrame, keys) -> DataFrame:
    """TimeSeries rows -> one row per Point with its stamp and value, first duplicate kept."""
    periods = series.select(*keys, F.col("s.MktPSRType.psrType").alias("psr_type"), F.explode("s.Period").alias("p"), "_order")
    pts = periods.select(*keys, "psr_type", "_order", "p.timeInterval.start", "p.resolution", F.posexplode("p.Point").alias("_at", "pt"))
    minutes = F.when(F.col("resolution").contains("60"), 60).otherwise(15)
    start = F.unix_micros(F.coalesce(
        F.try_to_timestamp("start", F.lit("yyyy-MM-dd'T'HH:mmXXX")), F.try_to_timestamp("start")
    ))
    out = pts.select(
        *keys, "psr_type",
        F.timestamp_micros(start + (F.col("pt.position") - 1).cast("bigint") * minutes * 60_000_000).alias("ts"),
        F.coalesce(F.col("pt")["price.amount"], F.col("pt.quantity")).alias("value"),
        F.struct("_order", F.col("start"), "_at").alias("_seq"),
    ).where(F.col("value").isNotNull())
    return keep_one(out, [*keys, "ts", "psr_type"], "_seq", last=False).select(*keys, "ts", "psr_type", "value")


def parse_documents(df: DataFrame, xml: str = "xml", keys=()) -> DataFrame:
    """Documents held as strings, one per row, with any default namespace."""
    doc = F.from_xml(F.col(xml), DOCUMENT, {"mode": "PERMISSIVE"})
    rows = df.select(*keys, doc.alias("d")).select(*keys, F.posexplode("d.TimeSeries").alias("_order", "s"))
    return _points(rows, list(keys))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document files; each TimeSeries element is one row, so a large file splits."""
    rows = spark.read.format("xml").option("rowTag", "TimeSeries").schema(SERIES).load(path)
    rows = rows.select(F.struct(*rows.columns).alias("s"), F.col("_metadata.file_path").alias("_order"))
    return _points(rows, [])


_QUOTES = T.StructType([
    T.StructField("unix_seconds", T.ArrayType(T.LongType())),
    T.StructField("price", T.ArrayType(T.DoubleType())),
])


def daily_last_quotes(df: DataFrame, json: str | Column = "json", keys=()) -> DataFrame:
    """``{unix_seconds: [...], price: [...]}`` payloads -> last quote per day."""
    j = F.col(json) if isinstance(json, str) else json
    doc = df.select(*keys, F.from_json(j, _QUOTES).alias("d"))
    q = doc.select(*keys, F.inline(F.arrays_zip("d.unix_seconds", "d.price"))).where(F.col("price").isNotNull())
    stamped = q.withColumn("t", F.timestamp_seconds("unix_seconds"))
    return stamped.groupBy(*keys, F.date_trunc("day", "t").alias("ts")).agg(F.max_by("price", "t").alias("price"))
