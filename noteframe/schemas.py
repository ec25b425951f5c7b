"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

RAW_NOTES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("length", T.LongType()),
    ]
)

NOTES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("headings", T.ArrayType(T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("frontmatter", T.VariantType()),
        T.StructField("raw_links", T.ArrayType(T.StringType())),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("raw", T.StringType()),
    ]
)

NOTE_LINKS = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("dst", T.StringType()),
    ]
)

EDIT_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("log_date", T.DateType()),
        T.StructField("tier", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)
