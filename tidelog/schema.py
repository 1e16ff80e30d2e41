"""Schemas and fixed names of the event model."""

from pyspark.sql import types as T

LOG = T.StructType([
    T.StructField("position", T.LongType()),
    T.StructField("stream", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("data", T.StringType()),
    T.StructField("metadata", T.StringType()),
])
CATALOG = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("created", T.LongType()),
    T.StructField("max_age", T.LongType()),
    T.StructField("max_count", T.IntegerType()),
    T.StructField("state", T.IntegerType()),
    T.StructField("permissions", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
INDEX = T.StructType([
    T.StructField("stream", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("position", T.LongType()),
])

# Fixed values of the event model: names that stored data uses.
SYSTEM_PREFIX = "_"
STREAMS_STREAM = "_streams"
INDEX_STREAM = "_index"
PROJECTIONS_STREAM = "_projections"
LINK_TYPE = "_>"
STREAM_CREATED = "_STREAM_CREATED"
STREAM_UPDATED = "_STREAM_UPDATED"
STREAM_DELETED = "_STREAM_DELETED"
INDEX_FLUSHED = "_INDEX_FLUSHED"
NO_VERSION = -1
NO_LIMIT = -1
PERMISSION_READ = 1
PERMISSION_WRITE = 2
