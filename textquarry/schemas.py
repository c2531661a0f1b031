"""Table schemas shared by sources and operators."""

from pyspark.sql import types as T

SNIPPET = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("start_line", T.LongType()),
    T.StructField("end_line", T.LongType()),
    T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

TOOL_CALL = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("input", T.StringType()),
])

TOOL_RESULT = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("is_error", T.BooleanType()),
])

WEB_RESPONSE = T.StructType([
    T.StructField("web", T.StructType([
        T.StructField("results", T.ArrayType(T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("description", T.StringType()),
        ]))),
    ])),
])
