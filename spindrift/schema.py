"""Schemas of the engine's tables."""

from pyspark.sql import types as T

#: A semantic chunk of a source file. Paths are relative to the repository root.
CHUNKS = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("parent_name", T.StringType()),
        T.StructField("calls", T.ArrayType(T.StringType())),
        T.StructField("outline", T.ArrayType(T.StringType())),
        T.StructField("imports", T.ArrayType(T.StringType())),
    ]
)
FILES = "file_path string, language string, size_bytes long, file_hash string"
POSTINGS = "file_path string, field string, term string, chunk_id long, tf long, size int"
CALLERS = "callee string, caller string, times long"
QUERY_LOG = "saved long, queried_at timestamp"
EMBEDDED = T.StructType([*CHUNKS.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
#: What searches need of chunks beside contents and vectors, kept so that they read no content.
META = "chunk_id long, file_path string, dir string, name string, norm string, chunk_type string, language string, line_start int, filled int, calls array<string>"
