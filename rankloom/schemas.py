"""Table schemas. Scores and metadata are keyed by ``item_id``, never by position."""

from pyspark.sql import types as T

# Column headers of the catalog and result files (fixed values).
NAME = "Assessment Name"
DESCRIPTION = "Short Description"
URL = "URL"
EMBEDDING_TEXT = "text_for_embedding"
ITEM_TYPE = "assessment_type"
RESULT_HEADER = [NAME, URL, "score", ITEM_TYPE]

# The six catalog classes (fixed values).
ITEM_TYPES = [
    "Personality & Behavior",
    "Cognitive",
    "Simulation",
    "Technical Skills",
    "Language",
    "General",
]


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


CATALOG_RAW = _struct(
    (NAME, T.StringType(), True),
    (DESCRIPTION, T.StringType(), True),
    (URL, T.StringType(), True),
)

EMBEDDINGS = _struct(
    ("item_id", T.LongType(), False),
    ("vector", T.ArrayType(T.FloatType(), False), False),
)

RUN_CONFIG = _struct(
    ("model_name", T.StringType(), True),
    ("embedding_dimension", T.IntegerType(), True),
    ("num_assessments", T.LongType(), True),
    ("input_file", T.StringType(), True),
    ("embeddings_file", T.StringType(), True),
    ("metadata_file", T.StringType(), True),
)

SEARCH_HISTORY = _struct(
    ("id", T.LongType(), False),
    ("session_id", T.StringType(), False),
    ("query", T.StringType(), False),
    ("result_count", T.IntegerType(), True),
    ("method", T.StringType(), True),
    ("query_time_ms", T.DoubleType(), True),
    ("item_type", T.StringType(), True),
    ("created_at", T.TimestampType(), True),
)

QUERY_ANALYTICS = _struct(
    ("id", T.LongType(), False),
    ("query", T.StringType(), False),
    ("result_count", T.IntegerType(), True),
    ("method", T.StringType(), True),
    ("query_time_ms", T.DoubleType(), True),
    ("cached", T.BooleanType(), True),
    ("created_at", T.TimestampType(), True),
)

TRUTH = _struct(
    ("Query", T.StringType(), True),
    ("Assessment_url", T.StringType(), True),
)
