"""Column lists and types of the tables that flow between operators."""

from pyspark.sql import types as T

KEY = ["dataset", "strategy", "sample_idx", "condition"]

# The field names and layouts of the log format, which must match.
SCORE_METRICS = ["substring_match", "is_numeric_close", "token_f1", "rouge_l"]

_LOG_FIELDS = [
    ("dataset", T.StringType()),
    ("strategy", T.StringType()),
    ("sample_idx", T.LongType()),
    ("question", T.StringType()),
    ("gold_answer", T.StringType()),
    ("generation", T.StringType()),
    ("predicted_answer", T.StringType()),
    ("is_correct", T.IntegerType()),
    ("parse_failed", T.IntegerType()),
    ("substring_match", T.IntegerType()),
    ("is_numeric_close", T.IntegerType()),
    ("token_f1", T.DoubleType()),
    ("rouge_l", T.DoubleType()),
    ("prompt_tokens", T.LongType()),
    ("completion_tokens", T.LongType()),
    ("total_tokens", T.LongType()),
    ("latency_s", T.DoubleType()),
    ("condition", T.StringType()),
]

LOG_TYPES = dict(_LOG_FIELDS)
LOG_TYPES["bertscore_f1"] = T.DoubleType()

RUN_LOG = T.StructType([T.StructField(n, t) for n, t in _LOG_FIELDS])
LOG_COLUMNS = RUN_LOG.names

# Layouts of the three generations of run logs.
LOG_V1 = LOG_COLUMNS[:9]
LOG_V2 = LOG_V1 + ["prompt_tokens", "completion_tokens", "total_tokens", "latency_s", "condition"]
LOG_V3 = LOG_COLUMNS

SAMPLES = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("sample_idx", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer_raw", T.StringType()),
])

GENERATIONS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("sample_idx", T.LongType()),
    T.StructField("condition", T.StringType()),
    T.StructField("path_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("latency_s", T.DoubleType()),
])
