"""

Everything is nullable; uniqueness and allowed values are checked by
``operators.history.constraint_violations`` rather than enforced on write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
D, TS = T.DateType(), T.TimestampType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SOURCE = _struct(("digest_type", S), ("source_idx", I), ("source_name", S), ("org", S),
                 ("category", S), ("feed_url", S), ("source_filter", T.ArrayType(S)),
                 ("disabled", B), ("is_section", B))

SETTINGS = _struct(("digest_type", S), ("days_back", I), ("max_items_per_source", I),
                   ("min_items_to_send", I), ("model", S), ("dedup_days", I))

ENTRY = _struct(("digest_type", S), ("source_idx", I), ("pos", I), ("org", S), ("category", S),
                ("source_name", S), ("source_filter", T.ArrayType(S)), ("link", S),
                ("entry_id", S), ("title", S), ("summary", S), ("description", S),
                ("author", S), ("pub_ts", TS))

ARTICLE = _struct(("digest_type", S), ("source_idx", I), ("pos", I), ("org", S),
                  ("category", S), ("source_name", S), ("title", S), ("summary", S),
                  ("link", S), ("published", S), ("pub_ts", TS))

DIGEST_RUN = _struct(("id", L), ("run_date", D), ("digest_type", S), ("source_count", I),
                     ("item_count", I), ("markdown", S), ("trends_raw", S),
                     ("feature_pitch_raw", S), ("created_at", TS), ("chunk_no", I), ("n_chunks", I))

SEEN_LINK = _struct(("link", S), ("digest_type", S), ("first_seen", D))

DIGEST_MEMORY = _struct(("digest_type", S), ("request_id", L), ("memory", S), ("updated_at", TS))

BLOCK = _struct(("type", S), ("text", S))
RESPONSE = _struct(("request_id", L), ("digest_type", S), ("blocks", T.ArrayType(BLOCK)),
                   ("stop_reason", S), ("status_code", I), ("connection_error", B))

RULE = _struct(("kind", S), ("term", S), ("label", S), ("weight", I), ("priority", I))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select ``schema``'s columns in order, casting present ones and adding absent ones as NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])
