"""Column names and Spark types of the interval fact table."""

from __future__ import annotations

from pyspark.sql import types as T

SUBJECT = "subject"
START = "start_date"
END = "end_date"
UPDATED = "updated_at"
LABEL = "verified_label"

#: One row per (subject, start_date) version. ``end_date`` NULL means still open.
STAY_SCHEMA = T.StructType(
    [
        T.StructField(SUBJECT, T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("birth_date", T.DateType()),
        T.StructField("category", T.StringType()),
        T.StructField(START, T.DateType()),
        T.StructField(END, T.DateType()),
        T.StructField("place", T.StringType()),
        T.StructField(LABEL, T.StringType()),
        T.StructField(UPDATED, T.TimestampNTZType()),
        T.StructField("source_file", T.StringType()),
    ]
)

#: What an import file delivers: the fact columns before the load adds its own stamp.
BATCH_COLUMNS = [f.name for f in STAY_SCHEMA.fields if f.name != UPDATED]
DATE_COLUMNS = ["birth_date", START, END]

#: Attributes replaced when an upsert finds its key.
ATTRIBUTES = ["name", "birth_date", "category", END, "place", "source_file"]
