"""Report writers. Each writes from the tasks; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sessions(sessions: DataFrame, path: str, day: str = "start_local_date") -> None:
    """Session rows as parquet, one folder per local day."""
    sessions.write.mode("overwrite").partitionBy(day).parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_daily_counts(daily: DataFrame, path: str) -> None:
    write_csv(daily, path)


def summary_row(**sections: DataFrame) -> DataFrame:
    """Single-row frames nested as named structs of one summary row."""
    out = None
    for name, frame in sections.items():
        part = frame.select(F.struct(*frame.columns).alias(name)).withColumn("__one", F.lit(1))
        out = part if out is None else out.join(part, "__one")
    return out.drop("__one")


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_text_list(rows: DataFrame, path: str, column: str) -> None:
    rows.select(column).write.mode("overwrite").text(path)
