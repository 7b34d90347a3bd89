"""Line-delimited JSON log → typed chat rows, vote rows, artifacts and quarantine.

A line is parsed once into a VARIANT; unknown fields are dropped, absent ones are
null. The JSON dialect is Spark's: a line must be an object, end in ``}`` and use
double quotes; a bare ``NaN`` is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur import schemas
from murmur.functions import loose


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with the file they came from and a row id of their own.

    Equal lines of one file have different ids. An id is the line's place in the plan of file
    splits, so it is the same again as long as files and split settings are.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), "value",
        F.monotonically_increasing_id().alias("row_id"))


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``raw`` (stripped), ``doc`` (variant, null when malformed); blank lines go."""
    # Exploding one-element arrays keeps the optimiser from copying the parse into every
    # filter and field above it: each line is stripped and parsed exactly once.
    kept = F.filter(F.array(loose.strip(F.col(value))), lambda s: s != "")
    stripped = lines.select(*lines.columns, F.explode(kept).alias("raw"))
    looks_whole = F.col("raw").startswith("{") & F.col("raw").endswith("}")
    doc = F.array(F.when(looks_whole, F.try_parse_json("raw")))
    return stripped.select(*stripped.columns, F.explode(doc).alias("doc"))


def bad_lines(parsed: DataFrame, keep: int = 300) -> DataFrame:
    """Quarantine rows: carried columns, reason and the start of the line."""
    reason = (F.when(~F.col("raw").startswith("{"), "not_an_object")
              .when(~F.col("raw").endswith("}"), "unterminated_object")
              .otherwise("invalid_json"))
    carried = [c for c in parsed.columns if c not in ("raw", "doc", "value")]
    return (parsed.where(F.col("doc").isNull())
            .select(*carried, reason.alias("reason"),
                    F.substring("raw", 1, keep).alias("raw")))


def _field(name: str, kind: str) -> Column:
    doc = F.col("doc")
    if kind == "bool":
        return loose.loose_bool_variant(doc, name)
    text = F.try_variant_get(doc, f"$.{name}", "string")
    if kind == "number":
        return loose.loose_double(text)
    if kind == "ts":
        return loose.loose_ts(text)
    if kind == "text":
        return loose.loose_text(text)
    return text


def _typed(rows: DataFrame, fields: dict[str, str], carry: list[str]) -> DataFrame:
    return rows.select(*carry, *[_field(n, k).alias(n) for n, k in fields.items()])


def is_vote() -> Column:
    return F.try_variant_get(F.col("doc"), "$.event", "string").eqNullSafe("vote")


def chat_rows(parsed: DataFrame, carry: tuple[str, ...] = (),
              null_profile: str = "strict") -> DataFrame:
    """Chat turns with the analysed fields, normalised."""
    good = parsed.where(F.col("doc").isNotNull() & ~is_vote())
    typed = _typed(good, schemas.CHAT_FIELDS, list(carry))
    return fill_defaults(typed) if null_profile == "default_fill" else typed


def vote_rows(parsed: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    good = parsed.where(F.col("doc").isNotNull() & is_vote())
    return _typed(good, schemas.VOTE_FIELDS, list(carry))


def fill_defaults(chats: DataFrame) -> DataFrame:
    """Default-fill profile: missing metrics become 0, missing labels 'unknown'."""
    return chats.withColumns({
        name: F.coalesce(F.col(name), F.lit(value).cast(chats.schema[name].dataType))
        for name, value in schemas.CHAT_DEFAULTS.items() if name in chats.columns})


def split_rows(rows: DataFrame, event: str = "event") -> tuple[DataFrame, DataFrame]:
    """(chats, votes) of a table already typed."""
    vote = F.col(event).eqNullSafe("vote")
    return rows.where(~vote), rows.where(vote)


def project_chat(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the analysed columns; absent ones null, extras dropped."""
    types = {"bool": "boolean", "number": "double", "ts": "timestamp"}
    return rows.select(*carry, *[
        F.col(n) if n in rows.columns else F.lit(None).cast(types.get(k, "string")).alias(n)
        for n, k in schemas.CHAT_FIELDS.items()])


def artifact_reason(ts: Column, message: Column) -> Column:
    """Why a non-vote row is no analysable turn; null when it is one."""
    return F.when(ts.isNull() | message.isNull() | (loose.strip(message) == ""),
                  "missing_ts_or_empty_message")


def artifacts(parsed: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Malformed lines and empty turns with a reason code."""
    doc = F.col("doc")
    get = lambda f: F.try_variant_get(doc, f"$.{f}", "string")
    reason = F.when(doc.isNull(), "json_decode_error").when(
        ~is_vote(), artifact_reason(F.nullif(get("ts"), F.lit("")), get("message")))
    return (parsed.withColumn("reason", reason).where(F.col("reason").isNotNull())
            .select(*carry, get("ts").alias("ts"), get("session_id").alias("session_id"),
                    loose.loose_double(get("turn_index")).alias("turn_index"),
                    F.coalesce(loose.loose_bool_variant(doc, "is_owner_traffic"), F.lit(False))
                    .alias("is_owner_traffic"), "reason"))


def load_meta(parsed: DataFrame) -> DataFrame:
    """Row counts of one load in a single pass."""
    ok = F.col("doc").isNotNull()
    return parsed.agg(
        F.count_if(~ok).alias("malformed_rows"),
        F.count_if(ok).alias("total_rows"),
        F.count_if(ok & ~is_vote()).alias("chat_rows"),
        F.count_if(ok & is_vote()).alias("vote_rows"))


def log_view(rows: DataFrame) -> DataFrame:
    """Narrow view of a raw log; absent columns are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
                         for c in schemas.LOG_VIEW_COLUMNS])


def load_query_log(spark: SparkSession, path: str, start_date: str | None = None,
                   end_date: str | None = None, owner_filter: str = "none",
                   null_profile: str = "strict") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chats, votes, load counts) of a log path, filtered."""
    from murmur.operators import filters

    parsed = parse_lines(read_lines(spark, path))
    carry = ("row_id", "file_path")
    chats = filters.date_range(chat_rows(parsed, carry, null_profile), start_date, end_date)
    votes = filters.date_range(vote_rows(parsed, carry), start_date, end_date)
    chats, votes = filters.exclude_owner(chats, votes, owner_filter)
    return chats, votes, load_meta(parsed)


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Missing values per field: one pass, one row per field."""
    total = rows.agg(F.count(F.lit(1)).alias("n"),
                     *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing"))
                        for f in fields])
    return (total.select("n", F.explode(entries).alias("e"))
            .select("e.field", "e.missing", F.col("n").alias("total"),
                    (100.0 * F.col("e.missing") / F.when(F.col("n") > 0, F.col("n")))
                    .alias("missing_pct")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
