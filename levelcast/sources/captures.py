"""Captured messages as JSON lines: reader, writer, bounds and replay schedule."""

from pyspark.sql import Window, functions as F

from levelcast.functions.timecols import MICROS, iso_offset, seconds_between
from levelcast.operators import classify, series
from levelcast.operators.stages import compute_once
from levelcast.session import spread

_FIELDS = ("topic", "captured_at", "payload", "payload_b64")
# A line is the first of exactly two elements of an array; see operators/classify.py.
_RECORD = "array<struct<" + ",".join(f"{f}:variant" for f in _FIELDS) + ",seal:string>>"
_OPTIONS = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
_BASE64 = r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"
# The reasons a line can be refused for.
BAD_JSON = "invalid json"
NOT_OBJECT = "record is not an object"
BAD_TOPIC = "missing or invalid topic"
NO_TIME = "missing or invalid captured_at"
BAD_TIME = "invalid captured_at"
NO_ZONE = "captured_at must be timezone-aware"
ONE_PAYLOAD = "exactly one of payload/payload_b64 required"
NOT_TEXT = "payload must be a string"
NOT_TEXT_B64 = "payload_b64 must be a string"
BAD_B64 = "invalid payload_b64"


def numbered_lines(spark, path):
    """Lines of text files with their file and 1-based line number.

    Files are read in splits. A line is numbered inside its split, whose size is
    bounded by spark.sql.files.maxPartitionBytes, and split totals are added up
    per file; no file passes through one task.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_read_order"),
    )
    counted = lines.withColumn("_one", F.lit(1))
    return series.running_total(
        counted, ["file"], "block", ["_read_order"], "_one", "line_no"
    ).select("file", "block", "line_no", "value")


def decode_records(lines):
    """Add topic, captured_at, payload and `error` (NULL for a good line) to `value` lines."""
    value = F.col("value")
    seal = F.xxhash64("value").cast("string")
    sealed = F.concat(F.lit("["), value, F.lit(',{"seal":"'), seal, F.lit('"}]'))
    readable = F.when(F.is_valid_utf8(value), sealed)
    parsed = compute_once(lines, _doc=F.from_json(readable, _RECORD, _OPTIONS))
    r = F.get("_doc", 0)
    whole = r.isNotNull() & (F.size("_doc") == 2) & (F.get("_doc", 1)["seal"] == seal)
    # Each field is read once; as text it would be read again wherever it is referred to.
    leaves = compute_once(
        parsed,
        lines.columns,
        _whole=F.coalesce(whole, F.lit(False)),
        **{f"_kind_{f}": F.schema_of_variant(r[f]) for f in _FIELDS},
        **{f"_{f}": F.try_variant_get(r[f], "$", "string") for f in _FIELDS},
    )
    timed = compute_once(leaves, _iso=F.translate("_captured_at", " ", "T"))
    timed = classify.with_utc(timed, _at="_iso")
    topic, at, text, encoded = (F.col(f"_{f}") for f in _FIELDS)
    kind = lambda f: F.col(f"_kind_{f}")
    is_text = lambda f: F.coalesce(kind(f) == "STRING", F.lit(False))
    # A JSON null counts as an absent payload field.
    has_text, has_encoded = (F.coalesce(kind(f) != "VOID", F.lit(False)) for f in _FIELDS[2:])
    zoneless = at.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
    error = (
        F.when(
            ~F.col("_whole"),
            F.when(
                ~F.ltrim(value).startswith("{") & F.try_parse_json(value).isNotNull(), NOT_OBJECT
            ).otherwise(BAD_JSON),
        )
        .when(~(is_text("topic") & (topic != "")), BAD_TOPIC)
        .when(~is_text("captured_at"), NO_TIME)
        .when(F.col("_at").isNull(), F.when(zoneless, NO_ZONE).otherwise(BAD_TIME))
        .when(has_text == has_encoded, ONE_PAYLOAD)
        .when(has_text & ~is_text("payload"), NOT_TEXT)
        .when(has_encoded & ~is_text("payload_b64"), NOT_TEXT_B64)
        .when(has_encoded & ~encoded.rlike(_BASE64), BAD_B64)
    )
    payload = F.when(has_text, F.encode(text, "UTF-8")).otherwise(
        F.try_to_binary(encoded, F.lit("base64"))
    )
    judged = compute_once(timed, error=error)
    good = F.col("error").isNull()
    return judged.select(
        *lines.columns,
        F.when(good, topic).alias("topic"),
        F.when(good, F.col("_at")).alias("captured_at"),
        F.when(good, payload).alias("payload"),
        "error",
    )


def read_capture(spark, path, mode="failfast"):
    """Captured messages (file, block, line_no, topic, captured_at, payload).

    Blank lines are skipped. 'failfast' fails the job on the first bad line,
    naming its number; 'quarantine' keeps bad lines, with `value` and `error`.
    """
    if mode not in ("failfast", "quarantine"):
        raise ValueError("mode must be 'failfast' or 'quarantine'")
    lines = numbered_lines(spark, path).filter(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    # Numbering leaves a task per split of a file; decoding is the costly step.
    records = decode_records(spread(lines))
    if mode == "quarantine":
        return records
    message = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), "error")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(message).cast("string"))
    return records.select(
        "file",
        "block",
        "line_no",
        F.coalesce(checked, F.col("topic")).alias("topic"),
        "captured_at",
        "payload",
    )


def capture_lines(messages):
    """One compact JSON line per message, keys in fixed order, as column `value`.

    Payload bytes that are valid UTF-8 stay readable text, others go to base64.
    """
    text = F.col("payload").cast("string")
    readable = F.is_valid_utf8(text)
    record = F.to_json(
        F.struct(
            F.col("topic").alias("topic"),
            iso_offset("captured_at").alias("captured_at"),
            F.when(readable, text).alias("payload"),
            # base64() breaks its text into lines; a record has none.
            F.when(~readable, F.translate(F.base64("payload"), "\r\n", "")).alias("payload_b64"),
        ),
        {"ignoreNullFields": "true"},
    )
    return messages.select(record.alias("value"))


def write_capture(messages, path, order=("captured_at",)):
    """Write capture lines in capture order (range-partitioned sort, many files)."""
    ordered = messages.orderBy(*order)
    capture_lines(ordered).write.mode("overwrite").text(path)


def capture_bounds(messages, order, at, count=None, duration_seconds=None, slice_seconds=(3600, 1)):
    """The first `count` messages or `duration_seconds`, whichever ends first.

    `order` begins with `at`. Messages are counted per hour, then per second of the
    hour that holds the last one wanted; only that second's messages are ranked.
    """
    if count is None and duration_seconds is None:
        raise ValueError("give count or duration_seconds")
    if count is not None and count <= 0:
        raise ValueError("count must be positive")
    if duration_seconds is not None and duration_seconds <= 0:
        raise ValueError("duration_seconds must be positive")
    kept = messages
    if duration_seconds is not None:
        first = messages.agg(F.min(at)).scalar()
        kept = kept.filter(seconds_between(at, first) <= F.lit(float(duration_seconds)))
    if count is None:
        return kept
    if order[0] != at:
        raise ValueError("order must begin with the time of arrival")
    return series.first_rows(kept, [], at, count, order[1:], slice_seconds=slice_seconds)


def replay_offsets(captured, speed, order="line_no", block="block"):
    """Add `offset_seconds`: when each message is due after the replay starts.

    Captured gaps are compressed by `speed` (None: all due at once), negative
    gaps count as zero. Added up in microseconds, block by block per file.
    """
    if speed is None:
        return captured.withColumn("offset_seconds", F.lit(0.0))
    if speed <= 0:
        raise ValueError("speed must be positive")
    keys = ["file"]
    ends = captured.groupBy(*keys, block).agg(
        F.max_by("captured_at", order).alias("_end")
    )
    carry = ends.select(
        *keys, block, F.lag("_end").over(Window.partitionBy(*keys).orderBy(block)).alias("_carry")
    )
    inside = Window.partitionBy(*keys, block).orderBy(order)
    local = captured.withColumn("_before", F.lag("captured_at").over(inside))
    gap = F.unix_micros("captured_at") - F.unix_micros(F.coalesce("_before", "_carry"))
    gapped = local.join(carry, [*keys, block]).select(
        *captured.columns, F.greatest(gap, F.lit(0)).alias("_gap")
    )
    due = series.running_total(gapped, keys, block, [order], "_gap", "_due")
    return due.select(
        *captured.columns,
        (F.col("_due") / F.lit(float(MICROS)) / F.lit(float(speed))).alias("offset_seconds"),
    )


def replay_messages(captured):
    """Captured records as arrivals of the ingest path, payload bytes unchanged.

    Records of one time are ordered by file and line: line numbers restart in each file.
    """
    return captured.select(
        "topic",
        "payload",
        F.col("captured_at").alias("received_at"),
        F.struct("file", "line_no").alias("arrival_seq"),
    )
