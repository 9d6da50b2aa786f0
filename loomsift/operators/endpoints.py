"""Endpoints in text blobs and their health from a request log ``(key, ts, id, ok, seconds)``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import vocab
from loomsift.functions.dialect import BLANK, rx, strip
from loomsift.functions.session import cut
from loomsift.operators.ranking import first_rows, with_previous


_NONE = "array<string>"


def _in_text(text: Column) -> Column:
    """``ip:port`` of all addresses in a text."""
    pattern = rx(vocab.ENDPOINT)
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, pattern, "$1:$2"))


def _in_object(text: Column) -> Column:
    """``ip:port`` of the items of a whole JSON object ``{"data": [{ip, port}]}``."""
    whole_object = text.rlike(rf"(?s)\A{BLANK}*\{{.*\}}{BLANK}*\z")
    items = F.from_json(F.when(whole_object, text), "data array<struct<ip:string,port:string>>")["data"]
    listed = F.transform(F.filter(items, lambda x: x["ip"].isNotNull() & x["port"].isNotNull()), lambda x: F.concat_ws(":", x["ip"], x["port"]))
    return F.coalesce(listed, F.array().cast(_NONE))


def _distinct(found: DataFrame) -> DataFrame:
    return found.select(strip(F.col("endpoint")).alias("endpoint")).filter(F.col("endpoint").contains(":")).distinct()


def extract_endpoints(blobs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct ``ip:port`` strings, from plain text and from JSON ``{"data": [{ip, port}]}``."""
    found = F.concat(_in_text(F.col(text)), _in_object(F.col(text)))
    return _distinct(blobs.select(F.explode_outer(found).alias("endpoint")))


def file_forms(lines: DataFrame) -> DataFrame:
    """``(file, form)`` of numbered lines ``(file, line_no, value)``: ``object``, ``list`` or ``text``.

    An object begins with ``{`` and ends with ``}``; in a list every line that is not blank is one string with a ``:``. Both follow from
    counts and from the first and last line, so no file is put together.
    """
    value = strip(F.col("value"))
    shown = lines.select("file", "line_no", value.alias("value")).filter("value <> ''")
    told = shown.groupBy("file").agg(
        F.min_by(F.left("value", F.lit(1)), "line_no").alias("_first"),
        F.max_by(F.right("value", F.lit(1)), "line_no").alias("_last"),
        F.count_if(~F.col("value").contains(":") | F.col("value").rlike(BLANK)).alias("_other"),
    )
    whole = (F.col("_first") == "{") & (F.col("_last") == "}")
    return told.select("file", F.when(whole, "object").when(F.col("_other") == 0, "list").otherwise("text").alias("form"))


_MEMBER = r"""[{}]|"(?:ip|port)"\s*:\s*(?:"[^"]*"|\d+)"""


def _of_objects(lines: DataFrame) -> DataFrame:
    """Endpoints of objects over several lines: an ``ip`` and a ``port`` beside each other, with no brace between them."""
    members = F.posexplode(F.regexp_extract_all("value", F.lit(_MEMBER), F.lit(0))).alias("k", "member")
    each = lines.select("file", "line_no", members)
    paired = with_previous(each, ["file", "line_no", "k"], ["file", "member"], "before")
    here, before = F.col("member"), F.col("before.member")
    value = lambda m: F.rtrim(F.ltrim(F.regexp_extract(m, r":\s*(.*)$", 1), F.lit('"')), F.lit('"'))
    is_ip = lambda m: m.startswith('"ip"')
    is_port = lambda m: m.startswith('"port"')
    endpoint = F.when(is_ip(before) & is_port(here), F.concat_ws(":", value(before), value(here))).when(
        is_port(before) & is_ip(here), F.concat_ws(":", value(here), value(before))
    )
    return paired.filter(F.col("before.file") == F.col("file")).select(endpoint.alias("endpoint")).filter("endpoint IS NOT NULL")


def endpoints_of_files(lines: DataFrame) -> DataFrame:
    """Distinct endpoints of files of numbered lines ``(file, line_no, value)``, each read by its form.

    Every line of a list is an endpoint as it is; an object gives the ``ip`` and ``port`` of its items, wherever its lines break; text gives the
    addresses in its lines. Objects give the addresses in their lines too, as a text would.
    """
    formed = lines.join(file_forms(lines), "file")
    listed = formed.filter("form = 'list'").select(F.col("value").alias("endpoint"))
    plain = formed.filter("form <> 'list'").select(F.explode(_in_text(F.col("value"))).alias("endpoint"))
    return _distinct(listed.unionAll(plain).unionAll(_of_objects(formed.filter("form = 'object'"))))


def event_counts() -> list[Column]:
    """Aggregates from which the state of a key follows."""
    return [
        F.count_if("ok").alias("success"),
        F.count_if(~F.col("ok")).alias("fail"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("seconds"))), F.lit(0.0)).alias("total_time"),
        F.max(F.struct("ts", "id", "ok")).alias("last"),
    ]


def merge_counts(partials: DataFrame) -> DataFrame:
    """Add up partial counts of the same key."""
    return partials.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("success", "fail", "total_time")], F.max("last").alias("last")
    )


def state_from_counts(counted: DataFrame) -> DataFrame:
    total = F.col("success") + F.col("fail")
    rate = F.col("fail") / total
    until = F.when(F.col("last.ok") | (total < vocab.MIN_TRIES), None)
    for above, minutes in vocab.QUARANTINE_RULES:
        until = until.when(rate > above, F.col("last.ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return counted.select(
        "key",
        "success",
        "fail",
        "total_time",
        (F.col("success") / total * 100).alias("success_rate"),
        F.col("last.ts").alias("last_ts"),
        until.alias("quarantine_until"),
    )


def endpoint_state(log: DataFrame) -> DataFrame:
    """One row per key: counts, time of successes and the quarantine left by the last event.

    A success clears a quarantine and failures in a row only raise the failure rate, so the counts
    and the last event decide; no ordered pass over the events of a key is needed and hot keys are
    pre-aggregated before the shuffle.
    """
    return state_from_counts(log.groupBy("key").agg(*event_counts()))


def endpoint_health(log: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Counts and success rate per key; keys without history score 50."""
    health = endpoint_state(log).select("key", "success", "fail", "total_time", F.col("success_rate").alias("score"))
    if keys is None:
        return health
    return keys.select("key").distinct().join(health, "key", "left").select(
        "key",
        F.coalesce("success", F.lit(0)).alias("success"),
        F.coalesce("fail", F.lit(0)).alias("fail"),
        F.coalesce("total_time", F.lit(0.0)).alias("total_time"),
        F.coalesce("score", F.lit(vocab.SCORE_UNKNOWN)).alias("score"),
    )


def quarantine(log: DataFrame, as_of: Column) -> DataFrame:
    """Quarantine end and score at an instant; quarantined keys score -1000."""
    held = F.col("quarantine_until").isNotNull() & (as_of < F.col("quarantine_until"))
    return endpoint_state(log).select(
        "key",
        "quarantine_until",
        F.coalesce(held, F.lit(False)).alias("quarantined"),
        F.when(held, vocab.SCORE_QUARANTINED).otherwise(F.col("success_rate")).alias("score"),
    )


def pool_stats(log: DataFrame, as_of: Column) -> DataFrame:
    """One row: total, active and quarantined keys."""
    held = F.count_if("quarantined")
    return quarantine(log, as_of).agg(
        F.count("*").alias("total"), (F.count("*") - held).alias("active"), held.alias("quarantined")
    )


def top_fifth(scored: DataFrame, score: str = "score", key: str = "key") -> DataFrame:
    """Best 20 % of the rows by score, one at least; equal scores in key order. The last of them is selected, nothing is sorted.

    Rows marked in a column ``quarantined``, as :func:`quarantine` has it, are no candidates and do not count.
    """
    if "quarantined" in scored.columns:
        scored = scored.filter(~F.col("quarantined"))
    # lowest first: rows without a score last, then the largest score
    stored = cut(scored.withColumns({"_none": F.col(score).isNull(), "_less": -F.col(score)}))
    best = first_rows(stored, max(1, stored.count() // 5), "_none", "_less", key)
    return best.drop("_none", "_less")


def _seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def speed(log: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: rows, seconds and rows per second of a log."""
    seconds = _seconds_between(F.min(ts), F.max(ts))
    return log.agg(
        F.count("*").alias("processed"),
        seconds.alias("seconds"),
        F.when(seconds > 0, F.count("*") / seconds).alias("per_second"),
    )


def request_gap_audit(log: DataFrame, delay: float) -> DataFrame:
    """Seconds since the previous request of the same key and the wait a minimum delay asks for.

    Rows are dealt by ranges of (key, ts, id) and only the last row of each stretch is handed to the next one, so that a key, or an hour of
    a key, may hold any share of the log.
    """
    rows = with_previous(log.select("key", "id", "ts"), ["key", "ts", "id"], ["key", "ts"], "_before")
    gap = F.when(F.col("_before.key").eqNullSafe(F.col("key")), _seconds_between(F.col("_before.ts"), F.col("ts")))
    return rows.select("key", "id", "ts", gap.alias("gap")).withColumn(
        "wait", F.greatest(F.lit(0.0), F.lit(float(delay)) - F.coalesce("gap", F.lit(float(delay))))
    )
