"""Operational rules over an event table: error share, latency, silence and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# --- fixed values: rule thresholds -----------------------------------------------
ERROR_SHARE = 0.05
LATENCY_SECONDS = 2.0
SILENCE_SECONDS = 60
RULE_WINDOW = "5 minutes"


def error_rate(events: DataFrame, width: str = RULE_WINDOW) -> DataFrame:
    """Share of errors per window, with ``is_alert`` above five percent."""
    share = F.count_if(F.col("event_type") == "error") / F.count("*")
    return (events.groupBy(F.window("ts", width).alias("w"))
            .agg(F.count("*").alias("n_events"), share.alias("error_share"))
            .select(F.col("w.start").alias("window_start"), "n_events", "error_share",
                    (F.col("error_share") > ERROR_SHARE).alias("is_alert")))


def p95_latency(events: DataFrame, width: str = RULE_WINDOW, accuracy: int | None = None) -> DataFrame:
    """95th percentile of ``value`` per window; approximate when an accuracy is given, for very full windows."""
    p95 = F.percentile_approx("value", 0.95, accuracy) if accuracy else F.percentile("value", 0.95)
    return (events.groupBy(F.window("ts", width).alias("w")).agg(p95.alias("p95"))
            .select(F.col("w.start").alias("window_start"), "p95", (F.col("p95") > LATENCY_SECONDS).alias("is_alert")))


SKETCH_K = 800
RANK_ERROR = 0.01  # of a quantile from sketches of this size, however many of them are merged


def minute_sketches(events: DataFrame) -> DataFrame:
    """``m`` (the minute), ``n``, ``errors`` and a mergeable sketch of ``value``: a few kilobytes, whatever the number of events."""
    return events.groupBy(F.window("ts", "1 minute").alias("m")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.kll_sketch_agg_double(F.col("value").cast("double"), SKETCH_K).alias("sketch"))


def from_minutes(minutes: DataFrame, width: str = RULE_WINDOW, slide: str | None = None) -> DataFrame:
    """``window_start, n, errors, p95`` of wider windows, sliding ones too, from the minutes alone.

    Windows must begin and end with minutes. ``p95`` has a rank between 0.95 less and plus ``RANK_ERROR``; a window
    without values has none.
    """
    merged = minutes.groupBy(F.window("m", width, slide or width).alias("w")).agg(
        F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    some = F.kll_sketch_get_n_double("sketch") > 0
    return merged.select(F.col("w.start").alias("window_start"), "n", "errors",
                         F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(0.95))).alias("p95"))


def silence_gaps(events: DataFrame, seconds: int = SILENCE_SECONDS) -> DataFrame:
    """Times without any event for longer than ``seconds``.

    Ordering all events in one window would put them in one task. Events are first reduced to one row per
    minute-wide bucket (first and last time), and buckets are linked within days; only the first and last
    bucket of each day, two rows per day, are linked across days.
    """
    at = F.unix_micros("ts")
    minutes = events.groupBy(F.floor(at / (seconds * 1_000_000)).alias("bucket")).agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"))
    return _gaps(minutes, seconds)


def _gaps(buckets: DataFrame, seconds: int) -> DataFrame:
    limit = seconds * 1_000_000
    days = buckets.withColumn("day", F.floor(F.col("lo") / 86_400_000_000))
    within = days.withColumn("next", F.lead("lo").over(Window.partitionBy("day").orderBy("lo")))
    inner = within.select(F.col("hi").alias("gap_start"), F.col("next").alias("gap_end"))
    edges = days.groupBy("day").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    across = edges.select(F.col("hi").alias("gap_start"),
                          F.lead("lo").over(Window.orderBy("day")).alias("gap_end"))
    gaps = inner.unionByName(across).filter(F.col("gap_end") - F.col("gap_start") > limit)
    return gaps.select("gap_start", "gap_end", ((F.col("gap_end") - F.col("gap_start")) / 1_000_000.0).alias("seconds"))


def throughput_summary(events: DataFrame) -> DataFrame:
    """Requests, successes, rate over the covered time and mean latency."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000.0
    ok = F.count_if(F.col("event_type") != "error")
    return events.agg(F.count("*").alias("total"), ok.alias("success"),
                      F.round(ok / F.count("*"), 6).alias("success_share"),
                      F.round(F.count("*") / F.nullif(span, F.lit(0.0)), 6).alias("per_second"),
                      F.round(F.avg("value"), 6).alias("mean_latency"))
