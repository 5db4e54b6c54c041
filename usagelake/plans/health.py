"""Reliability, environment, cache efficiency, governance and engagement.

The free text of errors is never read here; errors are classified by status code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.maps import count_if, day_text, dim, number, rate, total_of, zero
from usagelake.operators.quantile import exact_quantiles
from usagelake.operators.relational import beside, descending
from usagelake.plans import blocks as b
from usagelake.plans.tools import friction


def reliability_totals(e) -> DataFrame:
    kind = F.col("event_type")
    counted = {
        "api_requests": "api_request",
        "api_errors": "api_error",
        "refusals": "api_refusal",
        "retries_exhausted": "api_retries_exhausted",
        "internal_errors": "internal_error",
    }
    rows = e.where(kind.isin(*counted.values()))
    return rows.agg(*[count_if(kind == value).alias(name) for name, value in counted.items()])


def errors_by_day(e) -> DataFrame:
    """Every day with any event appears, also without requests or errors."""
    kind = F.col("event_type")
    grouped = e.groupBy("event_date").agg(
        count_if(kind == "api_request").alias("requests"), count_if(kind == "api_error").alias("errors")
    )
    return grouped.orderBy("event_date").select(day_text(F.col("event_date")).alias("day"), "requests", "errors")


def errors_by_status(e) -> DataFrame:
    rows = b.event(e, "api_error")
    code = number(rows, "status_code")
    status = F.when(code.isNotNull(), code.cast("int").cast("string")).otherwise(fx.NONE_LABEL)
    grouped = rows.groupBy(status.alias("status")).agg(F.count("*").alias("count"))
    return descending(grouped, "count", "status")


def errors_by_model(e):
    return b.count_by(b.event(e, "api_error"), F.col("model"), "model", "errors", fx.UNKNOWN_LABEL)


def refusals_by_model(e):
    return b.count_by(b.event(e, "api_refusal"), F.col("model"), "model", "count", fx.UNKNOWN_LABEL)


def error_top_users(e):
    return b.users_by(b.event(e, "api_error"), "errors", 10)


def reliability(e) -> dict[str, DataFrame]:
    return {
        "totals": reliability_totals(e),
        "errors_by_day": errors_by_day(e),
        "errors_by_status": errors_by_status(e),
        "errors_by_model": errors_by_model(e),
        "refusals_by_model": refusals_by_model(e),
        "top_users": error_top_users(e),
    }


def _reach(m, column: str, name: str) -> DataFrame:
    """Distinct users and sessions per non-empty value."""
    rows = m.where(F.col(column) != "")
    grouped = b.distinct_counts(rows, [F.col(column).alias(name)], {"users": "user_hash", "sessions": "session_id"})
    return descending(grouped, "users", name)


def env_versions(m):
    return _reach(m, "app_version", "version")


def env_entrypoints(m):
    return _reach(m, "entrypoint", "entrypoint")


def environment(m) -> dict[str, DataFrame]:
    return {"versions": env_versions(m), "entrypoints": env_entrypoints(m)}


def efficiency(e) -> DataFrame:
    """Cache use of API requests: hit ratio over prompt tokens and the estimated saving."""
    rows = b.event(e, "api_request")
    summed = {
        "cache_read": "cache_read_tokens",
        "cache_creation": "cache_creation_tokens",
        "input": "input_tokens",
        "output": "output_tokens",
        "total_cost": "cost_usd",
    }
    sums = rows.agg(*[total_of(number(rows, key)).alias(name) for name, key in summed.items()])
    read = F.col("cache_read")
    prompt = read + F.col("cache_creation") + F.col("input")
    return sums.withColumns(
        {
            "cache_hit_ratio": zero(rate(read, prompt)),
            "estimated_savings_tokens": read * fx.CACHE_SAVING_PER_TOKEN,
        }
    )


def decision_sources(e):
    rows = b.event(e, "tool_result")
    return b.count_by(rows, dim(e, "decision_source"), "source", "count", fx.UNKNOWN_LABEL)


def governance(e) -> dict[str, DataFrame]:
    return {"by_decision_source": decision_sources(e), "friction": friction(e)}


def _with_quantiles(rows: DataFrame, value: str, aggregates, quantiles: dict[str, float]) -> DataFrame:
    """Global aggregates next to exact quantiles of one column; empty input gives zeros."""
    both = beside(rows.agg(*aggregates), exact_quantiles(rows, [], value, quantiles))
    return both.withColumns({name: zero(F.col(name)) for name in quantiles})


def session_spans(e) -> DataFrame:
    """Seconds between the first and last event of each named session, counted in second boundaries."""
    return (
        e.where("session_id != ''")
        .groupBy("session_id")
        .agg((F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp"))).alias("seconds"))
    )


def session_duration(e) -> DataFrame:
    return _with_quantiles(
        session_spans(e),
        "seconds",
        [zero(F.avg("seconds")).alias("avg_seconds"), F.count("*").alias("sessions")],
        {"p50_seconds": 0.5, "p95_seconds": 0.95},
    )


def _lengths(e, kind: str, key: str) -> DataFrame:
    rows = b.event(e, kind)
    return rows.select(number(rows, key).alias("length")).where("length IS NOT NULL")


def response_length(e) -> DataFrame:
    rows = _lengths(e, "assistant_response", "response_length")
    return _with_quantiles(rows, "length", [zero(F.avg("length")).alias("avg")], {"p50": 0.5, "p95": 0.95})


def prompt_length(e) -> DataFrame:
    return _lengths(e, "user_prompt", "prompt_length").agg(zero(F.avg("length")).alias("avg"))


def engagement(e) -> dict[str, DataFrame]:
    return {
        "session_duration": session_duration(e),
        "response_length": response_length(e),
        "prompt_length": prompt_length(e),
    }
