"""Registered queries: every operator run over the generated tables.

Results are reduced to BIGINT, DOUBLE (6 digits), STRING and BOOLEAN columns so
that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, FloatType, IntegralType, TimestampType

from checks import oracle, oracle_ingest
from checks.ingest_queries import PIPELINE
from usagelake.lake import Lake
from usagelake.operators.dimensions import membership_list
from usagelake.operators.relational import scope
from usagelake.plans import capabilities as cap
from usagelake.plans import derived, health, overview, people, teams, tools

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _m(lake: Lake) -> DataFrame:
    return scope(lake.metrics(), oracle.ORG, oracle.FIRST, oracle.LAST)


def _e(lake: Lake) -> DataFrame:
    return scope(lake.events(), oracle.ORG, oracle.FIRST, oracle.LAST)


def _prior(lake: Lake) -> DataFrame:
    first, last = derived.prior_range(oracle.FIRST, oracle.LAST)
    return scope(lake.metrics(), oracle.ORG, first, last)


def _team(lake: Lake) -> DataFrame:
    return membership_list(lake.current_membership(), oracle.ORG, latest=True)


def _prior_range(lake: Lake) -> DataFrame:
    first, last = derived.prior_range(oracle.FIRST, oracle.LAST)
    totals = _prior(lake).agg(F.count("*").alias("points"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    return totals.select(F.lit(first).alias("first_day"), F.lit(last).alias("last_day"), "points", "total")


def _of_metrics(*blocks) -> dict:
    return {b.__name__: (lambda lake, b=b: b(_m(lake))) for b in blocks}


def _of_events(*blocks) -> dict:
    return {b.__name__: (lambda lake, b=b: b(_e(lake))) for b in blocks}


def _of_both(*blocks) -> dict:
    return {b.__name__: (lambda lake, b=b: b(_m(lake), _e(lake))) for b in blocks}


def _with_entity(entity: str, frame, *blocks) -> dict:
    return {b.__name__: (lambda lake, b=b: b(frame(lake), entity)) for b in blocks}


def _with_team(frame, *blocks) -> dict:
    return {b.__name__: (lambda lake, b=b: b(frame(lake), _team(lake), oracle.TEAM)) for b in blocks}


ANALYTICS: dict[str, Callable[[Lake], DataFrame]] = {
    "orgs": lambda lake: overview.orgs(lake.bronze_metrics(), lake.bronze_events()),
    **_of_metrics(*overview.METRIC_BLOCKS.values(), overview.metric_breakdowns),
    **_of_events(*overview.EVENT_BLOCKS.values(), overview.event_breakdowns),
    **_of_both(overview.subagents, people.people),
    **_with_entity(
        oracle.USER, _m, people.person_cost_by_day, people.person_tokens, people.person_models,
        people.person_sessions, people.person_lines,
    ),
    **_with_entity(oracle.USER, _e, people.person_tools, people.person_activity_by_hour),
    **_with_entity(
        oracle.MODEL, _m, people.model_cost_by_day, people.model_tokens, people.model_top_users,
        people.model_cost_by_source, people.model_cost_by_effort,
    ),
    **_of_metrics(people.cost_timeseries),
    **_of_events(tools.tools_list, tools.agents_list),
    **_with_entity(
        oracle.TOOL, _e, tools.tool_uses_by_day, tools.tool_latency, tools.tool_decisions, tools.tool_top_users
    ),
    **_of_both(tools.agents_by_name),
    **_with_entity(oracle.AGENT, _e, tools.agent_uses_by_day, tools.agent_top_users),
    "teams": lambda lake: teams.teams(_m(lake), _e(lake), _team(lake)),
    **_with_team(_m, teams.team_cost_by_day, teams.team_members, teams.team_models),
    **_with_team(_e, teams.team_tools),
    **_of_events(
        cap.plugins, cap.hooks_by_event, cap.hooks_by_source, cap.mcp_totals, cap.mcp_by_transport,
        cap.mcp_connected_servers, cap.mcp_tool_calls, cap.cap_skills, cap.autonomy_total, cap.autonomy_by_mode,
        cap.autonomy_transitions, cap.autonomy_by_trigger,
    ),
    **_of_metrics(cap.cap_session_starts),
    **_with_entity(
        oracle.PLUGIN, _e, cap.plugin_info, cap.plugin_versions, cap.plugin_users, cap.plugin_by_day
    ),
    **_of_events(
        health.reliability_totals, health.errors_by_day, health.errors_by_status, health.errors_by_model,
        health.refusals_by_model, health.error_top_users, health.efficiency, health.decision_sources, tools.friction,
        health.session_duration, health.response_length, health.prompt_length,
    ),
    **_of_metrics(health.env_versions, health.env_entrypoints),
    "prior_range": _prior_range,
    "period_delta": lambda lake: derived.period_delta(_m(lake), _prior(lake)),
    **_of_both(derived.overview_kpis),
    **_of_events(
        derived.tool_insights, derived.plugin_share, derived.hook_insights, derived.top_mode, derived.hour_fill,
        derived.reliability_rate,
    ),
    **_with_entity(oracle.TOOL, _e, derived.tool_weighted_success),
    **_of_metrics(derived.cost_pivot_top4, derived.cost_top_models),
    "detail_totals": lambda lake: derived.detail_totals(
        _m(lake), _e(lake), _team(lake), oracle.USER, oracle.MODEL, oracle.TEAM, oracle.AGENT
    ),
}


def _registered(build: Callable[[Lake], DataFrame]) -> Query:
    return lambda spark, sf_dir: comparable(build(Lake(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return {name: _registered(build) for name, build in {**ANALYTICS, **PIPELINE}.items()}


def oracle_sql() -> dict[str, str]:
    return {**oracle.ORACLE, **oracle_ingest.SQL}
