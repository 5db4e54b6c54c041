"""Figures computed on top of the query blocks: deltas, rates, shares, pivots."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions.maps import count_if, day_text, dim, rate, sum_if, total_of, zero
from usagelake.operators.relational import beside, merge_left
from usagelake.plans import blocks as b
from usagelake.plans.capabilities import autonomy_by_mode, hooks_by_event, plugins
from usagelake.plans.health import reliability_totals
from usagelake.plans.people import cost_trend, of_user
from usagelake.plans.teams import member_totals
from usagelake.plans.tools import agent_uses_by_day, tool_facts, tool_results, tool_uses_by_day


def prior_range(first_day: str, last_day: str) -> tuple[str, str]:
    """The range of equal length directly before an inclusive day range."""
    first, last = date.fromisoformat(first_day), date.fromisoformat(last_day)
    length = (last - first).days + 1
    return (first - timedelta(days=length)).isoformat(), (first - timedelta(days=1)).isoformat()


def change(current: Column, prior: Column) -> Column:
    """Signed relative change; NULL without a baseline, 0 when it is flat."""
    moved = rate(current - prior, F.when(prior != 0, prior))
    return F.when(F.abs(moved) < fx.FLAT_CHANGE, F.lit(0.0)).otherwise(moved)


def is_good(moved: Column, better_when_lower: bool = False) -> Column:
    """Verdict of a change: NULL when flat or without baseline."""
    better = moved < 0 if better_when_lower else moved > 0
    return F.when(moved != 0, better)


def period_totals(m) -> DataFrame:
    """Cost, tokens, users and sessions of one range."""
    name = F.col("name")
    sessions = b.per_session(m, {"cost": name == "cost.usage", "tokens": name == "token.usage"})
    return sessions.agg(
        total_of(F.col("cost")).alias("cost"),
        total_of(F.col("tokens")).alias("tokens"),
        F.count_distinct("user_hash").cast("double").alias("active_users"),
        F.count_distinct("session_id").cast("double").alias("sessions"),
    )


def period_delta(current_m, prior_m) -> DataFrame:
    """Change of each overview figure against the prior range.

    More cost or tokens is neither good nor bad, so those carry no verdict.
    """
    names = ("cost", "tokens", "active_users", "sessions")

    def long(m, column: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).alias(column)) for n in names])
        return period_totals(m).select(F.inline(pairs))

    both = long(current_m, "current").join(long(prior_m, "prior"), "figure")
    moved = both.withColumn("pct", change(F.col("current"), F.col("prior")))
    judged = F.when(F.col("figure").isin("active_users", "sessions"), is_good(F.col("pct")))
    return moved.withColumn("good", judged)


def overview_kpis(m, e) -> DataFrame:
    """The overview's headline figures in one row."""
    name, subtype, decision = F.col("name"), F.col("subtype"), F.col("decision")
    is_decision, is_tokens = name == "code_edit_tool.decision", name == "token.usage"
    sums = {
        "total_cost": name == "cost.usage",
        "total_tokens": is_tokens,
        "total_lines": name == "lines_of_code.count",
        "_seconds": name == "active_time.total",
        "commits": name == "commit.count",
        "pull_requests": name == "pull_request.count",
        "_accept": is_decision & (decision == "accept"),
        "_reject": is_decision & (decision == "reject"),
        "_read": is_tokens & (subtype == "cacheRead"),
        "_creation": is_tokens & (subtype == "cacheCreation"),
    }
    from_metrics = b.per_session(m, sums).agg(
        *[total_of(F.col(c)).alias(c) for c in sums],
        F.count_distinct("user_hash").alias("active_users"),
        F.count_distinct("session_id").alias("sessions"),
    )
    kind = F.col("event_type")
    # Totals over all tools and agents, not over the rows of their top lists.
    from_events = e.agg(
        count_if(kind == "api_request").alias("_requests"),
        count_if(kind == "api_error").alias("_errors"),
        count_if((kind == "tool_result") & (dim(e, "tool_name") != "")).alias("tool_calls"),
        count_if(dim(e, "agent.name") != "").alias("subagent_runs"),
    )
    row = beside(from_metrics, from_events)
    return row.select(
        "total_cost",
        "total_tokens",
        "total_lines",
        (F.col("_seconds") / 60).alias("active_minutes"),
        "commits",
        "pull_requests",
        "active_users",
        "sessions",
        "tool_calls",
        "subagent_runs",
        rate(F.col("total_cost"), F.col("active_users")).alias("cost_per_user"),
        rate(F.col("sessions"), F.col("active_users")).alias("sessions_per_user"),
        (100 * rate(F.col("_accept"), F.col("_accept") + F.col("_reject"))).alias("edit_accept_pct"),
        (100 * rate(F.col("_read"), F.col("_read") + F.col("_creation"))).alias("cache_reuse_pct"),
        zero(100 * rate(F.col("_errors"), F.col("_requests"))).alias("api_error_pct"),
    )


def tool_insights(e) -> DataFrame:
    """Figures over all tools, beyond the rows of the tool list too."""
    uses = F.col("uses")
    sums = tool_facts(e).agg(
        F.coalesce(F.sum("uses"), F.lit(0)).alias("calls"),
        F.count("*").alias("distinct_tools"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("_ok"),
        F.coalesce(F.sum(F.col("reject") + F.col("block")), F.lit(0)).alias("rejected_or_blocked"),
        F.coalesce(F.sum(F.when(F.col("mcp_server") != "", uses)), F.lit(0)).alias("_mcp"),
    )
    return sums.select(
        "calls",
        "distinct_tools",
        "rejected_or_blocked",
        (100 * rate(F.col("_ok"), F.col("calls"))).alias("success_pct"),
        (100 * rate(F.col("_mcp"), F.col("calls"))).alias("mcp_share_pct"),
    )


def tool_weighted_success(e, tool: str) -> DataFrame:
    """Success rate over days weighted by uses."""
    days = tool_uses_by_day(e, tool)
    return days.agg(
        F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"),
        zero(rate(F.sum(F.col("uses") * F.col("success_rate")), F.sum("uses"))).alias("success_rate"),
    )


def plugin_share(e) -> DataFrame:
    listed = plugins(e)
    return listed.agg(
        F.count("*").alias("plugins"),
        (100 * rate(count_if(F.col("has_hooks")), F.count("*"))).alias("with_hooks_pct"),
        (100 * rate(count_if(F.col("has_mcp")), F.count("*"))).alias("with_mcp_pct"),
    )


def hook_insights(e) -> DataFrame:
    listed = hooks_by_event(e)
    return listed.agg(
        F.coalesce(F.sum("executions"), F.lit(0)).alias("executions"),
        (100 * rate(F.sum("success"), F.sum("hooks"))).alias("success_pct"),
        zero(F.sum("blocking")).alias("blocked"),
        zero(rate(F.sum(F.col("avg_ms") * F.col("executions")), F.sum("executions"))).alias("avg_ms"),
    )


def top_mode(e) -> DataFrame:
    """Mode switches, the most frequent destination (first in name order on a tie) and the number of modes."""
    modes = autonomy_by_mode(e)
    best = F.min_by("mode", F.struct(-F.col("count"), F.col("mode")))
    return modes.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("switches"),
        best.alias("top_mode"),
        F.count("*").alias("distinct_modes"),
    )


def _ranked_trend(m, keep: int) -> DataFrame:
    """The daily cost per model with the model's rank by total cost; 0 beyond the kept ones."""
    trend = cost_trend(m).select(day_text(F.col("event_date")).alias("day"), "model", "cost")
    totals = trend.groupBy("model").agg(total_of(F.col("cost")).alias("_total"))
    order = [F.col("_total").desc(), F.col("model").asc()]
    # The limit runs as a distributed top list; only ``keep`` rows reach the rank.
    best = totals.orderBy(*order).limit(keep)
    ranks = best.select("model", F.row_number().over(Window.orderBy(*order)).alias("_rank"))
    return merge_left(trend, ranks, "model", {"_rank": 0})


def cost_pivot_top4(m, keep: int = 4) -> DataFrame:
    """One row per day with the ranked series as zero-filled columns: day, rank_1 .. rank_4, other."""
    return _pivoted(_ranked_trend(m, keep), keep).orderBy("day")


def _pivoted(ranked: DataFrame, keep: int) -> DataFrame:
    def series(rank: int) -> Column:
        return zero(F.sum(F.when(F.col("_rank") == rank, F.col("cost"))))

    columns = [series(i).alias(f"rank_{i}") for i in range(1, keep + 1)]
    return ranked.groupBy("day").agg(*columns, series(0).alias("other"))


def cost_top_models(m, keep: int = 4) -> DataFrame:
    """(day, series, cost): the models with the greatest cost, all others as one series, zero-filled per day."""
    ranked = _ranked_trend(m, keep)
    names = ranked.groupBy("_rank").agg(
        F.max(F.when(F.col("_rank") > 0, F.col("model")).otherwise(fx.OTHER_LABEL)).alias("series")
    )
    cells = [F.struct(F.lit(i).alias("_rank"), F.col(f"rank_{i}").alias("cost")) for i in range(1, keep + 1)]
    cells.append(F.struct(F.lit(0).alias("_rank"), F.col("other").alias("cost")))
    daily = _pivoted(ranked, keep).select("day", F.inline(F.array(*cells)))
    return daily.join(names, "_rank").select("day", "series", "cost").orderBy("day", "series")


def hour_fill(e) -> DataFrame:
    """Requests and cost for all 24 hours, zero where nothing happened."""
    hours = e.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return merge_left(hours, b.hourly_activity(e), "hour", {"requests": 0, "cost": 0.0}).orderBy("hour")


def detail_totals(m, e, membership, user: str, model: str, team: str, agent: str) -> DataFrame:
    """(page, cost, tokens, uses): the head figures of the four detail pages."""
    name, value = F.col("name"), F.col("value")

    def spend(rows: DataFrame) -> DataFrame:
        return rows.agg(
            sum_if(value, name == "cost.usage").alias("cost"), sum_if(value, name == "token.usage").alias("tokens")
        )

    def page(title: str, *frames: DataFrame) -> DataFrame:
        row = beside(*frames)
        have = row.columns
        return row.select(
            F.lit(title).alias("page"),
            *[
                (F.col(c).cast("double") if c in have else F.lit(0.0)).alias(c)
                for c in ("cost", "tokens", "uses")
            ],
        )

    person_tool_uses = tool_results(of_user(e, user)).agg(F.count("*").alias("uses"))
    whole_team = member_totals(m, membership, team).agg(
        total_of(F.col("cost")).alias("cost"), total_of(F.col("tokens")).alias("tokens"), F.sum("sessions").alias("uses")
    )
    agent_days = agent_uses_by_day(e, agent).agg(F.sum("uses").alias("uses"), zero(F.sum("tokens")).alias("tokens"))
    pages = [
        page("person", spend(of_user(m, user)), person_tool_uses),
        page("model", spend(m.where(F.col("model") == F.lit(model)))),
        page("team", whole_team),
        page("agent", agent_days),
    ]
    stacked = pages[0]
    for other in pages[1:]:
        stacked = stacked.unionByName(other)
    return stacked.withColumn("uses", zero(F.col("uses")))


def reliability_rate(e) -> DataFrame:
    totals = reliability_totals(e)
    return totals.select(
        "api_requests",
        "api_errors",
        "refusals",
        (100 * rate(F.col("api_errors"), F.col("api_requests"))).alias("error_pct"),
    )
