"""The registered queries restated as SQL over the generated tables.

Telemetry is derived here a second time, with plain columns and CASE instead of
maps and column expressions, so the two sides share no code.
"""

from __future__ import annotations


# --- shared derivations ---------------------------------------------------------

METRIC_BASE = """
m0 AS (
  SELECT *, (1704067200 + (ok % 30) * 86400 + ln * 3600 + pk % 3600) * 1000000000 + pk % 1000 AS ts_ns,
    DATE '2024-01-01' + CAST(ok % 30 AS INTEGER) AS event_date,
    CASE WHEN sk % 9 = 0 THEN 'unknown' ELSE 'claude_code' END AS source,
    CASE ln WHEN 1 THEN 'cost.usage' WHEN 2 THEN 'token.usage' WHEN 3 THEN 'lines_of_code.count'
      WHEN 4 THEN 'session.count' WHEN 5 THEN 'active_time.total' WHEN 6 THEN 'code_edit_tool.decision'
      ELSE CASE WHEN pk % 2 = 0 THEN 'commit.count' ELSE 'pull_request.count' END END AS name,
    CASE WHEN ln = 5 THEN 'gauge' ELSE 'counter' END AS kind,
    CASE ln WHEN 1 THEN 'USD' WHEN 2 THEN 'tokens' ELSE '' END AS unit,
    CASE WHEN ln = 1 THEN CAST(x AS DECIMAL(14,2)) ELSE CAST(q AS DECIMAL(14,2)) END AS value,
    'org_' || (un % 4) AS org_id, 'u' || un AS user_hash, 's' || ok AS session_id,
    CASE WHEN sk % 6 = 5 THEN '' ELSE 'model-' || (sk % 6) END AS model,
    CASE WHEN ln = 6 AND pk % 3 = 0 THEN 'python' WHEN ln = 6 AND pk % 3 = 1 THEN 'typescript' ELSE '' END AS language,
    CASE WHEN ln = 2 THEN CASE pk % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'output' WHEN 2 THEN 'cacheRead'
                          ELSE 'cacheCreation' END
         WHEN ln = 3 THEN CASE WHEN pk % 2 = 0 THEN 'added' ELSE 'removed' END
         WHEN ln = 5 THEN CASE WHEN pk % 2 = 0 THEN 'user' ELSE 'cli' END ELSE '' END AS subtype,
    CASE WHEN ln = 4 AND pk % 3 = 0 THEN 'fresh' WHEN ln = 4 AND pk % 3 = 1 THEN 'resume' ELSE '' END AS start_type,
    CASE sk % 3 WHEN 0 THEN '' WHEN 1 THEN 'subagent' ELSE 'main' END AS query_source,
    CASE WHEN ln = 6 THEN CASE WHEN pk % 2 = 0 THEN 'Edit' ELSE 'Write' END ELSE '' END AS tool_name,
    CASE WHEN ln = 6 THEN CASE WHEN pk % 3 > 0 THEN 'accept' ELSE 'reject' END ELSE '' END AS decision,
    'dep-' || (un % 5) AS department, 'tid-' || (un % 6) AS team_id,
    '1.' || (sk % 4) AS app_version,
    CASE sk % 5 WHEN 0 THEN 'cli' WHEN 1 THEN 'vscode' ELSE '' END AS entrypoint,
    CASE pk % 4 WHEN 0 THEN NULL WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS effort,
    CASE pk % 5 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'explorer' END AS agent_name,
    CASE WHEN ln = 4 AND pk % 3 = 2 AND pk % 2 = 0 THEN 'continue' END AS start_attribute
  FROM (SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, l_quantity AS q,
               l_extendedprice AS x, 20 + o_custkey % 200 AS un
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
)"""

METRIC_BRONZE = (
    METRIC_BASE
    + """,
mb AS (
  SELECT m0.*, c.copy, CASE WHEN c.copy = 1 THEN 'retry' ELSE 'first' END AS region
  FROM m0 JOIN (VALUES (0), (1)) AS c(copy) ON c.copy = 0 OR pk % 10 = 0
)"""
)

METRIC_SILVER = (
    METRIC_BRONZE
    + """,
ms AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY org_id, source, name, session_id, ts_ns, value, model, language, subtype, start_type,
                   query_source, tool_name, decision
      ORDER BY copy DESC, user_hash DESC, app_version DESC, entrypoint DESC,
        concat_ws(',', 'agent.name=' || agent_name, 'effort=' || effort, 'start_type=' || start_attribute) DESC) AS rn
    FROM mb) WHERE rn = 1
)"""
)

EVENT_BASE = """
e0 AS (
  SELECT *, epoch_us(ts) * 1000 + i % 1000 AS ts_ns, CAST(ts AS DATE) AS event_date,
    CASE WHEN k < 95 THEN 'claude_code' ELSE 'unknown' END AS source,
    'org_' || (u % 4) AS org_id, 'u' || u AS user_hash,
    CASE WHEN i % 97 = 0 THEN '' ELSE 's' || u || '-' || strftime(ts, '%Y-%m-%d') END AS session_id,
    'p' || (i // 3) AS correlation_id, '1.' || (k % 3) AS app_version,
    CASE WHEN k % 6 = 5 THEN NULL ELSE 'model-' || (k % 6) END AS model,
    CASE WHEN k % 7 = 3 AND i % 2 = 0 THEN 'Tool-' || (i % 60) ELSE
    CASE k % 7 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' WHEN 2 THEN 'Read' WHEN 3 THEN 'Grep'
      WHEN 4 THEN 'mcp__github__search' WHEN 5 THEN 'mcp__a__b__c' END END AS tool_name,
    CASE k % 7 WHEN 4 THEN 'github' WHEN 5 THEN 'a' END AS mcp_server,
    CASE k % 7 WHEN 4 THEN 'search' WHEN 5 THEN 'b__c' END AS mcp_tool,
    CASE WHEN i % 5 < 4 THEN 'true' ELSE 'false' END AS success,
    CASE WHEN k % 10 < 7 THEN 'accept' WHEN k % 10 < 9 THEN 'reject' ELSE 'block' END AS decision,
    CASE k % 4 WHEN 0 THEN 'config' WHEN 1 THEN 'user_temporary' WHEN 2 THEN 'user_permanent' END AS decision_source,
    CASE WHEN event_type = 'api_request' THEN agent END AS agent_name,
    CASE WHEN event_type = 'subagent' THEN agent END AS agent_type,
    CASE WHEN event_type = 'plugin' THEN 'plg-' || (u % 5) END AS plugin_name,
    CASE WHEN event_type = 'plugin' THEN '1.' || (k % 3) END AS plugin_version,
    CASE WHEN event_type = 'plugin' THEN 'market-' || (u % 5 % 2) END AS marketplace,
    CASE WHEN event_type = 'plugin' THEN CASE u % 5 % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'project' END END AS plugin_scope,
    CASE WHEN event_type = 'plugin' THEN CASE u % 5 % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'settings'
      ELSE 'marketplace' END END AS enabled_via,
    CASE WHEN event_type = 'plugin' THEN CASE WHEN u % 5 % 2 = 0 THEN 'true' ELSE 'false' END END AS has_hooks,
    CASE WHEN event_type = 'plugin' THEN CASE WHEN u % 5 % 2 = 1 THEN 'true' ELSE 'false' END END AS has_mcp,
    CASE WHEN event_type = 'hook' THEN CASE k % 3 WHEN 0 THEN 'PreToolUse' WHEN 1 THEN 'PostToolUse'
      ELSE 'Stop' END END AS hook_event,
    CASE WHEN event_type = 'hook' AND k % 2 = 0 THEN 'settings' END AS hook_source,
    CASE WHEN event_type = 'mcp_server_connection' THEN CASE u % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'jira' END END
      AS server_name,
    CASE WHEN event_type = 'mcp_server_connection' THEN CASE k % 3 WHEN 0 THEN 'stdio' WHEN 1 THEN 'http'
      ELSE 'sse' END END AS transport_type,
    CASE WHEN event_type = 'mcp_server_connection' THEN CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END END AS is_plugin,
    CASE WHEN event_type = 'skill_activated' AND u % 7 <> 6 THEN 'skill-' || (u % 7) END AS skill_name,
    CASE WHEN event_type = 'permission_mode_changed' THEN CASE k % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'plan'
      ELSE 'auto' END END AS from_mode,
    CASE WHEN event_type = 'permission_mode_changed' THEN CASE (k + 1) % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'plan'
      ELSE 'auto' END END AS to_mode,
    CASE WHEN event_type = 'permission_mode_changed' AND i % 2 = 0 THEN 'shortcut' END AS trigger,
    CASE WHEN i % 11 <> 0 THEN v * 10 END AS duration_ms,
    v AS cost_usd,
    CASE WHEN event_type = 'api_request' AND i % 13 <> 0 THEN k * 10 END AS input_tokens,
    CASE WHEN event_type = 'api_request' AND i % 13 <> 0 THEN k * 3 END AS output_tokens,
    CASE WHEN event_type = 'api_request' AND i % 13 <> 0 THEN k * 20 END AS cache_read_tokens,
    CASE WHEN event_type = 'api_request' AND i % 13 <> 0 THEN k END AS cache_creation_tokens,
    CASE WHEN event_type = 'api_error' THEN CASE i % 4 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 529 END END
      AS status_code,
    CASE WHEN event_type = 'user_prompt' AND i % 17 <> 0 THEN k * 7 END AS prompt_length,
    CASE WHEN event_type = 'assistant_response' AND i % 17 <> 0 THEN k * 31 END AS response_length,
    CASE WHEN event_type = 'subagent' THEN k * 100 END AS total_tokens,
    CASE WHEN event_type = 'subagent' THEN k % 9 END AS total_tool_uses,
    CASE WHEN event_type = 'hook' THEN 1 + k % 4 END AS num_hooks,
    CASE WHEN event_type = 'hook' THEN k % 4 END AS num_success,
    CASE WHEN event_type = 'hook' THEN CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END END AS num_blocking,
    CASE WHEN event_type = 'hook' THEN CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END END AS num_cancelled,
    CASE WHEN event_type = 'hook' THEN CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END END AS num_non_blocking_error,
    CASE WHEN event_type = 'hook' AND i % 11 <> 0 THEN v * 10 END AS total_duration_ms,
    CASE WHEN event_type = 'plugin' AND k % 2 = 0 THEN k % 5 END AS skill_path_count,
    CASE WHEN event_type = 'plugin' THEN k % 4 END AS command_path_count
  FROM (
    SELECT *,
      CASE raw_type WHEN 'view' THEN 'api_request' WHEN 'click' THEN 'tool_result' WHEN 'purchase' THEN 'tool_decision'
        WHEN 'error' THEN CASE k % 5 WHEN 2 THEN 'api_refusal' WHEN 3 THEN 'api_retries_exhausted'
                          WHEN 4 THEN 'internal_error' ELSE 'api_error' END
        ELSE CASE k % 8 WHEN 0 THEN 'user_prompt' WHEN 1 THEN 'assistant_response' WHEN 2 THEN 'plugin'
             WHEN 3 THEN 'hook' WHEN 4 THEN 'mcp_server_connection' WHEN 5 THEN 'skill_activated'
             WHEN 6 THEN 'subagent' ELSE 'permission_mode_changed' END END AS event_type,
      CASE i % 4 WHEN 0 THEN 'reviewer' WHEN 1 THEN 'explorer' WHEN 2 THEN 'planner' END AS agent
    FROM (SELECT event_id AS i, user_id AS u, event_type AS raw_type, ts, CAST(value AS DECIMAL(12,2)) AS v,
                 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
)"""

DIM_COLUMNS = {
    "agent.name": "agent_name", "agent_type": "agent_type", "decision": "decision",
    "decision_source": "decision_source", "enabled_via": "enabled_via", "from_mode": "from_mode",
    "has_hooks": "has_hooks", "has_mcp": "has_mcp", "hook_event": "hook_event", "hook_source": "hook_source",
    "is_plugin": "is_plugin", "marketplace.name": "marketplace", "mcp_server": "mcp_server", "mcp_tool": "mcp_tool",
    "model": "model", "plugin.name": "plugin_name", "plugin.scope": "plugin_scope",
    "plugin.version": "plugin_version", "server_name": "server_name", "skill.name": "skill_name",
    "success": "success", "to_mode": "to_mode", "tool_name": "tool_name", "transport_type": "transport_type",
    "trigger": "trigger",
}
NUMBER_COLUMNS = (
    "cache_creation_tokens", "cache_read_tokens", "command_path_count", "cost_usd", "duration_ms", "input_tokens",
    "num_blocking", "num_cancelled", "num_hooks", "num_non_blocking_error", "num_success", "output_tokens",
    "prompt_length", "response_length", "skill_path_count", "status_code", "total_duration_ms", "total_tokens",
    "total_tool_uses",
)

EVENT_BRONZE = (
    EVENT_BASE
    + """,
eb AS (
  SELECT e0.*, c.copy, CASE WHEN c.copy = 1 THEN 'retry' ELSE 'first' END AS region
  FROM e0 JOIN (VALUES (0), (1)) AS c(copy) ON c.copy = 0 OR i % 10 = 0
)"""
)

EVENT_SILVER = (
    EVENT_BRONZE
    + f""",
es AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY org_id, source, event_type, session_id, correlation_id, ts_ns,
        {", ".join(DIM_COLUMNS.values())}, {", ".join(NUMBER_COLUMNS)}
      ORDER BY copy DESC, user_hash DESC, app_version DESC) AS rn
    FROM eb) WHERE rn = 1
)"""
)

ORG, FIRST, LAST = "org_1", "2024-01-05", "2024-01-25"
PRIOR_FIRST, PRIOR_LAST = "2023-12-15", "2024-01-04"
USER, MODEL, TOOL, AGENT, TEAM, PLUGIN = "u45", "model-2", "Edit", "explorer", "team-3", "plg-1"


def _scope(name: str, source: str, first: str = FIRST, last: str = LAST) -> str:
    return (
        f"{name} AS (SELECT * FROM {source} WHERE org_id = '{ORG}' "
        f"AND event_date BETWEEN DATE '{first}' AND DATE '{last}')"
    )


M = f"WITH {METRIC_SILVER},\n{_scope('m', 'ms')}\n"
E = f"WITH {EVENT_SILVER},\n{_scope('e', 'es')}\n"
ME = f"WITH {METRIC_SILVER},\n{_scope('m', 'ms')},\n{EVENT_SILVER},\n{_scope('e', 'es')}\n"

ACCOUNTS = """
accounts AS (SELECT c_custkey AS c, c_name AS name, c_custkey % 220 AS n, c_custkey // 220 AS round FROM customer)"""
MEMBERSHIP = (
    ACCOUNTS
    + """,
mh AS (
  SELECT 'org_' || (n % 4) AS org_id, 'u' || n AS account_hash, 'team-' || ((n + round) % 6) AS team, c AS version
  FROM accounts WHERE n % 6 <> 5
  UNION ALL
  SELECT 'org_x', 'u' || n, 'team-foreign', c FROM accounts WHERE n % 6 <> 5 AND n % 7 = 0),
tm AS (
  SELECT account_hash, team FROM (
    SELECT *, row_number() OVER (PARTITION BY org_id, account_hash ORDER BY version DESC, team DESC) AS rn FROM mh)
  WHERE rn = 1 AND org_id = 'org_1')"""
)
TEAM_OF = "coalesce(nullif(tm.team, ''), '(unassigned)')"


# --- small SQL builders ---------------------------------------------------------


def dbl(expr: str) -> str:
    return f"round(CAST(coalesce({expr}, 0) AS DOUBLE), 6)"


def opt(expr: str) -> str:
    """Rounded, NULL kept."""
    return f"round(CAST({expr} AS DOUBLE), 6)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def labelled(expr: str, missing: str) -> str:
    return f"coalesce(nullif({expr}, ''), '{missing}')"


def sum_by(base: str, where: str, key: str, key_name: str, value_name: str, missing: str, source: str = "m") -> str:
    return (
        f"{base}SELECT {labelled('k', missing)} AS {key_name}, {dbl('sum(value)')} AS {value_name} "
        f"FROM (SELECT {key} AS k, value FROM {source} WHERE {where}) GROUP BY k"
    )


def sum_by_day(where: str) -> str:
    return f"{M}SELECT strftime(event_date, '%Y-%m-%d') AS day, {dbl('sum(value)')} AS cost FROM m WHERE {where} GROUP BY event_date"


def count_by(where: str, key: str, key_name: str, value_name: str, missing: str | None = None, n: int | None = None):
    shown = f"coalesce(k, '')" if missing is None else labelled("k", missing)
    keep = "WHERE coalesce(k, '') <> ''" if missing is None else ""
    top = f" ORDER BY {value_name} DESC, {key_name} LIMIT {n}" if n else ""
    return (
        f"{E}SELECT {shown} AS {key_name}, count(*) AS {value_name} "
        f"FROM (SELECT {key} AS k FROM e WHERE {where}) {keep} GROUP BY k{top}"
    )


def users_by(where: str, value_name: str, n: int) -> str:
    return (
        f"{E}SELECT user_hash, count(*) AS {value_name} FROM e WHERE {where} "
        f"GROUP BY user_hash ORDER BY {value_name} DESC, user_hash LIMIT {n}"
    )


SUCCESS = "round(CAST(count(*) FILTER (success = 'true') AS DOUBLE) / count(*), 6)"
AVG_MS = dbl("avg(duration_ms)")


def tool_usage(where: str, key: str = "tool_name", name: str = "tool", uses: str = "uses") -> str:
    return (
        f"{E}SELECT {key} AS {name}, count(*) AS {uses}, {SUCCESS} AS success_rate, {AVG_MS} AS avg_ms FROM e "
        f"WHERE event_type = 'tool_result' AND {where} AND {key} IS NOT NULL "
        f"GROUP BY {key} ORDER BY {uses} DESC, {name} LIMIT 20"
    )


DECISIONS = ", ".join(f"count(*) FILTER (decision = '{d}') AS {d}" for d in ("accept", "reject", "block"))


def hourly(where: str) -> str:
    return (
        f"{E}SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS requests, {dbl('sum(cost_usd)')} AS cost "
        f"FROM e WHERE event_type = 'api_request' AND {where} GROUP BY 1"
    )


START = "CASE WHEN start_type <> '' THEN start_type ELSE coalesce(start_attribute, '') END"
COST = "name = 'cost.usage'"
TOKENS = "name = 'token.usage'"


def ns_text(expr: str) -> str:
    return (
        f"strftime(make_timestamp(CAST({expr} // 1000000000 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') || '.' || "
        f"lpad(CAST({expr} % 1000000000 AS VARCHAR), 9, '0')"
    )


# --- overview -------------------------------------------------------------------

_AGENT_TOKENS = (
    "SELECT agent_name AS k, sum(value) AS v FROM m WHERE name = 'token.usage' AND agent_name IS NOT NULL GROUP BY 1"
)

ORACLE: dict[str, str] = {
    "orgs": f"""WITH {METRIC_BRONZE}, {EVENT_BRONZE}
        SELECT org_id, {big('sum(c)')} AS rows, {ns_text('max(s)')} AS last_seen FROM (
          SELECT org_id, count(*) AS c, max(ts_ns) AS s FROM mb GROUP BY org_id UNION ALL
          SELECT org_id, count(*), max(ts_ns) FROM eb GROUP BY org_id) GROUP BY org_id""",
    "cost_by_model": sum_by(M, COST, "model", "model", "cost", "(unknown)"),
    "cost_by_day": sum_by_day(COST),
    "cost_by_source": sum_by(M, COST, "query_source", "source", "cost", "(main)"),
    "tokens_by_type": sum_by(M, TOKENS, "subtype", "token_type", "tokens", "(none)"),
    "adoption": f"{M}SELECT count(DISTINCT user_hash) AS active_users, count(DISTINCT session_id) AS sessions FROM m",
    "edit_decisions": f"""{M}SELECT {dbl("sum(value) FILTER (decision = 'accept')")} AS accept,
        {dbl("sum(value) FILTER (decision = 'reject')")} AS reject FROM m WHERE name = 'code_edit_tool.decision'""",
    "api_totals": f"""{E}SELECT count(*) FILTER (event_type = 'api_request') AS api_requests,
        count(*) FILTER (event_type = 'api_error') AS api_errors FROM e""",
    "lines_of_code": sum_by(M, "name = 'lines_of_code.count'", "subtype", "subtype", "lines", "(none)"),
    "commits": f"{M}SELECT {dbl('sum(value)')} AS commits FROM m WHERE name = 'commit.count'",
    "pull_requests": f"{M}SELECT {dbl('sum(value)')} AS pull_requests FROM m WHERE name = 'pull_request.count'",
    "active_time": sum_by(M, "name = 'active_time.total'", "subtype", "subtype", "seconds", "(none)"),
    "sessions_by_start": sum_by(M, "name = 'session.count'", START, "start_type", "count", "(none)"),
    "tools_top": tool_usage("true"),
    "tool_decisions_top": f"""{E}SELECT tool_name AS tool, {DECISIONS} FROM e
        WHERE event_type = 'tool_decision' AND tool_name IS NOT NULL GROUP BY 1
        ORDER BY accept + reject + block DESC, tool LIMIT 20""",
    "subagents": f"""{ME}SELECT a.k AS agent_type, uses, {dbl('v')} AS tokens FROM (
          SELECT agent_name AS k, count(*) AS uses FROM e WHERE agent_name IS NOT NULL GROUP BY 1
          ORDER BY uses DESC, k LIMIT 20) a LEFT JOIN ({_AGENT_TOKENS}) t USING (k)""",
    "cost_by_effort": sum_by(M, COST, "coalesce(effort, '')", "effort", "cost", "(none)"),
    "cost_by_user_top": f"""{M}SELECT user_hash, {dbl('sum(value)')} AS cost FROM m WHERE {COST}
        GROUP BY 1 ORDER BY sum(value) DESC, user_hash LIMIT 10""",
    "activity_by_hour": hourly("true"),
    "skills_top": count_by("event_type = 'skill_activated'", "skill_name", "name", "count", n=20),
    "mcp_connected_top": count_by("event_type = 'mcp_server_connection'", "server_name", "name", "count", n=20),
    "plugins_top": count_by("event_type = 'plugin'", "plugin_name", "name", "count", n=20),
}

_BREAKDOWNS = (
    ("cost_by_model", COST, "model", "(unknown)"),
    ("cost_by_day", COST, "strftime(event_date, '%Y-%m-%d')", ""),
    ("cost_by_source", COST, "query_source", "(main)"),
    ("cost_by_effort", COST, "coalesce(effort, '')", "(none)"),
    ("tokens_by_type", TOKENS, "subtype", "(none)"),
    ("lines_of_code", "name = 'lines_of_code.count'", "subtype", "(none)"),
    ("active_time", "name = 'active_time.total'", "subtype", "(none)"),
    ("sessions_by_start", "name = 'session.count'", START, "(none)"),
    ("commits", "name = 'commit.count'", "''", ""),
    ("pull_requests", "name = 'pull_request.count'", "''", ""),
    ("edit_decisions", "name = 'code_edit_tool.decision'", "decision", ""),
)
ORACLE["metric_breakdowns"] = M + " UNION ALL ".join(
    f"SELECT '{block}' AS block, {labelled('k', missing)} AS key, {dbl('sum(value)')} AS value "
    f"FROM (SELECT {key} AS k, value FROM m WHERE {where}) GROUP BY k"
    for block, where, key, missing in _BREAKDOWNS
)

_EVENT_BREAKDOWNS = (
    ("skills", "skill_activated", "skill_name", ""),
    ("plugins", "plugin", "plugin_name", ""),
    ("mcp_servers", "mcp_server_connection", "server_name", ""),
    ("mcp_by_transport", "mcp_server_connection", "transport_type", "(none)"),
    ("hooks_by_source", "hook", "hook_source", "(none)"),
    ("autonomy_by_mode", "permission_mode_changed", "to_mode", "(none)"),
    ("autonomy_by_trigger", "permission_mode_changed", "trigger", "(none)"),
    ("decision_sources", "tool_result", "decision_source", "(unknown)"),
    ("errors_by_model", "api_error", "model", "(unknown)"),
    ("refusals_by_model", "api_refusal", "model", "(unknown)"),
)
ORACLE["event_breakdowns"] = (
    E
    + "SELECT block, key, count FROM ("
    + " UNION ALL ".join(
        f"SELECT '{block}' AS block, coalesce({key}, '{missing}') AS key, count(*) AS count "
        f"FROM e WHERE event_type = '{kind}' GROUP BY 2"
        for block, kind, key, missing in _EVENT_BREAKDOWNS
    )
    + ") WHERE key <> ''"
)

# --- people and models ----------------------------------------------------------

_BY_USER = f"user_hash = '{USER}'"
_BY_MODEL = f"{COST} AND model = '{MODEL}'"
ORACLE |= {
    "people": f"""{ME}SELECT coalesce(a.user_hash, b.user_hash) AS user_hash, {dbl('cost')} AS cost,
          {dbl('tokens')} AS tokens, {dbl('lines_added')} AS lines_added, {big('coalesce(sessions, 0)')} AS sessions,
          coalesce({ns_text('seen')}, '') AS last_active, {big('coalesce(tool_calls, 0)')} AS tool_calls
        FROM (SELECT user_hash, sum(value) FILTER ({COST}) AS cost, sum(value) FILTER ({TOKENS}) AS tokens,
                sum(value) FILTER (name = 'lines_of_code.count' AND subtype = 'added') AS lines_added,
                count(DISTINCT session_id) AS sessions, max(ts_ns) AS seen FROM m GROUP BY 1) a
        FULL JOIN (SELECT user_hash, count(*) AS tool_calls FROM e WHERE event_type = 'tool_result' GROUP BY 1) b
          ON a.user_hash = b.user_hash
        ORDER BY coalesce(cost, 0) DESC, 1 LIMIT 500""",
    "person_cost_by_day": sum_by_day(f"{COST} AND {_BY_USER}"),
    "person_tokens": sum_by(M, f"{TOKENS} AND {_BY_USER}", "subtype", "token_type", "tokens", "(none)"),
    "person_models": sum_by(M, f"{COST} AND {_BY_USER}", "model", "model", "cost", "(unknown)"),
    "person_sessions": f"{M}SELECT count(DISTINCT session_id) AS sessions FROM m WHERE {_BY_USER}",
    "person_lines": sum_by(M, f"name = 'lines_of_code.count' AND {_BY_USER}", "subtype", "subtype", "lines", "(none)"),
    "person_tools": tool_usage(_BY_USER),
    "person_activity_by_hour": hourly(_BY_USER),
    "model_cost_by_day": sum_by_day(_BY_MODEL),
    "model_tokens": sum_by(M, f"{TOKENS} AND model = '{MODEL}'", "subtype", "token_type", "tokens", "(none)"),
    "model_top_users": f"""{M}SELECT user_hash, {dbl('sum(value)')} AS cost FROM m WHERE {_BY_MODEL}
        GROUP BY 1 ORDER BY sum(value) DESC, user_hash LIMIT 10""",
    "model_cost_by_source": sum_by(M, _BY_MODEL, "query_source", "source", "cost", "(main)"),
    "model_cost_by_effort": sum_by(M, _BY_MODEL, "coalesce(effort, '')", "effort", "cost", "(none)"),
    "cost_timeseries": f"""{M}SELECT strftime(event_date, '%Y-%m-%d') AS day, {labelled('model', '(unknown)')} AS model,
        {dbl('sum(value)')} AS cost FROM m WHERE {COST} GROUP BY event_date, m.model""",
}

# --- tools and agents -----------------------------------------------------------

_RESULT = "event_type = 'tool_result' AND tool_name IS NOT NULL"
_TOOLS_LIST = f"""
tl AS (
  SELECT coalesce(a.tool, b.tool) AS tool, coalesce(mcp_server, '') AS mcp_server, {big('coalesce(uses, 0)')} AS uses,
    coalesce(ok / uses, 0) AS success_rate, coalesce(avg_ms, 0) AS avg_ms, coalesce(p95_ms, 0) AS p95_ms,
    {big('coalesce(users, 0)')} AS users, {big('coalesce(accept, 0)')} AS accept,
    {big('coalesce(reject, 0)')} AS reject, {big('coalesce(block, 0)')} AS block
  FROM (SELECT tool_name AS tool, max(mcp_server) AS mcp_server, count(*) AS uses,
          CAST(count(*) FILTER (success = 'true') AS DOUBLE) AS ok, CAST(avg(duration_ms) AS DOUBLE) AS avg_ms,
          quantile_cont(CAST(duration_ms AS DOUBLE), 0.95) AS p95_ms, count(DISTINCT user_hash) AS users
        FROM e WHERE {_RESULT} GROUP BY 1) a
  FULL JOIN (SELECT tool_name AS tool, {DECISIONS} FROM e WHERE event_type = 'tool_decision'
             AND tool_name IS NOT NULL GROUP BY 1) b ON a.tool = b.tool)"""
_BY_TOOL = f"event_type = 'tool_result' AND tool_name = '{TOOL}'"
_BY_AGENT = f"event_type = 'subagent' AND agent_type = '{AGENT}'"
ORACLE |= {
    "tools_list": f"""{E}, {_TOOLS_LIST}
        SELECT tool, mcp_server, uses, round(success_rate, 6) AS success_rate, round(avg_ms, 6) AS avg_ms,
          round(p95_ms, 6) AS p95_ms, users, accept, reject, block FROM tl ORDER BY uses DESC, tool LIMIT 500""",
    "tool_uses_by_day": f"""{E}SELECT strftime(event_date, '%Y-%m-%d') AS day, count(*) AS uses,
        {SUCCESS} AS success_rate FROM e WHERE {_BY_TOOL} GROUP BY event_date""",
    "tool_latency": f"""{E}SELECT {AVG_MS} AS avg_ms,
        {dbl('quantile_cont(CAST(duration_ms AS DOUBLE), 0.95)')} AS p95_ms FROM e WHERE {_BY_TOOL}""",
    "tool_decisions": f"""{E}SELECT {DECISIONS} FROM e
        WHERE event_type = 'tool_decision' AND tool_name = '{TOOL}'""",
    "tool_top_users": users_by(_BY_TOOL, "uses", 10),
    "agents_list": f"""{E}SELECT agent_type, count(*) AS uses, {dbl('sum(total_tokens)')} AS tokens,
        {dbl('sum(total_tool_uses)')} AS tool_uses, count(DISTINCT user_hash) AS users, {AVG_MS} AS avg_duration_ms
        FROM e WHERE event_type = 'subagent' AND agent_type IS NOT NULL GROUP BY 1
        ORDER BY uses DESC, agent_type LIMIT 200""",
    "agents_by_name": f"""{ME}SELECT a.k AS agent_type, uses, users, {dbl('v')} AS tokens, CAST(0 AS BIGINT) AS tool_uses
        FROM (SELECT agent_name AS k, count(*) AS uses, count(DISTINCT user_hash) AS users FROM e
              WHERE agent_name IS NOT NULL GROUP BY 1 ORDER BY uses DESC, k LIMIT 200) a
        LEFT JOIN ({_AGENT_TOKENS}) t USING (k)""",
    "agent_uses_by_day": f"""{E}SELECT strftime(event_date, '%Y-%m-%d') AS day, count(*) AS uses,
        {dbl('sum(total_tokens)')} AS tokens FROM e WHERE {_BY_AGENT} GROUP BY event_date""",
    "agent_top_users": users_by(_BY_AGENT, "uses", 10),
}

# --- teams ----------------------------------------------------------------------

_TEAM_JOIN = "LEFT JOIN tm ON user_hash = tm.account_hash"
_MT = f"{ME}, {MEMBERSHIP}, mt AS (SELECT m.*, {TEAM_OF} AS team FROM m {_TEAM_JOIN})"
_ET = f"{E}, {MEMBERSHIP}, et AS (SELECT e.*, {TEAM_OF} AS team FROM e {_TEAM_JOIN})"
_BOTH = f"{_MT}, et AS (SELECT e.*, {TEAM_OF} AS team FROM e {_TEAM_JOIN})"
_IN_TEAM = f"team = '{TEAM}'"
ORACLE |= {
    "teams": f"""{_BOTH} SELECT coalesce(a.team, b.team) AS team, {big('coalesce(members, 0)')} AS members,
          {dbl('cost')} AS cost, {dbl('tokens')} AS tokens, {big('coalesce(sessions, 0)')} AS sessions,
          {big('coalesce(tool_calls, 0)')} AS tool_calls
        FROM (SELECT team, count(DISTINCT user_hash) AS members, sum(value) FILTER ({COST}) AS cost,
                sum(value) FILTER ({TOKENS}) AS tokens, count(DISTINCT session_id) AS sessions FROM mt GROUP BY 1) a
        FULL JOIN (SELECT team, count(*) AS tool_calls FROM et WHERE event_type = 'tool_result' GROUP BY 1) b
          ON a.team = b.team""",
    "team_cost_by_day": f"""{_MT} SELECT strftime(event_date, '%Y-%m-%d') AS day, {dbl('sum(value)')} AS cost
        FROM mt WHERE {COST} AND {_IN_TEAM} GROUP BY event_date""",
    "team_members": f"""{_MT} SELECT user_hash, {dbl(f'sum(value) FILTER ({COST})')} AS cost,
        {dbl(f'sum(value) FILTER ({TOKENS})')} AS tokens, count(DISTINCT session_id) AS sessions FROM mt
        WHERE {_IN_TEAM} GROUP BY 1 ORDER BY coalesce(sum(value) FILTER ({COST}), 0) DESC, user_hash LIMIT 100""",
    "team_models": f"""{_MT} SELECT {labelled('model', '(unknown)')} AS model, {dbl('sum(value)')} AS cost
        FROM mt WHERE {COST} AND {_IN_TEAM} GROUP BY mt.model""",
    "team_tools": f"""{_ET} SELECT tool_name AS tool, count(*) AS uses, {SUCCESS} AS success_rate, {AVG_MS} AS avg_ms
        FROM et WHERE {_RESULT} AND {_IN_TEAM} GROUP BY 1 ORDER BY uses DESC, tool LIMIT 20""",
}

# --- capabilities and plugins ---------------------------------------------------


def _any(expr: str) -> str:
    return f"coalesce(arg_max(coalesce({expr}, ''), ts_ns), '')"


_PLUGIN_FACTS = f"""{_any('plugin_version')} AS version, {_any('marketplace')} AS marketplace,
    {_any('plugin_scope')} AS scope, {_any('enabled_via')} AS enabled_via,
    {_any('has_hooks')} = 'true' AS has_hooks, {_any('has_mcp')} = 'true' AS has_mcp,
    {dbl('max(coalesce(skill_path_count, 0))')} AS skills, {dbl('max(coalesce(command_path_count, 0))')} AS commands,
    CAST(0 AS DOUBLE) AS agents, count(*) AS events"""
_HOOKS = f"""SELECT coalesce(hook_event, '(none)') AS hook_event, count(*) AS executions,
    {dbl('sum(num_hooks)')} AS hooks, {dbl('sum(num_success)')} AS success, {dbl('sum(num_blocking)')} AS blocking,
    {dbl('sum(num_cancelled)')} AS cancelled, {dbl('sum(num_non_blocking_error)')} AS errors,
    {dbl('avg(total_duration_ms)')} AS avg_ms FROM e WHERE event_type = 'hook' GROUP BY 1"""
_CONNECT = "event_type = 'mcp_server_connection'"
_SWITCH = "event_type = 'permission_mode_changed'"
_BY_PLUGIN = f"event_type = 'plugin' AND plugin_name = '{PLUGIN}'"
_PLUGINS = f"SELECT plugin_name AS name, {_PLUGIN_FACTS} FROM e WHERE event_type = 'plugin' GROUP BY 1"
ORACLE |= {
    "plugins": f"{E}{_PLUGINS}",
    "hooks_by_event": f"{E}{_HOOKS}",
    "hooks_by_source": count_by("event_type = 'hook'", "hook_source", "source", "count", "(none)"),
    "mcp_totals": f"""{E}SELECT count(*) AS connections, {AVG_MS} AS avg_connect_ms,
        count(*) FILTER (is_plugin = 'true') AS plugin_provided FROM e WHERE {_CONNECT}""",
    "mcp_by_transport": count_by(_CONNECT, "transport_type", "transport", "count", "(none)"),
    "mcp_connected_servers": f"""{E}SELECT server_name AS server, count(*) AS connections, {AVG_MS} AS avg_connect_ms
        FROM e WHERE {_CONNECT} AND server_name IS NOT NULL GROUP BY 1 ORDER BY connections DESC, server LIMIT 20""",
    "mcp_tool_calls": tool_usage("true", "mcp_server", "server", "calls"),
    "cap_skills": count_by("event_type = 'skill_activated'", "skill_name", "name", "count", n=20),
    "cap_session_starts": sum_by(M, "name = 'session.count'", START, "start_type", "count", "(none)"),
    "autonomy_total": f"{E}SELECT count(*) AS total FROM e WHERE {_SWITCH}",
    "autonomy_by_mode": count_by(_SWITCH, "to_mode", "mode", "count", "(none)"),
    "autonomy_transitions": f"""{E}SELECT coalesce(from_mode, '(none)') AS from_mode,
        coalesce(to_mode, '(none)') AS to_mode, count(*) AS count FROM e WHERE {_SWITCH} GROUP BY 1, 2""",
    "autonomy_by_trigger": count_by(_SWITCH, "trigger", "trigger", "count", "(none)"),
    "plugin_info": f"""{E}SELECT * FROM (SELECT '{PLUGIN}' AS name, {_PLUGIN_FACTS} FROM e WHERE {_BY_PLUGIN})
        WHERE events > 0""",
    "plugin_versions": count_by(_BY_PLUGIN, "plugin_version", "version", "count"),
    "plugin_users": users_by(_BY_PLUGIN, "events", 20),
    "plugin_by_day": f"""{E}SELECT strftime(event_date, '%Y-%m-%d') AS day, count(*) AS events FROM e
        WHERE {_BY_PLUGIN} GROUP BY event_date""",
}

# --- reliability, environment, efficiency, governance, engagement -----------------

_TOTALS = """SELECT count(*) FILTER (event_type = 'api_request') AS api_requests,
    count(*) FILTER (event_type = 'api_error') AS api_errors, count(*) FILTER (event_type = 'api_refusal') AS refusals,
    count(*) FILTER (event_type = 'api_retries_exhausted') AS retries_exhausted,
    count(*) FILTER (event_type = 'internal_error') AS internal_errors FROM e"""


def _reach(column: str, name: str) -> str:
    return (
        f"{M}SELECT {column} AS {name}, count(DISTINCT user_hash) AS users, count(DISTINCT session_id) AS sessions "
        f"FROM m WHERE {column} <> '' GROUP BY 1"
    )


ORACLE |= {
    "reliability_totals": f"{E}{_TOTALS}",
    "errors_by_day": f"""{E}SELECT strftime(event_date, '%Y-%m-%d') AS day,
        count(*) FILTER (event_type = 'api_request') AS requests,
        count(*) FILTER (event_type = 'api_error') AS errors FROM e GROUP BY event_date""",
    "errors_by_status": f"""{E}SELECT coalesce(CAST(status_code AS VARCHAR), '(none)') AS status, count(*) AS count
        FROM e WHERE event_type = 'api_error' GROUP BY 1""",
    "errors_by_model": count_by("event_type = 'api_error'", "model", "model", "errors", "(unknown)"),
    "refusals_by_model": count_by("event_type = 'api_refusal'", "model", "model", "count", "(unknown)"),
    "error_top_users": users_by("event_type = 'api_error'", "errors", 10),
    "env_versions": _reach("app_version", "version"),
    "env_entrypoints": _reach("entrypoint", "entrypoint"),
    "efficiency": f"""{E}SELECT {dbl('r')} AS cache_read, {dbl('c')} AS cache_creation, {dbl('i')} AS input,
          {dbl('o')} AS output, {dbl('t')} AS total_cost,
          CASE WHEN r + c + i > 0 THEN round(CAST(r AS DOUBLE) / (r + c + i), 6) ELSE 0 END AS cache_hit_ratio,
          {dbl('r * 0.9')} AS estimated_savings_tokens
        FROM (SELECT sum(cache_read_tokens) AS r, sum(cache_creation_tokens) AS c, sum(input_tokens) AS i,
                sum(output_tokens) AS o, sum(cost_usd) AS t FROM e WHERE event_type = 'api_request')""",
    "decision_sources": count_by("event_type = 'tool_result'", "decision_source", "source", "count", "(unknown)"),
    "friction": f"""{E}SELECT tool, total, rejects, blocks, round(rate, 6) AS friction_rate FROM (
          SELECT *, CAST(rejects + blocks AS DOUBLE) / total AS rate FROM (
            SELECT tool_name AS tool, count(*) AS total, count(*) FILTER (decision = 'reject') AS rejects,
              count(*) FILTER (decision = 'block') AS blocks FROM e
            WHERE event_type = 'tool_decision' AND tool_name IS NOT NULL GROUP BY 1))
        ORDER BY rate DESC, tool LIMIT 20""",
    "session_duration": f"""{E}SELECT {dbl('avg(d)')} AS avg_seconds, count(*) AS sessions,
          {dbl('quantile_cont(CAST(d AS DOUBLE), 0.5)')} AS p50_seconds,
          {dbl('quantile_cont(CAST(d AS DOUBLE), 0.95)')} AS p95_seconds
        FROM (SELECT session_id, date_diff('second', min(ts), max(ts)) AS d FROM e WHERE session_id <> '' GROUP BY 1)""",
    "response_length": f"""{E}SELECT {dbl('avg(response_length)')} AS avg,
          {dbl('quantile_cont(CAST(response_length AS DOUBLE), 0.5)')} AS p50,
          {dbl('quantile_cont(CAST(response_length AS DOUBLE), 0.95)')} AS p95
        FROM e WHERE event_type = 'assistant_response'""",
    "prompt_length": f"{E}SELECT {dbl('avg(prompt_length)')} AS avg FROM e WHERE event_type = 'user_prompt'",
}

# --- derived figures --------------------------------------------------------------

_KPI_SUM = {
    "total_cost": COST,
    "total_tokens": TOKENS,
    "total_lines": "name = 'lines_of_code.count'",
    "active_seconds": "name = 'active_time.total'",
    "commits": "name = 'commit.count'",
    "pull_requests": "name = 'pull_request.count'",
    "ok": "name = 'code_edit_tool.decision' AND decision = 'accept'",
    "no": "name = 'code_edit_tool.decision' AND decision = 'reject'",
    "reads": f"{TOKENS} AND subtype = 'cacheRead'",
    "created": f"{TOKENS} AND subtype = 'cacheCreation'",
}
_PERIOD = f"""SELECT coalesce(sum(value) FILTER ({COST}), 0) AS cost, coalesce(sum(value) FILTER ({TOKENS}), 0) AS tokens,
    count(DISTINCT user_hash) AS active_users, count(DISTINCT session_id) AS sessions FROM"""
_TREND = f"""trend AS (SELECT strftime(event_date, '%Y-%m-%d') AS day, coalesce(nullif(m.model, ''), '(unknown)') AS model,
    sum(value) AS cost FROM m WHERE {COST} GROUP BY event_date, m.model),
  best AS (SELECT model, row_number() OVER (ORDER BY sum(cost) DESC, model) AS r FROM trend GROUP BY model),
  placed AS (SELECT day, cost, CASE WHEN r <= 4 THEN r ELSE 0 END AS r, CASE WHEN r <= 4 THEN model ELSE 'Other' END AS series
             FROM trend JOIN best USING (model))"""
ORACLE |= {
    "prior_range": f"""{M.replace("DATE '" + FIRST, "DATE '" + PRIOR_FIRST).replace("DATE '" + LAST, "DATE '" + PRIOR_LAST)}
        SELECT '{PRIOR_FIRST}' AS first_day, '{PRIOR_LAST}' AS last_day, count(*) AS points, {dbl('sum(value)')} AS total
        FROM m""",
    "period_delta": f"""{M}, {_scope('p', 'ms', PRIOR_FIRST, PRIOR_LAST)}, cur AS ({_PERIOD} m), old AS ({_PERIOD} p),
        both_ AS (
          SELECT unnest(['cost', 'tokens', 'active_users', 'sessions']) AS figure,
            unnest([CAST(cur.cost AS DOUBLE), CAST(cur.tokens AS DOUBLE), cur.active_users, cur.sessions]) AS c,
            unnest([CAST(old.cost AS DOUBLE), CAST(old.tokens AS DOUBLE), old.active_users, old.sessions]) AS p
          FROM cur, old),
        moved AS (SELECT *, CASE WHEN p <> 0 THEN CASE WHEN abs((c - p) / p) < 0.0005 THEN 0
                                 ELSE (c - p) / p END END AS pct FROM both_)
        SELECT figure, round(c, 6) AS current, round(p, 6) AS prior, round(pct, 6) AS pct,
          CASE WHEN figure IN ('active_users', 'sessions') AND pct <> 0 THEN pct > 0 END AS good FROM moved""",
    "overview_kpis": f"""{ME}, a AS (SELECT
          {", ".join(f"CAST(coalesce(sum(value) FILTER ({w}), 0) AS DOUBLE) AS {n}" for n, w in _KPI_SUM.items())},
          count(DISTINCT user_hash) AS active_users, count(DISTINCT session_id) AS sessions FROM m),
        b AS (SELECT count(*) FILTER (event_type = 'api_request') AS req, count(*) FILTER (event_type = 'api_error') AS err
              FROM e),
        c AS (SELECT count(*) AS tool_calls FROM e WHERE {_RESULT}),
        d AS (SELECT count(*) AS runs FROM e WHERE agent_name IS NOT NULL)
        SELECT round(total_cost, 6) AS total_cost, round(total_tokens, 6) AS total_tokens,
          round(total_lines, 6) AS total_lines, round(active_seconds / 60, 6) AS active_minutes,
          round(commits, 6) AS commits, round(pull_requests, 6) AS pull_requests, active_users, sessions,
          {big('coalesce(tool_calls, 0)')} AS tool_calls, {big('coalesce(runs, 0)')} AS subagent_runs,
          round(total_cost / nullif(active_users, 0), 6) AS cost_per_user,
          round(CAST(sessions AS DOUBLE) / nullif(active_users, 0), 6) AS sessions_per_user,
          round(100 * ok / nullif(ok + no, 0), 6) AS edit_accept_pct,
          round(100 * reads / nullif(reads + created, 0), 6) AS cache_reuse_pct,
          {dbl('100 * CAST(err AS DOUBLE) / nullif(req, 0)')} AS api_error_pct FROM a, b, c, d""",
    "tool_insights": f"""{E}, {_TOOLS_LIST}
        SELECT {big('coalesce(sum(uses), 0)')} AS calls, count(*) AS distinct_tools,
          {big('coalesce(sum(reject + block), 0)')} AS rejected_or_blocked,
          {opt('100 * sum(uses * success_rate) / nullif(sum(uses), 0)')} AS success_pct,
          {opt("100 * CAST(coalesce(sum(uses) FILTER (mcp_server <> ''), 0) AS DOUBLE) / nullif(sum(uses), 0)")}
            AS mcp_share_pct FROM tl""",
    "tool_weighted_success": f"""{E}SELECT count(*) AS uses,
        {dbl("CAST(count(*) FILTER (success = 'true') AS DOUBLE) / nullif(count(*), 0)")} AS success_rate
        FROM e WHERE {_BY_TOOL}""",
    "plugin_share": f"""{E}, p AS ({_PLUGINS}) SELECT count(*) AS plugins,
        {opt('100 * CAST(count(*) FILTER (has_hooks) AS DOUBLE) / nullif(count(*), 0)')} AS with_hooks_pct,
        {opt('100 * CAST(count(*) FILTER (has_mcp) AS DOUBLE) / nullif(count(*), 0)')} AS with_mcp_pct FROM p""",
    "hook_insights": f"""{E}, h AS (SELECT hook_event, count(*) AS n, sum(num_hooks) AS hooks, sum(num_success) AS ok,
          sum(num_blocking) AS blocked, CAST(coalesce(avg(total_duration_ms), 0) AS DOUBLE) AS ms
        FROM e WHERE event_type = 'hook' GROUP BY 1)
        SELECT {big('coalesce(sum(n), 0)')} AS executions,
          {opt('100 * CAST(sum(ok) AS DOUBLE) / nullif(sum(hooks), 0)')} AS success_pct, {dbl('sum(blocked)')} AS blocked,
          {dbl('sum(ms * n) / nullif(sum(n), 0)')} AS avg_ms FROM h""",
    "top_mode": f"""{E}, t AS (SELECT coalesce(to_mode, '(none)') AS mode, count(*) AS n FROM e WHERE {_SWITCH} GROUP BY 1)
        SELECT {big('coalesce(sum(n), 0)')} AS switches, (SELECT mode FROM t ORDER BY n DESC, mode LIMIT 1) AS top_mode,
          count(*) AS distinct_modes FROM t""",
    "cost_pivot_top4": f"""{M}, {_TREND} SELECT day,
          {", ".join(f"{dbl(f'sum(cost) FILTER (r = {i})')} AS rank_{i}" for i in (1, 2, 3, 4))},
          {dbl('sum(cost) FILTER (r = 0)')} AS other FROM placed GROUP BY day""",
    "cost_top_models": f"""{M}, {_TREND} SELECT d.day, s.series, {dbl('sum(cost)')} AS cost
        FROM (SELECT DISTINCT day FROM placed) d JOIN (SELECT DISTINCT series FROM placed) s ON true
        LEFT JOIN placed p ON p.day = d.day AND p.series = s.series GROUP BY d.day, s.series""",
    "hour_fill": f"""{E}SELECT CAST(h AS BIGINT) AS hour, coalesce(n, 0) AS requests, {dbl('c')} AS cost
        FROM (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n, sum(cost_usd) AS c FROM e
              WHERE event_type = 'api_request' GROUP BY 1) USING (h)""",
    "detail_totals": f"""{_BOTH},
        members AS (SELECT user_hash, sum(value) FILTER ({TOKENS}) AS tokens, count(DISTINCT session_id) AS sessions
          FROM mt WHERE {_IN_TEAM} GROUP BY 1)
        SELECT 'person' AS page, {dbl(f'(SELECT sum(value) FROM m WHERE {COST} AND {_BY_USER})')} AS cost,
          {dbl(f'(SELECT sum(value) FROM m WHERE {TOKENS} AND {_BY_USER})')} AS tokens,
          {dbl(f'(SELECT count(*) FROM e WHERE {_RESULT} AND {_BY_USER})')} AS uses
        UNION ALL SELECT 'model', {dbl(f"(SELECT sum(value) FROM m WHERE {_BY_MODEL})")},
          {dbl(f"(SELECT sum(value) FROM m WHERE {TOKENS} AND model = '{MODEL}')")}, 0
        UNION ALL SELECT 'team', {dbl(f'(SELECT sum(value) FROM mt WHERE {COST} AND {_IN_TEAM})')},
          {dbl('(SELECT sum(tokens) FROM members)')}, {dbl('(SELECT sum(sessions) FROM members)')}
        UNION ALL SELECT 'agent', 0, {dbl(f'(SELECT sum(total_tokens) FROM e WHERE {_BY_AGENT})')},
          {dbl(f'(SELECT count(*) FROM e WHERE {_BY_AGENT})')}""",
    "reliability_rate": f"""{E}, t AS ({_TOTALS}) SELECT api_requests, api_errors, refusals,
        {opt('100 * CAST(api_errors AS DOUBLE) / nullif(api_requests, 0)')} AS error_pct FROM t""",
}

