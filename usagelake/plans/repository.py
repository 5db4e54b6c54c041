"""The query surface: one method per report, each a plain set of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame

from usagelake import fixed_values as fx
from usagelake.operators.dimensions import directory_resolve, membership_list, named_people
from usagelake.operators.relational import scope
from usagelake.plans import capabilities, derived, health, overview, people, teams, tools


@dataclass(frozen=True)
class DateRange:
    """An organization and an inclusive day range; the default is the last 30 days."""

    org: str
    first_day: str = ""
    last_day: str = ""

    def __post_init__(self):
        if not self.org:
            raise ValueError("a report needs an organization")
        today = date.today()
        object.__setattr__(self, "last_day", self.last_day or today.isoformat())
        first = today - timedelta(days=fx.DEFAULT_RANGE_DAYS)
        object.__setattr__(self, "first_day", self.first_day or first.isoformat())

    def prior(self) -> DateRange:
        return DateRange(self.org, *derived.prior_range(self.first_day, self.last_day))


class Analytics:
    """Reports over silver metrics and events plus the two dimensions.

    ``membership`` and ``directory`` have one row per account, as ``dimensions.current`` reads them; a history goes
    through ``replace_dimension`` first. No report ranks versions.
    ``metrics`` and ``events`` hold latest versions only; the bronze frames are
    needed for ``orgs`` alone, which counts every delivery.
    """

    def __init__(
        self,
        metrics: DataFrame,
        events: DataFrame,
        membership: DataFrame | None = None,
        directory: DataFrame | None = None,
        metrics_bronze: DataFrame | None = None,
        events_bronze: DataFrame | None = None,
    ):
        self._metrics, self._events = metrics, events
        self._membership, self._directory = membership, directory
        self._metrics_bronze = metrics if metrics_bronze is None else metrics_bronze
        self._events_bronze = events if events_bronze is None else events_bronze

    def metrics(self, r: DateRange) -> DataFrame:
        return scope(self._metrics, r.org, r.first_day, r.last_day)

    def events(self, r: DateRange) -> DataFrame:
        return scope(self._events, r.org, r.first_day, r.last_day)

    def membership(self, org: str) -> DataFrame:
        if self._membership is None:
            raise ValueError("no team membership table given")
        return membership_list(self._membership, org, latest=True)

    def orgs(self):
        return overview.orgs(self._metrics_bronze, self._events_bronze)

    def summary(self, r: DateRange):
        return overview.summary(self.metrics(r), self.events(r))

    def metric_breakdowns(self, r: DateRange):
        return overview.metric_breakdowns(self.metrics(r))

    def event_breakdowns(self, r: DateRange):
        return overview.event_breakdowns(self.events(r))

    def people(self, r: DateRange):
        return people.people(self.metrics(r), self.events(r))

    def person_detail(self, r: DateRange, user: str):
        return people.person_detail(self.metrics(r), self.events(r), user)

    def model_detail(self, r: DateRange, model: str):
        return people.model_detail(self.metrics(r), model)

    def tools_list(self, r: DateRange):
        return tools.tools_list(self.events(r))

    def tool_detail(self, r: DateRange, tool: str):
        return tools.tool_detail(self.events(r), tool)

    def agents_list(self, r: DateRange):
        return tools.agents_list(self.events(r))

    def agents_by_name(self, r: DateRange):
        return tools.agents_by_name(self.metrics(r), self.events(r))

    def agent_detail(self, r: DateRange, agent: str):
        return tools.agent_detail(self.events(r), agent)

    def cost_timeseries(self, r: DateRange):
        return people.cost_timeseries(self.metrics(r))

    def teams(self, r: DateRange):
        return teams.teams(self.metrics(r), self.events(r), self.membership(r.org))

    def team_detail(self, r: DateRange, team: str):
        return teams.team_detail(self.metrics(r), self.events(r), self.membership(r.org), team)

    def capabilities(self, r: DateRange):
        return capabilities.capabilities(self.metrics(r), self.events(r))

    def plugin_detail(self, r: DateRange, name: str):
        return capabilities.plugin_detail(self.events(r), name)

    def reliability(self, r: DateRange):
        return health.reliability(self.events(r))

    def environment(self, r: DateRange):
        return health.environment(self.metrics(r))

    def efficiency(self, r: DateRange):
        return health.efficiency(self.events(r))

    def governance(self, r: DateRange):
        return health.governance(self.events(r))

    def engagement(self, r: DateRange):
        return health.engagement(self.events(r))

    def overview_kpis(self, r: DateRange):
        return derived.overview_kpis(self.metrics(r), self.events(r))

    def period_delta(self, r: DateRange):
        return derived.period_delta(self.metrics(r), self.metrics(r.prior()))

    def identities(self, org: str, hashes):
        if self._directory is None:
            raise ValueError("no person directory given")
        return directory_resolve(named_people(self._directory), org, hashes)
