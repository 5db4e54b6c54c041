"""Redaction of events: scrub every free text, then drop or encrypt staged content."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake import fixed_values as fx
from usagelake.functions import redaction as scan
from usagelake.functions.crypto import derive_key, encrypt_content, key_id

_BROADCAST_ORGS = 50_000  # about 5 MB of keys; larger policies are left to the optimizer
_BROADCAST_BYTES = 8 << 20  # of policies; larger ones too


@dataclass(frozen=True)
class OrgPolicies:
    """Configuration: organizations that opted into content capture, and literal deny terms."""

    capture_orgs: tuple[str, ...] = ()
    deny_list: tuple[str, ...] = ()
    deny_by_org: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def from_text(cls, capture: str = "", deny: str = "") -> OrgPolicies:
        """From comma-separated settings; blanks are trimmed and empty parts skipped."""

        def parts(value: str) -> tuple[str, ...]:
            return tuple(p for p in (x.strip() for x in value.split(",")) if p)

        return cls(capture_orgs=parts(capture), deny_list=parts(deny))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The policies as data: org_id, captures, patterns of the organization's own deny terms, and whether one of
        them is the replacement itself."""
        captures = set(self.capture_orgs)
        rows = [
            (org, org in captures, [scan.deny_pattern(t) for t in terms if t], any(t.lower() == fx.DENY_TEXT.lower() for t in terms))
            for org in sorted(captures | set(self.deny_by_org))
            for terms in (self.deny_by_org.get(org, ()),)
        ]
        frame = spark.createDataFrame(rows, "org_id STRING, captures BOOLEAN, patterns ARRAY<STRING>, marks BOOLEAN")
        size = sum(64 + len(org) + sum(map(len, patterns)) for org, _, patterns, _ in rows)
        return F.broadcast(frame) if size <= _BROADCAST_BYTES else frame

    def attach(self, events: DataFrame) -> DataFrame:
        """Add ``_policy``: captures, patterns and marks of the event's organization. The plan does not grow with the
        number of organizations."""
        if not self.capture_orgs and not self.deny_by_org:
            none = F.struct(F.lit(False).alias("captures"), _no_flags().alias("patterns"), F.lit(False).alias("marks"))
            return events.withColumn("_policy", none)
        given = self.frame(events.sparkSession).select(F.col("org_id").alias("_org"), F.struct("captures", "patterns", "marks").alias("_given"))
        joined = events.join(given, events.org_id == F.col("_org"), "left")
        policy = F.struct(
            F.coalesce("_given.captures", F.lit(False)).alias("captures"),
            F.coalesce("_given.patterns", _no_flags()).alias("patterns"),
            F.coalesce("_given.marks", F.lit(False)).alias("marks"),
        )
        return joined.withColumn("_policy", policy).drop("_org", "_given")

    def key_frame(self, spark: SparkSession, master: bytes, info: str) -> DataFrame:
        """org_id, key, key id of the capturing organizations; keys travel as data, not as plan literals."""
        rows = [(o, bytearray(derive_key(master, o, info)), key_id(o)) for o in sorted(set(self.capture_orgs))]
        frame = spark.createDataFrame(rows, "org_id STRING, _key BINARY, _key_id STRING")
        return F.broadcast(frame) if len(rows) <= _BROADCAST_ORGS else frame

    def deny_text(self, text: Column) -> Column:
        """The shared terms, then the organization's own ones in their order; ``_policy`` must be attached."""
        return F.aggregate(
            F.col("_policy.patterns"),
            scan.scan_deny_list(text, self.deny_list),
            lambda scrubbed, pattern: F.regexp_replace(scrubbed, pattern, F.lit(scan.DENY_REPLACEMENT)),
        )

    def is_clean(self, texts: Column) -> Column:
        """True where no scanner can change any of the texts that ``texts`` holds; ``_policy`` must be attached."""
        if any(self.deny_list):
            return F.lit(False)
        return (F.size("_policy.patterns") == 0) & ~scan.may_find(texts)

    def deny_hit(self, before: Column, after: Column) -> Column:
        return scan.deny_list_hit(before, after, self.deny_list) | (F.col("_policy.marks") & after.contains(fx.DENY_TEXT))


_ENTRY = ("staged", "key")
_ENTRIES = "array<struct<staged: boolean, key: string, text: string>>"


def _step(entries: Column, build) -> Column:
    """Rewrite every entry; the fields named in _ENTRY are carried, ``build`` gives the others."""
    return F.transform(entries, lambda e: F.struct(*[e[n].alias(n) for n in _ENTRY], *build(e)))


def redact_fields(events: DataFrame, policies: OrgPolicies) -> DataFrame:
    """Run every scanner over all dims and staged texts.

    Replaces ``dims`` and ``staged_content`` and adds ``redaction_flags``: the
    distinct flags in the order the scanners raise them. Each regular expression
    runs once per text.
    """

    def tagged(map_name: str, staged: bool) -> Column:
        return F.transform(
            F.map_entries(map_name),
            lambda e: F.struct(F.lit(staged).alias("staged"), e["key"].alias("key"), e["value"].alias("text")),
        )

    # The scanners are interpreted text by text, so only events run them in whose texts one could find something.
    attached = policies.attach(events).withColumn("_found", ~F.coalesce(policies.is_clean(_all_texts()), F.lit(False)))
    frame = attached.withColumns(
        {
            "_staged": F.size("staged_content") > 0,
            "_e": F.when(F.col("_found"), F.concat(tagged("dims", False), tagged("staged_content", True))).otherwise(
                F.array().cast(_ENTRIES)
            ),
        }
    )

    def changed(before: Column, after: Column) -> Column:
        return before != after

    scanners = (
        (fx.FLAG_SECRET, scan.scan_secrets, changed),
        (fx.FLAG_EMAIL, scan.scan_email, changed),
        (fx.FLAG_IP, scan.scan_ip, changed),
        (fx.FLAG_PATH, scan.scan_paths, changed),
        (
            fx.FLAG_DENY,
            policies.deny_text,
            policies.deny_hit,
        ),
    )
    carried: list[str] = []
    for flag, scanner, fired in scanners:
        known = tuple(carried)
        # Two steps, so that the scanner runs once although its result is used twice.
        scanned = _step(
            F.col("_e"),
            lambda e, s=scanner, k=known: (
                *[e[n].alias(n) for n in k], e["text"].alias("was"), s(e["text"]).alias("text"),
            ),
        )
        flagged = _step(
            F.col("_e"),
            lambda e, f=fired, n=flag, k=known: (
                *[e[x].alias(x) for x in k], f(e["was"], e["text"]).alias(n), e["text"].alias("text"),
            ),
        )
        frame = frame.withColumn("_e", scanned).withColumn("_e", flagged)
        carried.append(flag)
    entries = F.col("_e")

    def raised(flag: str) -> Column:
        return F.when(F.exists(entries, lambda e: e[flag]), F.array(F.lit(flag))).otherwise(_no_flags())

    # E-mail and address are one stage: their order follows the fields.
    pii = F.flatten(
        F.transform(
            entries,
            lambda e: F.array_compact(
                F.array(
                    F.when(e[fx.FLAG_EMAIL], F.lit(fx.FLAG_EMAIL)), F.when(e[fx.FLAG_IP], F.lit(fx.FLAG_IP))
                )
            ),
        )
    )
    flags = F.array_distinct(F.concat(raised(fx.FLAG_SECRET), pii, raised(fx.FLAG_PATH), raised(fx.FLAG_DENY)))

    def rebuilt(map_name: str, staged: bool) -> Column:
        chosen = F.filter(entries, lambda e: e["staged"] == F.lit(staged))
        scrubbed = F.map_from_entries(F.transform(chosen, lambda e: F.struct(e["key"], e["text"])))
        return F.when(F.col("_found"), scrubbed).otherwise(F.col(map_name))

    return frame.withColumns(
        {
            "redaction_flags": F.when(F.col("_found"), flags).otherwise(_no_flags()),
            "dims": rebuilt("dims", False),
            "staged_content": rebuilt("staged_content", True),
        }
    ).drop("_e", "_policy", "_found")


def _all_texts() -> Column:
    """All texts of an event as one, NULL if it lacks a map."""
    return F.concat(
        F.array_join(F.map_values("dims"), "\n"), F.lit("\n"), F.array_join(F.map_values("staged_content"), "\n")
    )


def _no_flags() -> Column:
    return F.array().cast("array<string>")


def field_policy(
    events: DataFrame, policies: OrgPolicies, master_key: bytes | None = None, key_info: str = "content"
) -> DataFrame:
    """Encrypt staged content of opted-in organizations, drop all other; ``staged_content`` is always removed."""
    # Known before the scanners run, so a filter on the outcome does not repeat them.
    staged = F.col("_staged") if "_staged" in events.columns else F.size("staged_content") > 0
    empty = F.create_map().cast("map<string,string>")
    if policies.capture_orgs:
        if master_key is None:
            raise ValueError("content capture needs a master key")
        keys = policies.key_frame(events.sparkSession, master_key, key_info)
        events = events.join(keys, "org_id", "left")
        captured = staged & F.col("_key").isNotNull()
        fields = F.when(
            captured, F.transform_values("staged_content", lambda _, v: encrypt_content(v, F.col("_key")))
        ).otherwise(empty)
        key_name = F.when(captured, F.col("_key_id")).otherwise("")
    else:
        captured, fields, key_name = F.lit(False), empty, F.lit("")
    outcome = (
        F.when(captured, F.array(F.lit(fx.FLAG_ENCRYPTED)))
        .when(staged, F.array(F.lit(fx.FLAG_DROPPED)))
        .otherwise(_no_flags())
    )
    return events.withColumns(
        {
            "redaction_flags": F.array_distinct(F.concat("redaction_flags", outcome)),
            "content_class": F.when(captured, fx.CONTENT_CLASS).otherwise(""),
            "content_keyid": key_name,
            "content_fields": fields,
        }
    ).drop("staged_content", "_staged", "_key", "_key_id")


def redact_events(
    events: DataFrame, policies: OrgPolicies, master_key: bytes | None = None, key_info: str = "content"
) -> DataFrame:
    """Secrets, personal data, home paths, deny terms, then the field policy."""
    return field_policy(redact_fields(events, policies), policies, master_key, key_info)


def field_policy_frame(spark: SparkSession) -> DataFrame:
    """The default field policy as a table: field, class, action, critical."""
    rows = [(f, c, a, f in fx.CRITICAL_FIELDS) for f, c, a in fx.FIELD_POLICIES]
    return spark.createDataFrame(rows, "field STRING, class STRING, action STRING, critical BOOLEAN")
