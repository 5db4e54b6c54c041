"""Attribute values of any depth against a plain recursion."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from usagelake.schemas import ATTRIBUTES
from usagelake.sources.otlp import flatten_anyvalue


def _text(value):
    for kind in ("stringValue", "boolValue", "intValue"):
        if kind in value:
            return value[kind] if isinstance(value[kind], str) else json.dumps(value[kind])
    for kind in ("arrayValue", "kvlistValue"):
        values = value.get(kind, {}).get("values")
        if values is not None and kind == "arrayValue":
            return json.dumps([_text(v) for v in values], separators=(",", ":"), ensure_ascii=False)
        if values is not None:
            texts = {e["key"]: _text(e["value"]) for e in values if e.get("key") and e.get("value")}
            return json.dumps({k: t for k, t in texts.items() if t is not None}, separators=(",", ":"), ensure_ascii=False)
    return None


def _deep(depth: int, rng: random.Random):
    if depth == 0:
        return {"stringValue": rng.choice(["x", "", 'a "q" \\ [b] {c}', "é\n[", "]", "\\", '\\"'])}
    inner = [_deep(depth - 1, rng), {"intValue": rng.randint(0, 9)}, {"boolValue": True}, {}][: rng.randint(1, 4)]
    if rng.random() < 0.5:
        return {"arrayValue": {"more": {"k": [1, [2]]}, "values": inner}}
    return {"kvlistValue": {"values": [{"key": f"k[{i}", "value": v} for i, v in enumerate(inner)] + [{"key": "", "value": {"stringValue": "z"}}]}}


def _single(depth: int):
    value = {"stringValue": "end"}
    for k in range(depth):
        value = {"arrayValue": {"values": [value]}} if k % 2 else {"kvlistValue": {"values": [{"key": "k", "value": value}]}}
    return value


def test_values_of_any_depth(spark):
    rng = random.Random(5)
    values = [_deep(d, rng) for d in (1, 2, 3, 3, 4, 5, 6, 6) for _ in range(4)] + [_single(d) for d in (0, 3, 6, 20)]
    values += [{"arrayValue": {"values": []}}, {"kvlistValue": {"values": []}}, {"arrayValue": {}}, {}]
    wide = {"arrayValue": {"values": [{"arrayValue": {"values": [{"stringValue": f"{i}"}]}} for i in range(3000)]}}
    values.append(wide)
    rows = [(i, json.dumps([{"key": "a", "value": v}], indent=i % 3 or None)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, body string").repartition(3)
    got = {r.i: r.t for r in df.select("i", flatten_anyvalue(F.from_json("body", ATTRIBUTES))["a"].alias("t")).collect()}
    assert len(got[len(values) - 6]) > 1 << 19  # quotes are escaped twenty times
    for i, v in enumerate(values):
        assert got[i] == _text(v), v
