"""Problem 6 against plain code, whole child tables, and edges."""

import json
import random

from sealwork.operators import flatten
from tests import brute

RECORD = "struct<kind:string,id:string,record_digest:string,record_location:string,body_location:string,binding:struct<scheme:string,digest:string>>"
OBJECT = "struct<ref:string,digest:string,size:bigint,role:string,media_type:string,license:string>"


def contents():
    r = random.Random(6)
    check = lambda: r.choice([{"name": "n", "value": 1.5, "detail": {"a": [1]}}, {"value": None}, None, {"name": "", "more": True}])
    span = lambda: r.choice([{"source_id": "s", "checks": [check(), check()]}, {"checks": check()}, None, {"source_id": None, "checks": None, "note": "x"}, {"checks": []}])
    out = []
    for i in range(120):
        v = {"evidence_spans": r.choice([[span() for _ in range(r.randrange(4))], span(), None]), "scope": r.choice([None, {}, {"basin_refs": r.choice(["b", {"id": "q", "label": "l"}, ["a", {"id": "c"}, None, {"label": "no id"}], None, []])}])}
        text = json.dumps(v)
        out.append((f"d{i}", json.dumps(text) if i % 5 == 0 else text))
    return out + [("e1", None), ("e2", ""), ("e3", "{"), ("e4", "[1]"), ("e5", "null"), ("e6", "3"), ("d0", None)]


def claims(spark, rows):
    return spark.createDataFrame([(d, t, 1) for d, t in rows] + [(None, rows[0][1], 1)] if rows else [], "record_digest string, content string, child_path int")


def test_claim_children_against_plain_code(spark):
    rows = contents()[:-1]
    got = [tuple(x)[1:] for x in flatten.claim_children(claims(spark, rows + rows[:9])).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.claim_children(rows)
    assert flatten.claim_children(claims(spark, [])).count() == 0


def test_bundle_children_against_plain_code(spark):
    o, r = [("a", "d", 1, "x", None, None), None, (None, "d", 2, "y", "m", "l")], [None, ("run", "r1", "d", "l", "b", ("s", "h")), ("run", None, None, None, None, None)]
    rows = [("1", o, r), ("2", None, []), ("3", [], None), ("1", o, r), (None, o, r)]
    df = spark.createDataFrame([(*x, 7) for x in rows], f"record_digest string, objects array<{OBJECT}>, records array<{RECORD}>, ref int")
    got = [tuple(x)[1:] for x in flatten.bundle_children(df).collect()]
    want = brute.bundle_children([(d, [x and {"ref": x[0]} for x in a] if a else a, [x and {"id": x[1]} for x in b] if b else b) for d, a, b in rows if d])
    assert len(got) == len(set(got)) and set(got) == want
    tables = flatten.bundle_tables(df)
    assert {tuple(x) for x in tables["objects"].collect()} == {("1", 0, *o[0]), ("1", 2, *o[2])}
    assert {tuple(x) for x in tables["records"].collect()} == {("1", 1, "run", "r1", "d", "l", "b", "s", "h"), ("1", 2, "run", None, None, None, None, None, None)}
    assert flatten.bundle_tables(df.limit(0))["objects"].count() == 0


def test_claim_tables_keep_every_member(spark):
    v = {"evidence_spans": [None, {"source_id": "s", "metric_ref": "m", "note": {"k": 1}, "checks": [{"name": "n", "value": 2, "detail": {"a": 1}, "more": "x"}, None, {}]}], "scope": {"basin_refs": ["b", {"id": "i", "label": "l", "z": 1}]}}
    t = flatten.claim_tables(claims(spark, [("d", json.dumps(v))]))
    assert [tuple(x) for x in t["spans"].collect()] == [("d", 1, "s", None, "m", '{"note":"{\\"k\\":1}"}')]
    assert sorted(tuple(x) for x in t["checks"].collect()) == [("d", 1, 0, "n", 2.0, '{"a":1}', '{"more":"x"}'), ("d", 1, 2, None, None, None, None)]
    assert sorted(tuple(x) for x in t["basins"].collect()) == [("d", 0, "b", None, None), ("d", 1, "i", "l", '{"z":"1"}')]
