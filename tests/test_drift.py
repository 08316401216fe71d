"""Problem 1: changes between files, dirty lines, and a table that loses nothing."""

import json
from datetime import datetime, timedelta

from sealwork.operators import drift

SCHEMA = "stream string, file_id string, written_at timestamp, line_no int, payload string, seq string"


def table(spark, files):
    day = datetime(2024, 1, 1)
    rows = [("s", f, day + timedelta(days=i), n, p, "x") for i, (f, lines) in enumerate(files) for n, p in enumerate(lines)]
    return spark.createDataFrame([*rows, *rows[:2], (None, "f", day, 0, "{}", "x")], SCHEMA)


def run(spark, files):
    raw = table(spark, files)
    profiles = drift.file_profiles(raw).cache()
    return raw, profiles, drift.schema_changes(profiles)


def lines(**fields):
    return [json.dumps({k: v(i) if callable(v) else v for k, v in fields.items()}) for i in range(20)]


FILES = [
    ("a", lines(run_id=lambda i: f"r{i}", size=lambda i: i, note=lambda i: f"word {i}.{i}", gone=True)),
    ("b", lines(run_id=lambda i: f"r{i}", size=lambda i: i + 0.5, remark=lambda i: f"word {i}.{i}", extra={"k": "v"})),
    ("c", lines(run_id=lambda i: f"r{i}", size=lambda i: i + 0.5, remark=lambda i: f"word {i}.{i}", extra={"k": "v"})),
    ("d", lines(run_id=lambda i: f"r{i}", size=lambda i: str(i), text=lambda i: f"word {i}.{i}", extra={"k": "v"})),
]


def test_changes_steps_and_versions(spark):
    _, profiles, changes = run(spark, FILES)
    got = {(x.file_id, x.change, x.field, x.detail) for x in changes.collect()}
    assert got == {("b", "retyped", "size", "fractional"), ("b", "renamed", "note", "remark"), ("b", "removed", "gone", ""), ("b", "added", "extra.k", ""), ("d", "retyped", "size", "string"), ("d", "renamed", "remark", "text")}
    steps = {(x.file_id, x.step, x.field, x.target, x.type) for x in drift.migration_steps(changes).collect()}
    assert ("d", "rename", "remark", "text", None) in steps and ("b", "default", "gone", "gone", None) in steps and ("d", "cast", "size", "size", "string") in steps
    assert [(x.version, x.n_files) for x in drift.schema_versions(profiles).orderBy("version").collect()] == [(1, 1), (2, 2), (3, 1)]


def test_one_table_keeps_every_value(spark):
    raw, profiles, changes = run(spark, FILES)
    rows = drift.consistent_table(raw, profiles, changes).collect()
    assert len(rows) == 80 and all(r.readable and r.run_id for r in rows)
    for r in rows:
        u = json.loads(r.unknown)
        assert u["text"].startswith("word ") and not {"note", "remark"} & u.keys() and isinstance(u["size"], str)
        assert r.casts == (["size"] if r.file_id != "d" else []) and r.clashes == []
    assert {json.loads(r.unknown)["size"] for r in rows if r.file_id == "b"} == {str(i + 0.5) for i in range(20)}


def test_dirty_lines(spark):
    bad = ['{"n": 1e999, "m": 9007199254740993}', '{"\\ud800": "\\ud800", "n": 2}', "no json", "", None, "[1]", '{"n": [1, 2], "m": 1.5}', "[" * 100_000]
    raw, profiles, changes = run(spark, [("a", bad), ("b", ['{"n": 1, "old": "q", "new": "z"}']), ("c", [])])
    assert changes.count() > 0
    rows = {r.line_no: r for r in drift.consistent_table(raw, profiles, changes).where("file_id = 'a'").collect()}
    assert [rows[i].readable for i in range(8)] == [True, True, False, False, False, False, True, False]
    assert json.loads(rows[0].unknown)["m"] == 9007199254740993 and json.loads(rows[0].unknown)["n"] == [float("inf")] and json.loads(rows[6].unknown)["n"] == [1, 2]
    assert drift.file_profiles(raw.limit(0)).count() == 0


def test_long_values_differ_beyond_any_prefix():
    a, b = ("abc 12 " * 50, "abc 12 " * 50 + "{;}")
    assert drift.kind_tokens(a) != drift.kind_tokens(b)
    assert drift.kind_tokens({f"k{i}": 1 for i in range(200)}) != drift.kind_tokens({f"k{i}": 1 for i in range(201)})
