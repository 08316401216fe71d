"""Evidence operators: golden vectors, queries against SQL, edges, and one broken record or graph for each rule."""

import json
import math
import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sealwork.functions import canon, geometry, text
from sealwork.operators import graph, resampling, seals, store, verify
from sealwork.plans import registry
from sealwork.sources import files

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- queries against SQL


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "grouped_ratio_ci" in entry.queries()


# ---------------------------------------------------------------- canonical text

VECTORS = [
    ('{"null":null,"t":true,"f":false,"i":-42,"s":"héllo"}', '{"f":false,"i":-42,"null":null,"s":"héllo","t":true}', "554a04997b20c8fc914aedecb22f8ca08d21479899102892aeac1e36731537f9"),
    ("[0,1.0,-0.0,4.5,0.1,1e21,1e-7,1e20,9007199254740992]", "[0,1,0,4.5,0.1,1e+21,1e-7,100000000000000000000,9007199254740992]", "ccd462311f95af7fd3a2e5336276f7dff4e276b1cb9a27f8888bc1eb84507559"),
    ('{"n":9007199254740993}', '{"n":{"$int":"9007199254740993"}}', "2f5155b6c30350123cd2a80d086e6d01b02fc59309618005ac65289e0d76db16"),
    ('{"b":[3,{"z":1,"a":2}],"a":{"y":[],"x":{}}}', '{"a":{"x":{},"y":[]},"b":[3,{"a":2,"z":1}]}', "cc56ba2dccec941c2696f0d74dd52fe029207df36f1a1488c4f4bbfdb2c6f4e7"),
    ('{"\\ud83d\\ude00":1,"\\ue000":2,"a":3}', '{"a":3,"\U0001f600":1,"\ue000":2}', "a901d5c9340048b768183fd6fb82e7d0f7792049a0aafa9d2c7ccd845d984ad3"),
    ('{"$float":"nan"}', '{"$map":{"$float":"nan"}}', "f1d857848ed494a9c4c7a6806c1de44cfa76d3855ff09a4ac9b40af2c19f2d18"),
]


def test_canonical_vectors(spark):
    df = spark.createDataFrame([(v[0],) for v in VECTORS] + [(None,), ("{",), ('"\\ud800"',)], "j string")
    rows = df.select("j", canon.canonical_json("j").alias("c"), canon.digest_text(canon.canonical_json("j")["text"]).alias("d")).collect()
    for (_, want, digest), r in zip(VECTORS, rows):
        assert r["c"]["text"] == want and r["d"] == f"sha256:{digest}"
    assert rows[-3]["c"] == (None, None) and rows[-3]["d"] is None and rows[-2]["c"]["error"] and rows[-1]["c"]["error"]


def test_values_beyond_json():
    assert canon.canonical_text({"d": Decimal("1.50"), "b": b"\x00", "s": {2, 1, 10}, "x": float("nan")}) == '{"b":{"$bytes":"AA=="},"d":{"$decimal":"1.50"},"s":{"$set":[1,10,2]},"x":{"$float":"nan"}}'
    for bad in ({True: 1}, {1: 1, "1": 2}, object(), "\ud800"):
        with pytest.raises(canon.UnencodableError):
            canon.canonical_text(bad)
    numbers = {0.0: "0", -0.0: "0", 100.0: "100", -4.5: "-4.5", 0.1 + 0.2: "0.30000000000000004", 1e20: "100000000000000000000", 1e21: "1e+21", 1e-6: "0.000001", 1e-7: "1e-7", 1.23e-18: "1.23e-18", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 333333333.3333333: "333333333.3333333", 123456789012345680000.0: "123456789012345680000"}
    assert all(canon.number_text(v) == t for v, t in numbers.items())


def test_row_text_equals_the_general_way(spark):
    rows = [('q"\\\n\t\x07\x1f~é\u2028', 1, 2**53 + 1, True), (None, None, None, None), ("", -3, -5, False)]
    df = spark.createDataFrame(rows, "`z` string, `a` int, `\ue000` bigint, `b` boolean")
    got = [r[0] for r in df.select(canon.row_text(df.schema, df.columns)).collect()]
    assert got == [canon.canonical_text(dict(zip(df.columns, r))) for r in rows]
    assert df.select(canon.row_text(df.schema, df.columns, drop_null=True)).collect()[1][0] == "{}"
    with pytest.raises(canon.UnencodableError):
        canon.row_text(spark.createDataFrame([(1.0,)], "x double").schema, ["x"])


BODIES = [
    ("{}", "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"), ('{"record":{"a":1}}', "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"),
    ('{"record":{"run_id":"x"},"evidence":{"v":1.0,"k":[1,2]},"tool_name":"t"}', "c8fc04a10aa1954764660515ac3191d2c82daf9619e39041d126517984531f42"),
    ('{"record":{},"evidence":{"record":{"kept":true}}}', "4d5820987f479ce18e8211b6ff80b9568c38d5b51b6ffc92424aac4438eb8c41"),
]


def test_body_binding(spark):
    df = spark.createDataFrame([(b, f"sha256:{h}") for b, h in BODIES] + [("{", "x"), (None, None)], "b string, h string")
    out = df.select((canon.entry_digest(F.col("b")) == F.col("h")).alias("same"), canon.verify_binding(F.col("b"), F.lit("e/1"), F.col("h"), "e/1").alias("ok")).collect()
    assert [r["same"] for r in out[:4]] == [True] * 4 and [r["ok"] for r in out] == [True] * 4 + [False] * 2


def test_digest_form(spark):
    good = "sha256:" + "a" * 64
    df = spark.createDataFrame([(good,), (good + "\n",), (good.upper(),), ("sha256:ab",), (None,)], "d string")
    assert [r[0] for r in df.select(canon.is_digest(F.col("d"))).collect()] == [True, False, False, False, False]


# ---------------------------------------------------------------- text


def test_pointers_and_locations(spark):
    df = spark.createDataFrame([(["a/b", "~1", ""],), ([],)], "t array<string>").withColumn("p", text.make_pointer(F.col("t")))
    assert [(r["p"], r["back"]) for r in df.withColumn("back", text.pointer_tokens(F.col("p"))).collect()] == [("/a~1b/~01/", ["a/b", "~1", ""]), ("", [])]
    bad = spark.createDataFrame([(x,) for x in ("no pointer", "a#b", "/abs#/x", "a/../b#/x", "a#/~2", None)], "l string").select(text.split_location(F.col("l")).alias("x"))
    assert all(r["x"] is None for r in bad.collect())
    assert one(spark, text.split_location(F.lit("a/b.json#/x~1y"))) == ("a/b.json", ["x/y"])
    doc = json.dumps({"a": [{"b": None}, 7], "": {"/": "é"}})
    get = lambda *t: one(spark, text.resolve_tokens(F.lit(doc), F.array(*map(F.lit, t))))
    assert (get("a", "1"), get("a", "0", "b"), get("", "/"), get("a", "01"), get("a", "2"), get("a", "x")) == ("7", "null", '"é"', None, None, None)


def test_names_times_and_paths(spark):
    assert one(spark, text.fragment_id(F.lit("a b*~"), F.lit("ü/"))) == "#a%20b%2A~-%C3%BC%2F"
    assert one(spark, text.percent_encoded(F.lit("a/b c"), keep_slash=True)) == "a/b%20c"
    assert one(spark, text.slug(F.lit("  Upper Rill -- 7 "))) == "upper-rill-7" and one(spark, text.slug(F.lit("??"))) is None
    assert one(spark, text.iso_ms(F.lit("2026-10-03T10:00:04.000999Z"))) == "2026-10-03T10:00:04.000+00:00" and one(spark, text.iso_ms(F.lit("yesterday"))) == "yesterday"
    assert one(spark, text.media_type(F.lit("x/A.GeoJSON"))) == "application/geo+json" and one(spark, text.media_type(F.lit("x"))) is None
    assert one(spark, text.license_name(F.lit("CC-BY-4.0"))) == "CC-BY-4.0" and one(spark, text.license_url(F.lit("https://x.org/l/"))) == "https://x.org/l/"
    cases = {"see /home/me/x": True, "file:///x": True, "C:\\x": True, "~mm/day": False, "https://a.org/home/": False, "in ~/notes": True, "$HOME": True, "//srv/share": True, "": False}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert df.where(text.has_local_path(F.col("t")) != F.col("want")).collect() == []
    assert one(spark, text.without_markers(F.lit("a <abs>/x  b not<abs>y"))) == "a b not<abs>y" and not one(spark, text.has_marker(F.lit("not<abs>")))


def test_open_members(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("x"), F.lit("2"))
    known, unknown = text.known_and_unknown(m, ["a", "b"])
    assert one(spark, known) == {"a": "1"} and one(spark, unknown) == {"x": "2"}
    assert one(spark, text.merged(known, F.create_map(F.lit("a"), F.lit("9"), F.lit("y"), F.lit("3")))) == {"a": "1", "y": "3"}
    assert one(spark, text.make_scope(F.array(F.lit("v")), F.lit(None).cast("array<string>"), F.array(F.lit("v")))) is None
    nan = F.lit(float("nan"))
    valid = lambda *v: one(spark, text.estimate_is_valid(*[x if not isinstance(x, (int, float, type(None))) else F.lit(x).cast("double") for x in v]))
    assert [valid(1, nan, nan, 1), valid(1, 0, 2, 1), valid(3, 0, 2, 1), valid(1, nan, 2, 1), valid(1, 0, 2, 0), valid(None, 0, 2, 1)] == [True, True, False, False, False, False]


# ---------------------------------------------------------------- places

POLYGONS = [
    ([[[4, 4], [0, 4], [0, 0], [4, 0], [4, 4]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]], "c018d778314b7f122bcb131510ef84a774fe2fd2ce8d7e8c757c28d570a2b847"),
    ([[[0, 0], [0, 0], [4, 0], [4, 4], [0, 4]]], "978c2aeb4c70529cedab0bd8bf168752f0e5dbfbe3509e245a9c96ad8ca271d4"),
]


def polygons(spark, rows):
    return spark.createDataFrame([([[[[float(x) for x in p] for p in r] for r in g] for g in geom],) for geom in rows], "g array<array<array<array<double>>>>")


def test_geometry_vectors_and_invariance(spark):
    multi = [[[[10, 10], [11, 10], [11, 11], [10, 11], [10, 10]]], [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]]]
    rows = [[g] for g, _ in POLYGONS] + [multi, multi[::-1]]
    turned = [[[r[k:-1] + r[:k] + [r[k]] for r in g] for g in multi] for k in (1, 2)]
    got = [r[0] for r in polygons(spark, [*rows, *turned]).select(geometry.geometry_id(F.col("g"))).collect()]
    want = [f"sha256:{h}" for _, h in POLYGONS] + ["sha256:068d6b519e34b19459321ba49ef968bed441db01388e1c6f98bc91c699ceae13"] * 4
    assert got == want
    assert one(spark, canon.digest_text(geometry.point_text(F.array(F.lit(-68.58), F.lit(47.23))))) == "sha256:d37672c22fb4f234d26933fd481a0240deaa892a7864f4e3b532ce88bc39a337"
    points = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((3.0, 4.0), (1.0, 2.0), (3.0, 4.0))])
    assert one(spark, canon.digest_text(geometry.multipoint_text(points))) == "sha256:4280c505d9bff75b34d4104f7f3d8b929992820a395edb0b89fd850c1c132a17"
    assert one(spark, canon.digest_text(geometry.gauge_text(F.lit("usgs"), F.lit("01013500")))) == "sha256:13f997e27ba4ff65dbd6e134cbe87882818ac1d0eb7a634625d7c90b8a27bb33"
    assert one(spark, geometry.basin_id(F.lit("network_element"), F.lit("merit-hydro"), F.lit("v07_b"), F.lit("71000001"))).endswith("19f5ff184950b3414f367a91681af436f9c7cefff287cf8a6d8761d620523e74")


def test_geometry_problems(spark):
    nan = float("nan")
    bad = [[[[[0, 0], [1, 1], [2, 2]]]], [[[[0, 0], [1, nan], [2, 0]]]], [[[[0, 0], [181, 0], [2, 2]]]], [[]], [[[[0, 0], [4, 0], [4, 4]]]]]
    out = [r[0] for r in polygons(spark, bad).select(geometry.geometry_problem(F.col("g"))).collect()]
    assert out == ["DEGENERATE_GEOMETRY", "INVALID_COORDINATE", "INVALID_COORDINATE", "INVALID_GEOMETRY", None]
    jump = polygons(spark, [[[[[179, 0], [-179, 0], [-179, 1]]]], [[[[1, 0], [2, 0], [2, 1]]]]]).select(geometry.crosses_antimeridian(F.col("g"))).collect()
    assert [r[0] for r in jump] == [True, False]
    assert [one(spark, geometry.quantise(F.lit(v))) for v in (0.0000005, 0.0000015, nan)] == [0, 2, None]


# ---------------------------------------------------------------- seals and chains


def digest(c):
    return "sha256:" + c * 64


def test_seals_follow_every_field(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, "x")], "k string, n int, extra string")
    sealed = seals.seal(df, ["k", "n", "extra"])
    assert all(r[0] for r in sealed.select(seals.verify_seal(sealed, ["k", "n", "extra"])).collect())
    for c, v in (("k", F.lit("z")), ("n", F.lit(9)), ("extra", F.lit("y")), ("record_digest", F.lit(digest("0")))):
        changed = sealed.withColumn(c, v)
        assert not any(r[0] for r in changed.select(seals.verify_seal(changed, ["k", "n", "extra"])).collect()), c
    record = {"run_id": "r", "v": 1.0}
    record["record_digest"] = canon.digest_of(canon.canonical_text(record))
    assert one(spark, seals.verify_json_seal(F.lit(json.dumps(record)))) and not one(spark, seals.verify_json_seal(F.lit(json.dumps(record | {"v": 2})))) and not one(spark, seals.verify_json_seal(F.lit("{")))


def test_chains_and_heads(spark):
    rows = [("good", 0, digest("a"), None, "p0", False), ("good", 1, digest("b"), digest("a"), "p1", True), ("gap", 0, digest("a"), None, "p0", None), ("gap", 2, digest("b"), digest("a"), None, False)]
    rows += [("link", 0, digest("a"), None, None, True), ("link", 1, digest("b"), digest("c"), None, True), ("form", 0, "x", None, "p", False), ("twice", 0, digest("a"), None, "p", False), ("twice", 0, digest("b"), None, "q", False)]
    df = spark.createDataFrame(rows, "c string, revision int, revision_digest string, supersedes string, p string, w boolean")
    got = {r["c"]: (r["problem"], r["at"]) for r in seals.chain_problems(df, ["c"]).collect()}
    assert got == {"good": (None, None), "gap": ("numbering", 1), "link": ("link", 1), "form": ("digest", 0), "twice": ("numbering", 1)}
    heads = {r["c"]: (r["head_revision"], r["head"], r["head_withheld"]) for r in seals.chain_heads(df, ["c"], "p", "w").collect()}
    assert heads == {"good": (0, "p0", True), "gap": (0, "p0", True), "form": (0, "p", False), "twice": (0, "q", False)}
    assert seals.chain_problems(df.limit(0), ["c"]).count() == 0


def test_head_differences(spark):
    heads = spark.createDataFrame([("a", 3, ("t <abs>/x", "ok"), True), ("b", 1, ("t", "ok"), False)], "c string, head_revision int, head struct<text:string,status:string>, head_withheld boolean")
    claims = spark.createDataFrame([("a", "t ~/y", "bad"), ("b", "t ~/y", "ok"), ("none", "t", "ok")], "c string, text string, status string")
    got = {r["c"]: (r["differing"], r["unverifiable"]) for r in seals.head_differences(claims, heads, ["c"], ("text", "status"), ("status",)).collect()}
    assert got == {"a": ([], ["text", "status"]), "b": (["text"], [])}


BUNDLE = "bundle_id string, record_digest string, objects array<struct<ref:string,digest:string,size:bigint,role:string>>, records array<struct<kind:string,id:string,record_digest:string,record_location:string,body_location:string,binding:struct<scheme:string,digest:string>>>, coverage struct<records_verified:bigint,records_total:bigint,unverifiable_ids:array<string>,withheld_ids:array<string>>, run_rows struct<run_log_rows:bigint,sealed:bigint,legacy_no_record:bigint,unbound:bigint,unsealable:bigint,withheld_for_privacy:bigint>, replay struct<status:string,manifest_status:string,checked_status:string>, gates array<struct<run_id:string,code:string,outcome:string>>"


def test_each_edit_of_a_bundle_trips_its_part(spark):
    good = {
        "bundle_id": "b", "objects": [("a.json", digest("a"), 1, "x")], "records": [("run", "r", digest("b"), "a.json#/r", None, None), ("claim_view", "c", None, None, "s.json#/c", None)],
        "coverage": (1, 2, ["r"], ["r"]), "run_rows": (3, 1, 1, 0, 0, 1), "replay": ("archive_integrity", "archive_integrity", None), "gates": [("r", "G", "error")],
    }
    edits = [
        ("objects", [("/a", digest("a"), 1, "x")], "objects", "ref"), ("objects", [("a", "x", 1, "x")], "objects", "digest"), ("objects", [("a", digest("a"), -1, "x")], "objects", "size"), ("objects", [("a", digest("a"), 1, "")], "objects", "role"),
        ("objects", [("a", digest("a"), 1, "x")] * 2, "objects", "duplicates"), ("objects", [None], "objects", "null entry"), ("records", [("odd", "r", digest("b"), "a#/r", None, None)], "records", "kind"), ("records", [("run", "r", None, "a#/r", None, None)], "records", "seal"),
        ("records", [("claim_view", "c", digest("a"), None, "s#/c", None)], "records", "seal"), ("records", [("claim_view", "c", None, None, None, None)], "records", "view"), ("records", [("run", "r", digest("b"), "a#r", None, None)], "records", "record_location"),
        ("records", [("run", "r", digest("b"), "a#/r", None, ("s", digest("c")))], "records", "binding"), ("coverage", (3, 2, [], None), "coverage", "verified"), ("coverage", (1, 2, ["b", "a"], None), "coverage", "unverifiable_ids"),
        ("coverage", (1, 2, ["a"], ["z"]), "coverage", "withheld_ids"), ("coverage", (0, 2, ["a"], None), "coverage", "unverified"), ("run_rows", (3, 1, 1, 0, 0, 0), "run_rows", "sum"), ("run_rows", (3, 1, None, 0, 0, 1), "run_rows", "counts"),
        ("replay", ("cross_check", "archive_integrity", None), "replay", "exceeds manifest"), ("replay", ("what", None, None), "replay", "status"), ("gates", [("r", "Z", "error")], "gates", "gates"),
    ]
    rows = [{**good, "record_digest": "0"}] + [{**good, c: v, "record_digest": str(i + 1)} for i, (c, v, _, _) in enumerate(edits)]
    names = [x.split(" ")[0] for x in ("bundle_id", "record_digest", "objects", "records", "coverage", "run_rows", "replay", "gates")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], BUNDLE)
    got = {(r["record_digest"], r["part"], r["problem"]) for r in seals.bundle_problems(df, ("G",)).collect()}
    assert got == {(str(i + 1), part, problem) for i, (_, _, part, problem) in enumerate(edits)}
    assert seals.bundle_problems(spark.createDataFrame([(None,) * 8], BUNDLE), ("G",)).count() == 0


def test_containment_and_sets(spark):
    p = spark.createDataFrame([("f", ["a", "b"]), ("f", ["ab"]), ("g", ["a", "b"]), ("f", [])], "file string, tokens array<string>")
    b = spark.createDataFrame([("f", ["a"])], "file string, tokens array<string>")
    assert [tuple(r) for r in seals.contained(p, b, ["file"]).collect()] == [("f", ["a", "b"])]
    x, y = spark.createDataFrame([("r", None), ("s", "1")], "a string, b string"), spark.createDataFrame([("r", None), ("t", "1")], "a string, b string")
    assert {tuple(r) for r in seals.set_difference(x, y).collect()} == {("s", "1", "declared"), ("t", "1", "derived")}


# ---------------------------------------------------------------- resampling


def test_ratio_is_exact_and_flags(spark):
    df = spark.createDataFrame([("s", g, float(g + k), 0.6 * (g + k)) for g in range(20) for k in range(g % 4 + 1)], "s string, g int, p double, q double")
    r = resampling.grouped_ratio_ci(df, ["s"], "g", {"m": ("q", "p")}, replicates=200).first()
    assert abs(r["ci_low"] - 0.6) < 1e-12 and abs(r["ci_high"] - 0.6) < 1e-12 and r["n_groups"] == 20 and r["low_n"] and not r["ci_degraded"]
    few = resampling.grouped_ratio_ci(df.where("g < 5"), ["s"], "g", {"m": ("q", "p")}, replicates=200).first()
    assert math.isnan(few["ci_low"]) and "at least 10" in few["ci_reason"]
    never = resampling.grouped_ratio_ci(df.withColumn("z", F.lit(0.0)), ["s"], "g", {"m": ("q", "z")}, replicates=100).first()
    assert math.isnan(never["value"]) and never["ci_reason"] == "point estimate is not finite" and never["ci_degraded"]
    assert resampling.grouped_ratio_ci(df.limit(0), ["s"], "g", {"m": ("q", "p")}).count() == 0
    with pytest.raises(Exception, match="group label"):
        resampling.grouped_ratio_ci(df.withColumn("g", F.lit(None).cast("int")), ["s"], "g", {"m": ("q", "p")}).collect()
    for bad in ({"replicates": 50}, {"ci": 1.0}, {"min_groups": 1}):
        with pytest.raises(ValueError):
            resampling.grouped_ratio_ci(df, ["s"], "g", {"m": ("q", "p")}, **bad)


def test_any_statistic_by_whole_groups(spark):
    df = spark.createDataFrame([("s", g, float(g)) for g in range(12) for _ in range(3)], "s string, g int, v double")
    r = resampling.grouped_bootstrap_fn(df, "s", "g", ["v"], lambda f: f["v"].median(), replicates=100).first()
    assert r["value"] == 5.5 and r["ci_low"] <= 5.5 <= r["ci_high"] and r["n_groups"] == 12
    odd = resampling.grouped_bootstrap_fn(df, "s", "g", ["v"], lambda f: 1 / 0, replicates=100).first()
    assert math.isnan(odd["ci_low"]) and odd["n_valid"] == 0


def test_iid_and_block(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(40)] + [("short", i, 1.0) for i in range(4)] + [("a", 99, float("nan"))], "s string, o int, v double")
    for f in (resampling.bootstrap_ci, resampling.block_bootstrap_ci):
        rows = f(df, ["s"], ["o"], "v", {"mean": resampling.mean_stat, "std": resampling.std_stat}, replicates=100).collect()
        assert {r["s"] for r in rows} == {"a"} and all(r["n"] == 40 and r["ci_low"] <= r["ci_high"] for r in rows)
        assert [r["value"] for r in rows if r["metric"] == "mean"] == [2.0]


def test_autocorrelation(spark):
    alternating = [("s", 1990 + i, (-1.0) ** i if i != 7 else float("nan")) for i in range(20)]
    r = resampling.lag1_autocorrelation(spark.createDataFrame(alternating, "s string, y int, v double"), ["s"], "y", "v").first()
    assert (r["n_years"], r["n_pairs"], r["has_gaps"], r["low_n"], r["high"]) == (19, 17, True, False, False) and r["r1"] < -0.9
    few = resampling.lag1_autocorrelation(spark.createDataFrame(alternating[:7], "s string, y int, v double"), ["s"], "y", "v").first()
    assert math.isnan(few["r1"]) and few["low_n"]
    flat = resampling.lag1_autocorrelation(spark.createDataFrame([("s", i, 1.0) for i in range(20)], "s string, y int, v double"), ["s"], "y", "v").first()
    assert math.isnan(flat["r1"]) and not flat["high"]


# ---------------------------------------------------------------- store


def test_jobs_view(spark):
    registry_rows = spark.createDataFrame([("a", "k", "1", "running"), ("b", "k", "2", "running"), ("c", "k", None, "running")], "job_id string, kind string, started_at string, registered string")
    status = spark.createDataFrame([("a", 1, "running"), ("a", 2, "complete"), ("d", 1, "running")], "job_id string, at int, status string")
    out = {r["job_id"]: r["state"] for r in store.jobs_view(registry_rows, status, spark.createDataFrame([("b",)], "job_id string")).collect()}
    assert out == {"a": "complete", "b": "running", "c": "failed", "d": "failed"}


def test_one_failing_row_fails_no_other(spark):
    req = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "f string, x int")
    done = spark.createDataFrame([("b", "old")], "f string, value string")
    rows = {r["f"]: (r["value"], r["cached"], bool(r["error"])) for r in store.compute_missing(req, done, ["f"], lambda p: 10 // (int(p["x"].iloc[0]) - 3), ["x"]).collect()}
    assert rows == {"a": ("-5", False, False), "b": ("old", True, False), None: (None, False, True)}


# ---------------------------------------------------------------- files, graphs, verification


def test_files_and_manifests(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"r":{"x":[1,2]}}')
    (tmp_path / "sub/b.csv").write_text("x\n")
    (tmp_path / "bad.json").write_text("{")
    os.symlink(tmp_path / "a.json", tmp_path / "link")
    os.mkfifo(tmp_path / "pipe")
    crates = {"c": str(tmp_path)}
    listed = files.listing(spark, crates)
    assert {(r["path"], r["kind"]) for r in listed.where("kind <> 'file'").collect()} == {("link", "link"), ("pipe", "irregular")}
    found = files.scan_files(listed).cache()
    assert {(r["path"], r["size"], r["media_type"]) for r in found.collect()} == {("a.json", 17, "application/json"), ("sub/b.csv", 2, "text/csv"), ("bad.json", 1, "application/json")}
    files.write_manifest(found, "c", str(tmp_path))
    manifest = files.read_manifest(spark, crates)
    assert verify.differing_sets(manifest, found, ["crate", "path"], ["sha256"], "VER-BAGIT").count() == 0
    (tmp_path / "sub/b.csv").write_text("y\n")
    now = files.scan_files(files.listing(spark, crates))
    assert [r["entity"] for r in verify.differing_sets(manifest, now, ["crate", "path"], ["sha256"], "VER-BAGIT").collect()] == ["sub/b.csv"]
    entries = spark.createDataFrame([("c", "a.json#/r/x/1"), ("c", "a.json#/q"), ("c", "none.json#/r")], "crate string, l string")
    out = {r["l"]: r["v"] for r in files.resolve_locations(entries, files.read_documents(listed), "l", "v").collect()}
    assert out == {"a.json#/r/x/1": "2", "a.json#/q": None, "none.json#/r": None}
    objects = now.select("crate", "path", F.concat(F.lit("sha256:"), "sha256").alias("digest"), "size").where("path <> 'bad.json'").unionByName(spark.createDataFrame([("c", "gone", digest("a"), 1)], "crate string, path string, digest string, size bigint"))
    rules = {(r["rule"], r["entity"]) for r in verify.file_failures(objects.withColumn("size", F.when(F.col("path") == "a.json", 1).otherwise(F.col("size"))), now, listed).collect()}
    assert rules == {("VER-FILE-DIGEST", "gone"), ("VER-FILE-DIGEST", "a.json"), ("VER-UNLISTED-FILE", "bad.json"), ("VER-UNLISTED-FILE", "link"), ("VER-UNLISTED-FILE", "pipe")}
    assert files.scan_files(listed.where("path = 'x'")).count() == 0
    assert files.write_crate([{"@id": "b", "x": [2, 1]}, {"@id": "a"}], "ctx", str(tmp_path)).endswith(b"\n")


CONTEXT = {"context": "https://w3id.org/ro/crate/1.3/context", "barred": "workflow-run", "spec": "https://spec", "profile": "process", "prefix": "own:", "namespace": "https://own/", "notice": "Integrity is not origin", "recomputation": "Recomputation", "crosscheck": "CrossCheck"}
REF = lambda *ids: {"@id": ids[0]} if len(ids) == 1 else [{"@id": i} for i in ids]


def crate():
    return {
        "ro-crate-metadata.json": {"@type": "CreativeWork", "about": REF("./"), "conformsTo": REF("https://spec")},
        "./": {"@type": "Dataset", "datePublished": "2026-01-01", "name": "n", "description": "Integrity is not origin", "license": REF("https://l"), "conformsTo": REF("process"), "hasPart": REF("a.csv"), "mentions": REF("#run", "#assess"), "own:replayStatus": "archive_integrity"},
        "process": {"@type": "Profile", "name": "p", "version": "1"},
        "a.csv": {"@type": "File", "sha256": "a" * 64, "contentSize": "12"},
        "#tool": {"@type": "SoftwareApplication", "url": "u", "version": "1"},
        "#me": {"@type": "Person"},
        "#run": {"@type": "CreateAction", "instrument": REF("#tool"), "agent": REF("#me"), "actionStatus": "http://schema.org/CompletedActionStatus", "result": REF("a.csv", "#stat")},
        "#stat": {"@type": "PropertyValue", "value": 1},
        "#assess": {"@type": "AssessAction", "instrument": REF("#tool"), "object": REF("./"), "result": REF("#s1", "#s2", "#s3", "#s4"), "description": "all"},
        "#s1": {"@type": "PropertyValue", "propertyID": "replayStatus", "value": "archive_integrity"},
        "#s2": {"@type": "PropertyValue", "propertyID": "manifestStatus", "value": "archive_integrity"},
        "#s3": {"@type": "PropertyValue", "propertyID": "checkedStatus", "value": "archive_integrity"},
        "#s4": {"@type": "PropertyValue", "propertyID": "records_verified", "value": 2, "maxValue": 2},
        "#claim": {"@type": "Claim", "name": "c", "additionalProperty": REF("#basis"), "own:recordDigest": "d", "own:recordLocation": "l", "prov:wasDerivedFrom": REF("#stat")},
        "#basis": {"@type": "PropertyValue", "propertyID": "claimBasis", "value": "sealed_revision"},
        **{f"https://own/{t}": {"@type": "rdf:Property", "name": t, "description": t, "rdfs:label": t, "rdfs:comment": t} for t in ("replayStatus", "recordDigest", "recordLocation")},
    }


MUTATIONS = [
    ("#s1", "value", "cross_check", "HON-REPLAY-LEVEL"), ("./", "own:replayStatus", None, "HON-REPLAY-PRESENT"), ("./", "own:replayStatus", "recomputed", "HON-RECOMPUTED"), ("./", "own:replayStatus", "cross_check", "HON-CROSSCHECK"), ("#s3", "value", "not_performed", "HON-REPLAY-LEVEL"),
    ("#assess", "object", None, "HON-REPLAY-ASSESS"), ("#assess", "@type", "CreateAction", "HON-REPLAY-ASSESS"), ("#s2", "propertyID", "x", "HON-REPLAY-ASSESS"), ("#s4", "maxValue", 3, "HON-COVERAGE"), ("#s4", "maxValue", None, "HON-COVERAGE"), ("./", "description", "x", "HON-NOT-ORIGIN"),
    ("a.csv", "sha256", "A" * 64, "RC-FILE"), ("a.csv", "contentSize", "1.5", "RC-FILE"), ("./", "hasPart", None, "RC-HASPART"), ("./", "hasPart", REF("a.csv", "#me"), "RC-HASPART"), ("./", "datePublished", "soon", "RC-ROOT"), ("./", "@type", "Thing", "RC-ROOT"), ("./", "conformsTo", REF("https://spec"), "PRC-ACTION"),
    ("process", "version", None, "RC-PROFILE"), ("ro-crate-metadata.json", "@type", "Thing", "RC-DESCRIPTOR"), ("ro-crate-metadata.json", "conformsTo", None, "RC-DESCRIPTOR"), ("#run", "instrument", None, "PRC-INSTRUMENT"), ("#run", "instrument", REF("#me"), "PRC-INSTRUMENT"), ("#run", "agent", REF("#tool"), "PRC-ACTION"),
    ("#run", "actionStatus", "done", "PRC-ACTION"), ("#run", "error", "e", "PRC-ACTION"), ("#run", "prov:wasInformedBy", REF("#me"), "PROV-DOMAIN"), ("#tool", "url", None, "RC-SOFTWARE-URL"), ("#tool", "version", None, "RC-SOFTWARE-VERSION"), ("#tool", "softwareVersion", "2", "PRC-ACTION"),
    ("#basis", "value", "x", "CLM-BASIS"), ("#claim", "own:recordDigest", None, "CLM-BASIS"), ("#basis", "value", "working_view_unsealed", "CLM-BASIS"), ("#claim", "prov:wasDerivedFrom", REF("#me"), "PROV-DOMAIN"), ("#claim", "prov:wasDerivedFrom", REF("#s1x"), "RC-REF-RESOLVE"), ("#run", "result", REF("a.csv"), "PROV-STAT-RESULT"),
    ("#me", "knows", {"name": "x"}, "RC-FLAT"), ("#me", "own:unknown", "x", "RC-TERM-DEFINED"), ("https://own/recordDigest", "rdfs:label", None, "RC-TERM-DEFINED"), ("#me", "odd:key", "x", "RC-CONTEXT-RESOLVE"), ("#me", "note", "in /home/me/x", "PRIV-PATH"),
]


def findings(spark, crates):
    rows = [(c, i, json.dumps(b)) for c, g in crates.items() for i, b in g.items()]
    terms = ("own:replayStatus", "own:recordDigest", "own:recordLocation", "own:unknown", "prov:wasDerivedFrom", "prov:wasInformedBy", "rdfs:label", "rdfs:comment")
    contexts = [(c, 0, None, CONTEXT["context"]) for c in crates] + [(c, 1, t, "x") for c in crates for t in terms]
    out = graph.validate(spark.createDataFrame(rows, "crate string, id string, body string"), spark.createDataFrame(contexts, "crate string, position int, term string, iri string"), **CONTEXT)
    return {(r["crate"], r["rule"]) for r in out.where("severity = 'error'").collect()}


def test_each_mutation_of_a_graph_trips_its_rule(spark):
    crates = {"sound": crate()}
    for k, (i, key, value, _) in enumerate(MUTATIONS):
        g = crate()
        g[i] = {a: b for a, b in (g[i] | {key: value}).items() if b is not None}
        crates[f"m{k}"] = g
    got = findings(spark, crates)
    assert not [x for x in got if x[0] == "sound"]
    assert [(f"m{k}", *m) for k, m in enumerate(MUTATIONS) if (f"m{k}", m[3]) not in got] == []


def test_records_first_failing_rule(spark):
    def run(**change):
        body = {"run_id": "r", "x": 1}
        record = {"run_id": "r", "session_id": "s", "extra": {"entry_digest": canon.digest_of(canon.canonical_text(body))}} | change.pop("record", {})
        record["record_digest"] = canon.digest_of(canon.canonical_text(record))
        row = {"crate": "c", "session_id": "s", "kind": "run", "id": "r", "record_digest": record["record_digest"], "binding_digest": canon.digest_of(canon.canonical_text(body)), "body": json.dumps(body | {"record": record}), "record": json.dumps(record)}
        return row | change

    cases = [(run(), None), (run(body=None), "VER-BINDING"), (run(body='{"run_id":"r"}'), "VER-BINDING"), (run(record={"x": 2}, id="q"), "VER-RECORD-DIGEST"), (run(session_id="t"), "VER-SESSION"), (run(record={"extra": {}}), "VER-BINDING"), (run(record_digest=digest("0")), "VER-RECORD-DIGEST")]
    cases.append(({**run(), "record": None}, "VER-RECORD-SEAL"))
    names = ("crate", "session_id", "kind", "id", "record_digest", "binding_digest", "body", "record")
    df = spark.createDataFrame([tuple([f"c{k}", *[r[n] for n in names[1:]]]) for k, (r, _) in enumerate(cases)], ", ".join(f"{n} string" for n in names))
    got = {r["crate"]: r["rule"] for r in verify.record_failures(df).collect()}
    assert got == {f"c{k}": rule for k, (_, rule) in enumerate(cases) if rule}


def test_stubs_chains_bundles_and_outcome(spark):
    stub = {"redacted_for_privacy": True, "run_id": "r", "session_id": "s", "record_digest": digest("a")}
    cases = [(stub, None), (stub | {"evidence": 1}, "VER-STUB-SHAPE"), (stub | {"redacted_for_privacy": "yes"}, "VER-STUB-SHAPE"), (stub | {"run_id": "q"}, "VER-RECORD-DIGEST"), (stub | {"session_id": "t"}, "VER-SESSION"), (stub | {"record_digest": digest("b")}, "VER-RECORD-DIGEST")]
    df = spark.createDataFrame([(f"c{k}", "s", "run", "r", digest("a"), None, json.dumps(b)) for k, (b, _) in enumerate(cases)], "crate string, session_id string, kind string, id string, record_digest string, binding_digest string, body string")
    got = {r["crate"]: r["rule"] for r in verify.stub_failures(df, {"run": tuple(stub)}).collect()}
    assert got == {f"c{k}": rule for k, (_, rule) in enumerate(cases) if rule}

    doc = {"schema": "b/1", "session_id": "s", "objects": [{"ref": "a", "n": 1}], "records": [{"kind": "run", "id": "r"}]}
    doc["bundle_id"] = canon.digest_of(canon.canonical_text(doc))
    doc["record_digest"] = canon.digest_of(canon.canonical_text(doc))
    docs = [("ok", json.dumps(doc)), ("seal", json.dumps(doc | {"created_at": "x"})), ("none", None), ("id", json.dumps(doc | {"session_id": "t"}))]
    rules = {(r["crate"], r["rule"]) for r in verify.bundle_failures(spark.createDataFrame(docs, "crate string, doc string")).collect()}
    assert rules == {("seal", "VER-BUNDLE-SEAL"), ("none", "VER-BUNDLE-SEAL"), ("id", "VER-BUNDLE-SEAL"), ("id", "VER-BUNDLE-IDENTITY")}

    rev = spark.createDataFrame([("c", "s", "x", 0, digest("a"), None), ("c", "s", "x", 1, digest("b"), digest("z")), ("c", "s", "y", 0, digest("a"), None)], "crate string, session_id string, claim_id string, revision int, revision_digest string, supersedes string")
    assert {r["entity"] for r in verify.chain_failures(rev).collect()} == {"x@0", "x@1"}
    crates = spark.createDataFrame([(c,) for c in ("a", "b", "c", "d")], "crate string")
    fails = spark.createDataFrame([("a", "VER-CHAIN", "e", "m"), ("a", "VER-CHAIN", "f", "m")], "crate string, rule string, entity string, message string")
    partial = spark.createDataFrame([("a", "withheld"), ("b", "unsealed"), ("b", "withheld"), ("c", "unsealed")], "crate string, reason string")
    out = {r["crate"]: (r["status"], r["exit_code"], r["rules"]) for r in verify.outcomes(crates, fails, partial).collect()}
    assert out == {"a": ("failed", 1, ["VER-CHAIN"]), "b": ("ok_partial_withheld", 3, []), "c": ("ok_partial_unsealed", 3, []), "d": ("ok", 0, [])}
    counts = spark.createDataFrame([("c", 2, 1, 1), ("d", 3, 0, 0)], "crate string, sealed int, withheld_for_privacy int, unsealed int")
    counted = spark.createDataFrame([("c", 1), ("d", 2)], "crate string, unsealed int")
    entries = spark.createDataFrame([("c", "run")] * 2 + [("d", "run")] * 3, "crate string, kind string")
    assert [r["crate"] for r in verify.row_count_failures(counts, counted, entries).collect()] == ["d"]
