"""Problem 3 against a plain version."""

import random
from collections import Counter
from datetime import datetime, timedelta

from sealwork.plans import problems
from sealwork.session import micros
from tests import brute


def tables(spark, d, runs, claims, bundles, basins, removed):
    t = "ingested_at timestamp_ntz"
    spark.createDataFrame([(r, p, at, 1) for r, p, at in runs], f"run_id string, parents array<string>, {t}, us int").write.parquet(f"{d}/runs.parquet")
    spark.createDataFrame([(c, v, (r,), at) for c, v, r, at in claims], f"claim_id string, revision int, cause struct<run_id:string>, {t}").write.parquet(f"{d}/claim_revisions.parquet")
    spark.createDataFrame(bundles, f"bundle_id string, records array<struct<kind:string,id:string>>, {t}").write.parquet(f"{d}/bundles.parquet")
    spark.createDataFrame(basins, f"basin_id string, {t}").write.parquet(f"{d}/basin_refs.parquet")
    spark.createDataFrame([(k, i, x, None if x is None else x) for k, i, x in removed], "kind string, record_id string, removed_at timestamp_ntz, restored_at timestamp_ntz").write.parquet(f"{d}/removed_records.parquet")


def test_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    day = datetime(2024, 1, 20)

    def at():
        return day + timedelta(hours=r.randrange(600))

    runs = [(f"r{r.randrange(60)}", r.choice([None, [], ["hot"], ["hot", "hot", None, " "], [f"r{r.randrange(70)}", f"r{r.randrange(70)}"]]), at()) for _ in range(150)]
    claims = [(f"c{r.randrange(9)}", r.randrange(4), r.choice([None, "", f"r{r.randrange(70)}"]), at()) for _ in range(60)]
    kinds = [("run", "r"), ("claim_revision", "c"), ("claim_view", "c"), ("basin_ref", "b")]
    bundles = []
    for i in range(30):
        entries = [(k, f"{p}{r.randrange(12)}" + (f"@{r.randrange(5)}" if k == "claim_revision" else "")) for k, p in (r.choice(kinds) for _ in range(4))]
        bundles.append((f"x{i % 20}", r.choice([None, entries, [*entries, None, ("run", None)]]), at()))
    basins = [(f"b{r.randrange(9)}", at()) for _ in range(9)]
    removed = [("run", "r3", None), ("run", "r4", day), ("basin_ref", "b1", None), ("claim_revision", "c1@1", None), ("run", "hot2", None), ("run", "r3", None)]
    tables(spark, tmp_path, runs, claims, bundles, basins, removed)
    want = brute.orphans(runs, claims, [(b, [e for e in es or () if e], t) for b, es, t in bundles], basins, {(k, i) for k, i, x in removed if x is None})
    got = [(x.src_table, x.src_key, x.ref_kind, x.ref_id, x.state, x.period) for x in problems.p3_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {(x.src_table, x.period, x.ref_kind, x.state): x.n for x in problems.p3_counts(spark, str(tmp_path)).collect()}
    assert counts == Counter((t, p, k, s) for t, _, k, _, s, p in want)
    assert {x[4] for x in want} == {"deleted", "missing", "late"}


def test_empty(spark, tmp_path):
    tables(spark, tmp_path, [], [], [], [], [])
    assert problems.p3_found(spark, str(tmp_path)).count() == problems.p3_counts(spark, str(tmp_path)).count() == 0


def test_micros_of_zoneless_time(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:01' t")
    assert df.select(micros("t")).first()[0] == brute.micros(datetime(2024, 1, 1, 0, 0, 1))
