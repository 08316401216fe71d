"""Queries p1, p2, p3, p4 and p6 over the tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwork.operators import drift, flatten, hierarchy, history, orphans
from sealwork.session import Scratch, iso_micros, micros, read_table


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = read_table(spark, d, "raw_records")
    return raw, Scratch(spark, "drift").save(drift.file_profiles(raw))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(_profiles(spark, d)[1]).drop("seq")


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_versions(_profiles(spark, d)[1])


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    """The migration steps from each file's schema to the one after it: renames, defaults for fields that came or went, casts."""
    return drift.migration_steps(drift.schema_changes(_profiles(spark, d)[1]))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    raw, profiles = _profiles(spark, d)
    return drift.consistent_table(raw, profiles, drift.schema_changes(profiles))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    revisions = read_table(spark, d, "claim_revisions").withColumn("us", iso_micros(F.col("recorded_at")))
    return history.version_history(revisions, Scratch(spark, "history"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    us = micros("ingested_at")
    month = F.date_format("seen", "yyyy-MM")
    runs = read_table(spark, d, "runs").select("run_id", "parents", "ingested_at")
    claims = read_table(spark, d, "claim_revisions").select("claim_id", F.concat_ws("@", "claim_id", "revision").alias("key"), F.col("cause.run_id").alias("run_id"), "ingested_at")
    bundles = read_table(spark, d, "bundles").select("bundle_id", F.transform("records", lambda x: F.struct(x["kind"].alias("kind"), x["id"].alias("id"))).alias("records"), "ingested_at")
    basins = read_table(spark, d, "basin_refs").select("basin_id", "ingested_at")

    def sources(df: DataFrame, table: str, key: str, refs: list) -> DataFrame:
        flat = df.select(F.lit(table).alias("src_table"), F.col(key).alias("src_key"), "ingested_at", *refs)
        return flat.where("ref_id is not null and trim(ref_id) <> '' and src_key is not null")

    refs = sources(runs.withColumn("ref_id", F.explode("parents")), "runs", "run_id", [F.lit("run").alias("ref_kind"), "ref_id"])
    refs = refs.unionByName(sources(claims.withColumnRenamed("run_id", "ref_id"), "claim_revisions", "key", [F.lit("run").alias("ref_kind"), "ref_id"]))
    refs = refs.unionByName(sources(bundles.withColumn("e", F.explode("records")).where("e.kind is not null"), "bundles", "bundle_id", [F.col("e.kind").alias("ref_kind"), F.col("e.id").alias("ref_id")]))
    first = (
        runs.select(F.lit("runs").alias("src_table"), F.col("run_id").alias("src_key"), "ingested_at")
        .unionByName(claims.select(F.lit("claim_revisions").alias("src_table"), F.col("key").alias("src_key"), "ingested_at"))
        .unionByName(bundles.select(F.lit("bundles").alias("src_table"), F.col("bundle_id").alias("src_key"), "ingested_at"))
        .groupBy("src_table", "src_key").agg(F.min("ingested_at").alias("seen"))
    )
    refs = refs.drop("ingested_at").distinct().join(first, ["src_table", "src_key"])
    refs = refs.select("src_table", "src_key", "ref_kind", "ref_id", micros("seen").alias("src_us"), month.alias("period"))

    def kind(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_kind"), F.col(key).alias("ref_id"), us.alias("us"))

    targets = kind(runs, "run", "run_id").unionByName(kind(claims, "claim_revision", "key")).unionByName(kind(claims, "claim_view", "claim_id")).unionByName(kind(basins, "basin_ref", "basin_id"))
    removed = read_table(spark, d, "removed_records").where("restored_at is null").select(F.col("kind").alias("ref_kind"), F.col("record_id").alias("ref_id"))
    return refs, targets, removed


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.faulty_references(*_references(spark, d), Scratch(spark, "orphans"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, d), Scratch(spark, "orphans"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "runs").select(F.col("run_id").alias("node"), "parents", "session_id", "ingested_at")


LOCALITY = ["session_id", "ingested_at"]


def _descents(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return hierarchy.hierarchy(_runs(spark, d), Scratch(spark, "hierarchy"), LOCALITY)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = _descents(spark, d)
    rows = out["assigned"].where("node <> root").select(F.col("node").alias("run_id"), F.col("root").alias("root_id"), "depth")
    return rows.unionByName(out["looped"].select(F.col("node").alias("run_id"), F.col("root").alias("root_id"), F.lit(-1).alias("depth")))


def p4_tree(spark: SparkSession, d: str) -> DataFrame:
    """One row per run: nearest root, depth, whole path, subtree size by primary parent (p4_descendant_counts: over all parents); loops have depth -1."""
    scratch = Scratch(spark, "hierarchy")
    out = hierarchy.hierarchy(_runs(spark, d), scratch, LOCALITY)
    near = scratch.save(out["assigned"].groupBy("node").agg(F.min(F.struct("depth", "root", "base", "seg")).alias("m"), F.count("*").cast("int").alias("n_roots")))
    paths = hierarchy.whole_paths(near.select("node", "m.base", "m.seg"), scratch)
    rows = near.join(paths, "node").join(out["peeled"].select("node", "size"), "node", "left").select(
        F.col("node").alias("run_id"), F.col("m.root").alias("root_id"), F.col("m.depth").alias("depth"), "n_roots", F.array_join("path", " / ").alias("path"), F.col("size").alias("subtree_size")
    )
    loops = out["looped"].select(F.col("node").alias("run_id"), F.col("root").alias("root_id"), F.lit(-1).alias("depth"), F.lit(1).alias("n_roots"), F.lit("").alias("path"), F.lit(None).cast("bigint").alias("subtree_size"))
    return rows.unionByName(loops)


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """One row per run and descendant, over all parents; members of a loop descend from each other, none from itself."""
    pairs = hierarchy.descendants(_runs(spark, d), Scratch(spark, "descendants"), LOCALITY)
    return pairs.select(F.col("node").alias("run_id"), F.col("descendant").alias("descendant_id"))


def p4_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row per run with the number of its distinct descendants over all parents, 0 if it has none."""
    counts = p4_descendants(spark, d).groupBy("run_id").agg(F.count("*").alias("n"))
    runs = _runs(spark, d).where("node is not null").select(F.col("node").alias("run_id")).distinct()
    return runs.join(counts, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_descendants"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    claims = flatten.claim_children(read_table(spark, d, "claim_revisions"))
    return claims.unionByName(flatten.bundle_children(read_table(spark, d, "bundles")))


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return flatten.claim_tables(read_table(spark, d, "claim_revisions"))["spans"]


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    return flatten.claim_tables(read_table(spark, d, "claim_revisions"))["checks"]


def p6_basins(spark: SparkSession, d: str) -> DataFrame:
    return flatten.claim_tables(read_table(spark, d, "claim_revisions"))["basins"]


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    return flatten.bundle_tables(read_table(spark, d, "bundles"))["objects"]


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return flatten.bundle_tables(read_table(spark, d, "bundles"))["records"]


_FUNCTIONS = (
    p1_found, p1_versions, p1_steps, p1_table, p2_found, p3_found, p3_counts, p4_found, p4_tree, p4_descendants, p4_descendant_counts,
    p6_found, p6_spans, p6_checks, p6_basins, p6_objects, p6_records,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# ---------------------------------------------------------------- the same in DuckDB's SQL

_TIME = """epoch_us(try_cast(case when regexp_matches(trim(recorded_at), '(?i)(z|[+-]\\d\\d:?\\d\\d)$') and contains(recorded_at, ':') then trim(recorded_at) else trim(recorded_at) || 'Z' end as timestamptz))"""
_P2 = f"""with recursive one as (select claim_id, revision, coalesce(revision_digest, '') as d, min(us) as us, arg_min(s, (us, s)) as s from (select claim_id, revision, revision_digest, {_TIME} as us, coalesce(supersedes, '') as s from claim_revisions where claim_id is not null and revision is not null) group by all),
ranked as (select *, dense_rank() over (partition by claim_id order by revision desc) as k from one),
picked as (select claim_id, revision, d, us, s, k from (select *, row_number() over (partition by claim_id order by us desc nulls last, d desc) as r from ranked where k = 1) where r = 1
union all select claim_id, revision, d, us, s, k from (select n.*, row_number() over (partition by n.claim_id order by (n.d = p.s) desc, n.us desc nulls last, n.d desc) as r from picked p join ranked n on n.claim_id = p.claim_id and n.k = p.k + 1) where r = 1),
opened as (select * from (select *, lag(d) over (partition by claim_id order by revision) as b, lag(revision) over (partition by claim_id order by revision) as br from picked) where br is null or b <> d)
select claim_id, revision, us as valid_from_us, case when lead(revision) over w is null then -1 else lead(us) over w end as valid_to_us from opened window w as (partition by claim_id order by revision)"""

_P3 = """with c as (select claim_id, claim_id || '@' || revision as key, cause.run_id as run_id, ingested_at from claim_revisions where claim_id is not null and revision is not null),
src as (select 'runs' as t, run_id as k, ingested_at as ts from runs union all select 'claim_revisions', key, ingested_at from c union all select 'bundles', bundle_id, ingested_at from bundles),
seen as (select t, k, min(ts) as ts from src where k is not null group by t, k),
refs as (select 'runs' as t, run_id as k, 'run' as kind, unnest(parents) as id from runs union select 'claim_revisions', key, 'run', run_id from c
union select 'bundles', bundle_id, e.kind, e.id from (select bundle_id, unnest(records, recursive := false) as e from bundles)),
own as (select distinct t, k, kind, id, ts from refs join seen using (t, k) where id is not null and trim(id) <> '' and kind is not null),
tgt as (select kind, id, min(ts) as first from (select 'run' as kind, run_id as id, ingested_at as ts from runs union all select 'claim_revision', key, ingested_at from c union all select 'claim_view', claim_id, ingested_at from c union all select 'basin_ref', basin_id, ingested_at from basin_refs) group by kind, id),
gone as (select distinct kind, record_id as id, true as g from removed_records where restored_at is null),
found as (select t as src_table, k as src_key, kind as ref_kind, id as ref_id, case when g then 'deleted' when tgt.id is null then 'missing' when first > ts then 'late' end as state, strftime(ts, '%Y-%m') as period
from own left join tgt using (kind, id) left join gone using (kind, id)) """

_LINKS = """with recursive nodes as (select distinct run_id as n from runs where run_id is not null),
e as (select distinct run_id as c, p from (select run_id, unnest(parents) as p from runs) where run_id is not null and trim(p) <> '' and p in (select n from nodes)),
reach as (select c as n, p as a from e union select reach.n, e.p from reach join e on e.c = reach.a)"""
_P4 = _LINKS + """, loops as (select r.n, least(r.n, min(r.a)) as g from reach r join reach b on b.n = r.a and b.a = r.n where exists (select 1 from reach s where s.n = r.n and s.a = r.n) group by r.n),
starts as (select n, g as root from loops union all select n, n from nodes where n not in (select c from e)),
dist as (select n, root, 0 as d from starts union select e.c, dist.root, d + 1 from dist join e on e.p = dist.n where d < 200),
best as (select n, root, min(d) as d from dist where n not in (select n from loops) group by n, root)
select n as run_id, root as root_id, cast(d as int) as depth from best where d > 0 union all select n, g, -1 from loops"""

_AS_LIST = "case when {j} is null or json_type({j}) = 'NULL' then [] when json_type({j}) = 'ARRAY' then cast({j} as json[]) else [{j}] end"
_P6_BASE = f"""with one as (select record_digest, any_value(content) as t from claim_revisions where record_digest is not null group by record_digest),
v as (select record_digest, case when json_valid(t) then case when json_type(t) = 'VARCHAR' then case when json_valid(json_extract_string(t, '$')) then cast(json_extract_string(t, '$') as json) end else cast(t as json) end end as j from one),
l as (select record_digest, {_AS_LIST.format(j="(j->'$.evidence_spans')")} as spans, {_AS_LIST.format(j="(j->'$.scope.basin_refs')")} as basins from v where json_type(j) = 'OBJECT'),
sp as (select record_digest, unnest(spans) as x, generate_subscripts(spans, 1) - 1 as i from l), s as (select * from sp where x is not null and json_type(x) <> 'NULL'),
ck as (select record_digest, i, unnest(c) as x, generate_subscripts(c, 1) - 1 as k from (select record_digest, i, {_AS_LIST.format(j="(x->'$.checks')")} as c from s)), c as (select * from ck where x is not null and json_type(x) <> 'NULL'),
bs as (select record_digest, unnest(basins) as x, generate_subscripts(basins, 1) - 1 as i from l), b as (select * from bs where x is not null and json_type(x) <> 'NULL'),
bu as (select record_digest, any_value(objects) as objects, any_value(records) as records from bundles where record_digest is not null group by record_digest),
o as (select record_digest, unnest(objects, recursive := false) as x, generate_subscripts(objects, 1) - 1 as i from bu), r as (select record_digest, unnest(records, recursive := false) as x, generate_subscripts(records, 1) - 1 as i from bu) """

ORACLES: dict[str, str] = {
    "p2_found": _P2,
    "p3_found": _P3 + "select * from found where state is not null",
    "p3_counts": _P3 + "select src_table, period, ref_kind, state, count(*) as n from found where state is not null group by all",
    "p4_found": _P4,
    "p4_descendants": _LINKS + " select a as run_id, n as descendant_id from reach where a <> n",
    "p4_descendant_counts": _LINKS + " select nodes.n as run_id, count(reach.n) filter (where reach.n <> nodes.n) as n_descendants from nodes left join reach on reach.a = nodes.n group by nodes.n",
    "p6_found": _P6_BASE + """select 'claim_revisions' as src_table, record_digest, 'evidence_spans' as child_path, i::varchar as child_pos, coalesce(x->>'$.source_id', '') as child_key from s
union all select 'claim_revisions', record_digest, 'evidence_spans.checks', i || '.' || k, coalesce(x->>'$.name', '') from c
union all select 'claim_revisions', record_digest, 'scope.basin_refs', i::varchar, coalesce(case when json_type(x) = 'OBJECT' then x->>'$.id' else x->>'$' end, '') from b
union all select 'bundles', record_digest, 'objects', i::varchar, coalesce(x.ref, '') from o where x is not null union all select 'bundles', record_digest, 'records', i::varchar, coalesce(x.id, '') from r where x is not null""",
    "p6_objects": _P6_BASE + "select record_digest, i::int as pos, x.ref as ref, x.digest as digest, x.size as size, x.role as role, x.media_type as media_type, x.license as license from o where x is not null",
    "p6_records": _P6_BASE + "select record_digest, i::int as pos, x.kind as kind, x.id as id, x.record_digest as entry_digest, x.record_location as record_location, x.body_location as body_location, x.binding.scheme as binding_scheme, x.binding.digest as binding_digest from r where x is not null",
    "p6_basins": _P6_BASE + "select record_digest, i::int as pos, case when json_type(x) = 'OBJECT' then x->>'$.id' else x->>'$' end as id, case when json_type(x) = 'OBJECT' then x->>'$.label' end as label, null::varchar as rest from b",
    "p6_checks": _P6_BASE + "select record_digest, i::int as parent_pos, k::int as pos, x->>'$.name' as name, try_cast(x->>'$.value' as double) as value, x->>'$.detail' as detail, null::varchar as rest from c",
    "p6_spans": _P6_BASE + "select record_digest, i::int as pos, x->>'$.source_id' as source_id, x->>'$.source_type' as source_type, x->>'$.metric_ref' as metric_ref, null::varchar as rest from s",
}
