"""Queries of the evidence operators over the driver's tables, each with the same result in DuckDB's SQL.

Queries run over whole tables. Where a table has no seal, body or polygon of its own, one is derived from its columns by the
same rule in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwork.constants import ACTOR_KINDS, ANCHOR_TAG, BASIN_PREFIX, GEOMETRY_TAG, LOCAL_PATH, MEDIA_TYPES, REPLAY_RANKS, RUN_STATUSES
from sealwork.functions import canon, geometry, text
from sealwork.operators import graph, resampling, seals, store, verify
from sealwork.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- canonical text and digests


@query("select doc_id, 'sha256:' || sha256(text) as digest from documents")
def digest_text(spark, d):
    return read_table(spark, d, "documents").select("doc_id", canon.digest_text("text").alias("digest"))


@query("select p_partkey, substr(sha256(p_name), 1, 8) as short_hash from part")
def short_hash_prefix(spark, d):
    return read_table(spark, d, "part").select("p_partkey", canon.short_hash("p_name").alias("short_hash"))


@query("select event_id, substr(sha256(props), 1, 16) as param_key from events")
def param_key_events(spark, d):
    return read_table(spark, d, "events").select("event_id", canon.param_key("props").alias("param_key"))


@query("select event_id, replace(props, ': ', ':') as canonical, 'sha256:' || sha256(replace(props, ': ', ':')) as digest from events")
def canonical_props(spark, d):
    c = read_table(spark, d, "events").select("event_id", canon.canonical_json("props")["text"].alias("canonical"))
    return c.withColumn("digest", canon.digest_text("canonical"))


@query("""select n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' as canonical,
'sha256:' || sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as digest from nation""")
def canonical_row_digest(spark, d):
    n = read_table(spark, d, "nation")
    n = n.withColumn("canonical", canon.row_text(n.schema, ["n_nationkey", "n_name", "n_regionkey"]))
    return n.select("n_nationkey", "canonical", canon.digest_text("canonical").alias("digest"))


@query("""select user_id, 'sha256:' || sha256('{"$set":[' || string_agg('"' || event_type || '"', ',' order by event_type) || ']}') as digest
from (select distinct user_id, event_type from events) group by user_id""")
def set_digest_event_types(spark, d):
    e = read_table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return e.select("user_id", canon.digest_text(canon.set_text(F.col("s"))).alias("digest"))


@query("""select o_custkey, count(*) as n, 'sha256:' || sha256(string_agg(sha256(o_orderkey || '|' || o_orderstatus), ',' order by o_orderkey)) as digest
from orders group by o_custkey""")
def group_digest_customer(spark, d):
    o = read_table(spark, d, "orders")
    return seals.group_digest(o, ["o_custkey"], ["o_orderkey"], F.concat_ws("|", "o_orderkey", "o_orderstatus"))


@query("""select coalesce(regexp_full_match(output_digest, 'sha256:[0-9a-f]{64}'), false) as output_ok, coalesce(regexp_full_match(input_digest, 'sha256:[0-9a-f]{64}'), false) as input_ok,
coalesce(regexp_full_match(record_digest, 'sha256:[0-9a-f]{64}'), false) as record_ok, count(*) as n from runs group by 1, 2, 3""")
def digest_wellformed(spark, d):
    r = read_table(spark, d, "runs")
    return r.groupBy(*[canon.is_digest(F.col(f"{c}_digest")).alias(f"{c}_ok") for c in ("output", "input", "record")]).agg(F.count("*").alias("n"))


@query("""select c_custkey, 'sha256:' || sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') as digest, c_mktsegment <> 'BUILDING' as verified from customer""")
def entry_binding(spark, d):
    c = read_table(spark, d, "customer")
    body = lambda name: F.to_json(F.struct(name.alias("c_name"), "c_custkey", F.struct("c_mktsegment").alias("record")))
    c = c.withColumn("body", body(F.col("c_name"))).withColumn("shown", body(F.when(F.col("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit("~"))).otherwise(F.col("c_name"))))
    c = c.withColumn("digest", canon.entry_digest(F.col("body")))
    return c.select("c_custkey", "digest", canon.verify_binding(F.col("shown"), F.lit("entry/1"), F.col("digest"), "entry/1").alias("verified"))


@query("""select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus <> 'P') as verified from orders group by o_orderpriority""")
def seal_verify_orders(spark, d):
    fields = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    o = seals.seal(read_table(spark, d, "orders").select(*fields), fields)
    changed = o.withColumn("o_custkey", F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    ok = changed.withColumn("ok", seals.verify_seal(changed, fields))
    return ok.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if("ok").alias("verified"))


# ---------------------------------------------------------------- records and chains

_DIGEST = "regexp_full_match({0}, 'sha256:[0-9a-f]{{64}}')"


def _good(c: str, optional: bool = True) -> str:
    t = _DIGEST.format(c)
    return f"({c} is null or {t})" if optional else f"coalesce({t}, false)"


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_ACTOR = f"coalesce(actor.kind in ({_in(ACTOR_KINDS)}) and actor.id <> '', false)"


@query(f"""select problem, count(*) as n from (select case
when not coalesce(run_id <> '', false) then 'run_id' when not coalesce(tool <> '', false) then 'tool' when not coalesce(status in ({_in(RUN_STATUSES)}), false) then 'status'
when not {_good('input_digest')} then 'input_digest' when not {_good('output_digest')} then 'output_digest' when not {_good('env_digest')} then 'env_digest' when not {_good('record_digest')} then 'record_digest'
when len(list_filter(coalesce(input_refs, []), lambda r: not coalesce(r.ref <> '' and (r.digest is null or regexp_full_match(r.digest, 'sha256:[0-9a-f]{{64}}')), false))) > 0 then 'input_refs'
when not (actor is null or {_ACTOR}) then 'actor' when len(list_filter(coalesce(parents, []), lambda p: not coalesce(p <> '', false))) > 0 then 'parents' end as problem from runs) group by problem""")
def run_validation(spark, d):
    return read_table(spark, d, "runs").groupBy(seals.run_problem().alias("problem")).agg(F.count("*").alias("n"))


@query(f"""select problem, count(*) as n from (select case when not coalesce(claim_id <> '', false) then 'claim_id' when not coalesce(revision >= 0, false) then 'revision'
when not {_good('revision_digest', False)} then 'revision_digest' when not (case when revision = 0 then supersedes is null else {_good('supersedes', False)} end) then 'supersedes'
when not {_good('record_digest')} then 'record_digest' when not coalesce(cause.tool <> '' and cause.reason <> '', false) then 'cause' when not {_ACTOR} then 'actor' end as problem from claim_revisions) group by problem""")
def claim_validation(spark, d):
    return read_table(spark, d, "claim_revisions").groupBy(seals.claim_problem().alias("problem")).agg(F.count("*").alias("n"))


_REVISIONS = "select session_id, claim_id, revision, revision_digest, min(supersedes) as supersedes from claim_revisions where claim_id is not null group by all"


def _revisions(spark, d):
    r = read_table(spark, d, "claim_revisions").where("claim_id is not null")
    return r.groupBy("session_id", "claim_id", "revision", "revision_digest").agg(F.min("supersedes").alias("supersedes"))


@query(f"""with r as (select *, row_number() over w - 1 as i, lag(revision_digest) over w as b from ({_REVISIONS})
window w as (partition by session_id, claim_id order by revision nulls first, revision_digest nulls first)),
p as (select *, case when revision is distinct from i then 'numbering' when not {_good('revision_digest', False)} then 'digest' when i > 0 and supersedes is distinct from b then 'link' end as problem from r)
select session_id, claim_id, count(*) as n, arg_min(problem, i) filter (where problem is not null) as problem, cast(min(i) filter (where problem is not null) as int) as at from p group by session_id, claim_id""")
def claim_chain_verify(spark, d):
    return seals.chain_problems(_revisions(spark, d), ["session_id", "claim_id"])


@query("""with g as (select distinct record_id from removed_records where kind = 'claim_revision' and restored_at is null and record_id is not null),
r as (select claim_id, revision, revision_digest, g.record_id is not null as gone from claim_revisions c left join g on g.record_id = claim_id || '@' || revision where claim_id is not null and revision is not null)
select claim_id, max(revision) filter (where not gone and revision_digest is not null) as head_revision, max({'r': revision, 'd': revision_digest}) filter (where not gone and revision_digest is not null).d as head,
max(revision) filter (where not gone and revision_digest is not null) < max(revision) as head_withheld from r group by claim_id having head_revision is not null""")
def chain_head(spark, d):
    gone = read_table(spark, d, "removed_records").where("kind = 'claim_revision' and restored_at is null and record_id is not null").select(F.col("record_id").alias("_k")).distinct()
    r = read_table(spark, d, "claim_revisions").where("claim_id is not null and revision is not null").select("claim_id", "revision", "revision_digest", F.concat_ws("@", "claim_id", "revision").alias("_k"))
    r = r.join(gone.withColumn("gone", F.lit(True)), "_k", "left")
    return seals.chain_heads(r, ["claim_id"], "revision_digest", "gone")


@query("""with v as (select o_custkey, arg_min(o_orderstatus, o_orderkey) as status, arg_min(o_orderpriority, o_orderkey) as text from orders group by o_custkey),
h as (select o_custkey, max(o_orderkey) filter (where o_orderstatus <> 'P') as head_revision, arg_max(o_orderstatus, o_orderkey) filter (where o_orderstatus <> 'P') as hs, arg_max(o_orderpriority, o_orderkey) filter (where o_orderstatus <> 'P') as ht,
max(o_orderkey) as l from orders group by o_custkey having head_revision is not null)
select o_custkey, head_revision, head_revision < l as head_withheld, concat_ws(',', case when status <> hs and head_revision = l then 'status' end, case when text <> ht then 'text' end) as differing,
case when status <> hs and head_revision < l then 'status' else '' end as unverifiable from v join h using (o_custkey)""")
def head_diff(spark, d):
    o = read_table(spark, d, "orders")
    view = o.groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.min_by("o_orderpriority", "o_orderkey").alias("text"))
    rows = o.select("o_custkey", F.col("o_orderkey").alias("revision"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("text")).alias("c"), (F.col("o_orderstatus") == "P").alias("w"))
    out = seals.head_differences(view, seals.chain_heads(rows, ["o_custkey"], "c", "w"), ["o_custkey"], ("status", "text"), ("status",))
    return out.select("o_custkey", "head_revision", "head_withheld", F.array_join("differing", ",").alias("differing"), F.array_join("unverifiable", ",").alias("unverifiable"))


@query("""select claim_id, revision, cast(revision - 1 as int) as was_revision_of from (select distinct claim_id, revision from claim_revisions where claim_id is not null) a
where exists (select 1 from claim_revisions b where b.claim_id = a.claim_id and b.revision = a.revision - 1)""")
def previous_revision_edges(spark, d):
    return seals.revision_edges(read_table(spark, d, "claim_revisions").where("claim_id is not null and revision is not null"), ["claim_id"])


@query("""with r as (select run_id, min(json_extract_string(case when json_valid(extra) then extra end, '$.call_run_id')) as call, min(status) as status, min(output_digest) as output_digest from runs where run_id is not null group by run_id)
select coalesce(call, run_id) as call_id, count(*) as n_runs, bool_or(coalesce(status <> 'ok', true)) as failed, arg_min(output_digest, run_id) filter (where output_digest is not null) as output_digest from r group by 1""")
def call_groups(spark, d):
    r = read_table(spark, d, "runs").where("run_id is not null").groupBy("run_id").agg(F.min(F.get_json_object("extra", "$.call_run_id")).alias("call"), (F.min("status") == "ok").alias("ok"), F.min("output_digest").alias("output_digest"))
    return seals.call_groups(r, "run_id", "call", "ok", "output_digest")


@query("select l_orderkey, count(*) as n_runs, bool_or(l_returnflag = 'R') as failed from lineitem group by l_orderkey")
def failed_any_by_group(spark, d):
    li = read_table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("g"), (F.col("l_returnflag") != "R").alias("ok"), F.lit(None).cast("string").alias("out"))
    return seals.call_groups(li, "g", "g", "ok", "out").select(F.col("call_id").cast("bigint").alias("l_orderkey"), "n_runs", "failed")


# ---------------------------------------------------------------- bundles, sets, joins


@query("""with b as (select any_value(coverage) as c, any_value(run_rows) as r, any_value(replay) as p, record_digest from bundles where record_digest is not null group by record_digest)
select record_digest, case when c is null then null when not coalesce(c.records_verified >= 0 and c.records_total >= 0, false) then 'counts' when not coalesce(c.records_verified <= c.records_total, false) then 'verified'
when not coalesce(c.unverifiable_ids = list_sort(list_distinct(c.unverifiable_ids)), false) then 'unverifiable_ids'
when not (c.withheld_ids is null or coalesce(c.withheld_ids = list_sort(list_distinct(c.withheld_ids)) and len(list_filter(c.withheld_ids, lambda x: not list_contains(c.unverifiable_ids, x))) = 0, false)) then 'withheld_ids'
when not coalesce(len(c.unverifiable_ids) = c.records_total - c.records_verified, false) then 'unverified' end as coverage_problem, coalesce(c.records_verified = c.records_total, false) as complete,
case when r is null then null when not coalesce(least(r.run_log_rows, r.sealed, r.legacy_no_record, r.unbound, r.unsealable, r.withheld_for_privacy) >= 0 and r.run_log_rows is not null and r.sealed is not null and r.legacy_no_record is not null and r.unbound is not null and r.unsealable is not null and r.withheld_for_privacy is not null, false) then 'counts'
when r.run_log_rows <> r.sealed + r.legacy_no_record + r.withheld_for_privacy then 'sum' end as run_rows_problem from b""")
def bundle_counts_check(spark, d):
    b = read_table(spark, d, "bundles").where("record_digest is not null").dropDuplicates(["record_digest"])
    return b.select(
        "record_digest", F.when(F.col("coverage").isNotNull(), seals.coverage_problem(F.col("coverage"))).alias("coverage_problem"), seals.coverage_complete(F.col("coverage")).alias("complete"),
        F.when(F.col("run_rows").isNotNull(), seals.run_rows_problem(F.col("run_rows"))).alias("run_rows_problem"),
    )


@query()
def bundle_validation(spark, d):
    """Counts of problems in bundles' entries, by part; locations make the SQL too long, tests hold it against plain code."""
    return seals.bundle_problems(read_table(spark, d, "bundles"), ("APPROVAL_REQUIRED",)).groupBy("part", "problem").agg(F.count("*").alias("n"))


@query("""with b as (select any_value(objects) as o, any_value(records) as r, record_digest from bundles where record_digest is not null group by record_digest),
k as (select record_digest, list_transform(list_filter(o, lambda x: x is not null), lambda x: x.ref) as a, list_transform(list_filter(r, lambda x: x is not null), lambda x: x.kind || chr(1) || x.id) as c from b)
select record_digest, coalesce(a = list_sort(list_distinct(a)), true) as objects_ordered, coalesce(c = list_sort(list_distinct(c)), true) as records_ordered from k""")
def canonical_order_check(spark, d):
    b = read_table(spark, d, "bundles").where("record_digest is not null").dropDuplicates(["record_digest"])
    kept = lambda c: F.filter(c, lambda x: x.isNotNull())
    return b.select(
        "record_digest", seals.in_canonical_order(kept("objects"), lambda x: x["ref"]).alias("objects_ordered"),
        seals.in_canonical_order(kept("records"), lambda x: F.concat(x["kind"], F.lit("\x01"), x["id"])).alias("records_ordered"),
    )


@query("""with e as (select distinct record_digest, unnest(records, recursive := false) as x from bundles where record_digest is not null),
l as (select record_digest, x.kind as kind, x.id as id, x.record_location as l from e where x.record_location is not null)
select record_digest, kind, id, split_part(l, '#', 1) as path, replace(replace(replace(substr(l, instr(l, '#') + 2), '/', chr(1)), '~1', '/'), '~0', '~') as tokens from l""")
def record_locations(spark, d):
    b = read_table(spark, d, "bundles").where("record_digest is not null").select("record_digest", F.explode("records").alias("x")).where("x.record_location is not null").distinct()
    at = text.split_location(F.col("x.record_location"))
    return b.select("record_digest", "x.kind", "x.id", at["path"].alias("path"), F.array_join(at["tokens"], "\x01").alias("tokens"))


_PARTS = "select p_brand as crate, p_partkey || '/' || p_name as path, p_type as digest, p_size as size from part"


@query(f"""with a as ({_PARTS}), b as (select crate, path, digest, case when digest like '%BRASS' then size + 1 else size end as size from a where digest not like 'SMALL%'
union all select crate, 'x' || path, digest, size from a where size = 7)
select coalesce(a.crate, b.crate) as crate, 'VER-OBJECTS-MANIFEST' as rule, coalesce(a.path, b.path) as entity from a full join b on a.crate = b.crate and a.path = b.path
where a.digest is distinct from b.digest or a.size is distinct from b.size""")
def objects_vs_manifest(spark, d):
    a = read_table(spark, d, "part").select(F.col("p_brand").alias("crate"), F.concat_ws("/", "p_partkey", "p_name").alias("path"), F.col("p_type").alias("digest"), F.col("p_size").alias("size"))
    b = a.where("digest not like 'SMALL%'").withColumn("size", F.when(F.col("digest").like("%BRASS"), F.col("size") + 1).otherwise(F.col("size")))
    b = b.unionByName(a.where("size = 7").withColumn("path", F.concat(F.lit("x"), "path")))
    return verify.differing_sets(a, b, ["crate", "path"], ["digest", "size"], "VER-OBJECTS-MANIFEST").drop("message")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_partkey is not null)")
def unlisted_parts(spark, d):
    li = read_table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, d, "part").select("p_partkey").join(li, "p_partkey", "left_anti")


@query("select l_suppkey, count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) group by l_suppkey")
def missing_refs(spark, d):
    li = read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return li.join(read_table(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey", "left_anti").withColumnRenamed("s_suppkey", "l_suppkey")


@query("""with a as (select distinct o_custkey, o_orderpriority from orders where o_orderstatus = 'F'), b as (select distinct o_custkey, o_orderpriority from orders where o_totalprice > 150000)
select *, 'declared' as side from (select * from a except select * from b) union all select *, 'derived' as side from (select * from b except select * from a)""")
def gate_symdiff(spark, d):
    o = read_table(spark, d, "orders")
    return seals.set_difference(o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority"), o.where("o_totalprice > 150000").select("o_custkey", "o_orderpriority"))


@query("""select o_orderpriority, count(*) filter (where o_orderstatus <> 'P') as records_verified, count(*) as records_total, sha256(coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey::varchar) filter (where o_orderstatus = 'P'), '')) as unverifiable,
sha256(coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey::varchar) filter (where o_orderstatus = 'P' and o_totalprice > 200000), '')) as withheld from orders group by o_orderpriority""")
def coverage_counts(spark, d):
    o = read_table(spark, d, "orders").select("o_orderpriority", F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") != "P").alias("ok"), (F.col("o_totalprice") > 200000).alias("kept"))
    c = seals.coverage(o, ["o_orderpriority"], "id", "ok", "kept")
    return c.select("o_orderpriority", "records_verified", "records_total", F.sha2(F.array_join("unverifiable_ids", ","), 256).alias("unverifiable"), F.sha2(F.array_join("withheld_ids", ","), 256).alias("withheld"))


@query("""with c as (select case when json_valid(content) then content end as j from claim_revisions), k as (select j, unnest(json_keys(j, '$.evidence_seals')) as run_id from c where json_type(j, '$.evidence_seals') = 'OBJECT'),
s as (select run_id, json_extract_string(j, '$.evidence_seals."' || run_id || '"') as digest from k), g as (select run_id, list_sort(list(distinct digest)) as digests from s where digest is not null group by run_id),
w as (select distinct r.run_id, r.record_digest from runs r join removed_records m on m.kind = 'run' and m.record_id = r.run_id and m.restored_at is null)
select run_id, record_digest, array_to_string(digests, ',') as digests from w join g using (run_id) where digests is distinct from [record_digest]""")
def stub_anchor_conflicts(spark, d):
    gone = read_table(spark, d, "removed_records").where("kind = 'run' and restored_at is null").select(F.col("record_id").alias("run_id")).distinct()
    withheld = read_table(spark, d, "runs").select("run_id", "record_digest").distinct().join(gone, "run_id", "left_semi")
    return seals.anchor_conflicts(withheld, seals.cited_seals(read_table(spark, d, "claim_revisions"))).select("run_id", "record_digest", F.array_join("digests", ",").alias("digests"))


@query("""select l_orderkey, l_linenumber, l_returnflag from lineitem a where exists (select 1 from lineitem b where b.l_linestatus = 'O' and b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber)""")
def prefix_containment(spark, d):
    li = read_table(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("string")
    pointers = li.select("l_orderkey", "l_linenumber", "l_returnflag", F.array(n, F.col("l_returnflag")).alias("tokens"))
    return seals.contained(pointers, li.where("l_linestatus = 'O'").select("l_orderkey", F.array(n).alias("tokens")), ["l_orderkey"]).drop("tokens")


@query("""select doc_id, '/' || replace(replace(coalesce(repo, ''), '~', '~0'), '/', '~1') || '/' || replace(replace(coalesce(path, ''), '~', '~0'), '/', '~1') as pointer, coalesce(repo, '') || chr(1) || coalesce(path, '') as tokens from documents""")
def pointer_roundtrip(spark, d):
    p = read_table(spark, d, "documents").select("doc_id", text.make_pointer(F.array(F.coalesce("repo", F.lit("")), F.coalesce("path", F.lit("")))).alias("pointer"))
    return p.withColumn("tokens", F.array_join(text.pointer_tokens(F.col("pointer")), "\x01"))


# ---------------------------------------------------------------- scalar functions

_LEVELS = {"1-URGENT": "independently_reproduced", "2-HIGH": "recomputed", "3-MEDIUM": "cross_check", "4-NOT SPECIFIED": "archive_integrity", "5-LOW": "not_performed"}


@query(f"""with l as (select o_custkey, case o_orderpriority {' '.join(f"when '{k}' then '{v}'" for k, v in _LEVELS.items())} end as level from orders)
select o_custkey, arg_min(level, case level {' '.join(f"when '{k}' then {v}" for k, v in REPLAY_RANKS.items())} end) as level from l group by o_custkey""")
def replay_min_level(spark, d):
    level = F.try_element_at(F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv]), F.col("o_orderpriority"))
    return read_table(spark, d, "orders").select("o_custkey", level.alias("level")).groupBy("o_custkey").agg(text.weakest_level(F.col("level")).alias("level"))


_ISO_RE = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})"


@query(rf"""select distinct recorded_at, case when not regexp_full_match(recorded_at, '{_ISO_RE}') then recorded_at else substr(recorded_at, 1, 19) ||
case when substr(recorded_at, 20, 1) = '.' then '.' || (regexp_extract(recorded_at, '\.(\d+)', 1) || '000')[1:3] else '' end ||
case when recorded_at like '%Z' then '+00:00' else right(recorded_at, 6) end end as iso from claim_revisions""")
def iso_ms_revisions(spark, d):
    return read_table(spark, d, "claim_revisions").select("recorded_at", text.iso_ms(F.col("recorded_at")).alias("iso")).distinct()


@query(rf"""select doc_id, case lower(regexp_extract(path, '(\.[^.]*)$', 1)) {' '.join(f"when '{k}' then '{v}'" for k, v in MEDIA_TYPES.items())} end as media_type from documents""")
def media_type_paths(spark, d):
    return read_table(spark, d, "documents").select("doc_id", text.media_type(F.col("path")).alias("media_type"))


@query(f"""select doc_id, coalesce(regexp_matches(text, '{LOCAL_PATH.replace("'", "''")}'), false) as has_path from documents""")
def privacy_path_scan(spark, d):
    return read_table(spark, d, "documents").select("doc_id", text.has_local_path(F.col("text")).alias("has_path"))


@query(r"""select doc_id, coalesce(regexp_matches(text, '(^|\s)(<abs>|~/|workspace:|session-data:)'), false) as marked,
sha256(trim(regexp_replace(regexp_replace(text, '(^|\s)(?:<abs>|~/|workspace:|session-data:)\S*', '\1', 'g'), '\s+', ' ', 'g'))) as stripped from documents""")
def scrub_markers(spark, d):
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", text.has_marker(t).alias("marked"), F.sha2(text.without_markers(t), 256).alias("stripped"))


@query("""select distinct scheme, alias_id, scheme || ':' || alias_id as curie, '#' || concat_ws('-', url_encode(scheme), url_encode(alias_id)) as fragment from place_aliases where alias_id is not null and scheme is not null""")
def alias_curies(spark, d):
    a = read_table(spark, d, "place_aliases").where("alias_id is not null and scheme is not null").select("scheme", "alias_id").distinct()
    return a.select("scheme", "alias_id", text.curie(F.col("scheme"), F.col("alias_id")).alias("curie"), text.fragment_id(F.col("scheme"), F.col("alias_id")).alias("fragment"))


@query(r"""select p_partkey, nullif(substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 32), '') as slug from part""")
def slug_names(spark, d):
    return read_table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


# ---------------------------------------------------------------- places


@query("""select basin_id, cast(round_even(outlet.lon * 1e6, 0) as bigint) as qx, cast(round_even(outlet.lat * 1e6, 0) as bigint) as qy from basin_refs""")
def quantise_points(spark, d):
    return read_table(spark, d, "basin_refs").select("basin_id", geometry.quantise(F.col("outlet.lon")).alias("qx"), geometry.quantise(F.col("outlet.lat")).alias("qy"))


@query(f"""select distinct basin_id, '{BASIN_PREFIX}sha256:' || sha256('{{"element":"' || anchor.element || '","kind":"' || anchor.kind || '","network":"' || anchor.network || '","network_version":"' || anchor.network_version || '","schema":"{ANCHOR_TAG}"}}') as implied,
coalesce(basin_id = '{BASIN_PREFIX}sha256:' || sha256('{{"element":"' || anchor.element || '","kind":"' || anchor.kind || '","network":"' || anchor.network || '","network_version":"' || anchor.network_version || '","schema":"{ANCHOR_TAG}"}}'), false) as verified from basin_refs""")
def basin_ids(spark, d):
    b = read_table(spark, d, "basin_refs")
    a = F.col("anchor")
    return b.select("basin_id", geometry.basin_id(a["kind"], a["network"], a["network_version"], a["element"]).alias("implied"), geometry.basin_ref_verifies(F.col("basin_id"), a).alias("verified")).distinct()


def _squares(spark, d):
    """A square for every supplier, written with the clock, closed, beginning at its upper left corner."""
    s = read_table(spark, d, "supplier").withColumn("x", (F.col("s_suppkey") % 300 - 150).cast("double")).withColumn("y", (F.col("s_suppkey") % 120 - 60).cast("double"))
    p = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    return s.select("s_suppkey", F.array(p(0, 1), p(1, 1), p(1, 0), p(1, 0), p(0, 0), p(0, 1)).alias("ring"))


_CORNERS = "select s_suppkey, (s_suppkey % 300 - 150) * 1000000 as x, (s_suppkey % 120 - 60) * 1000000 as y from supplier"
_SQUARE = f"""select s_suppkey, '{{"alg":"{GEOMETRY_TAG}","coordinates":[[[[' || x || ',' || y || '],[' || (x + 1000000) || ',' || y || '],[' || (x + 1000000) || ',' || (y + 1000000) || '],[' || x || ',' || (y + 1000000) || ']]]],"q_exp":6,"type":"MultiPolygon"}}' as canonical from ({_CORNERS})"""


@query("select s_suppkey, cast(-2000000000000 as bigint) as area2 from supplier")
def ring_area2(spark, d):
    return _squares(spark, d).select("s_suppkey", geometry.ring_area2(geometry.quantised_ring(F.col("ring"))).cast("bigint").alias("area2"))


@query(_SQUARE)
def ring_canonical(spark, d):
    return _squares(spark, d).select("s_suppkey", geometry.geometry_text(F.array(F.array("ring"))).alias("canonical"))


@query(f"select s_suppkey, 'sha256:' || sha256(canonical) as geometry_id from ({_SQUARE})")
def geometry_ids(spark, d):
    return _squares(spark, d).select("s_suppkey", geometry.geometry_id(F.array(F.array("ring"))).alias("geometry_id"))


@query("select s_suppkey, s_acctbal < 0 as crosses from supplier")
def antimeridian_flags(spark, d):
    s = read_table(spark, d, "supplier")
    far = F.when(F.col("s_acctbal") < 0, F.lit(-179.5)).otherwise(F.lit(179.9))
    ring = F.array(F.array(F.lit(179.0), F.lit(0.0)), F.array(far, F.lit(0.0)), F.array(far, F.lit(1.0)), F.array(F.lit(179.0), F.lit(1.0)))
    return s.select("s_suppkey", geometry.crosses_antimeridian(F.array(F.array(ring))).alias("crosses"))


# ---------------------------------------------------------------- resampling


@query("""select year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end as water_year, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1""")
def water_year_orders(spark, d):
    return read_table(spark, d, "orders").groupBy(resampling.water_year(F.col("o_orderdate")).alias("water_year")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("select cast(n as int) as n, greatest(5, cast(round_even(pow(n, 1.0 / 3), 0) as int)) as block_size from range(10, 8000) t(n)")
def default_block_sizes(spark, d):
    return spark.range(10, 8000).select(F.col("id").cast("int").alias("n"), resampling.default_block_size(F.col("id")).alias("block_size"))


_DRAW = "(('0x' || substr(sha256('0:' || {name} || ':' || r || ':' || i), 1, 12))::bigint % {n})"


def _grouped_sql(base: str, group_sums: str, ratio_cols: dict[str, tuple[str, str]], b: int) -> str:
    metrics = " union all ".join(f"select series, r, '{m}' as metric, sum({a}) / nullif(sum({c}), 0) as v from smp group by series, r" for m, (a, c) in ratio_cols.items())
    points = " union all ".join(f"select series, '{m}' as metric, sum({a}) / nullif(sum({c}), 0) as value, cast(sum(n) as bigint) as n, count(*) as n_groups from parts group by series" for m, (a, c) in ratio_cols.items())
    return f"""with parts as (select series, grp, {group_sums}, count(*) as n, row_number() over (partition by series order by grp) - 1 as k from ({base}) group by series, grp),
tot as (select series, count(*) as g from parts group by series), reps as (select series, g, r, unnest(range(g)) as i from (select *, unnest(range({b})) as r from tot where g >= 10)),
drw as (select series, r, {_DRAW.format(name="series", n="g")} as k from reps), smp as (select parts.*, r from drw join parts using (series, k)), vals as ({metrics}),
ci as (select series, metric, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi, count(v) as n_valid from vals group by series, metric), pts as ({points})"""


_MONTHLY = "select l_returnflag as series, strftime(l_shipdate, '%Y-%m') as grp, l_discount * l_extendedprice as a, l_extendedprice as b, l_quantity as q, 1.0 as one from lineitem"


def _lines(spark, d):
    li = read_table(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("series"), F.date_format("l_shipdate", "yyyy-MM").alias("grp"), (F.col("l_discount") * F.col("l_extendedprice")).alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_quantity").alias("q"), F.lit(1.0).alias("one"))


def _rounded(df: DataFrame, *cols: str, places: int = 8) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


@query(_grouped_sql(_MONTHLY, "sum(a) as a, sum(b) as b, sum(q) as q, sum(one) as one", {"discount": ("a", "b"), "quantity": ("q", "one")}, 500)
+ """ select series, metric, round(value, 8) as value, round(lo, 8) as ci_low, round(hi, 8) as ci_high, n, n_groups, n_valid, n_groups < 30 as low_n from pts join ci using (series, metric)""")
def grouped_ratio_ci(spark, d):
    out = resampling.grouped_ratio_ci(_lines(spark, d), ["series"], "grp", {"discount": ("a", "b"), "quantity": ("q", "one")}, replicates=500)
    return _rounded(out.select("series", "metric", "value", "ci_low", "ci_high", "n", "n_groups", "n_valid", "low_n"), "value", "ci_low", "ci_high")


_RARE = "select 'all' as series, strftime(l_shipdate, '%Y-%m') as grp, l_extendedprice as a, case when strftime(l_shipdate, '%Y-%m') = '1996-03' then l_extendedprice else 0 end as b from lineitem"


@query(_grouped_sql(_RARE, "sum(a) as a, sum(b) as b", {"rare": ("a", "b")}, 500)
+ """ select series, metric, n_groups, n_valid, round(n_valid / 500.0, 8) as valid_frac, n_valid < 475 as ci_degraded, case when n_valid < 475 then 'only ' || n_valid || ' of 500 replicates were finite' else '' end as ci_reason from pts join ci using (series, metric)""")
def degraded_flags(spark, d):
    li = read_table(spark, d, "lineitem").select(F.lit("all").alias("series"), F.date_format("l_shipdate", "yyyy-MM").alias("grp"), F.col("l_extendedprice").alias("a"))
    li = li.withColumn("b", F.when(F.col("grp") == "1996-03", F.col("a")).otherwise(F.lit(0.0)))
    out = resampling.grouped_ratio_ci(li, ["series"], "grp", {"rare": ("a", "b")}, replicates=500)
    return _rounded(out.select("series", "metric", "n_groups", "n_valid", "valid_frac", "ci_degraded", "ci_reason"), "valid_frac")


@query("""with w as (select o_orderpriority as series, year(o_orderdate) + case when month(o_orderdate) >= 10 then 1 else 0 end as g from orders)
select series, count(distinct g) as n_groups, true as low_n, isnan('nan'::double) as no_bounds, 'at least 10 groups are needed, there are ' || count(distinct g) as ci_reason from w group by series having count(distinct g) < 10""")
def low_n_flags(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), resampling.water_year(F.col("o_orderdate")).alias("g"), F.col("o_totalprice").alias("a"), F.lit(1.0).alias("b"))
    out = resampling.grouped_ratio_ci(o, ["series"], "g", {"mean": ("a", "b")}, replicates=100).where("n_groups < 10")
    return out.select("series", "n_groups", "low_n", (F.isnan("ci_low") & F.isnan("ci_high")).alias("no_bounds"), "ci_reason")


_DAILY = "select event_type as series, cast(ts as date) as day, avg(value) as v from events group by all having avg(value) is not null"


def _daily(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


_PLACED = f"rows_ as (select series, v, row_number() over (partition by series order by day) - 1 as p from ({_DAILY})), sizes as (select series, count(*) as n from rows_ group by series)"
_FINISH = """, ci as (select series, metric, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi, count(*) as n_valid from vals group by series, metric)
select series, metric, round(value, 8) as value, round(lo, 8) as ci_low, round(hi, 8) as ci_high, '{method}' as method, n, n_valid from pts join ci using (series, metric) join sizes using (series)"""
_MEAN = "vals as (select series, r, 'mean' as metric, avg(v) as v from drw join rows_ using (series, p) group by series, r), pts as (select series, 'mean' as metric, avg(v) as value from rows_ group by series)"
_BOTH = """vals as (select series, r, 'mean' as metric, avg(v) as v from drw join rows_ using (series, p) group by series, r union all select series, r, 'std' as metric, stddev_pop(v) as v from drw join rows_ using (series, p) group by series, r),
pts as (select series, 'mean' as metric, avg(v) as value from rows_ group by series union all select series, 'std' as metric, stddev_pop(v) as value from rows_ group by series)"""
_IID = f"with {_PLACED}, drw as (select series, r, {_DRAW.format(name='series', n='n')} as p from (select *, unnest(range(n)) as i from (select *, unnest(range(200)) as r from sizes where n >= 5))), "


@query(_IID + _MEAN + _FINISH.format(method="bootstrap_iid"))
def bootstrap_iid_mean(spark, d):
    return _rounded(resampling.bootstrap_ci(_daily(spark, d), ["series"], ["day"], "v", {"mean": resampling.mean_stat}, replicates=200), "value", "ci_low", "ci_high")


@query(_IID + _BOTH + _FINISH.format(method="bootstrap_iid"))
def multi_metric_ci(spark, d):
    return _rounded(resampling.bootstrap_ci(_daily(spark, d), ["series"], ["day"], "v", {"mean": resampling.mean_stat, "std": resampling.std_stat}, replicates=200), "value", "ci_low", "ci_high")


@query(f"""with {_PLACED}, bs as (select *, least(n, greatest(5, cast(round_even(pow(n, 1.0 / 3), 0) as int))) as b from sizes where n >= 10),
st as (select series, n, b, r, i, {_DRAW.format(name='series', n='n')} as s from (select *, unnest(range(cast(ceil(n / b) as bigint))) as i from (select *, unnest(range(200)) as r from bs))),
drw as (select series, r, (s + o) % n as p from (select *, unnest(range(b)) as o from st) where i * b + o < n), """ + _MEAN + _FINISH.format(method="bootstrap_block"))
def bootstrap_block_mean(spark, d):
    return _rounded(resampling.block_bootstrap_ci(_daily(spark, d), ["series"], ["day"], "v", {"mean": resampling.mean_stat}, replicates=200), "value", "ci_low", "ci_high")


@query("""with m as (select l_returnflag as series, year(l_shipdate) * 12 + month(l_shipdate) as y, avg(l_extendedprice) as v from lineitem where month(l_shipdate) <> 5 group by all),
p as (select series, v as a, lead(v) over w as b, lead(y) over w - y as g from m window w as (partition by series order by y)), q as (select * from p where g = 1),
c as (select series, count(*) as n_pairs, sum((a - ma) * (b - mb)) / nullif(sqrt(sum((a - ma) * (a - ma)) * sum((b - mb) * (b - mb))), 0) as r from (select *, avg(a) over (partition by series) as ma, avg(b) over (partition by series) as mb from q) group by series),
s as (select series, count(*) as n_years, max(y) - min(y) + 1 as span from m group by series)
select s.series, round(case when n_pairs >= 8 then r end, 6) as r1, n_years, n_pairs, n_years < span as has_gaps, n_pairs < 8 as low_n, coalesce(n_pairs >= 8 and r >= 0.3, false) as high from s join c using (series)""")
def lag1_monthly(spark, d):
    li = read_table(spark, d, "lineitem").where(F.month("l_shipdate") != 5)
    li = li.select(F.col("l_returnflag").alias("series"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("y"), F.col("l_extendedprice").alias("v"))
    return _rounded(resampling.lag1_autocorrelation(li, ["series"], "y", "v"), "r1", places=6)


# ---------------------------------------------------------------- predicates


@query("""select o_orderkey, case o_orderstatus when 'O' then true when 'F' then o_totalprice > 0 and o_custkey > 5 else o_totalprice >= 100000 and o_totalprice <= 200000 end as valid from orders""")
def estimate_validity(spark, d):
    o = read_table(spark, d, "orders")
    nan, s = F.lit(float("nan")), F.col("o_orderstatus")
    low = F.when(s == "O", nan).when(s == "F", F.lit(0.0) + F.when(F.col("o_totalprice") > 0, F.lit(0.0)).otherwise(nan)).otherwise(F.lit(100000.0))
    high = F.when(s == "O", nan).when(s == "F", F.col("o_totalprice")).otherwise(F.lit(200000.0))
    n = F.when(s == "F", F.col("o_custkey") - 5).otherwise(F.lit(1))
    return o.select("o_orderkey", text.estimate_is_valid(F.col("o_totalprice"), low, high, n).alias("valid"))


@query("select c_custkey, c_mktsegment not in ('BUILDING', 'MACHINERY') as excluded, true as unscoped from customer where c_mktsegment is not null")
def scope_exclusion(spark, d):
    c = read_table(spark, d, "customer").where("c_mktsegment is not null")
    scope = text.make_scope(F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("BUILDING")), F.array(F.lit("x")), F.array(F.lit("other")))
    return c.select("c_custkey", text.scope_excludes(scope["varies"], F.col("c_mktsegment")).alias("excluded"), text.scope_excludes(F.lit(None).cast("array<string>"), F.col("c_mktsegment")).alias("unscoped"))


@query("select event_id, case when event_type = 'view' then true when value > 5 then false else true end as blocking, props like '%\"k\"%' as has_keys from events")
def blocking_violations(spark, d):
    e = read_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", F.lit(None)).when(F.col("value") > 5, F.lit("lit_unresolvable")).otherwise(F.col("event_type"))
    return e.select("event_id", text.is_blocking(kind).alias("blocking"), text.has_keys(F.from_json("props", "map<string,string>"), ["k"]).alias("has_keys"))


# ---------------------------------------------------------------- store


@query("""select event_type, user_id, min(event_id) as first_seq, count(*) as n_writes, arg_max(props, event_id) as props from events group by event_type, user_id""")
def result_cache_latest(spark, d):
    return store.latest_per_key(read_table(spark, d, "events"), ["event_type", "user_id"], "event_id", ["props"])


@query("""select event_type, user_id, count(*) as n, string_agg(props, ' ' order by s, props) as listed from (select event_type, user_id, props, min(event_id) as s from events where props is not null group by all) group by event_type, user_id""")
def result_listing(spark, d):
    out = store.result_listing(read_table(spark, d, "events").where("props is not null"), "event_type", "user_id", "props", "event_id")
    return out.select("event_type", "user_id", "n", F.array_join("params_keys", " ").alias("listed"))


@query("""select distinct user_id, props from events a where event_type = 'error' and not exists (select 1 from events b where b.event_type <> 'error' and b.user_id is not distinct from a.user_id and b.props is not distinct from a.props)""")
def cache_misses(spark, d):
    e = read_table(spark, d, "events")
    return store.cache_misses(e.where("event_type = 'error'"), e.where("event_type <> 'error'"), ["user_id", "props"])


@query("""with r as (select distinct c_nationkey::varchar as ref from customer union select n_name from nation where n_regionkey < 3 union select 'nowhere' union select '' union select null)
select ref, case when ref is null or ref = '' then '7' else coalesce(a.n_nationkey::varchar, b.k) end as entity, case when ref is null or ref = '' then 'active' when a.n_nationkey is not null then 'id' when b.k is not null then 'name' else 'missing' end as how
from r left join nation a on a.n_nationkey::varchar = ref left join (select n_name, min(n_nationkey)::varchar as k from nation group by n_name) b on b.n_name = ref""")
def resolve_priority(spark, d):
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name", "n_nationkey", "n_regionkey")
    refs = read_table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("ref")).unionByName(n.where("n_regionkey < 3").select(F.col("n_name").alias("ref")))
    refs = refs.unionByName(spark.createDataFrame([("nowhere",), ("",), (None,)], "ref string"))
    return store.resolve(refs, n, "ref", "id", "n_name", "n_nationkey", active="7")


@query("""select n_regionkey, count(*) as n_features, count(*) filter (where n_regionkey = 0 or n_name not like 'N%1%') as n_success, count(*) filter (where n_regionkey <> 0 and n_name like 'N%1%') as n_error, count(*) filter (where n_regionkey = 0) as n_cached from nation group by n_regionkey""")
def batch_fanout_summary(spark, d):
    n = read_table(spark, d, "nation")

    def kernel(row):
        name = row["n_name"].iloc[0]
        if name.startswith("N") and "1" in name:
            raise ValueError(name)
        return len(name)

    cached = n.where("n_regionkey = 0").select("n_nationkey", "n_regionkey", F.lit("old").alias("value"))
    return store.fanout_summary(store.compute_missing(n, cached, ["n_nationkey", "n_regionkey"], kernel, ["n_name"]), ["n_regionkey"], "n_nationkey")


@query("""with f as (select repo, license_file, min(doc_id) as o from documents where repo is not null group by all)
select repo, coalesce(string_agg(license_file, chr(10) || chr(10) order by o) filter (where license_file <> ''), '% no citations') as citations from f group by repo""")
def citations_by_repo(spark, d):
    return store.citation_text(read_table(spark, d, "documents").where("repo is not null"), ["repo"], "doc_id", "license_file")


# ---------------------------------------------------------------- graphs


def _nations(spark, d):
    n = read_table(spark, d, "nation")
    part = F.struct(F.concat(F.lit("r/"), F.col("n_regionkey").cast("string")).alias("@id"))
    of = lambda names: n.select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("crate"), F.concat(F.lit("n/"), names).alias("id"), F.to_json(F.struct(F.lit("File").alias("@type"), part.alias("isPartOf"), F.col("n_name").alias("name"))).alias("body"))
    regions = read_table(spark, d, "region").where("r_regionkey <> 2").select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("crate"), F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")).alias("id"), F.lit('{"@type":["Dataset","Place"]}').alias("body"))
    return of(F.col("n_nationkey").cast("string")).unionByName(of(F.col("n_nationkey").cast("string")).where("body like '%1%'")).unionByName(regions)


@query("""select 'c' || n_regionkey as crate, 'RC-ID-UNIQUE' as rule, 'n/' || n_nationkey as entity from nation where ('{"r/' || n_regionkey || n_name) like '%1%'""")
def graph_dup_ids(spark, d):
    return graph.duplicate_ids(graph.read_graph(_nations(spark, d))).select("crate", "rule", "entity")


@query("""select distinct 'c2' as crate, 'RC-REF-RESOLVE' as rule, 'n/' || n_nationkey as entity, 'isPartOf -> r/2' as message from nation where n_regionkey = 2""")
def graph_dangling_refs(spark, d):
    return graph.dangling_references(graph.read_graph(_nations(spark, d))).select("crate", "rule", "entity", "message").distinct()


@query("""select distinct 'c' || n_regionkey as crate, 'RC-HASPART' as rule, 'n/' || n_nationkey as entity from nation""")
def graph_file_parts(spark, d):
    return graph.file_rules(graph.read_graph(_nations(spark, d))).where("rule = 'RC-HASPART'").select("crate", "rule", "entity").distinct()


@query("""select 'c' || (o_custkey % 10) as crate, 'PROV-DOMAIN' as rule, 'o/' || o_orderkey as entity from orders where o_orderstatus <> 'O' and o_orderpriority like '5%'""")
def prov_domain(spark, d):
    o = read_table(spark, d, "orders").withColumn("crate", F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string")))
    to = F.when(F.col("o_orderpriority").like("5%"), F.lit("thing")).otherwise(F.lit("act"))
    kind = F.when(F.col("o_orderstatus") == "O", F.lit("Dataset")).otherwise(F.lit("CreateAction"))
    acts = o.select("crate", F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("id"), F.to_json(F.struct(kind.alias("@type"), F.struct(to.alias("@id")).alias("prov:wasInformedBy"))).alias("body"))
    fixed = o.select("crate").distinct().select("crate", F.explode(F.array(F.struct(F.lit("act").alias("id"), F.lit('{"@type":"CreateAction"}').alias("body")), F.struct(F.lit("thing").alias("id"), F.lit('{"@type":"Thing"}').alias("body")))).alias("x")).select("crate", "x.id", "x.body")
    return graph.action_rules(graph.read_graph(acts.unionByName(fixed))).where("rule = 'PROV-DOMAIN'").select("crate", "rule", "entity")
