"""Verification of crates as findings: every rule is a join of tables, many crates at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwork.constants import CRATE_FILE, UNSEALED_KINDS
from sealwork.functions.canon import canonical_json, canonical_without, digest_text, entry_digest, is_digest
from sealwork.operators.seals import chain_problems, set_difference, verify_json_seal

FAILURE = ["crate", "rule", "entity", "message"]


def _fail(df: DataFrame, rule: str, entity: Column, message: str) -> DataFrame:
    return df.select("crate", F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), F.lit(message).alias("message"))


# ---------------------------------------------------------------- files


def file_failures(objects: DataFrame, files: DataFrame, listed: DataFrame) -> DataFrame:
    """objects (crate, path, digest, size) against files (crate, path, sha256, size) and everything listed (crate, path, kind)."""
    both = objects.alias("o").join(files.select("crate", "path", F.col("sha256").alias("_h"), F.col("size").alias("_s")), ["crate", "path"], "left")
    same = F.col("digest").eqNullSafe(F.concat(F.lit("sha256:"), "_h")) & F.col("size").eqNullSafe(F.col("_s"))
    gone = _fail(both.where("_h is null"), "VER-FILE-DIGEST", F.col("path"), "object is not there")
    changed = _fail(both.where(F.col("_h").isNotNull() & ~same), "VER-FILE-DIGEST", F.col("path"), "digest or size differs")
    stray = _fail(files.join(objects, ["crate", "path"], "left_anti"), "VER-UNLISTED-FILE", F.col("path"), "file is no object of the bundle")
    odd = _fail(listed.where("kind <> 'file'"), "VER-UNLISTED-FILE", F.col("path"), "link or irregular file")
    return reduce(DataFrame.unionByName, [changed, stray, odd], gone)


def differing_sets(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], rule: str) -> DataFrame:
    """Full outer, null-safe: keys of one side only, or with other values; used for manifests against objects and bags against files."""
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    return _fail(a.join(b, keys, "full").where("not (_a <=> _b)"), rule, F.col(keys[-1]), "the two sides differ")


# ---------------------------------------------------------------- records


def record_failures(entries: DataFrame) -> DataFrame:
    """First failing rule of every sealed entry, withheld stubs set aside.

    entries: crate, session_id, kind, id, record_digest, binding_digest, body (JSON text or null), record (JSON text or null). In
    this order: the body is there, its binding holds, the record is there, its seal holds, digest and id are the entry's, the
    session is the bundle's, and the body is the one that the record itself seals.
    """
    rows = entries.where(~F.col("kind").isin(*UNSEALED_KINDS))
    get = lambda path: F.get_json_object("record", path)
    own_id = F.when(F.col("kind") == "run", get("$.run_id")).when(F.col("kind") == "claim_revision", F.concat_ws("@", get("$.claim_id"), get("$.revision"))).otherwise(get("$.id"))
    bound = F.col("binding_digest").isNotNull()
    whole = digest_text(canonical_json(F.col("record"))["text"])
    sealed = F.when(F.col("kind") == "basin_ref", whole.eqNullSafe(F.col("record_digest"))).otherwise(verify_json_seal(F.col("record")) )
    stub = F.coalesce(F.get_json_object("body", "$.redacted_for_privacy") == "true", F.lit(False))
    rule = (
        F.when(stub, F.lit(None)).when(bound & F.col("body").isNull(), "VER-BINDING").when(bound & ~entry_digest(F.col("body")).eqNullSafe(F.col("binding_digest")), "VER-BINDING")
        .when(F.col("record").isNull() | ~sealed, "VER-RECORD-SEAL")
        .when((F.col("kind") != "basin_ref") & ~get("$.record_digest").eqNullSafe(F.col("record_digest")), "VER-RECORD-DIGEST").when(~own_id.eqNullSafe(F.col("id")), "VER-RECORD-DIGEST")
        .when((F.col("kind") != "basin_ref") & ~get("$.session_id").eqNullSafe(F.col("session_id")), "VER-SESSION")
        .when((F.col("kind") == "run") & bound & ~get("$.extra.entry_digest").eqNullSafe(F.col("binding_digest")), "VER-BINDING")
    )
    out = rows.withColumn("rule", rule).where("rule is not null")
    return out.select("crate", "rule", F.concat_ws(":", "kind", "id").alias("entity"), F.lit("record does not verify").alias("message"))


def stub_failures(stubs: DataFrame, keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """Withheld records: shape, id, session and digest, first failing rule. stubs: crate, session_id, kind, id, record_digest, binding_digest, body.

    keys: kind -> member names that a stub may have. A stub excuses only what it withholds.
    """
    get = lambda path: F.get_json_object("body", path)
    allowed = reduce(lambda w, kv: w.when(F.col("kind") == kv[0], F.array(*map(F.lit, kv[1]))), keys.items(), F.when(F.lit(False), F.expr("cast(array() as array<string>)")))
    own_id = F.when(F.col("kind") == "run", get("$.run_id")).otherwise(F.concat_ws("@", get("$.claim_id"), get("$.revision")))
    n, sup = get("$.revision").try_cast("int"), get("$.supersedes")
    linked = (F.col("kind") != "claim_revision") | (is_digest(get("$.revision_digest")) & F.when(n == 0, sup.isNull()).otherwise(is_digest(sup)))
    rule = (
        F.when(~get("$.redacted_for_privacy").eqNullSafe(F.lit("true")), "VER-STUB-SHAPE").when(allowed.isNull() | (F.size(F.array_except(F.json_object_keys("body"), allowed)) > 0), "VER-STUB-SHAPE")
        .when(~own_id.eqNullSafe(F.col("id")), "VER-RECORD-DIGEST").when(~get("$.session_id").eqNullSafe(F.col("session_id")), "VER-SESSION")
        .when(~get("$.record_digest").eqNullSafe(F.col("record_digest")), "VER-RECORD-DIGEST")
        .when(is_digest(get("$.entry_digest")) & F.col("binding_digest").isNotNull() & (get("$.entry_digest") != F.col("binding_digest")), "VER-BINDING").when(~linked, "VER-STUB-SHAPE")
    )
    return stubs.withColumn("rule", rule).where("rule is not null").select("crate", "rule", F.concat_ws(":", "kind", "id").alias("entity"), F.lit("no genuine stub").alias("message"))


def chain_failures(revisions: DataFrame) -> DataFrame:
    """Every member of a broken chain fails. revisions: crate, session_id, claim_id, revision, revision_digest, supersedes."""
    keys = ["crate", "session_id", "claim_id"]
    broken = chain_problems(revisions, keys).where("problem is not null").select(*keys)
    return _fail(revisions.join(broken, keys, "left_semi"), "VER-CHAIN", F.concat_ws("@", "claim_id", "revision"), "revision links are broken")


def bundle_failures(bundles: DataFrame) -> DataFrame:
    """Seal, identity and order of bundles given as JSON. bundles: crate, doc (null: unreadable)."""
    get = lambda path: F.get_json_object("doc", path)
    seal = digest_text(canonical_without(F.col("doc"), F.lit("record_digest"))["text"])
    identity = F.to_json(F.struct(*[F.expr(f"try_parse_json(get_json_object(doc, '$.{p}'))").alias(p) for p in ("objects", "records")], get("$.schema").alias("schema"), get("$.session_id").alias("session_id")))
    own = digest_text(canonical_json(identity)["text"])
    refs = F.from_json(get("$.objects"), "array<struct<ref:string>>")
    ids = F.from_json(get("$.records"), "array<struct<kind:string,id:string>>")
    ordered = (F.transform(refs, lambda o: o["ref"]) == F.array_sort(F.array_distinct(F.transform(refs, lambda o: o["ref"])))) & (ids == F.array_sort(F.array_distinct(ids)))
    out = _fail(bundles.where(F.col("doc").isNull() | ~seal.eqNullSafe(get("$.record_digest"))), "VER-BUNDLE-SEAL", F.lit("bundle"), "unreadable, or the seal is another")
    wrong = bundles.where(F.col("doc").isNotNull() & (~own.eqNullSafe(get("$.bundle_id")) | ~F.coalesce(ordered, F.lit(False))))
    return out.unionByName(_fail(wrong, "VER-BUNDLE-IDENTITY", F.lit("bundle"), "identity or order is another"))


# ---------------------------------------------------------------- counts and outcome


def coverage_failures(declared: DataFrame, derived: DataFrame, cols: list[str]) -> DataFrame:
    """Declared and recomputed coverage (crate and ``cols``) that differ, null-safe."""
    return differing_sets(declared, derived, ["crate"], cols, "VER-COVERAGE")


def gate_failures(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """Gates (crate, run_id, code, outcome) of one side only."""
    return _fail(set_difference(declared.select("crate", "run_id", "code", "outcome"), derived), "VER-GATES", F.col("run_id"), "declared and derived gates differ")


def row_count_failures(declared: DataFrame, counted: DataFrame, entries: DataFrame) -> DataFrame:
    """Counters of the run log (crate, sealed, withheld_for_privacy, unsealed) against what is counted and the number of run entries."""
    n = declared.join(counted.withColumnRenamed("unsealed", "_u"), "crate", "left").join(entries.groupBy("crate").agg(F.count_if(F.col("kind") == "run").alias("_e")), "crate", "left")
    e = F.coalesce("_e", F.lit(0))
    bad = ~F.coalesce(F.col("unsealed") == F.col("_u"), F.lit(True)) | (e < F.col("sealed")) | (e > F.col("sealed") + F.col("withheld_for_privacy"))
    return _fail(n.where(bad), "VER-RUN-ROWS", F.lit("run_rows"), "counters do not fit")


def regenerated(stored: DataFrame, built: DataFrame) -> DataFrame:
    """Crates whose stored bytes (crate, sha256) are not those built anew."""
    return differing_sets(stored, built, ["crate"], ["sha256"], "VER-CRATE-REGEN").withColumn("entity", F.lit(CRATE_FILE))


def outcomes(crates: DataFrame, failures: DataFrame, partial: DataFrame) -> DataFrame:
    """(crate, status, exit_code, rules): failed, ok, or ok in part; what is withheld outranks what is unsealed. partial: crate, reason (withheld, unsealed)."""
    f = failures.groupBy("crate").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    p = partial.groupBy("crate").agg(F.collect_set("reason").alias("_p"))
    out = crates.select("crate").distinct().join(f, "crate", "left").join(p, "crate", "left")
    status = F.when(F.col("rules").isNotNull(), "failed").when(F.array_contains("_p", "withheld"), "ok_partial_withheld").when(F.array_contains("_p", "unsealed"), "ok_partial_unsealed").otherwise("ok")
    code = F.when(status == "failed", 1).when(status == "ok", 0).otherwise(3)
    return out.select("crate", status.alias("status"), code.alias("exit_code"), F.coalesce("rules", F.expr("cast(array() as array<string>)")).alias("rules"))
