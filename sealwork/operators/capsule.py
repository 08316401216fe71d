"""Whole capsules from their folders: every rule over all capsules at once, and one outcome each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwork.constants import BAG_FILE, CRATE_FILE, STUB_KEYS, UNSEALED_KINDS
from sealwork.operators import seals, verify
from sealwork.sources import files

BUNDLE_FILE, MANIFEST_FILE = "bundle.json", "capsule_manifest.json"
_BUNDLE = (
    "session_id string, objects array<struct<ref:string,digest:string,size:bigint>>, records array<struct<kind:string,id:string,record_digest:string,record_location:string,body_location:string,binding:struct<scheme:string,digest:string>>>, "
    "coverage struct<records_verified:bigint,records_total:bigint,unverifiable_ids:array<string>,withheld_ids:array<string>>, run_rows struct<sealed:bigint,legacy_no_record:bigint,unbound:bigint,unsealable:bigint,withheld_for_privacy:bigint>, "
    "replay struct<status:string,manifest_status:string,checked_status:string>, gates array<struct<run_id:string,code:string,outcome:string>>"
)


def crate_entities(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, contexts) of the metadata files among documents (crate, path, doc), as graph.validate takes them."""
    meta = documents.where(F.col("path") == CRATE_FILE)
    bodies = meta.select("crate", F.explode(F.from_json(F.get_json_object("doc", "$['@graph']"), "array<string>")).alias("body"))
    entities = bodies.select("crate", F.get_json_object("body", "$['@id']").alias("id"), "body")
    raw = F.get_json_object("doc", "$['@context']")
    listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    items = meta.select("crate", F.posexplode(listed).alias("position", "item"))
    inline = items.where("item like '{%'").select("crate", "position", F.explode(F.from_json("item", "map<string,string>")).alias("term", "iri"))
    return entities, items.where("item not like '{%'").select("crate", "position", F.lit(None).cast("string").alias("term"), F.col("item").alias("iri")).unionByName(inline)


def verify_capsules(spark: SparkSession, capsules: dict[str, str], codes: tuple[str, ...] = ("APPROVAL_REQUIRED",)) -> tuple[DataFrame, DataFrame]:
    """(failures, outcomes) of capsules given by name and folder.

    failures: crate, rule, entity, message. outcomes: crate, status, exit_code, rules. Files are told apart first and only regular ones
    are opened; a capsule without a readable bundle fails and is looked at no further.
    """
    listed = files.listing(spark, capsules).cache()
    names = spark.createDataFrame([(c,) for c in capsules], "crate string")
    found, docs = files.scan_files(listed).cache(), files.read_documents(listed).cache()
    bundles = names.join(docs.where(F.col("path") == BUNDLE_FILE).select("crate", "doc"), "crate", "left")
    b = bundles.where("doc is not null").select("crate", F.from_json("doc", _BUNDLE).alias("b")).select("crate", "b.*").cache()
    objects = b.select("crate", F.explode("objects").alias("o")).select("crate", F.col("o.ref").alias("path"), "o.digest", "o.size")
    own = found.where(F.col("path") != BUNDLE_FILE).join(b.select("crate"), "crate", "left_semi")
    out = [verify.bundle_failures(bundles), verify.file_failures(objects, own, listed.join(b.select("crate"), "crate", "left_semi"))]

    manifest = docs.where(F.col("path") == MANIFEST_FILE).select("crate", F.explode(F.from_json(F.get_json_object("doc", "$.files"), "array<struct<path:string,sha256:string,size:bigint>>")).alias("f"))
    manifest = manifest.select("crate", "f.path", F.concat(F.lit("sha256:"), "f.sha256").alias("digest"), "f.size").where(~F.col("path").isin(BUNDLE_FILE, MANIFEST_FILE))
    out.append(verify.differing_sets(manifest, objects.where(~F.col("path").isin(BUNDLE_FILE, MANIFEST_FILE)), ["crate", "path"], ["digest", "size"], "VER-OBJECTS-MANIFEST"))
    bag = files.scan_files(listed, excluded=(BAG_FILE,)).join(b.select("crate"), "crate", "left_semi")
    out.append(verify.differing_sets(files.read_manifest(spark, capsules), bag, ["crate", "path"], ["sha256"], "VER-BAGIT"))

    entries = b.select("crate", "session_id", F.explode("records").alias("e")).select("crate", "session_id", "e.kind", "e.id", "e.record_digest", "e.record_location", "e.body_location", F.col("e.binding.digest").alias("binding_digest"))
    entries = files.resolve_locations(files.resolve_locations(entries, docs, "record_location", "record"), docs, "body_location", "body")
    entries = entries.withColumn("stub", F.coalesce(F.get_json_object(F.coalesce("body", "record"), "$.redacted_for_privacy") == "true", F.lit(False))).cache()
    stubs = entries.where("stub").withColumn("body", F.coalesce("body", "record"))
    failed = verify.record_failures(entries.where("not stub")).unionByName(verify.stub_failures(stubs, STUB_KEYS))
    get = lambda p: F.get_json_object(F.coalesce("record", "body"), p)
    revisions = entries.where("kind = 'claim_revision'").select("crate", "session_id", get("$.claim_id").alias("claim_id"), get("$.revision").try_cast("int").alias("revision"), get("$.revision_digest").alias("revision_digest"), get("$.supersedes").alias("supersedes"))
    failed = failed.unionByName(verify.chain_failures(revisions))
    cited = entries.where("kind = 'claim_revision' and not stub").select("crate", F.explode(F.from_json(get("$.content.evidence_seals"), "map<string,string>")).alias("id", "digest")).groupBy("crate", "id").agg(F.collect_set("digest").alias("digests"))
    anchored = stubs.where("kind = 'run'").join(cited, ["crate", "id"]).where("not (digests <=> array(record_digest))")
    failed = failed.unionByName(anchored.select("crate", F.lit("VER-STUB-ANCHOR").alias("rule"), F.concat_ws(":", "kind", "id").alias("entity"), F.lit("cited under another seal").alias("message"))).cache()
    out.append(failed)

    sealed = entries.where(~F.col("kind").isin(*UNSEALED_KINDS)).select("crate", "id", F.concat_ws(":", "kind", "id").alias("entity"), "stub")
    bad = failed.select("crate", "entity").distinct().withColumn("bad", F.lit(True))
    sealed = sealed.join(bad, ["crate", "entity"], "left").withColumn("ok", F.col("bad").isNull() & ~F.col("stub"))
    derived = seals.coverage(sealed, ["crate"], "id", "ok")
    declared = b.where("coverage is not null").select("crate", "coverage.records_verified", "coverage.records_total", "coverage.unverifiable_ids")
    out.append(verify.coverage_failures(declared, derived.join(declared.select("crate"), "crate", "left_semi"), ["records_verified", "records_total", "unverifiable_ids"]))
    runs = entries.where("kind = 'run' and not stub").join(bad.withColumn("id", F.expr("substring(entity, 5)")).where("entity like 'run:%'").select("crate", "id"), ["crate", "id"], "left_anti")
    gates = runs.select("crate", F.col("id").alias("run_id"), F.get_json_object("body", "$.error_summary").alias("code"), F.get_json_object("record", "$.status").alias("s"), (F.get_json_object("record", "$.extra.entry_digest") == F.col("binding_digest")).alias("bound"))
    gates = gates.where(F.col("bound") & F.col("code").isin(*codes)).select("crate", "run_id", "code", F.when(F.col("s").isin("refused", "error"), F.col("s")).otherwise("error").alias("outcome"))
    out.append(verify.gate_failures(b.select("crate", F.explode("gates").alias("g")).select("crate", "g.*"), gates))
    replay = b.where("replay is not null").withColumn("p", seals.replay_problem(F.col("replay"))).where("p is not null")
    out.append(replay.select("crate", F.lit("VER-REPLAY-MANIFEST").alias("rule"), F.lit("replay").alias("entity"), F.col("p").alias("message")))
    rows = b.where("run_rows is not null").select("crate", "run_rows.*").withColumn("n", F.col("sealed"))
    n_runs = entries.groupBy("crate").agg(F.count_if(F.col("kind") == "run").alias("_e"))
    odd = rows.join(n_runs, "crate", "left").where("coalesce(_e, 0) < sealed or coalesce(_e, 0) > sealed + withheld_for_privacy")
    out.append(odd.select("crate", F.lit("VER-RUN-ROWS").alias("rule"), F.lit("run_rows").alias("entity"), F.lit("counters do not fit the run entries").alias("message")))

    failures = reduce(DataFrame.unionByName, out).distinct().cache()
    unsealed = rows.where("coalesce(legacy_no_record, 0) + coalesce(unbound, 0) + coalesce(unsealable, 0) > 0").select("crate", F.lit("unsealed").alias("reason"))
    return failures, verify.outcomes(names, failures, stubs.select("crate", F.lit("withheld").alias("reason")).unionByName(unsealed))
