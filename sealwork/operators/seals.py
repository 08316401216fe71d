"""Sealed records: validation, seals, revision chains, heads, bundles, coverage and gates, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sealwork.constants import ACTOR_KINDS, ENUM_HEAD_FIELDS, GATE_OUTCOMES, HEAD_FIELDS, RECORD_KINDS, RUN_ROW_KEYS, RUN_STATUSES, UNSEALED_KINDS
from sealwork.functions.canon import canonical_without, digest_text, is_digest, row_text
from sealwork.functions.text import has_marker, is_relative_path, replay_rank, split_location, without_markers

# ---------------------------------------------------------------- seals


def seal(df: DataFrame, fields: list[str], out: str = "record_digest") -> DataFrame:
    """Adds the digest of the canonical object of ``fields`` without null members; the seal itself is never among them."""
    return df.withColumn(out, digest_text(row_text(df.schema, [f for f in fields if f != out], drop_null=True)))


def verify_seal(df: DataFrame, fields: list[str], seal_col: str = "record_digest") -> Column:
    """True where the seal is that of the fields; false for a null or malformed one."""
    own = digest_text(row_text(df.schema, [f for f in fields if f != seal_col], drop_null=True))
    return is_digest(F.col(seal_col)) & own.eqNullSafe(F.col(seal_col))


def verify_json_seal(record: Column) -> Column:
    """True where a JSON record's ``record_digest`` is the digest of its other members; unreadable records are false."""
    declared = F.get_json_object(record, "$.record_digest")
    return F.coalesce(is_digest(declared) & (digest_text(canonical_without(record, F.lit("record_digest"))["text"]) == declared), F.lit(False))


# ---------------------------------------------------------------- validation: the first problem of a row, null if none


def _first(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for good, name in reversed(checks):
        out = F.when(F.coalesce(good, F.lit(False)), out).otherwise(name)
    return out


def _optional_digest(c: Column) -> Column:
    return c.isNull() | is_digest(c)


def _there(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def actor_problem(actor: Column) -> Column:
    return _first((actor["kind"].isin(*ACTOR_KINDS), "actor.kind"), (_there(actor["id"]), "actor.id"))


def run_problem() -> Column:
    """First problem of a row of runs: identity, vocabulary, well-formed digests, input references, actor, parents."""
    refs = F.coalesce(F.forall("input_refs", lambda r: _there(r["ref"]) & _optional_digest(r["digest"])), F.lit(True))
    return _first(
        (_there(F.col("run_id")), "run_id"), (_there(F.col("tool")), "tool"), (F.col("status").isin(*RUN_STATUSES), "status"),
        (_optional_digest(F.col("input_digest")), "input_digest"), (_optional_digest(F.col("output_digest")), "output_digest"),
        (_optional_digest(F.col("env_digest")), "env_digest"), (_optional_digest(F.col("record_digest")), "record_digest"), (refs, "input_refs"),
        (F.col("actor").isNull() | actor_problem(F.col("actor")).isNull(), "actor"),
        (F.coalesce(F.forall("parents", lambda p: _there(p)), F.lit(True)), "parents"),
    )


def claim_problem() -> Column:
    """First problem of a row of claim_revisions: identity, digests, supersedes exactly from revision 1 on, cause, actor."""
    n = F.col("revision")
    return _first(
        (_there(F.col("claim_id")), "claim_id"), (n.isNotNull() & (n >= 0), "revision"), (is_digest(F.col("revision_digest")), "revision_digest"),
        (F.when(n == 0, F.col("supersedes").isNull()).otherwise(is_digest(F.col("supersedes"))), "supersedes"),
        (_optional_digest(F.col("record_digest")), "record_digest"), (_there(F.col("cause")["tool"]) & _there(F.col("cause")["reason"]), "cause"),
        (actor_problem(F.col("actor")).isNull(), "actor"),
    )


def _located(c: Column) -> Column:
    return c.isNull() | split_location(c).isNotNull()


def object_problem(o: Column) -> Column:
    return _first((is_relative_path(o["ref"]), "ref"), (is_digest(o["digest"]), "digest"), (o["size"] >= 0, "size"), (_there(o["role"]), "role"))


def record_problem(r: Column) -> Column:
    """First problem of a bundle's record entry: sealed kinds need digest and location, unsealed views must not claim any."""
    sealed = ~r["kind"].isin(*UNSEALED_KINDS)
    return _first(
        (r["kind"].isin(*RECORD_KINDS), "kind"), (_there(r["id"]), "id"),
        (F.when(sealed, is_digest(r["record_digest"]) & _there(r["record_location"])).otherwise(r["record_digest"].isNull() & r["record_location"].isNull()), "seal"),
        (_located(r["record_location"]), "record_location"), (_located(r["body_location"]), "body_location"),
        (sealed | r["body_location"].isNotNull(), "view"),
        (r["binding"].isNull() | (_there(r["binding"]["scheme"]) & is_digest(r["binding"]["digest"]) & r["body_location"].isNotNull()), "binding"),
    )


def coverage_problem(c: Column) -> Column:
    """Counts are whole and fit, ids sorted and distinct, withheld ones among the unverifiable ones, and these are exactly the unverified records."""
    v, t, u, w = c["records_verified"], c["records_total"], c["unverifiable_ids"], c["withheld_ids"]
    ordered = lambda x: x == F.array_sort(F.array_distinct(x))
    return _first(
        ((v >= 0) & (t >= 0), "counts"), (v <= t, "verified"), (u.isNotNull() & ordered(u), "unverifiable_ids"),
        (w.isNull() | (ordered(w) & (F.size(F.array_except(w, u)) == 0)), "withheld_ids"), (F.size(u) == t - v, "unverified"),
    )


def coverage_complete(c: Column) -> Column:
    return F.coalesce(c["records_verified"] == c["records_total"], F.lit(False))


def run_rows_problem(r: Column) -> Column:
    whole = F.forall(F.array(*[r[k] for k in RUN_ROW_KEYS]), lambda x: x.isNotNull() & (x >= 0))
    return _first((whole, "counts"), (r["run_log_rows"] == r["sealed"] + r["legacy_no_record"] + r["withheld_for_privacy"], "sum"))


def replay_problem(r: Column) -> Column:
    """A status is there and known, and neither above what the manifest states nor above what was checked."""
    rank = replay_rank(r["status"])
    known = lambda c: c.isNull() | replay_rank(c).isNotNull()
    return _first(
        (rank.isNotNull(), "status"), (known(r["manifest_status"]), "manifest_status"), (known(r["checked_status"]), "checked_status"),
        (r["manifest_status"].isNull() | (rank <= replay_rank(r["manifest_status"])), "exceeds manifest"), (r["checked_status"].isNull() | (rank <= replay_rank(r["checked_status"])), "exceeds checked"),
    )


def gates_problem(g: Column, codes: tuple[str, ...]) -> Column:
    return _first((F.coalesce(F.forall(g, lambda x: x["run_id"].isNotNull() & x["code"].isin(*codes) & x["outcome"].isin(*GATE_OUTCOMES)), F.lit(True)), "gates"))


def bundle_problems(bundles: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """(bundle_id, record_digest, part, problem): everything wrong with a bundle's entries, counts, replay and gates; sound parts have no row.

    Null entries are problems. Duplicate refs of objects and (kind, id) of records are told once per bundle.
    """
    one = bundles.dropDuplicates(["record_digest"]) if "record_digest" in bundles.columns else bundles
    entry = lambda column, problem, part: one.select("bundle_id", "record_digest", F.explode(column).alias("x")).select("bundle_id", "record_digest", F.lit(part).alias("part"), F.when(F.col("x").isNull(), "null entry").otherwise(problem(F.col("x"))).alias("problem"))
    whole = lambda part, problem: one.select("bundle_id", "record_digest", F.lit(part).alias("part"), problem.alias("problem"))

    def repeated(column: str, key) -> Column:
        ids = F.transform(F.filter(column, lambda x: x.isNotNull()), key)
        return F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicates")

    parts = [
        entry("objects", object_problem, "objects"), entry("records", record_problem, "records"),
        whole("objects", repeated("objects", lambda x: x["ref"])), whole("records", repeated("records", lambda x: F.struct(x["kind"], x["id"]))),
        whole("coverage", F.when(F.col("coverage").isNotNull(), coverage_problem(F.col("coverage")))), whole("run_rows", F.when(F.col("run_rows").isNotNull(), run_rows_problem(F.col("run_rows")))),
        whole("replay", F.when(F.col("replay").isNotNull(), replay_problem(F.col("replay")))), whole("gates", gates_problem(F.col("gates"), codes)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("problem is not null")


# ---------------------------------------------------------------- chains


def chain_problems(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, problem, at) of every chain: numbers from 0 without gap or repeat, well-formed digests, supersedes naming the one before.

    ``at`` is the place (from 0) of the first problem; sound chains have null in both. Rows of one chain are ordered by
    revision, ties by digest; only neighbours are compared.
    """
    w = W.partitionBy(*keys).orderBy("revision", "revision_digest")
    rows = revisions.withColumn("_i", F.row_number().over(w) - 1).withColumn("_before", F.lag("revision_digest").over(w))
    problem = (
        F.when(~F.col("revision").eqNullSafe(F.col("_i")), "numbering").when(~is_digest(F.col("revision_digest")), "digest")
        .when((F.col("_i") > 0) & ~F.col("supersedes").eqNullSafe(F.col("_before")), "link")
    )
    first = F.min(F.when(problem.isNotNull(), F.struct(F.col("_i").alias("at"), problem.alias("problem"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), first.alias("_f")).select(*keys, "n", F.col("_f.problem").alias("problem"), F.col("_f.at").alias("at"))


def chain_heads(revisions: DataFrame, keys: list[str], payload: str, withheld: str) -> DataFrame:
    """(keys, head_revision, head, head_withheld): the last revision that is not withheld and has a payload; chains without one have no row.

    An aggregate, so that no chain has to be sorted in a task.
    """
    usable = ~F.coalesce(F.col(withheld), F.lit(False)) & F.col(payload).isNotNull()
    agg = revisions.groupBy(*keys).agg(F.max(F.when(usable, F.struct("revision", F.col(payload).alias("p")))).alias("_h"), F.max("revision").alias("_last"))
    return agg.where("_h is not null").select(*keys, F.col("_h.revision").alias("head_revision"), F.col("_h.p").alias("head"), (F.col("_h.revision") < F.col("_last")).alias("head_withheld"))


def head_differences(claims: DataFrame, heads: DataFrame, keys: list[str], fields: tuple[str, ...] = HEAD_FIELDS, enums: tuple[str, ...] = ENUM_HEAD_FIELDS, text_field: str = "text") -> DataFrame:
    """(keys, head_revision, head_withheld, differing, unverifiable): fields in which a working view and the sealed head disagree.

    claims: keys and the fields as columns; heads: chain_heads with ``head`` a struct of the fields. A field null in the head is not
    compared. Under a withheld head a difference in an enumerated field, or in one that carries a scrub marker (the text
    itself only if it agrees but for marked tokens), cannot be verified and is no failure. Claims without head have no row.
    """
    joined = claims.join(heads, keys)

    def state(f: str) -> Column:
        mine, head = F.col(f), F.col("head")[f]
        differs = head.isNotNull() & ~mine.eqNullSafe(head)
        marked = has_marker(mine) & (F.lit(f != text_field) | without_markers(mine).eqNullSafe(without_markers(head)))
        excused = F.col("head_withheld") & (F.lit(f in enums) | marked)
        return F.struct(F.lit(f).alias("f"), differs.alias("d"), excused.alias("e"))

    states = F.array(*[state(f) for f in fields])
    names = lambda keep: F.transform(F.filter("_s", keep), lambda x: x["f"])
    out = joined.withColumn("_s", states)
    return out.select(*keys, "head_revision", "head_withheld", names(lambda x: x["d"] & ~x["e"]).alias("differing"), names(lambda x: x["d"] & x["e"]).alias("unverifiable"))


def revision_edges(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, revision, was_revision_of): an edge to the number before where that revision is there."""
    w = W.partitionBy(*keys).orderBy("revision")
    own = revisions.select(*keys, "revision").distinct().withColumn("_b", F.lag("revision").over(w))
    return own.where("_b = revision - 1").select(*keys, "revision", F.col("_b").alias("was_revision_of"))


# ---------------------------------------------------------------- groups of records


def group_digest(df: DataFrame, keys: list[str], order: list[str], text: Column) -> DataFrame:
    """(keys, n, digest): digest over the texts of a group in a fixed order, whatever the layout of the table.

    Texts are hashed first, so that a group holds 64 characters a row; rows with equal order are put in order of their hash.
    """
    rows = df.select(*keys, F.struct(*[F.col(o) for o in order], F.sha2(text, 256).alias("_h")).alias("_x"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_h"]), ",").alias("_t")).select(*keys, "n", digest_text(F.col("_t")).alias("digest"))


def in_canonical_order(items: Column, key) -> Column:
    """True where an array stands in the order of its keys without repeats."""
    keys = F.transform(items, key)
    return F.coalesce(keys == F.array_sort(F.array_distinct(keys)), F.lit(True))


def coverage(records: DataFrame, keys: list[str], record_id: str, verified: str, withheld: str | None = None) -> DataFrame:
    """(keys, records_verified, records_total, unverifiable_ids[, withheld_ids]) with sorted distinct ids."""
    ok = F.coalesce(F.col(verified), F.lit(False))
    aggs = [F.count_if(ok).alias("records_verified"), F.count("*").alias("records_total"), F.array_sort(F.collect_set(F.when(~ok, F.col(record_id)))).alias("unverifiable_ids")]
    if withheld:
        aggs.append(F.array_sort(F.collect_set(F.when(~ok & F.col(withheld), F.col(record_id)))).alias("withheld_ids"))
    return records.groupBy(*keys).agg(*aggs)


def call_groups(runs: DataFrame, run: str, call: str, ok: str, output: str) -> DataFrame:
    """(call_id, n_runs, failed, output_digest): runs of one call; failed if any is not ok; the output of the first run by id that has one."""
    return runs.groupBy(F.coalesce(call, run).alias("call_id")).agg(
        F.count("*").alias("n_runs"), F.bool_or(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"), F.min_by(output, F.when(F.col(output).isNotNull(), F.col(run))).alias("output_digest")
    )


def cited_seals(revisions: DataFrame) -> DataFrame:
    """(run_id, digests): distinct seals that JSON content cites in evidence_seals; content that is no object cites none."""
    seals = F.from_json(F.get_json_object("content", "$.evidence_seals"), "map<string,string>")
    rows = revisions.select(F.explode(seals).alias("run_id", "digest")).where("digest is not null")
    return rows.groupBy("run_id").agg(F.array_sort(F.collect_set("digest")).alias("digests"))


def anchor_conflicts(withheld: DataFrame, cited: DataFrame) -> DataFrame:
    """Rows (run_id, record_digest, digests) of withheld runs whose citations are not exactly their own digest."""
    return withheld.join(cited, "run_id").where("not (digests <=> array(record_digest))").select("run_id", "record_digest", "digests")


def set_difference(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows of only one side, with ``side`` declared or derived; equal sets give none. Null-safe, columns of the first."""
    cols = declared.columns
    a, b = declared.distinct(), derived.select(*cols).distinct()
    return a.subtract(b).withColumn("side", F.lit("declared")).unionByName(b.subtract(a).withColumn("side", F.lit("derived")))


def derived_gates(runs: DataFrame, codes: tuple[str, ...], code: str, bound: str) -> DataFrame:
    """(run_id, code, outcome) of runs bound to their sealed body whose error summary is an allowed code."""
    return runs.where(F.col(bound) & F.col(code).isin(*codes)).select("run_id", F.col(code).alias("code"), F.when(F.col("status").isin(*GATE_OUTCOMES), F.col("status")).otherwise("error").alias("outcome")).distinct()


def contained(pointers: DataFrame, bodies: DataFrame, on: list[str], tokens: str = "tokens") -> DataFrame:
    """Pointers (on, tokens) that lie inside a body (on, tokens) of the same file: the body's tokens begin the pointer's.

    Every prefix of a pointer is looked up by equality, so no two lists are compared pair by pair.
    """
    rows = pointers.withColumn("_id", F.monotonically_increasing_id())
    prefixes = rows.select("_id", *on, F.explode(F.transform(F.sequence(F.lit(0), F.size(tokens)), lambda n: F.slice(F.col(tokens), F.lit(1), n))).alias(tokens))
    hit = prefixes.join(bodies.select(*on, tokens).distinct(), [*on, tokens], "left_semi").select("_id").distinct()
    return rows.join(hit, "_id", "left_semi").drop("_id")
