"""Evidence graphs as two tables, and the rules a graph must keep, each a DataFrame of findings.

entities(crate, id, body): body is the entity's JSON text. From it come types(crate, id, type) and
edges(crate, src, prop, dst). Many crates are checked at once; a rule is a filter, an anti-join or a having.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealwork.constants import ACTION_TYPES, CLAIM_BASES, CRATE_FILE
from sealwork.functions.canon import canonical_json, is_hex64
from sealwork.functions.text import has_local_path, is_iso_date, replay_rank

FINDING = ["crate", "rule", "severity", "entity", "message"]
_OPEN = "crate string, id string, body string"
SCHEMA_ORG = "http://schema.org/"


def as_list(value: Column) -> Column:
    """Elements (JSON text) of a JSON value; a lone value is a list of one, null an empty list."""
    t = F.trim(value)
    wrapped = F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]")))
    return F.coalesce(F.from_json(F.when(t.isNotNull() & (t != "null"), wrapped), "array<string>"), F.expr("cast(array() as array<string>)"))


@dataclass
class Graph:
    """Entities with their members, types and references."""

    entities: DataFrame
    members: DataFrame
    types: DataFrame
    edges: DataFrame


def read_graph(entities: DataFrame) -> Graph:
    """entities: crate, id, body. Members are (crate, id, key, value), value as JSON text, a string as itself."""
    good = entities.where("id is not null")
    raw = good.select("crate", "id", F.from_json("body", "map<string,string>").alias("m"))
    members = raw.select("crate", "id", F.explode("m").alias("key", "value")).where("value is not null")
    items = members.where("key not like '@%'").select("crate", F.col("id").alias("src"), F.col("key").alias("prop"), F.explode(as_list(F.when(F.ltrim("value").rlike(r"^[\[{]"), F.col("value")))).alias("item"))
    edges = items.select("crate", "src", "prop", F.get_json_object("item", "$['@id']").alias("dst"), F.size(F.json_object_keys("item")).alias("keys"))
    kinds = F.when(F.ltrim(F.col("value")).startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    types = members.where("key = '@type'").select("crate", "id", F.explode(kinds).alias("type")).distinct()
    return Graph(good, members, types, edges)


def _found(df: DataFrame, rule: str, message: str | Column, severity: str = "error", entity: str | None = "id") -> DataFrame:
    return df.select("crate", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.col(entity) if entity else F.lit(None).cast("string")).alias("entity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _of_type(g: Graph, *names: str) -> DataFrame:
    return g.types.where(F.col("type").isin(*names)).select("crate", "id").distinct()


def _value(g: Graph, key: str, name: str) -> DataFrame:
    return g.members.where(F.col("key") == key).select("crate", "id", F.col("value").alias(name))


def _targets(g: Graph, prop: str) -> DataFrame:
    return g.edges.where((F.col("prop") == prop) & F.col("dst").isNotNull()).select("crate", "src", F.col("dst").alias("id"))


def roots(g: Graph) -> DataFrame:
    """(crate, id) of the root that a crate's descriptor is about; ``./`` where there is no descriptor."""
    about = _targets(g, "about").where(F.col("src") == CRATE_FILE).select("crate", F.col("id").alias("_r"))
    return g.entities.select("crate").distinct().join(about, "crate", "left").select("crate", F.coalesce("_r", F.lit("./")).alias("id"))


def duplicate_ids(g: Graph) -> DataFrame:
    return _found(g.entities.groupBy("crate", "id").count().where("count > 1"), "RC-ID-UNIQUE", "id defined more than once")


def conflicting_ids(g: Graph) -> DataFrame:
    """Ids defined more than once with different content; equal content in another key order is no conflict."""
    text = g.entities.select("crate", "id", canonical_json(F.col("body"))["text"].alias("t"))
    return _found(text.groupBy("crate", "id").agg(F.count_distinct("t").alias("n")).where("n > 1"), "RC-ID-CONFLICT", "definitions differ")


def nested_objects(g: Graph) -> DataFrame:
    bad = g.edges.where("keys is not null and (keys <> 1 or dst is null)").select("crate", F.col("src").alias("id"), "prop").distinct()
    return _found(bad, "RC-FLAT", F.concat(F.lit("embedded object in "), F.col("prop")))


def dangling_references(g: Graph) -> DataFrame:
    """References to ids that the crate does not define and that are no web addresses."""
    refs = g.edges.where("dst is not null and keys = 1").where(~F.col("dst").rlike("^https?://")).select("crate", F.col("src").alias("by"), "prop", F.col("dst").alias("id"))
    lost = refs.join(g.entities.select("crate", "id"), ["crate", "id"], "left_anti")
    return _found(lost, "RC-REF-RESOLVE", F.concat("prop", F.lit(" -> "), "id"), entity="by")


def descriptor_rules(g: Graph, spec: str) -> DataFrame:
    crates = g.entities.select("crate").distinct()
    there = _of_type(g, "CreativeWork").where(F.col("id") == CRATE_FILE)
    missing = _found(crates.join(there, "crate", "left_anti"), "RC-DESCRIPTOR", "no metadata descriptor of type CreativeWork", entity=None)
    about = _targets(g, "about").where(F.col("src") == CRATE_FILE)
    unrooted = _found(there.join(about.select("crate"), "crate", "left_anti"), "RC-DESCRIPTOR", "descriptor is about nothing")
    conforms = _targets(g, "conformsTo").where((F.col("src") == CRATE_FILE) & (F.col("id") == spec))
    other = _found(there.join(conforms.select("crate"), "crate", "left_anti"), "RC-DESCRIPTOR", "descriptor conforms to another specification")
    return missing.unionByName(unrooted).unionByName(other)


def root_rules(g: Graph, profile: str, notice: str) -> DataFrame:
    root = roots(g)
    typed = root.join(_of_type(g, "Dataset"), ["crate", "id"], "left_semi")
    out = _found(root.join(typed, ["crate", "id"], "left_anti"), "RC-ROOT", "root must be a Dataset")
    date = typed.join(_value(g, "datePublished", "v"), ["crate", "id"], "left")
    out = out.unionByName(_found(date.where(~is_iso_date(F.col("v"))), "RC-ROOT", "datePublished must be an ISO date"))
    for name in ("name", "description", "license"):
        lacking = typed.join(_value(g, name, "v"), ["crate", "id"], "left_anti")
        out = out.unionByName(_found(lacking, "RC-ROOT", f"root should have {name}", "warning"))
    conforms = typed.join(_targets(g, "conformsTo").withColumnRenamed("id", "to").withColumnRenamed("src", "id"), ["crate", "id"])
    out = out.unionByName(_found(typed.join(conforms.where(F.col("to") == profile).select("crate"), "crate", "left_anti"), "PRC-ACTION", "root must conform to the process-run profile"))
    sound = _of_type(g, "Profile").join(_value(g, "name", "a"), ["crate", "id"], "left_semi").join(_value(g, "version", "b"), ["crate", "id"], "left_semi").select("crate", F.col("id").alias("to"))
    out = out.unionByName(_found(conforms.join(sound, ["crate", "to"], "left_anti"), "RC-PROFILE", F.concat(F.lit("no named, versioned profile "), "to")))
    told = typed.join(_value(g, "description", "v").where(F.col("v").contains(notice)), ["crate", "id"], "left_anti")
    return out.unionByName(_found(told, "HON-NOT-ORIGIN", "the description must state that integrity is not origin"))


def file_rules(g: Graph) -> DataFrame:
    files = _of_type(g, "File")
    odd = F.col("id").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | F.col("id").startswith("/") | F.array_contains(F.split("id", "/"), "..") | F.col("id").rlike(r"[\s\\]")
    out = _found(files.where(odd), "RC-FILE", "a file's id must be a relative, encoded path")
    sha = files.join(_value(g, "sha256", "v"), ["crate", "id"], "left")
    out = out.unionByName(_found(sha.where(~is_hex64(F.col("v"))), "RC-FILE", "sha256 must be 64 small hex digits"))
    size = files.join(_value(g, "contentSize", "v"), ["crate", "id"], "left")
    out = out.unionByName(_found(size.where(~F.coalesce(F.col("v").rlike("^[0-9]+$"), F.lit(False))), "RC-FILE", "contentSize must be a decimal text"))
    parts = roots(g).withColumnRenamed("id", "src").join(_targets(g, "hasPart"), ["crate", "src"]).select("crate", "id").distinct()
    out = out.unionByName(_found(files.join(parts, ["crate", "id"], "left_anti"), "RC-HASPART", "file is no part of the root"))
    others = parts.join(g.entities.select("crate", "id"), ["crate", "id"], "left_semi").join(_of_type(g, "File", "Dataset"), ["crate", "id"], "left_anti")
    return out.unionByName(_found(others, "RC-HASPART", "a part is neither file nor dataset"))


def term_rules(g: Graph, prefix: str, namespace: str) -> DataFrame:
    """Every used term of the own vocabulary is defined in the graph, as a property with name, description, label and comment."""
    used = g.members.where(F.col("key").startswith(prefix)).select("crate", F.col("key").alias("term")).distinct()
    used = used.withColumn("id", F.concat(F.lit(namespace), F.expr(f"substring(term, {len(prefix) + 1})")))
    out = _found(used.join(g.entities.select("crate", "id"), ["crate", "id"], "left_anti"), "RC-TERM-DEFINED", F.concat("term", F.lit(" is not defined")), entity=None)
    full = _of_type(g, "rdf:Property")
    for key in ("name", "description", "rdfs:label", "rdfs:comment"):
        full = full.join(_value(g, key, "v").where("v <> ''"), ["crate", "id"], "left_semi")
    half = used.join(g.entities.select("crate", "id"), ["crate", "id"], "left_semi").join(full, ["crate", "id"], "left_anti")
    return out.unionByName(_found(half, "RC-TERM-DEFINED", F.concat("term", F.lit(" is defined in part only"))))


def context_rules(contexts: DataFrame, g: Graph, first: str, barred: str) -> DataFrame:
    """contexts: crate, position, term (of inline objects), iri. The first entry is the standard context, a barred one is not added, compact keys are defined."""
    crates = g.entities.select("crate").distinct()
    out = _found(crates.join(contexts.where((F.col("position") == 0) & (F.col("iri") == first)).select("crate"), "crate", "left_anti"), "RC-CONTEXT", "the first context must be the standard one", entity=None)
    out = out.unionByName(_found(contexts.where(F.col("term").isNull() & F.col("iri").contains(barred)).select("crate").distinct(), "RC-CONTEXT", "a context that redefines sha256 was added", entity=None))
    keys = g.members.where("key like '%:%' and key not like '@%'").select("crate", F.col("key").alias("term")).distinct()
    return out.unionByName(_found(keys.join(contexts.where("term is not null").select("crate", "term"), ["crate", "term"], "left_anti"), "RC-CONTEXT-RESOLVE", F.concat("term", F.lit(" is no term of the context")), entity=None))


def action_rules(g: Graph) -> DataFrame:
    actions = _of_type(g, *ACTION_TYPES)
    root = roots(g).withColumnRenamed("id", "src")
    listed = root.join(_targets(g, "mentions"), ["crate", "src"]).select("crate", "id")
    out = _found(actions.join(listed, ["crate", "id"], "left_anti"), "PRC-ACTION", "action is not mentioned by the root", "warning")
    tools = _targets(g, "instrument").withColumnRenamed("id", "tool").withColumnRenamed("src", "id")
    out = out.unionByName(_found(actions.join(tools.select("crate", "id"), ["crate", "id"], "left_anti"), "PRC-INSTRUMENT", "an action needs an instrument"))

    def wrong_kind(prop: str, kinds: tuple[str, ...], rule: str, message: str) -> DataFrame:
        to = actions.join(_targets(g, prop).withColumnRenamed("id", "to").withColumnRenamed("src", "id"), ["crate", "id"])
        there = g.entities.select("crate", F.col("id").alias("to")).distinct()
        right = _of_type(g, *kinds).withColumnRenamed("id", "to")
        return _found(to.join(there, ["crate", "to"], "left_semi").join(right, ["crate", "to"], "left_anti"), rule, message)

    out = out.unionByName(wrong_kind("instrument", ("SoftwareApplication", "SoftwareSourceCode", "ComputationalWorkflow"), "PRC-INSTRUMENT", "instrument must be software"))
    out = out.unionByName(wrong_kind("agent", ("Person", "Organization"), "PRC-ACTION", "agent must be a person or organization"))
    informed = actions.join(_targets(g, "prov:wasInformedBy").withColumnRenamed("id", "to").withColumnRenamed("src", "id"), ["crate", "id"])
    out = out.unionByName(_found(informed.join(actions.withColumnRenamed("id", "to"), ["crate", "to"], "left_anti"), "PROV-DOMAIN", "wasInformedBy must name an action"))
    status = actions.join(_value(g, "actionStatus", "s"), ["crate", "id"], "left").join(_value(g, "error", "e"), ["crate", "id"], "left")
    failed = F.lit(SCHEMA_ORG + "FailedActionStatus")
    out = out.unionByName(_found(status.where(F.col("s").isNotNull() & ~F.col("s").isin(SCHEMA_ORG + "FailedActionStatus", SCHEMA_ORG + "CompletedActionStatus")), "PRC-ACTION", "status is neither completed nor failed"))
    return out.unionByName(_found(status.where(F.col("e").isNotNull() & ~F.col("s").eqNullSafe(failed)), "PRC-ACTION", "an error needs a failed status"))


def software_rules(g: Graph) -> DataFrame:
    soft = _of_type(g, "SoftwareApplication").join(_value(g, "url", "u"), ["crate", "id"], "left").join(_value(g, "version", "a"), ["crate", "id"], "left").join(_value(g, "softwareVersion", "b"), ["crate", "id"], "left")
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    out = _found(soft.where(blank("u")), "RC-SOFTWARE-URL", "software needs a url")
    out = out.unionByName(_found(soft.where(blank("a") & blank("b")), "RC-SOFTWARE-VERSION", "software needs a version"))
    return out.unionByName(_found(soft.where("a is not null and b is not null"), "PRC-ACTION", "software has two kinds of version"))


def claim_rules(g: Graph, prefix: str) -> DataFrame:
    """A claim states its basis and carries what that basis needs; what it derives from is a statistic that some action gave."""
    claims = _of_type(g, "Claim")
    props = _targets(g, "additionalProperty").withColumnRenamed("id", "p").withColumnRenamed("src", "id")
    basis = _value(g, "propertyID", "v").where("v = 'claimBasis'").select("crate", F.col("id").alias("p")).join(_value(g, "value", "basis").withColumnRenamed("id", "p"), ["crate", "p"])
    stated = claims.join(props.join(basis, ["crate", "p"]).groupBy("crate", "id").agg(F.min("basis").alias("basis")), ["crate", "id"], "left")
    stated = stated.join(_value(g, prefix + "recordDigest", "d"), ["crate", "id"], "left").join(_value(g, prefix + "recordLocation", "l"), ["crate", "id"], "left").join(_value(g, "name", "n"), ["crate", "id"], "left")
    sealed = F.col("basis") == CLAIM_BASES[0]
    message = (
        F.when(~F.coalesce(F.col("basis").isin(*CLAIM_BASES), F.lit(False)), "no basis is stated").when(sealed & (F.col("d").isNull() | F.col("l").isNull()), "a sealed basis needs digest and location")
        .when(~sealed & F.col("d").isNotNull(), "a working view carries no seal").when(~sealed & ~F.coalesce(F.lower("n").contains("working view, unsealed"), F.lit(False)), "a working view must say so in its name")
    )
    out = _found(stated.withColumn("message", message).where("message is not null"), "CLM-BASIS", F.col("message"))
    derived = claims.join(_targets(g, "prov:wasDerivedFrom").withColumnRenamed("id", "to").withColumnRenamed("src", "id"), ["crate", "id"])
    there = g.entities.select("crate", F.col("id").alias("to")).distinct()
    values = _of_type(g, "PropertyValue").withColumnRenamed("id", "to")
    wrong = derived.join(there, ["crate", "to"], "left_semi").join(values, ["crate", "to"], "left_anti")
    out = out.unionByName(_found(wrong, "PROV-DOMAIN", "wasDerivedFrom must name a statistic"))
    results = _of_type(g, *ACTION_TYPES).withColumnRenamed("id", "src").join(_targets(g, "result"), ["crate", "src"]).select("crate", F.col("id").alias("to"))
    right = derived.join(wrong, ["crate", "id", "to"], "left_anti")
    return out.unionByName(_found(right.join(results, ["crate", "to"], "left_anti"), "PROV-STAT-RESULT", "the statistic is no result of an action"))


def replay_rules(g: Graph, prefix: str, recomputation: str, crosscheck: str) -> DataFrame:
    """The stated level of replay: present, assessed exactly once with all its values, not above its ceilings, and shown by an entity where it claims recomputation."""
    root = roots(g).join(_value(g, prefix + "replayStatus", "level"), ["crate", "id"], "left")
    out = _found(root.where(replay_rank(F.col("level")).isNull()), "HON-REPLAY-PRESENT", "the root states no known level")
    assess = _of_type(g, "AssessAction")
    n = root.select("crate", "id").join(assess.groupBy("crate").agg(F.count("*").alias("n"), F.min("id").alias("a")), "crate", "left")
    out = out.unionByName(_found(n.where("coalesce(n, 0) <> 1"), "HON-REPLAY-ASSESS", "exactly one assessment is needed"))
    single = n.where("n = 1").select("crate", "id", "a")
    about = _targets(g, "object").select("crate", F.col("src").alias("a"), "id")
    out = out.unionByName(_found(single.join(about, ["crate", "a", "id"], "left_anti"), "HON-REPLAY-ASSESS", "the assessment is not about the root"))
    got = single.join(_targets(g, "result").select("crate", F.col("src").alias("a"), F.col("id").alias("p")), ["crate", "a"])
    got = got.join(_value(g, "propertyID", "prop").withColumnRenamed("id", "p"), ["crate", "p"]).join(_value(g, "value", "v").withColumnRenamed("id", "p"), ["crate", "p"], "left")
    got = got.join(_value(g, "maxValue", "most").withColumnRenamed("id", "p"), ["crate", "p"], "left").join(_value(g, "description", "says").withColumnRenamed("id", "p"), ["crate", "p"], "left")
    pick = lambda prop, c: F.max(F.when(F.col("prop") == prop, F.col(c)))
    said = got.groupBy("crate", "id", "a").agg(
        F.collect_set("prop").alias("props"), *[pick(p, "v").alias(p) for p in ("replayStatus", "manifestStatus", "checkedStatus", "records_verified", "legacy_no_record", "unbound")], pick("records_verified", "most").alias("most"), pick("records_verified", "says").alias("says")
    )
    said = single.join(said, ["crate", "id", "a"], "left").join(root, ["crate", "id"]).join(_value(g, "description", "action_says").withColumnRenamed("id", "a"), ["crate", "a"], "left")
    needs = F.array_except(F.array(*map(F.lit, ("replayStatus", "manifestStatus", "checkedStatus", "records_verified"))), F.coalesce("props", F.expr("cast(array() as array<string>)")))
    lacking = said.select("crate", F.col("a").alias("id"), F.explode(needs).alias("need"))
    out = out.unionByName(_found(lacking, "HON-REPLAY-ASSESS", F.concat(F.lit("no value of "), "need")))
    rank = replay_rank(F.col("level"))
    out = out.unionByName(_found(said.where(F.col("replayStatus").isNotNull() & (F.col("replayStatus") != F.col("level"))), "HON-REPLAY-LEVEL", "root and assessment disagree"))
    for cap in ("manifestStatus", "checkedStatus"):
        out = out.unionByName(_found(said.where(F.col("replayStatus").isNotNull() & (rank > replay_rank(F.col(cap)))), "HON-REPLAY-LEVEL", f"the level exceeds {cap}"))
    kinds = g.members.where("key = 'additionalType'").select("crate", F.col("value").alias("t"))
    shown = lambda *names: kinds.where(reduce(lambda a, b: a | b, [F.col("t").contains(x) for x in names])).select("crate").distinct()
    stated = root.join(said.select("crate", "manifestStatus", "checkedStatus"), "crate", "left")
    over = F.coalesce(F.greatest(rank, replay_rank(F.col("manifestStatus")), replay_rank(F.col("checkedStatus"))), F.lit(0)) >= replay_rank(F.lit("recomputed"))
    out = out.unionByName(_found(stated.where(over).join(shown(recomputation), "crate", "left_anti"), "HON-RECOMPUTED", "no entity shows the recomputation"))
    out = out.unionByName(_found(root.where(rank >= replay_rank(F.lit("cross_check"))).join(shown(crosscheck, recomputation), "crate", "left_anti"), "HON-CROSSCHECK", "no entity shows the cross-check"))
    checked = said.where(rank >= replay_rank(F.lit("archive_integrity")))
    v, most = F.col("records_verified").try_cast("bigint"), F.col("most").try_cast("bigint")
    text = F.lower(F.concat_ws(" ", "action_says", "says"))
    loose = F.coalesce(F.col("legacy_no_record").try_cast("bigint"), F.lit(0)) + F.coalesce(F.col("unbound").try_cast("bigint"), F.lit(0))
    out = out.unionByName(_found(checked.where(v.isNull() | most.isNull()), "HON-COVERAGE", "coverage is not stated"))
    out = out.unionByName(_found(checked.where(v.isNotNull() & most.isNotNull() & (loose > 0) & ~text.contains("unsealed")), "HON-COVERAGE", "unsealed rows are not told"))
    return out.unionByName(_found(checked.where((v < most) & ~text.contains("partial")), "HON-COVERAGE", "partial coverage is not told"))


def privacy_rules(g: Graph) -> DataFrame:
    """No absolute or file ids, and no local path in any key or value, however deep (the JSON text is searched, escapes undone)."""
    out = _found(g.entities.where(F.col("id").startswith("/") | F.col("id").startswith("file:")), "PRIV-PATH", "absolute id")
    text = F.replace(F.col("value"), F.lit("\\\\"), F.lit("\\"))
    bad = g.members.where("key <> '@id'").where(has_local_path(F.col("key")) | has_local_path(text)).select("crate", "id").distinct()
    return out.unionByName(_found(bad, "PRIV-PATH", "local path in a value"))


def validate(entities: DataFrame, contexts: DataFrame, *, context: str, barred: str, spec: str, profile: str, prefix: str, namespace: str, notice: str, recomputation: str, crosscheck: str) -> DataFrame:
    """All findings (crate, rule, severity, entity, message) of crates given as entities(crate, id, body) and contexts(crate, position, term, iri).

    Entities without id are findings of RC-FLAT, unreadable bodies of RC-JSON.
    """
    g = read_graph(entities)
    unread = _found(entities.where(F.from_json("body", "map<string,string>").isNull()), "RC-JSON", "unreadable entity")
    no_id = _found(entities.where("id is null"), "RC-FLAT", "an entity needs an id")
    parts = [
        no_id, context_rules(contexts, g, context, barred), duplicate_ids(g), nested_objects(g), dangling_references(g), descriptor_rules(g, spec), root_rules(g, profile, notice), file_rules(g),
        term_rules(g, prefix, namespace), action_rules(g), software_rules(g), claim_rules(g, prefix), replay_rules(g, prefix, recomputation, crosscheck), privacy_rules(g),
    ]
    return reduce(DataFrame.unionByName, parts, unread).distinct()
