"""Schemas that drift between files (problem 1).

Each file gets a profile: for every field its type and the kind of its values. A file's fingerprint is the hash of its
(field, type) pairs; runs of files with one fingerprint are a version. Where the fingerprint changes, the two profiles are compared;
the changes are the migration steps (rename, default for what came or went, cast for what was retyped) through which every
line is routed into one table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINES_PER_PART = 256
VOCABULARY_BUCKETS = 64
#: Shapes of long text are told by so many hashes, which bounds a file's profile.
SHAPE_BUCKETS = 1024
LONG_SHAPE = 40
SAME_KIND = 0.3

_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGITS = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_AGAIN = re.compile(r"(.{1,3}?)\1{1,}")


def type_name(v: object) -> str:
    """The type of a JSON value that is not null."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "fractional"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def kind_tokens(v: object) -> list[str]:
    """Tokens whose distribution over a field tells the kind of its values: shapes of text, sign and size of numbers, members of objects."""
    if v is None:
        return ["null"]
    if isinstance(v, bool):
        return ["bool"]
    if isinstance(v, (int, float)):
        a = abs(v)
        size = "unit" if isinstance(v, float) and a < 1 else "small" if a < 10 else "medium" if a < 100 else "large"
        return [("neg " if v < 0 else "pos ") + size]
    if isinstance(v, str):
        shape = _AGAIN.sub(r"\1\1", _LETTERS.sub("a", _DIGITS.sub("9", _HEX.sub("#", v))))
        if len(shape) > LONG_SHAPE:  # of long text, which characters its whole shape is made of
            shape = "long " + "".join(sorted(set(shape)))
        if len(shape) > 8:
            shape = f"shape {zlib.crc32(shape.encode("utf-8", "replace")) % SHAPE_BUCKETS}"
        word = f"word {zlib.crc32(v.encode("utf-8", "replace")) % VOCABULARY_BUCKETS}" if shape == "a" else ""
        return [word or "text " + (shape if shape.isascii() else encodable(shape))]
    if isinstance(v, list):
        return ["in " + t for x in v for t in kind_tokens(x)] or ["in nothing"]
    return [f"members {zlib.crc32(','.join(sorted(map(str, v))).encode('utf-8', 'replace')) % SHAPE_BUCKETS}"]


def fields_of(payload: str | None) -> dict[str, object] | None:
    """Members of a line, those of extra as extra.name; None if the line is no JSON object. A lone surrogate in a name is written as its escape."""
    try:
        v = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(v, dict):
        return None
    out = {k: x for k, x in v.items() if k != "extra" and x is not None}
    if isinstance(v.get("extra"), dict):
        out |= {f"extra.{k}": x for k, x in v["extra"].items() if x is not None}
    return out if all(map(str.isascii, out)) else {encodable(k): x for k, x in out.items()}


def encodable(s: str) -> str:
    return s.encode("utf-8", "backslashreplace").decode("utf-8")


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n: Counter = Counter()
        for s, f, p in zip(pdf["stream"], pdf["file_id"], pdf["payload"]):
            for field, v in (fields_of(p) or {}).items():
                kind = type_name(v)
                n[s, f, field, kind, ""] += 1
                for t in kind_tokens(v):
                    n[s, f, field, kind, t] += 1
        rows = [(*k, c) for k, c in n.items()]
        yield pd.DataFrame(rows, columns=["stream", "file_id", "field", "type", "token", "n"])


def lines(raw: DataFrame) -> DataFrame:
    """Distinct lines, laid out so that parts of a file lie together but no file in one task. Rows without stream or file are left out."""
    return (
        raw.select("stream", "file_id", "written_at", "line_no", "payload")
        .where("stream is not null and file_id is not null")
        .withColumn("_part", F.floor(F.coalesce("line_no", F.lit(0)) / LINES_PER_PART))
        .repartition("stream", "file_id", "_part")
        .dropDuplicates(["stream", "file_id", "_part", "line_no", "payload"])
    )


def file_profiles(raw: DataFrame) -> DataFrame:
    """(stream, file_id, seq, written_at, profile, fingerprint): one row per file, in the order of written_at.

    profile is an array of (field, type, tokens, types). The type is that of most values; ties go to the first name.
    Only file rows are windowed by stream, lines never.
    """
    own = lines(raw)
    counts = (
        own.mapInPandas(_profiles, "stream string, file_id string, field string, type string, token string, n bigint")
        .groupBy("stream", "file_id", "field", "type", "token").agg(F.sum("n").alias("n"))
    )
    by_type = counts.groupBy("stream", "file_id", "field", "type").agg(
        F.sum(F.when(F.col("token") == "", F.col("n"))).alias("n"),
        F.map_from_entries(F.collect_list(F.when(F.col("token") != "", F.struct("token", "n")))).alias("tokens"),
    )
    best = by_type.groupBy("stream", "file_id", "field").agg(F.min(F.struct(-F.col("n"), "type")).alias("m"), F.collect_list(F.struct("type", "tokens")).alias("all"))
    profile = best.groupBy("stream", "file_id").agg(
        F.array_sort(F.collect_list(F.struct("field", F.col("m.type").alias("type"), F.to_json(F.expr("filter(all, x -> x.type = m.type)[0].tokens")).alias("tokens"), F.array_sort(F.transform("all", lambda x: x["type"])).alias("types")))).alias("profile")
    )
    order = W.partitionBy("stream").orderBy("written_at", "file_id")
    files = raw.where("stream is not null and file_id is not null").groupBy("stream", "file_id").agg(F.min("written_at").alias("written_at"))
    files = files.withColumn("seq", F.row_number().over(order))
    pairs = F.transform("profile", lambda x: F.concat_ws("\x1f", x["field"], x["type"]))
    return files.join(profile, ["stream", "file_id"], "left").withColumn("fingerprint", F.sha2(F.concat_ws("\x1e", pairs), 256))


def _kind(tokens: dict[str, int]) -> tuple[bool, str]:
    total = sum(tokens.values()) or 1
    sizes: Counter = Counter()
    for t, n in tokens.items():
        sizes[t.split()[-1]] += n
    return sum(n for t, n in tokens.items() if "neg " in t) / total >= 0.1, sizes.most_common(1)[0][0] if sizes else ""


def same_kind(kind: str, a: dict[str, int], b: dict[str, int]) -> float:
    """How alike two fields' values are, 0 if they are of different kinds."""
    if kind == "boolean":
        return 1.0
    numeric = all(t.removeprefix("in ").startswith(("neg ", "pos ")) for t in (*a, *b))
    if numeric and a and b:
        return 1.0 if _kind(a) == _kind(b) else 0.0
    x, y = sum(a.values()) or 1, sum(b.values()) or 1
    score = sum(min(a[t] / x, b[t] / y) for t in a.keys() & b.keys())
    words = sum(min(sum(n for t, n in d.items() if "word " in t) / s for d, s in ((a, x), (b, y))) for _ in (0,))
    return score if score >= SAME_KIND else max(score, 0.3) if words > 0.5 and score > 0 else 0.0


def _plain(name: str) -> str:
    name = name.removeprefix("extra.").lower()
    return re.sub(r"[^a-z0-9]", "", re.sub(r"^x_|_v\d+$", "", name))


def name_likeness(a: str, b: str) -> float:
    p, q = _plain(a), _plain(b)
    if p == q or sorted(re.split(r"[^a-z0-9]+", a.lower())) == sorted(re.split(r"[^a-z0-9]+", b.lower())):
        return 1.0
    return SequenceMatcher(None, p, q, autojunk=False).ratio()


def changes_between(old: list[tuple[str, str, dict[str, int]]], new: list[tuple[str, str, dict[str, int]]]) -> list[tuple[str, str, str]]:
    """(change, field, detail) that lead from one file's profile to the next one's."""
    was, now = {f: (t, k) for f, t, k in old}, {f: (t, k) for f, t, k in new}
    gone, come = sorted(was.keys() - now.keys()), sorted(now.keys() - was.keys())
    pairs = []
    for g in gone:
        for c in come:
            if was[g][0] == now[c][0] and (s := same_kind(was[g][0], was[g][1], now[c][1])) > 0:
                pairs.append((-name_likeness(g, c), -s, g, c))
    renamed: dict[str, str] = {}
    for _, _, g, c in sorted(pairs):
        if g not in renamed and c not in renamed.values():
            renamed[g] = c
    out = [("renamed", g, c) for g, c in renamed.items()]
    out += [("removed", g, "") for g in gone if g not in renamed]
    out += [("added", c, "") for c in come if c not in renamed.values()]
    return out + [("retyped", f, now[f][0]) for f in sorted(was.keys() & now.keys()) if was[f][0] != now[f][0]]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def read(x: object) -> list[tuple[str, str, dict[str, int]]]:
        return [(r["field"], r["type"], json.loads(r["tokens"] or "{}")) for r in x] if x is not None else []

    for pdf in batches:
        rows = []
        for s, f, seq, a, b in zip(pdf["stream"], pdf["file_id"], pdf["seq"], pdf["before"], pdf["profile"]):
            rows += [(s, f, seq, *c) for c in changes_between(read(a), read(b))]
        yield pd.DataFrame(rows, columns=["stream", "file_id", "seq", "change", "field", "detail"])


def schema_changes(profiles: DataFrame) -> DataFrame:
    """(stream, file_id, seq, change, field, detail) of every file against the one before it in its stream; the first file has none.

    Fields are told apart by exact name. A file without readable lines has no fields, so all end there and begin again after it.
    """
    before = profiles.select("stream", (F.col("seq") + 1).alias("seq"), F.col("profile").alias("before"), F.col("fingerprint").alias("was"))
    changed = profiles.select("stream", "file_id", "seq", "profile", "fingerprint").join(before, ["stream", "seq"]).where("not (was <=> fingerprint)")
    return changed.select("stream", "file_id", "seq", "before", "profile").mapInPandas(
        _compare, "stream string, file_id string, seq int, change string, field string, detail string"
    )


def migration_steps(changes: DataFrame) -> DataFrame:
    """(stream, file_id, seq, step, field, target, type): how rows of the file before become rows of this file's schema.

    rename: field to target; cast: field to type; default: a field that came (older rows get null) or went (newer rows get null).
    """
    step = F.when(F.col("change") == "renamed", "rename").when(F.col("change") == "retyped", "cast").otherwise("default")
    return changes.select(
        "stream", "file_id", "seq", step.alias("step"), "field", F.when(F.col("change") == "renamed", F.col("detail")).otherwise(F.col("field")).alias("target"), F.when(F.col("change") == "retyped", F.col("detail")).alias("type")
    )


def _epochs(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each stretch of files between two renames of a stream the newest name of every field renamed later, as JSON.

    One row per stretch: epoch counts the files with renames up to and including a file. Steps are metadata, one row per rename.
    """
    later: dict[str, str] = {}
    parts = sorted(pdf.groupby("seq"), reverse=True)
    rows = [(len(parts), "{}")]
    for i, (_, part) in enumerate(parts):
        step = dict(zip(part["field"], part["target"]))
        # a name that is taken over in this file is another field before it
        later = {k: v for k, v in later.items() if k not in step.values()} | {old: later.get(new, new) for old, new in step.items()}
        rows.append((len(parts) - 1 - i, json.dumps(later)))
    return pd.DataFrame([(pdf["stream"].iloc[0], e, m) for e, m in rows], columns=["stream", "epoch", "names"])


def _cast(v: object, kind: str) -> object:
    """A value in the type that holds all values of its field; nothing is lost: mixed fields are text, single values of arrays stand alone in one."""
    if v is None or type_name(v) == kind:
        return v
    if kind == "array":
        return [v]
    if kind == "fractional" and type_name(v) == "integer":
        return float(v) if abs(v) <= 2**53 else v
    return json.dumps(v, sort_keys=True)


KNOWN = ("schema", "recorded_at", "run_id", "claim_id", "revision", "session_id", "status", "tool", "tool_version", "parents", "content", "cause", "supersedes", "actor_id", "env_digest")


def _text(v: object) -> str | None:
    return None if v is None else encodable(v) if isinstance(v, str) else json.dumps(v, sort_keys=True)


def _route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    routes: dict[tuple, tuple[dict, dict]] = {}
    for pdf in batches:
        rows = []
        for s, f, seq, no, payload, names_text, kinds_text in zip(pdf["stream"], pdf["file_id"], pdf["seq"], pdf["line_no"], pdf["payload"], pdf["names"], pdf["kinds"]):
            own = fields_of(payload)
            if (names_text, kinds_text) not in routes:
                routes.clear()
                routes[names_text, kinds_text] = json.loads(names_text or "{}"), json.loads(kinds_text or "{}")
            names, types = routes[names_text, kinds_text]
            out: dict[str, object] = {}
            cast, clash = [], []
            for k, v in sorted((own or {}).items(), key=lambda kv: (kv[0] in names, kv[0])):
                new = names.get(k, k)
                if new in out:  # an older field beside one that has its name: the one that bears the name counts, the other keeps its own
                    clash.append(k)
                    new = k
                out[new] = _cast(v, types[new]) if new in types else v
                if new in types and type_name(v) != types[new]:
                    cast.append(new)
            known = [_text(out.pop(k, None)) for k in KNOWN]
            rows.append((s, f, seq, no, own is not None, *known, json.dumps(out, sort_keys=True), sorted(cast), clash))
        yield pd.DataFrame(rows, columns=["stream", "file_id", "seq", "line_no", "readable", *KNOWN, "unknown", "casts", "clashes"])


def widest_types(named: DataFrame) -> DataFrame:
    """(stream, name, type) that holds all values of (stream, name, type): fractional over integer, array over single values, else text."""
    of = F.array_sort(F.collect_set("type"))
    numbers = F.array(F.lit("fractional"), F.lit("integer"))
    wide = F.when(F.size("of") == 1, F.col("of")[0]).when(F.col("of") == numbers, "fractional").when(F.array_contains("of", "array"), "array").otherwise("string")
    return named.groupBy("stream", "name").agg(of.alias("of")).select("stream", "name", wide.alias("type"))


def consistent_table(raw: DataFrame, profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Every distinct line under the newest names and types of its stream.

    A line's fields are renamed along the chain of later renames and cast to the type that holds all values of the name in its
    stream, so no cast fails or loses a value (casts lists the fields that were cast); absent fields are null. If two fields of
    a line come to one name, the field that bears it counts and the other keeps its own name (clashes). Unreadable lines stay with
    readable = false. Known fields are columns of text (JSON for arrays and objects), all others members of ``unknown``.
    """
    renames = migration_steps(changes).where("step = 'rename'")
    chain = renames.groupBy("stream").applyInPandas(_epochs, "stream string, epoch int, names string")
    at = renames.select("stream", "seq").distinct().withColumn("_r", F.lit(1))
    files = profiles.select("stream", "file_id", "seq", "profile").join(at, ["stream", "seq"], "left")
    files = files.withColumn("epoch", F.coalesce(F.sum("_r").over(W.partitionBy("stream").orderBy("seq")), F.lit(0)).cast("int"))
    files = files.join(chain, ["stream", "epoch"], "left").select("stream", "file_id", "seq", "profile", F.coalesce("names", F.lit("{}")).alias("names"))
    own = files.select("stream", F.from_json("names", "map<string,string>").alias("m"), F.explode("profile").alias("p"))
    named = own.select("stream", F.coalesce(F.try_element_at("m", F.col("p.field")), F.col("p.field")).alias("name"), F.explode("p.types").alias("type"))
    types = widest_types(named).groupBy("stream").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "type")))).alias("kinds"))
    routes = files.drop("profile").join(types, "stream", "left")
    known = ", ".join(f"`{k}` string" for k in KNOWN)
    return lines(raw).join(routes, ["stream", "file_id"]).select("stream", "file_id", "seq", "line_no", "payload", "names", "kinds").mapInPandas(
        _route, f"stream string, file_id string, seq int, line_no int, readable boolean, {known}, unknown string, casts array<string>, clashes array<string>"
    )


def schema_versions(profiles: DataFrame) -> DataFrame:
    """(stream, version, fingerprint, first_seq, n_files, n_fields): runs of files with the same fingerprint are one version."""
    w = W.partitionBy("stream").orderBy("seq")
    new = F.coalesce((F.col("fingerprint") != F.lag("fingerprint").over(w)).cast("int"), F.lit(1))
    return (
        profiles.withColumn("_new", new).withColumn("version", F.sum("_new").over(w))
        .groupBy("stream", "version").agg(F.first("fingerprint").alias("fingerprint"), F.min("seq").alias("first_seq"), F.count("*").alias("n_files"), F.max(F.coalesce(F.size("profile"), F.lit(0))).alias("n_fields"))
    )
