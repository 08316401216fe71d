"""Deeply nested records to flat child tables (problem 6).

Lists are flattened on Arrow buffers: child rows come from list offsets and parent-index kernels, keys of the parent by a
vectorised take. Text JSON is brought to typed arrays by Spark's own parser first; no record is walked in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def child_rows(parents: pa.Array, lists: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(parent index, position, element) of every element of a list column; null lists have none, null elements are kept."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    index = pc.list_parent_indices(lists)
    values = pc.list_flatten(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    starts = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))[:-1]]) if len(lists) else np.zeros(0, "int64")
    i = index.to_numpy(zero_copy_only=False)
    place = np.arange(len(i), dtype="int64") - starts.astype("int64")[i]
    return index, pa.array(place), values


def _emit(table: str, digest: pa.Array, path: str, place: pa.Array, key: pa.Array, keep: pa.Array) -> pa.RecordBatch:
    n = len(digest)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([table] * n, pa.string()), digest.cast(pa.string()), pa.array([path] * n, pa.string()), place.cast(pa.string()), pc.fill_null(key.cast(pa.string()), "")],
        names=["src_table", "record_digest", "child_path", "child_pos", "child_key"],
    )
    return batch.filter(keep)


CHILD_SCHEMA = "src_table string, record_digest string, child_path string, child_pos string, child_key string"


def flat_children(table: str, paths: dict[str, tuple[str, str | None, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function. paths: child_path -> (list column, member that is the key or None for the element, member that is a list of grandchildren or '')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = b.column("record_digest")
            for path, (column, key, below) in paths.items():
                index, place, values = child_rows(digests, b.column(column))
                if not len(values):
                    continue
                owner = digests.take(index)
                yield _emit(table, owner, path, place, pc.struct_field(values, key) if key else values, pc.is_valid(values))
                if below:
                    inner_path, inner_key = below.split("/")
                    inner, spot, checks = child_rows(index, pc.struct_field(values, inner_path))
                    if len(checks):
                        pos = pc.binary_join_element_wise(place.take(inner).cast(pa.string()), spot.cast(pa.string()), ".")
                        yield _emit(table, owner.take(inner), f"{path}.{inner_path}", pos, pc.struct_field(checks, inner_key), pc.is_valid(checks))

    return run


def as_list(text: Column) -> Column:
    """Elements (JSON text) of a JSON value: an array's own, a lone object or string as one, null for null or unreadable text."""
    t = F.trim(text)
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).when(text.isNotNull() & (t != "null"), F.array(text))


def unwrapped(text: Column) -> Column:
    """JSON text that may have been encoded twice, decoded once."""
    return F.when(F.trim(text).startswith('"'), F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), 0)).otherwise(text)


def one_per_record(df: DataFrame, digest: str, cols: list[str]) -> DataFrame:
    """Copies of a record (same digest) count once; rows without a digest are left out."""
    return df.where(F.col(digest).isNotNull()).select(digest, *cols).dropDuplicates([digest])


def claim_children(claims: DataFrame) -> DataFrame:
    """Child rows of claim content: evidence spans, their checks, and the basin references of the scope.

    Content that is null or no JSON object has no children; a lone object is an array of one; null elements are no children
    but keep their place; an absent key is ''.
    """
    src = one_per_record(claims, "record_digest", ["content"])
    top = F.from_json(unwrapped(F.col("content")), "evidence_spans string, scope string")
    src = src.select("record_digest", top.alias("c")).select("record_digest", F.col("c.evidence_spans").alias("spans"), F.from_json("c.scope", "basin_refs string").alias("s"))
    span = F.transform(as_list(F.col("spans")), lambda x: F.from_json(x, "source_id string, checks string"))
    typed = src.select(
        "record_digest",
        F.transform(span, lambda x: F.when(x.isNotNull(), F.struct(x["source_id"].alias("source_id"), F.transform(as_list(x["checks"]), lambda c: F.from_json(c, "name string")).alias("checks")))).alias("spans"),
        F.transform(as_list(F.col("s.basin_refs")), lambda x: F.when(x.startswith("{"), F.from_json(x, "id string")).when(x.isNotNull(), F.struct(x.alias("id")))).alias("basins"),
    )
    return typed.mapInArrow(flat_children("claim_revisions", {"evidence_spans": ("spans", "source_id", "checks/name"), "scope.basin_refs": ("basins", "id", "")}), CHILD_SCHEMA)


def bundle_children(bundles: DataFrame) -> DataFrame:
    """Child rows of bundles: objects by ref, records by id. Null arrays have no children, null elements keep their place."""
    slim = bundles.select(
        "record_digest",
        F.transform("objects", lambda x: F.when(x.isNotNull(), F.struct(x["ref"].alias("ref")))).alias("objects"),
        F.transform("records", lambda x: F.when(x.isNotNull(), F.struct(x["id"].alias("id")))).alias("records"),
    )
    src = one_per_record(slim, "record_digest", ["objects", "records"])
    return src.mapInArrow(flat_children("bundles", {"objects": ("objects", "ref", ""), "records": ("records", "id", "")}), CHILD_SCHEMA)


# ---------------------------------------------------------------- whole child tables


def flat_table(df: DataFrame, parent: str, column: str, members: list[str], inner: str | None = None, inner_members: list[str] | None = None) -> DataFrame:
    """A child table of a list-of-structs column: parent, pos and the members; with ``inner`` a table of that member's elements instead.

    Rows of inner lists have parent, parent_pos, pos and inner_members. Lists are taken apart on Arrow buffers, members keep their
    types. Null elements are no rows but keep their place; null lists have none. Names of members must differ from parent and pos.
    """
    element = df.schema[column].dataType.elementType
    if inner:
        element = element[inner].dataType.elementType
    wanted = inner_members if inner else members
    kinds = [f"`{m}` {element[m].dataType.simpleString()}" for m in wanted]
    head = [f"`{parent}` {df.schema[parent].dataType.simpleString()}", *(["parent_pos int"] if inner else []), "pos int"]
    names = [parent, *(["parent_pos"] if inner else []), "pos", *wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner = b.column(parent)
            index, place, values = child_rows(owner, b.column(column))
            if not len(values):
                continue
            if inner:
                up, spot, values = child_rows(index, pc.struct_field(values, inner))
                if not len(values):
                    continue
                lead = [owner.take(index.take(up)), place.take(up).cast(pa.int32()), spot.cast(pa.int32())]
            else:
                lead = [owner.take(index), place.cast(pa.int32())]
            yield pa.RecordBatch.from_arrays([*lead, *(pc.struct_field(values, m) for m in wanted)], names=names).filter(pc.is_valid(values))

    return df.select(parent, column).mapInArrow(run, ", ".join([*head, *kinds]))


def _rest(text: Column, known: list[str]) -> Column:
    """JSON of the members of an object that have no column, null if there are none."""
    others = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: ~k.isin(*known))
    return F.when(F.size(others) > 0, F.to_json(others))


def claim_tables(claims: DataFrame) -> dict[str, DataFrame]:
    """spans, checks and basins of claim content as flat tables with all members; members without a column of their own are kept as JSON in ``rest``."""
    src = one_per_record(claims, "record_digest", ["content"])
    top = F.from_json(unwrapped(F.col("content")), "evidence_spans string, scope string")
    src = src.select("record_digest", top.alias("c")).select("record_digest", F.col("c.evidence_spans").alias("spans"), F.from_json("c.scope", "basin_refs string").alias("s"))

    def check(c: Column) -> Column:
        v = F.from_json(c, "name string, value string, detail string")
        return F.when(v.isNotNull(), F.struct(v["name"].alias("name"), v["value"].try_cast("double").alias("value"), v["detail"].alias("detail"), _rest(c, ["name", "value", "detail"]).alias("rest")))

    def span(x: Column) -> Column:
        v = F.from_json(x, "source_id string, source_type string, metric_ref string, checks string")
        rest = _rest(x, ["source_id", "source_type", "metric_ref", "checks"])
        return F.when(v.isNotNull(), F.struct(v["source_id"].alias("source_id"), v["source_type"].alias("source_type"), v["metric_ref"].alias("metric_ref"), rest.alias("rest"), F.transform(as_list(v["checks"]), check).alias("checks")))

    def basin(x: Column) -> Column:
        v = F.from_json(x, "id string, label string")
        return F.when(x.startswith("{"), F.struct(v["id"].alias("id"), v["label"].alias("label"), _rest(x, ["id", "label"]).alias("rest"))).when(x.isNotNull(), F.struct(x.alias("id"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("rest")))

    typed = src.select("record_digest", F.transform(as_list(F.col("spans")), span).alias("spans"), F.transform(as_list(F.col("s.basin_refs")), basin).alias("basins"))
    return {
        "spans": flat_table(typed, "record_digest", "spans", ["source_id", "source_type", "metric_ref", "rest"]),
        "checks": flat_table(typed, "record_digest", "spans", [], "checks", ["name", "value", "detail", "rest"]),
        "basins": flat_table(typed, "record_digest", "basins", ["id", "label", "rest"]),
    }


def bundle_tables(bundles: DataFrame) -> dict[str, DataFrame]:
    """objects and records of bundles as flat tables with all members; a record's binding becomes two columns, its digest entry_digest."""
    one = one_per_record(bundles, "record_digest", ["objects", "records"])
    entry = lambda r: F.when(r.isNotNull(), F.struct(r["kind"].alias("kind"), r["id"].alias("id"), r["record_digest"].alias("entry_digest"), r["record_location"].alias("record_location"), r["body_location"].alias("body_location"), r["binding"]["scheme"].alias("binding_scheme"), r["binding"]["digest"].alias("binding_digest")))
    one = one.withColumn("records", F.transform("records", entry))
    return {
        "objects": flat_table(one, "record_digest", "objects", ["ref", "digest", "size", "role", "media_type", "license"]),
        "records": flat_table(one, "record_digest", "records", ["kind", "id", "entry_digest", "record_location", "body_location", "binding_scheme", "binding_digest"]),
    }
