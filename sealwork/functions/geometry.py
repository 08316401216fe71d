"""Identity of places: geometries quantised to whole numbers, brought to one form and hashed.

A ring is array<struct<x:bigint,y:bigint>> in millionths of a degree. Everything is a higher-order array expression; areas
are added up as decimals, so that no ring is too large.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealwork.constants import ANCHOR_TAG, BASIN_PREFIX, GEOMETRY_TAG
from sealwork.functions.canon import digest_text, json_string

SCALE = 1_000_000


def quantise(v: Column) -> Column:
    """Millionths, half to even; null for NaN and infinities."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.rint(v * SCALE).cast("bigint"))


def quantised_point(p: Column) -> Column:
    """struct(x, y) of [lon, lat, ...]; null outside of longitude and latitude, for short or non-finite positions."""
    q = F.struct(quantise(F.get(p, 0)).alias("x"), quantise(F.get(p, 1)).alias("y"))
    return _let(q, lambda v: F.when((F.size(p) >= 2) & (F.abs(v["x"]) <= 180 * SCALE) & (F.abs(v["y"]) <= 90 * SCALE), v))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _area2(r: Column) -> Column:
    def cross(p: Column, i: Column) -> Column:
        wide = lambda c: c.cast("decimal(12,0)")
        return _let(F.get(r, (i + 1) % F.size(r)), lambda q: (wide(p["x"]) * wide(q["y"]) - wide(q["x"]) * wide(p["y"])).cast("decimal(38,0)"))

    return F.aggregate(F.transform(r, cross), F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)"))


def ring_area2(ring: Column) -> Column:
    """Twice the signed area, exactly; positive against the clock."""
    return _let(ring, _area2)


def clean_ring(ring: Column) -> Column:
    """Repeated neighbours and closing vertices go; null for fewer than three vertices, no area, or a vertex that is null."""

    def opened(kept: Column) -> Column:
        # after runs are gone at most one closing vertex is left
        return F.when((F.size(kept) > 1) & (F.element_at(kept, -1) == F.get(kept, 0)), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)

    def clean(r: Column) -> Column:
        kept = F.filter(r, lambda p, i: (i == 0) | ~(p == F.get(r, i - 1)))
        return F.when(~F.exists(r, lambda p: p.isNull()), _let(_let(kept, opened), lambda o: F.when((F.size(o) >= 3) & (_area2(o) != 0), o)))

    return _let(ring, clean)


def oriented(ring: Column, against_clock: bool) -> Column:
    """The ring in one direction, beginning at its least vertex (the first of equals)."""

    def rotated(t: Column) -> Column:
        return _let(F.array_position(t, F.array_min(t)).cast("int"), lambda at: F.concat(F.slice(t, at, F.size(t)), F.slice(t, F.lit(1), at - 1)))

    return _let(_let(ring, lambda r: F.when((_area2(r) > 0) == F.lit(against_clock), r).otherwise(F.reverse(r))), rotated)


def _text(ring: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(ring, lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))), ","), F.lit("]"))


def quantised_ring(ring: Column) -> Column:
    return F.transform(ring, quantised_point)


def canonical_polygon(rings: Column) -> Column:
    """array of rings of a polygon (array of rings of [lon, lat]): exterior against the clock, then holes with it, sorted; degenerate holes go.

    Null if the exterior is degenerate.
    """
    holes = F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), lambda h: clean_ring(quantised_ring(h)))
    holes = F.array_sort(F.transform(F.filter(holes, lambda h: h.isNotNull()), lambda h: oriented(h, False)))
    return _let(clean_ring(quantised_ring(F.get(rings, 0))), lambda e: F.when(e.isNotNull(), F.concat(F.array(oriented(e, True)), holes)))


def geometry_text(polygons: Column) -> Column:
    """Payload text of a multipolygon (array of polygons of rings of [lon, lat]); null if no polygon has an area."""
    parts = F.array_sort(F.filter(F.transform(polygons, canonical_polygon), lambda p: p.isNotNull()))

    def payload(ps: Column) -> Column:
        coords = F.array_join(F.transform(ps, lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, _text), ","), F.lit("]"))), ",")
        return F.when(F.size(ps) > 0, F.concat(F.lit(f'{{"alg":"{GEOMETRY_TAG}","coordinates":['), coords, F.lit('],"q_exp":6,"type":"MultiPolygon"}')))

    return _let(parts, payload)


def point_text(p: Column) -> Column:
    q = quantised_point(p)
    return F.concat(F.lit(f'{{"alg":"{GEOMETRY_TAG}","coordinates":['), q["x"].cast("string"), F.lit(","), q["y"].cast("string"), F.lit('],"q_exp":6,"type":"Point"}'))


def multipoint_text(points: Column) -> Column:
    """Payload of points, sorted and distinct; null if one of them is bad or there is none."""
    q = F.transform(points, quantised_point)
    good = (F.size(points) > 0) & ~F.exists(q, lambda p: p.isNull())
    return F.when(good, F.concat(F.lit(f'{{"alg":"{GEOMETRY_TAG}","coordinates":'), _text(F.array_sort(F.array_distinct(q))), F.lit(',"q_exp":6,"type":"MultiPoint"}')))


def gauge_text(scheme: Column, gauge: Column) -> Column:
    return F.when((scheme != "") & (gauge != ""), F.concat(F.lit(f'{{"alg":"{GEOMETRY_TAG}","id":'), json_string(gauge), F.lit(',"q_exp":6,"scheme":'), json_string(scheme), F.lit(',"type":"GaugeID"}')))


def geometry_problem(polygons: Column) -> Column:
    """Code of what is wrong with a multipolygon, null if it has an identity."""
    return _problem(polygons, geometry_text(polygons))


def _problem(polygons: Column, text: Column) -> Column:
    bad = F.exists(F.flatten(F.flatten(polygons)), lambda p: quantised_point(p).isNull())
    no_ring = polygons.isNull() | F.exists(polygons, lambda p: p.isNull() | (F.size(p) == 0) | F.exists(p, lambda r: r.isNull()))
    return F.when(no_ring, "INVALID_GEOMETRY").when(bad, "INVALID_COORDINATE").when(text.isNull(), "DEGENERATE_GEOMETRY")


def geometry_id(polygons: Column) -> Column:
    """Digest of a multipolygon's payload, null if it has no identity (geometry_problem says why)."""
    return _let(geometry_text(polygons), lambda t: digest_text(F.when(_problem(polygons, t).isNull(), t)))


def crosses_antimeridian(polygons: Column) -> Column:
    """Some edge jumps more than 180 degrees of longitude."""
    jumps = lambda r: F.exists(F.transform(r, lambda p, i: F.abs(F.get(p, 0) - F.get(F.get(r, (i + 1) % F.size(r)), 0)) > 180), lambda x: x)
    return F.coalesce(F.exists(F.flatten(polygons), jumps), F.lit(False))


def basin_id(kind: Column, network: Column, version: Column, element: Column) -> Column:
    """Id that a basin's anchor implies; null if a part is null or empty."""
    text = F.concat(
        F.lit('{"element":'), json_string(element), F.lit(',"kind":'), json_string(kind), F.lit(',"network":'), json_string(network),
        F.lit(',"network_version":'), json_string(version), F.lit(f',"schema":"{ANCHOR_TAG}"}}'),
    )
    whole = (kind != "") & (network != "") & (version != "") & (element != "")
    return F.when(F.coalesce(whole, F.lit(False)), F.concat(F.lit(BASIN_PREFIX), digest_text(text)))


def basin_ref_verifies(declared: Column, anchor: Column) -> Column:
    """The declared id is the one of the anchor (struct kind, network, network_version, element)."""
    return F.coalesce(declared == basin_id(anchor["kind"], anchor["network"], anchor["network_version"], anchor["element"]), F.lit(False))
