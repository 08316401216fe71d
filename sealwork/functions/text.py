"""Text functions of evidence tables: pointers, locations, ids, times, media types, paths that must not leave."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealwork.constants import ISO_DATE, LOCAL_PATH, MEDIA_TYPES, REPLAY_RANKS, SCRUB_MARKERS, SPDX_BASE

# ---------------------------------------------------------------- JSON pointers and locations


def escape_token(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_token(c: Column) -> Column:
    """The token's text; null if a tilde is followed by neither 0 nor 1."""
    return F.when(~c.rlike("~([^01]|$)"), F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def make_pointer(tokens: Column) -> Column:
    """JSON pointer of an array of tokens; an empty array is the whole document."""
    return F.concat(F.lit(""), F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("/"), escape_token(t))), ""))


def pointer_tokens(pointer: Column) -> Column:
    """Tokens of a pointer; null if it is neither empty nor begins with a slash, or has a bad escape."""
    tokens = F.transform(F.split(F.substring(pointer, 2, 1 << 30), "/", -1), unescape_token)
    good = pointer.startswith("/") & ~F.exists(tokens, lambda t: t.isNull())
    return F.when(pointer == "", F.expr("cast(array() as array<string>)")).when(good, tokens)


def is_relative_path(path: Column) -> Column:
    """A relative path of a crate: not empty, no leading slash, backslash, ``#`` or NUL, no empty, ``.`` or ``..`` segment."""
    odd = F.exists(F.split(path, "/", -1), lambda s: s.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.rlike("[\\\\#\\x00]") & ~odd, F.lit(False))


def split_location(location: Column) -> Column:
    """struct(path, tokens) of ``path#pointer``; null if malformed."""
    at = F.locate("#", location)
    path = F.substring(location, F.lit(1), at - 1)
    tokens = pointer_tokens(F.substring(location, at + 1, F.length(location)))
    return F.when((at > 0) & is_relative_path(path) & tokens.isNotNull(), F.struct(path.alias("path"), tokens.alias("tokens")))


def make_location(path: Column, tokens: Column) -> Column:
    """``path#pointer``; null if the path is not a relative one."""
    return F.when(is_relative_path(path), F.concat(path, F.lit("#"), make_pointer(tokens)))


def resolve(doc: object, tokens: list[str]) -> tuple[bool, object]:
    """(found, value) at the end of tokens in a JSON value: members by name, elements by plain decimal index."""
    for t in tokens:
        if isinstance(doc, dict) and t in doc:
            doc = doc[t]
        elif isinstance(doc, list) and t.isascii() and t.isdigit() and (t == "0" or t[0] != "0") and int(t) < len(doc):
            doc = doc[int(t)]
        else:
            return False, None
    return True, doc


@F.pandas_udf(T.StringType())
def resolve_tokens(doc: pd.Series, tokens: pd.Series) -> pd.Series:
    """JSON text of what tokens point to in a JSON document; null if there is no such place or the document is unreadable."""
    import json

    def one(text: str | None, path: object) -> str | None:
        if text is None or path is None:
            return None
        try:
            found, v = resolve(json.loads(text), list(path))
        except ValueError:
            return None
        return json.dumps(v, ensure_ascii=False) if found else None

    return pd.Series([one(a, b) for a, b in zip(doc, tokens)], dtype=object)


# ---------------------------------------------------------------- ids and names


def percent_encoded(c: Column, keep_slash: bool = False) -> Column:
    """Percent-encoding that keeps letters, digits and ``-._~`` (and ``/`` of a path)."""
    out = F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out


def fragment_id(*parts: Column) -> Column:
    return F.concat(F.lit("#"), F.concat_ws("-", *[percent_encoded(p) for p in parts]))


def record_key(kind: Column, record_id: Column) -> Column:
    return F.concat_ws(":", kind, record_id)


def curie(scheme: Column, local_id: Column) -> Column:
    return F.concat(scheme, F.lit(":"), local_id)


def slug(c: Column, length: int = 32) -> Column:
    """Small letters and digits joined by hyphens, at most ``length``; null if nothing is left (the caller gives an id of its own)."""
    s = F.substring(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), 1, length)
    return F.when(s != "", s)


def license_url(c: Column) -> Column:
    """Address of a licence given as SPDX name or as an address."""
    encoded = F.replace(percent_encoded(c), F.lit("%2B"), F.lit("+"))
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(SPDX_BASE), encoded, F.lit(".html")))


def license_name(c: Column) -> Column:
    last = F.regexp_extract(F.regexp_replace(license_url(c), "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(last, "\\.html$", "")


def media_type(path: Column) -> Column:
    """Media type by extension, without regard to case; null for others."""
    ext = F.lower(F.regexp_extract(path, "(\\.[^.]*)$", 1))
    return reduce(lambda w, kv: w.when(ext == kv[0], kv[1]), list(MEDIA_TYPES.items())[1:], F.when(ext == next(iter(MEDIA_TYPES)), MEDIA_TYPES[next(iter(MEDIA_TYPES))]))


# ---------------------------------------------------------------- times and levels

_ISO = "^(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2})(?:\\.(\\d+))?(Z|[+-]\\d{2}:\\d{2})$"


def iso_ms(c: Column) -> Column:
    """ISO text with the fraction cut to milliseconds and ``Z`` written as an offset; other text unchanged. No timestamp is made of it."""
    fraction = F.regexp_extract(c, _ISO, 2)
    cut = F.when(fraction != "", F.concat(F.lit("."), F.substring(F.rpad(fraction, 3, "0"), 1, 3))).otherwise("")
    zone = F.regexp_extract(c, _ISO, 3)
    return F.when(c.rlike(_ISO), F.concat(F.regexp_extract(c, _ISO, 1), cut, F.when(zone == "Z", "+00:00").otherwise(zone))).otherwise(c)


def is_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(ISO_DATE) & ~c.contains("\n"), F.lit(False))


def replay_rank(c: Column) -> Column:
    """Rank of a replay level, 0 the weakest; null for unknown levels."""
    levels = F.create_map(*[F.lit(x) for kv in REPLAY_RANKS.items() for x in kv])
    return F.try_element_at(levels, c)


def weakest_level(c: Column) -> Column:
    """Aggregate: the weakest of the known levels."""
    return F.min_by(c, replay_rank(c))


# ---------------------------------------------------------------- what must not leave


def has_local_path(c: Column) -> Column:
    return F.coalesce(c.rlike(LOCAL_PATH), F.lit(False))


def safe_text(c: Column) -> Column:
    return F.when(has_local_path(c) | c.startswith("/"), F.lit("[local path withheld]")).otherwise(c)


_MARKER = "(?<!\\S)(?:" + "|".join(SCRUB_MARKERS) + ")\\S*"


def has_marker(c: Column) -> Column:
    """A scrub marker begins a token of the text."""
    return F.coalesce(c.rlike(_MARKER), F.lit(False))


def without_markers(c: Column) -> Column:
    """Text without marked tokens, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, _MARKER, ""), "\\s+", " "))


# ---------------------------------------------------------------- members of open records


def known_and_unknown(members: Column, known: list[str]) -> tuple[Column, Column]:
    """A map of members split into those of known names and the others."""
    names = F.array(*map(F.lit, known))
    return F.map_filter(members, lambda k, _: F.array_contains(names, k)), F.map_filter(members, lambda k, _: ~F.array_contains(names, k))


def merged(known: Column, unknown: Column) -> Column:
    """Both maps in one; of a member in both the known one counts."""
    rest = F.map_filter(unknown, lambda k, _: ~F.map_contains_key(known, k))
    return F.map_concat(known, rest)


def without_nulls(members: Column) -> Column:
    return F.map_filter(members, lambda _, v: v.isNotNull())


def has_keys(members: Column, required: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys(members))) == 0, F.lit(False))


def is_blocking(kind: Column) -> Column:
    """An audit finding blocks unless its kind is that of literature that cannot be resolved; one without kind blocks."""
    return ~kind.eqNullSafe(F.lit("lit_unresolvable"))


def scope_excludes(varies: Column, term: Column) -> Column:
    """True unless the term is among what varies; a scope without that list excludes everything."""
    return F.coalesce(~F.array_contains(varies, term), F.lit(True))


def make_scope(varies: Column, assumes: Column, excludes: Column) -> Column:
    """struct of distinct, non-empty terms in order; null if a term both varies and is excluded."""

    def clean(c: Column) -> Column:
        return F.array_distinct(F.filter(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull() & (x != "")))

    return F.when(F.size(F.array_intersect(clean(varies), clean(excludes))) == 0, F.struct(clean(varies).alias("varies"), clean(assumes).alias("assumes"), clean(excludes).alias("excludes")))


def estimate_is_valid(value: Column, low: Column, high: Column, n: Column) -> Column:
    """An estimate counts: at least one observation, and either both bounds NaN or low <= value <= high; nulls make it invalid."""
    open_ci = F.isnan(low) & F.isnan(high)
    inside = ~F.isnan(low) & ~F.isnan(high) & ~F.isnan(value) & (low <= value) & (value <= high)
    there = value.isNotNull() & low.isNotNull() & high.isNotNull() & n.isNotNull()
    return F.coalesce(there & (n >= 1) & (open_ci | inside), F.lit(False))
