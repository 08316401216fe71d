"""Plain, single-threaded versions of the operators, to hold results against."""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import datetime, timezone


def micros(t):
    return None if t is None else round((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def iso_us(s):
    t = datetime.fromisoformat(s.strip().replace("Z", "+00:00"))
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def history(rows):
    """rows: (claim_id, revision, digest, supersedes, us)."""
    claims = defaultdict(lambda: defaultdict(dict))
    for c, r, d, s, us in rows:
        k = claims[c][r]
        if d not in k or us < k[d][0]:
            k[d] = (us, s)
    out = set()
    for c, revs in claims.items():
        picked, named = {}, set()
        for r in sorted(revs, reverse=True):
            cand = revs[r]
            hit = [d for d in cand if d in named]
            d = hit[0] if hit else max(cand, key=lambda d: (cand[d][0], d))
            picked[r] = (d, cand[d][0])
            named = {cand[d][1]}
        versions, before = [], None
        for r in sorted(picked):
            if picked[r][0] != before:
                versions.append((r, picked[r][1]))
            before = picked[r][0]
        for i, (r, us) in enumerate(versions):
            out.add((c, r, us, versions[i + 1][1] if i + 1 < len(versions) else -1))
    return out


def descents(links):
    """links: (node, parents). Rows (node, root, depth), loops with depth -1."""
    nodes = {n for n, _ in links if n is not None}
    up = {n: set() for n in nodes}
    for n, ps in links:
        if n is not None:
            up[n] |= {p for p in ps or () if p in nodes and p.strip()}
    down = defaultdict(set)
    for n, ps in up.items():
        for p in ps:
            down[p].add(n)

    def reach(start, step):
        seen, todo = set(), list(step[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += step[x]
        return seen

    # only nodes that survive peeling from both ends can be on a loop
    core = set(nodes)
    for step, back in ((up, down), (down, up)):
        n_left = {n: sum(p in core for p in step[n]) for n in core}
        todo = [n for n in core if not n_left[n]]
        while todo:
            n = todo.pop()
            core.discard(n)
            for k in back[n]:
                if k in core:
                    n_left[k] -= 1
                    if not n_left[k]:
                        todo.append(k)
    loop = {}
    for n in core:
        if n not in loop:
            a = reach(n, up)
            if n in a:
                group = {x for x in a & reach(n, down)} | {n}
                for x in group:
                    loop[x] = min(group)
    out = {(n, g, -1) for n, g in loop.items()}
    starts = defaultdict(list)
    for n in nodes:
        if n in loop:
            starts[loop[n]].append(n)
        elif not up[n]:
            starts[n].append(n)
    for root, layer in starts.items():
        seen, depth = set(layer), 0
        while layer:
            if depth:
                out |= {(n, root, depth) for n in layer if n not in loop}
            nxt = {k for n in layer for k in down[n]} - seen
            seen |= nxt
            layer, depth = nxt, depth + 1
    return out


def claim_children(rows):
    """rows: (digest, content)."""

    def many(x):
        return [] if x is None else x if isinstance(x, list) else [x]

    out = set()
    for d, text in dict(rows).items():
        try:
            v = json.loads(text) if text else None
            v = json.loads(v) if isinstance(v, str) else v
        except ValueError:
            v = None
        if not isinstance(v, dict):
            continue
        for i, s in enumerate(many(v.get("evidence_spans"))):
            if s is None:
                continue
            out.add((d, "evidence_spans", str(i), s.get("source_id") or ""))
            for j, c in enumerate(many(s.get("checks"))):
                if c is not None:
                    out.add((d, "evidence_spans.checks", f"{i}.{j}", c.get("name") or ""))
        for i, b in enumerate(many((v.get("scope") or {}).get("basin_refs"))):
            if b is not None:
                out.add((d, "scope.basin_refs", str(i), b if isinstance(b, str) else b.get("id") or ""))
    return out


def bundle_children(rows):
    """rows: (digest, objects, records)."""
    out = set()
    for d, objects, records in {r[0]: r for r in rows}.values():
        for path, key, xs in (("objects", "ref", objects), ("records", "id", records)):
            out |= {(d, path, str(i), x[key] or "") for i, x in enumerate(xs or ()) if x is not None}
    return out


def orphans(runs, claims, bundles, basins, removed):
    """runs: (run_id, parents, at); claims: (claim_id, revision, run_id, at); bundles: (bundle_id, [(kind, id)], at); basins: (id, at); removed: (kind, id)."""
    seen = {}

    def see(k, at):
        seen[k] = min(at, seen.get(k, at))

    for r, _, at in runs:
        see(("run", r), at)
    for c, v, _, at in claims:
        see(("claim_revision", f"{c}@{v}"), at)
        see(("claim_view", c), at)
    for b, at in basins:
        see(("basin_ref", b), at)
    for b, _, at in bundles:
        see(("bundle", b), at)
    refs = {("runs", r, "run", p) for r, ps, _ in runs for p in ps or ()}
    refs |= {("claim_revisions", f"{c}@{v}", "run", r) for c, v, r, _ in claims}
    refs |= {("bundles", b, k, i) for b, rs, _ in bundles for k, i in rs}
    own = {"runs": "run", "claim_revisions": "claim_revision", "bundles": "bundle"}
    out = set()
    for t, s, k, i in refs:
        if i is None or not i.strip():
            continue
        at = seen[own[t], s]
        state = "deleted" if (k, i) in removed else "missing" if (k, i) not in seen else "late" if seen[k, i] > at else ""
        if state:
            out.add((t, s, k, i, state, at.strftime("%Y-%m")))
    return out
