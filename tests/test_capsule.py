"""Whole capsules: a sound one, one with a withheld run, and one broken in each of several ways."""

import hashlib
import json

import pytest

from sealwork import __main__ as cli
from sealwork.functions.canon import canonical_text, digest_of
from sealwork.operators.capsule import crate_entities, verify_capsules
from sealwork.sources import files


def sealed(record):
    return record | {"record_digest": digest_of(canonical_text(record))}


def build(folder, withhold=False, edit=None):
    """A capsule of two runs, a claim of two revisions and a gate; edit(state) changes it before the bundle is sealed."""
    folder.mkdir()
    log = {}
    for rid, status in (("r1", "ok"), ("r2", "refused")):
        body = {"run_id": rid, "session_id": "s"} | ({"error_summary": "APPROVAL_REQUIRED"} if rid == "r2" else {})
        log[rid] = body | {"record": sealed({"run_id": rid, "session_id": "s", "status": status, "extra": {"entry_digest": digest_of(canonical_text(body))}})}
    first = sealed({"claim_id": "c", "revision": 0, "session_id": "s", "revision_digest": "sha256:" + "a" * 64, "content": {"evidence_seals": {"r1": log["r1"]["record"]["record_digest"]}}})
    second = sealed({"claim_id": "c", "revision": 1, "session_id": "s", "revision_digest": "sha256:" + "b" * 64, "supersedes": first["revision_digest"], "content": {}})
    entries = [{"kind": "claim_revision", "id": f"c@{i}", "record_digest": r["record_digest"], "record_location": f"claims.json#/{i}"} for i, r in enumerate((first, second))]
    for rid in ("r1", "r2"):
        record = log[rid]["record"]
        entries.append({"kind": "run", "id": rid, "record_digest": record["record_digest"], "record_location": f"run_log.json#/{rid}/record", "body_location": f"run_log.json#/{rid}", "binding": {"scheme": "e/1", "digest": record["extra"]["entry_digest"]}})
    if withhold:
        log["r1"] = {"redacted_for_privacy": True, "run_id": "r1", "session_id": "s", "record_digest": log["r1"]["record"]["record_digest"]}
    left = ["r1"] if withhold else []
    state = {"log": log, "claims": [first, second], "bundle": {
        "schema": "b/1", "session_id": "s", "objects": [], "records": entries, "coverage": {"records_verified": 4 - len(left), "records_total": 4, "unverifiable_ids": left},
        "run_rows": {"sealed": 2 - len(left), "withheld_for_privacy": len(left)}, "gates": [{"run_id": "r2", "code": "APPROVAL_REQUIRED", "outcome": "refused"}], "replay": {"status": "archive_integrity"},
    }}
    if edit:
        edit(state)
    (folder / "run_log.json").write_text(json.dumps(state["log"]))
    (folder / "claims.json").write_text(json.dumps(state["claims"]))
    facts = [(p, (folder / p).read_bytes()) for p in ("claims.json", "run_log.json")]
    (folder / "capsule_manifest.json").write_text(json.dumps({"files": [{"path": p, "sha256": hashlib.sha256(x).hexdigest(), "size": len(x)} for p, x in facts]}))
    facts.insert(0, ("capsule_manifest.json", (folder / "capsule_manifest.json").read_bytes()))
    b = state["bundle"]
    b["objects"] = [{"ref": p, "digest": "sha256:" + hashlib.sha256(x).hexdigest(), "size": len(x)} for p, x in facts]
    b["bundle_id"] = digest_of(canonical_text({k: b[k] for k in ("schema", "session_id", "objects", "records")}))
    (folder / "bundle.json").write_text(json.dumps(sealed(b)))
    names = ["bundle.json", *(p for p, _ in facts)]
    (folder / "manifest-sha256.txt").write_text("".join(f"{hashlib.sha256((folder / p).read_bytes()).hexdigest()}  {p}\n" for p in sorted(names)))


def swap(s, path, value):
    for k in path[:-1]:
        s = s[k]
    s[path[-1]] = value


EDITS = {
    "VER-CHAIN": lambda s: swap(s, ["claims", 1, "supersedes"], "sha256:" + "c" * 64), "VER-RECORD-SEAL": lambda s: swap(s, ["log", "r1", "record", "status"], "error"),
    "VER-BINDING": lambda s: swap(s, ["log", "r1", "note"], "x"), "VER-COVERAGE": lambda s: swap(s, ["bundle", "coverage", "records_total"], 5), "VER-GATES": lambda s: swap(s, ["bundle", "gates"], []),
    "VER-RUN-ROWS": lambda s: swap(s, ["bundle", "run_rows", "sealed"], 3), "VER-REPLAY-MANIFEST": lambda s: swap(s, ["bundle", "replay", "manifest_status"], "not_performed"), "VER-RECORD-DIGEST": lambda s: swap(s, ["bundle", "records", 2, "id"], "r0"),
}


def test_capsules(spark, tmp_path):
    folders = {"sound": {}, "withheld": {"withhold": True}, **{rule: {"edit": e} for rule, e in EDITS.items()}}
    for name, how in folders.items():
        build(tmp_path / name, **how)
    build(tmp_path / "VER-FILE-DIGEST")
    (tmp_path / "VER-FILE-DIGEST/claims.json").write_text("[]")
    build(tmp_path / "VER-UNLISTED-FILE")
    (tmp_path / "VER-UNLISTED-FILE/more.txt").write_text("x")
    (tmp_path / "VER-BUNDLE-SEAL").mkdir()
    names = [*folders, "VER-FILE-DIGEST", "VER-UNLISTED-FILE", "VER-BUNDLE-SEAL"]
    failures, outcomes = verify_capsules(spark, {n: str(tmp_path / n) for n in names})
    out = {r["crate"]: (r["status"], set(r["rules"])) for r in outcomes.collect()}
    assert out["sound"] == ("ok", set()) and out["withheld"] == ("ok_partial_withheld", set())
    for n in names[2:]:
        assert out[n][0] == "failed" and n in out[n][1], (n, out[n])
    assert failures.where("crate = 'VER-FILE-DIGEST' and rule = 'VER-BAGIT'").count() == 1


def test_command_line(spark, tmp_path, capsys):
    build(tmp_path / "a")
    assert cli.main(["verify", str(tmp_path / "a"), "--json"]) == 0 and json.loads(capsys.readouterr().out)["failures"] == []
    with pytest.raises(SystemExit):
        cli.main(["else", "x"])


def test_entities_of_a_metadata_file(spark, tmp_path):
    files.write_crate([{"@id": "./", "@type": "Dataset"}, {"@type": "File"}], ["https://c", {"own:x": "https://own/x"}], str(tmp_path))
    entities, contexts = crate_entities(files.read_documents(files.listing(spark, {"c": str(tmp_path)})))
    assert {r["id"] for r in entities.collect()} == {"./", None}
    assert {(r["term"], r["iri"]) for r in contexts.collect()} == {(None, "https://c"), ("own:x", "https://own/x")}
