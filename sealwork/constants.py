"""Tags, vocabularies, tables and thresholds that must equal those of the data formats, because they are hashed or matched."""

# fixed values: wire-format tags
GEOMETRY_TAG = "aihydro.geom/1"
ANCHOR_TAG = "aihydro.basin_anchor/1"
BASIN_PREFIX = "aihydro:basin:"
ALIAS_TAG_SCHEME = "aihydro"
CRATE_FILE = "ro-crate-metadata.json"
BAG_FILE = "manifest-sha256.txt"
SPDX_BASE = "https://spdx.org/licenses/"

# fixed values: vocabularies
RUN_STATUSES = ("ok", "error", "refused")
ACTOR_KINDS = ("human", "agent", "package", "system")
RECORD_KINDS = ("run", "claim_revision", "approval", "basin_ref", "claim_view")
UNSEALED_KINDS = ("claim_view",)
GATE_OUTCOMES = ("refused", "error")
REPLAY_RANKS = {"not_performed": 0, "archive_integrity": 1, "cross_check": 2, "recomputed": 3, "independently_reproduced": 4}
RUN_ROW_KEYS = ("run_log_rows", "sealed", "legacy_no_record", "unbound", "unsealable", "withheld_for_privacy")
HEAD_FIELDS = ("text", "claim_type", "status", "confidence", "confidence_rationale", "limitations")
ENUM_HEAD_FIELDS = ("claim_type", "status", "confidence")
SCRUB_MARKERS = ("<abs>", "~/", "workspace:", "session-data:")
ACTION_TYPES = ("CreateAction", "AssessAction", "UpdateAction", "ActivateAction")
CLAIM_BASES = ("sealed_revision", "working_view_unsealed")

# fixed values: what counts as a local path (file addresses, system roots, drives, network shares, home folders); no look-behind, so that RE2 takes it as well
LOCAL_ROOTS = ("Users", "home", "private", "var", "tmp", "opt", "root", "mnt", "Volumes", "srv", "scratch", "etc")
LOCAL_PATH = "|".join(
    [
        "file://",
        r"""(?:^|[\s"'(=:,;\[])/(?:""" + "|".join(LOCAL_ROOTS) + ")/",
        r"""(?:^|[\s"'(=,;\[])[A-Za-z]:(?:\\|/(?:Users|Windows|Documents|Program|home|tmp|temp)\b)""",
        r"""(?:^|[\s"'(])//[A-Za-z0-9_-]+/[^/\s]+""",
        r"""\\\\[^\\\s]+\\[^\\\s]+""",
        r"""(?:^|[\s"'(])~/[A-Za-z._]""",
        r"""\$\{?HOME\b|%USERPROFILE%|%HOMEPATH%""",
    ]
)

# fixed values: form of an ISO date
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"

# fixed values: members that a withheld record may have
STUB_KEYS = {
    "run": ("redacted_for_privacy", "run_id", "session_id", "timestamp", "tool_name", "record_digest", "entry_digest", "reason", "record"),
    "claim_revision": ("redacted_for_privacy", "session_id", "claim_id", "revision", "supersedes", "revision_digest", "record_digest", "recorded_at", "reason"),
}

# fixed values: media types by extension
MEDIA_TYPES = {
    ".json": "application/json", ".csv": "text/csv", ".md": "text/markdown", ".py": "text/x-python", ".txt": "text/plain",
    ".yml": "application/yaml", ".yaml": "application/yaml", ".bib": "application/x-bibtex", ".png": "image/png", ".svg": "image/svg+xml",
    ".geojson": "application/geo+json", ".nc": "application/x-netcdf",
}

# fixed values: thresholds of the statistics
LOW_N_GROUPS = 30
DEGRADED_VALID_FRAC = 0.95
NAN_CI_VALID_FRAC = 0.5
MIN_LAG1_PAIRS = 8
MIN_REPLICATES = 100
