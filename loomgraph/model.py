"""Schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, INT, BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
STRS = T.ArrayType(T.StringType())

# ---------------------------------------------------------------------------
# They must equal the published behaviour for results to match.
# ---------------------------------------------------------------------------

# Edge weights per relationship type, in tenths so that sums stay exact.
EDGE_WEIGHT_TENTHS = {
    "BELONGS_TO": 10,
    "CALLS": 12,
    "TESTS": 10,
    "IMPORTS": 15,
    "MODIFIES": 20,
    "MENTIONS_ISSUE": 25,
    "MENTIONS_PR": 25,
    "CREATES": 18,
    "USES": 15,
}
DEFAULT_WEIGHT_TENTHS = 20

# Ranking defaults.
ALPHA = 0.3
BETA = 0.6
MAX_PATH_LENGTH = 10.0
TOP_K = 20
TEST_START_THRESHOLD = 0.3
CANDIDATE_TYPES = ["function", "method", "class", "test", "test_method"]
VIRTUAL_ROOT_ID = "virtual_problem_root"
VIRTUAL_TARGET_TYPES = ["function", "method", "class", "file"]

# Directories never scanned for sources.
SKIP_DIRS = [
    "__pycache__", ".git", ".venv", "venv", "env", "node_modules", ".pytest_cache",
    ".tox", "build", "dist", "target", "bin", ".class",
]

# Relationship tables with their endpoint tables.
REL_ENDPOINTS = {
    "BELONGS_TO": ("CodeEntity", "CodeEntity"),
    "CALLS": ("CodeEntity", "CodeEntity"),
    "IMPORTS": ("CodeEntity", "CodeEntity"),
    "MODIFIES": ("Commit", "CodeEntity"),
    "TESTS": ("CodeEntity", "CodeEntity"),
    "MENTIONS_ISSUE": ("Commit", "Issue"),
    "MENTIONS_PR": ("Commit", "PullRequest"),
    "CREATES": ("CodeEntity", "CodeEntity"),
    "USES": ("CodeEntity", "CodeEntity"),
}

# Node tables other than the catch-all CodeEntity, by node type.
NODE_TABLE_BY_TYPE = {
    "commit": "Commit",
    "issue": "Issue",
    "pull_request": "PullRequest",
    "repository": "Repository",
}

# Columns of each node table.
NODE_TABLE_COLUMNS = {
    "CodeEntity": [
        "id", "name", "type", "file_path", "line_start", "line_end", "parameters", "is_test",
        "full_path", "methods", "base_classes", "import_type", "from_module", "line",
        "is_placeholder",
    ],
    "Commit": ["id", "sha", "message", "author", "date", "files_changed"],
    "Issue": [
        "id", "number", "title", "body", "state", "author", "created_at", "updated_at", "labels",
    ],
    "PullRequest": [
        "id", "number", "title", "body", "state", "author", "created_at", "updated_at",
        "base_branch", "head_branch",
    ],
    "Repository": ["id", "name", "owner", "description", "language", "stars", "forks"],
}

# Row caps of the artifact scans.
MAX_PULLS, MAX_ISSUES, MAX_COMMITS = 200, 200, 100

# ---------------------------------------------------------------------------
# Nodes and edges
# ---------------------------------------------------------------------------

CORE_NODE_FIELDS = [("id", STR), ("name", STR), ("type", STR), ("file_path", STR)]

OPTIONAL_NODE_FIELDS = [
    ("full_path", STR), ("line_start", LONG), ("line_end", LONG), ("parameters", STRS),
    ("methods", STRS), ("base_classes", STRS), ("is_test", BOOL), ("import_type", STR),
    ("from_module", STR), ("line", LONG), ("is_placeholder", BOOL),
    ("owner", STR), ("description", STR), ("language", STR), ("stars", LONG), ("forks", LONG),
    ("number", LONG), ("title", STR), ("body", STR), ("state", STR), ("author", STR),
    ("created_at", STR), ("merged_at", STR), ("labels", STRS),
    ("sha", STR), ("message", STR), ("date", STR), ("files_changed", STRS),
]

NODE_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in CORE_NODE_FIELDS + OPTIONAL_NODE_FIELDS]
)

# Optional columns that a node of each type carries; a null in one of these is
# a value (it overwrites on upsert), a null elsewhere means "not given".
FUNCTION_KEYS = ["line_start", "line_end", "parameters", "is_test"]
KEYS_BY_TYPE = {
    "file": ["full_path"],
    "function": FUNCTION_KEYS,
    "test": FUNCTION_KEYS,
    "import": ["import_type", "from_module", "line"],
    "resource": ["is_placeholder"],
    "unknown_function": ["is_placeholder"],
    "repository": ["owner", "description", "language", "stars", "forks"],
    "pull_request": [
        "number", "title", "body", "state", "author", "created_at", "merged_at", "files_changed",
    ],
    "issue": ["number", "title", "body", "state", "author", "created_at", "labels"],
    "commit": ["sha", "message", "author", "date", "files_changed"],
}

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("src", STR), T.StructField("dst", STR), T.StructField("type", STR),
        T.StructField("line", LONG), T.StructField("call_text", STR),
    ]
)

# ---------------------------------------------------------------------------
# Syntax events: one row per interesting node of a parsed source file
# ---------------------------------------------------------------------------

SYNTAX_SCHEMA = T.StructType(
    [
        T.StructField("file_path", STR),
        T.StructField("language", STR),
        # class interface function method constructor import call assign return new
        # field package file error
        T.StructField("kind", STR),
        T.StructField("pos", LONG),
        T.StructField("line_start", LONG),
        T.StructField("line_end", LONG),
        T.StructField("name", STR),
        T.StructField("text", STR),
        T.StructField("owner_function", STR),
        T.StructField("owner_class", STR),
        T.StructField("params", STRS),
        T.StructField("members", STRS),
        T.StructField("bases", STRS),
        T.StructField("markers", STRS),
        T.StructField("modifiers", STRS),
        T.StructField("from_module", STR),
        T.StructField("shape_hash", STR),
    ]
)

ARTIFACT_DDL = """
    repository STRUCT<owner STRING, name STRING, full_name STRING, description STRING,
        language STRING, stars BIGINT, forks BIGINT, open_issues BIGINT, created_at STRING,
        updated_at STRING, default_branch STRING, size BIGINT, archived BOOLEAN,
        disabled BOOLEAN, private BOOLEAN, error STRING>,
    pulls ARRAY<STRUCT<number BIGINT, title STRING, body STRING, state STRING, author STRING,
        created_at STRING, updated_at STRING, merged_at STRING, head_branch STRING,
        base_branch STRING, files_changed ARRAY<STRING>>>,
    issues ARRAY<STRUCT<number BIGINT, title STRING, body STRING, state STRING, author STRING,
        created_at STRING, updated_at STRING, closed_at STRING, labels ARRAY<STRING>,
        assignees ARRAY<STRING>, pull_request STRING>>,
    commits ARRAY<STRUCT<sha STRING, message STRING, author STRING, author_email STRING,
        committer STRING, date STRING, files_changed ARRAY<STRING>>>
"""
