"""Repository artifacts: metadata, pull requests, issues and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import model
from loomgraph.functions.text import file_id


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """One row per repository document (JSON, possibly on several lines)."""
    return spark.read.schema(model.ARTIFACT_DDL).option("multiLine", True).json(path)


def _newest(items: Column, limit: int | None) -> Column:
    newest = F.array_sort(
        items,
        lambda a, b: F.when(a["updated_at"] > b["updated_at"], -1).when(a["updated_at"] < b["updated_at"], 1).otherwise(0),
    )
    return newest if limit is None else F.slice(newest, 1, limit)


def scanned(
    artifacts: DataFrame, pulls: int | None = None, issues: int | None = None, commits: int | None = None
) -> DataFrame:
    """Pull requests and issues with the most recently updated first, and no issues that
    are pull requests.  The limits are per repository; without one everything stays."""
    plain = F.filter("issues", lambda i: i["pull_request"].isNull())
    columns = {"pulls": _newest(F.col("pulls"), pulls), "issues": _newest(plain, issues)}
    if commits is not None:
        columns["commits"] = F.slice("commits", 1, commits)
    return artifacts.withColumns(columns)


def capped(artifacts: DataFrame) -> DataFrame:
    """What the published artifact scans keep of each repository."""
    return scanned(artifacts, model.MAX_PULLS, model.MAX_ISSUES, model.MAX_COMMITS)


def artifact_totals(artifacts: DataFrame) -> DataFrame:
    def size(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0)).alias(f"total_{name}")

    return artifacts.select("repository.full_name", size("pulls"), size("issues"), size("commits"))


def _text(value: Column) -> Column:
    """A null prints as ``None`` inside a name."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def _nodes(rows: DataFrame, node_id: Column, name: Column, kind: str) -> DataFrame:
    """Node rows with the attribute columns that ``kind`` carries."""
    types = dict(model.OPTIONAL_NODE_FIELDS)
    attributes = [F.col(c).cast(types[c]).alias(c) for c in model.KEYS_BY_TYPE[kind]]
    return rows.select(
        node_id.alias("id"), name.alias("name"), F.lit(kind).alias("type"), F.lit("").alias("file_path"), *attributes
    )


def _short_sha() -> Column:
    return F.substring("sha", 1, 8)


def _pull_id(repository: Column | None) -> Column:
    number = F.col("number").cast("string")
    return F.concat(F.lit("pr_"), number) if repository is None else F.concat(F.lit("pr_"), repository, F.lit("#"), number)


def _issue_id(repository: Column | None) -> Column:
    number = F.col("number").cast("string")
    return F.concat(F.lit("issue_"), number) if repository is None else F.concat(F.lit("issue_"), repository, F.lit("#"), number)


def _commit_id(repository: Column | None) -> Column:
    if repository is None:
        return F.concat(F.lit("commit_"), _short_sha())
    return F.concat(F.lit("commit_"), repository, F.lit("@"), F.col("sha"))


def repository_nodes(repositories: DataFrame) -> DataFrame:
    """``repositories``: owner, name, full_name, description, language, stars, forks[, error].

    Without a full name the id is built from owner and name, unless the scan failed.
    """
    have = set(repositories.columns)
    failed = F.col("error").isNotNull() if "error" in have else F.lit(False)
    rows = repositories.filter(F.col("full_name").isNotNull() | ~failed)
    fallback = F.concat(F.coalesce("owner", F.lit("unknown")), F.lit("/"), F.coalesce("name", F.lit("unknown")))
    named = F.coalesce("name", F.when(F.col("full_name").isNotNull(), "Unknown").otherwise("Unknown Repository"))
    node_id = F.concat(F.lit("repo_"), F.coalesce("full_name", fallback))
    rows = rows.withColumns(
        {
            "_id": node_id, "_name": named, "owner": F.coalesce("owner", F.lit("Unknown")),
            "stars": F.coalesce("stars", F.lit(0)), "forks": F.coalesce("forks", F.lit(0)),
        }
    )
    return _nodes(rows, F.col("_id"), F.col("_name"), "repository")


def pull_nodes(pulls: DataFrame, repository: Column | None = None) -> DataFrame:
    """With ``repository`` ids hold its name; the short published ids are unique within one repository only."""
    number = F.col("number").cast("string")
    name = F.concat(F.lit("PR #"), number, F.lit(": "), _text(F.col("title")))
    return _nodes(pulls, _pull_id(repository), name, "pull_request")


def issue_nodes(issues: DataFrame, repository: Column | None = None) -> DataFrame:
    number = F.col("number").cast("string")
    name = F.concat(F.lit("Issue #"), number, F.lit(": "), _text(F.col("title")))
    return _nodes(issues, _issue_id(repository), name, "issue")


def commit_nodes(commits: DataFrame, repository: Column | None = None) -> DataFrame:
    name = F.concat(F.lit("Commit "), _short_sha(), F.lit(": "), F.substring("message", 1, 50), F.lit("..."))
    return _nodes(commits, _commit_id(repository), name, "commit")


def modifies_edges(rows: DataFrame, kind: str, repository: Column | None = None) -> DataFrame:
    """Edges from pull requests or commits to the ``.py`` files they changed."""
    source = _pull_id(repository) if kind == "pull_request" else _commit_id(repository)
    changed = rows.select(source.alias("src"), F.explode("files_changed").alias("path"))
    return changed.filter(F.col("path").endswith(".py")).select(
        "src", file_id(F.col("path")).alias("dst"), F.lit("MODIFIES").alias("type")
    )


def artifact_graph(artifacts: DataFrame, published: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all artifacts, one row per node id.

    Ids hold the repository's name and the whole hash of a commit.  ``published`` gives the short
    ids, which are meant for one repository: of several rows with an id the first in order of
    their values stays.
    """
    full = F.coalesce("repository.full_name", F.concat_ws("/", "repository.owner", "repository.name"), F.lit("unknown"))

    def flat(items: str) -> DataFrame:
        return artifacts.select(full.alias("_repository"), F.explode(items).alias("item")).select("_repository", "item.*")

    repository = None if published else F.col("_repository")
    pulls, issues, commits = flat("pulls"), flat("issues"), flat("commits")
    nodes = repository_nodes(artifacts.filter("repository IS NOT NULL").select("repository.*"))
    for part in (pull_nodes(pulls, repository), issue_nodes(issues, repository), commit_nodes(commits, repository)):
        nodes = nodes.unionByName(part, allowMissingColumns=True)
    edges = modifies_edges(pulls, "pull_request", repository).unionAll(modifies_edges(commits, "commit", repository))
    row = F.struct(*nodes.columns)
    return nodes.groupBy("id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"), edges.distinct()
