"""Readers of archived pages of a code host: commits, pull requests, reviews, CI runs and their jobs.

The pages are rows (scope, raw): ``raw`` is one JSON answer as it came, ``scope``
what was asked for (a pull request's number, a run's id).  Items are unnested on
the executors; broken pages give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

COMMIT = "sha string, commit struct<message: string, author: struct<name: string, date: timestamp>>, parents array<struct<sha: string>>"
PULL = "number long, title string, state string, user struct<login: string>, updated_at timestamp, merged_at timestamp"
REVIEW = "id long, state string, user struct<login: string>, submitted_at timestamp"
RUN = "id long, name string, status string, conclusion string, head_sha string, created_at timestamp"
JOB = "id long, name string, conclusion string, steps array<struct<number: int, name: string, conclusion: string>>"


def _items(pages: DataFrame, schema: str, key: str | None = None) -> DataFrame:
    """scope and one item a row, of pages that are an array or an object with the array under ``key``."""
    items = ArrayType(StructType.fromDDL(schema))
    read = F.from_json("raw", items) if key is None else F.from_json("raw", StructType().add(key, items))[key]
    return pages.select("scope", F.explode(read).alias("item")).select("scope", "item.*")


def _after(at: Column, since: str | None, strictly: bool = False) -> Column:
    if since is None:
        return F.lit(True)
    mark = F.lit(since).cast("timestamp")
    return at > mark if strictly else at >= mark


def commits(pages: DataFrame, since: str | None = None) -> DataFrame:
    """Commits from ``since`` on; the title is the message's first line."""
    rows = _items(pages, COMMIT)
    at = F.col("commit.author.date")
    return rows.filter(_after(at, since)).select("sha", F.substring_index("commit.message", "\n", 1).alias("title"), F.col("commit.author.name").alias("author"), at.alias("authored_at"), F.size("parents").alias("n_parents"))


def pull_requests(pages: DataFrame, since: str | None = None) -> DataFrame:
    """Pull requests updated after ``since``; one without that instant stays."""
    rows = _items(pages, PULL)
    return rows.filter(F.col("updated_at").isNull() | _after(F.col("updated_at"), since, strictly=True)).select("number", "title", "state", F.col("user.login").alias("author"), "updated_at", F.col("merged_at").isNotNull().alias("merged"))


def reviews(pages: DataFrame, pulls: DataFrame) -> DataFrame:
    """Reviews of the given pull requests only; the scope is the request's number."""
    rows = _items(pages, REVIEW).withColumn("number", F.col("scope").cast("long"))
    return rows.join(pulls.select("number").distinct(), "number", "left_semi").select("number", F.col("id").alias("review_id"), "state", F.col("user.login").alias("reviewer"), "submitted_at")


def workflow_runs(pages: DataFrame, since: str | None = None) -> DataFrame:
    return _items(pages, RUN, "workflow_runs").filter(_after(F.col("created_at"), since)).select(F.col("id").alias("run_id"), "name", "status", "conclusion", "head_sha", "created_at")


def run_jobs(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs of the runs that did not succeed, with the first step that failed; the scope is the run's id."""
    rows = _items(pages, JOB, "jobs").withColumn("run_id", F.col("scope").cast("long"))
    red = runs.filter(F.coalesce("conclusion", F.lit("")) != "success").select("run_id").distinct()
    failed = F.filter("steps", lambda s: s["conclusion"] == "failure")
    return rows.join(red, "run_id", "left_semi").select("run_id", F.col("id").alias("job_id"), "name", "conclusion", F.size("steps").alias("n_steps"), F.get(failed, F.lit(0))["name"].alias("failed_step"))
