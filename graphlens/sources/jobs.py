"""Job and run listings, logs and destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ["F"]


def list_jobs(jobs: DataFrame, include_terminal: bool = False, limit: int | None = 200) -> DataFrame:
    """The newest jobs first; ended ones only where asked for; ``limit`` None where a cluster is given."""
    rows = jobs if include_terminal else jobs.filter(~F.col("state").isin(TERMINAL))
    ordered = rows.orderBy(F.desc("submitted_at"), F.desc("job_id"))
    return ordered if limit is None else ordered.limit(limit)


def job_detail(jobs: DataFrame, transitions: DataFrame) -> DataFrame:
    """Of each job its last attempt, with its transitions in order."""
    others = [F.col(c) for c in jobs.columns if c not in ("job_id", "attempt")]
    last = jobs.groupBy("job_id").agg(F.max(F.struct("attempt", *others)).alias("j")).select("job_id", "j.*")
    told = transitions.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "ord", "state"))), lambda x: x["state"]), ">").alias("states"))
    return last.join(told, "job_id", "left")


def log_tail(logs: DataFrame, n: int | None) -> DataFrame:
    """id, stream, tail: the last ``n`` lines of each stream (None and 0: all), and whether the text is missing."""
    lines = F.split("text", "\n")
    tail = F.col("text") if not n else F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")
    return logs.select("id", "stream", tail.alias("tail"), F.col("text").isNull().alias("missing"))


def asked_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """The job rows of requests (job_id, attempt): that attempt, or the latest one where it isn't known."""
    exact = requests.select("job_id", F.col("attempt").alias("asked")).distinct()
    both = exact.join(jobs, "job_id")
    pick = F.max(F.struct((F.col("attempt") == F.col("asked")).alias("same"), "attempt", *[c for c in jobs.columns if c not in ("job_id", "attempt")])).alias("j")
    return both.groupBy("job_id", "asked").agg(pick).select("job_id", "asked", "j.*").drop("same")


def log_paths(jobs: DataFrame, prefix: str) -> DataFrame:
    """The jobs with stdout_path, stderr_path and job_dir lifted out of their ``metadata`` map, where they stand under ``prefix``."""
    return jobs.withColumns({name: F.try_element_at("metadata", F.lit(prefix + name)) for name in ("stdout_path", "stderr_path", "job_dir")})


def destinations(profiles: DataFrame, hosts: DataFrame | None, error: str | None = None) -> DataFrame:
    """Profiles and hosts with their ``source``; columns that one lacks are null. Where the hosts couldn't be read a row with the error stands for them."""
    out = profiles.withColumn("source", F.lit("profile"))
    if hosts is not None:
        out = out.unionByName(hosts.withColumn("source", F.lit("ssh")), allowMissingColumns=True)
    if error is not None:
        out = out.unionByName(profiles.sparkSession.range(1).select(F.lit("ssh").alias("source"), F.lit(error).alias("error")), allowMissingColumns=True)
    return out


def list_runs(runs: DataFrame, scope: str, value, status: str | None, limit: int) -> DataFrame:
    """Runs of a scope (``workspace`` or a column), by status, newest first within each scope value."""
    rows = runs if scope == "workspace" else runs.filter(F.col(scope) == value)
    rows = rows if status is None else rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)
