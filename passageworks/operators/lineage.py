"""Document versions: the newest commit that touched a file and did not delete it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_name_status(diffs: DataFrame, diff: str = "diff") -> DataFrame:
    """One row per kept line of a name-status text: ``change_type`` and ``path``.

    Two fields are a change of one path, deletions left out; three fields that start with R are a
    rename and count for the new path; every other line is ignored.
    """
    kept = [c for c in diffs.columns if c != diff]
    lines = diffs.select(*kept, F.explode(F.split(diff, "\n", -1)).alias("_line"))
    fields = lines.filter("_line <> ''").withColumn("_field", F.split("_line", "\t", -1))
    n, status = F.size("_field"), F.col("_field")[0]
    changed = (n == 2) & (status != "D")
    renamed = (n == 3) & status.startswith("R")
    return fields.filter(changed | renamed).select(
        *kept, status.alias("change_type"), F.element_at("_field", -1).alias("path")
    )


def touched_paths(
    changes: DataFrame, branch: str | None = None, folder: Column | None = None
) -> DataFrame:
    """``commit_hash, seq, path`` of the changes on a branch that left a file in place.

    ``folder`` is put before the paths of the log, which are relative to their repository.
    """
    if branch is not None:
        changes = changes.filter(F.col("branch") == branch)
    path = F.col("new_path")
    if folder is not None:
        path = F.concat(folder, F.lit("/"), path)
    return changes.filter(~F.col("change_type").isin("D", "DELETE")).select(
        "commit_hash", "seq", path.alias("path")
    )


def merge_touches(
    merges: DataFrame, branch: str | None = None, folder: Column | None = None, diff: str = "diff"
) -> DataFrame:
    """``commit_hash, seq, path`` of what merge commits left in place.

    ``merges`` has ``commit_hash, seq, branch`` and the name-status text of the difference to the
    first parent: what the merge brought to its branch, whichever commits made it elsewhere.
    """
    if branch is not None:
        merges = merges.filter(F.col("branch") == branch)
    kept = [c for c in merges.columns if c != diff]
    changes = parse_name_status(merges.select(*kept, diff), diff)
    path = F.col("path") if folder is None else F.concat(folder, F.lit("/"), "path")
    return changes.select("commit_hash", "seq", path.alias("path"))


def all_touches(
    changes: DataFrame, merges: DataFrame, branch: str | None = None, folder: Column | None = None
) -> DataFrame:
    """``commit_hash, seq, path`` of ordinary commits and of merges, in one order by ``seq``.

    A merge counts by its difference to the first parent alone: changes that the log lists under the
    same commit are left out. Logs are short rows; a text is parsed where it is read, unshuffled.
    """
    same = [c for c in ("repo_name", "commit_hash") if c in changes.columns and c in merges.columns]
    ordinary = changes.join(merges.select(*same).distinct(), same, "left_anti")
    return touched_paths(ordinary, branch, folder).unionByName(merge_touches(merges, branch, folder))


def latest_versions(touched: DataFrame) -> DataFrame:
    """``path, document_version``: the commit with the highest ``seq`` of each path.

    Partial aggregation leaves one row per path and task, so a path touched by a third of all
    commits is no heavier than any other.
    """
    return touched.groupBy("path").agg(F.max_by("commit_hash", "seq").alias("document_version"))


def latest_versions_by_rank(touched: DataFrame) -> DataFrame:
    """The window form; the rank limit is applied before the shuffle as well."""
    newest = Window.partitionBy("path").orderBy(F.desc("seq"))
    return (
        touched.withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1")
        .select("path", F.col("commit_hash").alias("document_version"))
    )


def with_versions(files: DataFrame, touched: DataFrame, path: str = "filepath") -> DataFrame:
    """Files with their version; a file no commit touched keeps a null version."""
    found = latest_versions(touched).withColumnRenamed("path", path)
    return files.join(found, path, "left")
