"""Text, conversations and source trees as DataFrames."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, language_of


def texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, content): whole files; a glob is a path."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, content): a row for each line that is not blank."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(F.trim("content") != "")


def turns(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(conv_id, turn, role, text) of JSON lines; bad lines are dropped. Content is text or blocks of text."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("conv_id"), F.col("value").alias("v")).where("v <> ''")
    parsed = raw.select("conv_id", F.from_json("v", "role string, content string, ts string", {"mode": "PERMISSIVE"}).alias("j"), "v")
    blocks = F.from_json(F.col("j.content"), "array<struct<type:string,text:string>>")
    text = F.when(F.col("j.content").startswith("["), F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "\n")).otherwise(F.col("j.content"))
    good = parsed.where("j.role is not null").select("conv_id", "j.role", text.alias("text"))
    from pyspark.sql.window import Window

    order = F.monotonically_increasing_id()
    return good.withColumn("_o", order).withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("_o")) - 1).select("conv_id", "turn", "role", "text")


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, language, content): files of known languages under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.select("path", language_of(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"))
    return out.where("language is not null")


def git_files(spark: SparkSession, repo: str, commits: Sequence[str], paths: Sequence[str] = ()) -> DataFrame:
    """(commit, path, content) of the files of known languages of a repository at commits.

    Executors run git, a task for each commit, so the repository must be at ``repo`` for all of them, as on a shared
    folder. Bytes that aren't UTF-8 are replaced.
    """
    only = ["--", *paths] if paths else []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for sha in part["commit"]:
                listed = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "-z", sha, *only], capture_output=True, check=True).stdout
                for row in listed.split(b"\0"):
                    about, _, name = row.partition(b"\t")
                    path = name.decode("utf-8", "replace")
                    if about.split()[1:2] != [b"blob"] or path.rpartition(".")[2].lower() not in LANGUAGES:
                        continue
                    blob = subprocess.run(["git", "-C", repo, "cat-file", "blob", about.split()[2].decode()], capture_output=True, check=True).stdout
                    yield pd.DataFrame([(sha, path, blob.decode("utf-8", "replace"))], columns=["commit", "path", "content"])

    shas = spark.createDataFrame([(c,) for c in commits], "commit string").repartition(max(1, len(commits)), "commit")
    return shas.mapInPandas(run, "commit string, path string, content string").where(language_of(F.col("path")).isNotNull())


def git_commits(repo: str, limit: int | None = None) -> list[str]:
    """Commits from the newest."""
    out = subprocess.run(["git", "-C", repo, "log", "--format=%H", *([f"-{limit}"] if limit else [])], capture_output=True, text=True, check=True).stdout
    return out.split()


def git_changed(repo: str, since: str, until: str = "HEAD") -> list[str]:
    """Files that differ between two commits: what an incremental scan reads."""
    return subprocess.run(["git", "-C", repo, "diff", "--name-only", since, until], capture_output=True, text=True, check=True).stdout.splitlines()
