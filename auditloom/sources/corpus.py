"""Source trees and metadata documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

def read_corpus(spark: SparkSession, root: str | list[str], ext: str = "rs", max_bytes: int | None = None) -> DataFrame:
    """One row per file of a tree: repo (first folder below root), path, content, size.

    Every file is read unless ``max_bytes`` is given; the size test is on file metadata, so larger files are
    not opened, and :func:`skipped_files` lists them.  Roots inside other roots are left out, so no file comes
    twice and file contents need no shuffle.
    """
    out = _files(spark, root, ext)
    out = out if max_bytes is None else out.where(F.col("size") <= max_bytes)
    return out.select("repo", "path", F.decode("content", "utf-8").alias("content"), "size")


def skipped_files(spark: SparkSession, root: str | list[str], max_bytes: int, ext: str = "rs") -> DataFrame:
    """repo, path, size of the files that :func:`read_corpus` leaves out under ``max_bytes``; contents are not read."""
    return _files(spark, root, ext).where(F.col("size") > max_bytes).select("repo", "path", "size")


def _files(spark: SparkSession, root: str | list[str], ext: str) -> DataFrame:
    given = sorted({r.rstrip("/") for r in ([root] if isinstance(root, str) else root)})
    roots = [r for r in given if not any(r.startswith(o + "/") for o in given)]
    df = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", True)
          .load(roots))
    rel = F.col("path")
    for r in roots:
        rel = F.regexp_replace(rel, r"^[a-z0-9]+:/*" + r.rstrip("/").lstrip("/") + "/", "")
    return df.select(F.split(rel, "/")[0].alias("repo"), "path", "content", F.col("length").alias("size"))


NAMED = "accounts array<struct<name:string>>, instructions array<struct<name:string>>"


def idl_names(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """Account and instruction names of interface documents; missing lists are empty."""
    names = lambda part: F.coalesce(F.transform(part, lambda x: x["name"]), F.array().cast("array<string>"))
    parsed: Column = F.from_json(json_col, NAMED)
    return df.select(*keep, parsed.alias("_d")).select(*keep, names(F.col("_d.accounts")).alias("accounts"),
                                                       names(F.col("_d.instructions")).alias("instructions"))
