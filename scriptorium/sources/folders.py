"""Folders of files to assessments, lists of samples by precedence, and manifests of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.sources.documents import ROLES, combined, role, safe_name, supported

#: S16. Where a list of samples may come from, the first that names any.
SAMPLE_SOURCES = ("argument", "list_file", "root", "manifest", "default")


def _below(path: Column, root: str) -> Column:
    """The names of a path below a root; null for what lies elsewhere."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.split(F.substring(path, len(top) + 1, 1 << 20), "/"))


def _role(names: Column, root: str) -> Column:
    file = F.element_at(names, -1)
    parent = F.when(F.size(names) > 1, F.get(names, F.size(names) - 2)).otherwise(root.rstrip("/").rsplit("/", 1)[-1])
    return role(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), parent)


def assessments(files: DataFrame, root: str) -> DataFrame:
    """A root whose folders are assessments: files (path and others) with assessment, role and ord, the place among the files of
    that role. A file at any depth belongs to the folder just below the root that it lies in; files of the root itself and such as
    no reader knows are left out."""
    names = _below(F.col("path"), root)
    rows = files.where(supported(F.col("path"))).withColumn("_n", names).where(F.size("_n") > 1)
    return _ordered(rows.select(*files.columns, F.col("_n")[0].alias("assessment"), _role(F.col("_n"), root).alias("role")), F.lit(0))


def single_assessment(files: DataFrame, root: str, name: str | None = None) -> DataFrame:
    """A root that is one assessment: its own files have roles by their names, files in the folders below it are submissions, and
    come before submissions in the root."""
    rows = files.where(supported(F.col("path"))).withColumn("_n", _below(F.col("path"), root)).where(F.col("_n").isNotNull())
    own = F.when(F.size("_n") > 1, "submission").otherwise(_role(F.col("_n"), root))
    top = (F.size("_n") == 1).cast("int")
    out = rows.select(*files.columns, F.lit(name or root.rstrip("/").rsplit("/", 1)[-1]).alias("assessment"), own.alias("role"), top.alias("_top"))
    return _ordered(out, F.col("_top")).drop("_top")


def _ordered(rows: DataFrame, first: Column) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("assessment", "role").orderBy(first, "path")))


def contexts(files: DataFrame) -> DataFrame:
    """A row for each assessment: the texts of its documents by role (files: assessment, role, path, text), empty where there is
    none, and the number of submissions."""
    names = [name for name, _ in ROLES]
    texts = combined(files.where(F.col("role") != "submission"), "assessment", "role")
    wide = texts.groupBy("assessment").agg(*(F.coalesce(F.max(F.when(F.col("role") == n, F.col("text"))), F.lit("")).alias(n) for n in names))
    number = files.groupBy("assessment").agg(F.count_if(F.col("role") == "submission").alias("n_submissions"))
    return number.join(wide, "assessment", "left").select("assessment", *(F.coalesce(n, F.lit("")).alias(n) for n in names), "n_submissions")


def chosen_samples(lists: DataFrame, *key: str) -> DataFrame:
    """Of the lists of samples (key, source, path) of each key the first by precedence that names any file that a reader knows: key, path,
    in order of the list's paths. Sources that are not known are passed over."""
    place = F.array_position(F.array(*map(F.lit, SAMPLE_SOURCES)), F.col("source"))
    known = lists.where((F.trim("path") != "") & (place > 0)).withColumn("_place", place)
    first = known.groupBy(*key).agg(F.min("_place").alias("_first"))
    out = known.join(first, list(key)) if key else known.crossJoin(first)
    return out.where(F.col("_place") == F.col("_first")).select(*key, "source", F.trim("path").alias("path"))


def manifest(files: DataFrame) -> DataFrame:
    """What a snapshot holds: files (assessment, role, ord, path, digest) with the name of the copy, which no character can break."""
    return files.select("assessment", "role", "path", "digest", F.concat_ws("/", "role", safe_name(F.col("ord"), F.element_at(F.split("path", "/"), -1))).alias("copy"))


def manifest_json(held: DataFrame) -> DataFrame:
    """A manifest as JSON for each assessment: role to the copies in order."""
    listed = held.groupBy("assessment", "role").agg(F.array_sort(F.collect_list("copy")).alias("copies"))
    by = listed.groupBy("assessment").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "copies")))).alias("m"))
    return by.select("assessment", F.to_json("m").alias("manifest"))


def changes(files: DataFrame, held: DataFrame) -> DataFrame:
    """Files (path, digest) against the manifest of an earlier run: path and change, new, changed, same or gone. What is the same need not
    be read again."""
    now, then = files.select("path", F.col("digest").alias("now")), held.select("path", F.col("digest").alias("then"))
    both = now.join(then, "path", "full_outer")
    change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed").otherwise("same")
    return both.select("path", change.alias("change"))
