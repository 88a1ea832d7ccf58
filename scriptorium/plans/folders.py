"""Queries on folders: each document of the table is a file whose path follows from its source, language and id."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.plans.marks import _t
from scriptorium.sources import documents, folders

ROOT = "/data/set"
_NAMES = ("rubric {}", "Brief_{}", "marking_scheme {}", "sample {}", "support {}", "essay {}", "essay {}", "essay {}", "notes {}")
_ENDS = (".txt", ".PDF", ".docx", ".md")


def _files(spark, sf):
    """path, text, digest: root files, files of a source, and deeper ones in a folder named by language."""
    n = F.coalesce("doc_id", F.lit(0))
    at = lambda texts, m: F.element_at(F.array(*map(F.lit, texts)), (m % len(texts) + 1).cast("int"))
    name = F.concat(F.replace(at(_NAMES, n), F.lit("{}"), n.cast("string")), at(_ENDS, F.floor(n / 9)))
    below = F.when(n % 7 == 0, "").when(n % 7 < 4, F.concat("source", F.lit("/"))).otherwise(F.concat_ws("/", "source", F.when(n % 7 == 6, F.concat(F.lit("Guidance "), "lang")).otherwise(F.col("lang")), F.lit("")))
    d = _t(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    return d.select(F.concat(F.lit(ROOT + "/"), below, name).alias("path"), "text", F.md5("text").alias("digest"))


def assessment_folders(spark, sf):
    """A folder for each source; every file has a role by its name or folder."""
    return folders.assessments(_files(spark, sf), ROOT).select("path", "assessment", "role", "ord")


def single_folder(spark, sf):
    """The root as one assessment."""
    return folders.single_assessment(_files(spark, sf), ROOT).select("path", "assessment", "role", "ord")


def assessment_contexts(spark, sf):
    """The whole texts of each assessment's documents by role."""
    return folders.contexts(folders.assessments(_files(spark, sf), ROOT))


def snapshot_manifest(spark, sf):
    """What a snapshot of each assessment holds, as JSON."""
    return folders.manifest_json(folders.manifest(folders.assessments(_files(spark, sf), ROOT)))


def manifest_changes(spark, sf):
    """Files against a manifest that knows other texts of some, lacks some, and holds some that are gone."""
    files = _files(spark, sf)
    size = F.length("text") % 5
    now = files.where(size != 0)
    held = files.where(size != 1).withColumn("digest", F.when(size == 2, "old").otherwise(F.col("digest")))
    return folders.changes(now, held).groupBy("change").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def sample_lists(spark, sf):
    """Lists of samples of each source, of which the first by precedence counts."""
    at = F.element_at(F.array(*map(F.lit, (*folders.SAMPLE_SOURCES, "other"))), (F.length("text") % 6 + 1).cast("int"))
    lists = folders.assessments(_files(spark, sf), ROOT).withColumn("source", at).withColumn("path", F.when(F.length("text") % 12 == 0, " ").otherwise(F.col("path")))
    return folders.chosen_samples(lists, "assessment")


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "([" + ", ".join(map(_q, xs)) + "])"


_HITS = " ".join(f"WHEN {' OR '.join(f'contains(seen, {_q(w)})' for w in words)} THEN {_q(name)}" for name, words in documents.ROLES)
_FILES = f"""
files AS (
  SELECT '{ROOT}/' || below || name AS path, text, md5(text) AS digest, name, below, length(text) AS n, regexp_replace(name, '\\.[^.]*$', '') AS stem, below AS folder FROM (
    SELECT text, replace({_list(_NAMES)}[doc_id % {len(_NAMES)} + 1], '{{}}', doc_id::VARCHAR) || {_list(_ENDS)}[(doc_id // 9) % {len(_ENDS)} + 1] AS name,
      CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 < 4 THEN source || '/' WHEN doc_id % 7 = 6 THEN source || '/Guidance ' || lang || '/' ELSE source || '/' || lang || '/' END AS below
    FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL)
), readable AS (
  SELECT *, lower(replace(stem || ' ' || coalesce(nullif(regexp_extract(below, '([^/]*)/$', 1), ''), 'set'), '_', ' ')) AS seen FROM files WHERE regexp_matches(lower(name), '\\.(txt|pdf|docx)$')
), roled AS (
  SELECT *, CASE {_HITS} ELSE 'submission' END AS role, split_part(below, '/', 1) AS assessment FROM readable
), known AS (
  SELECT *, row_number() OVER (PARTITION BY assessment, role ORDER BY path) AS ord FROM roled WHERE below <> ''
)"""

SQL = {
    "assessment_folders": f"WITH {_FILES} SELECT path, assessment, role, ord::INT AS ord FROM known",
    "single_folder": f"WITH {_FILES}, own AS (SELECT path, below, CASE WHEN below = '' THEN role ELSE 'submission' END AS role FROM roled) SELECT path, 'set' AS assessment, role, (row_number() OVER (PARTITION BY role ORDER BY below = '', path))::INT AS ord FROM own",
    "assessment_contexts": f"WITH {_FILES} SELECT assessment, " + ", ".join(f"coalesce(string_agg(trim(text), chr(10) || chr(10) ORDER BY path) FILTER (role = '{r}' AND trim(text) <> ''), '') AS {r}" for r, _ in documents.ROLES) + ", count(*) FILTER (role = 'submission') AS n_submissions FROM known GROUP BY 1",
    "snapshot_manifest": f"""WITH {_FILES}, copies AS (SELECT assessment, role, role || '/' || printf('%03d', ord) || '_' || regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g') AS copy FROM known),
        listed AS (SELECT assessment, role, '"' || role || '":["' || string_agg(copy, '","' ORDER BY copy) || '"]' AS said FROM copies GROUP BY 1, 2)
        SELECT assessment, '{{' || string_agg(said, ',' ORDER BY role) || '}}' AS manifest FROM listed GROUP BY 1""",
    "manifest_changes": f"WITH {_FILES} SELECT CASE n % 5 WHEN 0 THEN 'gone' WHEN 1 THEN 'new' WHEN 2 THEN 'changed' ELSE 'same' END AS change, count(*) AS n, min(path) AS first FROM files GROUP BY 1",
    "sample_lists": f"""WITH {_FILES}, lists AS (SELECT assessment, path, n % 6 + 1 AS place FROM known WHERE n % 6 < 5 AND n % 12 <> 0), first AS (SELECT assessment, min(place) AS place FROM lists GROUP BY 1)
        SELECT assessment, {_list(folders.SAMPLE_SOURCES)}[place] AS source, path FROM lists JOIN first USING (assessment, place)""",
}
QUERIES = {name: globals()[name] for name in SQL}
