"""Secret scans in DataFrame functions alone: spans of single patterns, and multipart credentials.

Base spans: assignments, access keys and long hex runs, each leftmost and non-overlapping. Beside them weak candidates, which
alone mean little: logins, keys of 40 characters and endpoints. A credential needs an identifier, a secret and mostly an
endpoint, so a weak candidate is reported only where parts that complement it lie in its scope: parts whose starts are at most
SCOPE code points from its own, wherever in the text that is.
  login (identifier) needs a secret and an endpoint; key40 (secret) needs an identifier; endpoint needs an identifier and a secret.
The join of intervals goes by cells of SCOPE code points: a part is in scope if it lies in the candidate's own cell, or is the last of the
cell before or the first of the cell after and near enough. So a cell's first and last start stand for all its parts.

Positions come from the gaps: a text split at a pattern, and the pattern's matches, give all offsets as running sums, which
are taken in blocks, so that thousands of matches cost no quadratic copying. No shuffle, no Python.

Null counts as an empty text; repeated rows each give their row; extra columns are ignored, whatever their names are, and
without_secrets() keeps them.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import numbered, text_or_empty

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: The longest runs of hex digits that have 32 of them or more; shorter runs could only be dropped.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LOGIN = r"(?i:(user|username|login|account|client_id))\x20*[:=]\x20*[A-Za-z0-9_.@-]+"
KEY40 = r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40,}"
ENDPOINT = r"[a-z]+://[A-Za-z0-9.-]+|[A-Za-z0-9-]+\.amazonaws\.com"

#: Strings of which a text must hold one, in lower case, to match: a plain search is far cheaper than the pattern.
NEEDED = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "login": ("user", "login", "account", "client_id"), "endpoint": ("://", ".amazonaws.com")}

#: In the order in which spans with one start are listed.
BASE = ("assign", "access", "hex")
SCOPE = 1024
_BLOCK = 128


def _spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Of every match: start and end in code points, length of the match and of the group that decides whether it stands."""
    gaps = F.transform(F.split(text, F.lit(pattern), F.lit(-1)), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    wide = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else found
    return F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("long"), wide.alias("wide"))


def _placed(steps: Column) -> Column:
    """steps (gap, long, wide) to (start, end, wide). Sums of blocks first, then inside each block."""
    step = lambda x: x["gap"] + x["long"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + step(x))
    firsts = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")),
        lambda a, b: F.struct((a["sum"] + total(b)).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")),
        lambda a: a["all"],
    )

    def inside(block: Column, first: Column) -> Column:
        kind = "struct<at:int,all:array<struct<start:int,end:int,wide:int>>>"
        return F.aggregate(
            block,
            F.struct(first.alias("at"), F.array().cast("array<struct<start:int,end:int,wide:int>>").alias("all")).cast(kind),
            lambda a, x: F.struct(
                (a["at"] + step(x)).alias("at"),
                F.concat(a["all"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + step(x)).alias("end"), x["wide"].alias("wide")))).alias("all"),
            ).cast(kind),
            lambda a: a["all"],
        )

    made = F.flatten(F.zip_with(blocks, firsts, inside))
    return F.when(F.size(steps) > 0, made).otherwise(F.array().cast("array<struct<start:int,end:int,wide:int>>"))


def _starts(*spans: str) -> Column:
    return F.array_sort(F.transform(F.concat(*spans), lambda x: x["start"]))


def _cells(starts: str) -> Column:
    """Cell number to the first and last of sorted starts in it. starts is a column: a lambda would work an expression out anew for
    each element."""
    cell = lambda x: F.floor(x / SCOPE).cast("int")
    edge = lambda by: F.filter(starts, lambda x, i: F.coalesce(cell(x) != cell(F.get(starts, i + by)), F.lit(True)))
    ends = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(cell(a).alias("key"), F.struct(a.alias("first"), b.alias("last")).alias("value")))
    return F.map_from_entries(ends)


def _near(x: Column, cells: Column) -> Column:
    """Whether any part of the cells starts within SCOPE of span x."""
    cell = F.floor(x["start"] / SCOPE).cast("int")
    before, after = F.try_element_at(cells, cell - 1)["last"], F.try_element_at(cells, cell + 1)["first"]
    return F.map_contains_key(cells, cell) | F.coalesce(before >= x["start"] - SCOPE, F.lit(False)) | F.coalesce(after <= x["start"] + SCOPE, F.lit(False))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, with assign, access, hex, login, key40 and endpoint: arrays of (start, end, wide)."""
    return _found(docs.select("doc_id", F.col("text").alias("_text")), "_text")


def _found(docs: DataFrame, text: str) -> DataFrame:
    """docs, whose columns have other names than ours, without the text alone, with the spans of each kind."""
    kinds = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "login": (LOGIN, 0), "key40": (KEY40, 0), "endpoint": (ENDPOINT, 0)}
    keep = [c for c in docs.columns if c != "_text"]
    df = docs.withColumn("_text", text_or_empty(text)).withColumn("_low", F.lower("_text"))

    def may(kind: str, pattern: str) -> Column:
        held = [F.contains("_low", F.lit(x)) for x in NEEDED.get(kind, ())]
        return functools.reduce(operator.or_, held, F.lit(not held)) & F.col("_text").rlike(pattern)

    # a text without a match, by far the most, is told by a search and not taken apart
    steps = {k: F.when(may(k, p), _spans(F.col("_text"), p, g)).otherwise(F.array().cast("array<struct<gap:int,long:int,wide:int>>")) for k, (p, g) in kinds.items()}
    df = df.select(*keep, *(v.cast("array<struct<gap:int,long:int,wide:int>>").alias(k) for k, v in steps.items()))
    df = df.withColumns({k: _placed(F.col(k)) for k in kinds})
    df = df.withColumn("assign", F.filter("assign", lambda x: x["wide"] >= 8)).withColumn("access", F.filter("access", lambda x: x["wide"] >= 16))
    # long hex runs and words inside URLs are 40 characters too: only the exact length is a key
    df = df.withColumn("key40", F.filter("key40", lambda x: x["wide"] == 40))
    df = df.withColumns({"_id": _starts("access", "login"), "_secret": _starts("assign", "hex", "key40"), "_end": _starts("endpoint")})
    df = df.withColumns({c: _cells(c) for c in ("_id", "_secret", "_end")})

    def linked(kind: str, *complements: str) -> Column:
        there = functools.reduce(operator.and_, (F.size(c) > 0 for c in complements), F.size(kind) > 0)
        return F.when(there, F.filter(kind, lambda x: functools.reduce(operator.and_, (_near(x, F.col(c)) for c in complements)))).otherwise(F.filter(kind, lambda x: F.lit(False))).alias(kind)

    return df.select(*keep, "assign", "access", "hex", linked("login", "_secret", "_end"), linked("key40", "_id"), linked("endpoint", "_id", "_secret"))


def _listed(*kinds: str) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""

    def said(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("said")))

    each = [said(i, kind) for i, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["said"]), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    found = secrets(docs)
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(*BASE).cast("binary"), 256).alias("base_sha256"),
        _listed(*BASE, "login", "key40", "endpoint").alias("spans"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("login", "key40", "endpoint")),
    )


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with the spans of secrets in their texts replaced by a mark; all rows, columns and all other text stay."""
    rows, named = numbered(docs)
    found, text = _found(rows, named["text"]), F.col(named["text"])
    hidden = F.array_sort(F.transform(F.concat("assign", "access", "hex", "login", "key40"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    found = found.withColumn("_hidden", hidden)
    masked = found.withColumn(named["text"], F.when(F.size("_hidden") == 0, text).otherwise(_masked(text, F.col("_hidden"))))
    if "n_chars" in named:
        masked = masked.withColumn(named["n_chars"], F.when(F.size("_hidden") == 0, F.col(named["n_chars"])).otherwise(F.length(named["text"])))
    return masked.select(*rows.columns).toDF(*docs.columns)


def _masked(text: Column, spans: Column) -> Column:
    """Spans may overlap: each keeps the text from the furthest end before it to its own start, and adds the mark. A block of spans
    works on its own piece of the text, so that thousands of them cost neither long searches nor quadratic copying."""
    none = F.array().cast("array<string>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int")), lambda b: F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK)))
    far = lambda block, at: F.aggregate(block, at, lambda a, x: F.greatest(a, x["end"]))
    # the furthest end before each block, and after the last
    ends = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all")),
        lambda a, block: F.struct(far(block, a["at"]).alias("at"), F.concat(a["all"], F.array(far(block, a["at"]))).alias("all")),
        lambda a: a["all"],
    )
    kind = "struct<at:int,parts:array<string>>"

    def joined(block: Column, first: Column) -> Column:
        def step(piece: Column):
            keep = lambda a, x: F.array(F.substring(piece, a["at"] - first + 1, x["start"] - a["at"]), F.lit("[SECRET]"))
            return lambda a, x: F.struct(F.greatest(a["at"], x["end"]), F.concat(a["parts"], F.when(x["start"] >= a["at"], keep(a, x)).otherwise(none))).cast(kind)

        own = F.substring(text, first + 1, far(block, first) - first)
        return F.get(F.transform(F.array(own), lambda piece: F.array_join(F.aggregate(block, F.struct(first, none).cast(kind), step(piece))["parts"], "")), F.lit(0))

    return F.concat(F.array_join(F.zip_with(blocks, F.slice(ends, F.lit(1), F.size(ends) - 1), joined), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
