"""Byte sources (S1, S3, S7, S10, S13). Only bytes go through Python; what follows is DataFrame work."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import any_of, bound

#: Tried in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "utf-16", "cp1252", "latin-1")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decoded(raw: bytes) -> str:
    """S1."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def docx_text(raw: bytes) -> str:
    """S3: paragraphs of word/document.xml with inserted and deleted text and tabs."""
    with zipfile.ZipFile(io.BytesIO(raw)) as held:
        tree = ElementTree.fromstring(held.read("word/document.xml"))
    said = []
    for paragraph in tree.iter(_W + "p"):
        pieces = ["\t" if x.tag == _W + "tab" else x.text or "" for x in paragraph.iter() if x.tag in (_W + "t", _W + "delText", _W + "tab")]
        said.append("".join(pieces))
    return "\n".join(said)


def docx_paragraphs(raw: bytes) -> tuple[list[dict], list[str]]:
    """What heading() needs to know of each paragraph of the body, and the rows of its tables as 'a | b'."""
    with zipfile.ZipFile(io.BytesIO(raw)) as held:
        tree = ElementTree.fromstring(held.read("word/document.xml"))
    body = tree.find(_W + "body")
    said, rows = [], []
    for paragraph in body.findall(_W + "p") if body is not None else ():
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        runs = [r for r in paragraph.iter(_W + "r") if "".join(x.text or "" for x in r.iter(_W + "t")).strip()]
        on = lambda b: b is not None and b.get(_W + "val", "true") not in ("0", "false")
        sizes = [int(z.get(_W + "val")) / 2 for r in runs if (z := r.find(f"{_W}rPr/{_W}sz")) is not None]
        text = "".join(x.text or "" for x in paragraph.iter(_W + "t")).strip()
        if text:
            said.append({"text": text, "bold": bool(runs) and all(on(r.find(f"{_W}rPr/{_W}b")) for r in runs), "size": max(sizes, default=None), "style": style.get(_W + "val", "") if style is not None else ""})
    for row in tree.iter(_W + "tr"):
        cells = [" ".join("".join(x.text or "" for x in cell.iter(_W + "t")).split()) for cell in row.findall(_W + "tc")]
        if any(cells):
            rows.append(" | ".join(c for c in cells if c))
    return said, rows


def _paragraphs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for path, raw in zip(frame["path"], frame["content"], strict=True):
            try:
                out.append((path, *docx_paragraphs(bytes(raw)), None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                out.append((path, [], [], type(e).__name__))
        yield pd.DataFrame(out, columns=["path", "paragraphs", "rows", "error_code"])


def structure_texts(files: DataFrame) -> DataFrame:
    """Path, text, error_code of DOCX files: paragraphs, headings marked with [HEADING], then table rows."""
    found = files.select("path", "content").mapInPandas(_paragraphs, "path string, paragraphs array<struct<text:string,bold:boolean,size:double,style:string>>, rows array<string>, error_code string")
    lines = F.transform("paragraphs", lambda x: F.concat(F.when(heading(x["text"], x["bold"], x["size"], x["style"]), "[HEADING] ").otherwise(""), x["text"]))
    return found.select("path", F.when(F.col("error_code").isNull(), F.array_join(F.concat(lines, "rows"), "\n")).alias("text"), "error_code")


def pdf_text(raw: bytes) -> str:
    """The pages of a PDF, one below the other, by an optional library."""
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    readers = {"txt": decoded, "docx": docx_text, "pdf": pdf_text}
    for frame in frames:
        out = []
        for path, raw in zip(frame["path"], frame["content"], strict=True):
            suffix = path.rsplit(".", 1)[-1].lower()
            if suffix not in readers:
                out.append((path, None, "unsupported_type"))
                continue
            try:
                out.append((path, readers[suffix](bytes(raw)), None))
            except ImportError:
                out.append((path, None, "no_pdf_library"))
            except Exception as e:  # an unreadable file is a row, whatever its reader says of it
                out.append((path, None, type(e).__name__))
        yield pd.DataFrame(out, columns=["path", "text", "error_code"])


def texts(files: DataFrame) -> DataFrame:
    """Path, text, error_code of files (path, content), by suffix. An unreadable file is a row with an error."""
    return files.select("path", "content").mapInPandas(_texts, "path string, text string, error_code string")


def read(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder that readers know; others are not opened."""
    return texts(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(supported(F.col("path"))))


#: S13. The first role of whose words one is in the stem or the parent folder; _ is a space there.
ROLES = (
    ("rubric", ("rubric",)),
    ("brief", ("brief", "assignment")),
    ("scheme", ("marking_scheme", "marking scheme", "scheme")),
    ("graded_sample", ("graded_sample", "graded sample", "sample", "example")),
    ("other", ("support", "context", "guidance", "instruction")),
)


def role(stem: Column, parent: Column) -> Column:
    def named(seen: Column) -> Column:
        out = F.lit("submission")
        for name, words in reversed(ROLES):
            out = F.when(any_of(seen, words), name).otherwise(out)
        return out

    return bound(F.lower(F.replace(F.concat_ws(" ", stem, parent), F.lit("_"), F.lit(" "))), named)


def row_text(*columns: str) -> Column:
    """The filled cells of a row, each under its column's name."""
    return F.concat_ws("\n\n", *(F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c}:\n"), F.trim(F.col(c)))) for c in columns))


def safe_name(index: Column, name: Column) -> Column:
    """The name of a copy in a snapshot: a number of three digits, and what is safe in a file name."""
    safe = F.regexp_replace(F.trim(name), "[^A-Za-z0-9._-]+", "_")
    return F.concat(F.format_string("%03d", index.cast("int")), F.lit("_"), F.when(safe == "", "file").otherwise(safe))


def supported(path: Column) -> Column:
    """Files that readers know."""
    return F.lower(path).rlike(r"\.(txt|pdf|docx)$")


def combined(files: DataFrame, *key: str) -> DataFrame:
    """The texts (path, text) of each key in the order of their paths, blank ones left out, with blank lines between."""
    rows = files.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("path", F.trim("text").alias("text")))).alias("rows"))
    return rows.select(*key, F.array_join(F.transform("rows", lambda x: x["text"]), "\n\n").alias("text"))


#: S5. How a heading may begin, be numbered, or be written.
HEADING = r"(?i)^(part|question|section|appendix)\b"
NUMBERED = r"(?i)^(q(?:uestion)?\s*\d+[a-z]?|[ivxlcdm]+[\.\)]|(?:\d+|[A-Z])[\.\)])\b"
TITLE = r"^[A-Z][A-Za-z0-9 ,:/&()'\"-]{0,90}$"


def heading(text: Column, bold: Column, size: Column, style: Column) -> Column:
    """Whether a paragraph of a DOCX is a heading, by its text (bold: whether all runs are; size: the largest, in points, null
    where none is stated) and the name of its style."""
    flat = F.regexp_replace(F.trim(text), r"\s+", " ")
    words = F.size(F.split(flat, " "))
    large = lambda n: F.coalesce(size >= n, F.lit(False))
    capitals = (F.upper(flat) == flat) & (F.lower(flat) != flat) & (words <= 12)
    styled = F.contains(F.lower(F.coalesce(style, F.lit(""))), F.lit("heading"))
    found = flat.rlike(HEADING) | styled | (flat.rlike(NUMBERED) & (words <= 12)) | (flat.rlike(TITLE) & (bold | large(13))) | capitals | (bold & (words <= 16)) | (large(14) & (words <= 20))
    return F.coalesce((flat != "") & (F.length(flat) <= 140) & found, F.lit(False))


def docx_variant(primary: Column, fallback: Column) -> Column:
    """The variant that keeps formulas, if it has any and few pictures, else the other one where it has pictures only. Fixed
    values."""
    first, second = F.trim(F.coalesce(primary, F.lit(""))), F.trim(F.coalesce(fallback, F.lit("")))
    formulas, pictures = F.regexp_count(first, F.lit("<latex>")), F.regexp_count(first, F.lit("----media/"))
    return (
        F.when(first == "", second).when((formulas > 0) & (pictures <= F.greatest(F.lit(2), F.floor(formulas / 8))), first)
        .when((pictures > 0) & (formulas == 0), F.when(second != "", second).otherwise(first)).otherwise(first)
    )


def human_records(rows: DataFrame) -> DataFrame:
    """Rows (identifier, full_name, grade, comments) with an id of seven digits and a grade; the last row of an id counts
    (by `ord`)."""
    known = rows.withColumn("participant_id", F.nullif(F.regexp_extract("identifier", r"(\d{7})", 1), F.lit(""))).where("participant_id IS NOT NULL AND grade IS NOT NULL")
    last = known.groupBy("participant_id").agg(F.max_by(F.struct("full_name", "grade", "comments"), "ord").alias("r"))
    return last.select("participant_id", F.trim("r.full_name").alias("full_name"), F.col("r.grade").cast("double").alias("total_mark"), F.trim(F.coalesce("r.comments", F.lit(""))).alias("comments"))


def sampled(files: DataFrame, path: str, n: int, seed: int) -> DataFrame:
    """N files, the same for a seed wherever they are read."""
    return files.orderBy(F.xxhash64(F.lit(seed), path), path).limit(n)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, as UTF-8 if all of it is that, else as cp1252 (which is latin-1 but for 27 signs)."""
    raw = spark.read.format("binaryFile").load(path).select(F.min(F.expr("is_valid_utf8(content)").cast("int")).alias("ok")).head()
    if raw is None or raw.ok != 0:
        return spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    latin = spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=True)
    signs = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    old, new = (("".join(x) for x in zip(*((k, v) for k, v in signs.items() if v), strict=True)))
    return latin.select(*(F.translate(F.col(f"`{c}`"), old, new).alias("".join(signs.get(x) or x for x in c)) for c in latin.columns))
