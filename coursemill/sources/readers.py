"""Sources and sinks: manifests, Markdown and code trees, archives, notebooks, images, index files.

All reads go through Spark's readers, so any path that Spark can open works. IDs in brackets are those of the operator
inventory.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from coursemill.functions import vocab
from coursemill.functions.batches import by_parts
from coursemill.operators.catalog import profile

ENTRY_SCHEMA = (
    "id string, source_path string, file_type string, category string, title string, tags string, manual_tags array<string>, auto_tags array<string>, manual_unit_slug string, "
    "manual_timeline_block_id string, notes string, professor_signal string, relevant_for_exam boolean, include_in_bundle boolean, processing_mode string, document_profile string, preferred_backend string, "
    "formula_priority boolean, extract_images boolean, extract_tables boolean, page_range string, enabled boolean, raw_target string, base_markdown string, advanced_markdown string, approved_markdown string, "
    "curated_markdown string, manual_review string, images_dir string, rendered_pages_dir string, effective_profile string"
)
MANIFEST_SCHEMA = f"app string, generated_at string, course struct<course_name:string,course_slug:string,professor:string,institution:string,semester:string>, entries array<struct<{', '.join(f'{f.split()[0]}:{f.split(maxsplit=1)[1]}' for f in ENTRY_SCHEMA.split(', '))}>>, failed_entries array<struct<id:string,title:string,error:string>>, logs array<string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON manifests, one row each: course_id, entry_ord and the known keys. [S1]

    Unknown keys are dropped by the schema; profiles get their current names; old tags become manual ones where there
    are none, the entry is no code, and the text has separators; flags default to true.
    """
    raw = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    df = raw.select(F.col("course.course_slug").alias("course_id"), F.posexplode("entries").alias("entry_ord", "e")).select("course_id", "entry_ord", "e.*").withColumnRenamed("id", "entry_id")
    return entry_defaults(df)


def entry_defaults(df: DataFrame) -> DataFrame:
    """Defaults and old forms of entries' columns. [S1]"""
    manual = F.coalesce("manual_tags", F.array().cast("array<string>"))
    tags = F.coalesce("tags", F.lit(""))
    parts = F.array_distinct(F.filter(F.transform(F.split(tags, "[;,]"), lambda x: F.trim(x)), lambda x: x != ""))
    moves = (F.size(manual) == 0) & ~F.coalesce("file_type", F.lit("")).isin("code", "github-repo") & tags.rlike("[:;,]")
    category = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in vocab.LEGACY_CATEGORIES.items() for x in kv)), F.col("category")), F.col("category"))
    return df.withColumns({
        "manual_tags": F.when(moves, parts).otherwise(F.array_distinct(manual)), "tags": F.when(moves, "").otherwise(tags), "document_profile": profile(F.col("document_profile")), "category": category,
        **{c: F.coalesce(c, F.lit(True)) for c in ("relevant_for_exam", "include_in_bundle", "enabled")},
    })


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log rows of manifests in order: course_id, ord, message."""
    raw = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    return raw.select(F.col("course.course_slug").alias("course_id"), F.posexplode("logs").alias("ord", "message"))


def read_markdown(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """Whole Markdown files below a folder: path (relative to it) and markdown. [S2]"""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    base = root.rstrip("/").rpartition(":")[2]
    return files.select(F.regexp_extract("_metadata.file_path", rf"{base}/(.*)$", 1).alias("path"), F.col("value").alias("markdown"))


def attach_markdown(entries: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Entries with the text of their file; a missing one gives an empty text. [S2]"""
    side = files.select(F.col("path").alias(path), "markdown")
    return entries.join(side, path, "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))


SKIPPED_FOLDERS = ["__pycache__", "node_modules", "dist", "build"]
MOST_CODE_BYTES = 500_000


def _code_filter(path: Column, length: Column) -> Column:
    hidden = path.rlike(r"(?:^|/)\.[^/.][^/]*/|(?:^|/)(?:" + "|".join(SKIPPED_FOLDERS) + ")/")
    return ~hidden & F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(vocab.CODE_EXTENSIONS) & (length <= MOST_CODE_BYTES)


def language(path: Column) -> Column:
    """The language of a code file by its extension. [S3]"""
    pairs = F.create_map(*(F.lit(x) for kv in vocab.LANGUAGES.items() for x in kv))
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.element_at(pairs, extension), extension)


def branch_category(branch: Column) -> Column:
    """Whose code a branch holds. [S3]"""
    return F.when(F.lower(branch).isin(vocab.STUDENT_BRANCHES), "codigo-aluno").otherwise("codigo-professor")


def read_code(spark: SparkSession, root: str) -> DataFrame:
    """Code files below a folder: path, language, length and code; hidden and built folders, other kinds of files and
    files over 500 000 bytes are left out before their content is read. [S3]"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").rpartition(":")[2]
    path = F.regexp_extract("path", rf"{base}/(.*)$", 1)
    return files.filter(F.col("length") <= MOST_CODE_BYTES).withColumn("path", path).filter(_code_filter(F.col("path"), F.col("length"))).select("path", language(F.col("path")).alias("language"), "length", F.decode("content", "UTF-8").alias("code"))


def expand_zip(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Code files of zip archives: archive, path, language, code; a broken archive gives one row with its error. [S4]

    Each archive is one row of a task; the files are spread again by their archive and path.
    """

    def files(name: str, data: bytes) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if not info.is_dir() and info.file_size <= MOST_CODE_BYTES:
                        yield name, info.filename, info.file_size, z.read(info).decode("utf-8", "replace"), None
        except (zipfile.BadZipFile, RuntimeError, OSError) as e:
            yield name, None, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf[path], pdf[content], strict=True):
                yield pd.DataFrame(list(files(name, data or b"")), columns=["archive", "path", "length", "code", "error"]).astype({"length": "Int64"})

    out = archives.select(path, content).mapInPandas(run, "archive string, path string, length long, code string, error string")
    return out.filter(F.col("error").isNotNull() | _code_filter(F.col("path"), F.col("length"))).repartition("archive", "path").withColumn("language", language(F.col("path")))


MOST_CELLS, MOST_OUTPUTS, MOST_OUTPUT_CHARS = 24, 3, 6000


def compact_notebook(raw: Column) -> Column:
    """struct(language, markdown) of a notebook's JSON: first cells, few outputs, a budget for output text. [S5]

    Text that is no notebook passes through with no language.
    """

    def compact(s: str | None) -> tuple[str, str]:
        try:
            book = json.loads(s or "")
            cells = book["cells"]
        except (ValueError, KeyError, TypeError):
            return "", s or ""
        lang = str((book.get("metadata") or {}).get("kernelspec", {}).get("language") or (book.get("metadata") or {}).get("language_info", {}).get("name") or "python")
        parts, left = [], MOST_OUTPUT_CHARS
        text = lambda x: "".join(x) if isinstance(x, list) else str(x or "")
        for cell in cells[:MOST_CELLS]:
            source = text(cell.get("source")).strip()
            if source:
                parts.append(source if cell.get("cell_type") == "markdown" else f"```{lang}\n{source}\n```")
            for out in (cell.get("outputs") or [])[:MOST_OUTPUTS]:
                shown = (text(out.get("text")) or text((out.get("data") or {}).get("text/plain")))[: max(left, 0)].strip()
                left -= len(shown)
                if shown:
                    parts.append(f"```text\n{shown}\n```")
        return lang, "\n\n".join(parts)

    names = ("language", "markdown")
    return by_parts(raw, lambda s: dict(zip(names, compact(s), strict=True)), StructType([StructField(c, StringType()) for c in names]))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files below a folder: fname, bytes, sha1, width, height (PNG) and sampled distinct colours. [S8]"""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.lower("path").rlike(r"\.(?:png|jpe?g|gif|webp|bmp)$"))
    return image_facts(files.select(F.element_at(F.split("path", "/"), -1).alias("fname"), "content"))


def image_facts(images: DataFrame, content: str = "content") -> DataFrame:
    """Size, digest, PNG dimensions and colours of image bytes. [S8]"""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    side = lambda at: F.when(png, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))
    return images.withColumns({"bytes": F.octet_length(content), "sha1": F.sha1(content), "width": side(17), "height": side(21), "colours": png_colours(F.col(content))})


SAMPLED_PIXELS = 2000


def png_colours(content: Column) -> Column:
    """Distinct colours among the first pixels of an 8-bit RGB or RGBA PNG; for others the sample's size. [S8]"""
    import struct
    import zlib

    def count(data: bytes | None) -> int:
        try:
            width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
            if depth != 8 or colour not in (2, 6):
                return SAMPLED_PIXELS
            packed, at = b"", 8
            while at + 8 <= len(data):
                n, kind = struct.unpack(">I4s", data[at : at + 8])
                packed += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
                at += 12 + n
            step = 3 if colour == 2 else 4
            rows = min(height, -(-SAMPLED_PIXELS // max(width, 1)))
            raw = zlib.decompressobj().decompress(packed, rows * (width * step + 1))
            seen, before = set(), bytearray(width * step)
            for r in range(rows):
                line = bytearray(raw[r * (width * step + 1) : (r + 1) * (width * step + 1)])
                if len(line) < width * step + 1:
                    break
                mode, line = line[0], line[1:]
                for i in range(len(line)):
                    a, b, c = (line[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    line[i] = (line[i] + (0, a, b, (a + b) // 2, guess)[mode]) & 255
                before = line
                seen.update(bytes(line[i : i + step]) for i in range(0, len(line), step))
            return len(seen) or SAMPLED_PIXELS
        except (struct.error, zlib.error, TypeError, IndexError):
            return SAMPLED_PIXELS

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(count)

    return run(content)


def index_documents(rows: DataFrame, key: str, order: list[str], columns: list[str], name: str, lists: list[str] | None = None) -> DataFrame:
    """One row per course with its index as an ordered array of structs; list fields are never null. [S9]"""
    lists = lists or []
    item = F.struct(*(F.col(c).alias(f"__{c}") for c in order), *(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c) if c in lists else F.col(c) for c in columns))
    kept = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    return rows.groupBy(key).agg(kept.alias(name))


def write_index(index: DataFrame, path: str, key: str = "course_id") -> None:
    """Index rows as JSON, one folder per course; courses that are not among the rows stay as they are. [S9]"""
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)
