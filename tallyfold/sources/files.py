"""Files in: PDFs by content hash, outlines, JSON lists, page blocks from an external reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..providers import once
from ..scratch import Scratch, exists

OUTLINES, JSON_LISTS, PAGED = (".txt", ".md", ".markdown"), (".json",), (".pdf",)
INDEX_PAGES = 150
BLOCKS = "file_id string, pos long, page_numbers array<int>, block_type string, text string, marker string"
#: Labels of a layout reader and the block types they stand for; others are 'other'.
BLOCK_TYPES = {
    "title": "title",
    "section_header": "section_header",
    "text": "text",
    "paragraph": "text",
    "reference": "text",
    "footnote": "text",
    "list_item": "list_item",
    "caption": "caption",
    "page_header": "page_header",
    "page_footer": "page_footer",
    "table": "table",
    "document_index": "document_index",
}


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, content and file_hash; the hash of the bytes is a file's identity."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content", F.sha2("content", 256).alias("file_hash"))


def outline_lines(spark: SparkSession, path: str) -> DataFrame:
    """forest (file name), ord, line of outline files."""
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("forest"), "value")
    return texts.select("forest", F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("forest"), F.col("value").alias("json"))


def source_kind(path: str) -> str:
    """outline, json or paged by a file's ending; another one is an error."""
    low = path.lower()
    for kind, endings in (("outline", OUTLINES), ("json", JSON_LISTS), ("paged", PAGED)):
        if low.endswith(endings):
            return kind
    raise ValueError(f"unsupported topic source: {path}")


def block_type(label) -> object:
    pairs = [x for k, v in BLOCK_TYPES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit("other"))


def read_blocks(files: DataFrame, reader: Callable[[bytes], list[tuple[int, str, str, str | None]]]) -> DataFrame:
    """Blocks of file contents by an external layout reader: bytes to (page, label, text, marker).

    A reader that fails gives a file without blocks; blank blocks go.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file_id, content in zip(frame["file_hash"], frame["content"]):
                try:
                    found = reader(bytes(content))
                except Exception:
                    found = []
                kept = [b for b in found if b[2].strip()]
                out += [(file_id, i, [page], label, text, marker) for i, (page, label, text, marker) in enumerate(kept)]
            yield pd.DataFrame(out, columns=["file_id", "pos", "page_numbers", "block_type", "text", "marker"])

    raw = files.select("file_hash", "content").mapInPandas(read, BLOCKS)
    return raw.withColumn("block_type", block_type(F.col("block_type")))


def reader_name(load: Callable) -> str:
    """What a worker knows a reader by: where its maker is defined. Makers that are closures over settings need names of their own."""
    return f"{getattr(load, '__module__', '')}.{getattr(load, '__qualname__', type(load).__name__)}"


def read_evidence(
    files: DataFrame, load: Callable[[bool], Callable[[bytes], list[tuple[int, str, str, str | None]]]], ocr: bool = True, name: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Blocks, and file_id, status, error of each file: success, partial_success (blank or unreadable blocks among others) or failure.

    ``load(ocr)`` makes a reader, once a worker for each setting; ``name`` tells readers apart.
    """
    known_as = (name or reader_name(load), ocr)
    schema = "file_id string, status string, error string, blocks array<struct<pos:long,page_numbers:array<int>,label:string,text:string,marker:string>>"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file_id, content in zip(frame["file_hash"], frame["content"]):
                try:
                    found = once("reader", known_as, lambda: load(ocr))(bytes(content))
                except Exception as failed:
                    out.append((file_id, "failure", str(failed) or type(failed).__name__, []))
                    continue
                kept = [b for b in found if b[2] and b[2].strip()]
                status = "success" if len(kept) == len(found) and kept else "partial_success" if kept else "failure"
                rows = [{"pos": i, "page_numbers": [page], "label": label, "text": text, "marker": marker} for i, (page, label, text, marker) in enumerate(kept)]
                out.append((file_id, status, None if kept else "no text", rows))
            yield pd.DataFrame(out, columns=["file_id", "status", "error", "blocks"])

    # Written once by the caller's Scratch or read twice; the reader is the expensive part.
    raw = Scratch(files.sparkSession, "evidence").keep(files.select("file_hash", "content").mapInPandas(read, schema), "files")
    rows = raw.select("file_id", F.explode("blocks").alias("b")).select(
        "file_id", "b.pos", "b.page_numbers", block_type(F.col("b.label")).alias("block_type"), "b.text", "b.marker"
    )
    return rows, raw.select("file_id", "status", "error")


RANGE_BLOCKS = "array<struct<page_numbers:array<int>,label:string,text:string,marker:string>>"
#: Page ranges that were read: their blocks in order, or why there are none.
EVIDENCE = f"file_id string, start_page int, end_page int, reader string, status string, error string, blocks {RANGE_BLOCKS}"
PageReader = Callable[[bytes, int, int], list[tuple[int, str, str, "str | None"]]]


def read_page_ranges(files: DataFrame, ranges: DataFrame, load: Callable[[bool], PageReader], ocr: bool = True, name: str | None = None) -> DataFrame:
    """EVIDENCE of page ranges (file_id, start_page, end_page) of files (file_hash, content); pages outside them are not read.

    A reader gets the bytes and both ends of one range at a time. The content of a
    file goes to Python once, with all its ranges; one that fails leaves the others
    as they are.
    """
    known_as = f"{name or reader_name(load)}:{'ocr' if ocr else 'text'}"
    asked = ranges.groupBy(F.col("file_id").alias("file_hash")).agg(F.array_sort(F.collect_set(F.struct("start_page", "end_page"))).alias("ranges"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file_id, content, wanted in zip(frame["file_hash"], frame["content"], frame["ranges"]):
                out = []
                for first, last in ((int(r["start_page"]), int(r["end_page"])) for r in wanted):
                    try:
                        found = once("pages", known_as, lambda: load(ocr))(bytes(content), first, last)
                    except Exception as failed:
                        out.append((file_id, first, last, known_as, "failure", str(failed) or type(failed).__name__, []))
                        continue
                    kept = [b for b in found if b[2] and b[2].strip() and first <= b[0] <= last]
                    status = "success" if len(kept) == len(found) else "partial_success"
                    rows = [{"page_numbers": [page], "label": label, "text": text, "marker": marker} for page, label, text, marker in kept]
                    out.append((file_id, first, last, known_as, status, None if kept else "no text", rows))
                yield pd.DataFrame(out, columns=["file_id", "start_page", "end_page", "reader", "status", "error", "blocks"])

    return files.select("file_hash", "content").join(asked, "file_hash").mapInPandas(read, EVIDENCE)


def evidence_blocks(evidence: DataFrame) -> DataFrame:
    """Blocks of read ranges; pos is their order in the file (ranges of one file must not overlap)."""
    rows = evidence.select("file_id", "start_page", F.posexplode("blocks").alias("place", "b"))
    pos = (F.col("start_page").cast("long") * F.lit(1 << 24) + F.col("place")).alias("pos")
    return rows.select("file_id", pos, "b.page_numbers", block_type(F.col("b.label")).alias("block_type"), "b.text", "b.marker")


class EvidenceStore:
    """Page ranges read so far; what is there already is not converted again. Failures are tried anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.schema(EVIDENCE).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], EVIDENCE)

    def evidence(self, files: DataFrame, ranges: DataFrame, load: Callable[[bool], PageReader], ocr: bool = True, name: str | None = None) -> DataFrame:
        """EVIDENCE of the ranges, read where the store has none of this reader."""
        known_as = f"{name or reader_name(load)}:{'ocr' if ocr else 'text'}"
        scratch = Scratch(self.spark, "ranges")
        wanted = scratch.keep(ranges.select("file_id", "start_page", "end_page").distinct(), "wanted")
        on = ["file_id", "start_page", "end_page"]
        good = (F.col("reader") == known_as) & (F.col("status") != "failure")
        missing = scratch.keep(wanted.join(self.rows().where(good).select(*on), on, "left_anti"), "missing")
        read_page_ranges(files, missing, load, ocr, name).write.mode("append").parquet(self.path)
        best = self.rows().where(F.col("reader") == known_as).groupBy(*on).agg(F.max(F.struct(F.col("status") != "failure", "status", "error", "blocks")).alias("e"))
        out = wanted.join(best, on).select(*on, F.lit(known_as).alias("reader"), "e.status", "e.error", "e.blocks")
        return scratch.keep(out, "evidence")


def page_counts(files: DataFrame, count: Callable[[bytes], int]) -> DataFrame:
    """file_hash and the number of pages that ``count`` finds in the content; null where it fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for content in frame["content"]:
                try:
                    out.append(int(count(bytes(content))))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"file_hash": frame["file_hash"], "pages": pd.array(out, "Int32")})

    return files.select("file_hash", "content").mapInPandas(run, "file_hash string, pages int")


def index_pages(blocks: DataFrame) -> DataFrame:
    """The blocks of the pages that a paged index is read from: the first INDEX_PAGES."""
    return blocks.where(F.exists("page_numbers", lambda p: p <= INDEX_PAGES))


def html_headings(pages: DataFrame) -> DataFrame:
    """forest (page id), ord, line: the headings of raw pages as '#' lines."""
    pattern = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("l"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("t"))
    rows = pages.select(F.col("page_id").cast("string").alias("forest"), F.posexplode(pairs).alias("ord", "h"))
    text = F.regexp_replace(F.col("h")["t"], "<[^>]*>", "")
    return rows.select("forest", F.col("ord").cast("long").alias("ord"), F.concat(F.repeat(F.lit("#"), F.col("h")["l"].cast("int")), F.lit(" "), text).alias("line"))
