"""Readers and writers of the data formats that the queries take: rows in, DataFrames out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import BUCKETS, Store

from ..operators.windows import best_row, upsert


def csv(spark: SparkSession, path: str, strict: bool = False, line_ends: bool = False) -> DataFrame:
    """UTF-8 with or without a byte order mark, a header, every value a string. strict: a ragged row is an error.

    line_ends: values may hold line ends in quotes; each file is then read by one task.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", line_ends).option("escape", '"').option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def json_records(spark: SparkSession, path: str, wrappers: Sequence[str] = ("data", "records", "items"), recursive: bool = False) -> DataFrame:
    """One object for each record: the root may be a list, an object, or an object that wraps a list. Others are left out."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED")
    df = reader.option("recursiveFileLookup", True).json(path) if recursive else reader.json(path)
    for name in wrappers:
        kind = df.schema[name].dataType if name in df.columns else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return df.select(F.explode(name).alias("_r")).select("_r.*")
    return df.drop("_corrupt_record")


def last_wins(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Of rows that repeat a key the last in order."""
    names = [f"_o{i}" for i in range(len(order))]
    return best_row(df.select("*", *[c.alias(n) for c, n in zip(order, names)]), [key], names).select(*df.columns)


def _alias(df: DataFrame, names: Sequence[str]) -> Column:
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Docid, text, title, metadata (unknown keys, as strings). Aliases: _id, docid, id; text, contents."""
    df = spark.read.json(path)
    known = {"_id", "docid", "id", "text", "contents", "title", "metadata"}
    rest = [c for c in df.columns if c not in known]
    spilled = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if rest else F.expr("map()").cast("map<string,string>")
    return df.select(_alias(df, ["_id", "docid", "id"]).alias("docid"), _alias(df, ["text", "contents"]).alias("text"), _alias(df, ["title"]).alias("title"), spilled.alias("metadata"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """Qid, text; rows with an empty id or text are left out."""
    df = spark.read.json(path)
    out = df.select(_alias(df, ["_id", "qid", "query_id", "id"]).alias("qid"), F.trim(_alias(df, ["text", "query"])).alias("text"))
    return out.where("qid is not null and qid <> '' and text <> ''")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Qid, docid, rel from three columns or TREC's four; comments, blank lines and a header are skipped, another shape is an error."""
    line = F.trim("value")
    parts = F.split(line, "\\s+")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(parts.alias("p"))
    rows = rows.where(~F.lower(F.col("p")[0]).isin("qid", "query-id", "query_id"))
    bad = F.raise_error(F.concat(F.lit("malformed judgement: "), F.array_join("p", " ")))
    docid = F.when(F.size("p") == 3, F.col("p")[1]).when(F.size("p") == 4, F.col("p")[2]).otherwise(bad.cast("string"))
    return rows.select(F.col("p")[0].alias("qid"), docid.alias("docid"), F.element_at("p", -1).cast("int").alias("rel"))


def write_run(run: DataFrame, path: str, name: str) -> None:
    """A TREC run: qid Q0 docid rank score name."""
    line = F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("docid").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(name))
    run.repartitionByRange("qid").sortWithinPartitions("qid", "rank").select(line.alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """K01."""
    df.write.mode("append" if append else "overwrite").json(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a merged table as of now. schema: its columns, should it hold nothing yet."""
    return Store(spark, path).table("rows", schema)


def merge_table(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], buckets: int = BUCKETS, order: Sequence[str] = ()) -> DataFrame:
    """A keyed upsert as the next version of a table; versions before stay readable.

    A key stands once: of new rows with one key the one with the largest `order` columns counts. The
    table keeps the number of key buckets of its first write. Versions that were not completed are
    never seen, a replay changes no row, and of two writers at once one fails with Conflict.
    """
    t = Store(spark, path).begin()
    t.upsert("rows", new, keys, order, buckets)
    t.commit()
    return read_table(spark, path, new.schema)


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of text files with their number, character offset and the heading (#) that they stand under."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    w = Window.partitionBy("file").orderBy("line_no")
    before = F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.last(F.when(F.col("line").rlike("^#{1,6} "), F.regexp_replace("line", "^#+ +", "")), ignorenulls=True).over(w)
    return lines.select("file", "line_no", before.alias("offset"), head.alias("section"), F.trim("line").alias("text")).where("text <> ''")


_CELL = re.compile(r"([A-Z]+)([0-9]+)")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _member(z: zipfile.ZipFile, sheet: str | None) -> str:
    """The archive member of the sheet of this name (the first one without a name), by the workbook and its relationships."""
    sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"))
    wanted = [s for s in sheets if sheet is None or s.get("name") == sheet]
    if not wanted:
        raise ValueError(f"no sheet {sheet!r}")
    for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == wanted[0].get(_REL):
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no part for sheet {sheet!r}")


def _sheet_rows(raw: bytes, sheet: str | None) -> Iterator[tuple[int, int, str]]:
    """Row, column and value (as text; whole numbers without a point) of the cells of a worksheet."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        for _, cell in ElementTree.iterparse(z.open(_member(z, sheet))):
            if cell.tag != f"{_NS}c":
                continue
            letters, row = _CELL.match(cell.get("r")).groups()
            col = 0
            for c in letters:
                col = col * 26 + ord(c) - 64
            kind, value = cell.get("t"), cell.findtext(f"{_NS}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
            elif kind == "s" and value is not None:
                value = shared[int(value)]
            elif value is not None and kind != "str" and float(value).is_integer():
                value = str(int(float(value)))
            if value is not None:
                yield int(row), col, value
            cell.clear()


def xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """File, row, col, value of every filled cell; each file is read by one task."""
    def run(batches):
        for b in batches:
            for file, raw in zip(b["path"], b["content"]):
                yield pd.DataFrame([(file, *c) for c in _sheet_rows(raw, sheet)], columns=["file", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row int, col int, value string")
