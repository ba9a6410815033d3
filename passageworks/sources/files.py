"""Documents in folders: discovery, decoding and text extraction by file type."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passageworks.functions.text import (
    basename,
    escape_sql_text,
    extension,
    linearize_cells,
    local_path,
    markdown_to_text,
    unify_newlines,
)
from passageworks.schema import ALLOWED_EXTENSIONS


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def allowed(
    path: Column, extensions: Sequence[str] = ALLOWED_EXTENSIONS, deny: Sequence[str] = ()
) -> Column:
    """Extension in the list (case counts) and file name not in the deny list."""
    keep = extension(path).isin(*extensions)
    return keep & ~basename(path).isin(*deny) if deny else keep


def name_pattern(extensions: Sequence[str] = ALLOWED_EXTENSIONS) -> str:
    """The glob of wanted names: the reader lists by it, so other files are never opened."""
    return "{" + ",".join(f"*{e}" for e in extensions) + "}"


def file_rows(
    binary: DataFrame,
    extensions: Sequence[str] = ALLOWED_EXTENSIONS,
    deny: Sequence[str] = (),
    internal_only: bool = False,
) -> DataFrame:
    """The wanted rows of a ``binaryFile`` read: path, name, length, content and access flag."""
    return binary.filter(allowed(F.col("path"), extensions, deny)).select(
        local_path(F.col("path")).alias("filepath"),
        basename(F.col("path")).alias("document_name"),
        "length",
        "content",
        F.lit(internal_only).alias("internal_only"),
    )


def discover_files(
    spark: SparkSession,
    root: str | list[str],
    extensions: Sequence[str] = ALLOWED_EXTENSIONS,
    deny: Sequence[str] = (),
    internal_only: bool = False,
) -> DataFrame:
    """The files below ``root``; their content is only read by plans that use it.

    Spark passes over empty files, which have no text to extract, and over files and folders
    whose names start with ``_`` or ``.``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.option("pathGlobFilter", name_pattern(extensions)).load(root)
    return file_rows(found, extensions, deny, internal_only)


def decode_text(content: Column, strict: bool = True) -> Column:
    """UTF-8 text with unified line ends. Malformed bytes stop the job unless not ``strict``."""
    text = (
        F.decode(content, "UTF-8")
        if strict
        else F.make_valid_utf8(content.cast("string"))
    )
    return unify_newlines(text)


# Parts of a word-processor document, in reading order: a paragraph or the cells of a table.
_PART = T.StructType(
    [
        T.StructField("paragraph", T.StringType()),
        T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("n_columns", T.IntegerType()),
    ]
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph_text(paragraph: ElementTree.Element) -> str:
    marks = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    pieces = []
    for run in paragraph.iter(_W + "r"):
        for node in run:
            kind = node.tag.removeprefix(_W)
            pieces.append((node.text or "") if kind == "t" else marks.get(kind, ""))
    return "".join(pieces)


def _row_cells(row: ElementTree.Element) -> list[str]:
    """Cell texts of a row; a cell that spans columns is repeated for each."""
    texts = []
    for cell in row.findall(_W + "tc"):
        text = "\n".join(_paragraph_text(p) for p in cell.findall(_W + "p"))
        span = cell.find(f"{_W}tcPr/{_W}gridSpan")
        texts.extend([text] * (1 if span is None else int(span.get(_W + "val", "1"))))
    return texts


def docx_parts(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(_W + "body")
    parts = []
    for node in body if body is not None else ():
        if node.tag == _W + "p":
            parts.append({"paragraph": _paragraph_text(node), "cells": None, "n_columns": None})
        elif node.tag == _W + "tbl":
            columns = node.findall(f"{_W}tblGrid/{_W}gridCol")
            rows = [_row_cells(r) for r in node.findall(_W + "tr")]
            parts.append({"paragraph": None, "cells": rows, "n_columns": len(columns)})
    return parts


_PART_ARROW = pa.list_(
    pa.struct(
        [
            ("paragraph", pa.string()),
            ("cells", pa.list_(pa.list_(pa.string()))),
            ("n_columns", pa.int32()),
        ]
    )
)


def docx_text(content: Column) -> Column:
    """Paragraphs and tables of a document, each followed by a blank line."""

    @F.arrow_udf(T.ArrayType(_PART))
    def parts(contents: pa.Array) -> pa.Array:
        return pa.array(
            [None if c is None else docx_parts(c) for c in contents.to_pylist()], _PART_ARROW
        )

    def text(part: Column) -> Column:
        table = linearize_cells(part["cells"], part["n_columns"])
        return F.concat(F.coalesce(part["paragraph"], table), F.lit("\n\n"))

    return F.array_join(F.transform(parts(content), text), "")


def text_by_type(
    path: Column,
    text: Column,
    docx: Column | None = None,
    indicate_tables: bool = True,
    table_separator: str = ",",
    escape: bool = False,
) -> Column:
    """Extracted text by file suffix; other types have the empty text."""
    extracted = (
        F.when(path.endswith(".docx"), text if docx is None else docx)
        .when(path.endswith(".txt"), text)
        .when(path.endswith(".md"), markdown_to_text(text, indicate_tables, table_separator))
        .otherwise(F.lit(""))
    )
    return escape_sql_text(extracted) if escape else extracted


def extracted_documents(
    files: DataFrame,
    strict: bool = True,
    indicate_tables: bool = True,
    table_separator: str = ",",
    escape: bool = False,
) -> DataFrame:
    """``filepath, internal_only, document_text, document_name``; empty texts are left out."""
    zipped = F.col("filepath").endswith(".docx")
    # Packages are no text and the others no packages, so each reader sees nulls instead.
    plain = decode_text(F.when(~zipped, F.col("content")), strict)
    packed = docx_text(F.when(zipped, F.col("content")))
    text = text_by_type(
        F.col("filepath"), plain, packed, indicate_tables, table_separator, escape
    )
    return with_text(
        files.select("filepath", "internal_only", text.alias("document_text"), "document_name")
    )


def with_text(documents: DataFrame) -> DataFrame:
    """Documents whose text is neither null nor empty."""
    return documents.filter("document_text <> ''")


def read_documents(
    spark: SparkSession,
    root: str | list[str],
    extensions: Sequence[str] = ALLOWED_EXTENSIONS,
    deny: Sequence[str] = (),
    internal_only: bool = False,
    **how,
) -> DataFrame:
    """Discover and extract; ``how`` are the options of ``extracted_documents``."""
    return extracted_documents(
        discover_files(spark, root, extensions, deny, internal_only), **how
    )
