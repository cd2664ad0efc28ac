"""Spreadsheets (XLSX) as tables: each file is read by a task, row by row from its zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task passes on at once.
ROWS = 5000


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells name by number."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as file:
        for _, element in ElementTree.iterparse(file):
            if element.tag.endswith("}si"):
                found.append("".join(t.text or "" for t in element.iter() if t.tag.endswith("}t")))
                element.clear()
    return found


def _place(reference: str) -> int:
    """The number of the column in a cell's name (A1: 0)."""
    number = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        number = 26 * number + ord(letter) - 64
    return number - 1


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The first sheet's rows as texts; a cell that isn't there is None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        known = _texts(book)
        name = min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        with book.open(name) as file:
            for _, element in ElementTree.iterparse(file):
                if not element.tag.endswith("}row"):
                    continue
                row: list[str | None] = []
                for at, cell in enumerate(c for c in element if c.tag.endswith("}c")):
                    place = _place(cell.get("r", "")) if cell.get("r") else at
                    row += [None] * (place + 1 - len(row))
                    parts = [t.text or "" for t in cell.iter() if t.tag.endswith(("}v", "}t"))]
                    text = "".join(parts) if parts else None
                    row[place] = known[int(text)] if cell.get("t") == "s" and text is not None else text
                yield row
                element.clear()


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``columns``, all text, of the first sheet of every file at ``path``; the first row names them, missing ones are an error."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                sheet = sheet_rows(bytes(content))
                names = next(sheet, [])
                if missing := [c for c in columns if c not in names]:
                    raise ValueError(f"the sheet has no columns {', '.join(missing)}")
                places, held = [names.index(c) for c in columns], []
                for row in sheet:
                    held.append([row[p] if p < len(row) else None for p in places])
                    if len(held) == ROWS:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                yield pd.DataFrame(held, columns=columns)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))
