"""Texts of PDF files, with whichever of two optional libraries is there."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The first that is installed reads the files.
LIBRARIES = ("pdfplumber", "pypdf")


def reader() -> str:
    """The library in use; ImportError if there is none."""
    for name in LIBRARIES:
        if importlib.util.find_spec(name):
            return name
    raise ImportError(f"PDF files need one of {', '.join(LIBRARIES)}; texts can be given instead (see tables.report_text_files)")


def pages_of(content: bytes, library: str) -> list[str]:
    module = importlib.import_module(library)
    if library == "pdfplumber":
        with module.open(io.BytesIO(content)) as pdf:
            return [page.extract_text() or "" for page in pdf.pages]
    return [page.extract_text() or "" for page in module.PdfReader(io.BytesIO(content)).pages]


def pdf_texts(files: DataFrame) -> DataFrame:
    """id (the path) and text of files (path, content), each page ended by a line end and parted from the next by a form feed.

    A file that cannot be read has a null text, which puts it into quarantine (see extract.uploaded).
    """
    library = reader()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append("\f".join(page + "\n" for page in pages_of(bytes(content), library)))
                except Exception:  # whatever the library raises on a broken file
                    texts.append(None)
            yield pd.DataFrame({"id": batch["path"], "text": texts})

    return files.select("path", "content").mapInPandas(read, "id string, text string")
