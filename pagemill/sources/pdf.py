"""PDF files as span, image, word, outline and page tables, by an optional reader (PyMuPDF), and OCR before it.

Where the reader is not installed, available() is false and the functions raise RuntimeError when a plan is
made; all other parts of the library work on span tables from any source.
"""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "path string, page_number long, block_no int, line_no int, span_no int, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double, width double, height double"
OUTLINE = "path string, pos long, level int, title string, page_number long, page_count long"
WORDS = "path string, page_number long, x0 double, y0 double, x1 double, y1 double, text string, block_no int, line_no int, word_no int"
IMAGES = "path string, page_number long, block_no int, x0 double, y0 double, x1 double, y1 double, image binary, ext string"
PAGE_IMAGES = "path string, page_number long, image binary"


def available() -> bool:
    return importlib.util.find_spec("fitz") is not None


def require() -> None:
    if not available():
        raise RuntimeError("reading PDF files needs PyMuPDF, which is not installed")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")


def _rows(docs: DataFrame, schema: str, of) -> DataFrame:
    require()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for pdf in found:
            for path, content in zip(pdf["path"], pdf["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    rows = [(path, *r) for r in of(doc)]
                yield pd.DataFrame(rows, columns=names)

    return docs.mapInPandas(run, schema)


def spans(docs: DataFrame) -> DataFrame:
    def of(doc):
        for n, page in enumerate(doc, 1):
            for b, block in enumerate(page.get_text("dict", sort=True)["blocks"]):
                for k, line in enumerate(block.get("lines", [])):
                    for s, span in enumerate(line["spans"]):
                        yield n, b, k, s, span["text"], span["font"], float(span["size"]), int(span["flags"]), *map(float, span["bbox"]), float(page.rect.width), float(page.rect.height)

    return _rows(docs, SPANS, of)


def images(docs: DataFrame) -> DataFrame:
    def of(doc):
        for n, page in enumerate(doc, 1):
            for b, block in enumerate(page.get_text("dict", sort=True)["blocks"]):
                if block["type"] == 1:
                    yield n, b, *map(float, block["bbox"]), block["image"], block["ext"]

    return _rows(docs, IMAGES, of)


def words(docs: DataFrame) -> DataFrame:
    return _rows(docs, WORDS, lambda doc: ((n, *map(float, w[:4]), w[4], *map(int, w[5:8])) for n, page in enumerate(doc, 1) for w in page.get_text("words", sort=True)))


def outline(docs: DataFrame) -> DataFrame:
    return _rows(docs, OUTLINE, lambda doc: ((k, level, title, page, len(doc)) for k, (level, title, page) in enumerate(doc.get_toc(simple=True))))


def page_images(docs: DataFrame, scale: float = 2.0) -> DataFrame:
    def of(doc):
        import fitz

        for n, page in enumerate(doc, 1):
            yield n, page.get_pixmap(matrix=fitz.Matrix(scale, scale), alpha=False).tobytes("png")

    return _rows(docs, PAGE_IMAGES, of)


def ocr_method() -> str:
    """The best there is: ocrmypdf, builtin (tesseract by the reader) or none."""
    if importlib.util.find_spec("ocrmypdf") or shutil.which("ocrmypdf"):
        return "ocrmypdf"
    return "builtin" if available() and shutil.which("tesseract") else "none"


def needs_ocr(pages: DataFrame, least: int = 30) -> DataFrame:
    """Pages (..., text) with too little text of their own."""
    return pages.where(F.length(F.trim(F.coalesce("text", F.lit("")))) <= least)


def ocr(docs: DataFrame, language: str = "eng", seconds: int = 3600) -> DataFrame:
    """path, content with a text layer, by ocrmypdf's command; a document that fails stays as it is."""
    if shutil.which("ocrmypdf") is None:
        raise RuntimeError("OCR needs ocrmypdf, which is not installed")

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for content in pdf["content"]:
                with tempfile.TemporaryDirectory() as d:
                    a, b = Path(d, "in.pdf"), Path(d, "out.pdf")
                    a.write_bytes(content)
                    done = subprocess.run(["ocrmypdf", "-l", language, "--skip-text", "--deskew", "--rotate-pages", "--clean", str(a), str(b)], capture_output=True, timeout=seconds)
                    out.append(b.read_bytes() if done.returncode == 0 and b.exists() else content)
            yield pd.DataFrame({"path": pdf["path"], "content": out})

    return docs.mapInPandas(run, "path string, content binary")
