"""Text out of documents. The only code here that runs Python for each file."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import extension, kind_of

#: End tags after which a line ends.
LINE_ENDS = frozenset("p div br li tr h1 h2 h3 h4".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        if tag in LINE_ENDS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(html: str) -> str:
    """Visible text: no scripts or styles, entities decoded, a line's end after block ends."""
    parser = _Text()
    parser.feed(html)
    return "".join(parser.out)


def _pdf(content: bytes) -> str:
    from pypdf import PdfReader  # optional

    text = "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    if not text.strip():
        raise ValueError("the file has no text; it is probably a scan")
    return text


def _docx(content: bytes) -> str:
    from docx import Document  # optional

    doc = Document(io.BytesIO(content))
    rows = [" | ".join(cell.text for cell in row.cells) for table in doc.tables for row in table.rows]
    return "\n".join([p.text for p in doc.paragraphs] + rows)


def _pptx(content: bytes) -> str:
    from pptx import Presentation  # optional

    out = []
    for i, slide in enumerate(Presentation(io.BytesIO(content)).slides, 1):
        out.append(f"Slide {i}:")
        for shape in slide.shapes:
            if shape.has_text_frame:
                out.append(shape.text_frame.text)
            if getattr(shape, "has_table", False) and shape.has_table:
                out += [" | ".join(c.text for c in row.cells) for row in shape.table.rows]
        if slide.has_notes_slide:
            out.append("Speaker notes: " + slide.notes_slide.notes_text_frame.text)
    return "\n".join(out)


def _xlsx(content: bytes) -> str:
    from openpyxl import load_workbook  # optional

    out = []
    for sheet in load_workbook(io.BytesIO(content), read_only=True, data_only=True):
        out.append(f"Sheet {sheet.title}:")
        out += [" | ".join(str(v) for v in row if v is not None) for row in sheet.iter_rows(values_only=True) if any(v is not None for v in row)]
    return "\n".join(out)


_READERS: dict[str, Callable[[bytes], str]] = {
    "html": lambda c: html_text(c.decode("utf-8", "replace")),
    "htm": lambda c: html_text(c.decode("utf-8", "replace")),
    "pdf": _pdf,
    "docx": _docx,
    "pptx": _pptx,
    "xlsx": _xlsx,
}


def read_text(content: bytes, ext: str) -> tuple[str | None, str | None]:
    """(text, error): a file that can't be read is a row with its reason."""
    try:
        return _READERS.get(ext, lambda c: c.decode("utf-8", "replace"))(content), None
    except ImportError as e:
        return None, f"reading .{ext} needs the package {e.name}"
    except Exception as e:  # a broken file may fail in any way
        return None, f"{type(e).__name__}: {e}"


def html_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: html_text(x) if x is not None else None)

    return run(html)


def extract(files: DataFrame, vision: Callable[[bytes], str] | None = None) -> DataFrame:
    """Files (path, content) with ``text``, ``error`` and ``sha256``; plain text is decoded
    without leaving the engine, other documents and, with a function for them, images in
    Arrow batches. The content column is dropped."""
    ext, kind = extension(F.col("path")), kind_of(F.col("path"))
    plain = ext.isin("txt", "md", "rst", "csv", "log")

    @F.pandas_udf("struct<text:string,error:string>")
    def parse(contents: pd.Series, exts: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        out = []
        for c, e, k in zip(contents, exts, kinds, strict=True):
            if c is None or k == "other" or (k == "image" and vision is None):
                out.append((None, None))
            elif k == "image":
                try:
                    out.append((vision(c), None))
                except Exception as x:
                    out.append((None, f"{type(x).__name__}: {x}"))
            else:
                out.append(read_text(c, e))
        return pd.DataFrame(out, columns=["text", "error"])

    rest = [c for c in files.columns if c != "content"]
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    easy = hashed.where(plain).select(*rest, "sha256", F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("error"))
    hard = hashed.where(~plain | plain.isNull()).withColumn("_r", parse("content", ext, kind)).select(*rest, "sha256", "_r.text", "_r.error")
    return easy.unionByName(hard)
