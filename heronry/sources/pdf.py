"""Pages of PDF files: text layer, figures and an image of each page, through a PDF library that is installed.

The library is imported where pages are read, so that nothing else needs it: pypdf for texts and figures and, if it
is there, pypdfium2 for page images. Register the reader by register_page_reader("vision", pdf.pages).
"""

from __future__ import annotations

import io

from pyspark.sql import DataFrame

from heronry.sources.documents import ParseError

_PAGES = "page int, text string, figure boolean, image binary"


def read_pages(data: bytes, reader=None, renderer=None) -> list[tuple[int, str, bool, bytes | None]]:
    """(page from 1 on, text, whether it has a figure, image) of each page. reader and renderer stand in for the libraries."""
    if reader is None:
        try:
            import pypdf as reader
        except ModuleNotFoundError as e:
            raise ParseError("reading PDF files needs the package pypdf") from e
    try:
        pages = reader.PdfReader(io.BytesIO(data)).pages
    except Exception as e:
        raise ParseError(f"not a readable PDF file: {e}") from e
    if renderer is None:
        try:
            import pypdfium2 as renderer
        except ModuleNotFoundError:
            renderer = None
    drawn = renderer.PdfDocument(data) if renderer is not None else None
    out = []
    for k, page in enumerate(pages):
        image = None
        if drawn is not None:
            held = io.BytesIO()
            drawn[k].render(scale=2).to_pil().save(held, format="PNG")
            image = held.getvalue()
        out.append((k + 1, page.extract_text() or "", len(page.images) > 0, image))
    return out


def pages(files: DataFrame) -> DataFrame:
    """(doc_id, page, text, figure, image) of files (doc_id, data)."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = [(doc, *page) for doc, data in zip(frame["doc_id"], frame["data"]) for page in read_pages(bytes(data or b""))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "figure", "image"])

    return files.select("doc_id", "data").mapInPandas(run, f"doc_id {kind}, {_PAGES}")
