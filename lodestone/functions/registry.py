"""Extension points: extractors by file type, operation handlers, and document pages as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package
from . import documents
from .pdf import pdf_pages

#: Text extractors by extension; others are plain text unless they look binary.
EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {
    "csv": lambda data: [documents.csv_summary(data.decode("utf-8", "replace"))],
    **{kind: (lambda data, kind=kind: documents.pages(data, kind)) for kind in ("docx", "odt", "xlsx", "pptx", "epub")},
    "pdf": lambda data: pdf_pages(documents.of_size(data)),
}
#: Operation handlers by name, to be filled by the caller.
HANDLERS: dict[str, Callable] = {}


def embedded_picture(data: bytes, page: int) -> bytes:
    """The page-th picture, from 1 and by name, that an office file holds."""
    names = documents.media_names(data)
    if not 1 <= page <= len(names):
        raise ValueError(f"no page {page} of {len(names)}")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(names[page - 1])


def whole_picture(data: bytes, page: int) -> bytes:
    """A picture file as its only page."""
    if page != 1:
        raise ValueError(f"no page {page} of 1")
    return data


#: Page pictures by extension, as stored; whoever can draw PDF pages registers ``pdf`` here and in PICTURES.
RASTERIZERS: dict[str, Callable[[bytes, int], bytes]] = {**dict.fromkeys(("docx", "pptx", "xlsx", "odt", "epub"), embedded_picture), **dict.fromkeys(("png", "jpg", "jpeg", "gif", "bmp", "webp"), whole_picture)}
#: How many page pictures a file has, by extension.
PICTURES: dict[str, Callable[[bytes], int]] = {**dict.fromkeys(("docx", "pptx", "xlsx", "odt", "epub"), lambda data: len(documents.media_names(data))), **dict.fromkeys(("png", "jpg", "jpeg", "gif", "bmp", "webp"), lambda data: 1)}


def picture_pages(files: DataFrame, key: str = "path", extension: str = "extension", content: str = "content") -> DataFrame:
    """(key, page, image, error) for every page picture of every file; files without any have no row, broken ones one."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = pa.schema([(key, batch.column(0).type), ("page", pa.int32()), ("image", pa.binary()), ("error", pa.string())])
            for name, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind, rows = (kind or "").lower(), []
                if kind in PICTURES:
                    try:
                        rows = [{key: name, "page": n, "image": RASTERIZERS[kind](data or b"", n), "error": None} for n in range(1, PICTURES[kind](data or b"") + 1)]
                    except Exception as e:  # noqa: BLE001  files are not ours
                        rows = [{key: name, "page": 0, "image": None, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return files.select(key, extension, content).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, page int, image binary, error string")


def plain_text(data: bytes) -> list[str]:
    return [""] if b"\0" in data[:8192] else [data.decode("utf-8", "replace")]


def handler(operation: str) -> Callable[[Callable], Callable]:
    def register(fn: Callable) -> Callable:
        HANDLERS[operation] = fn
        return fn

    return register


def document_pages(files: DataFrame, key: str = "path", extension: str = "extension", content: str = "content") -> DataFrame:
    """(key, page, text, error) for every page of every file; a file that cannot be read keeps one row."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = EXTRACTORS.get((kind or "").lower(), plain_text)(data or b"")
                    rows += [{key: name, "page": n, "text": t, "error": None} for n, t in enumerate(found, 1)]
                except Exception as e:  # noqa: BLE001  files are not ours
                    rows.append({key: name, "page": 0, "text": "", "error": f"{type(e).__name__}: {e}"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(key, batch.column(0).type), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())]))

    return files.select(key, extension, content).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, page int, text string, error string")


class SearchStore(Protocol):
    """What a search index offers, whatever it is made of."""

    def add(self, rows: DataFrame) -> object: ...

    def find(self, query: object, k: int) -> DataFrame: ...

    def count(self) -> int: ...

    def has(self, key: str) -> bool: ...

    def remove(self, keys: DataFrame) -> None: ...


def register_sql(spark) -> None:
    """The library's scalar functions as SQL functions of a session: glob_match, cosine, stem, csv_summary, first_json."""
    from pyspark.sql.types import ArrayType, StringType

    from . import porter2
    from . import text as X

    ship_package(spark)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN size(a) = size(b) AND size(a) > 0 AND aggregate(a, 0D, (s, x) -> s + x * x) > 0 AND aggregate(b, 0D, (s, x) -> s + x * x) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) ELSE 0D END")
    batched = {"bag_terms": (porter2.terms, ArrayType(StringType())), "csv_summary": (documents.csv_summary, StringType()), "first_json": (documents.first_json, StringType()), "glob_regex": (X.glob_regex, StringType())}
    from pyspark.sql.functions import arrow_udf

    def over(fn: Callable, kind: object) -> Callable:
        arrow = pa.list_(pa.string()) if isinstance(kind, ArrayType) else pa.string()

        def run(column: pa.Array) -> pa.Array:
            return pa.array([None if v is None else fn(v) for v in column.to_pylist()], arrow)

        return run

    for name, (fn, kind) in batched.items():
        spark.udf.register(name, arrow_udf(over(fn, kind), kind))
