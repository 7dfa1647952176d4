"""What a body is: formats by magic bytes and file names, MIME types, and checks of uploads."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

#: MIME type of each format; its name is its file extension.
MIME = {
    "pdf": "application/pdf",
    "epub": "application/epub+zip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "txt": "text/plain",
    "md": "text/markdown",
    "html": "text/html",
}
#: Other extensions.
ALIASES = {"markdown": "md", "htm": "html", "text": "txt"}
ZIPPED = ("epub", "docx", "pptx", "xlsx")


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def by_name(name: Column) -> Column:
    """The format that a file name's extension stands for, else null."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([^./\\]*)$", 1))
    return F.coalesce(_mapped(ext, ALIASES), F.when(ext.isin(*MIME), ext))


def mime_of(fmt: Column) -> Column:
    return F.coalesce(_mapped(fmt, MIME), F.lit("text/plain"))


def by_mime(mime: Column) -> Column:
    """Unknown types count as pdf."""
    return F.coalesce(_mapped(mime, {v: k for k, v in MIME.items()}), F.lit("pdf"))


@pandas_udf(BooleanType())
def _printable(head: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> bool:
        b = (b or b"")[:512]
        good = sum(x in (9, 10, 13) or (x >= 32 and x != 127) for x in b)
        return bool(b) and good * 100 >= len(b) * 90

    return head.map(one)


def sniffed(body: Column, name: Column) -> Column:
    """The format of a body (binary), or null where none is known."""
    head = F.substring(body, 1, 512)
    named = by_name(name)
    text = F.decode(F.substring(body, 1, 200), "ISO-8859-1")
    start = F.lower(F.btrim(F.regexp_replace(text, "^\u00ef\u00bb\u00bf", ""), F.lit(" \t\r\n")))
    textual = _printable(head)
    zipped = F.when(named.isin(*ZIPPED), named).when(F.substring(body, 31, 8) == F.lit(b"mimetype"), "epub")
    return (
        F.when(F.substring(body, 1, 5) == F.lit(b"%PDF-"), "pdf").when(F.substring(body, 1, 4) == F.lit(b"PK\x03\x04"), zipped)
        .when(textual & (start.startswith("<!doctype html") | start.startswith("<html")), "html")
        .when(textual, F.when(named.isin("md", "html", "txt"), named).otherwise("txt"))
    )


def html_ok(body: Column) -> Column:
    return F.contains(body, F.lit(b"<"))


@pandas_udf(BooleanType())
def zip_ok(body: pd.Series) -> pd.Series:
    """An archive with a member."""

    def one(b: bytes | None) -> bool:
        try:
            return bool(zipfile.ZipFile(io.BytesIO(b or b"")).namelist())
        except (zipfile.BadZipFile, ValueError):
            return False

    return body.map(one)


def verified(fmt: Column, body: Column, claimed_sha: Column | None = None, most_bytes: int = 64 << 20) -> Column:
    """Null where an upload is sound, else what is wrong with it."""
    text = F.when(F.octet_length(body) == 0, "empty").when(~_utf8(body), "not UTF-8")
    wrong = F.when(F.octet_length(body) > most_bytes, "too large")
    if claimed_sha is not None:
        wrong = F.coalesce(F.when(F.sha2(body, 256) != F.lower(claimed_sha), "digest differs"), wrong)
    by_format = F.when(fmt.isin(*ZIPPED) & ~zip_ok(body), "not an archive").when(fmt.isin("txt", "md"), text).when(fmt == "html", F.coalesce(text, F.when(~html_ok(body), "no markup")))
    return F.coalesce(wrong, by_format, F.when(fmt.isNull(), "unknown format"))


@pandas_udf(BooleanType())
def _utf8(body: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> bool:
        try:
            (b or b"").decode()
            return True
        except UnicodeDecodeError:
            return False

    return body.map(one)


def pdf_pages(body: Column) -> Column:
    """Page objects of a PDF: `/Type /Page` not followed by s."""
    return F.regexp_count(F.decode(body, "ISO-8859-1"), F.lit(r"/Type\s*/Page(?!s)"))


def parser_route(fmt: Column) -> Column:
    """Which parser takes a format."""
    return F.when(fmt.isin("txt", "md"), "passthrough").when(fmt == "html", "html").otherwise("converter")
