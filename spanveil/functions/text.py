"""Text expressions that stay in the JVM; offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import running_sums

PAGE_MARK = "<!-- docling-page -->"

# Types by suffix, and the types that are admitted.
MIME_BY_SUFFIX = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".html": "text/html",
    ".adoc": "text/asciidoc",
    ".md": "text/markdown",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".csv": "text/csv",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".bmp": "image/bmp",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".txt": "text/plain",
}
ADMITTED = sorted(set(MIME_BY_SUFFIX.values()))


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unescape_markdown(c: Column) -> Column:
    return F.replace(c, F.lit("\\_"), F.lit("_"))


def page_parts(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\\Q" + PAGE_MARK + "\\E", -1)


def page_text(c: Column) -> Column:
    return F.array_join(page_parts(c), "")


def page_offsets(c: Column) -> Column:
    """Where each page begins in page_text; one page at least."""
    return running_sums(F.transform(page_parts(c), F.length)).cast("array<int>")


def page_of(offsets: Column, start: Column) -> Column:
    """1-based page of an offset."""
    return F.size(F.filter(offsets, lambda o: o <= start))


def mime_type(name: Column) -> Column:
    """Type by the last suffix of a file name, 'invalid' where there is none that is known."""
    base = F.regexp_extract(name, r"[^/]*$", 0)
    suffix = F.lower(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1))
    out = F.lit("invalid")
    for k, v in MIME_BY_SUFFIX.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def mime_error(mime: Column) -> Column:
    return F.when(~F.coalesce(mime, F.lit("")).isin(ADMITTED), F.lit("invalid_mime_type"))


def size_error(size: Column, limit: int = 104_857_600) -> Column:
    return F.when(size > limit, F.lit("file_too_large"))


def html_to_text(c: Column) -> Column:
    """Visible text of simple pages: scripts, styles and tags go, blocks end lines, basic entities are read."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(c, r"(?is)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)</(p|div|h[1-6]|li|tr|title|table|ul|ol)>|<br */?>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def marked_name(name: Column) -> Column:
    """x.pdf becomes x.markiert.pdf; a name without suffix takes .pdf."""
    base = F.regexp_extract(name, r"[^/]*$", 0)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    suffix = F.regexp_extract(base, r"(?<=.)(\.[^.]+)$", 1)
    return F.concat(stem, F.lit(".markiert"), F.when(suffix == "", F.lit(".pdf")).otherwise(suffix))


def client_key(header: Column, host: Column) -> Column:
    """Who a task is counted for: the header's first 128 characters, else the peer."""
    return F.coalesce(F.substring(F.nullif(header, F.lit("")), 1, 128), F.nullif(host, F.lit("")), F.lit("anonymous"))
