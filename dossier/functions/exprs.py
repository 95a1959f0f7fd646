"""Column expressions over names, texts and statuses. All stay inside Spark's own functions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.schemas import ALLOWED_EXTENSIONS, ALLOWED_MIME_TYPES, PREVIEW_CHARS

# First and last code points of the ranges that Unicode counts as white space.
SPACE_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
WHITE_SPACE = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACE_RANGES)
#: A word of Java's expressions. The printable ASCII of the front is in the class behind it; it is looked at first, and saves ten ranges.
WORD = f"[!-~[^{WHITE_SPACE}]]+"


def file_extension(name: Column) -> Column:
    """The lower-cased extension with its dot; leading dots of a base name are no extension; ``""`` without one or for null."""
    return F.coalesce(F.regexp_extract(F.lower(name), r"[^/.][^/]*(\.[^/.]*)\z", 1), F.lit(""))


def word_count(text: Column) -> Column:
    """Runs of characters other than Unicode white space (bigint); null stays null."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def text_length(text: Column) -> Column:
    """Code points (bigint)."""
    return F.length(text).cast("bigint")


def file_kind(name: Column) -> Column:
    """pdf, docx or txt by extension, else null."""
    ext = file_extension(name)
    return F.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").when(ext.isin(".txt", ".text"), "txt")


def kind_error(name: Column) -> Column:
    """The message for a name that no extractor takes, else null."""
    return F.when(file_kind(name).isNull(), F.concat(F.lit("Unsupported file extension: "), file_extension(name)))


def upload_allowed(name: Column, mime: Column) -> Column:
    """True if the extension or the mime type is accepted."""
    return file_extension(F.coalesce(name, F.lit(""))).isin(*ALLOWED_EXTENSIONS) | F.coalesce(mime.isin(*ALLOWED_MIME_TYPES), F.lit(False))


def reject_reason(name: Column, mime: Column) -> Column:
    return F.when(~upload_allowed(name, mime), F.lit("Invalid file type. Allowed types are: " + ", ".join(sorted(ALLOWED_EXTENSIONS))))


def display_name(title: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), filename, F.lit(""))


def status_view(status: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(status), F.lit("")), F.lit("PENDING"))


def text_preview(status: Column, text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """The first code points of a completed document's text; null if it is empty or the document is not completed."""
    return F.when((status_view(status) == "COMPLETED") & (F.length(text) > 0), F.substring(text, 1, chars))


def tenant_captured(tenant: Column) -> Column:
    """True for a tenant header that was sent and is not empty."""
    return F.coalesce(tenant != "", F.lit(False))


def parse_uuid(text: Column) -> Column:
    """The canonical form of an id in any spelling that Python's ``UUID`` takes, null for others.

    What is left of ``urn:``, ``uuid:``, outer braces and hyphens has 32 characters and is a whole number to base 16,
    with all that Python allows there: white space around it, a plus sign, ``0x``, single underscores, and decimal
    digits of any script. A minus sign is a hyphen and so is gone.
    """
    bare = F.regexp_replace(F.replace(F.replace(text, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit("")), r"^[{}]+|[{}]+\z", "")
    bare = F.replace(bare, F.lit("-"), F.lit(""))
    spaces = "\\x09-\\x0D\\x20" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SPACE_RANGES if a > 0x7F)
    digits = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    ascii_ = F.translate(bare, "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits))
    number = F.regexp_extract(ascii_, f"^[{spaces}]*\\+?(?:0[xX]_?)?([0-9a-fA-F]+(?:_[0-9a-fA-F]+)*)[{spaces}]*\\z", 1)
    plain = F.lpad(F.lower(F.replace(number, F.lit("_"), F.lit(""))), 32, "0")
    dashed = F.concat_ws("-", *(F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when((F.length(bare) == 32) & (number != ""), dashed)
