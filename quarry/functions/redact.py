"""Secrets in text: lines and tokens that look like credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import squeezed

MARK = "[REDACTED]"
LABELS = "password|passwd|secret|token|api[_-]?key|authorization|bearer|credential|private[_ -]?key"
SHAPES = (r"\bsk-[A-Za-z0-9_-]{8,}", r"\bgh[pousr]_[A-Za-z0-9]{16,}", r"\bAKIA[0-9A-Z]{16}\b", r"\bxox[abpr]-[A-Za-z0-9-]{8,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}")
#: A line with a label and a value, or with a key's shape.
SECRET_LINE = rf"(?i)\b({LABELS})\b\s*[:=]\s*\S+|" + "|".join(f"(?-i:{s})" for s in SHAPES)
SECRET_LINE_SQL = SECRET_LINE.replace("'", "''")
EXCERPT_CHARS = 180


def looks_secret(text: Column) -> Column:
    return text.rlike(SECRET_LINE)


def redact_lines(text: Column) -> Column:
    """Lines that hold a secret become a mark."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.when(looks_secret(x), MARK).otherwise(x)), "\n")


def sanitized_excerpt(text: Column, most: int = EXCERPT_CHARS) -> Column:
    """White space squeezed, labelled values and key shapes replaced, long tokens of mixed letters and digits too, cut at `most` characters."""
    out = F.regexp_replace(squeezed(text), rf"(?i)\b({LABELS})\b\s*[:=]\s*\S+", f"$1={MARK.replace('[', '').replace(']', '')}")
    for shape in SHAPES:
        out = F.regexp_replace(out, shape, MARK)
    odd = lambda t: (F.length(t) >= 32) & t.rlike("^[A-Za-z0-9_+/=.-]+$") & t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    return F.substring(F.array_join(F.transform(F.split(out, " "), lambda t: F.when(odd(t), MARK).otherwise(t)), " "), 1, most)


def scan_secrets(files: DataFrame) -> DataFrame:
    """files: path, text. Lines that look secret: path, line_no; never the line itself."""
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).filter(looks_secret(F.col("line"))).select("path", (F.col("k") + 1).alias("line_no"))
