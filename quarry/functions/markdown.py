"""Markdown notes to columns, without Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import lines, sorted_distinct, strings

SCALARS = ("confidence", "status", "source_type", "valid_from", "valid_until", "supersedes", "superseded_by", "updated")
WIKILINK = r"!?\[\[([^\]]+)\]\]"
INLINE_TAG = r"(?:^|\s)#([\p{L}\p{N}_/-]+)"


def split_frontmatter(source: Column) -> tuple[Column, Column]:
    """Frontmatter (null without one) and body. It opens at the very start; a closing line ends it, else any line that begins with three dashes."""
    rest = F.substring(source, 5, 1 << 30)
    line, begun = F.locate("\n---\n", rest), F.locate("\n---", rest)
    opened = source.startswith("---\n")
    front = F.when(opened & (line > 0), F.substring(rest, F.lit(1), line - 1)).when(opened & (begun > 0), F.substring(rest, F.lit(1), begun - 1))
    body = F.when(opened & (line > 0), F.substring(rest, line + 5, F.lit(1 << 30))).when(opened & (begun > 0), F.regexp_replace(F.substring(rest, begun + 4, F.lit(1 << 30)), r"^\n+", "")).otherwise(source)
    return front, body


def clean_tag(raw: Column) -> Column:
    return F.btrim(F.trim(raw), F.lit("\"'# "))


def frontmatter_tags(front: Column) -> Column:
    """Tags of `tags:` lines, bracketed or single, and of lines that begin with a dash; in order."""

    def of(line: Column) -> Column:
        bare = F.trim(line)
        value = F.trim(F.substring(bare, 6, 1 << 30))
        listed = F.transform(F.split(F.btrim(value, F.lit("[]")), ","), clean_tag)
        single = F.when(value == "", strings()).otherwise(F.array(clean_tag(value)))
        tagged = F.when(value.startswith("[") & value.endswith("]"), listed).otherwise(single)
        return F.when(bare.startswith("tags:"), tagged).when(bare.startswith("-"), F.array(clean_tag(F.ltrim(bare, F.lit("-"))))).otherwise(strings())

    return F.filter(F.flatten(F.transform(lines(F.coalesce(front, F.lit(""))), of)), lambda t: t != "")


def inline_tags(body: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(INLINE_TAG), 1), clean_tag), lambda t: t != "")


def wikilinks(body: Column) -> Column:
    """Targets in order, repeats kept."""
    return F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), 1), lambda x: F.trim(x))


def link_set(text: Column) -> Column:
    """Distinct link texts, sorted; for a chunk."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), 1), lambda x: F.trim(x))
    return sorted_distinct(F.filter(found, lambda x: x != ""))


def scalar(front: Column, key: str) -> Column:
    """The first non-empty plain value of a key."""
    prefix = f"{key}:"
    values = F.transform(
        F.filter(lines(F.coalesce(front, F.lit(""))), lambda x: F.trim(x).startswith(prefix)),
        lambda x: F.trim(F.btrim(F.trim(F.substring(F.trim(x), len(prefix) + 1, 1 << 30)), F.lit("\"'"))),
    )
    return F.get(F.filter(values, lambda v: (v != "") & ~v.startswith("[") & ~v.startswith("{")), F.lit(0))


def title(body: Column) -> Column:
    """The first line that is a heading of the first level."""
    heads = F.filter(lines(body), lambda x: F.ltrim(x).startswith("# "))
    return F.get(F.transform(heads, lambda x: F.trim(F.substring(F.ltrim(x), 3, 1 << 30))), F.lit(0))


def parse_notes(notes: DataFrame, source: str = "source") -> DataFrame:
    """Adds body, title, tags, links and the frontmatter scalars; drops the source."""
    front, body = split_frontmatter(F.col(source))
    staged = notes.withColumns({"_front": front, "_body": body}).drop(source)
    named = {"title": title(F.col("_body")), "tags": sorted_distinct(F.concat(frontmatter_tags(F.col("_front")), inline_tags(F.col("_body")))), "links": wikilinks(F.col("_body"))}
    named |= {k: scalar(F.col("_front"), k) for k in SCALARS}
    return staged.withColumns(named).withColumnRenamed("_body", "body").drop("_front")


def structure(text: Column) -> dict[str, Column]:
    """What a text holds: has_code, has_link, has_task_list, has_incomplete_tasks."""
    starts = lambda pattern: F.exists(lines(text), lambda x: F.ltrim(x).rlike(pattern))
    return {
        "has_code": starts(r"^(```|~~~)"),
        "has_link": text.contains("http://") | text.contains("https://") | text.contains("[[") | (text.contains("[") & text.contains("](")),
        "has_task_list": starts(r"^[-*] \[[ xX]\]"),
        "has_incomplete_tasks": starts(r"^[-*] \[ \]"),
    }


def link_key(target: Column) -> Column:
    """A link's target without alias, anchor, directories and .md, lower-cased."""
    bare = F.trim(F.regexp_extract(target, r"^([^|#]*)", 1))
    return F.lower(F.trim(F.regexp_extract(F.regexp_replace(F.replace(bare, F.lit("\\"), F.lit("/")), r"\.md$", ""), r"([^/]*)$", 1)))


def path_stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", ""))


def title_key(title_: Column) -> Column:
    key = F.lower(F.trim(title_))
    return F.when(key != "", key)
