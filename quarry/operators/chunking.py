"""Notes to chunks that know their headings.

The walk over a note's lines depends on open fences, the stack of headings and the size of the chunk so far, so it is one Python
function over Arrow batches; ids and flags of chunks are columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markdown import structure

MAX_BYTES, LEAST_BYTES = 1200, 200
#: Characters of notes that a task cuts at once (one note at least), and chunks that it passes on at once.
CUT_CHARS, PIECE_ROWS = 2_000_000, 2000
HEADING = re.compile(r"(#{1,6})(?!#)\s*(\S.*)")
FENCE = re.compile(r"`{3,}|~{3,}")


def settled(max_bytes: int, overlap: int) -> tuple[int, int]:
    """Sizes within their limits: 200 bytes at least, and an overlap of half a chunk at most."""
    size = max(LEAST_BYTES, max_bytes)
    return size, min(max(0, overlap), size // 2)


def marked(lines: list[str]) -> Iterator[tuple[str, tuple[int, str] | None, bool]]:
    """Each line with its heading (level, text) if it is one, and whether a fence is open before it."""
    fence = ""
    for line in lines:
        bare = line.lstrip()
        head = HEADING.fullmatch(bare) if not fence else None
        yield line, (len(head[1]), head[2].strip()) if head else None, bool(fence)
        if mark := FENCE.match(bare):
            if not fence:
                fence = mark[0][0]
            elif fence == mark[0][0]:
                fence = ""


def tail(held: list[str], overlap: int) -> list[str]:
    """The last lines, whole, up to the overlap's characters (one at least); none if that is all of them."""
    n, size = 0, 0
    for line in reversed(held):
        if n and size + len(line) + 1 > overlap:
            break
        n, size = n + 1, size + len(line) + 1
        if size >= overlap:
            break
    return held[-n:] if overlap and n < len(held) else []


def sections(body: str, max_bytes: int = MAX_BYTES, overlap: int = 0) -> Iterator[tuple[str | None, int, int, str]]:
    """(breadcrumb, first line, last line, text) of each chunk; lines count from 1 in the body.

    A heading starts a chunk unless there is only white space so far. A chunk that would grow beyond max_bytes ends, but not inside
    a fence; the next one repeats the overlap.
    """
    max_bytes, overlap = settled(max_bytes, overlap)
    lines = body.replace("\r\n", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    stack: list[tuple[int, str]] = []
    held: list[str] = []
    size, start = 0, 1
    crumb = lambda: " > ".join(t for _, t in stack) or None
    solid = lambda: any(x.strip() for x in held)
    for no, (line, head, fenced) in enumerate(marked(lines), 1):
        if head:
            if solid():
                yield crumb(), start, no - 1, "\n".join(held).strip()
                held, size, start = [], 0, no
            stack = [h for h in stack if h[0] < head[0]] + [head]
        bytes_ = len(line.encode()) + 1
        if size + bytes_ > max_bytes and not fenced and solid():
            yield crumb(), start, no - 1, "\n".join(held).strip()
            held = tail(held, overlap)
            size, start = sum(len(x.encode()) + 1 for x in held), no - len(held)
        held.append(line)
        size += bytes_
    if solid():
        yield crumb(), start, len(lines), "\n".join(held).strip()


PIECE = T.StructType([T.StructField("heading", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("text", T.StringType())])


def cut(max_bytes: int, overlap: int, schema: T.StructType, at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, begin, held = b.column(at), 0, 0
            for end in range(1, b.num_rows + 1):
                held += texts[end - 1].as_py() is not None and len(texts[end - 1].as_py())
                if held >= CUT_CHARS or end == b.num_rows:
                    yield from pieces(b.slice(begin, end - begin))
                    begin, held = end, 0

    def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Chunks of a few notes; a note's other columns are repeated PIECE_ROWS at a time."""
        repeat: list[int] = []
        flat: list[tuple] = []
        for k, x in enumerate(b.column(at)):
            for piece in sections(x.as_py() or "", max_bytes, overlap):
                repeat.append(k)
                flat.append(piece)
                if len(flat) == PIECE_ROWS:
                    yield batch(b, repeat, flat)
                    repeat, flat = [], []
        if flat:
            yield batch(b, repeat, flat)

    def batch(b: pa.RecordBatch, repeat: list[int], flat: list[tuple]) -> pa.RecordBatch:
        columns = [c.take(pa.array(repeat, pa.int64())) for k, c in enumerate(b.columns) if k != at]
        columns += [pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.int32()), pa.array([p[2] for p in flat], pa.int32()), pa.array([p[3] for p in flat], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def chunk(notes: DataFrame, max_bytes: int = MAX_BYTES, overlap: int = 0) -> DataFrame:
    """notes: path, title, tags, body and any other columns. A row for each chunk: chunk_id, heading, line_start, line_end, text, hash,
    the structure flags, and the note's other columns."""
    kept = [f for f in notes.schema.fields if f.name != "body"]
    schema = T.StructType([*kept, *PIECE.fields])
    pieces = notes.select(*[f.name for f in kept], "body").mapInArrow(cut(max_bytes, overlap, schema, len(kept)), schema)
    return with_ids(pieces.withColumns({"hash": F.sha2(F.col("text").cast("binary"), 256), **structure(F.col("text"))}))


def with_ids(chunks: DataFrame) -> DataFrame:
    """Ids from path, title, tags, heading and text; equal chunks of a note are told apart by their order."""
    seed = [F.col("path"), F.coalesce("title", F.lit("")), F.array_join("tags", "\u001f"), F.coalesce("heading", F.lit("")), F.col("hash")]
    again = F.row_number().over(Window.partitionBy("path", "heading", "hash").orderBy("line_start")) - 1
    return chunks.withColumn("occurrence", again).withColumn("chunk_id", F.concat(F.lit("chk_"), F.substring(F.sha2(F.concat_ws("\u0000", *seed, F.col("occurrence").cast("string")).cast("binary"), 256), 1, 24))).drop("occurrence")


def embedding_text(title: Column, heading: Column, tags: Column, text: Column) -> Column:
    """What is embedded of a chunk: labelled title, heading and tags, then the text."""
    return F.concat_ws("\n", F.concat(F.lit("title: "), title), F.concat(F.lit("heading: "), heading), F.when(F.size(tags) > 0, F.concat(F.lit("tags: "), F.array_join(tags, ", "))), text)
