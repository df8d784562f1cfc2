"""Operator 5: sequence packing by minimum bin slack.

Whole documents are tokenised where they are read and packed in the same task, so nothing is shuffled. A document
of more than one window gives full windows at once; its rest joins a pool. A window is then filled from the pool by
minimum bin slack: the oldest piece is fixed, and a bitset of reachable sums, one Python integer per distinct length
and copy count, tells which multiset of the other lengths comes closest to the capacity; the counts are found again by
walking the bitsets backwards. What is left at a task's end is cut into windows of powers of two, which need no
padding. Memory is bounded by the pool: POOL pieces, or as many as two windows' tokens (each has one at least).

Nulls and empty texts give one piece that holds only the end id. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import batch, give_back

CAPACITY, END_ID, POOL, CACHED_WORDS = 4096, 2, 384, 400_000
#: Bits of sequence_id that number the windows of one task.
LOCAL_BITS = 36
#: White space to Python but not to the tokenizer, and chunks between what is white space to the tokenizer.
NOT_SPACE, CHUNKS = re.compile(r"[\x1c-\x1f]"), re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Letters that stay letters, one by one, in lower case; then ASCII signs that neither join letters nor begin a special token's name.
LETTERS_AND_SIGNS = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:;=?@\[-`{}~]*)")
#: The characters that byte-level vocabularies have for bytes which Latin-1 doesn't print.
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Words by which a tokenizer shows whether letters go to its model as they are, in lower case and byte by byte.
PROBES = ["a", "Zebra", "the", "windows", "\xc0\xe9\xf1", "stra\xdfe", "\xd8re", "\xff\xfe", "qzxjkvw" * 9, *map(chr, range(0xC0, 0xD7)), *map(chr, range(0xD8, 0xF7)), *map(chr, range(0xF8, 0x100))]

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_WITH_IDS = PIECES.append(pa.field("ids", pa.list_(pa.int32())))
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Chunk of text without white space -> its ids as little-endian 32-bit bytes.

    White space always separates tokens of this kind of vocabulary and is dropped, so a text's ids are those of its
    chunks. Two generations bound the memory: chunks not used since the last change of generation are encoded again.
    """

    def __init__(self, tokenizer, most: int = CACHED_WORDS):
        super().__init__()
        self.tokenizer, self.most, self.old, self.model = tokenizer, most, {}, tokenizer.model
        self.direct = all(self.ids_of_letters(x) == self.ids_of_any(x) for x in PROBES)

    def ids_of_any(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids_of_letters(self, chunk: str) -> bytes:
        """The model's ids, without the steps that leave a run of letters whole."""
        chunk = chunk.lower()
        if not chunk.isascii():
            chunk = chunk.encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = [x.id for x in self.model.tokenize(chunk)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            parts = LETTERS_AND_SIGNS.fullmatch(chunk) if self.direct else None
            if parts and parts[2]:  # letters and signs are never one token
                ids = self[parts[1]] + self[parts[2]]
            else:
                ids = self.ids_of_letters(chunk) if parts else self.ids_of_any(chunk)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" not in text:  # a special token's name counts only as it is written
            try:
                text.encode("latin-1")
                text = text.lower()  # the vocabulary is lower case; in this range letter by letter
            except UnicodeEncodeError:
                pass
        return b"".join([self[chunk] for chunk in (CHUNKS.findall(text) if NOT_SPACE.search(text) else text.split())])


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per worker process, kept between its tasks."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path))


def fill(first: int, available: dict[int, int], capacity: int) -> list[int]:
    """The lengths, `first` among them, whose sum comes closest to the capacity; available: copies of each other length."""
    room = capacity - first
    within = (1 << (room + 1)) - 1
    reachable, steps = 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        copies, size = min(available[length], room // length), 1
        while copies:
            take = min(size, copies)
            steps.append((length, take, reachable))
            reachable |= (reachable << (length * take)) & within
            copies -= take
            size *= 2
        if reachable >> room & 1:
            break
    total, chosen = reachable.bit_length() - 1, [first]
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


class Packer:
    """Packs (key, ids) as they come; windows come out as lists of pieces (key, start, ids, tokens of the document)."""

    def __init__(self, capacity: int = CAPACITY, pool: int = POOL):
        self.capacity, self.most = capacity, pool
        self.waiting: dict[int, deque] = defaultdict(deque)
        self.order: deque = deque()
        self.held, self.tokens = 0, 0

    def add(self, key, ids: np.ndarray) -> Iterator[list[tuple]]:
        n, cut = len(ids), len(ids) - len(ids) % self.capacity
        for start in range(0, cut, self.capacity):
            yield [(key, start, ids[start : start + self.capacity], n)]
        if cut < n:
            piece = (key, cut, ids[cut:].copy() if cut else ids, n)
            self.waiting[n - cut].append(piece)
            self.order.append((n - cut, id(piece), piece))
            self.held, self.tokens = self.held + 1, self.tokens + n - cut
        while self.held >= self.most and self.tokens >= 2 * self.capacity:
            yield self.window()

    def take(self, length: int) -> tuple:
        queue = self.waiting[length]
        piece = queue.popleft()
        if not queue:
            del self.waiting[length]
        self.held, self.tokens = self.held - 1, self.tokens - length
        return piece

    def oldest(self) -> int:
        while True:
            length, ident, _ = self.order[0]
            queue = self.waiting.get(length)
            if queue and id(queue[0]) == ident:
                return length
            self.order.popleft()

    def window(self) -> list[tuple]:
        first = self.oldest()
        pieces = [self.take(first)]
        lengths = fill(first, {k: len(v) for k, v in self.waiting.items()}, self.capacity)
        pieces += [self.take(x) for x in lengths[1:]]
        room = self.capacity - sum(lengths)
        if room and self.waiting:  # no multiset fills the window: a longer piece is cut
            key, start, ids, n = self.take(max(self.waiting))
            pieces.append((key, start, ids[:room], n))
            rest = (key, start + room, ids[room:], n)
            self.waiting[len(ids) - room].append(rest)
            self.order.append((len(ids) - room, id(rest), rest))
            self.held, self.tokens = self.held + 1, self.tokens + len(ids) - room
        return pieces

    def rest(self) -> Iterator[list[tuple]]:
        while self.tokens >= self.capacity:
            yield self.window()
        pieces = [self.take(self.oldest()) for _ in range(self.held)]
        self.order.clear()
        left, at = sum(len(p[2]) for p in pieces), 0
        while left:
            size, window = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                key, start, ids, n = pieces[at]
                took = ids[:size]
                window.append((key, start, took, n))
                size -= len(took)
                if len(took) == len(ids):
                    at += 1
                else:
                    pieces[at] = (key, start + len(took), ids[len(took) :], n)
            yield window


def pack_batches(batches: Iterable[pa.RecordBatch], path: str, capacity: int = CAPACITY, with_ids: bool = False, task: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to batches of pieces."""
    ids_of, packer, end = word_ids(path), Packer(capacity), np.array([END_ID], dtype="<u4").tobytes()
    task = TaskContext.get().partitionId() if task is None else task
    schema, sequence, rows = PIECES_WITH_IDS if with_ids else PIECES, task << LOCAL_BITS, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        return batch(schema, **dict(zip(schema.names, map(list, columns))))

    def write(window: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for key, start, ids, n in window:
            rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset) + ((ids.astype("<i4"),) if with_ids else ()))
            offset += len(ids)
        sequence += 1

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            for window in packer.add(key, np.frombuffer(ids_of.encode(text.as_py() or "") + end, dtype="<u4")):
                write(window)
            if len(rows) >= (256 if with_ids else 8192):
                yield out()
    for window in packer.rest():
        write(window)
    if rows:
        yield out()
    ids_of.old = {}
    give_back()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A window holds the capacity or a power of two. The tokenizer's file must be on every executor.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: pack_batches(batches, tokenizer, capacity, with_ids), DDL + (", ids array<int>" if with_ids else ""))
