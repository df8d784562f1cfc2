"""Operator 4: exact substring dedup over a sparse, range-partitioned suffix array.

A byte is removed if a string of WIDTH bytes that covers it also starts in a document with a smaller id. Every string of
WIDTH bytes holds WIDTH-GRAM+1 grams of GRAM bytes; those with the least hash are its anchors, so equal strings have
equal anchors at equal places, and only suffixes at anchors (about one byte in 13) need be sorted. That is exact: a
string of WIDTH bytes is repeated just if, at one of its anchors, the bytes before and after agree.

Documents are dealt to blocks. Rounds of messages between blocks and ranges, all within one Spark job:

1. A block sends the distinct hashes of its anchors' grams, packed as sorted differences, to the range of hashes they
   fall in, and a digest of each document. The range answers with a bit for each: whether another document has the
   gram; and whether a smaller document is an exact copy, which settles all of this one.
2. A block sends the distinct contexts of shared anchors (the suffix, WIDTH bytes, and the WIDTH-GRAM bytes before it)
   with the least id. They are range-partitioned by sampled splitters on the suffix's leading GRAM bytes, so equal
   grams never lie across a boundary. A range sorts its suffixes by multikey quicksort, eight bytes a key, compares
   neighbours, and for each distance before the anchor finds the least id of each repeated string; it answers with a
   bit for each distance.
3. A block marks the bytes covered and cuts them out.

Contexts that a block holds more than once are sent once, and a group of exact copies after its first document not at
all. A task holds a block (its size is bounded but for a single longer document) or a range. Blocks and ranges depend
on the total of bytes; at 100 TB, raise BLOCK_BYTES and RANGE_BYTES, as messages are blocks times ranges.

Null and empty texts have no bytes. Rows with a null id are returned whole and take no part. Rows that repeat an id never
remove each other's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, give_back, quoted, table

WIDTH, GRAM = 50, 24
LEFT = WIDTH - GRAM
BLOCK_BYTES, RANGE_BYTES, LEAST_RANGES, SAMPLE_DOCS, SAMPLES = (4 << 20, 64 << 20), 24 << 20, 12, 4000, 16
#: Bytes hashed, and contexts taken, at once.
SEGMENT, AT_ONCE = 1 << 20, 1 << 15
CONTEXT = WIDTH + LEFT + 2
U = np.uint64
MESSAGE = pa.schema([("to", pa.int32()), ("sender", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
MESSAGE_DDL = "to int, sender int, kind int, a binary, b binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pressed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(x: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.frombuffer(pa.decompress(x[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b"", dtype=dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers as byte planes of their differences."""
    d = np.diff(x, prepend=U(0)).astype("<u8")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    used = max(1, 8 - int((planes[::-1].any(axis=1)).argmax())) if len(x) else 1
    return bytes([used]) + pressed(planes[:used])


def unpack_sorted(x: bytes) -> np.ndarray:
    planes = opened(x[1:], np.uint8).reshape(x[0], -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, : x[0]] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def groups(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate(([0], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


class Block:
    """The documents of a block as one buffer, with their anchors."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: pa.Array):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        self.ids, self.known = ids, known
        self.bounds = ends - ends[0]
        self.size = len(data)
        self.bytes = np.concatenate((np.zeros(LEFT, np.uint8), data, np.zeros(WIDTH + 8, np.uint8)))  # byte i is at LEFT + i
        self.digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())]
        self._anchors()

    def words(self, at: int, n: int, step: int) -> np.ndarray:
        return np.ndarray((n,), "<u8", buffer=self.bytes.data, offset=LEFT + at + step, strides=(1,))

    def _anchors(self) -> None:
        found_at, found_hash = [], []
        starts, stops = self.bounds[:-1], self.bounds[1:]
        long = self.known & (stops - starts >= WIDTH)
        if long.any():
            begins = np.zeros(self.size + 1, np.int32)  # strings that lie within one document
            np.add.at(begins, starts[long], 1)
            np.add.at(begins, stops[long] - WIDTH + 1, -1)
            for s in range(0, self.size - WIDTH + 1, SEGMENT):
                e = min(s + SEGMENT, self.size - WIDTH + 1)
                valid = np.cumsum(begins[s:e]) + (0 if s == 0 else carry) > 0
                carry = (0 if s == 0 else carry) + int(begins[s:e].sum())
                if not valid.any():
                    continue
                n = e - s + LEFT
                h = mixed(self.words(s, n, 0) ^ U(0x9E3779B97F4A7C15))
                for step in range(8, GRAM, 8):
                    h = mixed(h + self.words(s, n, step))
                h |= U(1)
                least = np.where(valid, sliding(h, LEFT + 1, np.minimum), U(0))
                edge = np.zeros(LEFT, np.uint64)
                most = sliding(np.concatenate((edge, least, edge)), LEFT + 1, np.maximum)
                at = np.flatnonzero(most == h)
                found_at.append(at + s)
                found_hash.append(h[at])
        self.at = np.concatenate(found_at) if found_at else np.zeros(0, np.int64)
        self.hash = mixed(np.concatenate(found_hash)) if found_hash else np.zeros(0, np.uint64)
        self.at, first = np.unique(self.at, return_index=True)
        self.hash = self.hash[first]
        self.doc = np.searchsorted(self.bounds[1:], self.at, side="right")

    def grams(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct gram hashes, ascending; whether two documents of the block have it; for each anchor its place."""
        h = self.hash >> U(64 - bits)
        order = np.argsort(h, kind="stable")
        first, ids = runs(h[order]), self.ids[self.doc[order]]
        place = np.empty(len(h), np.int64)
        place[order] = groups(h[order])
        if not len(first):
            return h, np.zeros(0, bool), place
        return h[order][first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first), place

    def firsts(self) -> dict[bytes, int]:
        """Digest of a document that is long enough -> the block's least id of it."""
        least: dict[bytes, int] = {}
        for digest, doc, known, n in zip(self.digests, self.ids.tolist(), self.known.tolist(), np.diff(self.bounds).tolist()):
            if known and n >= WIDTH:
                least[digest] = min(doc, least.get(digest, doc))
        return least

    def copies(self, first_elsewhere: dict[bytes, int]) -> np.ndarray:
        """Which documents equal one with a smaller id."""
        least = self.firsts()
        found = [known and digest in least and min(least[digest], first_elsewhere.get(digest, doc)) < doc for digest, doc, known in zip(self.digests, self.ids.tolist(), self.known.tolist())]
        return np.array(found, dtype=bool)

    def contexts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the chosen anchors: distinct contexts (suffix, bytes before from near to far, both valid lengths), their
        least ids, and each anchor's place among them."""
        at, doc = self.at[chosen], self.doc[chosen]
        after = np.minimum(self.bounds[1:][doc] - at, WIDTH)
        before = np.minimum(at - self.bounds[:-1][doc], LEFT)
        view = np.lib.stride_tricks.sliding_window_view(self.bytes, WIDTH + LEFT)
        c, h = np.zeros((len(at), -(-CONTEXT // 8) * 8), np.uint8), np.zeros(len(at), np.uint64)
        for s in range(0, len(at), AT_ONCE):
            e = min(s + AT_ONCE, len(at))
            raw, part = view[at[s:e]], c[s:e]  # from LEFT bytes before an anchor
            part[:, :WIDTH] = np.where(np.arange(WIDTH) < after[s:e, None], raw[:, LEFT:], 0)
            part[:, WIDTH : WIDTH + LEFT] = np.where(np.arange(LEFT) < before[s:e, None], raw[:, :LEFT][:, ::-1], 0)
            part[:, WIDTH + LEFT], part[:, WIDTH + LEFT + 1] = after[s:e], before[s:e]
            for k in range(c.shape[1] // 8):
                h[s:e] = mixed(h[s:e] + np.ascontiguousarray(part[:, 8 * k : 8 * k + 8]).view("<u8").ravel() + U(k + 1))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        pairs = np.flatnonzero(same)
        if any((c[order[x]] != c[order[x + 1]]).any() for x in np.split(pairs, range(AT_ONCE, len(pairs), AT_ONCE))):  # different contexts of one hash
            order = np.lexsort(c.T[::-1])
            same = (c[order][1:] == c[order][:-1]).all(axis=1)
        first = np.flatnonzero(np.concatenate(([True], ~same))) if len(at) else np.zeros(0, np.int64)
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(np.concatenate(([0], ~same))) if len(at) else 0
        ids = np.minimum.reduceat(self.ids[doc][order], first) if len(at) else np.zeros(0, np.int64)
        return c[order[first], :CONTEXT], ids, place


def messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, MESSAGE)], schema=MESSAGE)


def block_of(documents: pa.Table) -> Block:
    ids = documents.column("doc_id")
    return Block(np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), documents.column("_bytes"))


def sorted_rows(t: pa.Table, kind: int) -> list[dict]:
    return sorted((r for r in t.to_pylist() if r["kind"] == kind), key=lambda r: r["sender"])


class Plan:
    """The rounds' functions; n_ranges, hash bits and splitters travel with them."""

    def __init__(self, n_ranges: int, bits: int, splitters: list[bytes], with_text: bool = False):
        self.n_ranges, self.bits, self.splitters, self.with_text = n_ranges, bits, np.array(splitters, dtype=f"S{GRAM}"), with_text

    # Round 1, in a block
    def send_grams(self, key, documents: pa.Table) -> pa.Table:
        b, rows = block_of(documents), []
        grams, shared, _ = b.grams(self.bits)
        to = self.gram_range(grams)
        for r, part in self.parts(to):
            rows.append((r, key[0].as_py(), 1, pack_sorted(grams[part]), pressed(np.packbits(shared[part]))))
        by_range: dict[int, list] = {}
        for digest, doc in b.firsts().items():
            by_range.setdefault(int.from_bytes(digest[:4], "little") % self.n_ranges, []).append((digest, doc))
        for r, found in by_range.items():
            rows.append((r, key[0].as_py(), 2, b"".join(d for d, _ in found), np.array([x for _, x in found], "<i8").tobytes()))
        return messages(rows)

    def gram_range(self, grams: np.ndarray) -> np.ndarray:
        return ((grams >> U(max(0, self.bits - 32))) * U(self.n_ranges) >> U(min(32, self.bits))).astype(np.int64)

    @staticmethod
    def parts(to: np.ndarray) -> Iterator[tuple[int, slice]]:
        first = runs(to)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(to)]):
            yield int(to[a]), slice(a, b)

    # Round 1, in a range
    def answer_grams(self, key, t: pa.Table) -> pa.Table:
        rows = sorted_rows(t, 1)
        if rows:
            lists = [unpack_sorted(r["a"]) for r in rows]
            flags = [np.unpackbits(opened(r["b"], np.uint8), count=len(x)).astype(bool) for r, x in zip(rows, lists)]
            every, flag = np.concatenate(lists), np.concatenate(flags)
            order = np.argsort(every, kind="stable")
            first, of = runs(every[order]), groups(every[order])
            common = np.logical_or.reduceat(flag[order], first) | (np.diff(np.append(first, len(every))) > 1)
            shared = np.empty(len(every), bool)
            shared[order] = common[of]
            cuts = np.cumsum([len(x) for x in lists])[:-1]
            out = [(r["sender"], key[0].as_py(), 1, pressed(np.packbits(part)), len(part).to_bytes(8, "little")) for r, part in zip(rows, np.split(shared, cuts))]
        else:
            out = []
        documents = sorted_rows(t, 2)
        least: dict[bytes, int] = {}
        held = [([r["a"][i : i + 16] for i in range(0, len(r["a"]), 16)], np.frombuffer(r["b"], "<i8").tolist()) for r in documents]
        for digests, ids in held:
            for digest, doc in zip(digests, ids):
                least[digest] = min(doc, least.get(digest, doc))
        for r, (digests, ids) in zip(documents, held):
            smaller = [(d, least[d]) for d, doc in zip(digests, ids) if least[d] < doc]
            if smaller:
                out.append((r["sender"], key[0].as_py(), 2, b"".join(d for d, _ in smaller), np.array([x for _, x in smaller], "<i8").tobytes()))
        return messages(out)

    def candidates(self, b: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which documents are copies, and which anchors' contexts matter."""
        shared = [np.unpackbits(opened(r["a"], np.uint8), count=int.from_bytes(r["b"], "little")) for r in sorted_rows(answers, 1)]
        elsewhere = {r["a"][i : i + 16]: int(x) for r in sorted_rows(answers, 2) for i, x in zip(range(0, len(r["a"]), 16), np.frombuffer(r["b"], "<i8"))}
        copies = b.copies(elsewhere)
        if not len(b.at):
            return copies, np.zeros(0, bool)
        _, _, place = b.grams(self.bits)
        return copies, np.concatenate(shared).astype(bool)[place] & ~copies[b.doc]

    def ranged(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contexts' order by range and leading bytes, and their ranges in that order."""
        to = np.searchsorted(self.splitters, np.ascontiguousarray(c[:, :GRAM]).view(f"S{GRAM}").ravel(), side="right") if len(c) else np.zeros(0, np.int64)
        order = np.lexsort((np.ascontiguousarray(c[:, :8]).view(">u8").ravel(), to))
        return order, to[order]

    # Round 2, in a block
    def send_contexts(self, key, documents: pa.Table, answers: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return messages([])
        b = block_of(documents)
        _, chosen = self.candidates(b, answers)
        c, ids, _ = b.contexts(np.flatnonzero(chosen))
        order, to = self.ranged(c)
        return messages([(r, int(documents.column("_block")[0].as_py()), 3, pressed(c[order[part]]), pressed(ids[order[part]].astype("<i8"))) for r, part in self.parts(to)])

    # Round 2, in a range
    def answer_contexts(self, key, t: pa.Table) -> pa.Table:
        rows = sorted_rows(t, 3)
        parts = [opened(r["a"], np.uint8).reshape(-1, CONTEXT) for r in rows]
        ids = np.concatenate([opened(r["b"], "<i8") for r in rows])
        masks = repeated(np.concatenate(parts), ids)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return messages([(r["sender"], key[0].as_py(), 3, pressed(m.astype("<u4")), b"") for r, m in zip(rows, np.split(masks, cuts))])

    # Round 3, in a block
    def cut(self, documents: pa.Table, answers: pa.Table) -> pa.Table:
        b = block_of(documents)
        copies, chosen = self.candidates(b, answers)
        chosen = np.flatnonzero(chosen)
        c, ids, place = b.contexts(chosen)
        order, _ = self.ranged(c)
        mask = np.zeros(len(c), np.uint32)
        if len(c):
            mask[order] = np.concatenate([opened(r["a"], "<u4") for r in sorted_rows(answers, 3)])
        at, own = b.at[chosen], mask[place] if len(c) else mask
        if len(c):
            distances = np.arange(LEFT + 1)
            whole = ((distances <= c[:, WIDTH + LEFT + 1][:, None]) & (WIDTH - distances <= c[:, WIDTH + LEFT][:, None])) @ (1 << distances)
            own = np.where(b.ids[b.doc[chosen]] > ids[place], whole[place], own)  # the block itself has a smaller document
        change = np.zeros(b.size + 1, np.int32)
        for d in range(LEFT + 1):
            hit = at[(own >> d & 1).astype(bool)] - d
            change[hit] += 1
            change[hit + WIDTH] -= 1
        gone = np.cumsum(change[:-1]) > 0
        for k in np.flatnonzero(copies):
            gone[b.bounds[k] : b.bounds[k + 1]] = True
        return self.results(b, gone, documents, self.with_text)

    @staticmethod
    def results(b: Block, gone: np.ndarray, documents: pa.Table, with_text: bool) -> pa.Table:
        lo, hi = b.bounds[:-1], b.bounds[1:]
        before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
        before[lo[lo < b.size]] = False
        after = np.concatenate((gone[1:], [False])) if len(gone) else gone
        after[hi[hi > lo] - 1] = False
        starts, stops = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        per = np.searchsorted(starts, np.append(lo, b.size))
        removed = np.concatenate(([0], np.cumsum(gone)))
        data = b.bytes[LEFT : LEFT + b.size]
        kept_bytes, kept_to = data[~gone].tobytes(), np.arange(b.size + 1) - removed
        kept = [kept_bytes[x:y] for x, y in zip(kept_to[lo].tolist(), kept_to[hi].tolist())]
        owner = np.searchsorted(hi, starts, side="right")
        offsets = pa.array(per.astype(np.int32))
        n = {
            "n_bytes": pa.array(hi - lo), "n_removed": pa.array(removed[hi] - removed[lo]), "n_spans": pa.array(np.diff(per)),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            "span_starts": pa.ListArray.from_arrays(offsets, pa.array(starts - lo[owner])), "span_ends": pa.ListArray.from_arrays(offsets, pa.array(stops - lo[owner])),
        }
        if with_text:
            n |= {"kept_text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), "was_null": documents.column("_bytes").is_null()}
        rest = documents.drop_columns(["_block", "_bytes"])
        for name, column in n.items():
            rest = rest.append_column(f"_{name}", column)
        return rest


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort: by the first key, then each run of equal ones by the next, and so on."""
    order = np.argsort(keys[0], kind="stable")
    of = groups(keys[0][order])
    for key in keys[1:]:
        size = np.bincount(of)
        tied = np.flatnonzero(size[of] > 1)
        if not len(tied):
            break
        inner = np.lexsort((key[order[tied]], of[tied]))
        order[tied] = order[tied[inner]]
        k = key[order]
        of = np.cumsum(np.concatenate(([0], (of[1:] != of[:-1]) | ((k[1:] != k[:-1]) & (size[of[1:]] > 1)))))
    return order


def repeated(c: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each context a mask: bit d is set if the string that begins d bytes before the anchor is also one of a smaller id."""
    padded = np.zeros((len(c), -(-WIDTH // 8) * 8), np.uint8)
    padded[:, :WIDTH] = c[:, :WIDTH]
    order = multikey_order([np.ascontiguousarray(padded[:, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, padded.shape[1], 8)])
    s = c[order]
    differ = s[1:, :WIDTH] != s[:-1, :WIDTH]
    common = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)))  # with the suffix before
    of = np.cumsum(common < GRAM)
    many = (np.bincount(of)[of] > 1) if len(of) else np.zeros(0, bool)  # a gram with one context has nothing to compare
    masks = np.zeros(len(c), np.int64)
    s, common, own = s[many], common[many], ids[order][many]
    if not len(s):
        return masks
    after, before = s[:, WIDTH + LEFT].astype(np.int64), s[:, WIDTH + LEFT + 1].astype(np.int64)
    left, found = np.zeros(len(s), np.uint64), np.zeros(len(s), np.int64)
    for d in range(LEFT + 1):
        if d:
            left = (left + s[:, WIDTH + d - 1] + U(1)) * U(0x9E3779B97F4A7C15)
            left ^= left >> U(32)
        valid = np.flatnonzero((before >= d) & (after >= WIDTH - d))
        suffix = np.cumsum(common < WIDTH - d).astype(np.uint64)[valid]
        key = mixed(suffix * U(0xD6E8FEB86659FD93) ^ left[valid])
        o = np.argsort(key, kind="stable")
        same = key[o][1:] == key[o][:-1]
        pair = np.flatnonzero(same)
        x, y = valid[o[pair]], valid[o[pair + 1]]
        if (suffix[o[pair]] != suffix[o[pair + 1]]).any() or (s[x, WIDTH : WIDTH + d] != s[y, WIDTH : WIDTH + d]).any():  # different strings of one key
            o = np.lexsort((*s[valid, WIDTH : WIDTH + d].T[::-1], suffix)) if d else np.argsort(suffix, kind="stable")
            same = (suffix[o][1:] == suffix[o][:-1]) & (s[valid[o[1:]], WIDTH : WIDTH + d] == s[valid[o[:-1]], WIDTH : WIDTH + d]).all(axis=1)
        if not len(valid):
            continue
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.minimum.reduceat(own[valid[o]], first)[np.cumsum(np.concatenate(([0], ~same)))]
        hit = valid[o[least < own[valid[o]]]]
        found[hit] |= 1 << d
    masks[order[many]] = found
    return masks


def splitters(docs: DataFrame, n_docs: int, n_ranges: int) -> list[bytes]:
    """Quantiles of the leading bytes of a bounded sample of suffixes."""
    text = F.col("text").cast("binary")
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0).filter(F.octet_length("text") >= GRAM)
    at = F.transform(F.sequence(F.lit(1), F.lit(SAMPLES)), lambda i: F.substring(text, (1 + F.pmod(F.xxhash64("doc_id", i), (F.octet_length("text") - GRAM + 1).cast("long"))).cast("int"), F.lit(GRAM)))
    found = sorted(bytes(r[0]) for r in some.select(F.explode(at)).limit(4 * SAMPLE_DOCS * SAMPLES).collect())
    return sorted({found[len(found) * k // n_ranges] for k in range(1, n_ranges)}) if found else []


def freeing(step, *tables):
    """A step's result, with what its group took given back."""
    out = step(*tables)
    give_back()
    return out


def cut_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document doc_id, _rest (a struct of its columns but the text), _n_bytes, _n_removed, _n_spans, _kept_sha256, _span_starts, _span_ends.

    with_text: also _kept_text, the bytes kept as text without what is left of a cut character, and _was_null.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    block = min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], size["b"] // 200))
    n_blocks, n_ranges = max(1, -(-size["b"] // block)), max(LEAST_RANGES, -(-size["b"] // RANGE_BYTES))
    plan = Plan(n_ranges, min(64, max(40, size["b"].bit_length() + 14)), splitters(docs, size["n"], n_ranges), with_text)
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n_blocks)).cast("int").alias("_block"), F.col("text").cast("binary").alias("_bytes"), "doc_id",
        F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("_rest"),
    )
    by_block = dealt.groupBy("_block")
    grams = by_block.applyInArrow(lambda key, t: freeing(plan.send_grams, key, t), MESSAGE_DDL)
    gram_answers = grams.groupBy("to").applyInArrow(lambda key, t: freeing(plan.answer_grams, key, t), MESSAGE_DDL)
    contexts = by_block.cogroup(gram_answers.groupBy("to")).applyInArrow(lambda key, t, found: freeing(plan.send_contexts, key, t, found), MESSAGE_DDL)
    answers = contexts.groupBy("to").applyInArrow(lambda key, t: freeing(plan.answer_contexts, key, t), MESSAGE_DDL).unionByName(gram_answers)
    out = T.StructType([dealt.schema["doc_id"], dealt.schema["_rest"]])
    for name, kind in (("_n_bytes", "long"), ("_n_removed", "long"), ("_n_spans", "long"), ("_kept_sha256", "string"), ("_span_starts", T.ArrayType(T.LongType())), ("_span_ends", T.ArrayType(T.LongType()))):
        out = out.add(name, kind)
    if with_text:
        out = out.add("_kept_text", "string").add("_was_null", "boolean")
    return by_block.cogroup(answers.groupBy("to")).applyInArrow(lambda key, documents, found: freeing(plan.cut, documents, found), out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, less the bytes removed (and what they leave of a cut character).

    A document that the cut leaves without a word goes; one that had none before stays.
    """
    found = cut_repeats(docs, with_text=True).filter((F.col("_n_removed") == 0) | F.col("_kept_text").rlike(WORD))
    kept = F.when(F.col("_was_null"), F.lit(None).cast("string")).otherwise(F.col("_kept_text"))
    return found.select(*[kept.alias("text") if c == "text" else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    found = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))
