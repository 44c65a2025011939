"""Benchmark decontamination by Wu-Manber multi-pattern search.

The benchmark's windows (8 words, or a whole shorter item) are the patterns. Per class of pattern
lengths, a hashed table gives for every block of bytes how far the search may jump; where it says
zero, the patterns with that block at the same place are compared byte by byte. Many cursors,
one per stretch of text, move at once.

Texts never move: each document is searched where it is read. The benchmark's texts are broadcast
in blocks of at most BLOCK_BYTES. For a larger benchmark the rows are numbered in a table once; every block's search
gives the numbers, spans and items of the rows that it hits, which are then joined to that table.

A benchmark item in a training text is a leak even if it is the only one: drop_contaminated takes a
document out for one whole window of WINDOW words of any item, or for MIN_ITEMS items (which may be shorter).

Defined cases: a null or empty text has no words, no hits and the digest of the empty string; a very long text is searched
whole (in a slice of its own); a null or wordless item has no windows; a null item_id is left out; equal items, or
items that repeat, each count by their item_id once; items that tie on a window are all found; repeated document rows are
searched and returned each; an empty table gives an empty result, an empty benchmark contaminates
nothing; extra columns, whatever their names, are carried in a struct and left alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quillspark.llm.batches import append
from quillspark.llm.common import carried, materialize

WINDOW, MIN_ITEMS, BLOCK_BYTES = 8, 2, 8 << 20
#: Bytes as words have them: A-Z lower-cased, other ASCII but a-z and 0-9 a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CLASSES, STRETCH = (0, 8, 16, 32, 64), 2048


class WuManber:
    """All patterns of one class of lengths."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        self.patterns = patterns
        self.m = m = min(len(p) for _, p in patterns)
        self.block = block = min(8, m)
        heads = np.frombuffer(b"".join(p[:m] for _, p in patterns), np.uint8).reshape(len(patterns), m)
        self.bits = min(22, max(12, int(np.log2(heads.size)) + 4))
        self.shift = np.full(1 << self.bits, m - block + 1, np.int32)
        buckets: dict[int, list[int]] = {}
        for end in range(block, m + 1):
            h = self.hashed(heads[:, end - block : end])
            np.minimum.at(self.shift, h, m - end)
        for k, slot in enumerate(h.tolist()):
            buckets.setdefault(slot, []).append(k)
        self.buckets = buckets

    def hashed(self, blocks: np.ndarray) -> np.ndarray:
        eight = np.zeros((len(blocks), 8), np.uint8)
        eight[:, : self.block] = blocks
        return ((eight.view(np.uint64)[:, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, data: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in data."""
        m, block, found = self.m, self.block, []
        if len(data) < m:
            return found
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), block)
        at = np.arange(m, len(data) + 1, STRETCH)
        until = np.minimum(at + STRETCH, len(data) + 1)
        events, slots = [], []
        while len(at):
            h = self.hashed(windows[at - block])
            jump = self.shift[h]
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                events.append(at[hit])
                slots.append(h[hit])
                jump[hit] = 1
            at = at + jump
            on = at < until
            if not on.all():
                at, until = at[on], until[on]
        for end, slot in zip(np.concatenate(events).tolist(), np.concatenate(slots).tolist()) if events else ():
            for k in self.buckets.get(slot, ()):
                if data.startswith(self.patterns[k][1], end - m):
                    found.append((end - m, k))
        return found


class Searcher:
    def __init__(self, items: list[tuple[str, bytes]], window: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            words = text.translate(FOLD).split()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).add(item)
        self.patterns = sorted(owners)
        self.owners = [sorted(owners[p]) for p in self.patterns]
        self.lengths = np.array([p.count(b" ") - 1 for p in self.patterns])
        self.window = window
        by: dict[int, list[tuple[int, bytes]]] = {}
        for k, p in enumerate(self.patterns):
            by.setdefault(max(c for c in CLASSES if c <= len(p)), []).append((k, p))
        self.searches = [WuManber(x) for _, x in sorted(by.items())]

    def spans(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]], list[bool]]:
        """Per text: its number of words, the merged runs of hit words, the items found, whether a
        window of the full length is among the hits."""
        n_words, parts, starts, at = [], [], [], 0
        for x in texts:
            words = x.translate(FOLD).split()
            n_words.append(len(words))
            part = b" " + b" ".join(words) + b" "
            parts.append(part)
            starts.append(at)
            at += len(part) + 1
        data = b"\n".join(parts)
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        whole = [False] * len(texts)
        found = [(start, s.patterns[k][0]) for s in self.searches for start, k in s.search(data)]
        if found:
            found.sort()
            where, which = (np.array(x) for x in zip(*found))
            doc = np.searchsorted(starts, where, side="right") - 1
            spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
            first = np.searchsorted(spaces, where) - np.searchsorted(spaces, np.array(starts)[doc])
            own: dict[int, set[str]] = {}
            for d, a, b, k in zip(doc.tolist(), first.tolist(), (first + self.lengths[which]).tolist(), which.tolist()):
                own.setdefault(d, set()).update(self.owners[k])
                whole[d] = whole[d] or b - a >= self.window
                if runs[d] and a <= runs[d][-1][1]:
                    runs[d][-1] = (runs[d][-1][0], max(b, runs[d][-1][1]))
                else:
                    runs[d].append((a, b))
            for d, x in own.items():
                items[d] = sorted(x)
        return n_words, runs, items, whole


SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
FIELDS = [StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN)), StructField("items", ArrayType(StringType())), StructField("whole", BooleanType())]
ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string()), pa.bool_()]
_built: dict[str, Searcher] = {}  # of the last block that this worker searched


def searched(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """rows(text and others) with n_words, spans, items and whole; items: a block that may be broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in items.collect()])
    key = uuid.uuid4().hex  # the broadcast's: addresses of objects are used again

    def values(texts):
        if key not in _built:
            _built.clear()
            _built[key] = Searcher(shared.value, window)
        n_words, runs, found, whole = _built[key].spans(texts)
        return [pa.array(x, t) for x, t in zip((n_words, [[{"start": a, "end": b} for a, b in x] for x in runs], found, whole), ARROW)]

    return append(rows, FIELDS, values)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (a struct of the columns of docs), n_words, n_hit, spans (word runs), items (item_ids, sorted
    as strings) and whole (a window of window words is hit) for every row of docs."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    rows = carried(docs, "text")
    if blocks == 1:
        found = searched(rows, items, window)
    else:
        rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "overlap")
        hits = None
        for k in range(blocks):
            own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            got = searched(rows.select("at", "text"), own, window).select("at", *[f.name for f in FIELDS])
            if k:
                got = got.where("size(items) > 0")  # the first block's rows give every text's number of words
            hits = got if hits is None else hits.union(got)
        by = hits.groupBy("at").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("whole").alias("whole"),
        )
        found = rows.select("at", "row").join(by, "at")
    n_hit = F.expr("aggregate(spans, struct(0L AS n, 0 AS until), (a, s) -> struct(a.n + greatest(s.end - greatest(s.start, a.until), 0) AS n, greatest(a.until, s.end) AS until)).n")
    return found.select("row", "n_words", n_hit.alias("n_hit"), "spans", "items", "whole")


def contaminated():
    return F.size("items") >= MIN_ITEMS


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlaps(docs.select("doc_id", "text"), benchmark).select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that hold no whole window of WINDOW words of an item and
    share windows with fewer than MIN_ITEMS items."""
    return overlaps(docs, benchmark).where(~F.col("whole") & ~contaminated()).select("row.*")
