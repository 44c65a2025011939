"""Best-fit packing after Martello-Toth dominance reduction.

What can be packed depends on the pieces' lengths alone, so the plan is made from their histogram
(at most CAPACITY rows, whatever the corpus): sets that provably dominate all others are fixed first,
an exactly filling pair, a piece that nothing fits beside, a pair where no third fits. The
rest goes by best fit, longest first, whole runs of equal pieces at a time. Pieces then take their
places by their rank within their length.

Defined cases: a null or empty text is its closing id alone; a very long text is encoded whole (a slice of its own) and cut;
pieces that tie in length are dealt out in order of a hash, rows equal in all they hold are interchangeable; repeated rows
and repeated doc_ids are packed as rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quillspark.llm.batches import slices
from quillspark.llm.common import bucket_count, materialize, ranked
from quillspark.llm.tokens import encoder

CAPACITY, CLOSE, SLICE = 2048, 0, 12 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than capacity, if n is larger."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


PIECES = StructType(
    [StructField("doc_id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
)


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every row of docs."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, most=SLICE):
                rows = []
                ids = part.column(0).to_pylist()
                for doc, tokens in zip(ids, encoder(path or default_tokenizer()).encode(texts)):
                    tokens = np.append(tokens, CLOSE).astype("<u4")
                    rows += [(doc, k, a, n, zlib.crc32(tokens[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(tokens), capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=PIECES.names
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


Group = tuple[int, tuple[tuple[int, int], ...]]  # sequences, ((length, pieces of it in each), ...)


def reduced(left: dict[int, int], capacity: int) -> list[Group]:
    """Take from left (pieces by length) what dominance fixes."""
    groups: list[Group] = []

    def take(sequences: int, *content: tuple[int, int]) -> None:
        groups.append((sequences, content))
        for length, n in content:
            left[length] -= sequences * n
            if not left[length]:
                del left[length]

    lengths = sorted(left)
    for w in reversed(lengths):
        while w in left:
            if w == capacity:
                take(left[w], (w, 1))
                continue
            rest = capacity - w
            # A partner that fills the sequence dominates every set that fits beside w.
            if rest == w and left[w] >= 2:
                take(left[w] // 2, (w, 2))
                continue
            if rest != w and rest in left:
                take(min(left[w], left[rest]), (w, 1), (rest, 1))
                continue
            others = [x for x in sorted(left)[:3] for _ in range(min(2, left[x] - (x == w)))][:2]
            if not others or others[0] > rest:
                take(left[w], (w, 1))
                continue
            if len(others) == 1 or others[0] + others[1] > rest:  # one at most fits beside w: the longest dominates
                best = max(x for x in left if x <= rest and (x != w or left[w] > 1))
                if best == w:
                    pairs = left[w] // 2
                    take(pairs, (w, 2)) if pairs else take(1, (w, 1), (others[0], 1))
                else:
                    take(min(left[w], left[best]), (w, 1), (best, 1))
                continue
            break
    return groups


def best_fit(left: dict[int, int], capacity: int) -> list[Group]:
    """Best fit, longest first; equal pieces go in bulk, into the same places as one by one."""
    room: dict[int, list[list]] = {}
    free: list[int] = []

    def put(r: int, sequences: int, content: tuple) -> None:
        if r not in room:
            room[r] = []
            insort(free, r)
        room[r].append([sequences, content])

    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            at = bisect_left(free, w)
            if at == len(free):
                each = capacity // w
                if n >= each:
                    put(capacity - each * w, n // each, ((w, each),))
                if n % each:
                    put(capacity - n % each * w, 1, ((w, n % each),))
                break
            r = free[at]
            group, each = room[r][-1], r // w
            bins = min(group[0], n // each)
            if bins:
                put(r - each * w, bins, (*group[1], (w, each)))
                n -= bins * each
            else:
                bins = 1
                put(r - n * w, 1, (*group[1], (w, n)))
                n = 0
            group[0] -= bins
            if not group[0]:
                room[r].remove(group)
                if not room[r]:
                    del room[r]
                    free.remove(r)
    return [(n, content) for r in sorted(room) for n, content in room[r]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    left = {w: n for w, n in counts.items() if n}
    fixed = reduced(left, capacity)
    return fixed + best_fit(left, capacity)


def places(groups: list[Group]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces of this length in each, offset of the first)."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for n, content in groups:
        offset = 0
        for w, each in content:
            rows.setdefault(w, []).append((used.get(w, 0), sequence, each, offset))
            used[w] = used.get(w, 0) + n * each
            offset += w * each
        sequence += n
    return {w: np.array(x, np.int64) for w, x in rows.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    pieces = materialize(pieces_of(docs, path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = bucket_count(sum(counts.values()))
    mix = F.xxhash64("doc_id", "piece", "ids_crc32")
    order = [F.col("mix"), F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    rows = ranked(pieces.withColumn("mix", mix), ["length"], F.pmod("mix", F.lit(buckets)), order)
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))  # bounded by capacity, not by the corpus
    schema = StructType([*PIECES.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches):
        for b in batches:
            lengths, ranks = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            by = np.argsort(lengths, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(lengths[by])) + 1):
                if len(own):
                    w = int(lengths[own[0]])
                    at = shared.value[w]
                    k = at[np.searchsorted(at[:, 0], ranks[own], side="right") - 1]
                    j = ranks[own] - k[:, 0]
                    sequence[own], offset[own] = k[:, 1] + j // k[:, 2], k[:, 3] + j % k[:, 2] * w
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

    return rows.select(*PIECES.names, F.col("rank_in_group").cast("long")).mapInArrow(run, schema)
