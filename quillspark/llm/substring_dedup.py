"""Repeated passages by prefix-free parsing, cut at the depth that matters.

Rolling-hash triggers cut each text into phrases: the trigger of a 100-byte string is its 32-byte
substring of least hash, and a phrase is a run of such strings with one trigger. Equal strings have
equal triggers at equal offsets, so a repeated string is found among the phrases of its trigger.

  parse       every phrase's occurrence: (trigger, phrase) hashes, document, place
  dictionary  the first occurrence of every distinct phrase; later ones repeat it altogether
  suffixes    of dictionary phrases with one trigger, sorted by their first 100 bytes: among equal
              ones, all but the first in corpus order repeat

Suffix order beyond 100 bytes can't change what repeats, and suffixes with different triggers can't
be equal so far; so the suffix array is made per trigger, and no task needs the whole order.

Equal phrases of one slice of text are collapsed where they are read (by 128 bits: trigger and phrase hashes). A trigger
with over HOT distinct phrases in a slice, or over HOT_ROWS rows from all slices, such as the edge of a passage
that a third of the documents share, is not grouped: the strings of its phrases are dealt out by their own digests.

Strings are judged on the input; matches never cross documents. Defined cases: a null or empty
text has no bytes (the digest of the empty string); texts under 100 bytes are kept whole; very long texts are hashed in overlapping chunks; rows with
the same doc_id, or none, are documents of their own, in an order fixed by their text's digest (equal rows are
interchangeable); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.llm.batches import slices
from quillspark.llm.common import materialize

LENGTH, GRAM, HOT, HOT_ROWS = 100, 32, 4, 64
SPAN = LENGTH - GRAM + 1  # grams of a string
CHUNK = 1 << 17  # bytes hashed at a time, so that all arrays stay in the cache
U = np.uint64
BASE, ODD, ODD2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BYTES = np.random.default_rng(100).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
PLACE = U((1 << 20) - 1)
NORMAL, KNOWN, SPREAD, SIGN = 0, 1, 2, 3


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * ODD
    x = (x ^ (x >> U(27))) * ODD2
    return x ^ (x >> U(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the GRAM bytes from every place on."""
    h, size = BYTES[data], 1
    while size < GRAM:
        h = h[:-size] * U(pow(int(BASE), size, 1 << 64)) + h[size:]
        size *= 2
    return h


def string_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the LENGTH bytes from at on; h: gram hashes."""
    out = scrambled(h[at])
    for k in (GRAM, 2 * GRAM, LENGTH - GRAM):
        out = scrambled(out * BASE + h[at + k])
    return out


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """trigger, phrase, first string, strings, trigger's offset from it, of all phrases of the documents
    that lie in data from starts to ends."""
    empty = np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return empty, empty, *(np.empty(0, np.int64),) * 3
    h = gram_hashes(data)
    low = (scrambled(h) & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    inside = np.zeros(len(low) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    low[np.cumsum(inside[:-1]) == 0] = ~U(0)
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(low)]))
    real = low[first] != ~U(0)
    first, last = first[real], last[real]
    trigger = (low[first] & PLACE).astype(np.int64)
    n, offset = last - first, trigger - first
    phrase = scrambled(string_hash(h, first) * BASE + string_hash(h, last - 1)) * BASE + (n * 256 + offset).astype(np.uint64)
    return scrambled(h[trigger] ^ ODD), scrambled(phrase), first, n, offset


def parsed(orders: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """p, g, ord, x of the phrases of a slice: p deals the rows out, g tells phrases of a trigger apart,
    x holds the first string's place, the strings, the trigger's offset and the kind of row."""
    by = np.argsort(orders, kind="stable").tolist()
    out, buffer, starts, whose, places, size = [], [], [], [], [], 0

    def flush() -> None:
        nonlocal size
        if buffer:
            s = np.array(starts)
            e = s + np.array([len(x) for x in buffer])
            t, g, first, n, offset = phrases(np.frombuffer(b"".join(buffer), np.uint8), s, e)
            doc = np.searchsorted(s, first, side="right") - 1
            place = first - s[doc] + np.array(places)[doc]
            out.append((t, g, orders[np.array(whose)[doc]], (place << 16) | (n << 9) | (offset << 2)))
        buffer.clear(), starts.clear(), whose.clear(), places.clear()
        size = 0

    for i in by:
        x = texts[i]
        if len(x) < LENGTH:
            continue
        for at in range(0, len(x) - LENGTH + 1, CHUNK):
            part = x[at : at + CHUNK + LENGTH - 1]
            if size + len(part) > 2 * CHUNK:
                flush()
            starts.append(size)
            buffer.append(part)
            whose.append(i)
            places.append(at)
            size += len(part)
    flush()
    if not out:
        return (np.empty(0, np.int64),) * 4
    t, g, order, x = (np.concatenate(c) for c in zip(*out))
    sort = np.argsort(t ^ (g * BASE), kind="stable")  # rows are in corpus order: the first of equal phrases is the first there
    again = np.zeros(len(t), bool)
    again[sort[1:]] = (t[sort[1:]] == t[sort[:-1]]) & (g[sort[1:]] == g[sort[:-1]])
    once = np.flatnonzero(~again)
    names, which, n = np.unique(t[once], return_inverse=True, return_counts=True)
    hot = once[n[which] > HOT]
    p, kind = t.copy(), np.zeros(len(t), np.int64)
    p[again], g[again] = order[again].astype(np.uint64), 0  # dealt out by document, and easy to compress
    kind[again] = KNOWN
    p[hot] = scrambled(t[hot] ^ scrambled(g[hot]))
    kind[hot] = SPREAD
    signs = names[n > HOT]
    zero = np.zeros(len(signs), np.int64)
    return (
        np.concatenate((p, signs)).view(np.int64),
        np.concatenate((g, np.zeros(len(signs), np.uint64))).view(np.int64),
        np.concatenate((order, zero)),
        np.concatenate((x | kind, zero | SIGN)),
    )


def longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def parse(docs: DataFrame) -> DataFrame:
    """Rows (p, g, ord, x) of docs(ord, text); see parsed."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parsed(part.column(0).to_numpy(zero_copy_only=False), texts)], names=["p", "g", "ord", "x"])

    return docs.select("ord", "text").mapInArrow(run, longs("p", "g", "ord", "x"))


def judged(rows: DataFrame) -> DataFrame:
    """p, ord, x, status of phrases with something repeated: known (all of it), edge (first of its
    kind, beside others with its trigger), spread (the same, of a hot trigger)."""
    kind = F.col("x").bitwiseAND(3)
    by = Window.partitionBy("p")
    normal = F.when(kind == NORMAL, F.col("g"))
    rows = rows.select(
        "p", "ord", "x",
        (F.lag("g").over(by.orderBy("g", "ord", "x")) == F.col("g")).alias("same"),
        F.lag(kind).over(by.orderBy("g", "ord", "x")).alias("before"),
        (F.min(normal).over(by) < F.max(normal).over(by)).alias("several"),
        ((F.max(kind).over(by) == SIGN) | (F.count(normal).over(by) > HOT_ROWS) & (F.min(normal).over(by) < F.max(normal).over(by))).alias("sign"),
    )
    known = (kind == KNOWN) | (F.col("same") & (F.col("before") == kind))
    status = F.when(kind == SIGN, None).when(F.coalesce(known, F.lit(False)), "known").when((kind == SPREAD) | F.col("sign"), "spread").when(F.col("several"), "edge")
    return rows.select("p", "ord", "x", status.alias("status")).where("status IS NOT NULL")


CONTEXT = longs("p", "ord", "x").add("bytes", "binary").add("spread", "boolean")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """p, ord, x, the bytes and whether to spread of the phrases in wanted(p, ord, x, status)."""
    lists = wanted.groupBy("ord").agg(F.collect_list(F.struct("p", "x", (F.col("status") == "spread").alias("spread"))).alias("wanted"))
    rows = docs.join(lists, "ord").select("ord", "text", "wanted")

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                p, order, xs, found, spread = [], [], [], [], []
                lists = part.column(2)
                for k, text in enumerate(texts):
                    o = part.column(0)[k].as_py()
                    for w in lists[k].values.to_pylist():
                        at, n = w["x"] >> 16, (w["x"] >> 9) & 127
                        p.append(w["p"])
                        order.append(o)
                        xs.append(w["x"])
                        found.append(text[at : at + n - 1 + LENGTH])
                        spread.append(w["spread"])
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(order, pa.int64()), pa.array(xs, pa.int64()), pa.array(found, pa.binary()), pa.array(spread, pa.bool_())], names=CONTEXT.names)

    return rows.mapInArrow(run, CONTEXT)


def strings(x: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of some phrases: which phrase, which of its strings, and their bytes."""
    n = (x >> 9) & 127
    which = np.repeat(np.arange(len(x)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    size = np.array([len(b) for b in found])
    begins = np.cumsum(size) - size
    data = np.frombuffer(b"".join(found), np.uint8)
    return which, nth, np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begins[which] + nth]


RANGE = StructType([StructField("ord", LongType()), StructField("start", LongType()), StructField("end", LongType())])
STRINGS_AT_ONCE = 200_000


def later(p: np.ndarray, order: np.ndarray, x: np.ndarray, found: list[bytes]) -> pa.RecordBatch:
    """The suffix array of some triggers' dictionary phrases to depth LENGTH: ranges of strings that
    aren't the first of their kind in corpus order."""
    by = np.lexsort((x, order, p))
    p, order, x, found = p[by], order[by], x[by], [found[i] for i in by.tolist()]
    which, nth, data = strings(x, found)
    names = np.empty((len(which), 5 + LENGTH), np.uint8)  # trigger, offset from it, bytes
    trigger = np.cumsum(np.concatenate(([0], p[1:] != p[:-1])))
    names[:, :4] = trigger[which].astype(">u4").view(np.uint8).reshape(-1, 4)
    names[:, 4] = ((x >> 2) & 127)[which] + 128 - nth
    names[:, 5:] = data
    names = names.view(f"S{5 + LENGTH}")[:, 0]
    array = np.argsort(names, kind="stable")
    again = np.zeros(len(names), bool)
    again[array[1:]] = names[array[1:]] == names[array[:-1]]
    at = np.flatnonzero(again)
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (which[at[1:]] != which[at[:-1]])
    first = at[opens]
    last = at[np.append(np.flatnonzero(opens)[1:] - 1, len(at) - 1)] if len(at) else at
    place = x[which[first]] >> 16
    return pa.RecordBatch.from_arrays([pa.array(order[which[first]]), pa.array(place + nth[first]), pa.array(place + nth[last] + LENGTH)], names=RANGE.names)


def edge_ranges(rows: DataFrame) -> DataFrame:
    """Repeated ranges (ord, start, end) of the phrases of contexts, trigger by trigger."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns[:3]] + [b.column(3).to_pylist()]
            held = now if held is None else [np.concatenate((a, c)) for a, c in zip(held[:3], now[:3])] + [held[3] + now[3]]
            cuts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1  # the last trigger may go on
            done = 0
            total = np.cumsum((held[2] >> 9) & 127)
            while len(cuts) and done < cuts[-1]:
                until = cuts[np.searchsorted(total[cuts - 1], (total[done - 1] if done else 0) + STRINGS_AT_ONCE).clip(max=len(cuts) - 1)]
                until = until if until > done else cuts[np.searchsorted(cuts, done, side="right")]
                yield later(*(c[done:until] for c in held))
                done = int(until)
            held = [c[done:] for c in held]
        if held is not None and len(held[3]):
            yield later(*held)

    return rows.repartition("p").sortWithinPartitions("p").mapInArrow(run, RANGE)


def spread_ranges(rows: DataFrame) -> DataFrame:
    """The same for hot triggers: strings meet by a 128-bit digest of their own."""

    def run(batches):
        for b in batches:
            order, x = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            found = b.column(3).to_pylist()
            for at in range(0, len(found), 4096):
                o, y = order[at : at + 4096], x[at : at + 4096]
                which, nth, data = strings(y, found[at : at + 4096])
                digests = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in data), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(o[which]), pa.array((y >> 16)[which] + nth)], names=["a", "b", "ord", "start"])

    each = rows.mapInArrow(run, longs("a", "b", "ord", "start"))
    each = materialize(each, "strings", drop_shuffles=True)
    first = each.groupBy("a", "b").agg(F.min(F.struct("ord", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = each.join(first, ["a", "b"]).where((F.col("ord") != F.col("first.ord")) | (F.col("start") != F.col("first.start")))
    return later.select("ord", "start", (F.col("start") + LENGTH).alias("end"))


RESULT = longs("doc_id", "n_bytes", "n_removed", "n_spans").add("kept_sha256", "string").add("kept", "binary")


def ordered(docs: DataFrame) -> DataFrame:
    """ord, doc_id, text: ord is unique and rises with doc_id."""
    docs = docs.select("doc_id", "text")
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").cast("long").alias("ord"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull()]
    return materialize(docs.orderBy(*order).select(F.monotonically_increasing_id().alias("ord"), "doc_id", "text"), "ordered")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Ranges (ord, start, end) of bytes to remove from docs(ord, text); they may overlap."""
    found = materialize(judged(parse(docs)), "phrases", drop_shuffles=True)
    place = F.shiftright("x", 16)
    ranges = found.where("status = 'known'").select("ord", place.alias("start"), (place + F.shiftright("x", 9).bitwiseAND(127) - 1 + LENGTH).alias("end"))
    rows = materialize(contexts(docs, found.where("status != 'known'")), "contexts", drop_shuffles=True)
    return ranges.union(edge_ranges(rows.where("NOT spread"))).union(spread_ranges(rows.where("spread")))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs, and kept (the bytes
    that remain) if with_text."""
    docs = ordered(docs)
    lists = repeated_ranges(docs).groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    rows = docs.join(lists, "ord", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ranges")

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                out = []
                for k, text in enumerate(texts):
                    own = part.column(2)[k]
                    kept, removed, spans, at = [], 0, 0, 0
                    if own.is_valid:
                        table = own.values
                        start, end = (table.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                        by = np.argsort(start, kind="stable")
                        start, reach = start[by], np.maximum.accumulate(end[by])
                        opens = np.concatenate(([True], start[1:] > reach[:-1]))
                        closes = np.concatenate((np.flatnonzero(opens)[1:] - 1, [len(start) - 1]))
                        for s, e in zip(start[opens].tolist(), reach[closes].tolist()):
                            kept.append(text[at:s])
                            removed, spans, at = removed + e - s, spans + 1, e
                    kept.append(text[at:])
                    left = b"".join(kept)
                    out.append((len(text), removed, spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=RESULT.names)

    out = rows.mapInArrow(run, RESULT)
    return out if with_text else out.drop("kept")
