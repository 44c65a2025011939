"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its 32 segments of two bits. The Manhattan distance
of two such vectors is a lower bound of the Hamming distance, so vectors further apart than the
limit can't be linked. Eight groups of four segments span the grid: vectors within a distance of 4
agree in at least four groups, so any four of the eight make a cell (70 cells per fingerprint) and
linked fingerprints meet in one of them. Within a cell the lower bound comes first, then the exact
distance; members are joined to the first of their class instead of in all pairs, and a
cell of over CELL members is dealt out by a hash as pairs of blocks. Classes grow together by the
large-star and small-star steps over distributed edges, until nothing changes; nodes with over 1 in
HOT_SHARE of all edges (so few that they can be broadcast) never meet their edges in one task.

Only distinct fingerprints enter the search, so exact copies cost nothing.

Defined cases: a null, empty or wordless text has fingerprint zero and is linked like any other; a very long text is
hashed whole, some shingles at a time; a bit that half the shingles set (a tie) is 0; repeated rows and repeated
doc_ids are rows of their own with the same class, and of those that tie for the smallest doc_id one_of_each keeps
one; a null doc_id gets a class but never names one while its class has another; an empty table gives
an empty result; extra columns, whatever their names, are carried in a struct and left alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.llm.batches import append
from quillspark.llm.common import HOT_SHARE, carried, looked_up, materialize, release

SHINGLE, SEED, DISTANCE, GROUPS, CELL = 4, 42, 4, 8, 2048
BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        part = hashes[at : at + BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, out: str = "_fingerprint") -> DataFrame:
    """docs with the signed 64-bit fingerprint of its column text."""
    return append(docs, [StructField(out, LongType())], lambda texts: [pa.array([fingerprint(x) for x in texts], pa.int64())])


def counts_of_pairs(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments of two bits, each in unary in its two bits: 00, 01 or 11."""
    low = np.uint64(0x5555555555555555)
    half = x >> np.uint64(1)
    return ((x | half) & low) | ((x & half & low) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two vectors of counts in unary."""
    return np.bitwise_count(a ^ b)


def linked(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the first member of each class to its others; linked are members within DISTANCE."""
    rest = np.unique(cell).view(np.uint64)
    counts, roots, ends = counts_of_pairs(rest), [], []
    while len(rest) > 1:
        root = rest[0]
        front = [(root, counts[0])]
        rest, counts = rest[1:], counts[1:]
        while front and len(rest):
            one, own = front.pop()
            near = np.flatnonzero(manhattan(counts, own) <= DISTANCE)  # the lower bound, then the distance itself
            near = near[np.bitwise_count(rest[near] ^ one) <= DISTANCE]
            if len(near):
                reached = rest[near]
                front.extend(zip(reached, counts[near]))
                ends.append(reached)
                roots.append(np.full(len(reached), root, np.uint64))
                left = np.ones(len(rest), bool)
                left[near] = False
                rest, counts = rest[left], counts[left]
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(roots).view(np.int64), np.concatenate(ends).view(np.int64)


def cell_edges(batches):
    """Rows (cell, i, j, fp), sorted by the first three: edges within each run of equal (cell, i, j)."""
    held: list[np.ndarray] | None = None

    def edges(table: list[np.ndarray]):
        keys, fps = table[:3], table[3]
        change = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
        starts, ends = np.concatenate(([0], change)), np.concatenate((change, [len(fps)]))
        size = ends - starts
        two = starts[size == 2]  # most cells: both steps at once
        a, b = fps[two].view(np.uint64), fps[two + 1].view(np.uint64)
        near = manhattan(counts_of_pairs(a), counts_of_pairs(b)) <= DISTANCE
        near[near] = np.bitwise_count(a[near] ^ b[near]) <= DISTANCE
        out = [(np.minimum(fps[two], fps[two + 1])[near], np.maximum(fps[two], fps[two + 1])[near])]
        out += [linked(fps[s:e]) for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist())]
        return [np.concatenate(x) for x in zip(*out)]

    def batch(ab):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ab], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1]))
        cut = last[-1] + 1 if len(last) else 0  # the last run may go on
        if cut:
            yield batch(edges([x[:cut] for x in held]))
            held = [x[cut:] for x in held]
    if held is not None:
        yield batch(edges(held))


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct values of the column fp as their links do."""
    unary = F.expr("((fp | shiftrightunsigned(fp, 1)) & 6148914691236517205L) | shiftleft(fp & shiftrightunsigned(fp, 1) & 6148914691236517205L, 1)")
    masks = [sum(0xFF << (8 * g) for g in some) for some in combinations(range(GROUPS), GROUPS - DISTANCE)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = F.explode(F.transform(F.lit(masks), lambda m: F.xxhash64(F.col("counts").bitwiseAND(m), m))).alias("cell")
    rows = fingerprints.select("fp", unary.alias("counts")).select("fp", cells)
    large = materialize(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL), "cells")
    ordinary, none = rows, F.lit(0)
    some = large.agg(F.max("n")).first()[0]
    if some:
        ordinary = rows.join(large, "cell", "left_anti")
    by = Window.partitionBy("cell")  # of CELL rows at most
    rows_of = ordinary.withColumn("n", F.count(F.lit(1)).over(by)).where("n > 1").select("cell", none.alias("i"), none.alias("j"), "fp")
    if some:
        blocks = F.expr(f"cast(ceil(n / {CELL}) AS int)")
        split = rows.join(large, "cell").select("cell", "fp", blocks.alias("m")).withColumn("b", F.pmod(F.xxhash64("fp", F.lit(17)), F.col("m")).cast("int"))
        pairs = F.explode(F.expr("transform(sequence(0, m - 1), x -> struct(least(x, b) AS i, greatest(x, b) AS j))"))
        rows_of = rows_of.unionByName(split.select("cell", "fp", pairs.alias("p")).select("cell", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "fp"))
    rows_of = rows_of.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    schema = StructType([StructField("u", LongType()), StructField("v", LongType())])
    return rows_of.mapInArrow(cell_edges, schema).where("u != v").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it is connected with) for every node of edges (u, v).

    Every step of a round is written before the next one, so that none is planned or run more than once: a
    round that is one job asks the driver for some fifteen stages at a time."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    spark, state = edges.sparkSession, None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = edges.union(edges.select("v", "u"))
        nodes = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "nodes")
        # Nodes with very many edges, fewer than 2 * HOT_SHARE of them, meet their least neighbour by a broadcast.
        hot = nodes.where(F.col("n") * HOT_SHARE > 2 * now[0]).select("u", "m").collect()
        known = spark.createDataFrame(hot, "u bigint, m bigint") if hot else None
        is_hot = F.col("u").isin([r.u for r in hot])

        def met(rows, table, of_hot, known=known, is_hot=is_hot):
            if known is None:
                return rows.join(table, "u")
            return rows.where(~is_hot).join(table, "u").unionByName(rows.where(is_hot).join(F.broadcast(of_hot), "u"))

        large = materialize(met(both, nodes.select("u", "m"), known).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "larger")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = met(large, least, least.where(is_hot)).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        before, edges = edges, materialize(small.where("u != v").distinct(), "edges", drop_shuffles=True)
        for made in (before, nodes, large, least):
            release(made)


def near_classes(prints: DataFrame) -> DataFrame:
    """fp, component_id, root, n (rows with this fp) for the distinct fp of prints(doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "prints")
    roots = classes(links(distinct))
    own = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "members")
    least = own.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return looked_up(own, least, "root").select("fp", "component_id", "root", F.col("copies").alias("n"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs."""
    prints = materialize(with_fingerprints(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "fingerprints")
    found = materialize(near_classes(prints), "classes")
    return looked_up(prints, found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, but of each class of near-duplicates only the one with
    the smallest doc_id (of several such rows, one)."""
    kept = with_fingerprints(carried(docs, "doc_id", "text"), "fp").select("row", "doc_id", "fp", F.monotonically_increasing_id().alias("at"))
    kept = materialize(kept, "rows")  # from here on a row's number is fixed
    rows = kept.select("doc_id", "fp", "at")
    found = materialize(near_classes(rows), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "at")
    chosen = looked_up(rows, found.select("fp", "root", "n"), "fp").groupBy("root").agg(F.min(order).alias("least")).select("least.at")
    return kept.join(chosen, "at", "left_semi").select("row.*")
