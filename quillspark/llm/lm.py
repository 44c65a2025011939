"""LM scoring: a causal self-attention model over subword ids, beside counts of words.

Text is lower-cased (A-Z) and cut into words at ASCII white space; every text ends with an end
token. The model's probability of a word mixes two estimates,

    share * counted(word)  +  (1 - share) * attended(its subword ids | the ids before them)

counted: (c + 0.1) / (N + 0.1 (V + 1)) over all training words; words that training lacks are one
outcome (c = 0), as in the base score. attended: the attention model of attention.py. Its embedding rows, kinds and experts
count all training texts; its weights are trained on all windows of all training texts, once, in parts (drawn by a
hash of the row, about PART_BYTES of text each) from one start, and averaged; the share maximises the likelihood of all
training texts, each word's own occurrence left out of its count.

Texts become ids once (as bytes, two an id), in a table dealt out by part and sorted, so that neither the parts nor the
order in them depend on how the input is laid out. All later steps read that table. A word's first id, and no other, is of a
token that starts with a space; words are known by a 64-bit digest of their ids, which spell them. Those that aren't among the most frequent HEAD (broadcast, 16 bytes each) meet their counts
in a join, so no task needs the whole vocabulary. Training texts are those whose
crc32(doc_id as text) mod 10 isn't 0; a null doc_id counts as the text "null".

Defined cases: a null or empty text is its end token; a very long text is a slice of its own, scored whole in overlapping
windows; rows with one doc_id, or none, are scored each on its own; words that tie in frequency at the end of the head all
stay out of it; no training texts leave uniform experts and no known words; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import attention
from quillspark.llm.attention import EXPERTS, OWN_ROWS, SHARED_ROWS
from quillspark.llm.batches import slices
from quillspark.llm.common import materialize, release
from quillspark.llm.tokens import encoder, gathered

HEAD, RATE = 1_000_000, 0.02
PART_BYTES, PARTS_A_TASK = 4 << 20, 4  # of text; an id has about two and a half bytes
COLUMNS = 128  # most frequent next ids by which kinds of tokens are told apart
SLICE = 6 << 20  # bytes of text
STEP = 1 << 20  # ids at a time
PSEUDO = 200.0
SHARES = [0.1, 0.25, 0.4, 0.5, 0.65, 0.8, 0.9]
ODD, ODD2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def id_type(path: str) -> np.dtype:
    return np.dtype(np.uint16 if encoder(path).end < 1 << 16 else np.uint32)


def ids_of(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts as ids end to end, each with its end token, and their lengths. The end is a word as well."""
    flat: list[bytes] = []
    sizes = []
    for x in texts:
        own = x.lower().split()
        flat += own
        sizes.append(len(own))
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if flat else np.empty(0, np.int64)
    ids, lengths = encoder(path).spaced(coded.dictionary.cast(pa.string()))
    stream, ends = gathered(ids.astype(id_type(path)), lengths, words)
    bounds = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
    after = np.concatenate(([0], ends))[bounds]
    out_lengths = np.diff(after) + 1
    stops = np.cumsum(out_lengths) - 1
    out = np.empty(len(stream) + len(texts), stream.dtype)
    here = np.ones(len(out), bool)
    here[stops] = False
    out[here], out[stops] = stream, encoder(path).end
    return out, out_lengths


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD
    x = (x ^ (x >> np.uint64(27))) * ODD2
    return x ^ (x >> np.uint64(31))


def word_starts(ids: np.ndarray, path: str) -> np.ndarray:
    return np.flatnonzero(encoder(path).opens[ids])


def word_keys(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A digest of each word, from its ids."""
    if not len(starts):
        return np.empty(0, np.int64)
    place = (np.arange(len(ids), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(starts, append=len(ids)))).astype(np.uint64)
    each = scrambled(ids + (place << np.uint64(20)) + np.uint64(1))
    return scrambled(np.add.reduceat(each, starts)).view(np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """ord (unique), doc_id, held_out, text."""
    docs = docs.select("doc_id", "text")
    repeated = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if repeated:
        docs = materialize(docs.withColumn("ord", F.monotonically_increasing_id()), "numbered")
    else:
        docs = docs.withColumn("ord", F.col("doc_id").cast("long"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select("ord", "doc_id", (F.crc32(F.encode(name, "UTF-8")) % 10 == 0).alias("held_out"), "text")


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """part, ord, doc_id, held_out, ids (as bytes) of every row; a part's rows lie side by side in one file, by ord."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", SLICE):
                ids, lengths = ids_of(texts, path)
                offsets = (np.concatenate(([0], np.cumsum(lengths))) * ids.itemsize).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], column], names=["ord", "doc_id", "held_out", "ids"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    schema = f"ord bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, ids binary"
    rows = docs.mapInArrow(run, schema).withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(parts)))
    rows = rows.repartition(-(-parts // PARTS_A_TASK), "part").sortWithinPartitions("part", "ord")
    return materialize(rows.select("part", "ord", "doc_id", "held_out", "ids"), "ids", drop_shuffles=True)


def flat_ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column of bytes, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // kind.itemsize, int(ends[0])), np.diff(ends).astype(np.int64) // kind.itemsize


def cut_batches(batches, place: int, kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of batches, with the ids (in column place) and their lengths, about STEP ids at a time; a longer text is one alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(flat_ids(batch.column(place), kind)[1])
        at = 0
        while at < len(total):
            until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, side="right")))
            part = batch.slice(at, until - at)
            yield part, *flat_ids(part.column(place), kind)
            at = until


def keyed(keys: np.ndarray, n: np.ndarray, of_ids: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n.astype(np.int64)), pa.array(np.full(len(keys), of_ids))], names=["key", "n", "of_ids"])


def all_counts(ids: DataFrame, path: str) -> DataFrame:
    """key, n, of_ids over all texts of ids: of ids, and of words by digest."""

    def run(batches):
        kind, seen = id_type(path), np.zeros(encoder(path).end + 1, np.int64)
        for _, own, _ in cut_batches(batches, 0, kind):
            seen += np.bincount(own, minlength=len(seen))
            yield keyed(*np.unique(word_keys(own, word_starts(own, path)), return_counts=True), False)
        some = np.flatnonzero(seen)
        yield keyed(some, seen[some], True)

    return ids.select("ids").mapInArrow(run, "key bigint, n bigint, of_ids boolean").groupBy("of_ids", "key").agg(F.sum("n").alias("n"))


def summed(ids: DataFrame, cells: int, counted, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts over all texts, where counted(before, ids) gives keys below cells."""

    def run(batches):
        table = np.zeros(cells, np.int64)
        for _, own, _ in cut_batches(batches, 0, id_type(path)):
            table += np.bincount(counted(before_of(own, path), own), minlength=cells)
        some = np.flatnonzero(table)
        for at in range(0, len(some), STEP):
            keys = some[at : at + STEP]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(table[keys])], names=["key", "n"])

    found = ids.select("ids").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # cells at most
    return found["key"].to_numpy(), found["n"].to_numpy()


def before_of(ids: np.ndarray, path: str) -> np.ndarray:
    """The id before each; a text starts after an end."""
    out = np.empty_like(ids)
    out[1:], out[:1] = ids[:-1], encoder(path).end
    return out


class Kinds:
    """What the model knows of ids: the embedding row and the kind of each."""

    def __init__(self, ids: DataFrame, counts: DataFrame, path: str, seed: int = 1):
        size = encoder(path).end + 1
        n = np.zeros(size)
        for r in counts.where("of_ids").collect():  # size at most
            n[r.key] = r.n
        order = np.argsort(-n, kind="stable")
        self.rows = (OWN_ROWS + np.arange(size) % SHARED_ROWS).astype(np.int32)
        self.rows[order[:OWN_ROWS]] = np.arange(min(OWN_ROWS, size))
        columns = [int(x) for x in order[:COLUMNS] if n[x]]
        table = np.zeros((size, COLUMNS), np.float32)
        if columns:
            at = np.full(size, -1, np.int32)
            at[columns] = np.arange(len(columns))

            def counted(before, own):
                k = at[own]
                there = np.flatnonzero(k >= 0)
                return before[there].astype(np.int32) * COLUMNS + k[there]

            keys, found = summed(ids, size * COLUMNS, counted, path)
            table.reshape(-1)[keys] = found
        self.kinds = clustered(table, n, seed).astype(np.int32)


def clustered(table: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """EXPERTS kinds of ids by what follows them: spherical k-means on square roots of shares."""
    total = table.sum(1)
    x = np.sqrt(table / np.maximum(total, 1)[:, None])
    seen = np.flatnonzero(total >= 3)
    kinds = np.zeros(len(table), np.int64)
    if len(seen) <= EXPERTS:
        kinds[seen] = np.arange(len(seen))
        return kinds
    rng = np.random.default_rng(seed)
    w = total[seen]
    centers = x[rng.choice(seen, EXPERTS, replace=False, p=w / w.sum())]
    for _ in range(12):
        near = np.argmax(x[seen] @ centers.T, 1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x[seen] * w[:, None])
        size = np.linalg.norm(sums, axis=1)
        centers[size > 0] = sums[size > 0] / size[size > 0, None]
    kinds[:] = np.argmax(x @ centers.T, 1)
    return kinds


def expert_counts(ids: DataFrame, kinds: np.ndarray, path: str) -> np.ndarray:
    """How often each id (column) follows ids of each kind (row) in all training texts."""
    size = len(kinds)
    experts = np.zeros((EXPERTS, size), np.float32)
    keys, n = summed(ids, EXPERTS * size, lambda before, own: kinds[before] * np.int32(size) + own, path)
    experts.reshape(-1)[keys] = n
    return experts


def packed(p: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def by_part(batches, kind: np.dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each part with the ids and the lengths of its texts, from batches in which a part's rows lie side by side."""
    held, ids, lengths = None, [], []
    for batch in batches:
        parts = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            if ids and parts[a] != held:
                yield int(held), np.concatenate(ids), np.concatenate(lengths)
                ids, lengths = [], []
            held = parts[a]
            own, n = flat_ids(batch.column(1).slice(a, b - a), kind)
            ids.append(own)
            lengths.append(n)
    if ids:
        yield int(held), np.concatenate(ids), np.concatenate(lengths)


WEIGHTS = "part bigint, p binary, w double"


def fitted(ids: DataFrame, known: Kinds, experts: np.ndarray, path: str) -> dict[str, np.ndarray]:
    """Weights: every part of the training texts trains from the same start; the mean by length, in order of parts."""
    first = attention.initial()
    shared = ids.sparkSession.sparkContext.broadcast((known.kinds, known.rows, experts))

    def run(batches):
        kinds, rows_of, experts = shared.value
        for part, own, lengths in by_part(batches, id_type(path)):
            before = before_of(own, path)
            q = attention.trained(first, rows_of[before], kinds[before], own, experts, lengths, RATE)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([packed(q)], pa.binary()), pa.array([float(len(own))])], names=["part", "p", "w"])

    got = materialize(ids.select("part", "ids").mapInArrow(run, WEIGHTS), "weights")
    while (n := got.count()) > 16:  # averaged in groups, so the driver gets a few
        groups = -(-n // 16)
        dealt = got.withColumn("part", F.pmod("part", F.lit(groups))).repartition(groups, "part").sortWithinPartitions("part", "w", "p")
        got = materialize(dealt.mapInArrow(means, WEIGHTS), "weights")
    found = [(r.w, unpacked(bytes(r.p))) for r in got.orderBy("part").collect()]
    total = sum(w for w, _ in found)
    return {k: sum(q[k] * np.float32(w / total) for w, q in found) for k in first} if found else first


def means(batches):
    """A row per part: the mean of its weights."""
    held, total, out = None, 0.0, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([packed({k: v / np.float32(total) for k, v in out.items()})], pa.binary()), pa.array([total])], names=["part", "p", "w"])

    for b in batches:
        for part, data, w in zip(*(b.column(i).to_pylist() for i in range(3))):
            if out is not None and part != held:
                yield row()
                total, out = 0.0, None
            q = unpacked(data)
            held, total = part, total + w
            out = {k: v * np.float32(w) + (0 if out is None else out[k]) for k, v in q.items()}
    if out is not None:
        yield row()


class Model:
    """What scoring needs on the executors, all of bounded size."""

    def __init__(self, known: Kinds, experts: np.ndarray, weights: dict[str, np.ndarray], head: tuple[np.ndarray, np.ndarray], n: int, v: int, path: str):
        self.rows, self.kinds, self.experts, self.weights, self.head = known.rows, known.kinds, experts, weights, head
        self.n, self.v, self.path = n, v, path

    def total(self) -> float:
        return self.n + 0.1 * (self.v + 1)

    def tokens(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the probability of every id."""
        before = before_of(ids, self.path)
        return attention.log10_probabilities(self.weights, (self.rows[before], self.kinds[before]), ids, self.experts, lengths)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of words by digest; 0 where the head lacks them."""
        have, n = self.head
        if not len(have):
            return np.zeros(len(keys), np.int64)
        distinct, which = np.unique(keys, return_inverse=True)  # in order: neighbours in the head, and each once
        at = np.minimum(np.searchsorted(have, distinct), len(have) - 1)
        return np.where(have[at] == distinct, n[at], 0)[which]


LOG10 = 1 / math.log(10)


def best_share(rows: DataFrame, total: float) -> int:
    """The number of the share under which all training texts are likeliest, one occurrence of each word left out."""
    counted = (F.col("c") - 0.9) / total
    rare = ~F.col("is_text") & ~F.col("held_out")
    likely = lambda s: F.when(rare, F.log10(s * counted + (1 - s) * F.pow(F.lit(10.0), "own")))
    sums = rows.agg(*[F.sum(F.when(F.col("is_text"), F.get("fit", F.lit(k))).otherwise(likely(s))).alias(f"s{k}") for k, s in enumerate(SHARES)]).first()
    found = [sums[f"s{k}"] or 0.0 for k in range(len(SHARES))]
    return int(np.argmax(found)) if any(found) else SHARES.index(0.5)


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    path = path or default_tokenizer()
    ids = tokenized(numbered(docs), path)
    training = ids.where("NOT held_out")
    counts = materialize(all_counts(training, path), "counts", drop_shuffles=True)
    known = Kinds(training, counts, path)
    experts = expert_counts(training, known.kinds, path)
    whole = experts.sum(0) + 0.01
    experts += PSEUDO * whole / whole.sum()
    experts = np.ascontiguousarray((experts / experts.sum(1, keepdims=True)).T)

    words = counts.where("NOT of_ids").select("key", "n")
    n, v = (x or 0 for x in words.agg(F.sum("n"), F.count(F.lit(1))).first())
    often = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(HEAD).collect()
    least, have = math.inf, 0
    for r in often:
        have += r.words
        if have > HEAD:
            break
        least = r.n
    head = words.where(F.col("n") >= least).toArrow() if least < math.inf else None
    keys, values = (head["key"].to_numpy(), head["n"].to_numpy()) if head else (np.empty(0, np.int64),) * 2
    order = np.argsort(keys)
    model = Model(known, experts, fitted(training, known, experts, path), (keys[order], values[order]), n, v, path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(ids, words.where(F.col("n") < least) if least < math.inf else words, shared)


def scored(ids: DataFrame, tail: DataFrame, shared) -> DataFrame:
    """A row per text with what its frequent words give under every share, and a row per other word, which meets its count."""
    total = shared.value.total()
    unknown = math.log10(0.1 / total)

    def run(batches):
        model = shared.value
        for part, own, lengths in cut_batches(batches, 3, id_type(model.path)):
            n_texts = len(lengths)
            starts = word_starts(own, model.path)
            keys = word_keys(own, starts)
            attended = np.add.reduceat(model.tokens(own, lengths), starts)
            c = model.counts(keys)
            doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
            often, rare = np.flatnonzero(c > 0), np.flatnonzero(c == 0)
            doc_often, c_often, p_often = doc[often], c[often], 10.0 ** attended[often]
            per_text = lambda x: np.bincount(doc_often, x, minlength=n_texts)
            held_out = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            mixed = lambda s, n: per_text(np.log(s * (n + 0.1) / total + (1 - s) * p_often)) * LOG10
            joint = np.stack([mixed(s, c_often) for s in SHARES], 1)
            fit = np.stack([mixed(s, np.maximum(c_often - 1, 0)) for s in SHARES], 1) * ~held_out[:, None]  # a training word is counted itself
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate((np.arange(n_texts + 1) * len(SHARES), np.full(len(rare), x.size))).astype(np.int32)), pa.array(x.reshape(-1), pa.float64()))
            none = np.zeros(len(rare))
            order = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((order, order[doc[rare]]))),
                    pa.array(np.concatenate((order, keys[rare]))),  # texts are dealt out as words are
                    pa.array(np.concatenate((np.ones(n_texts, bool), np.zeros(len(rare), bool)))),
                    pa.concat_arrays([part.column(1), pa.nulls(len(rare), part.column(1).type)]),
                    pa.array(np.concatenate((held_out, held_out[doc[rare]]))),
                    pa.array(np.concatenate((np.bincount(doc, minlength=n_texts), none.astype(np.int64)))),
                    pa.array(np.concatenate((np.bincount(doc_often, minlength=n_texts), none.astype(np.int64)))),
                    pa.array(np.concatenate((per_text(np.log((c_often + 0.1) / total) * LOG10), none))),
                    pa.array(np.concatenate((np.zeros(n_texts), attended[rare]))),
                    lists(joint),
                    lists(fit),
                ],
                names=["ord", "key", "is_text", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", "joint", "fit"],
            )

    doc_id = ids.schema["doc_id"].dataType.simpleString()
    rows = ids.select("ord", "doc_id", "held_out", "ids").mapInArrow(run, f"ord bigint, key bigint, is_text boolean, doc_id {doc_id}, held_out boolean, n_tokens bigint, n_known bigint, base double, own double, joint array<double>, fit array<double>")
    rows = rows.join(tail.select("key", F.col("n").alias("c")), "key", "left").withColumn("c", F.when(~F.col("is_text"), F.coalesce("c", F.lit(0))))
    rows = materialize(rows, "rows", drop_shuffles=True)
    release(ids)
    chosen = best_share(rows, total)
    share = SHARES[chosen]
    counted = (F.col("c") + 0.1) / total
    base = F.when(F.col("is_text"), F.col("base")).when(F.col("c") > 0, F.log10(counted)).otherwise(unknown)
    joint = F.when(F.col("is_text"), F.get("joint", F.lit(chosen))).otherwise(F.log10(share * counted + (1 - share) * F.pow(F.lit(10.0), "own")))
    known = F.when(F.col("is_text"), F.col("n_known")).otherwise((F.col("c") > 0).cast("long"))
    out = rows.select("ord", "doc_id", "held_out", "n_tokens", known.alias("n_known"), base.alias("base"), joint.alias("joint"))
    return out.groupBy("ord").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("joint").alias("score")
    ).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(shared.value.n)).cast("long").alias("train_tokens"), "base_score", "score")
