"""Quality rules: a decision list learned by sequential covering, applied as one conditional expression.

Every text gets a few counts (array functions, no Python). Over labelled texts the counts become
shares, cut at quantiles; rules, conjunctions of at most MAX_TERMS thresholds, are grown by information
gain on two thirds of the labelled rows and pruned on the other third, one after the other, each
from what the ones before it leave, until no rule is precise enough. The list becomes an ordered CASE WHEN.

All learning steps are aggregates over a table of (bins, counts); the driver sees a row per
feature and bin. Labelled rows are not sampled. Quantiles are read from counts of the shares in steps of 1 / GRAIN,
so they don't depend on how rows are laid out.

Defined cases: a null or empty text has no words and fails the base rule; a very long text is counted whole; labels with a null
quality, or of documents that aren't there, are ignored; several labels of one document all count;
no labels, or labels of one kind, give an empty list (then only the base rule rejects); of thresholds that tie in gain the first
by feature, value and direction is taken; repeated rows are judged alike; an empty table gives an empty result;
extra columns, whatever their names, are carried in a struct and left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER, carried, materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares that rules may use, from the counts.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "echo_share": "n_echoes / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}
#: Quantiles; terms of a rule; a rule's least precision, and least number of bad texts, on what is left of the labelled rows.
BINS, MAX_TERMS, MIN_PRECISION, MIN_COVER = 24, 3, 0.97, 4
GRAIN, LARGEST = 10_000, 1_000  # steps of a share; quantiles above LARGEST (of a mean word's length) are told apart no more


@dataclass(frozen=True)
class Term:
    """A threshold: feature > value, or feature <= value. cut: the threshold's place among the feature's."""

    feature: str
    above: bool
    value: float
    cut: int

    def column(self) -> Column:
        left = F.expr(FEATURES[self.feature])
        return left > F.lit(self.value) if self.above else left <= F.lit(self.value)

    def on_bins(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:.6g}"


def less(text: str, chars: str) -> Column:
    """How many characters of a text are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_counts(df: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of df(text, ...) and the counts of each text, words being runs of anything but ASCII white space.

    No column to keep may be named as one made here."""
    body = F.coalesce(F.col("text"), F.lit(""))
    df = df.select(*keep, body.alias("body"), F.array_remove(F.split(body, SPACE), "").alias("words"))
    # What is counted by character is rare, so most of the rest is taken out of the text first.
    some = F.translate("body", LOWER + " .,;:'-\n", "")
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*keep, some.alias("some"), lines.alias("lines"), F.length(F.array_join("words", "")).alias("solid"), F.transform("words", lambda w: F.xxhash64(w)).alias("ids"))
    numbers = [
        F.size("ids").cast("long").alias("n_words"),
        F.col("solid").cast("long").alias("word_chars"),
        less("some", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        less("some", UPPER).cast("long").alias("n_upper"),
        less("some", "!?").cast("long").alias("n_marks"),
        less("some", "0123456789").cast("long").alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("cast(size(array_remove(zip_with(ids, slice(ids, 2, size(ids)), (a, b) -> coalesce(a = b, false)), false)) AS bigint)").alias("n_echoes"),
        F.size(F.array_distinct("ids")).cast("long").alias("n_distinct"),
    ]
    shifted = ", ".join(f"slice(ids, {k + 1}, size(ids) - {WINDOW - 1})" for k in range(WINDOW))
    windows = F.expr(f"CASE WHEN size(ids) >= {WINDOW} THEN transform(arrays_zip({shifted}), x -> xxhash64(x)) ELSE cast(array() AS array<bigint>) END")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper", "n_marks", "n_digits", "n_lines", "n_echoes", "n_distinct"]
    df = df.select(*keep, *numbers, windows.alias("windows"))
    # Only a text with a repeated window has its windows sorted, with their places.
    placed = F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (w, i) -> struct(w, i))) ELSE cast(array() AS array<struct<w:bigint,i:int>>) END")
    df = df.select(*keep, *names, placed.alias("placed"))
    again = F.expr("sort_array(transform(filter(placed, (x, k) -> get(placed, k - 1).w = x.w OR get(placed, k + 1).w = x.w), x -> x.i))")
    df = df.select(*keep, *names, again.alias("again"))
    covered = F.expr(f"aggregate(again, struct(0L AS n, 0 AS until), (a, i) -> struct(a.n + {WINDOW} - greatest(a.until - i, 0) AS n, i + {WINDOW} AS until)).n")
    return df.select(*keep, *names, covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn_rules(counts: DataFrame, labels: DataFrame) -> list[list[Term]]:
    """An ordered list of rules; a text that fits any is rejected.

    counts: doc_id and the counts of text_counts as columns. labels: doc_id, quality (0: bad)."""
    labelled = labels.where("quality IN (0, 1)").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rows = counts.where(~base_failed()).join(labelled, "doc_id").select(
        "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held"), *[F.expr(e).alias(f) for f, e in FEATURES.items()]
    )
    # Counts by feature and step: a table of at most GRAIN rows a share, so the driver sees a bounded one.
    grain = {f: F.floor(F.least(F.col(f), F.lit(float(LARGEST))) * (GRAIN if f != "mean_word" else GRAIN // LARGEST)).cast("long") for f in FEATURES}
    steps = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), g.alias("step")) for f, g in grain.items()])).alias("at")
    found = rows.select("bad", steps).groupBy("at.feature", "at.step").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    n_bad, n_good = (sum(r[k] for r in found if r.feature == "mean_word") for k in ("bad", "good"))
    if not n_bad or not n_good:
        return []
    cuts = {f: halfway([(r.step, r.bad + r.good) for r in found if r.feature == f], GRAIN if f != "mean_word" else GRAIN // LARGEST) for f in FEATURES}
    bins = [sum((F.when(F.col(f) > v, 1).otherwise(0) for v in c), F.lit(0)).alias(f) for f, c in cuts.items()]
    kinds = {"grow_bad": (False, True), "grow_good": (False, False), "held_bad": (True, True), "held_good": (True, False)}
    cells = (
        rows.select(*bins, "bad", "held")
        .groupBy(*FEATURES)
        .agg(*[F.count_if((F.col("held") == h) & (F.col("bad") == b)).alias(k) for k, (h, b) in kinds.items()])
    )
    cells = materialize(cells, "cells")
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in FEATURES])).alias("at")
    rules: list[list[Term]] = []
    left = cells
    while True:  # every rule takes MIN_COVER bad texts at least
        rule = grow(left, cuts, long)
        rule = prune(left, rule) if rule else []
        if not rule:
            break
        rules.append(rule)
        left = left.where(~conjunction(rule))
    return rules


def halfway(counts: list[tuple[int, int]], grain: int) -> list[float]:
    """Thresholds halfway between neighbouring quantiles: a margin on both sides."""
    total, below, points = sum(n for _, n in counts), 0, []
    for step, n in sorted(counts):
        # The quantiles that fall on this step's rows.
        if any(below <= k * (total - 1) / BINS < below + n for k in range(BINS + 1)):
            points.append(step / grain)
        below += n
    return [(a + b) / 2 for a, b in zip(points, points[1:])]


def conjunction(rule: list[Term]) -> Column:
    fits = F.lit(True)
    for term in rule:
        fits = fits & term.on_bins()
    return fits


def gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def grow(cells: DataFrame, cuts: dict[str, list[float]], long: Column) -> list[Term]:
    rule: list[Term] = []
    while len(rule) < MAX_TERMS:
        at = cells.where(conjunction(rule)).select(long, "grow_bad", "grow_good").groupBy("at.feature", "at.bin")
        by = {f: {} for f in cuts}
        for r in at.agg(F.sum("grow_bad").alias("p"), F.sum("grow_good").alias("n")).collect():
            by[r.feature][r.bin] = (r.p, r.n)
        p0, n0 = (sum(x[k] for x in by[next(iter(cuts))].values()) for k in (0, 1))
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f in sorted(cuts):
            for k, value in enumerate(cuts[f]):
                low = [sum(x[j] for b, x in by[f].items() if b <= k) for j in (0, 1)]
                for above, (p, n) in ((False, low), (True, [p0 - low[0], n0 - low[1]])):
                    if p >= MIN_COVER and (g := gain(p, n, p0, n0)) > best[0]:
                        best = (g, Term(f, above, float(value), k))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def prune(cells: DataFrame, rule: list[Term]) -> list[Term]:
    """The shortest of the best prefixes on the held rows; none if it isn't precise enough on all rows."""
    sums = [F.sum(F.when(conjunction(rule[:k]), F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(1, len(rule) + 1) for c in ("grow_bad", "grow_good", "held_bad", "held_good")]
    r = cells.agg(*sums).first()

    def worth(k: int) -> float:
        p, n = r[f"held_bad{k}"], r[f"held_good{k}"]
        return (p - n) / (p + n) if p + n else -1.0

    best = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
    p, n = r[f"grow_bad{best}"] + r[f"held_bad{best}"], r[f"grow_good{best}"] + r[f"held_good{best}"]
    return rule[:best] if p >= MIN_COVER and p >= MIN_PRECISION * (p + n) else []


def verdict(rules: list[list[Term]]) -> Column:
    """The first rule that fits, as text, or 'keep'."""
    if not rules:
        return F.lit("keep")
    out = F
    for rule in rules:
        fits = rule[0].column()
        for term in rule[1:]:
            fits = fits & term.column()
        out = out.when(fits, F.lit(" and ".join(map(str, rule))))
    return out.otherwise(F.lit("keep"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, rule and kept for every row of docs."""
    counts = materialize(text_counts(docs.select("doc_id", "text"), "doc_id"), "quality")
    rules = learn_rules(counts, labels)
    return counts.select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == "keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that neither the base rule nor the list rejects.

    The counts are written beside the rows, so texts are counted once."""
    rows = materialize(text_counts(carried(docs, "doc_id", "text"), "row", "doc_id"), "quality")
    rules = learn_rules(rows.drop("row"), labels)
    return rows.where(~base_failed() & (verdict(rules) == "keep")).select("row.*")
