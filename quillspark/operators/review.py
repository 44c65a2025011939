"""Review of files: decisions, counts, where to go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import basename
from quillspark.operators.records import natural_order

DECISIONS = ["approved", "rejected"]
SPAN = 100_000


def decisions_of(states: DataFrame) -> DataFrame:
    """file_name, status, reviewed_at of review states (decisions: map of name to a struct); bad
    entries are dropped, names cut to their last part."""
    rows = states.select(F.explode("decisions").alias("name", "d"))
    rows = rows.select(basename(F.col("name")).alias("file_name"), F.lower(F.trim("d.status")).alias("status"), F.col("d.reviewed_at_utc").alias("reviewed_at"))
    return rows.where(F.col("status").isin(DECISIONS) & (F.col("file_name") != ""))


def latest(log: DataFrame) -> DataFrame:
    """The decision that holds for every file of an append-only log."""
    return log.groupBy("file_name").agg(F.max(F.struct("reviewed_at", "status")).alias("d")).select("file_name", "d.status", "d.reviewed_at")


def stats(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """approved (and still there), rejected, pending, reviewed, total; a rejected file that is there again counts twice in total."""
    rows = files.select("file_name", F.lit(True).alias("there")).join(decisions.select("file_name", "status"), "file_name", "full")
    there = F.coalesce("there", F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    approved, rejected = n((F.col("status") == "approved") & there), n(F.col("status") == "rejected")
    return rows.agg(approved.alias("approved"), rejected.alias("rejected"), n(there & F.col("status").isNull()).alias("pending"), n(there).alias("present")).select(
        "approved", "rejected", "pending", (F.col("approved") + F.col("rejected")).alias("reviewed"), (F.col("present") + F.col("rejected")).alias("total")
    )


def recent(decisions: DataFrame, n: int = 12) -> DataFrame:
    return decisions.orderBy(F.desc("reviewed_at"), "file_name").limit(n)


def positions(files: DataFrame, group: list[Column] | None = None) -> DataFrame:
    """file_name, position from 1, previous and next name ('' at the ends), in natural order.

    group: columns within which files are ordered, such as their folder."""
    # Names are windowed within spans: numbers by SPAN, others by how they begin. Only the spans, a small table, are
    # ordered as a whole, and give the offsets and the names beyond their ends.
    k = _key(F.col("file_name"))
    span = F.when(k["a"], F.concat(F.lit("1"), F.substring(k["c"], 1, 3))).otherwise(F.concat(F.lit("0"), F.lpad(F.floor(k["b"] / SPAN).cast("string"), 38, "0")))
    rows = files.withColumn("_g", F.to_json(F.struct(*[c.alias(f"g{i}") for i, c in enumerate(group or [F.lit(0)])]))).withColumn("_span", span)
    ends = rows.groupBy("_g", "_span").agg(F.count(F.lit(1)).alias("_n"), F.min_by("file_name", k).alias("_low"), F.max_by("file_name", k).alias("_high"))
    by = Window.partitionBy("_g").orderBy("_span")
    ends = ends.select("_g", "_span", (F.sum("_n").over(by) - F.col("_n")).alias("_before"), F.lag("_high", 1, "").over(by).alias("_previous"), F.lead("_low", 1, "").over(by).alias("_next"))
    order = Window.partitionBy("_g", "_span").orderBy(*natural_order(ignore="_mask"))
    rows = rows.join(ends, ["_g", "_span"]).withColumns({
        "position": (F.col("_before") + F.row_number().over(order)).cast("int"),
        "previous": F.coalesce(F.lag("file_name").over(order), "_previous"),
        "next": F.coalesce(F.lead("file_name").over(order), "_next"),
    })
    return rows.drop("_g", "_span", "_before", "_previous", "_next")


def resume_at(files: DataFrame, decided: DataFrame, last: str) -> DataFrame:
    """The first undecided file after last in natural order, else (or if last isn't there) the first
    undecided one, else ''; one aggregate over the files."""
    done = decided.select("file_name", F.lit(True).alias("done")).distinct()
    rows = files.select("file_name").join(done, "file_name", "left").withColumn("k", _key(F.col("file_name")))
    pending = F.col("done").isNull()
    after = F.min_by("file_name", F.when(pending & (F.col("k") > _key(F.lit(last))), F.col("k")))
    found = rows.agg(F.max(F.col("file_name") == last).alias("there"), after.alias("after"), F.min_by("file_name", F.when(pending, F.col("k"))).alias("first"))
    return found.select(F.coalesce(F.when(F.col("there"), F.col("after")), "first", F.lit("")).alias("file_name"))


def _key(name: Column) -> Column:
    """A struct that sorts names as natural_order does, parts of stems that say _mask aside."""
    stem = F.replace(F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+$", ""), F.lit("_mask"), F.lit(""))
    number = F.when(stem.rlike("^[0-9]+$"), stem.try_cast("decimal(38,0)"))
    return F.struct(number.isNull().alias("a"), number.alias("b"), F.when(number.isNull(), F.lower(name)).alias("c"), name.alias("d"))


def decide(decisions: DataFrame, file_name: str, status: str, at: str) -> DataFrame:
    """The log with one decision more; approving a rejected (moved) file changes nothing."""
    if status not in DECISIONS:
        raise ValueError(f"a decision is one of {DECISIONS}")
    new = decisions.sparkSession.createDataFrame([(file_name, status, at)], "file_name string, status string, reviewed_at string")
    if status == "approved":
        moved = latest(decisions).where((F.col("file_name") == file_name) & (F.col("status") == "rejected"))
        new = new.join(moved.select("file_name"), "file_name", "left_anti")
    return decisions.select("file_name", "status", "reviewed_at").unionByName(new.select("file_name", "status", "reviewed_at"))
