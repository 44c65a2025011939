"""The record table: pages, lookups, neighbours, lists, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import jsonx, text

MAX_PAGE = 100


def with_status(df: DataFrame, status: str | None, column: str = "status") -> DataFrame:
    """Rows of one status; of any, if status is null or empty."""
    return df.where(F.col(column) == status) if status else df


def page(df: DataFrame, number: int, size: int, key: str = "id") -> DataFrame:
    """One page by key; a top-k plan, nothing is sorted whole. Every task keeps the rows up to the page's end, so deep
    pages cost as much as all before them: page_after goes on from a key instead."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"pages start at 1 and hold 1 to {MAX_PAGE} rows")
    return df.orderBy(key).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last: int | None, size: int, key: str = "id") -> DataFrame:
    """The page that follows the key last (null: the first one): a filter that reaches the scan, and a top-k of size rows."""
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"pages hold 1 to {MAX_PAGE} rows")
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(size)


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint")


def lookup(df: DataFrame, value: int, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == value)


def neighbours_of(df: DataFrame, value: int, key: str = "id") -> DataFrame:
    """previous, next of one key, that needn't be there; a filter and an aggregate."""
    k = F.col(key)
    return df.agg(F.max(F.when(k < value, k)).alias("previous"), F.min(F.when(k > value, k)).alias("next"))


def with_neighbours(df: DataFrame, key: str = "id", span: int = 100_000) -> DataFrame:
    """Every row with the previous and next key. Keys are distinct whole numbers.

    Rows are windowed within spans of keys; only the spans' ends, a small table, are ordered as a whole."""
    df = df.withColumn("_span", F.floor(F.col(key) / span))
    ends = df.groupBy("_span").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    order = Window.orderBy("_span")
    ends = ends.select("_span", F.lag("_high").over(order).alias("_before"), F.lead("_low").over(order).alias("_after"))
    within = Window.partitionBy("_span").orderBy(key)
    return (
        df.join(ends, "_span")
        .withColumn("previous", F.coalesce(F.lag(key).over(within), "_before"))
        .withColumn("next", F.coalesce(F.lead(key).over(within), "_after"))
        .drop("_span", "_before", "_after")
    )


def listing(df: DataFrame) -> DataFrame:
    """The rows of a record list."""
    f = jsonx.active_fields(F.col("extracted_json"), F.col("reviewed_json"))
    df = df.withColumn("_f", f)
    return df.select(
        "id",
        "image_path",
        text.basename(F.col("image_path")).alias("file_name"),
        "status",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        text.full_name(F.col("_f.surname"), F.col("_f.given_names")).alias("full_name"),
        F.col("_f.passport_number").alias("passport_number"),
        (F.length(F.coalesce("reviewed_json", F.lit(""))) > 0).alias("has_reviewed_json"),
        (F.length(F.coalesce("layoutlm_json", F.lit(""))) > 0).alias("has_layoutlm_json"),
    )


def tag_vocabulary(tags: list[str]) -> list[str]:
    return ["O", *[f"{p}-{t}" for t in tags for p in "BI"]]


def detail(df: DataFrame, value: int) -> DataFrame:
    """One record with its fields and neighbours."""
    found = lookup(df, value).withColumn("fields", jsonx.active_fields(F.col("extracted_json"), F.col("reviewed_json")))
    found = found.withColumn("label_payload", F.when(F.length("layoutlm_reviewed_json") > 0, F.col("layoutlm_reviewed_json")).otherwise(F.col("layoutlm_json")))
    return found.join(neighbours_of(df, value).withColumn("id", F.lit(value).cast("bigint")), "id")


def natural_order(name: str = "file_name", ignore: str = "") -> list[Column]:
    """Names that are numbers first, as numbers; then the others. ignore: a part of stems that doesn't count."""
    n = F.col(name)
    stem = F.replace(text.stem(n), F.lit(ignore), F.lit("")) if ignore else text.stem(n)
    number = F.when(stem.rlike("^[0-9]+$"), stem.try_cast("decimal(38,0)"))
    return [number.asc_nulls_last(), F.when(number.isNull(), F.lower(n)).asc_nulls_first(), text.suffix(n), n]


def in_stem_range(name: Column, low: int | None, high: int | None) -> Column:
    """Names whose stem is a number within the bounds; all names if there is no bound."""
    if low is None and high is None:
        return F.lit(True)
    number = text.numeric_stem(name)
    fits = number.isNotNull()
    if low is not None:
        fits = fits & (number >= low)
    if high is not None:
        fits = fits & (number <= high)
    return F.coalesce(fits, F.lit(False))


def outside(path: Column, folder: str) -> Column:
    return ~(path.startswith(folder.rstrip("/") + "/") | (path == folder.rstrip("/")))


def code_options(df: DataFrame, kind: str) -> DataFrame:
    """value, label of the codes of a kind, in either case, by description."""
    value, name = F.trim(F.coalesce("code_value", F.lit(""))), F.trim(F.coalesce("code_value_des", F.lit("")))
    name = F.when(name == "", value).otherwise(name)
    rows = df.where(F.upper("code_id") == kind.upper()).orderBy("code_value_des", "code_value")
    return rows.select(value.alias("value"), F.when(value != "", F.concat_ws(" - ", value, name)).otherwise(name).alias("label"))
