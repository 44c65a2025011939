"""Where results go: a record table that is a log of versions, files of JSON lines, logs, names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry
from quillspark.functions.jsonx import double_encoded, json_object
from quillspark.functions.text import stripped
from quillspark.operators.labelling import valid_payload
from quillspark.schema import RECORDS, STATUSES

COLUMNS = [c.strip().split(" ")[0] for c in RECORDS.split(",")]


PART_BITS, ROW_BITS = 14, 24  # of an id, below its write's number


class RecordStore:
    """Records as an append-only Parquet log; a record is the latest non-null value of each column.

    Writers only add files, so a job that is run again or loses executors never leaves half a table; compact() writes the current
    state into a new folder. Every write claims a number of its own by creating a file of that name, so that two writers
    never share one and no write reads the log. A column is set to null by an empty string."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], f"{RECORDS}, version bigint").schema

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        """One row per id: an aggregate that combines before its shuffle."""
        latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in COLUMNS if c != "id"]
        return self.log().groupBy("id").agg(*latest)

    def _claim(self) -> int:
        """The next write's number: the first whose file isn't there yet (readers of Parquet pass over _claims)."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(at)
        number = 1 + max((int(x.getPath().getName()) for x in files.listStatus(at)), default=0)
        while not files.createNewFile(at.suffix(f"/{number}")):
            number += 1
        return number

    def _append(self, df: DataFrame, version: int) -> None:
        have = set(df.columns)
        types = {f.name: f.dataType for f in self.schema}
        rows = df.select(*[(F.col(c) if c in have else F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS], F.lit(version).cast("bigint").alias("version"))
        rows.write.mode("append").parquet(self.path)

    def insert(self, df: DataFrame, status: str = "ocr_done") -> DataFrame:
        """Add records; returns them with ids, which rise but needn't be dense."""
        version, row = self._claim(), F.monotonically_increasing_id()
        part, nth = F.shiftright(row, 33), row.bitwiseAND(F.lit((1 << 33) - 1))
        fits = (part < 1 << PART_BITS) & (nth < 1 << ROW_BITS)
        key = F.when(fits, F.lit(version << (PART_BITS + ROW_BITS)) + F.shiftleft(part, ROW_BITS) + nth).otherwise(F.raise_error(F.lit("too many rows in a part for one insert")).cast("bigint"))
        self._append(df.withColumn("id", key).withColumn("status", F.lit(status)).withColumn("created_at", F.localtimestamp()), version)
        return self.log().where(F.col("version") == version).drop("version")

    def insert_errors(self, df: DataFrame) -> DataFrame:
        """Add rows of image_path and error_message alone."""
        return self.insert(df.select("image_path", "error_message"), "error")

    def update(self, df: DataFrame) -> None:
        """Set the columns of df for its ids, and updated_at."""
        self._append(df.withColumn("updated_at", F.localtimestamp()), self._claim())

    def save_review(self, df: DataFrame) -> None:
        """Reviews (id, file_name, status, fields and, where the labels were reviewed too, payload with tokens, bboxes and
        ner_tags): the fields as JSON within JSON, the status and the payload go into one write. An
        unknown status, or arrays of unequal lengths, fail the write, and nothing of it stays."""
        checked = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("not a status: "), F.coalesce("status", F.lit("null")))))
        out = {"id": F.col("id"), "status": checked, "reviewed_json": double_encoded(F.col("file_name"), F.col("fields"))}
        if "payload" in df.columns:
            p = F.col("payload")
            fits = valid_payload(p["tokens"], p["bboxes"], p["ner_tags"])
            out["layoutlm_reviewed_json"] = F.when(p.isNull(), None).when(fits, F.to_json(p)).otherwise(F.raise_error(F.lit("a payload's arrays differ in length")))
        self.update(df.select(*[c.alias(k) for k, c in out.items()]))

    def turn(self, turned: DataFrame) -> None:
        """Turn the boxes of both label payloads of records(id, angle, image_width, image_height) whose pages were turned."""
        rows = self.current().select("id", "layoutlm_json", "layoutlm_reviewed_json").join(turned.where("angle % 360 != 0"), "id")
        done = []
        for name in ("layoutlm_json", "layoutlm_reviewed_json"):
            boxes = F.from_json(F.get_json_object(name, "$.bboxes"), "array<array<int>>")
            moved = F.to_json(F.transform(boxes, lambda b: geometry.turned(b, F.col("angle"), F.col("image_width"), F.col("image_height"))))
            others = F.map_filter(F.try_variant_get(json_object(F.col(name)), "$", "map<string,variant>"), lambda k, _: k != "bboxes")
            done.append(F.when(boxes.isNotNull(), F.to_json(F.map_concat(others, F.create_map(F.lit("bboxes"), F.parse_json(moved))))).alias(name))
        self.update(rows.select("id", *done).where("layoutlm_json IS NOT NULL OR layoutlm_reviewed_json IS NOT NULL"))

    def compact(self, path: str) -> RecordStore:
        store = RecordStore(self.spark, path)
        self.current().withColumn("version", F.lit(store._claim()).cast("bigint")).write.mode("append").parquet(path)
        return store


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with those of the columns (name: type) that it lacks, null; again changes nothing."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def append_log(df: DataFrame, path: str, time: str = "timestamp", blobs: list[str] | None = None) -> None:
    """Rows as JSON, in a folder per day; blobs by their length only."""
    for b in blobs or []:
        df = df.withColumn(f"{b}_length", F.coalesce(F.length(b), F.lit(0))).drop(b)
    df.withColumn("date", F.date_format(time, "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)


def state_json(df: DataFrame, columns: list[str], at: Column) -> DataFrame:
    """One row, json: the distinct values of each column, sorted, and the time."""
    return df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns]).select(F.to_json(F.struct(*columns, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("updated_at_utc"))).alias("json"))


def renumbered(files: DataFrame, start: int = 1, taken: DataFrame | None = None) -> DataFrame:
    """files(folder, path, suffix) with new_name: numbers from start in order of path, folder by folder.

    taken(folder, number, suffix): names that are in use; a number is passed over if the name with this
    suffix is."""
    order = Window.partitionBy("folder").orderBy("path")
    rows = files.withColumn("number", F.row_number().over(order) + start - 1)
    if taken is not None:
        by = Window.partitionBy("folder", "suffix")
        own = files.select("folder", "suffix", "path", (F.row_number().over(by.orderBy("path")) - 1).alias("at"))
        # Before the k-th name in use (from 0) number - start - k names are free; that many files come before it.
        used = taken.where(F.col("number") >= start).select("folder", "suffix", "number").distinct()
        used = used.select("folder", "suffix", F.lit(None).cast("string").alias("path"), (F.col("number") - start - F.row_number().over(by.orderBy("number")) + 1).alias("at"))
        passed = F.sum(F.col("path").isNull().cast("int")).over(by.orderBy("at", F.col("path").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        rows = own.union(used).withColumn("number", F.col("at") + start + passed).where("path IS NOT NULL").drop("at")
    return rows.withColumn("new_name", F.concat(F.col("number").cast("string"), F.col("suffix")))


def portrait_name(path: Column, modified_ns: Column, size: Column) -> Column:
    """stem_portrait_ and 16 hex digits of a digest of path, time and size."""
    stem = F.regexp_replace(F.substring_index(F.substring_index(path, "/", -1), "\\", -1), r"(?s)(?<=.)\.[^.]+$", "")
    digest = F.substring(F.sha1(F.concat_ws("|", F.lower(path), modified_ns.cast("string"), size.cast("string"))), 1, 16)
    return F.concat(stripped(stem), F.lit("_portrait_"), digest, F.lit(".jpg"))


def moved(files: DataFrame, rejected: DataFrame, folder: str) -> DataFrame:
    """files with moved_to: the place in folder of those that were rejected; moving them is a step outside."""
    return files.join(rejected.select("file_name", F.lit(True).alias("_r")).distinct(), "file_name", "left").withColumn("moved_to", F.when(F.col("_r"), F.concat(F.lit(folder.rstrip("/") + "/"), "file_name"))).drop("_r")
