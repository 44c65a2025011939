"""Files that come as base64 text, perhaps with a data-URI header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import basename, content_key, stripped, suffix

#: Suffixes of media types, and the bytes that files of a kind start with.
MEDIA = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/webp": ".webp"}
MAGIC = [("FFD8FF", ".jpg"), ("89504E470D0A1A0A", ".png"), ("424D", ".bmp"), ("49492A00", ".tiff"), ("4D4D002A", ".tiff")]
KNOWN = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"]


def sniffed(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
    for magic, extension in MAGIC:
        out = out.when(head.startswith(magic), extension)
    return out


def decoded(df: DataFrame, payload: str = "payload", name: str = "file_name") -> DataFrame:
    """df with content, extension, content_key and error (null if all went well).

    A data URI's header reaches to the first comma and must say ;base64, in either case and anywhere. A payload without a
    name is named as a .jpg. A name without a known suffix gets the media type's, .jpg if that is unknown, and
    outside a data URI that of what the bytes look like. Base64 is read strictly: its alphabet alone, padded."""
    raw = stripped(F.coalesce(payload, F.lit("")))
    uri = raw.startswith("data:")
    header = F.when(uri & raw.contains(","), F.substring_index(raw, ",", 1))
    body = F.when(uri, stripped(F.regexp_replace(raw, r"(?s)^[^,]*,", ""))).otherwise(raw)
    strict = body.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(body) % 4 == 0)
    content = F.when(strict, F.try_to_binary(body, F.lit("base64")))
    bad_uri = uri & (header.isNull() | ~F.coalesce(F.lower(header).contains(";base64"), F.lit(False)))
    error = F.when(raw == "", "empty payload").when(bad_uri, "bad data URI").when(content.isNull(), "invalid base64").when(F.length(content) == 0, "empty content")
    media = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    given = stripped(F.coalesce(name, F.lit("")))
    named = suffix(basename(F.when(given == "", "upload.jpg").otherwise(given)))
    kind = F.lower(stripped(F.substring_index(F.regexp_replace(header, "^data:", ""), ";", 1)))
    extension = F.when(named.isin(KNOWN), named).when(uri, F.coalesce(F.try_element_at(media, kind), F.lit(".jpg"))).otherwise(F.coalesce(sniffed(content), F.lit(".jpg")))
    df = df.withColumn("content", content).withColumn("error", error).withColumn("extension", extension)
    return df.withColumn("content_key", F.when(F.col("error").isNull(), content_key(F.col("content"), F.col("extension"))))


def new_blobs(df: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per content_key that isn't stored yet."""
    return df.where("error IS NULL").dropDuplicates(["content_key"]).join(stored.select("content_key"), "content_key", "left_anti")
