"""Expressions over JSON kept as text, some of it encoded twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.base import let
from quillspark.functions.dates import output_date
from quillspark.functions.text import stripped
from quillspark.schema import CODE_FIELDS, DATE_FIELDS, FIELDS


def json_value(c: Column) -> Column:
    """The text as a variant if all of it is one JSON value, else null.

    The parser stops at the end of a value and ignores what follows, so the text is parsed as the first
    of two elements of an array: then anything that follows it shows."""
    at = lambda v, k, t: F.try_variant_get(v, f"$[{k}]", t)
    return let(F.try_parse_json(F.concat(F.lit("["), c, F.lit(",7]"))), lambda v: F.when((at(v, 1, "int") == 7) & at(v, 2, "variant").isNull(), at(v, 0, "variant")))


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def json_object(c: Column) -> Column:
    """The text as a variant if it is a JSON object, else null."""
    return let(json_value(c), lambda v: F.when(is_object(v), v))


def _inner(c: Column) -> Column:
    """gt_parse of the object; where it lacks one, of the object in the string ground_truth."""

    def of(outer):
        # An object there would cast to text as well, so its own type decides.
        is_text = F.schema_of_variant(F.try_variant_get(outer, "$.ground_truth", "variant")) == "STRING"
        nested = json_object(F.try_variant_get(outer, "$.ground_truth", "string"))
        has = F.try_variant_get(outer, "$.gt_parse", "variant")
        return F.when(has.isNotNull(), has).otherwise(F.when(is_text, F.try_variant_get(nested, "$.gt_parse", "variant")))

    # Bound, so that each text is parsed once and not once per use.
    return let(json_object(c), of)


def fields(c: Column) -> Column:
    """The fixed fields of a record's payload, as a struct of strings; what is missing or null is empty."""

    def read(inner):
        return F.struct(*[F.coalesce(F.try_variant_get(inner, f"$.{f}", "string"), F.lit("")).alias(f) for f in FIELDS])

    return let(let(_inner(c), lambda v: F.when(is_object(v), v)), read)


def active_fields(extracted: Column, reviewed: Column) -> Column:
    """Of the reviewed payload alone wherever there is one, even if it can't be read."""
    return fields(F.when(F.length(reviewed) > 0, reviewed).otherwise(extracted))


def trimmed(struct: Column) -> Column:
    return F.struct(*[stripped(struct[f]).alias(f) for f in FIELDS])


def rescued(c: Column) -> Column:
    """The object between the first { and the last } of a text; null if that isn't one."""
    return json_object(F.regexp_extract(c, r"(?s)(\{.*\})", 1))


def model_fields(c: Column) -> Column:
    """The fields of a model's output: unwrapped, codes in upper case, dates as ISO."""
    unwrapped = lambda v: let(F.try_variant_get(v, "$.gt_parse", "variant"), lambda inner: F.when(is_object(inner), inner).otherwise(v))

    def read(source):
        def field(f):
            x = stripped(F.coalesce(F.try_variant_get(source, f"$.{f}", "string"), F.lit("")))
            return F.upper(x) if f in CODE_FIELDS else output_date(x) if f in DATE_FIELDS else x

        return F.struct(*[field(f).alias(f) for f in FIELDS])

    return let(let(rescued(c), unwrapped), read)


def double_encoded(file_name: Column, struct: Column) -> Column:
    """The reviewed payload of a record: the fields as JSON text within JSON."""
    return F.to_json(F.struct(file_name.alias("file_name"), F.to_json(F.struct(struct.alias("gt_parse"))).alias("ground_truth")))


def blanked(entry: Column, new_name: Column, key: str = "personal_number") -> Column:
    """A metadata entry under a new file name, with one field of its payload emptied; all else, of whatever type, stays
    as it is. Payloads that aren't objects within a string are left alone."""
    members = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    one = lambda k, v: F.create_map(F.lit(k), v.cast("variant"))
    others = lambda m, *keys: F.map_filter(m, lambda k, _: ~k.isin(*keys))

    def made(outer):
        truth = F.when(F.schema_of_variant(F.try_variant_get(outer, "$.ground_truth", "variant")) == "STRING", F.try_variant_get(outer, "$.ground_truth", "string"))

        def emptied(inner):
            def whole(parsed):
                blank = F.to_json(F.map_concat(others(members(parsed), key), one(key, F.lit(""))))
                return F.when(is_object(parsed), F.to_json(F.map_concat(others(members(inner), "gt_parse"), F.create_map(F.lit("gt_parse"), F.parse_json(blank)))))

            return let(F.try_variant_get(inner, "$.gt_parse", "variant"), whole)

        named = F.map_concat(others(members(outer), "file_name"), one("file_name", new_name))
        whole = lambda t: let(named, lambda m: F.to_json(F.when(t.isNull(), m).otherwise(F.map_concat(others(m, "ground_truth"), one("ground_truth", t)))))
        return let(let(json_object(truth), emptied), whole)

    return let(json_object(entry), lambda outer: F.when(outer.isNotNull(), made(outer)))


def overlay_text(lines: Column) -> Column:
    """The texts of an array of lines that aren't blank, one a line."""
    texts = F.transform(lines, lambda x: stripped(F.coalesce(x["text"], F.lit(""))))
    return F.array_join(F.array_remove(texts, ""), "\n")


def redacted(row: Column, keys: list[str]) -> Column:
    """A struct without its blobs; the length of each takes its place."""
    out = row
    for k in keys:
        out = out.withField(f"{k}_length", F.coalesce(F.length(row[k]), F.lit(0))).dropFields(k)
    return out
