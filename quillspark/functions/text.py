"""Text expressions. All are JVM expressions; canonical_udf alone runs in Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillspark.functions.base import constant_map, let

BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(c, f"^{BLANK}+", ""), f"{BLANK}+$", "")


def tidy(c: Column) -> Column:
    """Form feeds and runs of blanks become one space, runs of newlines one newline; stripped."""
    c = F.regexp_replace(F.translate(c, "\x0c", " "), r"[ \t]+", " ")
    return stripped(F.regexp_replace(c, r"\n{2,}", "\n"))


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of each character of the basic plane in ASCII: single
    characters as a translation, and those of the Latin blocks and ligatures that become several."""
    source, target, several = [], [], {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if ord(x) < 128)
        if len(plain) == 1:
            source.append(c)
            target.append(plain)
        elif len(plain) > 1 and (code < 0x250 or 0xFB00 <= code < 0xFB10 or code in (0x2026, 0x2122, 0x2116)):
            several[c] = plain
    return "".join(source), "".join(target), several


def ascii_folded(c: Column) -> Column:
    """NFKD with everything but ASCII dropped."""
    source, target, several = _folding()
    table = constant_map(several)
    spelled = lambda v: F.array_join(F.transform(F.split(v, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    spread = let(c, lambda v: F.when(v.rlike(f"[{''.join(several)}]"), spelled(v)).otherwise(v))
    return F.regexp_replace(F.translate(spread, source, target), r"[^\x00-\x7F]", "")


def _canonical_rest(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), "[^0-9A-Z]+", " "))


def canonical(c: Column) -> Column:
    """Upper-case letters and digits, everything else one space.

    Exact for all text but rare compatibility characters that stand for several (such as a circled
    ten); canonical_udf handles those too."""
    return let(c, lambda v: _canonical_rest(F.when(v.rlike(r"[^\x00-\x7F]"), ascii_folded(v)).otherwise(v)))


@pandas_udf(StringType())
def _fold(x):
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode())


def stripped_words(line: Column) -> Column:
    """The words between the spaces of a line, stripped; only lines with other white space need to look at each."""
    words = F.array_remove(F.split(line, " "), "")
    return F.when(line.rlike(f"(?! ){BLANK}"), F.transform(words, stripped)).otherwise(words)


def canonical_words(line: Column, words: Column) -> Column:
    """The canonical form of each of a line's stripped_words; of ASCII lines the line's, taken apart, for a call a word is dear."""
    bare = F.regexp_replace(line, "(?<![^ ])[^0-9A-Za-z ]+(?=[0-9A-Za-z])|(?<=[0-9A-Za-z])[^0-9A-Za-z ]+(?![^ ])", "")
    # What is left of other characters, within words or as words, is marked until the line is split.
    apart = F.array_remove(F.split(F.upper(F.regexp_replace(bare, "[^0-9A-Za-z ]+", "\x01")), " "), "")
    plain = F.when(line.rlike("[^0-9A-Za-z ]"), F.transform(apart, lambda w: F.trim(F.translate(w, "\x01", " ")))).otherwise(apart)
    return F.when(line.rlike(r"[^\x00-\x7F]"), F.transform(words, canonical)).otherwise(plain)


def canonical_udf(c: Column) -> Column:
    return _canonical_rest(_fold(c))


def compact(c: Column) -> Column:
    return F.replace(canonical(c), F.lit(" "), F.lit(""))


def region_text(c: Column) -> Column:
    """Upper case without any white space."""
    return F.regexp_replace(F.upper(c), f"{BLANK}+", "")


TOKEN = r"[A-Z0-9<]+(?:[/-][A-Z0-9<]+)*"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.upper(c), F.lit(TOKEN), F.lit(0))


def boxed_tokens(text: Column, box: Column) -> Column:
    """The tokens of a line with their share of its box: array of (text, bbox as four integers).

    The pieces between tokens give the offsets; ratios are rounded half to even."""
    # Found and between are bound, for a lambda would make them anew for every token; a text that is one token needs no offsets.
    return let(F.upper(text), lambda upper: F.when(upper.rlike(f"^{TOKEN}$"), _one_token(upper, box)).otherwise(let(F.regexp_extract_all(upper, F.lit(TOKEN), F.lit(0)), lambda found: _boxed(upper, found, box))))


def _one_token(upper: Column, box: Column) -> Column:
    right = F.greatest(box["left"] + 1, box["left"] + box["width"])
    return F.array(F.struct(upper.alias("text"), F.array(box["left"], box["top"], right, box["top"] + box["height"]).alias("bbox")))


def _boxed(upper: Column, found: Column, box: Column) -> Column:
    total = F.greatest(F.length(upper), F.lit(1))

    def token(between, t, k):
        before = F.aggregate(F.slice(between, 1, k + 1), F.lit(0), lambda a, x: a + F.length(x))
        start = before + F.aggregate(F.slice(found, 1, k), F.lit(0), lambda a, x: a + F.length(x))
        left = box["left"] + F.rint(box["width"] * (start / total)).cast("int")
        right = box["left"] + F.rint(box["width"] * ((start + F.length(t)) / total)).cast("int")
        return F.struct(t.alias("text"), F.array(left, box["top"], F.greatest(left + 1, right), box["top"] + box["height"]).alias("bbox"))

    return let(F.split(upper, TOKEN, -1), lambda between: F.transform(found, lambda t, k: token(between, t, k)))


def match_token(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9<]", "")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or the empty string."""
    return F.coalesce(F.regexp_extract(c, pattern, group), F.lit(""))


#: Word boundaries and digits as Unicode has them.
ID_NUMBER = r"(?U)\b([A-Z][0-9A-Z]{6,8})\b"
DATE = r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"


def basename(c: Column) -> Column:
    return stripped(F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1))


def normalized_path(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit("/"), F.lit("\\")))


def stem(c: Column) -> Column:
    """The name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(c, r"(?s)(?<=.)\.[^.]+$", "")


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(?s).(\.[^.]+)$", 1))


def numeric_stem(c: Column) -> Column:
    """The stem as a number, null unless it is all digits."""
    return F.when(stem(c).rlike("^[0-9]+$"), stem(c).try_cast("decimal(38,0)"))


def full_name(surname: Column, given: Column) -> Column:
    a, b = stripped(F.coalesce(surname, F.lit(""))), stripped(F.coalesce(given, F.lit("")))
    return F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def shared(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two arrays of distinct tokens."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(a) + F.size(b))))


def token_f1(left: Column, right: Column) -> Column:
    """Harmonic mean of precision and recall over the sets of space-separated tokens."""
    sets = F.struct(*[F.array_distinct(F.array_remove(F.split(x, " "), "")).alias(n) for n, x in (("a", left), ("b", right))])
    return let(sets, lambda v: shared(v["a"], v["b"]))


#: Codes that mean the same.
SEX_CODES = [["M", "MALE", "NAM"], ["F", "FEMALE", "NU"], ["X", "OTHER", "UNKNOWN"]]


def code_variants(field: Column, value: Column) -> Column:
    return let(compact(value), lambda v: _code_variants(field, v))


def _code_variants(field: Column, v: Column) -> Column:
    out = F.when(v == "", F.array().cast("array<string>"))
    kind = field == "passport_type"
    out = out.when(kind & v.startswith("PO"), F.array(F.lit("PO"))).when(kind & v.startswith("PD"), F.array(F.lit("PD"))).when(kind & v.startswith("P"), F.array(F.lit("P"), F.lit("P<")))
    for codes in SEX_CODES:
        out = out.when((field == "sex") & v.isin(codes), F.array(*map(F.lit, codes)))
    return out.otherwise(F.array(v))


def content_key(content: Column, extension: Column) -> Column:
    return F.concat(F.sha2(content, 256), extension)


def pair_digest(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(a, F.encode(F.lit("::"), "UTF-8"), b), 256)


def model_name(config: Column) -> Column:
    """The value of the first model_name line of a configuration text."""
    return F.nullif(F.regexp_extract(config, r"(?m)^\s*model_name:\s*([^\s#]+)\s*$", 1), F.lit(""))
