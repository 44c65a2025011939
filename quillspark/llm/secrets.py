"""Secret scans: fixed patterns, and a battery of randomness tests on what looks like an encoded token.

Spans come from regular expressions: the pieces between matches and the matches themselves give
the offsets. A token is a run of 16 or more letters, digits and + / _ -; the narrowest alphabet that
holds it is its encoding. The battery asks whether it fits a uniform draw from that alphabet: a
chi-squared test of the symbol counts (with the variance that its length implies), a runs test about
the alphabet's middle and a lag-one serial correlation, whose p-values Fisher's method combines.

Passing isn't enough: a short word passes too. So a token's p-value is that of written text: symbol pairs
of all runs of under 16 such characters in the corpus, which are no tokens, give the chance of the
token as text, and the ratio of that to its chance as a uniform draw exceeds 1/p with a
probability of at most p, at any length. A token that the battery rejects (combined p under ALPHA) has p = 1.
Per class of lengths, the step-up rule of Benjamini and Hochberg over all tokens of the corpus
keeps the share of false discoveries at RATE.

All spans are [start, end) in code points. Defined cases: a null or empty text has none; very long texts and tokens are
scanned whole; repeated rows are scanned alike (and count as tokens of their own); tokens that tie on a p-value are
discovered together; a corpus without short runs takes all pairs for equally likely; an empty table gives an
empty result; spans of several kinds may overlap; extra columns, whatever their names, are carried in a struct and
left alone. JVM functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import LOWER, UPPER, carried, materialize

KINDS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "random": r"[A-Za-z0-9+/_-]{16,}",
}
MIN_VALUE = 12
MIN_TOKEN = 16
DIGITS = "0123456789"
#: Inferred encodings, narrowest first: name, pattern, alphabet.
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", LOWER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("lower36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/_-"),
]
SYMBOLS = UPPER + LOWER + DIGITS + "+/_-"
#: Battery: the least combined p-value. Rate: of false discoveries.
ALPHA, RATE = 0.001, 0.01
LENGTHS = [16, 24, 40, 80]
BLOCK = 256
STEPS = 8  # of a natural logarithm
TOKEN = "struct<start:int,end:int,encoding:string,n:int,chi:double,runs:double,serial:double,p:double,evidence:double>"


def positions(name: str) -> str:
    """SQL for the starts of all matches, from the columns name_p (pieces) and name_m (matches).

    Prefix sums in two levels, so that a text with very many matches doesn't cost their square."""
    return (
        f"transform(sequence(0, size({name}_m) - 1), k -> get({name}_b, k div {BLOCK}) + length(get({name}_p, k))"
        f" + aggregate(slice({name}_l, (k div {BLOCK}) * {BLOCK} + 1, k % {BLOCK}), 0, (a, x) -> a + x))"
    )


def symbol_square(alphabet: str) -> str:
    return f"aggregate(array({', '.join(repr(c) for c in alphabet)}), 0D, (a, c) -> a + pow(length(x.t) - length(replace(x.t, c, '')), 2))"


def tail(z: str) -> str:
    """SQL for the upper tail of the standard normal at z, by a logistic cubic (within 0.0002)."""
    return f"1 / (1 + exp(least(1.5976 * ({z}) + 0.070566 * pow({z}, 3), 700D)))"


def battery() -> str:
    """SQL for the tests of the tokens in random_m: structs of place, length, encoding, symbols, and the
    three p-values."""
    low = {e: a[: len(a) // 2] for e, _, a in ENCODINGS}
    by = lambda f: "CASE " + " ".join(f"WHEN x.e = '{e}' THEN {f(e, a)}" for e, _, a in ENCODINGS) + " END"
    size = by(lambda e, a: str(len(a)))
    squares = by(lambda e, a: symbol_square(a))
    halves = by(lambda e, a: f"translate(x.t, '{a}', '{'0' * len(low[e])}{'1' * (len(a) - len(low[e]))}')")
    values = by(lambda e, a: f"transform(filter(split(x.t, ''), c -> c != ''), c -> cast(instr('{a}', c) AS double))")
    first = f"transform(transform(random_m, (t, k) -> struct(t, get(random_s, k) AS s)), x -> struct(x.t, x.s, {encoding('x.t')} AS e))"
    second = (
        f"transform({first}, x -> struct(x.s AS start, x.s + length(x.t) AS end, x.e AS encoding, cast(length(x.t) AS double) AS n, cast({size} AS double) AS k, {squares} AS squares, {halves} AS halves, {values} AS v,"
        f" transform(filter(split(x.t, ''), c -> c != ''), c -> instr('{SYMBOLS}', c)) AS symbols))"
    )
    third = (
        f"transform({second}, x -> struct(x.start, x.end, x.encoding, x.n, x.k, x.squares, x.v, x.symbols, cast(length(regexp_replace(x.halves, '(0+|1+)', 'x')) AS double) AS runs,"
        " cast(length(replace(x.halves, '0', '')) AS double) AS ones, aggregate(x.v, 0D, (a, y) -> a + y) / x.n AS mean))"
    )
    fourth = (
        f"transform({third}, x -> struct(x.start, x.end, x.encoding, x.n, x.k, x.symbols,"
        " (x.squares * x.k / x.n - x.n - (x.k - 1)) / sqrt(2 * (x.k - 1) * (x.n - 1) / x.n) AS chi,"
        " 2 * x.ones * (x.n - x.ones) / x.n AS half,"
        " x.runs AS runs,"
        " aggregate(x.v, 0D, (a, y) -> a + (y - x.mean) * (y - x.mean)) AS spread,"
        " aggregate(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v) - 1), (a, b) -> (a - x.mean) * (b - x.mean)), 0D, (a, y) -> a + y) AS lagged))"
    )
    fifth = (
        f"transform({fourth}, x -> struct(x.start, x.end, x.encoding, x.n, x.k, x.symbols, x.chi,"
        " CASE WHEN x.half <= 1 THEN 9D ELSE abs(x.runs - x.half - 1) / sqrt(x.half * (x.half - 1) / (x.n - 1)) END AS runs,"
        " CASE WHEN x.spread = 0 THEN 9D ELSE abs(x.lagged / x.spread) * sqrt(x.n) END AS serial))"
    )
    return f"transform({fifth}, x -> struct(x.start, x.end, x.encoding, x.n, x.k, x.symbols, {tail('x.chi')} AS chi, 2 * {tail('x.runs')} AS runs, 2 * {tail('x.serial')} AS serial))"


def combined(chi: Column, runs: Column, serial: Column) -> Column:
    """Fisher's method for three p-values: the upper tail of chi-squared with six degrees of freedom."""
    half = -(F.log(F.greatest(chi, F.lit(1e-300))) + F.log(F.greatest(runs, F.lit(1e-300))) + F.log(F.greatest(serial, F.lit(1e-300))))
    return F.exp(-half) * (1 + half + half * half / 2)


def surprises(texts: DataFrame, text: str = "text") -> list[float]:
    """Per pair of symbols (the one before, 0 for none, and the next): minus the log of its chance in written text.

    Counted over all runs of under MIN_TOKEN token characters in all texts, distinct runs first."""
    words = texts.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z0-9+/_-]+")).alias("w")).where(f"length(w) BETWEEN 1 AND {MIN_TOKEN - 1}")
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.expr(f"transform(sequence(1, length(w)), i -> struct(instr('{SYMBOLS}', substr(concat('.', w), i, 1)) AS a, instr('{SYMBOLS}', substr(w, i, 1)) AS b))")
    found = words.select(F.explode(pairs).alias("p"), "n").groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).collect()  # len(SYMBOLS) squared at most, and a row
    size = len(SYMBOLS)
    counts = [[0.5] * size for _ in range(size + 1)]
    for r in found:
        counts[r.a][r.b - 1] += r.n
    return [math.log(sum(row) / c) for row in counts for c in row]


def encoding(t: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} RLIKE '{p}' THEN '{e}'" for e, p, _ in ENCODINGS) + " END"


def scan(docs: DataFrame, keep: list[str], costs: list[float]) -> DataFrame:
    """The columns keep of docs, base (array of start, kind, end, by start and kind) and tokens (tested).

    docs: text and the columns to keep, none of which may be named as the ones made here. costs: see surprises."""
    kinds = list(KINDS)
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("body"))
    has = [(F.col("body").contains("AKIA") & F.col("body").rlike(p) if k == "access" else F.col("body").rlike(p)).alias(f"{k}_h") for k, p in KINDS.items()]
    df = df.select(*keep, "body", *has)
    cut = [F.when(F.col(f"{k}_h"), F.split("body", p, -1)).alias(f"{k}_p") for k, p in KINDS.items()]
    match = [F.when(F.col(f"{k}_h"), F.regexp_extract_all("body", F.lit(p), F.lit(0))).alias(f"{k}_m") for k, p in KINDS.items()]
    value = F.when(F.col("assign_h"), F.regexp_extract_all("body", F.lit(KINDS["assign"]), F.lit(2))).alias("assign_v")
    df = df.select(*keep, *cut, *match, value)
    carry = ["assign_v", *[f"{k}_{x}" for k in kinds for x in "pm"]]
    df = df.select(*keep, *carry, *[F.expr(f"zip_with(slice({k}_p, 1, size({k}_m)), {k}_m, (p, m) -> length(p) + length(m))").alias(f"{k}_l") for k in kinds])
    carry += [f"{k}_l" for k in kinds]
    sums = "aggregate(transform(sequence(0, (size({k}_m) - 1) div {B}), b -> aggregate(slice({k}_l, b * {B} + 1, {B}), 0, (a, x) -> a + x)), array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    df = df.select(*keep, *carry, *[F.expr(f"CASE WHEN {k}_m IS NOT NULL THEN {sums.format(k=k, B=BLOCK)} END").alias(f"{k}_b") for k in kinds])
    starts = [F.expr(f"CASE WHEN {k}_m IS NOT NULL THEN {positions(k)} END").alias(f"{k}_s") for k in kinds]
    df = df.select(*keep, "assign_v", *[f"{k}_m" for k in kinds], *starts)
    spans = []
    for at, k in enumerate(kinds[:3]):
        fits = f"length(get(assign_v, k)) >= {MIN_VALUE}" if k == "assign" else "true"
        spans.append(f"coalesce(transform(filter(transform({k}_m, (m, k) -> struct(get({k}_s, k) AS start, {at} AS kind, get({k}_s, k) + length(m) AS end, {fits} AS fits)), x -> x.fits), x -> struct(x.start, x.kind, x.end)), cast(array() AS array<struct<start:int,kind:int,end:int>>))")
    df = df.select(*keep, "random_m", "random_s", F.expr(f"array_sort(concat({', '.join(spans)}))").alias("base"))
    df = df.select(*keep, "base", F.expr(f"CASE WHEN random_m IS NOT NULL THEN {battery()} END").alias("tested"))
    table, size = F.expr(f"array({', '.join(f'{x!r}D' for x in costs)})"), len(SYMBOLS)

    def judged(x):
        cost = F.transform(x["symbols"], lambda c, i: F.get(table, F.coalesce(F.get(x["symbols"], i - 1), F.lit(0)) * size + c - 1))
        ratio = F.aggregate(cost, -x["n"] * F.log(x["k"]), lambda a, y: a + y)
        p = combined(x["chi"], x["runs"], x["serial"])
        return F.struct(
            x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["encoding"].alias("encoding"), x["n"].cast("int").alias("n"), x["chi"].alias("chi"), x["runs"].alias("runs"), x["serial"].alias("serial"),
            p.alias("p"), F.when(p >= ALPHA, F.greatest(ratio, F.lit(0.0))).otherwise(0.0).alias("evidence"),
        )

    none = F.array().cast(f"array<{TOKEN}>")
    apart = F.filter("tested", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return df.select(*keep, "base", F.coalesce(F.transform(apart, judged), none).alias("tokens"))


LENGTH_CLASS = "CASE " + " ".join(f"WHEN {{n}} >= {n} THEN {k}" for k, n in reversed(list(enumerate(LENGTHS)))) + " ELSE 0 END"


def thresholds(scanned: DataFrame) -> list[float]:
    """Per class of lengths, the least evidence (minus the log of p) of a discovery.

    scanned: a column tokens. The evidence is counted in steps, so the driver gets a bounded table."""
    tokens = scanned.select(F.explode("tokens").alias("x"))
    step = F.least(F.floor(F.col("x.evidence") * STEPS), F.lit(100 * STEPS))
    counts = tokens.groupBy(F.expr(LENGTH_CLASS.format(n="x.n")).alias("kind"), step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = [math.inf] * len(LENGTHS)
    for kind in range(len(LENGTHS)):
        own = {r.step: r.n for r in counts if r.kind == kind}
        total, above = sum(own.values()), 0
        for s in sorted(own, reverse=True):
            above += own[s]
            if math.exp(-s / STEPS) * total <= RATE * above:
                found[kind] = s / STEPS
    return found


def discoveries(limits: list[float]) -> Column:
    """The spans (start, kind, end) of tokens with enough evidence, kind being 3."""
    limit = "CASE " + " ".join(f"WHEN {LENGTH_CLASS.format(n='x.n')} = {k} THEN {v if v < math.inf else 1e300!r}D" for k, v in enumerate(limits)) + " END"
    return F.expr(f"transform(filter(tokens, x -> x.evidence >= {limit}), x -> struct(x.start, 3 AS kind, x.end))")


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(get(array({names}), x.kind), ':', x.start, ':', x.end)), ',')")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    docs = docs.select("doc_id", "text")
    found = materialize(scan(docs, ["doc_id"], surprises(docs)), "secrets")
    found = found.select("doc_id", "base", F.array_sort(F.concat("base", discoveries(thresholds(found)))).alias("all"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(list(KINDS)[:3])]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs, with their columns, every run of secret characters replaced by mark (and n_chars, where
    there is such a column, counted anew). A row's spans are written beside it, so texts are scanned once."""
    found = materialize(scan(carried(docs, "text"), ["row"], surprises(docs)), "secrets")
    df = found.select("row", F.array_sort(F.concat("base", discoveries(thresholds(found)))).alias("spans"))
    # Of spans that overlap, the first opens a mark and all move its end.
    merged = (
        "aggregate(spans, cast(array() AS array<struct<start:int,end:int>>), (a, x) -> CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).end"
        " THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).end, x.end) AS end)))"
        " ELSE concat(a, array(struct(x.start AS start, x.end AS end))) END)"
    )
    df = df.select("row", F.expr(merged).alias("spans"))
    cut = (
        "concat(array_join(transform(spans, (x, k) -> concat(substring(row.text, coalesce(get(spans, k - 1).end, 0) + 1, x.start - coalesce(get(spans, k - 1).end, 0)), '"
        + mark
        + "')), ''), substring(row.text, element_at(spans, -1).end + 1))"
    )
    df = df.select("row", F.expr(f"CASE WHEN size(spans) > 0 THEN {cut} ELSE row.text END").alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("clean").isNotNull(), F.length("clean")).cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
