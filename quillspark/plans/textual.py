"""Queries over texts and dates: documents, conversations, pages, and dates written out from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dates, jsonx, text
from quillspark.functions.base import let
from quillspark.functions.scores import ratio
from quillspark.operators import labelling, review
from quillspark.plans.registry import query, read
from quillspark.sources import jsonl, payloads

CANONICAL = "trim(regexp_replace(upper(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^0-9A-Z]+', ' ', 'g'))"


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text || chr(12) || ' x', '[ \t\f]+', ' ', 'g'), '\n{2,}', chr(10), 'g')) AS tidy FROM conversations")
def tidy_text(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.tidy(F.concat("text", F.lit("\x0c x"))).alias("tidy"))


@query(f"SELECT doc_id, {CANONICAL.format(x='text')} AS canonical, replace({CANONICAL.format(x='text')}, ' ', '') AS compact FROM documents")
def canonical_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.canonical(F.col("text")).alias("canonical"), text.compact(F.col("text")).alias("compact"))


@query(f"SELECT doc_id, {CANONICAL.format(x='text')} AS canonical FROM documents")
def canonical_text_udf(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.canonical_udf(F.col("text")).alias("canonical"))


@query(r"SELECT conv_id, turn, regexp_replace(upper(replace(text, 'ß', 'ss')), '\s+', '', 'g') AS region_text FROM conversations")
def region_texts(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.region_text(F.col("text")).alias("region_text"))


@query("SELECT conv_id, turn, regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9<]+(?:[/-][A-Z0-9<]+)*') AS tokens FROM conversations")
def token_lists(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("tokens"))


TOKENS_SQL = "[A-Z0-9<]+(?:[/-][A-Z0-9<]+)*"


@query(
    f"WITH p AS (SELECT p_partkey, upper(p_name) AS n, CAST(greatest(1, length(p_name)) AS DOUBLE) AS total, regexp_extract_all(upper(p_name), '{TOKENS_SQL}') AS ts, string_split_regex(upper(p_name), '{TOKENS_SQL}') AS gaps FROM part),"
    " t AS (SELECT p_partkey, total, unnest(ts) AS w, unnest(list_transform(range(1, len(ts) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(ts[1:i-1], lambda y: length(y))), 0))) AS s FROM p)"
    " SELECT p_partkey, w AS t, 10 + CAST(round_even(200 * (s / total), 0) AS INT) AS l, greatest(11 + CAST(round_even(200 * (s / total), 0) AS INT), 10 + CAST(round_even(200 * ((s + length(w)) / total), 0) AS INT)) AS r FROM t"
)
def boxed_tokens(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name", F.expr("named_struct('left', 10, 'top', 5, 'width', 200, 'height', 9)").alias("b"))
    rows = p.select("p_partkey", F.explode(text.boxed_tokens(F.col("p_name"), F.col("b"))).alias("x"))
    return rows.select("p_partkey", F.col("x.text").alias("t"), F.col("x.bbox")[0].alias("l"), F.col("x.bbox")[2].alias("r"))


#: The same in SQL: a word there is what stands between characters that are neither letters, digits nor _.
ALONE = "list_filter(string_split_regex({t}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]'), lambda x: regexp_full_match(x, '{p}'))[1]"


@query(
    "WITH d AS (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS t FROM documents) SELECT doc_id,"
    + ", ".join(f"coalesce({ALONE.format(t='t', p=p)}, '') AS {n}" for n, p in (("passport_number", "[A-Z][0-9A-Z]{6,8}"), ("sex", "M|F|X"), ("issuing_country", "[A-Z]{3}")))
    + ", coalesce(list_filter(string_split_regex(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')[1], '\\s+'), lambda x: x <> '')[1], '') AS surname FROM d"
)
def guessed_fields(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", guessed(F.col("text")).alias("f")).select("doc_id", "f.passport_number", "f.sex", "f.issuing_country", "f.surname")


def guessed(raw):
    """The fields that patterns find in a page's text: a number, three dates, a code, a country, a name."""
    return let(text.tidy(raw), lambda t: let(F.upper(t), lambda upper: _guessed(t, upper)))


def _guessed(t, upper):
    lines = F.filter(F.transform(F.split(t, "\n"), text.stripped), lambda x: x != "")
    name = F.array_remove(F.split(F.upper(F.get(lines, F.lit(0))), text.BLANK + "+"), "")
    found = F.transform(F.slice(F.regexp_extract_all(t, F.lit(text.DATE), F.lit(0)), 1, 3), dates.normalized)
    country = text.first_match(upper, r"(?U)\b([A-Z]{3})\b", 1)
    at = lambda a, k: F.coalesce(F.get(a, F.lit(k)), F.lit(""))
    return F.struct(
        text.first_match(upper, text.ID_NUMBER, 1).alias("passport_number"), at(found, 0).alias("date_of_birth"), at(found, 1).alias("date_of_issue"), at(found, 2).alias("date_of_expiry"),
        text.first_match(upper, r"(?U)\b(M|F|X)\b", 1).alias("sex"), country.alias("issuing_country"), country.alias("nationality_current"),
        at(name, 0).alias("surname"), F.coalesce(F.array_join(F.slice(name, 2, 1000000), " "), F.lit("")).alias("given_names"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS first, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS second FROM orders")
def dates_in_text(spark, sf):
    o = read(spark, sf, "orders")
    line = F.concat(F.lit("born "), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" and issued "), F.date_format(F.expr("o_orderdate + INTERVAL 1 DAY"), "dd-MM-yyyy"), F.lit("."))
    return o.select("o_orderkey", guessed(line).alias("f")).select("o_orderkey", F.col("f.date_of_birth").alias("first"), F.col("f.date_of_issue").alias("second"))


WRITTEN = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%y') WHEN 2 THEN '31/02/2024' WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 4 THEN '1/2/' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') ELSE strftime(o_orderdate, '%-d ') || upper(strftime(o_orderdate, '%b')) || strftime(o_orderdate, ' %Y') END"


def written_dates(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    f = lambda p: F.date_format(d, p)
    w = F.when(k % 6 == 0, f("d/M/yyyy")).when(k % 6 == 1, f("dd-MM-yy")).when(k % 6 == 2, "31/02/2024").when(k % 6 == 3, f("dd.MM.yyyy"))
    w = w.when(k % 6 == 4, F.concat(F.lit("1/2/"), F.lpad((k % 100).cast("string"), 2, "0"))).otherwise(F.concat(f("d "), F.upper(f("MMM")), f(" yyyy")))
    return read(spark, sf, "orders").select("o_orderkey", "o_orderdate", w.alias("w"))


CENTURY = "CASE WHEN o_orderkey % 100 < 69 THEN '20' ELSE '19' END || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-02-01'"


@query(f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN {CENTURY} ELSE {WRITTEN} END AS iso FROM orders")
def date_iso(spark, sf):
    return written_dates(spark, sf).select("o_orderkey", dates.normalized(F.col("w")).alias("iso"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN '' WHEN 4 THEN {CENTURY} ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def any_date(spark, sf):
    return written_dates(spark, sf).select("o_orderkey", dates.any_date(F.concat(F.lit(" "), "w")).alias("iso"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 6 = 4 THEN {CENTURY} ELSE {WRITTEN} END AS out, strftime(o_orderdate, '%Y-%m-%d') AS same, '' AS blank FROM orders")
def output_dates(spark, sf):
    return written_dates(spark, sf).select("o_orderkey", dates.output_date(F.col("w")).alias("out"), dates.output_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("same"), dates.output_date(F.lit("  ")).alias("blank"))


@query("SELECT o_orderkey, strftime(try_strptime(printf('%04d-%02d-%02d', CASE WHEN y < 30 THEN 2000 ELSE 1900 END + y, month(o_orderdate), day(o_orderdate)), '%Y-%m-%d'), '%Y-%m-%d') AS iso FROM (SELECT *, CAST(o_orderkey % 100 AS INT) AS y FROM orders)")
def alpha_month(spark, sf):
    o = read(spark, sf, "orders")
    w = F.concat(F.lit("On "), F.date_format("o_orderdate", "d "), F.date_format("o_orderdate", "MMMM"), F.lit(" "), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("!"))
    return o.select("o_orderkey", dates.month_named(w).alias("iso"))


@query(
    "SELECT o_orderkey, list_sort(list_distinct([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y%m%d'), strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%d-%m-%Y'), strftime(o_orderdate, '%d%m%Y'), strftime(o_orderdate, '%y%m%d'), strftime(o_orderdate, '%Y-%m'), strftime(o_orderdate, '%Y%m'), strftime(o_orderdate, '%m-%Y'), strftime(o_orderdate, '%m/%Y')])) AS variants FROM orders"
)
def date_variants(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.sort_array(dates.variants(F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("variants"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CASE WHEN o_orderkey % 2 = 0 THEN CAST(day(o_orderdate) AS INT) END AS d, TRUE AS looks FROM orders")
def date_signature(spark, sf):
    w = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    s = dates.signature(w)
    return read(spark, sf, "orders").select("o_orderkey", s["year"].alias("y"), s["month"].alias("m"), s["day"].alias("d"), dates.looks_like_date(w).alias("looks"))


@query(
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['PO'] WHEN 1 THEN ['P', 'P<'] WHEN 2 THEN ['F', 'FEMALE', 'NU'] ELSE [upper(c_mktsegment)] END AS v FROM customer"
)
def code_variants(spark, sf):
    k = F.col("c_custkey") % 4
    c = read(spark, sf, "customer")
    field = F.when(k < 2, "passport_type").otherwise("sex")
    value = F.when(k == 0, "po x").when(k == 1, "p<").when(k == 2, "female").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", text.code_variants(field, value).alias("v"))


@query(
    f"WITH t AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(string_split({CANONICAL.format(x='a.text')}, ' '), lambda x: x <> '')) AS l, list_distinct(list_filter(string_split({CANONICAL.format(x='b.text')}, ' '), lambda x: x <> '')) AS r"
    " FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN len(list_intersect(l, r)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(l, r)) / (len(l) + len(r)) END, 9) AS f1 FROM t"
)
def token_f1(spark, sf):
    c = read(spark, sf, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.token_f1(text.canonical(F.col("text")), text.canonical(F.col("other"))), 9).alias("f1"))


@query()
def matching_blocks(spark, sf):
    """The ratio of matching blocks of neighbouring turns' texts; an Arrow function."""
    c = read(spark, sf, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ratio(F.col("text"), F.col("other")), 9).alias("ratio"))


@query("SELECT page_id, sha256(html) || '.jpg' AS content_key, sha256(url || '::' || html) AS pair FROM pages")
def digest_keys(spark, sf):
    p = read(spark, sf, "pages")
    html, url = F.encode("html", "UTF-8"), F.encode("url", "UTF-8")
    return p.select("page_id", text.content_key(html, F.lit(".jpg")).alias("content_key"), text.pair_digest(url, html).alias("pair"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS model FROM part")
def model_names(spark, sf):
    config = F.concat(F.lit("a: 1\n  model_name:  "), F.substring_index("p_name", " ", 1), F.lit("\n# model_name: no\n"))
    return read(spark, sf, "part").select("p_partkey", text.model_name(config).alias("model"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_rescue(spark, sf):
    e = read(spark, sf, "events").select("event_id", jsonx.rescued(F.concat(F.lit("<s> "), "props", F.lit(" </s>"))).alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("SELECT o_orderkey, upper(o_orderstatus) AS sex, strftime(o_orderdate, '%Y-%m-%d') AS date_of_birth, '' AS surname FROM orders")
def model_fields(spark, sf):
    j = F.concat(F.lit('xx{"gt_parse": {"sex": " '), F.lower("o_orderstatus"), F.lit('", "date_of_birth": "'), F.date_format("o_orderdate", "d-M-yyyy"), F.lit('"}}yy'))
    f = jsonx.model_fields(j)
    return read(spark, sf, "orders").select("o_orderkey", f["sex"].alias("sex"), f["date_of_birth"].alias("date_of_birth"), f["surname"].alias("surname"))


@query("SELECT doc_id || '.jpg' AS file_name, CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status FROM labels WHERE toxic = 0")
def state_decisions(spark, sf):
    """A review state as JSON, read back; toxic documents stand for bad entries."""
    l = read(spark, sf, "labels")  # noqa: E741
    word = F.when(F.col("toxic") == 1, "unknown").when(F.col("quality") == 1, " Approved ").otherwise("rejected")
    entry = F.struct(word.alias("status"), F.lit("2024").alias("reviewed_at_utc"), F.lit("").alias("moved_to_error_path"))
    states = l.select(F.create_map(F.concat(F.lit("/x/"), F.col("doc_id").cast("string"), F.lit(".jpg")), entry).alias("decisions"))
    return review.decisions_of(states).select("file_name", "status")


@query("SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def overlay_text(spark, sf):
    by = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("lines"))
    return by.select("conv_id", jsonx.overlay_text(F.col("lines")).alias("text")).where("text != ''")


@query(
    "SELECT page_id, CASE page_id % 8 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' WHEN 4 THEN '.tiff' ELSE '.jpg' END AS extension, CASE page_id % 8 WHEN 3 THEN 'invalid base64' WHEN 5 THEN 'bad data URI' WHEN 6 THEN 'invalid base64' END AS error,"
    " CASE WHEN page_id % 8 NOT IN (3, 5, 6) THEN octet_length(encode(url)) END AS bytes FROM pages"
)
def payload_decode(spark, sf):
    """Names with and without suffixes, headers in capitals and with parameters, unknown types, broken lines."""
    k = F.col("page_id") % 8
    b64 = F.base64(F.encode("url", "UTF-8"))
    b64 = F.regexp_replace(b64, r"\s", "")
    uri = lambda head: F.concat(F.lit(f"data:{head},"), b64)
    payload = F.when(k.isin(0, 2), b64).when(k == 1, uri("IMAGE/WebP;BASE64")).when(k == 3, "####").when(k == 4, uri(" image/tiff ;base64;x=1")).when(k == 5, uri("image/png")).when(k == 6, F.concat(F.substring(b64, 1, 4), F.lit("\n"), b64)).otherwise(uri("image/unknown;base64"))
    p = read(spark, sf, "pages").select("page_id", payload.alias("payload"), F.when(k == 0, "dir/A.PNG").when(k.isin(1, 4, 7), "scan").alias("file_name"))
    out = payloads.decoded(p)
    return out.select("page_id", "extension", "error", F.when(F.col("error").isNull(), F.length("content").cast("bigint")).alias("bytes"))


@query("SELECT doc_id || '.jpg' AS file_name, max(doc_id) AS line_no FROM documents WHERE doc_id % 5 > 1 GROUP BY 1")
def metadata_entries(spark, sf):
    """Lines of JSON, some of them blank or not objects, by name."""
    d = F.col("doc_id")
    good = F.to_json(F.struct(F.concat(d.cast("string"), F.lit(".JPG")).alias("file_name"), F.col("lang")))
    rows = read(spark, sf, "documents").select(d.alias("line_no"), F.when(d % 5 == 0, "  ").when(d % 5 == 1, "[1]").otherwise(good).alias("value"))
    return jsonl.strict(rows).select("file_name", "line_no")


@query("SELECT doc_id, CAST(doc_id % 5 AS INT) AS start FROM documents")
def sequence_start(spark, sf):
    d = read(spark, sf, "documents")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("T"), i.cast("string")))
    target = F.transform(F.sequence(F.col("doc_id") % 5, F.col("doc_id") % 5 + 2), lambda i: F.concat(F.lit("T"), i.cast("string")))
    return d.select("doc_id", labelling.sequence_start(tokens, target).alias("start"))
