"""Queries over the record table's analogues: events as records with a status, customers as records with
payloads, pages and documents as files. All run over whole tables; limits are pages and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import jsonx, text
from quillspark.operators import ingest, records, review
from quillspark.plans.registry import query, read, spread
from quillspark.schema import FIELDS
from quillspark.sources import sinks


def event_records(spark, sf):
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), "ts", "user_id", "value")


@query("SELECT event_id AS id, event_type AS status, ts, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 20 OFFSET 40")
def page_filtered(spark, sf):
    return records.page(records.with_status(event_records(spark, sf), "purchase"), 3, 20)


@query("SELECT event_id AS id, event_type AS status, ts, user_id, value FROM events ORDER BY event_id LIMIT 100 OFFSET 100")
def page_unfiltered(spark, sf):
    return records.page(records.with_status(event_records(spark, sf), ""), 2, 100)


@query(
    "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages,"
    " greatest(1, CAST(ceil(count(*) FILTER (WHERE event_type = 'none') / 20.0) AS BIGINT)) AS no_pages FROM events"
)
def page_totals(spark, sf):
    rows = event_records(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "none").alias("none"))
    return rows.select("total", "errors", records.page_count(F.col("total"), 20).alias("pages"), records.page_count(F.col("none"), 20).alias("no_pages"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, sf):
    return ingest.outcome_counts(event_records(spark, sf), "status")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey")
def ordered_scan(spark, sf):
    return read(spark, sf, "customer").orderBy("c_custkey")


@query("SELECT page_id AS id, lower(replace(url, '/', chr(92))) AS normalized_path, lower(string_split(rtrim(url, '/'), '/')[-1]) AS lower_name FROM pages")
def record_keys(spark, sf):
    return ingest.with_keys(read(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"), "url").select("id", "normalized_path", "lower_name")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 77")
def record_lookup(spark, sf):
    return records.lookup(read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), 77, "doc_id")


@query("SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS previous, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next FROM orders")
def neighbours(spark, sf):
    return records.with_neighbours(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4096)


@query("SELECT max(doc_id) FILTER (WHERE doc_id < 100) AS previous, min(doc_id) FILTER (WHERE doc_id > 100) AS next FROM documents")
def neighbours_of_one(spark, sf):
    return records.neighbours_of(read(spark, sf, "documents"), 100, "doc_id")


CODES = "SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'Country' ELSE 'currency' END AS code_id, CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE upper(substr(n_name, 1, 3)) END AS code_value, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS code_value_des FROM nation"


@query(f"SELECT trim(code_value) AS value, CASE WHEN trim(code_value) <> '' THEN trim(code_value) || ' - ' || name ELSE name END AS label FROM (SELECT *, CASE WHEN coalesce(trim(code_value_des), '') = '' THEN trim(code_value) ELSE trim(code_value_des) END AS name FROM ({CODES})) WHERE upper(code_id) = 'COUNTRY'")
def code_options(spark, sf):
    n = read(spark, sf, "nation")
    codes = n.select(
        F.when(F.col("n_regionkey") % 2 == 0, "Country").otherwise("currency").alias("code_id"),
        F.when(F.col("n_nationkey") % 7 == 0, "").otherwise(F.upper(F.substring("n_name", 1, 3))).alias("code_value"),
        F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("code_value_des"),
    )
    return records.code_options(codes, "country")


def customer_records(spark, sf):
    """Records whose payloads are missing, unreadable, plain or encoded twice, by key."""
    c = spread(read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    k = F.col("c_custkey")
    plain = F.concat(F.lit('{"gt_parse": {"surname": "'), F.col("c_name"), F.lit('", "sex": null, "personal_number": "'), k.cast("string"), F.lit('"}}'))
    twice = F.concat(F.lit('{"file_name": "f", "ground_truth": "{\\"gt_parse\\": {\\"surname\\": \\"R '), F.col("c_name"), F.lit('\\", \\"given_names\\": \\" '), F.col("c_mktsegment"), F.lit('\\"}}"}'))
    reviewed = F.when(k % 5 == 0, "nope").when(k % 5 == 1, twice).when(k % 5 == 2, "").when(k % 5 == 3, '{"ground_truth": {"gt_parse": {"surname": "object"}}}')
    return c.select(
        k.alias("id"), F.concat(F.lit("/in/"), k.cast("string"), F.lit(".jpg")).alias("image_path"), F.when(k % 7 == 0, "[1]").otherwise(plain).alias("extracted_json"), reviewed.alias("reviewed_json"),
        F.lit(None).cast("string").alias("layoutlm_json"), F.when(k % 2 == 0, "reviewed").otherwise("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
    )


CUSTOMERS = r"""
r AS (SELECT c_custkey AS id, '/in/' || c_custkey || '.jpg' AS image_path, CASE WHEN c_custkey % 2 = 0 THEN 'reviewed' ELSE 'pending' END AS status,
  CASE WHEN c_custkey % 7 = 0 THEN '[1]' ELSE '{"gt_parse": {"surname": "' || c_name || '", "sex": null, "personal_number": "' || c_custkey || '"}}' END AS extracted_json,
  CASE c_custkey % 5 WHEN 0 THEN 'nope' WHEN 1 THEN '{"file_name": "f", "ground_truth": "{\"gt_parse\": {\"surname\": \"R ' || c_name || '\", \"given_names\": \" ' || c_mktsegment || '\"}}"}'
    WHEN 2 THEN '' WHEN 3 THEN '{"ground_truth": {"gt_parse": {"surname": "object"}}}' END AS reviewed_json FROM customer),
a AS (SELECT *, CASE WHEN length(reviewed_json) > 0 THEN reviewed_json ELSE extracted_json END AS active FROM r),
g AS (SELECT *, CASE WHEN NOT json_valid(active) THEN NULL WHEN json_type(active, '$.gt_parse') = 'OBJECT' THEN active
  WHEN json_type(active, '$.ground_truth') = 'VARCHAR' THEN json_extract_string(active, '$.ground_truth') END AS payload FROM a),
f AS (SELECT *, coalesce(json_extract_string(payload, '$.gt_parse.surname'), '') AS surname, coalesce(json_extract_string(payload, '$.gt_parse.given_names'), '') AS given_names,
  coalesce(json_extract_string(payload, '$.gt_parse.personal_number'), '') AS personal_number, coalesce(json_extract_string(payload, '$.gt_parse.sex'), '') AS sex FROM g)
"""


@query(f"WITH {CUSTOMERS} SELECT id, surname, given_names, personal_number, sex FROM f")
def active_fields(spark, sf):
    r = customer_records(spark, sf).withColumn("f", jsonx.active_fields(F.col("extracted_json"), F.col("reviewed_json")))
    return r.select("id", *[f"f.{x}" for x in ("surname", "given_names", "personal_number", "sex")])


@query(
    f"WITH {CUSTOMERS} SELECT id, image_path, id || '.jpg' AS file_name, status, CAST(NULL AS VARCHAR) AS created_at, trim(trim(surname) || ' ' || trim(given_names)) AS full_name, '' AS passport_number,"
    " length(coalesce(reviewed_json, '')) > 0 AS has_reviewed_json, FALSE AS has_layoutlm_json FROM f"
)
def record_list(spark, sf):
    return records.listing(customer_records(spark, sf))


@query(f"WITH {CUSTOMERS} SELECT id, surname, previous, next FROM f, (SELECT max(id) FILTER (WHERE id < 36) AS previous, min(id) FILTER (WHERE id > 36) AS next FROM f) WHERE id = 36")
def record_detail(spark, sf):
    rows = customer_records(spark, sf).withColumn("layoutlm_reviewed_json", F.lit(None).cast("string"))
    return records.detail(rows, 36).select("id", "fields.surname", "previous", "next")


@query("SELECT c_custkey AS id, 'R ' || c_name AS surname, '' AS personal_number, c_custkey || '_mask.jpg' AS file_name FROM customer")
def blank_private_field(spark, sf):
    c = spread(read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    inner = F.to_json(F.struct(F.struct(F.concat(F.lit("R "), "c_name").alias("surname"), F.col("c_custkey").cast("string").alias("personal_number")).alias("gt_parse")))
    entry = F.to_json(F.struct(F.concat(F.col("c_custkey").cast("string"), F.lit(".jpg")).alias("file_name"), inner.alias("ground_truth")))
    rows = c.select(F.col("c_custkey").alias("id"), entry.alias("entry"))
    name = ingest.output_name(F.get_json_object("entry", "$.file_name"), "mask")
    rows = rows.select("id", jsonx.blanked(F.col("entry"), name).alias("entry"))
    f = jsonx.fields(F.col("entry"))
    return rows.select("id", f["surname"].alias("surname"), f["personal_number"].alias("personal_number"), F.get_json_object("entry", "$.file_name").alias("file_name"))


@query(
    "SELECT doc_id, coalesce(json_extract_string(json_extract_string(j, '$.ground_truth'), '$.gt_parse.surname'), '') AS surname, json_extract_string(j, '$.file_name') AS file_name"
    " FROM (SELECT doc_id, json_object('file_name', doc_id || '.jpg', 'ground_truth', CAST(json_object('gt_parse', json_object('surname', upper(lang))) AS VARCHAR)) AS j FROM documents)"
)
def double_encoded(spark, sf):
    d = read(spark, sf, "documents")
    f = F.struct(*[(F.upper("lang") if x == "surname" else F.lit("")).alias(x) for x in FIELDS])
    rows = d.select("doc_id", jsonx.double_encoded(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")), f).alias("j"))
    return rows.select("doc_id", jsonx.fields(F.col("j"))["surname"].alias("surname"), F.get_json_object("j", "$.file_name").alias("file_name"))


def review_files(spark, sf):
    return read(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_mask.jpg")).alias("file_name"))


def decision_log(spark, sf):
    rows = read(spark, sf, "labels")
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_mask.jpg")).alias("file_name"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("status"), F.format_string("2024-01-%02dT%05d", (F.col("doc_id") % 28 + 1).cast("int"), F.col("doc_id").cast("int")).alias("reviewed_at"))


FILES = "files AS (SELECT doc_id || '_mask.jpg' AS file_name, doc_id FROM documents), d AS (SELECT doc_id || '_mask.jpg' AS file_name, doc_id, CASE WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status, printf('2024-01-%02dT%05d', doc_id % 28 + 1, doc_id) AS reviewed_at FROM labels)"


@query(
    f"WITH {FILES}, j AS (SELECT files.file_name AS there, d.status FROM files FULL JOIN d USING (file_name)) SELECT count(*) FILTER (WHERE status = 'approved' AND there IS NOT NULL) AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected,"
    " count(*) FILTER (WHERE status IS NULL) AS pending, count(*) FILTER (WHERE status = 'approved' AND there IS NOT NULL) + count(*) FILTER (WHERE status = 'rejected') AS reviewed, count(there) + count(*) FILTER (WHERE status = 'rejected') AS total FROM j"
)
def review_stats(spark, sf):
    return review.stats(review_files(spark, sf), decision_log(spark, sf))


@query(f"WITH {FILES} SELECT file_name, status, reviewed_at FROM d ORDER BY reviewed_at DESC, file_name LIMIT 12")
def recent_decisions(spark, sf):
    return review.recent(decision_log(spark, sf))


@query(f"WITH {FILES} SELECT coalesce((SELECT files.file_name FROM files ANTI JOIN d USING (file_name) WHERE doc_id > 40 ORDER BY doc_id LIMIT 1), (SELECT files.file_name FROM files ANTI JOIN d USING (file_name) ORDER BY doc_id LIMIT 1), '') AS file_name")
def resume_pointer(spark, sf):
    return review.resume_at(review_files(spark, sf), decision_log(spark, sf), "40_mask.jpg")


@query(
    "WITH n AS (SELECT source, file_name, row_number() OVER w AS position, lag(file_name, 1, '') OVER w AS previous, lead(file_name, 1, '') OVER w AS next FROM"
    " (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || doc_id || '.JPG' ELSE doc_id || '_mask.jpg' END AS file_name FROM documents)"
    " WINDOW w AS (PARTITION BY source ORDER BY doc_id % 3 = 0, CASE WHEN doc_id % 3 <> 0 THEN doc_id END, lower(file_name))) SELECT * FROM n"
)
def natural_positions(spark, sf):
    d = read(spark, sf, "documents")
    k = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", k, F.lit(".JPG"))).otherwise(F.concat(k, F.lit("_mask.jpg")))
    return review.positions(d.select("source", name.alias("file_name")), [F.col("source")])


@query("SELECT doc_id || '_mask.jpg' AS file_name, max(CASE WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END) AS status FROM labels GROUP BY 1")
def latest_decisions(spark, sf):
    rows = read(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("_mask.jpg")).alias("file_name"), F.when(F.col("toxic") == 1, "rejected").otherwise("approved").alias("status"), F.lit("2024").alias("reviewed_at"))
    return review.latest(rows).select("file_name", "status")


@query(
    "WITH p AS (SELECT page_id, lower(replace(url, '/', chr(92))) AS path, lower(string_split(rtrim(url, '/'), '/')[-1]) AS name FROM pages), old AS (SELECT * FROM p WHERE page_id % 4 = 0), new AS (SELECT * FROM p WHERE page_id % 4 <> 0)"
    " SELECT page_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) AS k FROM new WHERE path NOT IN (SELECT path FROM old) AND name NOT IN (SELECT name FROM old)) WHERE k = 1"
)
def duplicate_anti_join(spark, sf):
    """A quarter of the files stands for those that are there already; the others are the batch."""
    p = read(spark, sf, "pages").select("page_id", F.col("url").alias("image_path"))
    return ingest.without_duplicates(p.where("page_id % 4 != 0"), p.where("page_id % 4 = 0"), [F.col("page_id")]).select("page_id")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_key, count(*) AS copies FROM documents GROUP BY text")
def content_dedupe(spark, sf):
    return ingest.one_per_content(read(spark, sf, "documents"), F.encode("text", "UTF-8"), [F.col("doc_id")]).select("doc_id", "content_key", "copies")


@query("SELECT d.doc_id, m.text AS entry, m.text IS NULL AS missing FROM documents d LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY 1) m ON d.doc_id = m.conv_id")
def metadata_join(spark, sf):
    images = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("F"), F.col("doc_id").cast("string")).alias("file_name"))
    metadata = read(spark, sf, "conversations").select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file_name"), F.col("text").alias("entry"), F.col("turn").alias("line_no"))
    return ingest.with_metadata(images, metadata).select("doc_id", "entry", "missing")


@query(
    "WITH s AS (SELECT doc_id, doc_id || '.jpg' AS f FROM documents), done AS (SELECT f FROM s WHERE doc_id % 3 = 0 UNION SELECT f FROM s WHERE doc_id % 5 = 0), ok AS (SELECT f FROM s WHERE doc_id % 5 = 0 UNION SELECT f FROM s WHERE doc_id % 9 = 0)"
    " SELECT f AS file_name FROM s WHERE NOT (f IN (SELECT f FROM done) AND f IN (SELECT f FROM ok))"
)
def resume_pending(spark, sf):
    """Every third file is in the state, every fifth has an output, every ninth is known to give none."""
    s = read(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file_name"))
    outputs = s.where("doc_id % 5 = 0").select(ingest.output_name(F.col("file_name"), "mask").alias("file_name"))
    done = ingest.processed(s.where("doc_id % 3 = 0"), outputs, outputs, "mask")
    return ingest.pending(s.select("file_name"), done, outputs, s.where("doc_id % 9 = 0"), "mask")


@query("SELECT CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 THEN 'inserted' ELSE 'error' END AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def outcome_counts(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    return ingest.outcome_counts(rows.select(F.when(F.col("quality").isNull(), "skipped").when(F.col("quality") == 1, "inserted").otherwise("error").alias("outcome")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/a/' || doc_id || '.jpg' WHEN doc_id % 3 = 0 THEN '/in/' || doc_id || '.jpg' ELSE '/a/' || doc_id || '.jpg' END AS resolved_path FROM documents")
def resolved_paths(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_path"))
    there = d.where("doc_id % 2 = 0").select(F.col("image_path").alias("path"))
    moved = d.where("doc_id % 3 = 0").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return ingest.resolved_path(d, there.union(moved), "/in").select("doc_id", "resolved_path")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id BETWEEN 100 AND 300")
def stem_range(spark, sf):
    d = read(spark, sf, "documents")
    k = F.col("doc_id").cast("string")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a"), k, F.lit(".jpg"))).otherwise(F.concat(k, F.lit(".jpg"))).alias("name"))
    return rows.where(records.in_stem_range(F.col("name"), 100, 300)).select("doc_id")


@query("SELECT page_id FROM pages WHERE NOT starts_with(url, 'http://')")
def outside_folder(spark, sf):
    return read(spark, sf, "pages").where(records.outside(F.col("url"), "http:/")).select("page_id")


@query("SELECT user_id AS content_key, max(event_id) AS written FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY 2 DESC LIMIT 32")
def cache_contents(spark, sf):
    writes = read(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("content_key"), F.col("event_id").alias("written"))
    return ingest.cached(writes, 32)


@query("SELECT DISTINCT user_id AS content_key FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def cache_misses(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("content_key"), "event_type")
    return ingest.cache_misses(e.select("content_key"), e.where("event_type = 'error'").select("content_key").distinct())


@query("SELECT event_id FROM events WHERE event_id % 2 = 1")
def unchecked_files(spark, sf):
    files = read(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("path"), F.col("ts").alias("modified"), F.col("user_id").alias("length"))
    markers = files.select("path", "modified", (F.col("length") + F.col("event_id") % 2).alias("length"))
    return ingest.unchecked(files, markers).select("event_id")


@query(
    "SELECT user_id AS id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (WHERE event_type <> 'error') AS value, count(*) AS versions FROM events GROUP BY 1"
)
def record_versions(spark, sf):
    """The latest known value of each column of a log of versions."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_id")
    return e.groupBy("id").agg(F.max_by("status", "event_id").alias("status"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("event_id"))).alias("value"), F.count(F.lit(1)).alias("versions"))


@query("SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY printf('%09d', doc_id)) + 4) || '.jpg' AS new_name FROM documents")
def renumbered_files(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("folder"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.lit(".jpg").alias("suffix"))
    return sinks.renumbered(d, 5).select("doc_id", "new_name")


@query("SELECT CAST(ts AS DATE) AS day, event_type AS stage, count(*) AS n, avg(length(props)) AS mean_length FROM events GROUP BY 1, 2")
def log_by_day(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("props")).alias("mean_length"))


@query("SELECT list_sort(list(DISTINCT event_type)) AS types, count(DISTINCT user_id) AS users FROM events")
def state_sets(spark, sf):
    return read(spark, sf, "events").agg(F.sort_array(F.collect_set("event_type")).alias("types"), F.count_distinct("user_id").alias("users"))


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def name_union(spark, sf):
    return read(spark, sf, "documents").select("doc_id").union(read(spark, sf, "labels").select("doc_id")).distinct()


@query("SELECT event_id AS id, event_type AS status, ts, user_id, value FROM events WHERE event_id > 57 ORDER BY event_id LIMIT 20")
def page_after_key(spark, sf):
    return records.page_after(event_records(spark, sf), 57, 20)


@query(
    "SELECT c_custkey AS id, 100 AS width, TRUE AS ok, [1, 2] AS list, 'x' AS more, json_object('gt_parse', json_object('personal_number', '', 'n', 7)) IS NOT NULL AS kept, c_name AS surname, '' AS personal_number FROM customer"
)
def rewritten_entries(spark, sf):
    """Metadata entries keep numbers, booleans, lists and what stands beside the fields, under their new names."""
    c = read(spark, sf, "customer")
    inner = F.concat(F.lit('{"more": "x", "gt_parse": {"n": 7, "personal_number": "1", "surname": "'), F.col("c_name"), F.lit('"}}'))
    entry = F.concat(F.lit('{"width": 100, "ok": true, "list": [1, 2], "file_name": "a.jpg", "ground_truth": '), F.to_json(F.struct(inner.alias("s"))).substr(F.lit(6), F.lit(1 << 30)))
    out = c.select(F.col("c_custkey").alias("id"), jsonx.blanked(entry, F.lit("b.jpg")).alias("j"))
    v, t = F.parse_json("j"), F.parse_json(F.get_json_object("j", "$.ground_truth"))
    return out.select(
        "id", F.variant_get(v, "$.width", "int").alias("width"), F.variant_get(v, "$.ok", "boolean").alias("ok"), F.variant_get(v, "$.list", "array<int>").alias("list"), F.variant_get(t, "$.more", "string").alias("more"),
        (F.variant_get(t, "$.gt_parse.n", "int") == 7).alias("kept"), F.variant_get(t, "$.gt_parse.surname", "string").alias("surname"), F.variant_get(t, "$.gt_parse.personal_number", "string").alias("personal_number"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def json_fields(spark, sf):
    e = read(spark, sf, "events").withColumn("v", jsonx.json_object(F.col("props")))
    return e.where("v IS NOT NULL").select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("SELECT c_custkey AS id, length(c_name) AS c_name_length, c_mktsegment FROM customer")
def redacted_rows(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.struct("c_name", "c_mktsegment").alias("s"))
    return c.select("id", jsonx.redacted(F.col("s"), ["c_name"]).alias("s")).select("id", "s.c_name_length", "s.c_mktsegment")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'reviewed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'bogus' END IN ('pending', 'ocr_done', 'reviewing', 'reviewed', 'error') AS valid FROM orders")
def valid_statuses(spark, sf):
    from quillspark.schema import STATUSES

    status = F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "O", "pending").otherwise("bogus")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), status.isin(STATUSES).alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '/error/' || doc_id || '_mask.jpg' END AS moved_to FROM documents")
def moved_files(spark, sf):
    f = read(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("_mask.jpg")).alias("file_name"))
    return sinks.moved(f, f.where("doc_id % 5 = 0"), "/error").select("doc_id", "moved_to")


@query("SELECT page_id, sha1(lower(url) || '|' || page_id || '|' || length(html))[1:16] AS digest FROM pages")
def portrait_names(spark, sf):
    p = read(spark, sf, "pages")
    name = sinks.portrait_name(F.col("url"), F.col("page_id"), F.length("html"))
    return p.select("page_id", F.regexp_extract(name, "_portrait_([0-9a-f]{16})[.]jpg$", 1).alias("digest"))


@query("SELECT conv_id, turn, regexp_replace(role, '^(.*)$', '\\1_mask') AS made, role AS source FROM conversations")
def reversed_names(spark, sf):
    c = read(spark, sf, "conversations")
    made = ingest.output_name(F.col("role"), "mask")
    return c.select("conv_id", "turn", made.alias("made"), ingest.source_name(made, "mask").alias("source"))


@query("SELECT doc_id, text AS stripped FROM documents WHERE doc_id < 0")
def no_rows(spark, sf):
    return records.lookup(read(spark, sf, "documents"), -1, "doc_id").select("doc_id", text.stripped(F.col("text")).alias("stripped"))
