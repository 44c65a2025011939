"""What the queries over pages shuffle: a few rows a document or line, not one or more a word."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import jsonx
from quillspark.plans.catalog import QUERIES

WORDS, LINES, PAGES = 60, 3, 4
#: Rows a page that a query may shuffle.
MOST = {"code_match": 4, "country_match": 4, "fuzzy_best_match": 60, "word_spans": 4, "token_f1_best_match": 4, "label_payloads": 8, "reading_order": 4, "portraits": 60}


def shuffled_rows(spark, df):
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    df.collect()
    return sum(n for k, n in written().items() if k not in before)


@pytest.mark.parametrize("name", MOST)
def test_words_are_not_shuffled(spark, tmp_path, name):
    texts = ["\n".join(" ".join(f"w{d}{i}{j} x" for j in range(WORDS // 2)) for i in range(LINES)) for d in range(PAGES)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert shuffled_rows(spark, QUERIES[name](spark, str(tmp_path))) <= MOST[name] * PAGES


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["line_boxes", "document_boxes", "ordered_payloads", "reading_order", "label_payloads", "rebuilt_payloads"])
def test_words_are_not_collected(spark, name):
    assert "collect_list" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_faces_are_suppressed_in_the_jvm(spark):
    assert "InPandas" not in plan(QUERIES["kept_faces"](spark, "/root/testdata/sf0.001"))


def test_a_payload_is_parsed_once(spark):
    # The text itself and the text within it.
    assert str(jsonx.fields(F.col("c"))._jc.toString()).count("try_parse_json(") <= 2


@pytest.mark.parametrize("name", ["date_match", "date_overrides", "record_list", "blank_private_field"])
def test_dear_rows_are_dealt_out(spark, name):
    assert "RepartitionByExpression" in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
