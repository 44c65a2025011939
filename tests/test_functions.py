"""Expressions against values derived by hand and against plain Python."""

import math
import unicodedata
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions import dates, geometry, jsonx, scores, text, vectors


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, (list, tuple)) else F.array(*map(F.lit, v)))
    return df.select(column.alias("x")).first().x


def many(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalized_dates(spark):
    given = ["1/2/1999", "01/02/68", "01/02/69", "31/02/2024", "1-2-1999", "1/2-1999", "12/13/2020", "x", "29/02/2023", "29/02/2024", ""]
    want = ["1999-02-01", "2068-02-01", "1969-02-01", "31/02/2024", "1999-02-01", "1/2-1999", "12/13/2020", "x", "29/02/2023", "2024-02-29", ""]
    assert many(spark, dates.normalized, given) == want


def test_dates_with_month_names(spark):
    given = ["5 SEPT 29", "5 SEP 30", "on 07 march 2001.", "5 XYZ 2001", "31 FEB 2001", "1 MAY 99"]
    assert many(spark, dates.month_named, given) == ["2029-09-05", "1930-09-05", "2001-03-07", None, None, "1999-05-01"]


def test_any_date(spark):
    given = ["1.2.1999", " 01 / 02 / 1999 ", "born 3/4/2001 x", "2020-05-06", "6 MAY 2020", "20200506", "2020 5 6", "6 5 2020", "", None, "none"]
    want = ["1999-02-01", "1999-02-01", "2001-04-03", "2020-05-06", "2020-05-06", "", "2020-05-06", "2020-05-06", "", "", ""]
    assert many(spark, dates.any_date, given) == want


def test_signatures(spark):
    got = many(spark, dates.signature, ["2020-05", "2020 13", "1/2/1999", "x", "2020/07"])
    assert [tuple(x) if x else None for x in got] == [(2020, 5, None), None, (1999, 2, 1), None, (2020, 7, None)]


def test_canonical(spark):
    given = ["Éric  O'Né<<il", "ß ﬁ ½ ①", "漢字", "", None, " a-b ", "ŁÓdź"]

    def plain(s):
        if s is None:
            return None
        s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().upper()
        return " ".join("".join(c if c.isalnum() else " " for c in s).split())

    want = [plain(x) for x in given]
    assert want[0] == "ERIC O NE IL"
    assert many(spark, text.canonical, given) == want
    assert many(spark, text.canonical_udf, given) == want
    assert many(spark, text.compact, given)[0] == "ERICONEIL"


def test_tidy_and_stripped(spark):
    assert many(spark, text.tidy, [" a\t\t b\x0c\n\n\nc  ", ""]) == ["a b \nc", ""]
    assert many(spark, text.stripped, [" x\x1c", "  "]) == ["x", ""]


def test_token_f1(spark):
    assert math.isclose(one(spark, text.token_f1(F.lit("A B C"), F.lit("B C D"))), 2 / 3)
    assert one(spark, text.token_f1(F.lit(""), F.lit("A"))) == 0


def test_code_variants(spark):
    assert set(one(spark, text.code_variants(F.lit("sex"), F.lit("female")))) == {"F", "FEMALE", "NU"}
    assert one(spark, text.code_variants(F.lit("passport_type"), F.lit("P"))) == ["P", "P<"]
    assert one(spark, text.code_variants(F.lit("sex"), F.lit(" "))) == []


def test_boxed_tokens_round_half_to_even(spark):
    b = F.expr("named_struct('left', 0, 'top', 0, 'width', 5, 'height', 1)")
    got = one(spark, text.boxed_tokens(F.lit("a b"), b))
    assert [(x.text, x.bbox) for x in got] == [("A", [0, 0, round(5 / 3), 1]), ("B", [round(10 / 3), 0, 5, 1])]


def test_scores(spark):
    country = one(spark, scores.country_score(F.lit("VNM"), F.lit("VNMX")))
    assert (country.score, country.match_type) == (0.92, "contains")
    number = one(spark, scores.identifier_score(F.lit("AB1234567"), F.lit("AB12345")))
    assert math.isclose(number.score, min(0.96, 0.88 + 0.08 * 7 / 9)) and number.match_type == "prefix"
    a, b = "NGUYEN VAN", "NGUYEN VAN AN"
    assert math.isclose(one(spark, scores.ratio(F.lit(a), F.lit(b))), SequenceMatcher(None, a, b).ratio())


def test_region_score(spark):
    line = "P<" + "A" * 42
    line = line[:10] + "<" + line[11:]
    lit = F.lit
    assert one(spark, scores.region_score(lit(line), lit(0), lit(85), lit(90), lit(90), lit(100), lit(100))) == 21
    assert one(spark, scores.region_score(lit("a" * 20), lit(0), lit(0), lit(0), lit(0), lit(100), lit(100))) == 1 + 2


@pytest.mark.parametrize(("score", "want"), [(0.363, "match"), (0.3, "review"), (0.2999, "mismatch")])
def test_decision(spark, score, want):
    assert one(spark, vectors.decision(F.lit(score))) == want


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-2.0), F.lit(0.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert [one(spark, vectors.cosine(x, y)) for x, y in ((a, a), (a, b), (a, zero), (b, a))] == [1.0, -1.0, 0.0, -1.0]


def test_fields_of_payloads(spark):
    given = [r'{"ground_truth":"{\"gt_parse\":{\"sex\":null,\"surname\":\"X\"}}"}', '{"gt_parse": "x"}', '{"gt_parse": null}', "nope", "[1]", "", None, '{"ground_truth": {"gt_parse": {"surname": "Y"}}}', '{"gt_parse": {"surname": 5}}']
    assert [x.surname for x in many(spark, jsonx.fields, given)] == ["X", "", "", "", "", "", "", "", "5"]
    assert all(x.sex == "" for x in many(spark, jsonx.fields, given))


def test_rescue(spark):
    assert [x is not None for x in many(spark, jsonx.rescued, ['a {"b": 1} c', "no", "{", '{"a": {"b": 2}} }'])] == [True, False, False, False]


def test_turns_are_inverse(spark):
    b = geometry.box(F.lit(10), F.lit(20), F.lit(40), F.lit(60))
    for angle, size in ((90, (100, 200)), (180, (100, 200)), (270, (100, 200))):
        w, h = size
        there = one(spark, geometry.turned(F.array(F.lit(10), F.lit(20), F.lit(40), F.lit(60)), F.lit(angle), F.lit(w), F.lit(h)))
        assert there[0] < there[2] and there[1] < there[3]
    back = one(spark, geometry.turned_back(b, F.lit(180), F.lit(100), F.lit(200)))
    assert (back.left, back.top, back.right, back.bottom) == (60, 140, 90, 180)


def test_unions_skip_missing_boxes(spark):
    b = geometry.box(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    none = F.lit(None).cast("struct<left:int,top:int,right:int,bottom:int,width:int,height:int>")
    u = one(spark, geometry.union_of(F.array(b, none, geometry.box(F.lit(0), F.lit(3), F.lit(2), F.lit(9)))))
    assert (u.left, u.top, u.right, u.bottom, u.width, u.height) == (0, 2, 3, 9, 3, 7)


def test_variants_hold_the_usual_forms(spark):
    got = set(many(spark, dates.variants, ["05/06/2020"])[0])
    day = datetime(2020, 6, 5)
    assert {day.strftime(f) for f in ("%Y-%m-%d", "%Y%m%d", "%d/%m/%Y", "%d-%m-%Y", "%d%m%Y", "%y%m%d", "%Y-%m", "%Y%m", "%m-%Y", "%m/%Y")} == got
