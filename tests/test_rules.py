"""Hand-written rows that pin the edges of the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import catalog as G
from tallyloom.functions import documents as DF
from tallyloom.functions import logs as L
from tallyloom.functions import predicates as P
from tallyloom.functions import text as X
from tallyloom.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, code",
    [("zara_Men_Bottom_00108309_0.jpg", "00108309"), ("a_b_c_12345.jpg", "12345"), ("x/plain.jpg", "plain"), ("a_7.png", "a")],
)
def test_code_from_filename(spark, name, code):
    assert one(spark, DF.code_from_filename(F.lit(name))) == code


@pytest.mark.parametrize(
    "message, level",
    [
        ('GET /x?ERROR HTTP/1.1" 200', "INFO"),
        ('GET /x?ERROR HTTP/1.1" 500', "ERROR"),
        ("critical error", "ERROR"),
        ("warning: critical", "WARN"),
        ("fatal: stop", "CRITICAL"),
        ("all fine", "INFO"),
    ],
)
def test_infer_log_level(spark, message, level):
    assert one(spark, L.infer_log_level(F.lit(message))) == level


@pytest.mark.parametrize(
    "line, level, message",
    [
        ('{"s":"F","msg":"m"}', "CRITICAL", "m"),
        ('{"s":"D","msg":"m"}', "INFO", "m"),
        ('{"s":"E"}', "INFO", '{"s":"E"}'),
        ('{"a":"error"}', "ERROR", '{"a":"error"}'),
        ("{broken error", "ERROR", "{broken error"),
    ],
)
def test_parse_log_line(spark, line, level, message):
    row = one(spark, L.parse_log_line(F.lit(line)))
    assert (row["level"], row["message"]) == (level, message)


@pytest.mark.parametrize(
    "code, cleaned, valid", [("AB-12_3", "AB", True), ("A_1-2", "A", True), ("", "", False), ("ABCDEFGHIJK", "ABCDEFGHIJK", False)]
)
def test_clean_model_code(spark, code, cleaned, valid):
    column = X.clean_model_code(F.lit(code))
    assert one(spark, column) == cleaned
    assert one(spark, X.is_valid_code(column)) is valid


@pytest.mark.parametrize("base, price, kept", [(1000, 300, False), (1000, 301, True), (1000, 2499, True), (1000, 2500, False), (0, 5, True)])
def test_plausible_price(spark, base, price, kept):
    assert one(spark, P.plausible_price(F.lit(price), F.lit(base))) is kept


@pytest.mark.parametrize("price, clean", [(400, False), (401, True), (1999, True), (2000, False)])
def test_refine_band(spark, price, clean):
    assert one(spark, P.refine_band(F.lit(price), F.lit(1000))) is clean
    assert one(spark, P.outside_refine_band(F.lit(price), F.lit(1000))) is not clean


@pytest.mark.parametrize(
    "code_query, exact, similarity, kept",
    [(False, False, 0.34, False), (False, False, 0.35, True), (False, True, 0.175, True), (True, False, 1.0, False), (True, True, 0.17, False), (True, True, 0.2, True)],
)
def test_similarity_gate(spark, code_query, exact, similarity, kept):
    assert one(spark, P.similarity_gate(F.lit(code_query), F.lit(exact), F.lit(similarity))) is kept


def test_discount(spark):
    difference, rate = G.discount(F.lit(1000), F.lit(1155))
    assert (one(spark, difference), one(spark, rate)) == (-155, -15)
    assert one(spark, G.discount(F.lit(0), F.lit(5))[1]) == 0


def test_core_keywords(spark):
    assert one(spark, X.core_keywords(F.lit("[여성] ZARA 린넨 셔츠 2024 블루 신상 롱"))) == "린넨 셔츠 블루"
    assert one(spark, X.core_keywords(F.lit("정품 2024"))) == "정품 2024"
    assert one(spark, X.core_keywords(F.lit(None).cast("string"))) == ""


def test_search_queries(spark):
    rows = one(spark, X.search_queries(F.lit("Zara"), F.lit("linen shirt"), F.lit("AB-1")))
    assert [(r["kind"], r["query"]) for r in rows] == [
        ("ko_name", "자라 linen shirt"), ("en_name", "zara linen shirt"), ("ko_code", "자라 AB"), ("en_code", "zara AB"),
    ]


def test_title_similarity(spark):
    pairs = [("린넨 셔츠", "린넨 셔츠 긴팔"), ("abc", "ABC def"), ("abcd", "abxd"), ("", "x"), ("x", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["s"] for r in df.select(X.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([1.0, 1.0, 0.75, 0.0, 0.0])


def test_log_lines_are_whole_objects(spark):
    lines = {
        '{"s":"E","msg":"x"}': ("ERROR", "x"),
        '{"s":"E","msg":"x"} tail': ("INFO", '{"s":"E","msg":"x"} tail'),
        '{"s":"I","msg":"an error"} more': ("ERROR", '{"s":"I","msg":"an error"} more'),
        '{"s":"F","msg":null}': ("CRITICAL", None),
        '{"s":null,"msg":"y"}': ("INFO", "y"),
        '{"msg":"warning"}': ("WARN", '{"msg":"warning"}'),
        '["s","msg"]': ("INFO", '["s","msg"]'),
        "plain": ("INFO", "plain"),
    }
    df = spark.createDataFrame([(line,) for line in lines], "m string")
    got = {r["m"]: tuple(r["p"]) for r in df.select("m", L.parse_log_line(F.col("m")).alias("p")).collect()}
    assert got == lines


def test_active_hours_wrap(spark):
    def at(hour):  # Seoul is nine hours ahead
        return F.lit(dt.datetime(2024, 1, 1, (hour - 9) % 24)).cast("timestamp_ntz")

    assert one(spark, L.in_active_hours(at(23), 22, 6)) is True
    assert one(spark, L.in_active_hours(at(6), 22, 6)) is False
    assert one(spark, L.in_active_hours(at(12), None, 6)) is True


def test_expand_category(spark):
    def spell(*words):
        return one(spark, X.expand_category(F.array(*[F.lit(w) for w in words])))

    assert spell("TOP", "상의") == ["top", "Top", "상의"]
    assert spell("sHoes", " ") == ["sHoes", "shoes", "Shoes"]


def test_filter_list_and_legacy(spark):
    assert one(spark, X.parse_filter_list(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(spark, X.parse_filter_list(F.lit("  "))) is None
    gender, category = X.split_legacy_filter(F.lit("men_top_x"), F.lit(None).cast("string"))
    assert (one(spark, gender), one(spark, category)) == ("men", "top_x")


def test_filter_attr_keys(spark):
    assert one(spark, X.filter_attr_keys(F.lit('{"소재":"면","교환 및 반품":"x"}'))) == '{"소재":"면"}'
    assert one(spark, X.filter_attr_keys(F.lit("{nope"))) == "{}"
    assert one(spark, X.filter_attr_keys(F.lit(None).cast("string"))) == "{}"


def test_json_payload(spark):
    assert one(spark, X.extract_json_payload(F.lit('```json\nok {"a": {"b": 1}} bye\n```'))) == '{"a": {"b": 1}}'
    assert one(spark, X.extract_json_payload(F.lit("{oops} {"))) is None


def test_vectors(spark):
    assert one(spark, V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    df = spark.createDataFrame([([1.0], [2.0], "x")], "text_vector array<double>, embedding array<float>, b_vector string")
    assert V.detect_vector_fields(df.schema) == ["text_vector"]
    assert V.detect_vector_fields(df.drop("text_vector").schema) == ["embedding"]
    with pytest.raises(ValueError):
        V.detect_vector_fields(df.select("b_vector").schema)


def test_counters(spark):
    assert one(spark, L.cpu_percent(F.lit(20), F.lit(10), F.lit(200), F.lit(100))) == 10.0
    assert one(spark, L.cpu_percent(F.lit(5), F.lit(10), F.lit(200), F.lit(100))) == 0.0
    assert one(spark, L.cpu_percent(F.lit(5), F.lit(10), F.lit(200), F.lit(100), strict=False)) == -5.0
    assert one(spark, L.memory_percent(F.lit(5), F.lit(0))) == 0.0


def test_audit_columns(spark):
    stamp = F.lit(dt.datetime(2024, 5, 1)).cast("timestamp")
    row = spark.range(1).select(*G.audit_columns(stamp)).first()
    assert row["create_dt"] == row["update_dt"] is not None


@pytest.mark.parametrize("number, text", [(7, "ZR0007"), (9999, "ZR9999"), (10001, "ZR10001")])
def test_surrogate_id_grows(spark, number, text):
    assert one(spark, G.surrogate_id("ZR", F.lit(number))) == text
