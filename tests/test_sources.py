"""Readers and writers on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import exports as E
from tallyloom.sources import files as S
from tallyloom.sources import tables as T

RECORD = {
    "goodsNo": "G1", "goodsNm": "셔츠", "price": 29900, "thumbnailImageUrl": "t", "url": "u",
    "goodsImages": ["a", "b"], "goodsMaterial": {"소재": "면", "핏": "루즈"},
    "size_stock": [{"size": "M", "is_sold_out": False, "stock_qty": 999}], "colors": [{"color_code": "01", "color_name": "red", "icon_url": "i"}],
}


def test_raw_json(spark, tmp_path):
    (tmp_path / "zara_men_top_G1.json").write_text(json.dumps(RECORD, ensure_ascii=False, indent=4), encoding="utf-8")
    row = S.read_raw_json(spark, str(tmp_path / "*.json")).first()
    assert row["price"] == "29900" and row["goodsMaterial"] == {"소재": "면", "핏": "루즈"}
    assert row["file_path"].endswith("zara_men_top_G1.json") and row["product_code"] is None
    assert row["size_stock"][0]["stock_qty"] == 999


def test_partitions_are_replaced_alone(spark, tmp_path):
    root = str(tmp_path / "raw")
    rows = [("zara", "20240101", "a"), ("zara", "20240102", "b"), ("uniqlo", "20240101", "c")]
    T.write_partition(spark.createDataFrame(rows, "brand string, dt string, goodsNo string"), root)
    T.write_partition(spark.createDataFrame([("zara", "20240102", "B")], "brand string, dt string, goodsNo string"), root)
    assert [r["goodsNo"] for r in S.read_partition(spark, root, "zara", "20240102").collect()] == ["B"]
    assert S.read_partition(spark, root, "zara", "20240101").first()["brand"] == "zara"
    assert spark.read.json(root).count() == 3


def test_json_docs_roots(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"product_id": "a", "x": 1}')
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "many.json").write_text('[{"product_id": "b", "x": 2},\n {"product_id": "c", "x": 3}]')
    (tmp_path / "skip.txt").write_text("no")
    schema = "product_id string, x int"
    assert S.read_json_docs(spark, str(tmp_path), schema).count() == 3
    assert S.read_json_docs(spark, str(tmp_path / "*.json"), schema).count() == 1
    (tmp_path / "bad.json").write_text('"text"')
    with pytest.raises(Exception):
        S.read_json_docs(spark, str(tmp_path), schema).collect()


def test_catalog_csv(spark, tmp_path):
    text = "﻿product_id,base_price,prod_name\n" + "x" * 25 + ",12.9,\"a, b\"\np2,,n\np2,7,again\nknown,1,k\n"
    path = tmp_path / "products.csv"
    path.write_text(text, encoding="utf-8")
    known = spark.createDataFrame([("known",)], "product_id string")
    rows = {r["product_id"]: r for r in S.import_catalog_csv(spark, str(path), known).collect()}
    assert set(rows) == {"x" * 20, "p2"}
    assert rows["x" * 20]["base_price"] == 12 and rows["x" * 20]["prod_name"] == "a, b" and rows["x" * 20]["gender"] == ""


def test_catalog_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"product_id": "p1", "base_price": "abc", "origine_url": "http://o"}))
    (tmp_path / "b.json").write_text(json.dumps({"product_id": "p2", "base_price": "19.5"}))
    rows = {r["product_id"]: r for r in S.import_catalog_json(spark, str(tmp_path / "*.json")).collect()}
    assert (rows["p1"]["base_price"], rows["p1"]["origin_url"], rows["p2"]["base_price"]) == (0, "http://o", 19)


def test_scan_images(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, size in (("a/big.jpg", 6000), ("a/BIG.PNG", 5120), ("small.jpg", 5119), ("doc.txt", 9000)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = S.scan_images(spark, str(tmp_path))
    assert sorted(r["path"].split("/")[-1] for r in got.collect()) == ["BIG.PNG", "big.jpg"]
    assert "content" not in got.columns


def test_tail_lines(spark, tmp_path):
    (tmp_path / "c.log").write_text("2024-01-01T12:00:00.123456789Z hello world\n\nalone\n")
    rows = S.read_tail_lines(spark, str(tmp_path / "c.log"), dt.datetime(2024, 2, 1)).collect()
    assert [(r["timestamp"], r["message"]) for r in rows] == [("2024-01-01T12:00:00.123Z", "hello world"), ("2024-02-01T00:00:00Z", "alone")]


def test_exports(spark, tmp_path):
    products = spark.createDataFrame(
        [("p1", "ZARA", "m1", "n1", 10), ("p2", "ZARA", "m2", "n2", 20)], "product_id string, brand_name string, model_code string, prod_name string, base_price int"
    )
    matched = spark.createDataFrame([("p1", 2, "t2", 9, "B", "ub"), ("p1", 1, "t1", 8, "A", "ua")], "product_id string, rank int, title string, price int, mall_name string, mall_url string")
    E.export_csv_topk(products, matched, str(tmp_path / "csv"))
    flat = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("product_id", "rank").collect()
    assert [(r["product_id"], r["rank"], r["offer_price"]) for r in flat] == [("p1", "1", "8"), ("p1", "2", "9"), ("p2", "-", "-")]
    E.export_json_nested(products, matched, str(tmp_path / "json"))
    docs = {r["product_id"]: r for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert [o["mall_name"] for o in docs["p1"]["top_5_results"]] == ["A", "B"] and docs["p2"]["top_5_results"] == []


def test_log_text(spark):
    logs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "ERROR", "s", "c", "a\nb")], "event_id int, timestamp timestamp_ntz, level string, service string, container string, message string")
    assert E.log_text(logs).first()["line"] == "[2024-01-01 00:00:00] [ERROR] [s] c - a  b"
    assert E.log_text(logs, size=1).count() == E.log_text(logs).count() == 1


def test_truncate_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    T.append_table(spark.range(5), path)
    T.append_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 10
    T.truncate_tables(spark, [path])
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id"]


def test_scan_selects_and_filters(spark):
    df = T.scan(spark.range(10).withColumn("x", F.lit(1)), F.col("id") == 3, ["id"])
    assert df.columns == ["id"] and df.count() == 1
