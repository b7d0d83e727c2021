"""Text expressions on literals, CJK among them."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestock.functions import text as tx


def one(spark, value, make):
    df = spark.createDataFrame([(value,)], "v string").withColumn("n", tx.normalize_compare(F.col("v")))
    return df.select(make(F.col("n")).alias("x")).first()[0]


@pytest.mark.parametrize(("raw", "normal"), [(None, ""), ("  Ａ\tＢ\nＣ  ", "A B C"), (" 40L防水袋 ", "40L防水袋"), ("é é", "é é")])
def test_normalize(spark, raw, normal):
    assert one(spark, raw, lambda n: n) == normal


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=40))
def test_normalize_as_python_does(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").withColumn("n", tx.normalize_compare(F.col("v"))).orderBy("i").collect()
    assert [r["n"] for r in rows] == [" ".join(unicodedata.normalize("NFKC", v).split()) for v in values]


@pytest.mark.parametrize("raw", ["0", " １ ", "无", "n-a", "N/A", "NULL", "unknown", "未知", "", None])
def test_placeholders(spark, raw):
    assert one(spark, raw, tx.clean_optional) is None


@pytest.mark.parametrize("raw", ["40L防水袋", "16寸风扇", "N/A防水袋", "1号收纳箱"])
def test_names_that_are_none(spark, raw):
    assert one(spark, raw, tx.clean_optional) == raw


@pytest.mark.parametrize(("raw", "cut"), [("露营折叠桌 链接拍红色款", "露营折叠桌"), ("链接拍专用防水袋", "链接拍专用防水袋"), ("40L防水袋采购看供应商", "40L防水袋"), ("0 链接拍红色", "0 链接拍红色")])
def test_operational_text(spark, raw, cut):
    assert one(spark, raw, tx.truncate_operational) == cut


@pytest.mark.parametrize(("raw", "tokens"), [("AB露营折叠椅2人x", ["AB", "露营", "营折", "折叠", "叠椅", "2", "人", "x"]), ("Camp camp Camp", ["Camp", "camp"]), ("灯", ["灯"]), ("!!", [])])
def test_query_tokens(spark, raw, tokens):
    assert one(spark, raw, tx.keyword_tokens) == tokens


def test_index_tokens(spark):
    assert one(spark, "T恤", lambda n: tx.index_text(F.array(n))) == "T恤 T"
    assert one(spark, "户外灯", lambda n: tx.index_text(F.array(n))) == "户外灯 户 外 灯 户外 外灯"


def test_identifiers(spark):
    p = tx.identifiers_pattern(F.array(F.lit("SKU-1"), F.lit("SKU-10")))
    assert one(spark, "灯 sku-10 (SKU-1) SKU-100", lambda n: tx.remove_identifiers(n, p)) == "灯 ( ) SKU-100"
    assert one(spark, "SKU-100", lambda n: tx.mentions_identifier(n, F.lit("SKU-10"))) is False


def test_vector_names(spark):
    df = spark.createDataFrame([(["长名字一二三", "短", "短", "未知"],)], "a array<string>")
    assert df.select(tx.vector_text(F.col("a"))).first()[0] == "商品名称：短；长名字一二三"


@pytest.mark.parametrize(("status", "platform", "banned"), [("shopee 禁售", "shopee", True), ("shopee2 禁售", "shopee", False), ("虾皮-禁售", "虾皮", True), ("大虾皮禁售", "虾皮", False), ("shopee ok", "shopee", False), ("shopee banned", None, False)])
def test_platform_bans(spark, status, platform, banned):
    df = spark.createDataFrame([(status, platform)], "s string, p string")
    assert df.select(tx.platform_banned(F.col("s"), F.col("p"))).first()[0] is banned


@pytest.mark.parametrize(("text", "name", "found"), [("CCTV camera", "cctv线", True), ("监控存储卡", "存储卡", True), ("lamp", "tent", False), ("存储", "存储卡", False)])
def test_mentions(spark, text, name, found):
    assert spark.createDataFrame([(text, name)], "t string, n string").select(tx.mentions(F.col("t"), F.col("n"))).first()[0] is found


def test_numbers_and_countries(spark):
    df = spark.createDataFrame([("1,200.5", "泰国"), ("", "ph"), ("x", "??"), (None, None)], "n string, c string")
    assert [r[0] for r in df.select(tx.number(F.col("n"))).collect()] == [1200.5, 0, 0, 0]
    assert [r[0] for r in df.select(tx.country_code(F.col("c"))).collect()] == ["TH", "PH", None, None]
    with pytest.raises(Exception, match="invalid quantity"):
        df.select(tx.number(F.col("n"), strict=True)).collect()


def test_clue_parts(spark):
    assert spark.createDataFrame([("灯具、椅,桌子",)], "c string").select(tx.split_clue(F.col("c"))).first()[0] == ["灯具", "桌子"]
    assert spark.createDataFrame([("a,b",)], "c string").select(tx.split_clue(F.col("c"))).first()[0] == ["a,b"]
