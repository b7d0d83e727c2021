"""Rules of nested documents, with faults on every level, and mentions joined against brute force."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestock.operators import clues, validators


def faults(spark, rule, *documents):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(documents)], "id int, doc string")
    out = {r["id"]: [tuple(f) for f in r["faults"]] for r in validators.checked(rows, "doc", rule).collect()}
    return [out[i] for i in range(len(documents))]


def changed(document, *changes):
    out = []
    for path, value in changes:
        d = at = copy.deepcopy(document)
        for step in path[:-1]:
            at = at[step]
        if value is KeyError:
            del at[path[-1]]
        else:
            at[path[-1]] = value
        out.append(d)
    return out


EXPANSIONS = {"model": "m", "scenes": [{"scene_name": "s", "products": [{"product_cn": "椅", "product_en": "chair", "canonical_cn": "椅", "canonical_en": "chair", "expanded_cn": [], "expanded_en": ["seat"]}]}]}


def test_expansions(spark):
    p = ("scenes", 0, "products", 0)
    wrong = changed(
        EXPANSIONS, (("model",), "other"), (("scenes",), []), (("scenes", 0, "more"), 1), (("scenes", 0, "scene_name"), "  "), ((*p, "product_en"), 5), ((*p, "expanded_en"), "seat"), ((*p, "expanded_en"), ["a"] * 7),
        ((*p, "expanded_cn"), ["x", None, ""]), ((*p, "canonical_cn"), KeyError), (p, ["list"]), (("scenes",), {"a": 1}), ((*p, "product_cn"), True),
    )
    got = faults(spark, validators.expansions_rule("m"), EXPANSIONS, *wrong, "no json", None, "[]", "3")
    at = "scenes[0].products[0]"
    assert got == [
        [], [("model", "not one of the choices")], [("scenes", "too few items")], [("scenes[0].more", "unexpected")], [("scenes[0].scene_name", "blank")], [(f"{at}.product_en", "not a text")], [(f"{at}.expanded_en", "not a list")],
        [(f"{at}.expanded_en", "too many items")], [(f"{at}.expanded_cn[1]", "not a text"), (f"{at}.expanded_cn[2]", "blank")], [(f"{at}.canonical_cn", "missing")], [(at, "not an object")], [("scenes", "not a list")], [(f"{at}.product_cn", "not a text")],
        [("", "not JSON")], [("", "not JSON")], [("", "not an object")], [("", "not an object")],
    ]


def test_recognition(spark):
    product = {"name_cn": "灯", "name_en": "", "role": "不确定", "confidence": 0.5, "evidence": ""}
    image = {"filename": "a.png", "products": [product]}
    good = {"images": [image, {"filename": "b.png", "products": [], "sales_rows": [1], "sales_warnings": []}]}
    older = {"images": [{"filename": "a.png", "products": [{"name": "灯", "role": "不确定", "confidence": 1, "evidence": "x"}]}]}
    p = ("images", 0, "products", 0)
    wrong = changed(good, ((*p, "confidence"), True), ((*p, "confidence"), 1.2), ((*p, "role"), "main"), ((*p, "evidence"), None), (("images", 1, "filename"), "a.png"), (("images", 1, "odd"), 1), (("images", 0, "products"), [product] * 201))
    got = faults(spark, validators.recognition_rule(), good, older, *wrong)
    at = "images[0].products[0]"
    assert got == [[], [], [(f"{at}.confidence", "not a number")], [(f"{at}.confidence", "out of bounds")], [(f"{at}.role", "not one of the choices")], [(f"{at}.evidence", "not a text")], [("images", "items share filename")], [("images[1].odd", "unexpected")], [("images[0].products", "too many items")]]


def test_scenes_products_and_synthesis(spark):
    scene = lambda n, **more: {"scene_name": n, "audience": "a", "user_need": "u", "evidence": "e"} | more
    scenes = {"model": "m", "scenes": [scene(str(i), scope_in=["x", 1]) for i in range(5)]}
    wrong = changed(scenes, (("scenes",), scenes["scenes"][:3]), (("scenes", 1, "scene_name"), " 0 "), (("scenes", 2, "scope_in"), ["", 3]), (("scenes", 2, "scope_out"), ["x"] * 9))
    assert faults(spark, validators.scenes_rule("m"), scenes, *wrong) == [[], [("scenes", "too few items")], [("scenes", "items share scene_name")], [("scenes[2].scope_in", "no usable lines")], [("scenes[2].scope_out", "no usable lines")]]
    products = {"model": "m", "products": [{"product_cn": "a", "product_en": None, "purpose": 1}] * 2}
    assert faults(spark, validators.products_rule("m"), products, *changed(products, (("products",), []), (("products", 1), {}))) == [
        [], [("products", "too few items")], [(f"products[1].{n}", "missing") for n in ("product_cn", "product_en", "purpose")]]
    section, three = {"judgement": "j", "evidence": "e", "more": 1}, ["1", "2", "3"]
    whole = {
        "model": "m", "manager_summary": {"executive_conclusion": "a", "business_opportunity": "b", "decision_boundary": "c", "recommended_actions": list(three)}, "store_profile": section, "current_product_structure": section,
        "audiences": [{"audience_name": "a", "description": "d", "evidence": "e"}], "future_product_structure": section | {"priority_order": three}, "operation_strategy": [{"strategy_name": "s", "description": "d", "evidence": "e"}],
    }
    wrong = changed(whole, (("manager_summary", "recommended_actions"), three[:2]), (("audiences", 0, "evidence"), " "), (("future_product_structure", "priority_order", 1), 2), (("store_profile",), []))
    assert faults(spark, validators.synthesis_rule("m"), whole, *wrong) == [[], [("manager_summary.recommended_actions", "too few items")], [("audiences[0].evidence", "blank")], [("future_product_structure.priority_order[1]", "not a text")], [("store_profile", "not an object")]]


def test_split(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": "x", "b": 2}'), (3, None)], "id int, doc string")
    good, bad = validators.split(rows, "doc", validators.Object({"a": validators.Number()}), ["id"])
    assert [r["id"] for r in good.collect()] == [1] and sorted(map(tuple, bad.collect())) == [(2, "a", "not a number"), (2, "b", "unexpected"), (3, "", "not JSON")]


def brute(text, name):
    words = lambda t: set(re.findall("[0-9a-z]{2,}", t.lower()))
    runs = lambda t: re.findall("[一-鿿]{2,}", t)
    return bool(words(text) & words(name)) or any(part in run for part in runs(name) for run in runs(text))


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions(spark, seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(["折叠", "椅", "户外", "桌", "灯", " ", "x1 ", "Chair ", "-", "露营"]) for _ in range(n))
    needs = [(i, make(6) if i % 9 else None, make(2) if i % 4 else None) for i in range(80)] + [(7, "折叠椅", "x1")] * 2
    names = [make(3) for _ in range(40)] + [None, "", "椅", "折叠椅"]
    got = clues.purity_violations(spark.createDataFrame(needs, "scene int, product_cn string, product_en string"), spark.createDataFrame([(n,) for n in names], "clue string"))
    text = lambda cn, en: f"{cn or ''} {en or ''}"
    want = sorted(((s, cn, n) for s, cn, en in needs for n in {n for n in names if n is not None} if brute(text(cn, en), n)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_very_many_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("name"), "id").alias("clue"))
    needs = spark.range(0, 100_000, 1000).select(F.col("id").alias("scene"), F.concat(F.lit("a NAME"), "id").alias("product_cn"), F.lit(None).cast("string").alias("product_en"))
    got = clues.purity_violations(needs, names)
    assert got.count() == 100 and got.where("lower(product_cn) <> concat('a ', excluded_clue)").count() == 0


def test_a_document_is_read_once(spark):
    """Levels multiply nothing: the parser is named once in the plan of any rule, and no filter checks documents a second time before their faults are listed."""
    Object, List, Text, Number = validators.Object, validators.List, validators.Text, validators.Number
    rule = Object({"a": List(Object({"b": Object({"c": List(Object({"d": Text()}), 1, 2)}), "n": Number(0, 5)}), 1, 3)})
    rows = spark.createDataFrame([(1, '{"a":[{"b":{"c":[{"d":null},{"d":" "},{}]},"n":9}]}'), (2, '{"a":[{"b":{"c":[{"d":"x"}]},"n":1}]}'), (3, '{"a":[{"b":{"c":null}}]}'), (4, "[")], "id int, j string")
    good, bad = validators.split(rows, "j", rule, ["id"])
    assert [r.id for r in good.collect()] == [2]
    assert sorted(map(tuple, bad.collect())) == [
        (1, "a[0].b.c", "too many items"), (1, "a[0].b.c[0].d", "not a text"), (1, "a[0].b.c[1].d", "blank"), (1, "a[0].b.c[2].d", "missing"), (1, "a[0].n", "out of bounds"),
        (3, "a[0].b.c", "not a list"), (3, "a[0].n", "missing"), (4, "", "not JSON"),
    ]
    for d in (good, bad):
        assert d._jdf.queryExecution().optimizedPlan().toString().count("parseJson") + d._jdf.queryExecution().optimizedPlan().toString().count("parse_json(") == 1
