"""Providers of vectors and verdicts, and the dashboard's view."""

import pytest
from pyspark.sql import functions as F

from lodestock.functions.embedding import embed
from lodestock.functions.providers import answers_of, call_summary, vectorizer_at
from lodestock.operators import rerank
from lodestock.operators.dashboard import retrieval_view

MODULE = """
import numpy as np
class Vectorizer:
    model_id, dimension = "lengths", 2
    def embed(self, texts):
        return np.array([[len(t), 1.0] for t in texts])
class Other:
    pass
"""


def test_vectorizer_of_a_file(spark, tmp_path):
    (tmp_path / "own_vectors.py").write_text(MODULE)
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, t string")
    got = embed(rows, "t", vectorizer_at(str(tmp_path / "own_vectors.py")), unit=False).collect()
    assert {r["id"]: list(r["vector"]) for r in got} == {1: [3.0, 1.0], 2: [0.0, 1.0]}
    with pytest.raises(TypeError):
        vectorizer_at(str(tmp_path / "own_vectors.py"), "Other")()
    with pytest.raises(Exception):
        vectorizer_at(str(tmp_path / "none.py"))()


class Strict:
    tokens = 0

    def ask(self, scene, questions):
        self.tokens = len(questions)
        if scene == "bad":
            raise ConnectionError("down")
        if scene == "foreign":
            return [("x", rerank.RELATED, 1.0)]
        return [(q["main_sku"], rerank.RELATED, 0.5) for q in questions if q["main_sku"] != "3"]


def test_answers(spark):
    asked = spark.createDataFrame([(s, i // 2, str(i)) for s in ("ok", "bad", "foreign") for i in range(5)], "scene string, batch long, main_sku string")
    answers = answers_of(asked, Strict).cache()
    assert {r["main_sku"] for r in answers.where("scene = 'ok'").collect()} == {"0", "1", "2", "4"}
    assert {r["error"] for r in answers.where("scene = 'bad'").collect()} == {"ConnectionError: down"} and answers.where("scene = 'bad'").count() == 3
    assert call_summary(answers).first()[:] == (9, 3, 5 + 5 + 5)
    assert {r["scene"] for r in rerank.read_answers(answers.where("error is null"), asked).collect()} == {"ok"}
    assert call_summary(answers_of(asked.where("false"), Strict)).first()[:] == (0, 0, 0)


def test_dashboard(spark):
    roles = spark.createDataFrame([("s", 1, "椅", "chair"), ("s", 0, "灯", None), ("t", 0, "桌", "table")], "scene_name string, place int, product_cn string, product_en string")
    found = spark.createDataFrame([("s", "灯", None, "raw_global_candidates", 2, "B"), ("s", "灯", None, "raw_global_candidates", 1, "A"), ("s", "灯", None, "global_candidates", 1, "C")], "scene_name string, product_cn string, product_en string, group string, rank int, main_sku string")
    out = {r["scene_name"]: r["products"] for r in retrieval_view(roles, found, final=True).collect()}
    assert [p["product_cn"] for p in out["s"]] == ["灯", "椅"] and [c["main_sku"] for c in out["s"][0]["raw_global_candidates"]] == ["A", "B"]
    assert out["t"][0]["related_candidates"] == [] and out["s"][0]["canonical_cn"] is None and out["s"][0]["raw_global_candidates"][0]["rrf_score"] is None
    assert [c["main_sku"] for c in retrieval_view(roles, found).where(F.col("scene_name") == "s").first()["products"][0]["global_candidates"]] == ["C"]
