"""Judges asked in batches, and what a dashboard shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.providers import answers_of, call_summary
from ..operators import rerank
from ..operators.dashboard import retrieval_view
from .registry import query
from .stock_queries import SCENES, scene_candidates


@dataclass
class RuleJudge:
    """A judge without a model: every third SKU doesn't suit, one scene's calls fail."""

    tokens: int = 0

    def ask(self, scene, questions):
        if scene == "BUILDING":
            raise TimeoutError("no answer")
        self.tokens = 7 * len(questions)
        return [(q["main_sku"], rerank.UNRELATED if int(q["main_sku"]) % 3 == 0 else rerank.RELATED, int(q["main_sku"]) % 10 / 10) for q in questions]


def asked_batches(spark, sf_dir: str) -> DataFrame:
    asked = rerank.question_batches(rerank.questions(scene_candidates(spark, sf_dir)), 10)
    return asked.select("scene", F.col("batch").cast("long").alias("batch"), F.col("main_sku").cast("string").alias("main_sku"), "name")


@query(f"with {SCENES} select distinct scene, cast(main_sku as varchar) as main_sku, case when main_sku % 3 = 0 then '{rerank.UNRELATED}' else '{rerank.RELATED}' end as verdict, round(main_sku % 10 / 10.0::double, 6) as probability from sr where scene <> 'BUILDING'")
def judged_answers(spark, sf_dir):
    """Each SKU of a scene asked once, in batches; a batch that fails leaves its SKUs without a verdict."""
    asked = asked_batches(spark, sf_dir)
    answers = answers_of(asked, RuleJudge).where("error is null")
    return rerank.read_answers(answers, asked).withColumn("probability", F.round("probability", 6))


@query(f"""with {SCENES}, n as (select scene, count(distinct main_sku) as n from sr group by scene)
select cast(sum(ceil(n / 10.0)) as bigint) as batches, cast(coalesce(sum(ceil(n / 10.0)) filter (scene = 'BUILDING'), 0) as bigint) as failed, cast(coalesce(sum(7 * n) filter (scene <> 'BUILDING'), 0) as bigint) as tokens from n""")
def judge_calls(spark, sf_dir):
    return call_summary(answers_of(asked_batches(spark, sf_dir), RuleJudge))


@query(f"""with {SCENES} select scene as scene_name, cast(row_number() over (partition by scene order by role_place) - 1 as integer) as place, role as product_cn, string_agg(cast(main_sku as varchar), ',' order by rank) as global_skus,
 coalesce(string_agg(cast(main_sku as varchar), ',' order by rank) filter (main_sku % 2 = 0), '') as country_skus from sr group by scene, role, role_place""")
def dashboard_view(spark, sf_dir):
    """Scenes with their roles as products; even SKUs are those of the country."""
    c = scene_candidates(spark, sf_dir).withColumn("product_cn", F.col("role")).withColumn("product_en", F.lit(None).cast("string")).withColumnRenamed("scene", "scene_name")
    roles = c.select("scene_name", F.col("role_place").alias("place"), "product_cn", "product_en").distinct()
    shown = c.withColumn("group", F.explode(F.when(F.col("main_sku") % 2 == 0, F.array(F.lit("global_candidates"), F.lit("country_candidates"))).otherwise(F.array(F.lit("global_candidates")))))
    flat = retrieval_view(roles, shown).select("scene_name", F.posexplode("products").alias("place", "p"))
    skus = lambda g: F.array_join(F.transform(F.col(f"p.{g}_candidates"), lambda x: x["main_sku"].cast("string")), ",").alias(f"{g}_skus")
    return flat.select("scene_name", "place", F.col("p.product_cn").alias("product_cn"), skus("global"), skus("country"))
