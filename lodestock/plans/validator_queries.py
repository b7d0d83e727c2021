"""Nested documents checked by rules: orders as JSON with planted faults on three levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clues, validators
from ..operators.validators import List, Number, Object, Text
from .registry import query, table

ORDER = Object({"status": Text(choices=("F", "O")), "groups": List(Object({"flag": Text(), "lines": List(Object({"part": Text(), "quantity": Number(1, 40)}), 1, 7)}), 0, 2)})


def order_documents(spark, sf_dir: str) -> DataFrame:
    """(o_orderkey, document): an order's lines by return flag. Returned ones have a blank flag; parts without a discount are numbers instead of names."""
    l = table(spark, sf_dir, "lineitem")
    part = F.when(F.col("l_discount") == 0, F.col("l_partkey").cast("string")).otherwise(F.concat(F.lit('"P'), "l_partkey", F.lit('"')))
    line = F.concat(F.lit('{"part":'), part, F.lit(',"quantity":'), F.col("l_quantity").cast("string"), F.lit("}"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), ",")
    groups = l.groupBy("l_orderkey", "l_returnflag").agg(joined(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", line.alias("t"))).alias("lines"))
    flag = F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag"))
    group = F.concat(F.lit('{"flag":"'), flag, F.lit('","lines":['), "lines", F.lit("]}"))
    per_order = groups.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(joined(F.struct("l_returnflag", group.alias("t"))).alias("groups"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(per_order, "o_orderkey", "left")
    return o.select("o_orderkey", F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","groups":['), F.coalesce("groups", F.lit("")), F.lit("]}")).alias("document"))


FAULTS = """with l as (select *, dense_rank() over (partition by l_orderkey order by l_returnflag) - 1 as i, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_quantity, l_discount) - 1 as j from lineitem where l_orderkey in (select o_orderkey from orders)),
faults as (select o_orderkey, 'status' as path, 'not one of the choices' as problem from orders where o_orderstatus not in ('F', 'O')
union all select l_orderkey, 'groups', 'too many items' from l group by l_orderkey having max(i) > 1
union all select l_orderkey, 'groups[' || i || '].lines', 'too many items' from l group by l_orderkey, i having count(*) > 7
union all select distinct l_orderkey, 'groups[' || i || '].flag', 'blank' from l where l_returnflag = 'R'
union all select l_orderkey, 'groups[' || i || '].lines[' || j || '].part', 'not a text' from l where l_discount = 0
union all select l_orderkey, 'groups[' || i || '].lines[' || j || '].quantity', 'out of bounds' from l where l_quantity > 40)"""


@query(FAULTS + " select * from faults")
def nested_faults(spark, sf_dir):
    return validators.split(order_documents(spark, sf_dir), "document", ORDER, ["o_orderkey"])[1]


@query(FAULTS + " select cast(count(*) as bigint) as sound from orders where o_orderkey not in (select o_orderkey from faults)")
def nested_sound(spark, sf_dir):
    return validators.split(order_documents(spark, sf_dir), "document", ORDER, ["o_orderkey"])[0].agg(F.count("*").alias("sound"))


@query("""with n as (select distinct p_name as name from part), w as (select name, unnest(list_distinct(regexp_extract_all(lower(name), '[0-9a-z]{2,}'))) as key from n),
d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9a-z]{2,}'))) as key from documents)
select doc_id as scene, name as excluded_clue from d join w using (key) group by doc_id, name""")
def text_mentions(spark, sf_dir):
    """Every part's name that a document mentions."""
    needs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scene"), F.col("text").alias("product_cn"), F.lit(None).cast("string").alias("product_en"))
    return clues.purity_violations(needs, table(spark, sf_dir, "part").select(F.col("p_name").alias("clue"))).select("scene", "excluded_clue")
