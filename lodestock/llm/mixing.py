"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's target repetition rate is its share of the target total over its rows. Each document draws its count by
inverting the Poisson distribution of that mean at a uniform number hashed from seed and id, is exploded by the count, and
the copies are dealt over the whole output by the order of a second hash.

Weights: a map from source to weight, or, without one, the square root of each source's rows; either is scaled to sum 1.
Sources without a weight get none. Nulls: a null source is a source of its own (its key in the map is None); a null id
draws like the id "null". Repeated rows of one id draw the same count. Empty texts are rows like any other, an empty table
gives an empty result, and the input's columns named copy, copies or shuffle_key are replaced; no other name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

#: Up to this many sources their rates are broadcast (a few hundred bytes each, 200 * sqrt(rate) for high ones); beyond it they are joined by shuffle.
MOST_BROADCAST = 20_000
SALTS = 64


def hash52(*parts: Column) -> Column:
    """A hash of the parts as a whole number below 2^52, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def _rates(docs: DataFrame, source_col: str, weights: dict | None, total: float | None) -> DataFrame:
    """(source, least, cdf): per source the Poisson probabilities of at most least, least + 1 ... copies, up to where they reach 1.

    Terms start as 1 at `least`, twelve deviations below the rate, are built by ratios and scaled by their sum, so that none
    underflows or overflows at any rate; fewer copies than `least` have together less than 1e-30, the smallest uniform is 1e-16.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").cast("double").alias("rows"))
    if weights is None:
        raw = F.sqrt("rows")
    else:
        given = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()]
        raw = F.coalesce(*given, F.lit(0.0))
    sums = counts.withColumn("raw", raw).agg(F.sum("raw").alias("all_raw"), F.sum("rows").alias("all_rows"))
    rate = F.when(F.col("all_raw") > 0, (F.col("all_rows") if total is None else F.lit(float(total))) * raw / F.col("all_raw") / F.col("rows")).otherwise(F.lit(0.0))
    rated = counts.crossJoin(F.broadcast(sums)).select("source", rate.alias("rate"))  # one row of sums
    wide = 12 * F.sqrt("rate") + 30
    least, last = F.greatest(F.floor(F.col("rate") - wide), F.lit(0)).cast("long"), F.ceil(F.col("rate") + wide).cast("long")
    step = lambda acc, i: F.struct((acc["term"] * F.col("rate") / i).alias("term"), (acc["sum"] + acc["term"] * F.col("rate") / i).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + acc["term"] * F.col("rate") / i)).alias("sums"))
    one = F.lit(1.0)
    scaled = F.aggregate(F.sequence(least + 1, last), F.struct(one.alias("term"), one.alias("sum"), F.array(one).alias("sums")), step, lambda acc: F.transform(acc["sums"], lambda p: p / acc["sum"]))
    return rated.select("source", least.alias("least"), scaled.alias("cdf"))


def mix_sources(docs: DataFrame, *, weights: dict | None = None, total: float | None = None, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The columns of `docs` plus copies (drawn count), copy (from 0) and shuffle_key, in the order of shuffle_key.

    total: expected rows of the result; as many as `docs` has, if None. Rates may be of any size.
    """
    docs = docs.drop("copy", "copies", "shuffle_key")
    of, least, cdf, salt, salt_of = (free_name(docs.columns, n) for n in ("rate_of", "rate_least", "rate_cdf", "salt", "salt_of"))
    rates = _rates(docs, source_col, weights, total).toDF(of, least, cdf)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    same = docs[source_col].eqNullSafe(rates[of])
    if rates.select(of).limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        joined = docs.join(F.broadcast(rates), same)
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
        spread = rates.withColumn(salt_of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, salted[source_col].eqNullSafe(spread[of]) & (salted[salt] == spread[salt_of])).drop(salt, salt_of)
    uniform = (hash52(F.lit(seed), name) + F.lit(0.5)) / F.lit(float(2**52))
    drawn = joined.withColumn("copies", F.col(least) + F.size(F.filter(cdf, lambda p: p <= uniform))).drop(least, cdf, of)
    # no filter on copies: pushed into the join, its lambda may end up below it, where the id is unknown
    places = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    copied = drawn.withColumn("copy", F.explode(places))
    keyed = copied.withColumn("shuffle_key", hash52(F.lit(seed), name, F.col("copy").cast("string")))
    return keyed.orderBy("shuffle_key", id_col, "copy")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "copies", "copy", "shuffle_key")


SQL = """
with counts as (select source, cast(count(*) as double) as n from documents group by source),
rates as (select source, (select sum(n) from counts) * sqrt(n) / (select sum(sqrt(n)) from counts) / n as rate from counts),
cdfs as (select source, j, sum(exp(-rate + j * ln(rate) - case when j = 0 then 0 else lgamma(j + 1) end)) over (partition by source order by j) as p from rates, range(0, 200) t(j) where j <= ceil(rate + 12 * sqrt(rate) + 30)),
drawn as (select d.*, (cast(('0x' || substr(md5('mix:' || d.doc_id), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double as u from documents d),
counted as (select d.*, (select count(*) from cdfs c where c.source is not distinct from d.source and c.p <= d.u) as copies from drawn d)
select doc_id, text, lang, source, cast(copies as bigint) as copies, copy, cast(('0x' || substr(md5('mix:' || doc_id || ':' || copy), 1, 13)) as bigint) as shuffle_key
from (select *, unnest(range(copies)) as copy from counted)
"""
