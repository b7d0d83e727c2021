"""Rules of nested documents, compiled to one expression that gives every fault its path.

A document is JSON as a model wrote it, so that a field may hold any type: it is read as a variant, and nothing is coerced before it is
checked. A rule is a tree of the classes below; `faults` turns it into higher-order functions over the variant, one level of lambda for each
level of lists, and all documents are checked in the scan, without a shuffle and without Python.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULTS = "array<struct<path:string,problem:string>>"


@dataclass(frozen=True)
class Rule:
    """Anything."""

    def faults(self, value: Column, path: Column) -> Column:
        return _none()


def _none() -> Column:
    return F.array().cast(FAULTS)


def _named(path: Column, problem: Column) -> Column:
    """The fault of a problem that is null where there is none."""
    return F.when(problem.isNull(), _none()).otherwise(F.array(F.struct(path.alias("path"), problem.alias("problem"))).cast(FAULTS))


def _fault(path: Column, problem: str, when: Column) -> Column:
    return F.when(when, F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem"))).cast(FAULTS)).otherwise(_none())


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` a value that is computed once, however often `of` names it: as the variable of a lambda. Named outright, a field's value would be read from its parent's anew at each use, and so on up to the parser."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _if_there(rule: Rule, path: Column, absent: Column) -> Callable[[Column], Column]:
    return lambda value: F.when(value.isNull(), absent).otherwise(rule.faults(value, path))


def _kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, OBJECT<..> or ARRAY<..>; empty where there is no value."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _is_number(value: Column) -> Column:
    return _kind(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")


@dataclass(frozen=True)
class Text(Rule):
    """A text, not blank unless `blank`, one of `choices` if given."""

    blank: bool = False
    choices: tuple[str, ...] = ()

    def faults(self, value: Column, path: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        problem = F.when(_kind(value) != "STRING", "not a text")
        if self.choices:
            problem = problem.when(~text.isin(*self.choices), "not one of the choices")
        elif not self.blank:
            problem = problem.when(F.trim(text) == "", "blank")
        return _named(path, problem)


@dataclass(frozen=True)
class Number(Rule):
    """A number, which true and false are not, within bounds."""

    least: float | None = None
    most: float | None = None

    def faults(self, value: Column, path: Column) -> Column:
        def bounded(n: Column) -> Column:
            out = F.lit(False)
            if self.least is not None:
                out = out | (n < self.least)
            if self.most is not None:
                out = out | (n > self.most)
            return out

        outside = _once(F.try_variant_get(value, "$", "double"), bounded)
        return _named(path, F.when(~_is_number(value), "not a number").when(outside, "out of bounds"))


@dataclass(frozen=True)
class Object(Rule):
    """An object with all of `fields`, any of `optional` and, unless `more`, no other."""

    fields: Mapping[str, Rule]
    optional: Mapping[str, Rule] = field(default_factory=dict)
    more: bool = False

    def faults(self, value: Column, path: Column) -> Column:
        at = lambda name: F.concat(path, F.when(path == "", "").otherwise("."), F.lit(name) if isinstance(name, str) else name)

        def inside(members: Column) -> Column:
            parts = []
            for required, rules in ((True, self.fields), (False, self.optional)):
                for name, rule in rules.items():
                    absent = _fault(at(name), "missing", F.lit(True)) if required else _none()
                    if type(rule) is Rule:
                        parts.append(F.when(F.map_contains_key(members, F.lit(name)), _none()).otherwise(absent))
                    else:  # a member that is there is no null: JSON's own is a variant
                        parts.append(_once(F.try_element_at(members, F.lit(name)), _if_there(rule, at(name), absent)))
            if not self.more:
                odd = F.array_sort(F.array_except(F.map_keys(members), F.array(*[F.lit(n) for n in (*self.fields, *self.optional)])))
                parts.append(F.transform(odd, lambda k: F.struct(at(k).alias("path"), F.lit("unexpected").alias("problem"))).cast(FAULTS))
            return F.concat(*parts)

        members = F.try_variant_get(value, "$", "map<string,variant>")
        return _once(members, lambda m: F.when(m.isNull(), _fault(path, "not an object", F.lit(True))).otherwise(inside(m)))


@dataclass(frozen=True)
class List(Rule):
    """A list of `least` to `most` items; `unique`: a field of the items that no two share, white space at its ends aside."""

    item: Rule
    least: int = 0
    most: int | None = None
    unique: str | None = None

    def faults(self, value: Column, path: Column) -> Column:
        def inside(items: Column) -> Column:
            parts = [_fault(path, "too few items", F.size(items) < self.least)]
            if self.most is not None:
                parts.append(_fault(path, "too many items", F.size(items) > self.most))
            if self.unique:
                named = F.filter(F.transform(items, lambda x: F.trim(F.try_variant_get(x, f"$['{self.unique}']", "string"))), lambda n: n.isNotNull())
                parts.append(_fault(path, f"items share {self.unique}", F.size(F.array_distinct(named)) < F.size(named)))
            parts.append(F.flatten(F.transform(items, lambda x, i: self.item.faults(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
            return F.concat(*parts)

        items = F.try_variant_get(value, "$", "array<variant>")
        return _once(items, lambda i: F.when(i.isNull(), _fault(path, "not a list", F.lit(True))).otherwise(inside(i)))


@dataclass(frozen=True)
class Lines(Rule):
    """A list of at most `most` items, of which one at least is a text that is not blank; what is no text counts as no line."""

    most: int

    def faults(self, value: Column, path: Column) -> Column:
        items = F.try_variant_get(value, "$", "array<variant>")
        usable = F.exists(items, lambda x: (_kind(x) == "STRING") & (F.trim(F.try_variant_get(x, "$", "string")) != ""))
        return _fault(path, "no usable lines", ~(_kind(value).startswith("ARRAY") & (F.size(items) <= self.most) & F.coalesce(usable, F.lit(False))))


@dataclass(frozen=True)
class Either(Rule):
    """What one of two rules accepts; else the faults by the first."""

    first: Rule
    second: Rule

    def faults(self, value: Column, path: Column) -> Column:
        return F.when(F.size(self.second.faults(value, path)) == 0, _none()).otherwise(self.first.faults(value, path))


def checked(rows: DataFrame, column: str, rule: Rule) -> DataFrame:
    """Rows plus faults (path, problem) of the JSON in `column`; text that is no JSON has one fault, with an empty path."""
    value = F.try_parse_json(F.coalesce(F.col(column), F.lit("")))
    return rows.withColumn("faults", _once(value, lambda v: F.when(v.isNull(), _fault(F.lit(""), "not JSON", F.lit(True))).otherwise(rule.faults(v, F.lit("")))))


def split(rows: DataFrame, column: str, rule: Rule, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and (keys, path, problem), a row a fault of the others."""
    c = checked(rows, column, rule)
    # explode() itself would have the planner put a filter on the size of `faults` before it, which checks each document again
    return c.where(F.size("faults") == 0).drop("faults"), c.select(*keys, F.explode_outer("faults").alias("f")).where("f is not null").select(*keys, "f.*")


# The fields of each kind of answer, and how many items their lists may have.
MODEL_ROLES = ("商品卡片主图", "不确定", "场景中偶然出现")
SCENE_FIELDS, SCOPE_FIELDS = ("scene_name", "audience", "user_need", "evidence"), ("scope_in", "scope_out")
SLACK, SCOPE_MOST = 10, 8


def sections(*names: str, **more: Rule) -> Object:
    return Object({n: Text() for n in names} | more, more=True)


def scenes_rule(model: str, scene_count: int = 6) -> Object:
    scene = Object({n: Text() for n in SCENE_FIELDS}, {n: Lines(SCOPE_MOST) for n in SCOPE_FIELDS})
    return Object({"model": Text(choices=(model,)), "scenes": List(scene, max(1, scene_count - 2), scene_count + 2, unique="scene_name")})


def products_rule(model: str, products_per_scene: int = 16) -> Object:
    return Object({"model": Text(choices=(model,)), "products": List(Object({n: Rule() for n in ("product_cn", "product_en", "purpose")}), 2, products_per_scene + SLACK)})


def synthesis_rule(model: str) -> Object:
    named = lambda first: List(sections(first, "description", "evidence"), 1)
    priorities = List(Text(), 3, 5)
    summary = Object({n: Text() for n in ("executive_conclusion", "business_opportunity", "decision_boundary")} | {"recommended_actions": List(Text(), 3, 5)})
    return Object({
        "model": Text(choices=(model,)), "manager_summary": summary, "store_profile": sections("judgement", "evidence"), "audiences": named("audience_name"), "current_product_structure": sections("judgement", "evidence"),
        "future_product_structure": sections("judgement", "evidence", priority_order=priorities), "operation_strategy": named("strategy_name"),
    })


def expansions_rule(model: str, expansion_terms: int = 6) -> Object:
    terms = List(Text(), 0, expansion_terms)
    product = Object({n: Text() for n in ("product_cn", "product_en", "canonical_cn", "canonical_en")} | {"expanded_cn": terms, "expanded_en": terms})
    return Object({"model": Text(choices=(model,)), "scenes": List(Object({"scene_name": Text(), "products": List(product, 1)}), 1)})


def recognition_rule() -> Object:
    rest = {"role": Text(choices=MODEL_ROLES), "confidence": Number(0, 1), "evidence": Text(blank=True)}
    product = Either(Object({"name_cn": Text(), "name_en": Text(blank=True)} | rest), Object({"name": Text()} | rest))
    image = Object({"filename": Text(blank=True), "products": List(product, 0, 200)}, {"sales_rows": Rule(), "sales_warnings": Rule()})
    return Object({"images": List(image, unique="filename")})
