"""Families: source rows of one main SKU grouped into one searchable document with its children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

ROW_FIELDS = ("sku", "main_sku", "product_name", "english_name", "english_keywords", "sales_status_raw", "product_catalog", "category_level_1", "category_level_2", "category_level_3", "category_level_4")
LEVELS = ROW_FIELDS[7:]
# Main SKUs that are never searchable, and English names for families that have none.
EXCLUDED_MAINS = ("1A0000",)
ENGLISH_FALLBACKS = {"SH-CW-2339": ["Lace shorts"], "WATOY320": ["Miniature ancient weapon model pendant"]}


def excluded_main(main: Column) -> Column:
    return F.upper(main).isin(*EXCLUDED_MAINS)


def split_unassigned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a main SKU, and the others for the audit."""
    has = F.trim(F.coalesce("main_sku", F.lit(""))) != ""
    return rows.where(has), rows.where(~has)


def without_excluded(rows: DataFrame, excluded_children: DataFrame) -> DataFrame:
    """Rows whose child isn't on the exclusion list (sku) and whose main isn't excluded."""
    return rows.join(excluded_children.select("sku").distinct(), "sku", "left_anti").where(~excluded_main(F.col("main_sku")))


def _first_of_each(ordered: Column) -> Column:
    """The first struct of each `key` of a sorted array, in one pass: the array beside itself, moved by one."""
    before = F.concat(F.slice(ordered, 1, F.least(F.size(ordered), F.lit(1))), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))))
    marked = F.zip_with(ordered, before, lambda p, q: F.struct(p.alias("p"), (p["key"] != q["key"]).alias("new")))
    return F.transform(F.filter(marked, lambda m, i: (i == 0) | m["new"]), lambda m: m["p"])


def _least_display(pairs: Column) -> Column:
    """(key, display) pairs to one display a key, the least, in the order of the key regardless of case."""
    keyed = F.array_sort(F.transform(_first_of_each(F.array_sort(pairs)), lambda p: F.struct(F.lower(p["key"]).alias("folded"), p["key"].alias("key"), p["display"].alias("display"))))
    return F.transform(keyed, lambda p: p["display"])


def _pair(key: Column, display: Column) -> Column:
    return F.struct(key.alias("key"), display.alias("display"))


def normalized_rows(rows: DataFrame, *, ascii_only: bool = False) -> DataFrame:
    """Every source cell as text and, under n_<name>, normalized; `ord` is the row's place."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ROW_FIELDS]
    plain = rows.select("ord", *cells)
    return plain.select("*", *[tx.normalize_compare(F.col(c), ascii_only=ascii_only).alias(f"n_{c}") for c in ROW_FIELDS if c != "sales_status_raw"])


def _with_own_identifiers(r: DataFrame) -> DataFrame:
    """Adds `ids`, a pattern of the family's identifiers that may stand in the row's name.

    An identifier of letters, digits, - and _ alone is a whole token wherever it matches, so a name's tokens are joined with the family's
    identifiers; a family's other identifiers are in the pattern of each of its rows.
    """
    ids = r.select("n_main_sku", F.explode(F.array_distinct(F.array("n_sku", "n_main_sku"))).alias("id")).distinct()
    return _identified(r, "n_main_sku", "ord", F.col("n_product_name"), ids)


def _identified(r: DataFrame, main: str, key: str, text: Column, identifiers: DataFrame) -> DataFrame:
    """Adds `ids` to rows of (main, key): the pattern of those of a family's identifiers (main, id) that may stand in `text`."""
    plain = F.col("id").rlike("^[A-Za-z0-9_-]+$")
    tokens = r.select(main, key, F.explode(F.array_distinct(tx.identifier_tokens(text))).alias("token"))
    met = tokens.join(identifiers.where(plain).select(main, F.lower("id").alias("token")).distinct(), [main, "token"])
    own = met.groupBy(main, key).agg(F.collect_list("token").alias("own"))
    odd = identifiers.where(~plain).groupBy(main).agg(F.collect_list("id").alias("odd"))
    none = F.array().cast("array<string>")
    joined = r.join(own, [main, key], "left").join(odd, main, "left")
    return joined.withColumn("ids", tx.identifiers_pattern(F.concat(F.coalesce("own", none), F.coalesce("odd", none)))).drop("own", "odd")


def family_entries(rows: DataFrame, excluded_children: DataFrame | None = None, *, ascii_only: bool = False) -> DataFrame:
    """(main_sku, kind, key, show, ord): what is distinct in each family, a row an entry, from one pass over the source rows.

    kind: child (a row each), cn, en and leaf (names by normalized key; show: the least display), path (show: its displays; ord: where it first
    occurs), vec (names of the vector text) and mark (live, out, operational, bad_english). Entries are combined before they are shuffled, by kind and key, so
    that a family of any number of rows is no hot key. rows: ROW_FIELDS and ord, a number that no two rows of a family share; a row without sku or main_sku is an error.
    """
    r = normalized_rows(rows, ascii_only=ascii_only)
    r = r.withColumn("n_main_sku", F.when((F.col("n_sku") == "") | (F.col("n_main_sku") == ""), F.raise_error(F.lit("each source row requires non-empty sku and main_sku")).cast("string")).otherwise(F.col("n_main_sku")))
    if excluded_children is not None:
        marks = excluded_children.select(F.col("sku").alias("__sku")).distinct().withColumn("__out", F.lit(True))
        r = r.join(marks, F.trim("sku") == F.col("__sku"), "left").withColumn("out", F.coalesce("__out", F.lit(False)))
    else:
        r = r.withColumn("out", F.lit(False))
    r = _with_own_identifiers(r.withColumn("out", F.col("out") | excluded_main(F.col("n_main_sku"))))
    usable = lambda c: tx.clean_optional(F.col(f"n_{c}"))
    levels = [F.when(usable(c).isNotNull(), _pair(F.col(f"n_{c}"), F.col(c))) for c in LEVELS]
    leaf = F.coalesce(*reversed(levels), F.when(usable("product_catalog").isNotNull(), _pair(F.col("n_product_catalog"), F.col("product_catalog"))))
    bad_english = F.lit(False)
    for c in ("english_name", "english_keywords"):
        bad_english = bad_english | ((F.col(f"n_{c}") != "") & usable(c).isNull())
    name = usable("product_name")
    r = r.withColumns({"__cut": tx.remove_identifiers(F.col("n_product_name"), F.col("ids"), normal=F.col("n_product_name")), "__path": F.array_compact(F.array(*levels)), "__leaf": leaf})
    same = name.isNull() | (F.col("__cut") == F.col("n_product_name"))

    def entry(kind: str, when: Column, key: Column, show: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key"), show.cast("array<string>").alias("show")))

    live, none = ~F.col("out"), F.array()
    pair = lambda kind, p: entry(kind, live & p.isNotNull(), p["key"], F.array(p["display"]))
    vector_name = F.get(tx.vector_names(F.array("__cut")), F.lit(0))
    entries = [
        entry("child", F.lit(True), F.col("ord").cast("string"), F.array("sku", "product_name", "sales_status_raw", F.when(F.col("out"), "excluded_sku").otherwise(""))),
        entry("mark", F.lit(True), F.when(live, "live").otherwise("out"), none), entry("mark", live & bad_english, F.lit("bad_english"), none),
        entry("mark", live & F.coalesce(tx.truncate_operational(name) != name, F.lit(False)), F.lit("operational"), none),
        pair("cn", F.when(tx.clean_optional(F.col("__cut")).isNotNull(), _pair(F.col("__cut"), F.when(same, F.col("product_name")).otherwise(F.col("__cut"))))), pair("leaf", F.col("__leaf")),
        *[pair("en", F.when(usable(c).isNotNull(), _pair(F.col(f"n_{c}"), F.col(c)))) for c in ("english_name", "english_keywords")],
        entry("vec", live & vector_name.isNotNull(), vector_name, none),
        entry("path", live & (F.size("__path") > 0), F.to_json(F.transform("__path", lambda q: q["key"])), F.transform("__path", lambda q: q["display"])),
    ]
    flat = r.select(F.col("n_main_sku").alias("main_sku"), "ord", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("main_sku", "ord", "e.*")
    return flat.groupBy("main_sku", "kind", "key").agg(F.min("show").alias("show"), F.min("ord").alias("ord"))


def family_children(entries: DataFrame) -> DataFrame:
    """(main_sku, place, sku, display_name, sales_status_raw, status_flags) in the order of the source, a row a child; a large family is sorted on disk."""
    c = entries.where("kind = 'child'").withColumn("place", F.row_number().over(W.partitionBy("main_sku").orderBy("ord")) - 1)
    flags = F.when(F.col("show")[3] != "", F.array(F.col("show")[3])).otherwise(F.array().cast("array<string>"))
    return c.select("main_sku", "place", F.col("show")[0].alias("sku"), F.col("show")[1].alias("display_name"), F.col("show")[2].alias("sales_status_raw"), flags.alias("status_flags"))


def family_names(entries: DataFrame) -> DataFrame:
    """(main_sku, kind, place, name): distinct cn, en and leaf names in order of their keys regardless of case, a row a name."""
    n = entries.where("kind in ('cn', 'en', 'leaf')")
    return n.select("main_sku", "kind", (F.row_number().over(W.partitionBy("main_sku", "kind").orderBy(F.lower("key"), "key")) - 1).alias("place"), F.col("show")[0].alias("name"))


def family_facts(entries: DataFrame) -> DataFrame:
    """(main_sku, searchable, vector_text_v1, quality_flags, children): a row a family, whatever its size: of its names only the eight of the vector text meet."""
    best = entries.where("kind = 'vec'").withColumn("n", F.row_number().over(W.partitionBy("main_sku").orderBy(F.char_length("key"), "key"))).where(F.col("n") <= tx.VECTOR_NAMES)
    text = best.groupBy("main_sku").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("named"))
    has = lambda mark: F.bool_or((F.col("kind") == "mark") & (F.col("key") == mark)).alias(mark)
    g = entries.groupBy("main_sku").agg(*[has(m) for m in ("live", "out", "operational", "bad_english")], F.count_if(F.col("kind") == "leaf").alias("leaves"), F.count_if(F.col("kind") == "child").alias("children"))
    g = g.join(text, "main_sku", "left").withColumn("vector_text_v1", tx.vector_text_of(F.transform("named", lambda x: x["key"])))
    return g.select("main_sku", *_judged(), "children")


def _judged() -> list[Column]:
    """Searchable, vector text and quality flags from a family's marks, number of leaves and vector text."""
    excluded = excluded_main(F.col("main_sku"))
    flags = F.array_compact(F.array(
        F.when(~excluded & F.col("out"), F.lit("excluded_children")), F.when(excluded, F.lit("excluded_main_sku")), F.when(F.col("leaves") > 1, F.lit("mixed_leaf_category")),
        F.when(F.col("operational"), F.lit("operational_text")), F.when(F.col("bad_english"), F.lit("placeholder_english")), F.when(F.col("vector_text_v1") == "", F.lit("unsearchable")),
    ))
    return [((F.col("vector_text_v1") != "") & ~excluded).alias("searchable"), F.col("vector_text_v1"), flags.alias("quality_flags")]


def build_documents(rows: DataFrame, excluded_children: DataFrame | None = None, *, ascii_only: bool = False) -> DataFrame:
    """One document a main SKU, with all its children in one row. rows as for `family_entries`, whose flat tables serve families too large for a row."""
    children = F.array_sort(F.collect_list(F.when(F.col("kind") == "child", F.struct("ord", F.col("show").alias("x")))))
    shown = F.transform("children", lambda e: F.struct(
        e["x"][0].alias("sku"), e["x"][1].alias("display_name"), e["x"][2].alias("sales_status_raw"), F.when(e["x"][3] != "", F.array(e["x"][3])).otherwise(F.array().cast("array<string>")).alias("status_flags")))
    return _documents(family_entries(rows, excluded_children, ascii_only=ascii_only), children, shown)


def family_heads(entries: DataFrame) -> DataFrame:
    """The documents of `build_documents` with the number of their children in place of these: a row holds the distinct names of a family, whatever its size."""
    return _documents(entries, F.count_if(F.col("kind") == "child"), F.col("children"))


def _documents(entries: DataFrame, children: Column, shown_children: Column) -> DataFrame:
    of = lambda kind, item: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))
    named = F.struct(F.lower("key").alias("folded"), F.col("key").alias("key"), F.col("show")[0].alias("x"))
    has = lambda mark: F.bool_or((F.col("kind") == "mark") & (F.col("key") == mark)).alias(mark)
    g = entries.groupBy("main_sku").agg(
        *[of(kind, named).alias(kind) for kind in ("cn", "en", "leaf")], of("path", F.struct("ord", F.col("show").alias("x"))).alias("path"), children.alias("children"),
        of("vec", F.struct(F.char_length("key").alias("size"), F.col("key").alias("x"))).alias("vec"), *[has(m) for m in ("live", "out", "operational", "bad_english")],
    )
    shown = lambda kind: F.transform(kind, lambda e: e["x"])
    g = g.withColumns({"leaves": F.size("leaf"), "vector_text_v1": tx.vector_text_of(F.slice(shown("vec"), 1, tx.VECTOR_NAMES))})
    searchable, text, flags = _judged()
    return g.select(
        F.concat(F.lit("main:"), "main_sku").alias("doc_id"), "main_sku", searchable, shown("cn").alias("cn_names"), shown("en").alias("en_aliases"), shown("leaf").alias("leaf_categories"),
        shown("path").alias("category_paths"), text, shown_children.alias("children"), flags,
    )


def english_documents(documents: DataFrame) -> DataFrame:
    """The English projection: cleaned aliases (one a name regardless of case), fallbacks, and the flag where none is left."""
    documents = documents.withColumn("__ids", tx.identifiers_pattern(tx.identifiers_in(F.concat(F.array("main_sku"), F.transform("children", lambda c: c["sku"])), F.col("en_aliases"))))
    cleaned = F.array_compact(F.transform("en_aliases", lambda a: tx.english_alias(tx.collapse(a), F.col("__ids"))))
    pairs = F.transform(cleaned, lambda a: _pair(F.lower(a), a))
    return _english(documents.withColumn("__a", _least_display(pairs)).drop("__ids"))


def english_heads(entries: DataFrame) -> DataFrame:
    """The English projection of `family_heads`: an alias meets the family's identifiers as tokens, so that no row holds these."""
    a = entries.where("kind = 'en'").select("main_sku", "key", F.col("show")[0].alias("name"))
    ids = entries.where("kind = 'child'").select("main_sku", F.col("show")[0].alias("id")).unionByName(entries.select("main_sku", F.col("main_sku").alias("id"))).distinct()
    a = _identified(a, "main_sku", "key", F.col("name"), ids)
    cleaned = a.select("main_sku", tx.english_alias(tx.collapse(F.col("name")), F.col("ids")).alias("name")).where("name is not null")
    one = cleaned.groupBy("main_sku", F.lower("name").alias("key")).agg(F.min("name").alias("name"))
    named = one.groupBy("main_sku").agg(F.array_sort(F.collect_list(F.struct("key", "name"))).alias("__a")).withColumn("__a", F.transform("__a", lambda x: x["name"]))
    heads = family_heads(entries)
    return _english(heads.join(named, "main_sku", "left").select(*heads.columns, F.coalesce("__a", F.array().cast("array<string>")).alias("__a")))


def _english(d: DataFrame) -> DataFrame:
    table = F.create_map(*[x for k, v in ENGLISH_FALLBACKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    d = d.withColumn("en_aliases", F.when(F.size("__a") > 0, F.col("__a")).otherwise(F.coalesce(F.try_element_at(table, F.col("main_sku")), F.array().cast("array<string>")))).drop("__a")
    none = F.size("en_aliases") == 0
    flags = F.array_remove("quality_flags", "missing_english")
    return (
        d.withColumn("quality_flags", F.when(none, F.array_sort(F.concat(flags, F.array(F.lit("missing_english"))))).otherwise(flags))
        .withColumn("searchable", ~none & ~F.array_contains("quality_flags", "excluded_main_sku"))
        .withColumn("vector_text_v1", F.when(none, "").otherwise(F.concat(F.lit("Product name: "), F.array_join("en_aliases", "; "))))
    )


def children_of(documents: DataFrame) -> DataFrame:
    """(main_sku, place, sku, display_name, sales_status_raw, status_flags)."""
    return documents.select("main_sku", F.posexplode("children").alias("place", "c")).select("main_sku", "place", "c.*")


def child_map(documents: DataFrame, child_skus: Column) -> DataFrame:
    """(child_sku, main_sku), an error where a child has two mains."""
    return child_mains(documents.select("main_sku", F.explode(child_skus).alias("child_sku")))


def child_mains(children: DataFrame) -> DataFrame:
    """`child_map` of flat rows (main_sku, child_sku)."""
    pairs = children.select("main_sku", "child_sku").distinct()
    one = pairs.groupBy("child_sku").agg(F.min("main_sku").alias("main_sku"), F.count("*").alias("mains"))
    return one.select("child_sku", F.when(F.col("mains") > 1, F.raise_error(F.concat(F.lit("child SKU maps to multiple main SKUs: "), "child_sku")).cast("string")).otherwise(F.col("main_sku")).alias("main_sku"))


def get_document(documents: DataFrame, main_sku: str) -> DataFrame:
    return documents.where(F.col("main_sku") == F.lit(" ".join(main_sku.split())))


def representative_name(documents: DataFrame, excluded_children: DataFrame | None = None) -> DataFrame:
    """(main_sku, name): the first name; where children are excluded, the first usable name of one that isn't."""
    live = F.filter("children", lambda c: ~F.array_contains(c["status_flags"], "excluded_sku") & tx.clean_optional(tx.collapse(c["display_name"])).isNotNull())
    first = F.coalesce(F.get("cn_names", F.lit(0)), F.lit(""))
    return documents.select("main_sku", F.when(F.array_contains("quality_flags", "excluded_children"), F.coalesce(F.get(live, F.lit(0))["display_name"], first)).otherwise(first).alias("name"))


def representative_names(entries: DataFrame) -> DataFrame:
    """`representative_name` of flat entries, excluded children marked in them: least entries alone are kept, no lists."""
    of = lambda kind: F.col("kind") == kind
    shown = lambda i: F.get("show", F.lit(i))
    live = of("child") & (shown(3) == "") & tx.clean_optional(tx.collapse(shown(1))).isNotNull()
    g = entries.where("kind in ('cn', 'child', 'mark')").groupBy("main_sku").agg(
        F.min(F.when(of("cn"), F.struct(F.lower("key").alias("folded"), "key", shown(0).alias("name"))))["name"].alias("first"),
        F.min(F.when(live, F.struct("ord", shown(1).alias("name"))))["name"].alias("live"), F.bool_or(of("mark") & (F.col("key") == "out")).alias("out"),
    )
    first = F.coalesce("first", F.lit(""))
    return g.select("main_sku", F.when(F.col("out") & ~excluded_main(F.col("main_sku")), F.coalesce("live", first)).otherwise(first).alias("name"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
