"""Text expressions over columns. All stay on the JVM but two Arrow functions, for NFKC and for folding accents."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Whole-cell placeholders, and the markers that begin operational text.
PLACEHOLDERS = ("0", "1", "无", "n-a", "n/a", "na", "none", "null", "unknown", "未知")
OPERATIONAL_MARKERS = ("链接随便拍", "链接拍", "采购看", "仓库看", "下单备注", "供应商按照", "供应商打包", "控制在", "备货量", "市场分析", "头程费用", "本地上传")
# Characters trimmed from a name from which identifiers were cut.
TRIMMED = " ,.;:，。；：、/\\|()[]{}（）【】<>《》\"'“”-_"
#: White space as Python's str.split sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
CJK = r"[一-鿿]"
CJK_WIDE = r"[㐀-鿿]"
VECTOR_PREFIX, VECTOR_SEPARATOR, VECTOR_CHARS, VECTOR_NAMES = "商品名称：", "；", 120, 8
# Country names and codes.
COUNTRIES = {"PH": "PH", "菲律宾": "PH", "TH": "TH", "泰国": "TH", "VN": "VN", "越南": "VN", "MY": "MY", "马来西亚": "MY"}
# Words of a sales status.
RISK_WORDS = ("违禁", "禁售", "侵权", "高退款", "质量", "banned", "prohibited")
BAN_WORDS = ("违禁", "禁售", "banned", "prohibited")
EXTRA_RISK_WORDS = ("侵权", "高退款", "质量")


@F.arrow_udf(StringType())
def nfkc(values: pa.Array) -> pa.Array:
    return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def _folded(v: str) -> str:
    return v.lower() if v.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.combining(c))).lower()


@F.arrow_udf(StringType())
def fold_accents(values: pa.Array) -> pa.Array:
    """Lower case without the marks of letters, as a full-text index folds them."""
    return pa.array([None if v is None else _folded(v) for v in values.to_pylist()], pa.string())


def with_folded(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with some string columns folded; one pass over Arrow batches, which no later expression is merged with."""
    at = [df.columns.index(c) for c in columns]

    def fold(batches):
        for b in batches:
            arrays = list(b.columns)
            for i in at:
                arrays[i] = pa.array([None if v is None else _folded(v) for v in arrays[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return df.mapInArrow(fold, df.schema)


def collapse(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize_compare(c: Column, *, ascii_only: bool = False) -> Column:
    """Text for comparison: NFKC, white space collapsed, null as empty. `ascii_only` spares the Arrow call where NFKC changes nothing."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return collapse(c if ascii_only else nfkc(c))


def is_placeholder(normal: Column) -> Column:
    return F.lower(normal).isin(*PLACEHOLDERS)


def clean_optional(normal: Column) -> Column:
    """Null for an empty or placeholder cell; `normal` is normalized text."""
    return F.when((normal != "") & ~is_placeholder(normal), normal)


def truncate_operational(name: Column) -> Column:
    """What stands before the first operational marker; the whole name if nothing usable does."""
    places = [F.when(F.instr(name, m) > 1, F.instr(name, m) - 1) for m in OPERATIONAL_MARKERS]
    first = F.least(*places)
    prefix = clean_optional(collapse(F.substring(name, F.lit(1), first)))
    return F.when(first.isNull(), name).otherwise(F.coalesce(prefix, name))


def vector_names(names: Column) -> Column:
    """At most eight distinct names, shortest first, from an array of normalized ones."""
    usable = F.filter(F.transform(names, clean_optional), lambda n: n.isNotNull())
    cut = F.array_distinct(F.transform(usable, lambda n: F.substring(truncate_operational(n), 1, VECTOR_CHARS)))
    keyed = F.array_sort(F.transform(cut, lambda n: F.struct(F.char_length(n).alias("size"), n.alias("name"))))
    return F.slice(F.transform(keyed, lambda k: k["name"]), 1, VECTOR_NAMES)


def vector_text(names: Column) -> Column:
    return vector_text_of(vector_names(names))


def vector_text_of(prepared: Column) -> Column:
    """The text of prepared names, empty without any."""
    return F.when(F.size(prepared) > 0, F.concat(F.lit(VECTOR_PREFIX), F.array_join(prepared, VECTOR_SEPARATOR))).otherwise("")


def _pairs(run: Column) -> Column:
    """Neighbouring characters of a run of two or more."""
    return F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))


def keyword_tokens(normal: Column) -> Column:
    """Query tokens in order, first of each: bigrams of CJK runs, a lone CJK character, and ASCII words whole."""
    runs = F.regexp_extract_all(normal, F.lit(rf"({CJK}+|[A-Za-z0-9]+)"), F.lit(1))
    split = lambda r: F.when((F.char_length(r) > 1) & r.rlike(f"^{CJK}"), _pairs(r)).otherwise(F.array(r))
    return F.array_distinct(F.flatten(F.transform(runs, split)))


def index_tokens(values: Column) -> Column:
    """What an index adds to normalized values: CJK characters and bigrams that are no whole run, and words glued to CJK text."""
    runs = lambda v: F.regexp_extract_all(v, F.lit(f"({CJK}+)"), F.lit(1))
    whole = F.flatten(F.transform(values, runs))
    singles = lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r)), lambda i: F.substring(r, i, F.lit(1)))
    parts = lambda r: F.when(F.char_length(r) > 1, F.concat(singles(r), _pairs(r))).otherwise(singles(r))
    glued = lambda v: F.regexp_extract_all(v, F.lit(rf"((?<={CJK})[A-Za-z0-9]+|[A-Za-z0-9]+(?={CJK}))"), F.lit(1))
    helped = F.transform(values, lambda v: F.concat(F.filter(F.flatten(F.transform(runs(v), parts)), lambda t: ~F.array_contains(whole, t)), glued(v)))
    return F.array_distinct(F.flatten(helped))


def index_text(values: Column) -> Column:
    """Indexed text of an array of normalized values: the distinct ones, then index_tokens."""
    originals = F.array_distinct(F.filter(values, lambda v: v != ""))
    return F.array_join(F.concat(originals, index_tokens(originals)), " ")


def index_words(folded: Column) -> Column:
    """Tokens of folded indexed text: runs of letters, digits and private-use characters."""
    return F.filter(F.split(folded, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def identifiers_pattern(identifiers: Column) -> Column:
    """One expression for all of a family's identifiers as whole tokens, longest first."""
    ordered = F.reverse(F.array_sort(F.transform(F.array_distinct(identifiers), lambda i: F.struct(F.char_length(i).alias("size"), i.alias("id")))))
    listed = F.array_join(F.transform(ordered, lambda i: F.concat(F.lit(r"\Q"), i["id"], F.lit(r"\E"))), "|")
    # no identifiers: what matches nowhere
    return F.when(F.size(identifiers) > 0, F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_-])(?:"), listed, F.lit(r")(?![A-Za-z0-9_-])"))).otherwise(r"(?!)")


def identifier_tokens(text: Column) -> Column:
    """The runs, in lower case, that an identifier of letters, digits, - and _ must equal to match."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_-]+)"), F.lit(1))


def identifiers_in(identifiers: Column, texts: Column) -> Column:
    """Of an array of identifiers those that may stand in an array of texts, found by their tokens."""
    tokens = F.array_distinct(F.flatten(F.transform(texts, identifier_tokens)))
    plain = lambda i: i.rlike("^[A-Za-z0-9_-]+$")
    return F.concat(F.array_intersect(F.transform(F.filter(identifiers, plain), lambda i: F.lower(i)), tokens), F.filter(identifiers, lambda i: ~plain(i)))


def remove_identifiers(value: Column, pattern: Column, *, normal: Column | None = None) -> Column:
    """`value` less what `identifiers_pattern` matches; unchanged if nothing does."""
    cleaned = clean_optional(value if normal is None else normal)
    cut = F.regexp_replace(cleaned, pattern, F.lit(" "))
    return F.when(cleaned.isNull() | (cut == cleaned), value).otherwise(F.btrim(collapse(cut), F.lit(TRIMMED)))


def mentions_identifier(text: Column, identifier: Column) -> Column:
    """Whether an identifier stands in a text as a whole token."""
    return (identifier != "") & F.regexp(text, F.concat(F.lit(r"(?<![A-Za-z0-9_-])\Q"), identifier, F.lit(r"\E(?![A-Za-z0-9_-])")))


def category_path(levels: list[Column]) -> Column:
    """The levels that are no placeholders, in order; `levels` are raw values."""
    return F.filter(F.array(*levels), lambda v: clean_optional(collapse(v)).isNotNull())


def leaf_category(levels: list[Column], catalog: Column) -> Column:
    """The deepest usable level, else the catalog."""
    return F.coalesce(*[F.when(clean_optional(collapse(v)).isNotNull(), v) for v in (*reversed(levels), catalog)])


def english_alias(normal: Column, pattern: Column) -> Column:
    """An alias without identifiers and CJK text; null if no letter is left."""
    cut = F.regexp_replace(remove_identifiers(normal, pattern), f"{CJK_WIDE}+", " ")
    cleaned = clean_optional(collapse(cut))
    return F.when(cleaned.rlike("[A-Za-z]"), F.btrim(cleaned, F.lit(TRIMMED)))


def is_english(c: Column) -> Column:
    return c.rlike("[A-Za-z]") & ~c.rlike(CJK_WIDE)


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def status_key(normal: Column) -> Column:
    return F.lower(normal)


def platform_banned(status: Column, platform: Column) -> Column:
    """Whether a status key bans sale on a platform: it names the platform on its own and holds a word of ban."""
    latin = F.regexp(status, F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), platform, F.lit(r"\E(?![A-Za-z0-9])")))
    han = F.regexp(status, F.concat(F.lit(r"(?:^|(?<=[\s\-_/\\|,:;，、；：()\[\]{}（）【】<>《》\"'“”]))\Q"), platform, F.lit(r"\E")))
    named = F.when(platform.rlike("[A-Za-z0-9]"), latin).when(platform.rlike(f"^{CJK_WIDE}+$"), han).otherwise(False)
    return platform.isNotNull() & named & has_any(status, BAN_WORDS)


def status_warns(status: Column, banned: Column, platform: Column) -> Column:
    return has_any(status, RISK_WORDS) & (~banned | platform.isNull() | has_any(status, EXTRA_RISK_WORDS))


def split_clue(name: Column) -> Column:
    """The parts of a listed name that have two characters or more; the whole name if none has."""
    parts = F.array_distinct(F.filter(F.transform(F.split(name, "[、，,]"), lambda p: F.trim(p)), lambda p: F.char_length(p) >= 2))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(name))


def mentions(text: Column, name: Column) -> Column:
    """Whether a description refers to a name: a Latin word of it comes back, or a CJK run of it lies in one of the text's."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([0-9a-z]{2,})"), F.lit(1))
    runs = lambda c: F.regexp_extract_all(c, F.lit(rf"({CJK}{{2,}})"), F.lit(1))
    return F.arrays_overlap(words(text), words(name)) | F.exists(runs(name), lambda part: F.exists(runs(text), lambda run: F.contains(run, part)))


def product_text(cn: Column, en: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(cn, F.lit("")), F.coalesce(en, F.lit("")))


def question_name(cn: Column, en: Column) -> Column:
    """'en（cn）', or the one that is there."""
    c, e = F.nullif(F.trim(cn), F.lit("")), F.nullif(F.trim(en), F.lit(""))
    return F.when(c.isNotNull() & e.isNotNull(), F.concat(e, F.lit("（"), c, F.lit("）"))).otherwise(F.coalesce(e, c, F.lit("")))


def slug(c: Column, limit: int = 40) -> Column:
    """Lower-case words joined by hyphens."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"^[. ]+|[. ]+$", "")


def country_code(c: Column) -> Column:
    raw = F.trim(c)
    codes = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.upper(raw)), F.try_element_at(codes, raw))


def number(c: Column, *, strict: bool = False) -> Column:
    """Blank is 0, thousands separators are dropped; anything else that is no finite number is an error if strict, else 0."""
    raw = F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("")))
    value = raw.try_cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    wrong = F.raise_error(F.concat(F.lit("invalid quantity "), raw)).cast("double") if strict else F.lit(0.0)
    return F.when(raw.isNull() | (raw == ""), F.lit(0.0)).when(bad, wrong).otherwise(value)


def cell_text(c: Column) -> Column:
    """A double as text, whole numbers without a point."""
    return F.when(c.isNull(), "").when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def distinct_lines(lines: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")), "\n")


def labelled(fields: dict[str, Column]) -> Column:
    """'label：value' lines of the fields that have a value."""
    return F.concat_ws("\n", *[F.when(F.trim(v) != "", F.concat(F.lit(f"{k}："), F.trim(v))) for k, v in fields.items()])


def display_width(c: Column) -> Column:
    """Columns that a text takes where wide characters take two."""
    return F.char_length(c) + F.char_length(F.regexp_replace(c, r"[^ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦]", ""))


def row_lines(c: Column, width: int) -> Column:
    """Lines that a cell of a given width takes."""
    return F.aggregate(F.split(c, "\n"), F.lit(0).cast("long"), lambda acc, line: acc + F.greatest(F.lit(1), F.ceil(display_width(line) / width)).cast("long"))
