"""Scalar functions as Column expressions: built-in functions only, NULL where a value cannot be parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.plans.rules import DEFAULT, IMAGE_SUFFIXES, Rules

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBER_OR_NONE = rf"{NUMBER}|(?i)^[+-]?(nan|inf|infinity)$"
CODE = r"^[0-9]{13}$"
MONTH = r"^[0-9]{4}-[0-9]{2}$"


def text(c: Column) -> Column:
    """null becomes empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """without Unicode white space at either end; null becomes empty."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def at(items: Column, index: Column) -> Column:
    """the element, or empty for a null or out-of-range index."""
    return F.coalesce(F.get(items, index), F.lit(""))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def normalize_column(header: Column, rules: Rules = DEFAULT) -> Column:
    """the canonical column of a header cell, or null. Inner white space counts."""
    return F.try_element_at(literal_map(rules.alias_map()), F.lower(strip(header)))


def normalize_month(label: Column, reference_year: Column, rules: Rules = DEFAULT) -> Column:
    """yyyy-MM of the first token (by priority) that is a word of the label; the year is the first 20xx anywhere, else the reference year. Null without a token."""
    low = F.lower(strip(label))
    words = F.split(low, r"[^\p{L}\p{N}_]+")
    token = F.get(F.array_intersect(F.array(*(F.lit(t) for t in rules.month_map())), words), F.lit(0))  # in the order of tokens
    year = F.coalesce(F.nullif(F.regexp_extract(low, "(20[0-9]{2})", 1), F.lit("")), reference_year.cast("string"))
    return F.concat(year, F.lit("-"), F.try_element_at(literal_map(rules.month_map()), token))


def _number(s: Column) -> Column:
    """The number that all of the text is, else null. The text is used once, so that it is not computed again."""
    return F.regexp_extract(s, NUMBER, 0).try_cast("double")


def french_decimal(v: Column) -> Column:
    """digits, comma, point and minus are kept, the comma is the decimal mark; null if that is no number (or blank)."""
    return _number(F.replace(F.regexp_replace(text(v), r"[^0-9,.\-]", ""), F.lit(","), F.lit(".")))


def cell_number(v: Column) -> Column:
    """ASCII spaces go, the comma is the decimal mark; null if that is no number. nan, inf and infinity, in any case and with a sign, are numbers."""
    number = F.regexp_extract(F.replace(F.replace(strip(v), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), NUMBER_OR_NONE, 0).try_cast("double")
    return F.when(F.regexp_like(text(v), F.lit("^[0-9]{1,15}$")), text(v).try_cast("double")).otherwise(number)  # most are digits alone


def truncated(v: Column) -> Column:
    """a float's text, truncated toward zero; null for what is no finite number."""
    n = _number(F.trim(text(v)))
    return F.when(F.abs(n) < 9.2e18, n.cast("bigint"))


def whole(v: Column) -> Column:
    """an integer's text; null for any other text."""
    s = strip(v)
    number = F.when(F.regexp_like(s, F.lit(r"^[+-]?[0-9]+$")), s.try_cast("bigint"))
    return F.when(F.regexp_like(text(v), F.lit("^[0-9]{1,15}$")), text(v).try_cast("bigint")).otherwise(number)  # most are digits alone


def code_digits(c: Column) -> Column:
    """F8: the digits alone."""
    return F.regexp_replace(text(c), "[^0-9]", "")


def is_code(c: Column) -> Column:
    """13 digits."""
    return F.regexp_like(c, F.lit(CODE))


def reference_year(t: Column) -> Column:
    """the largest 20xx of a text, else 2000."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text(t), F.lit("(20[0-9]{2})"), 1), lambda y: y.cast("int"))), F.lit(2000))


def report_date(v: Column) -> Column:
    """the first ten characters as yyyy-MM-dd, else null."""
    s = F.substring(text(v), 1, 10)
    return F.when(F.regexp_like(s, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), s.try_cast("date"))


def month_prefix(v: Column) -> Column:
    """the first seven characters if they are yyyy-MM, else null. Months beyond 12 are not refused."""
    return F.nullif(F.regexp_extract(F.substring(text(v), 1, 7), MONTH, 0), F.lit(""))


def month_label(month: Column, rules: Rules = DEFAULT) -> Column:
    """F16: the header of a month column, as in "janv. 2026"."""
    tokens = literal_map({f"{m:02d}": rules.label_token(m) for m in range(1, 13)})
    return F.concat(F.try_element_at(tokens, F.substring(month, 6, 2)), F.lit(". "), F.substring(month, 1, 4))


def french_number(x: Column) -> Column:
    """two decimals after a comma, spaces between thousands; null becomes empty."""
    return F.coalesce(F.translate(F.format_number(x, 2), ",.", " ,"), F.lit(""))


def plain_number(x: Column) -> Column:
    """without decimals if it is integral."""
    integral = x == F.floor(x)
    return F.when(integral & (F.abs(x) < 2.0**53), x.cast("bigint").cast("string")).when(integral, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def float_text(x: Column) -> Column:
    """A double as text with one decimal at least, never in scientific form below 2 ** 53."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 2.0**53), F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def signature(lgo: Column, rules: Rules = DEFAULT) -> Column:
    """the first signature of a software id, else the id."""
    return F.coalesce(F.try_element_at(literal_map({k: v[0] for k, v in rules.signatures}), lgo), lgo)


def bare_name(n: Column) -> Column:
    """lower-cased, a to z and digits alone."""
    return F.regexp_replace(F.lower(n), "[^a-z0-9]", "")


def frame_stem(n: Column) -> Column:
    """the stem before a trailing _digits, or null."""
    return F.when(F.regexp_like(n, F.lit(r"^.*_[0-9]+$")), F.regexp_extract(n, r"^(.*)_[0-9]+$", 1))


def target_size(width: Column, height: Column, most: Column) -> Column:
    """the size scaled down to so many pixels, or null if none is given or it fits."""
    scale = F.sqrt(most / (width * height))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale).cast("int"))
    return F.when((most > 0) & (width * height > most), F.struct(side(width).alias("width"), side(height).alias("height")))


def route(name: Column) -> Column:
    """pdf, image, or null by the suffix."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(*IMAGE_SUFFIXES), "image")


def fingerprint(t: Column, rules: Rules = DEFAULT) -> Column:
    """P10: the first software, by priority, one of whose signatures the text contains in any case; else null."""
    low, out = F.lower(text(t)), F.lit(None).cast("string")
    for name, own in reversed(rules.signatures):
        hit = F.lit(False)
        for s in own:
            hit = hit | F.contains(low, F.lit(s.lower()))
        out = F.when(hit, name).otherwise(out)
    return out


def header_meta(t: Column) -> Column:
    """struct(supplier, id, name, address) of a page's text: the last line with each prefix, and the second and third of the other lines."""
    lines = F.filter(F.transform(F.split(text(t), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), strip), lambda s: s != "")
    after = lambda own: F.coalesce(strip(F.regexp_replace(F.element_at(own, -1), r"(?s)^[^:]*:", "")), F.lit(""))
    last = lambda prefix: F.filter(lines, lambda s: F.startswith(F.lower(s), F.lit(prefix)))
    body = F.filter(lines, lambda s: ~F.startswith(F.lower(s), F.lit("fournisseur:")) & ~F.startswith(F.lower(s), F.lit("id:")))
    field = lambda prefix: F.when(F.size(last(prefix)) > 0, after(last(prefix))).otherwise("")
    return F.struct(field("fournisseur:").alias("supplier"), field("id:").alias("id"), at(body, F.lit(1)).alias("name"), at(body, F.lit(2)).alias("address"))


def bad_line(code: Column, confidence: Column) -> Column:
    """V1, V3: why a line is refused, or null. An empty code is accepted."""
    digits = code_digits(code)
    return F.when((digits != "") & ~is_code(digits), "code is not 13 digits").when(~confidence.between(0, 1), "confidence out of range")


def bad_document(months: Column, page_count: Column, row_count: Column) -> Column:
    """V2, V3: why a document is refused, or null."""
    return F.when(~F.forall(months, lambda m: F.regexp_like(m, F.lit(MONTH))), "month is not yyyy-MM").when(page_count < 1, "page_count below 1").when(row_count < 0, "row_count below 0")
