"""Model completions and annotation exports, kept as VARIANT so that one bad element does not spoil its neighbours."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import exprs as x

FENCE = "```"
# The members that may name an image, in order.
IMAGE_KEYS = ("image", "image_name", "file_name", "filename", "source", "uri")
_END = secrets.token_hex(16)
#: The characters of the property White_Space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strict_object(s: Column) -> Column:
    """The text as VARIANT if all of it is one JSON object, else null. The parser stops after a value, so the text is parsed as the first of two elements of a list: one that closes the list early loses the second, which it cannot know, and one that goes on after a comma puts another in its place."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), s, F.lit(f',"{_END}"]')))
    alone = lambda p: F.when(F.try_variant_get(p, "$[1]", "string") == _END, F.try_variant_get(p, "$[0]", "variant"))
    # trimming looks at each character, so it is left to texts that need it
    begins = F.startswith(s, F.lit("{")) | F.startswith(F.ltrim(s, F.lit(_SPACE)), F.lit("{"))
    ends = F.endswith(s, F.lit("}")) | F.endswith(F.rtrim(s, F.lit(_SPACE)), F.lit("}"))
    # the lambda keeps the text from being parsed once for each use
    return F.get(F.transform(F.when(begins & ends, F.array(wrapped)), alone), F.lit(0))


def completion(s: Column) -> Column:
    """The first of the fenced block, the whole text, and what lies from the first { to the last } that is a JSON object; else null."""
    s = x.text(s)
    parts = F.split(s, FENCE, 3)  # before, in and after the first block
    fenced = F.when(F.size(parts) == 3, F.regexp_replace(F.get(parts, F.lit(1)), "^json", ""))
    braced = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    return F.coalesce(*(strict_object(F.nullif(c, F.lit(""))) for c in (fenced, s, braced)))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def as_text(v: Column, path: str) -> Column:
    """F10 on a member of a VARIANT."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def items(v: Column, path: str) -> Column:
    """A member of a VARIANT as an array of VARIANT, or null if it is no list."""
    return F.try_variant_get(v, path, "array<variant>")


def elements(df: DataFrame, found: Column, keep: list[str], name: str, pos: str) -> DataFrame:
    """A row for each element of an array, with its position from 0. The outer form is used, as the inner one makes Spark compute the array once more for a filter on its size."""
    return df.select(*keep, F.posexplode_outer(found).alias(pos, name)).filter(F.col(pos).isNotNull())


def computed(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a filter on them is not moved to before them, where Spark would compute them for itself."""
    return df.select(*keep, F.inline_outer(F.array(F.struct(*columns))))


def completion_lines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J2, J3 of raw(doc_id, v): (lines, cells). Elements that are no objects and codes without 13 digits are left out; a month's quantities are summed."""
    products = _products(raw)
    lines = products.select("doc_id", "line_no", "code_produit", as_text(F.col("product"), "$.designation").alias("designation"))
    sales = elements(products, items(F.col("product"), "$.sales"), ["doc_id", "line_no", "code_produit"], "sale", "sale_no").filter(is_object(F.col("sale")))
    sales = computed(sales, ["doc_id", "line_no", "code_produit"], *_sale(F.col("sale")))
    cells = sales.filter("month is not null and quantity is not null").groupBy("doc_id", "line_no", "code_produit", "month").agg(F.sum("quantity").alias("quantity"))
    return lines, cells


def completion_own(raw: DataFrame) -> DataFrame:
    """completion_lines() of raw(doc_id, v) with a row a doc_id, as one table (doc_id, line_no, code_produit, designation, own): each line with its quantities by month in a map, so that a completion is parsed once and nothing is shuffled."""
    sales = F.transform(items(F.col("product"), "$.sales"), lambda s: F.when(is_object(s), F.struct(*_sale(s))))
    told = computed(_products(raw), ["doc_id", "line_no", "code_produit"], as_text(F.col("product"), "$.designation").alias("designation"), F.filter(sales, lambda s: s.month.isNotNull() & s.quantity.isNotNull()).alias("sales"))
    months = F.array_distinct("sales.month")
    total = lambda m: F.aggregate(F.filter("sales", lambda s: s.month == m), F.lit(0).cast("bigint"), lambda a, s: a + s.quantity)
    own = F.when(F.size(months) == F.size("sales"), F.map_from_entries("sales")).when(F.size("sales") > 0, F.map_from_arrays(months, F.transform(months, total)))
    return told.select("doc_id", "line_no", "code_produit", "designation", F.coalesce(own, F.create_map().cast("map<string,bigint>")).cast("map<string,double>").alias("own"))


def _products(raw: DataFrame) -> DataFrame:
    """(doc_id, line_no, product, code_produit) of the products with a code."""
    products = elements(raw, items(F.col("v"), "$.products"), ["doc_id"], "product", "line_no").filter(is_object(F.col("product")))
    return computed(products, ["doc_id", "line_no", "product"], x.code_digits(as_text(F.col("product"), "$.code_produit")).alias("code_produit")).filter(x.is_code(F.col("code_produit")))


def _sale(v: Column) -> tuple[Column, Column]:
    return x.month_prefix(as_text(v, "$.month")).alias("month"), x.truncated(as_text(v, "$.quantity")).alias("quantity")


def completion_documents(raw: DataFrame) -> DataFrame:
    """J2 of raw(doc_id, v): (doc_id, statement_type, pharmacy_name, pharmacy_id, supplier, generated_at)."""
    v = F.col("v")
    return raw.select("doc_id", F.lit("monthly").alias("statement_type"), as_text(v, "$.pharmacy.name").alias("pharmacy_name"), as_text(v, "$.pharmacy.id").alias("pharmacy_id"), as_text(v, "$.supplier").alias("supplier"), x.report_date(as_text(v, "$.report_date")).alias("generated_at"))


def completion_of(documents: DataFrame, lines: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, output): the completion that would give these tables. documents: (doc_id, pharmacy_name, pharmacy_id, supplier, generated_at). Without cells, lines have their quantities by month in a map own, and are joined with nothing but their documents."""
    sale = lambda month, quantity: F.struct(F.concat(month, F.lit("-01")).alias("month"), x.plain_number(quantity.cast("double")).cast("bigint").alias("quantity"))
    if cells is None:
        lines = lines.withColumn("sales", F.transform(F.map_entries("own"), lambda e: sale(e.key, e.value)))
    else:
        sales = cells.groupBy("doc_id", "line_no").agg(F.collect_list(sale(F.col("month"), F.col("quantity"))).alias("sales"))
        lines = lines.join(sales, ["doc_id", "line_no"], "left")
    product = F.struct("line_no", F.struct("code_produit", "designation", F.coalesce(F.sort_array("sales"), F.array().cast("array<struct<month:string,quantity:bigint>>")).alias("sales")).alias("p"))
    products = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(product))["p"].alias("products"))
    empty = F.array().cast("array<struct<code_produit:string,designation:string,sales:array<struct<month:string,quantity:bigint>>>>")
    whole = F.struct(F.struct(F.col("pharmacy_name").alias("name"), F.col("pharmacy_id").alias("id")).alias("pharmacy"), "supplier", F.coalesce(F.col("generated_at").cast("string"), F.lit("")).alias("report_date"), F.coalesce("products", empty).alias("products"))
    return documents.join(products, "doc_id", "left").select("doc_id", F.to_json(whole).alias("output"))


#: What is read of an entity and its properties. A text is read as bytes, which only strings can become, so that numbers and objects there give null.
_ENTITY = "type:string,mentionText:string,normalizedValue:struct<text:binary>"


def entities(v: Column, depth: int) -> Column:
    """The entities of an export with their types and texts, and their properties down to a depth, as an array of structs, or null if they are no list. All of it is one cast of a VARIANT, which gives null for each part of another kind and spoils no neighbour."""
    kind = _ENTITY
    for _ in range(depth):
        kind = f"{_ENTITY},properties:array<struct<{kind}>>"
    return F.try_variant_get(v, "$.entities", f"array<struct<confidence:double,{kind}>>")


def norm_text(e: Column) -> Column:
    """F15 of one of entities(): normalizedValue.text if it is a string, else mentionText, else empty."""
    return F.coalesce(e["normalizedValue"]["text"].cast("string"), e["mentionText"], F.lit(""))


def of_type(found: Column, kind: str) -> Column:
    """The elements of one type, in order."""
    return F.filter(found, lambda e: F.coalesce(e["type"] == kind, F.lit(False)))


def first_text(found: Column, kind: str) -> Column:
    """The text of the first element of a type, or null if there is none."""
    return F.get(F.transform(of_type(found, kind), norm_text), F.lit(0))


def once_a_row(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with a value that is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def entity_sales(props: Column) -> Column:
    """An array of structs (month, quantity) of the sales_by_month properties with both a month and a whole number; a month's quantities are summed, at the cost of a look at all sales for each month if any month is there twice. Months are not checked here."""
    texts = F.transform(of_type(props, "sales_by_month"), lambda s: F.struct(first_text(s["properties"], "month_period_normalized").alias("month"), first_text(s["properties"], "sales_quantity").alias("quantity")))
    sales = F.filter(F.transform(texts, lambda s: F.struct(F.substring(s["month"], 1, 7).alias("month"), x.whole(s["quantity"]).alias("quantity"))), lambda s: s["month"].isNotNull() & s["quantity"].isNotNull())
    total = lambda sales, m: F.aggregate(F.filter(sales, lambda s: s["month"] == m), F.lit(0).cast("bigint"), lambda a, s: a + s["quantity"])
    summed = lambda sales, months: F.when(F.size(months) == F.size(sales), sales).otherwise(F.transform(months, lambda m: F.struct(m.alias("month"), total(sales, m).alias("quantity"))))
    return once_a_row(sales, lambda s: once_a_row(F.array_distinct(s["month"]), lambda months: summed(s, months)))


def product_lines(found: Column, sales: bool = True) -> Column:
    """The product lines among entities(), as an array of structs (line_no, raw_code, code_produit, good, designation, confidence, and sales, those of entity_sales(), of good ones). A line whose first product_ean has not 13 digits is not good."""
    placed = F.filter(F.transform(found, lambda e, i: F.struct(i.alias("line_no"), e.alias("own"))), lambda p: F.coalesce(p["own"]["type"] == "product_line", F.lit(False)))
    named = F.transform(placed, lambda p: F.struct(p["line_no"], x.text(first_text(p["own"]["properties"], "product_ean")).alias("raw_code"), p["own"].alias("own")))
    coded = F.transform(named, lambda p: F.struct(p["line_no"], p["raw_code"], x.code_digits(p["raw_code"]).alias("code_produit"), p["own"].alias("own")))
    own = lambda p: (
        p["line_no"], p["raw_code"], p["code_produit"], x.is_code(p["code_produit"]).alias("good"), x.text(first_text(p["own"]["properties"], "product_designation")).alias("designation"),
        F.coalesce(p["own"]["confidence"], F.lit(1.0)).alias("confidence"), *([F.when(x.is_code(p["code_produit"]), entity_sales(p["own"]["properties"])).alias("sales")] if sales else []),
    )
    return F.transform(coded, lambda p: F.struct(*own(p)))


def total_sales(found: Column) -> Column:
    """entity_sales() of the first total_line among entities(), or null if there is none."""
    return F.get(F.transform(F.slice(of_type(found, "total_line"), 1, 1), lambda e: entity_sales(e["properties"])), F.lit(0))


def line_tables(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects) of told(doc_id, lines), as product_lines() gives them."""
    found = told.select("doc_id", F.inline("lines"))
    lines = found.filter("good").select("doc_id", "line_no", "code_produit", "designation", "confidence")
    return lines, found.filter(~F.col("good")).select("doc_id", "line_no", F.lit("non-13-digit code").alias("reason"), "raw_code")


def line_cells(told: DataFrame) -> DataFrame:
    """(doc_id, line_no, code_produit, month, quantity) of told(doc_id, lines)."""
    own = lambda p: F.transform(p["sales"], lambda s: F.struct(p["line_no"], p["code_produit"], s["month"].alias("month"), s["quantity"].alias("quantity")))
    return told.select("doc_id", F.inline(F.flatten(F.transform(F.filter("lines", lambda p: p["good"]), own))))


def export_lines(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J7 of raw(doc_id, v) with a row a doc_id: (lines, cells, rejects). A product line whose first product_ean has not 13 digits is a reject with a reason. Each table parses an export once, and nothing is shuffled."""
    told = lambda depth: computed(raw, ["doc_id"], product_lines(entities(F.col("v"), depth), depth > 1).alias("lines"))
    lines, rejects = line_tables(told(1))
    return lines, line_cells(told(2)), rejects


def export_totals(raw: DataFrame) -> DataFrame:
    """(doc_id, month, quantity) of the first total_line."""
    return computed(raw, ["doc_id"], total_sales(entities(F.col("v"), 2)).alias("sales")).select("doc_id", F.inline("sales"))


def compared_sales(lines: Column, totals: Column) -> Column:
    """The sales of product_lines() and of total_sales() as one array of structs (month, quantity, printed), either number null."""
    none = F.lit(None).cast("bigint")
    sold = F.flatten(F.transform(F.filter(lines, lambda p: p["good"]), lambda p: F.transform(p["sales"], lambda s: F.struct(s["month"].alias("month"), s["quantity"].alias("quantity"), none.alias("printed")))))
    told = F.transform(totals, lambda s: F.struct(s["month"].alias("month"), none.alias("quantity"), s["quantity"].alias("printed")))
    return F.concat(*(F.coalesce(c, F.array().cast("array<struct<month:string,quantity:bigint,printed:bigint>>")) for c in (sold, told)))


def export_sales(raw: DataFrame) -> DataFrame:
    """(doc_id, sales) of raw(doc_id, v) with a row a doc_id: the compared_sales() of each export, which is parsed once."""
    return computed(raw, ["doc_id"], once_a_row(entities(F.col("v"), 2), lambda e: compared_sales(product_lines(e), total_sales(e))).alias("sales"))


def export_date(found: Column) -> Column:
    """The text of the first report_date among entities(), or null if there is none."""
    return first_text(found, "report_date")


def export_dates(raw: DataFrame) -> DataFrame:
    """(doc_id, generated_at) of the first report_date of documents that have one, null if that is no date."""
    return computed(raw, ["doc_id"], export_date(entities(F.col("v"), 0)).alias("t")).filter("t is not null").select("doc_id", x.report_date(F.col("t")).alias("generated_at"))


def exports(texts: DataFrame) -> DataFrame:
    """(doc_id, reason, text, date, lines, totals) of texts(doc_id, value), each an export: its own text, export_date(), product_lines() and total_sales(), and why it is refused as a whole, or null. It is parsed once."""
    placed = lambda v: once_a_row(entities(v, 2), lambda e: F.struct(export_date(e).alias("date"), product_lines(e).alias("lines"), total_sales(e).alias("totals")))
    found = computed(texts, ["doc_id"], once_a_row(strict_object(F.col("value")), lambda v: F.struct(v.isNotNull().alias("parsed"), as_text(v, "$.text").alias("text"), placed(v).alias("own"))).alias("e"))
    bad_month = lambda s: x.month_prefix(s["month"]).isNull()
    reason = (
        F.when(~F.col("e.parsed"), "not a JSON object")
        .when(F.exists("e.own.lines", lambda p: p["good"] & ~p["confidence"].between(0, 1)), "confidence out of range")
        .when(F.exists("e.own.lines", lambda p: p["good"] & F.exists(p["sales"], bad_month)), "month is not yyyy-MM")
    )
    return found.select("doc_id", reason.alias("reason"), "e.text", "e.own.*")


def image_name(s: Column) -> Column:
    """The file name in the first of the known keys that holds the name of an image."""
    v = F.try_parse_json(s)
    pick = lambda k: F.when((F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING") & (x.route(F.try_variant_get(v, f"$.{k}", "string")) == "image"), F.try_variant_get(v, f"$.{k}", "string"))
    return F.regexp_extract(F.coalesce(*(pick(k) for k in IMAGE_KEYS)), r"([^/\\]*)$", 1)
