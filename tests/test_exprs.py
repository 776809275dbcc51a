import pytest
from pyspark.sql import functions as F

from quillframe.functions import exprs as x
from quillframe.plans import rules


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize(("label", "month"), [("avr", "2019-04"), ("Ventes de SEPT 2033", "2033-09"), (" fevr ", "2019-02"), ("OCTOBRE / 2040", "2040-10"), ("jui", "2019-07"), ("mai 92024", "2024-05"), ("nov2030", None), ("aou_2030", None), ("montant", None), (None, None)])
def test_month(spark, label, month):
    assert one(spark, x.normalize_month(F.lit(label).cast("string"), F.lit(2019))) == month


@pytest.mark.parametrize(("text", "value"), [("12 805,07 €", 12805.07), ("-0,25", -0.25), ("EUR 7,5", 7.5), ("8.001,9", None), ("−41", 41.0), ("n/a", None), ("", None), (None, None)])
def test_french_decimal(spark, text, value):
    assert one(spark, x.french_decimal(F.lit(text).cast("string"))) == value


@pytest.mark.parametrize(("header", "field"), [(" LIBELLE", "designation"), ("date DE vente ", "date"), ("montant", "amount"), ("QUANTITÉ", "quantity"), ("Cip", "code_produit"), ("PA  cat", None), ("pv ttc.", None), (None, None)])
def test_column(spark, header, field):
    assert one(spark, x.normalize_column(F.lit(header).cast("string"))) == field


@pytest.mark.parametrize(("code", "digits", "reason"), [("34015 123 09875", "3401512309875", None), ("n° 3401597302468;", "3401597302468", None), ("", "", None), ("-", "", None), ("990017", "990017", "code is not 13 digits")])
def test_code(spark, code, digits, reason):
    assert one(spark, x.code_digits(F.lit(code))) == digits
    assert one(spark, x.bad_line(F.lit(code), F.lit(1.0))) == reason


@pytest.mark.parametrize(("text", "lgo"), [("x ETAT DES VENTES y", "etat_des_ventes"), ("état des ventes", "etat_des_ventes"), ("Win Pharma, LGPI", "lgpi"), ("unknown", None), (None, None)])
def test_fingerprint(spark, text, lgo):
    assert one(spark, x.fingerprint(F.lit(text).cast("string"))) == lgo


def test_downscale(spark):
    size = lambda w, h, most: one(spark, x.target_size(F.lit(w), F.lit(h), F.lit(most).cast("int")))
    assert size(800, 600, None) is None and size(800, 600, 1_000_000) is None
    small = size(4000, 3000, 1_000_000)
    assert small.width * small.height <= 1_000_000 and abs(small.width / small.height - 4 / 3) < 0.01


def test_small_functions(spark):
    assert one(spark, x.french_number(F.lit(1234567.891))) == "1 234 567,89"
    assert one(spark, x.french_number(F.lit(None).cast("double"))) == ""
    assert [one(spark, x.plain_number(F.lit(v))) for v in (3.0, 3.5)] == ["3", "3.5"]
    assert one(spark, x.float_text(F.lit(12345678.0))) == "12345678.0"
    assert one(spark, x.frame_stem(F.lit("q_77_3"))) == "q_77" and one(spark, x.frame_stem(F.lit("a_x"))) is None
    assert one(spark, x.bare_name(F.lit("Été-12.B"))) == "t12b"
    assert str(one(spark, x.report_date(F.lit("2026-02-03T01:02")))) == "2026-02-03" and one(spark, x.report_date(F.lit("2026-2-3"))) is None
    assert one(spark, x.month_prefix(F.lit("2026-13-01"))) == "2026-13"
    assert one(spark, x.reference_year(F.lit("2024 and 12031"))) == 2031 and one(spark, x.reference_year(F.lit("x"))) == 2000
    assert one(spark, x.signature(F.lit("lgpi"))) == "LGPI" and one(spark, x.signature(F.lit("zz"))) == "zz"
    assert one(spark, x.strip(F.lit("   a b　"))) == "a b"
    assert one(spark, x.at(F.array(F.lit("a")), F.lit(3))) == ""
    assert one(spark, x.route(F.lit("a/b.TIFF"))) == "image" and one(spark, x.route(F.lit("a.txt"))) is None


def test_header_meta(spark):
    m = one(spark, x.header_meta(F.lit("Title\n\nFournisseur: A\n Pharmacie X \r\nID: 12\n1 rue\nfournisseur: B: C")))
    assert (m.supplier, m.id, m.name, m.address) == ("B: C", "12", "Pharmacie X", "1 rue")
    empty = one(spark, x.header_meta(F.lit(None).cast("string")))
    assert (empty.supplier, empty.id, empty.name, empty.address) == ("", "", "", "")


def test_document_checks(spark):
    bad = lambda months, pages, rows: one(spark, x.bad_document(F.array(*map(F.lit, months)).cast("array<string>"), F.lit(pages), F.lit(rows)))
    assert bad(["2026-13"], 1, 0) is None
    assert bad(["2026-1"], 1, 0) == "month is not yyyy-MM" and bad([], 0, 0) == "page_count below 1" and bad([], 1, -1) == "row_count below 0"


def test_rules():
    r = rules.DEFAULT
    assert rules.month_labels(dict(rules.MONTH_TOKENS)) == rules.MONTH_LABELS
    assert rules.month_labels({"Maitime": 5, "may": 5, "mai": 5, "junetime": 6})[4:6] == ("may", "junetime")
    assert [r.label_token(m) for m in range(1, 13)] == ["janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc"]
    with pytest.raises(TypeError):
        rules.from_json([], {}, [])
    with pytest.raises(ValueError):
        rules.validate(rules.Rules(signatures=(("a", ()),)))
    assert rules.from_json({"Jan": 1}, {"EAN ": "code_produit"}, [{"id": "a", "signatures": ["A"]}]).alias_map() == {"ean": "code_produit"}
