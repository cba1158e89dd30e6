"""Column functions on literal rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywright.functions import classify as cl
from tallywright.functions import money as mo
from tallywright.functions import periods as pe
from tallywright.functions import text as tx
from tallywright.rules import REGIONAL


@pytest.fixture
def one(spark):
    def evaluate(values, build, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        frame = spark.createDataFrame(rows, f"i int, v {kind}")
        return [r[0] for r in frame.orderBy("i").select(build(F.col("v")).alias("x")).collect()]

    return evaluate


def test_title_case_is_that_of_python(one):
    names = ["BS.AS. AGUA-LUZ", "4TO TRIMESTRE", "óleos y ñandú", "", None, "A PAGAR  BS AS", "d'or x2y"]
    assert one(names, tx.title_case) == [None if n is None else n.title() for n in names]


def test_canonical_account_numbers(one):
    raw = ["42101001.0", " 42101001 ", "4220120", "12a ", None, "nan", "-7.9"]
    assert one(raw, tx.canonical_account_no) == ["42101001", "42101001", "4220120", "12a", None, "nan", "-7"]


def test_plain_patterns_and_real_patterns_agree(one):
    texts = ["AJ INFL", "nota de CRÉDITO 3", "Anulación", None, "Asiento 1", "ASTO DE X", "x"]
    assert one(texts, lambda c: tx.contains(c, "Asiento|ASTO DE")) == [False, False, False, False, True, True, False]
    assert one(texts, lambda c: tx.contains(c, REGIONAL.reversal_text)) == [False, True, True, False, False, False, False]
    assert one(["Bs.As.", "BsxAsx", "Bs As"], lambda c: tx.contains(c, REGIONAL.label_unit_pattern)) == [True, False, True]


def test_cleaning(one):
    assert one(["a\x00b\x0bc\td\n", None], tx.strip_control) == ["abc\td\n", None]
    assert one(["b'2026-01'", "2026-02"], tx.strip_bytes_mark) == ["2026-01", "2026-02"]
    long = "BSAS " + "X" * 60
    label = one([long, "pat alquileres", "Otra"], tx.account_label)
    assert label == ["X" + "x" * 50 + "…", "Alquileres", "Otra"]
    assert one(["00-Ventas netas - A", "sin prefijo"], tx.concept_label) == ["Ventas netas - A", "sin prefijo"]
    assert one(["x" * 46, "x" * 45], tx.short_label) == ["x" * 45 + "…", "x" * 45]


def test_money_formats(one):
    values = [1234567890.0, -5.0e5, 0.0]
    assert one(values, mo.peso_millions, "double") == ["$1.234,6M", "-$0,5M", "$0,0M"]
    assert one([1234567, 12], mo.thousands, "bigint") == ["1.234.567", "12"]
    assert one([1234560000.0], mo.millions, "double") == ["1.234,6"]


def test_signs(one):
    assert one([0, 1, 2, None], lambda c: mo.signed_amount(F.lit(5), c), "int") == [5, -5, None, None]
    texts = ["NOTA DE CRÉDITO 1", "anulación", "Factura", None]
    flipped = one(texts, lambda c: mo.flip_reversals(F.lit(5), c, REGIONAL.reversal_text))
    assert flipped == [-5, -5, 5, 5]
    assert one([10.0, 0.0, None], lambda c: mo.margin_pct(F.lit(5.0), c), "double") == [50.0, None, None]


def test_prefix_is_idempotent_and_groups_follow(one):
    raw = ["Ventas netas - A", "Sueldos - B", "01-Otros DA", "Sindicato - A", "Alquiler", None]
    prefixed = one(raw, cl.with_order_prefix)
    assert prefixed == ["00-Ventas netas - A", "01-Sueldos - B", "01-Otros DA", "01-Sindicato - A", "02-Alquiler", None]
    assert one(prefixed, cl.with_order_prefix) == prefixed
    assert one(prefixed, cl.pnl_group) == ["1.Ventas", "2.RRHH", "2.RRHH", "2.RRHH", "3.Egresos", None]


def test_noise_precedence(spark):
    rows = [(10, "cierre INFL"), (9, "reversion de ajuste infl"), (9, "Reversion provision"), (9, "provision"), (9, None), (None, "x")]
    frame = spark.createDataFrame(rows, "origin int, detail string")
    got = frame.select(cl.noise_category(F.col("origin"), F.col("detail"), REGIONAL).alias("c")).collect()
    assert [r["c"] for r in got] == ["cierre", "infl", "reversion", "provision", "base", "base"]


def test_units_and_flags(one):
    names = ["BSAS PATENTES", "PAT SUELDOS", "BS AS X", "SALTA Y", "bsas minúsculas", None]
    assert one(names, lambda c: cl.unit_of_name(c, REGIONAL)) == ["Bs.As.", "Salta", "Bs.As.", "Salta", None, None]
    assert one([3, 8, 4, 5, None], lambda c: cl.unit_of_branch(c, REGIONAL), "int") == ["Bs.As.", "Bs.As.", "Salta", "Otros", "Otros"]
    assert one(["Si", " sI ", "Sí", "No", None], cl.is_considered) == [True, True, False, False, False]
    assert one([8, 0, None], lambda c: cl.decode(c, REGIONAL.origin_labels), "int") == ["Compra", None, None]
    assert one(["42101029", "42202", "42303"], lambda c: cl.subclass(c, REGIONAL.subclass_labels, "Sin Clasificar")) == [
        "Consultoría y Operaciones",
        "Administración",
        "Sin Clasificar",
    ]


def test_periods(one):
    days = [dt.date(2024, 1, 31), None]
    assert one(days, pe.month_of, "date") == [dt.date(2024, 1, 1), None]
    assert one(days, pe.month_or_dash, "date") == ["2024-01", "-"]
    assert one(days, pe.day_text, "date") == ["31/01/2024", None]
    assert one(days[:1], pe.month_name, "date") == ["Ene 2024"]
    assert one(["2024-02-30", "2024-02-03", "x"], pe.parse_moment)[1] is not None
    assert one(["2024-02-30", "x"], pe.parse_moment) == [None, None]
    assert pe.months_between(dt.date(2023, 11, 1), dt.date(2024, 2, 1)) == ["2023-11", "2023-12", "2024-01", "2024-02"]
    assert pe.period_label((2025, 2024)) == "2024 – 2025" and pe.period_label(()) == ""


def test_document_numbers_stay_whole_unless_cut(spark):
    rows = spark.createDataFrame([(0, 1, 12345, 1234567891), (0, 1, 3, 12)], "t int, l int, b int, n long")
    label = lambda cut: [r[0] for r in rows.select(cl.document_label(F.col("t"), F.col("l"), F.col("b"), F.col("n"), cut)).collect()]
    assert [x.split(" ")[-1] for x in label(False)] == ["12345-1234567891", "0003-00000012"]
    assert [x.split(" ")[-1] for x in label(True)] == ["1234-12345678", "0003-00000012"]


def test_bytes_decode(spark):
    assert spark.range(1).select(tx.decode_bytes(F.unhex(F.lit("C3A9")))).first()[0] == "é"
