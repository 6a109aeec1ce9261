"""Printed values, claims and business documents on small literal cases, nulls included."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import claims as C
from millrace.functions import fields as P
from millrace.functions import stats
from millrace.functions import text as T
from millrace.operators import business as B
from millrace.operators import retrieval
from millrace.plans import business as plans


def values(spark, texts, use):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.select(use(F.col("t")).alias("v"), "k").orderBy("k").collect()]


def test_numbers_and_their_confidence(spark):
    texts = ["1,234.56", "1.234,56", "1.234", "12,50", "1,234,567", "-5.00", "7", "3.5", "", None]
    got = [tuple(v) for v in values(spark, texts, P.number)]
    assert got == [(1234.56, 1.0), (1234.56, 1.0), (1234.0, 0.55), (12.5, 1.0), (1234567.0, 1.0), (-5.0, 1.0), (7.0, 1.0), (3.5, 0.8), (None, 0.0), (None, 0.0)]


def test_money_keeps_the_sign_and_takes_the_last_number(spark):
    got = values(spark, ["VAT 20%   464.60", "TOTAL   -2,787.60", "none", None], P.money_on_line)
    assert [v and tuple(v) for v in got] == [(464.6, 1.0, "464.60"), (-2787.6, 1.0, "-2,787.60"), None, None]
    assert values(spark, ["€ 5", "5 USD", "USDX 5", "5"], P.currency) == ["EUR", "USD", "", ""]


def test_dates(spark):
    texts = ["2025-03-07", "7 March 2025", "07 Mar 2025", "March 7, 2025", "13/02/2025", "03/02/2025", "02/13/2025", "7.3.2025", "07-03-2025", "2025-13-40", "soon", None]
    got = [v and (v["value"], v["confidence"]) for v in values(spark, texts, P.parsed_date)]
    day = datetime.date(2025, 3, 7)
    assert got[:4] == [(day, 1.0)] * 4 and got[4] == (datetime.date(2025, 2, 13), 0.95) and got[5] == (datetime.date(2025, 2, 3), 0.6)
    assert got[6] == (datetime.date(2025, 2, 13), 0.6) and got[7] == (day, 0.85) and got[8] == (day, 0.7) and got[9:] == [None] * 3


def test_labels_and_hyphens(spark):
    got = values(spark, ["Total - 500.00", "TOTAL   -500.00", "Subtotal 5", "Total: = 7", "the total", None], lambda t: P.after_label(t, "total"))
    assert got == ["500.00", "-500.00", None, "7", "", None]
    assert values(spark, ["Fenwick Ltd, of 12 Row", "Brook (the Client)", "Plain Ltd,", " of nothing"], P.company) == ["Fenwick Ltd", "Brook", "Plain Ltd", "of nothing"]


def test_identifiers(spark):
    assert values(spark, ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 99", "GB82", None], lambda t: T.iban_valid(t, P.IBAN_LENGTHS)) == [True, False, False, None]
    assert values(spark, ["GB123456789", "GB 12345", "XX1", "XX12", "NL123456789B01"], P.vat_valid) == [True, False, False, True, True]


def test_scanner_repairs(spark):
    got = [tuple(v) for v in values(spark, ["Total 12O.5l Oil A1O", "", "l0"], P.repaired_digits)]
    assert got == [("Total 120.51 Oil A1O", 2), ("", 0), ("10", 1)]


def test_an_empty_and_a_null_document(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "x\ninvoice no A-1")], "id int, t string")
    got = {(r["id"], r["name"]): r["value"] for r in B.extracted_fields(docs, "id", "t", "invoice").collect()}
    assert got[1, "invoice_number"] is None and got[2, "supplier_name"] is None and got[3, "invoice_number"] == "A-1" and len(got) == 36
    assert B.line_items(docs, "id", "t").count() == 0
    assert {r["code"] for r in B.issues(docs.filter("id = 1"), "id", "t", "invoice", "2025-01-01").collect()} == {"required_field_missing"}


def test_stems(spark):
    words = ["policies", "classes", "running", "refunded", "bus", "is", "status", "make", "boxes", "goes"]
    assert values(spark, words, C.singular) == ["policy", "class", "running", "refunded", "bus", "is", "status", "make", "box", "goe"]
    assert values(spark, words, C.root) == ["policy", "class", "runn", "refund", "bus", "is", "status", "make", "box", "goe"]


def test_claims(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()[0]
    numbers = lambda *x: F.array(*[F.lit(float(v)) for v in x]) if x else F.array().cast("array<double>")
    assert value(C.numbers_agree(numbers(100), numbers(90, 500))) and not value(C.numbers_agree(numbers(100, 7), numbers(100))) and value(C.numbers_agree(numbers(), numbers(1)))
    assert value(C.unsupported_numbers(F.lit("10 of 95 [3] and 40.5"), numbers(100))) == [40.5]
    assert value(C.recency(F.lit("n.d."), 2025)) == round(1 / (1 + 99 * 0.2), 4) and value(C.recency(F.lit("2026-01-01"), 2025)) == 1.0
    assert value(C.quoted_in(F.lit("so the cat sat on the mat"), F.lit("So the cat sat upon the mat today. Yes."))) and not value(C.quoted_in(F.lit(" "), F.lit("x")))
    assert value(C.known_markers(F.lit("a [1] b [9]."), F.array(F.lit(1)))) == "a [1] b ."
    assert value(C.answer_confidence(F.lit(0.8), F.lit(1), F.lit(1.0))) == 0.86 and value(C.has_all(F.lit("A cat"), F.array(F.lit("dog|CAT"), F.lit("a"))))


def test_rates(spark):
    got = spark.range(1).select(stats.compared_rates(F.lit(54), F.lit(100), F.lit(69), F.lit(100)).alias("c")).first()["c"]
    assert (got["difference"], got["significant"]) == (0.15, True) and got["interval_low"] == pytest.approx(0.0166, abs=2e-4)
    empty = spark.range(1).select(stats.compared_rates(F.lit(0), F.lit(0), F.lit(1), F.lit(2)).alias("c")).first()["c"]
    assert empty["rate_a"] is None and empty["significant"] is False


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_A_BLOCK", 3)
    rows, queries = spark.range(5).withColumnRenamed("id", "x"), spark.range(10).withColumnRenamed("id", "query_id")
    got = retrieval.with_queries(rows, queries).collect()
    assert len(got) == 50 and len(set(map(tuple, got))) == 50


def test_pages_are_read_without_grouping_documents(spark):
    docs = spark.createDataFrame([(1, "Acme Ltd\nInvoice Number: A-1\nTotal 12.00")], "id int, t string")
    for out in (B.extracted_fields(docs, "id", "t", "invoice"), B.line_items(docs, "id", "t")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_lines_of_pages_are_not_walked_by_column_expressions(spark):
    text = "Acme Ltd\nInvoice Number: A-1\n----------\nBolt  two   2   1,234.50   2,469.00\r\nTotal   1   1.00   1.00\n----------\nVAT No: GB123456789\nVAT 20%  493.80\nTOTAL 2,962.80\n"
    docs = spark.createDataFrame([(1, text), (2, "2 x Flat white    6.41\nTill"), (3, None)], "id int, t string")
    items = B.line_items(docs, "id", "t")
    assert sorted(map(tuple, items.collect())) == [(1, 0, "Bolt  two", 2.0, 1234.5, 2469.0), (2, 0, "Flat white", 2.0, 3.21, 6.41)]
    fields = B.extracted_fields(docs, "id", "t", "invoice")
    found = {r["name"]: r["value"] for r in fields.filter("id = 1 and value is not null").collect()}
    assert found == {"invoice_number": "A-1", "supplier_name": "Acme Ltd", "supplier_vat": "GB123456789", "tax_amount": "493.80", "total_amount": "2962.80", "currency": "GBP"}
    assert all("ArrowEvalPython" in x._jdf.queryExecution().optimizedPlan().toString() for x in (items, fields))
    assert [P.half_up(x, 2) for x in (1.005, 2.675, -0.125, 3.0)] == [1.01, 2.68, -0.13, 3.0]


def test_vectors_are_multiplied_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS_A_BLOCK", 3)
    rows = [(1, [1.0, 0.0], "a"), (2, [0.6, 0.8], "a"), (3, [0.6, 0.8], "b"), (4, [1.0], "a"), (5, None, None), (6, [-1.0, 0.0], "b"), (7, [0.5, None], "a"), (8, [2.5e-6, 0.0], "a")]
    v = spark.createDataFrame(rows, "id int, v array<double>, label string")
    q = v.filter("id in (1, 4)").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"), "label")
    plain = {1: {1: 1.0, 2: 0.6, 3: 0.6, 4: 0.0, 5: 0.0, 6: -1.0, 7: None, 8: 0.000003}, 4: {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0, 6: 0.0, 7: 0.0, 8: 0.0}}
    best = {(k, i, s) for k, by in plain.items() for i, s in sorted(by.items(), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:3]}
    found = retrieval.vector_search(v, "id", "v", q.drop("label"), top=3)
    assert {(r["query_id"], r["id"], r["score"]) for r in found.collect()} == best
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    scoped = {(r["query_id"], r["id"], r["rank"]) for r in retrieval.vector_search(v, "id", "v", q, "label", 2, 0.0).collect()}
    assert scoped == {(1, 1, 1), (1, 2, 2), (4, 4, 1), (4, 1, 2)}
    swept = {r["threshold"]: (r["same"], r["different"]) for r in retrieval.threshold_counts(v, "id", "v", "label", q, [0.0, 0.000003, 0.6]).collect()}
    assert swept == {0.0: (7, 3), 0.000003: (2, 1), 0.6: (1, 1)}


def test_items_are_dealt_before_words_become_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ITEMS_A_TASK", 10)
    items = spark.range(100, numPartitions=1).select("id", F.array(F.lit("rod"), (F.col("id") % 3).cast("string")).alias("name"), F.array(F.lit("steel")).alias("body"))
    asked = spark.createDataFrame([(1, "rod"), (1, "2"), (2, "steel"), (3, "none")], "query_id long, term string")
    found = retrieval.field_search(items, asked, 2)
    assert sorted((r["query_id"], r["id"], r["score"]) for r in found.collect()) == [(1, 2, 4.0), (1, 5, 4.0), (2, 0, 1.0), (2, 1, 1.0), (3, 0, 0.0), (3, 1, 0.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and "hashpartitioning(query_id#" in plan and "BroadcastHashJoin" in plan
    assert not any("hashpartitioning(term" in line or "hashpartitioning(query_id" in line and ", id#" in line for line in plan.splitlines())


def test_accounts_of_one_piece_are_checked_by_all_cores(spark, tmp_path):
    from millrace.plans import business

    spark.range(50).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert business.identifier_checks(spark, str(tmp_path)).rdd.getNumPartitions() == 4


def test_named_fields_are_read_alone_and_pages_once(spark):
    pages = spark.createDataFrame([(1, "Row Ltd\nInvoice No: A-1\nIBAN: GB82 WEST 1234 5698 7654 32\nTotal 5.00"), (2, "Row Ltd"), (3, None)], "k long, text string")
    every = B.extracted_fields(pages, "k", "text", "invoice")
    for names in (("invoice_number",), ("iban", "currency"), ("total_amount", "supplier_name")):
        named = B.extracted_fields(pages, "k", "text", "invoice", names)
        assert sorted(map(str, named.collect())) == sorted(map(str, every.filter(F.col("name").isin(*names)).collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for query in (plans.invoice_corrections, plans.filled_fields):
        assert "ArrowEvalPython" not in plan(query(spark, "/root/testdata/sf0.001"))
    # Lines are dealt by their number, which adaptive execution leaves as it is.
    assert "REPARTITION_BY_NUM" in plan(plans.invoice_rows(spark, "/root/testdata/sf0.001"))


def test_phrases_of_pages_are_found_by_line_in_one_pass(spark):
    told = T.Phrases(["tax inv", "late fee", "é"])
    docs = spark.createDataFrame([(1, "TAX INVOICE 12\nTax invoice 13"), (2, "a late\nfee"), (3, "x É late fee 7"), (4, ""), (5, None)], "id int, t string").withColumn("held", told.held_by(F.col("t")))
    assert dict(docs.select("id", "held").collect()) == {1: 1, 2: 0, 3: 6, 4: 0, 5: None}
    assert [r[0] for r in docs.select(told.holds(F.col("held"), "late fee")).collect()] == [False, False, True, False, None]
    plan = plans.judged_invoices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Contains(lower" not in plan and "contains(lower" not in plan.lower()


def test_lines_that_differ_in_digits_alone_are_judged_once():
    specs = (B.Spec("number", "identifier", ("no",)), B.Spec("tax", "money", ("vat",), avoid=("reg",)))
    likeness, ends = B.label_ends(specs)
    page = lambda n: f"Note\nNO: {n}7 no 5\nKno {n}\n  VAT Reg no 1\nVat -3"
    for n in (1, 2, 3):
        got = B.label_places(page(n), specs, likeness, ends)
        assert got == [[(f"{n}7 no 5", f"NO: {n}7 no 5", f"Kno {n}"), ("1", "VAT Reg no 1", "Vat -3")], [("-3", "Vat -3", None)]]
    assert ends.cache_info().misses == 5
    assert B.label_ends((B.Spec("a", "text", ("a1",)),))[1]("b a1") == [(0, 0, 4)] and B.label_places("B A1: x\nA2 y", (specs[0], B.Spec("a", "text", ("a1",))), *B.label_ends((specs[0], B.Spec("a", "text", ("a1",)))))[1] == [("x", "B A1: x", "A2 y")]
    B.row_spans.cache_clear()
    assert [B.page_rows(f"----------\nBolt {n}  two   {n}   1,234.50   2,469.00\n----------") for n in (2, 3)] == [[(f"Bolt {n}  two", float(n), 1234.5, 2469.0)] for n in (2, 3)]
    assert B.row_spans.cache_info().misses == 1


def test_documents_that_corrections_leave_as_they_are_are_read_once(spark, monkeypatch):
    page = lambda total, iban: f"Row Ltd\nInvoice No: A-1\nInvoice Date: 2024-01-01\nIBAN: {iban}\nTotal {total}"
    good, bad = plans.GOOD_IBAN, plans.BAD_IBAN
    rows = [(1, page(0, good), page(0, good)), (2, page(0, bad), page(0, good)), (3, page(5, good), page(0, bad)), (4, page(5, good), page(5, good)), (5, None, page(0, bad)), (6, None, None)]
    docs = spark.createDataFrame(rows, "k int, b string, a string")
    plain = B.review_outcome(*(B.issues(docs, "k", c, "invoice", "2024-02-01") for c in "ba"))
    read, issues = [], B.issues
    monkeypatch.setattr(B, "issues", lambda texts, *a, **limits: read.append(texts.count()) or issues(texts, *a, **limits))
    got = B.reviewed(docs, "k", "b", "a", "invoice", "2024-02-01")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert {(r["id"], r["code"], r["outcome"]) for r in got.collect()} >= {(1, "zero_total", "remaining"), (2, "iban_checksum_failed", "fixed"), (3, "zero_total", "new"), (5, "required_field_missing", "fixed")}
    assert read == [9] and "ArrowEvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_dates_are_tried_by_the_formats_of_their_shape(spark):
    texts = ["due 2000-10-01 or 1.9.2000", "32 May 2000, paid 1.9.2000", "on 5 MAY 2000", "sept 5, 2000", "31/12/1999", "2000-13-01", "1/2.2000", "", None]
    got = values(spark, texts, P.date_within)
    assert [v and (str(v["value"]), v["confidence"], v["raw"]) for v in got] == [("2000-10-01", 1.0, "2000-10-01"), ("2000-09-01", 0.85, "1.9.2000"), ("2000-05-05", 1.0, "5 MAY 2000"), None, ("1999-12-31", 0.95, "31/12/1999"), None, None, None, None]
    # Shapes behind the first that can be read aren't looked for: no array of all of them.
    assert str(P.date_within(F.col("t"))).startswith("Column<'coalesce(")
    assert [v["value"] for v in values(spark, ["-1,234.50", "1234,567.89", "1,23.50", "7.50\n", "1.234,50"], P.number)] == [-1234.5, 1234567.89, 123.5, 7.5, 1234.5]
    assert "RLIKE" in str(P.number(F.col("t"))).upper()
