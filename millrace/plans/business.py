"""Queries over business documents: pages printed from orders, with planted defects, are read back and checked.

What the SQL computes from the tables, the queries must find on the pages alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as P
from ..functions import text as T
from ..operators import business as B
from ..session import spread, table
from ..storage import scratch, written

TODAY = "2000-01-01"
#: Lines of orders that a task gathers.
LINES_A_TASK = 250_000
GOOD_IBAN, BAD_IBAN = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 99"


def cents(col):
    return F.format_number((F.col(col) if isinstance(col, str) else col) / 100, 2)


def invoice_rows(spark, sf):
    """Numbers of each invoice in cents, with the defects that its key gives it."""
    k = F.col("o_orderkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("u"))
    # Items are gathered as numbers and printed only when they have met their order, so that no text is dealt anew. They are dealt by
    # number: adaptive execution joins pieces by their compressed size, and a task may then spill what it gathers.
    dealt = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES_A_TASK)), "l_orderkey")
    by = dealt.groupBy("l_orderkey").agg(F.sum(F.col("q") * F.col("u")).alias("plain"), F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "q", "u"))).alias("items"))
    heads = spread(table(spark, sf, "orders")).select("o_orderkey", "o_custkey", "o_orderdate").join(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = heads.join(by, k == F.col("l_orderkey")).withColumn("first", F.array_min(F.transform("items", lambda r: r["l_linenumber"])))
    total = lambda r: r["q"] * r["u"] + F.when((k % 7 == 1) & (r["l_linenumber"] == F.col("first")), 100).otherwise(0)
    rows = rows.withColumn("rows", F.transform("items", lambda r: F.struct(r["l_partkey"].alias("l_partkey"), r["q"].alias("q"), r["u"].alias("u"), total(r).alias("t"))))
    rows = rows.withColumn("s", F.col("plain") + F.when(k % 11 == 2, 500).otherwise(0)).withColumn("pct", F.when(k % 13 == 3, 13).otherwise(20))
    rows = rows.withColumn("x", F.expr("(s * pct + 50) div 100")).withColumn("t", F.col("s") + F.col("x") + F.when(k % 17 == 4, 1000).otherwise(0))
    day = F.to_date("o_orderdate")
    return rows.select(k.alias("k"), "c_name", "c_mktsegment", "rows", "s", "x", "pct", "t", day.alias("day"), F.date_add(day, F.when(k % 19 == 5, -5).otherwise(30)).alias("due"))


def printed_row(r):
    """A row of a table: part, quantity, price and total."""
    part = F.rpad(F.concat(F.lit("Part "), r["l_partkey"].cast("string"), F.lit(" rack")), 30, " ")
    return F.concat(part, F.lpad(r["q"].cast("string"), 6, " "), F.lpad(cents(r["u"]), 14, " "), F.lpad(cents(r["t"]), 16, " "))


def printed_day():
    """The day in one of four ways, by key."""
    k, day = F.col("k"), F.col("day")
    return F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "d MMMM yyyy")).when(k % 4 == 2, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "d.M.yyyy"))


def invoice_text(mended: bool = False):
    """The text of an invoice whose items are printed; mended ones have their number and a valid account."""
    k, date = F.col("k"), printed_day()
    line = lambda cond, value: F.when(cond, value)
    name = F.concat(F.col("c_mktsegment"), F.lit(" Goods Ltd"))
    parts = [
        F.when(k % 5 == 0, F.concat(name, F.lit(", of 12 Rowan Street"))).otherwise(name),
        line(F.lit(mended) | (k % 23 != 6), F.concat(F.lit("Invoice Number: INV-"), k.cast("string"))),
        F.concat(F.lit("Invoice Date: "), date), F.concat(F.lit("Due Date: "), F.date_format("due", "yyyy-MM-dd")),
        F.concat(F.lit("VAT Registration: "), F.when(k % 31 == 8, "GB12345").otherwise("GB123456789")),
        F.lit(""), F.lit("Bill To:"), F.concat(F.lit("  "), F.col("c_name"), F.lit("     ref 7")), F.lit(""),
        F.lit("Description                   Qty    Unit Price          Amount"), F.lit("-" * 60), F.col("printed"), F.lit("-" * 60),
        F.concat(F.lit("Subtotal      "), cents("s")), F.concat(F.lit("VAT "), F.col("pct").cast("string"), F.lit("%     "), cents("x")), F.concat(F.lit("TOTAL   "), cents("t")),
        F.concat(F.lit("IBAN: "), F.when(F.lit(not mended) & (k % 29 == 7), BAD_IBAN).otherwise(GOOD_IBAN)), F.lit("Payment Terms: 30 days net"),
        line(k % 37 == 9, F.lit("DUPLICATE COPY")),
    ]
    return F.concat_ws("\n", *parts)


def invoices(spark, sf, **others):
    """doc_id, text of each order's invoice, and others: texts by name. Items are printed once for all of them."""
    rows = invoice_rows(spark, sf).withColumn("printed", F.array_join(F.transform("rows", printed_row), "\n"))
    return rows.select(F.col("k").alias("doc_id"), invoice_text().alias("text"), *[text.alias(name) for name, text in others.items()])


def invoice_fields(spark, sf):
    found = B.extracted_fields(invoices(spark, sf), "doc_id", "text", "invoice")
    return found.select(F.col("id").alias("doc_id"), "name", "value", "confidence")


def invoice_line_items(spark, sf):
    out = B.line_items(invoices(spark, sf), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.col("item_no").cast("long").alias("item_no"), "description", "quantity", "unit_price", "total")


def invoice_issues(spark, sf):
    return B.issues(invoices(spark, sf), "doc_id", "text", "invoice", TODAY).select(F.col("id").alias("doc_id"), "code", "field", "severity")


def issue_order(spark, sf):
    """The first issue of each invoice: errors before warnings, then by code."""
    found = B.sorted_issues(B.issues(invoices(spark, sf), "doc_id", "text", "invoice", TODAY)).filter("issue_no = 1")
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def judged_invoices(spark, sf):
    """Confidence reports of the invoices, with their fields and issues: each page is printed, read and judged as one row."""
    pages = B.with_issues(B.read_pages(invoices(spark, sf), "doc_id", "text", "invoice", checks=True), "invoice", TODAY)
    return B.confidence_reports(pages.withColumn("type_confidence", B.type_confidence(B.classified(F.col("text")))), "invoice")


def invoice_decisions(spark, sf):
    out = B.decisions(judged_invoices(spark, sf), "invoice")
    return out.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


def confidence_reports(spark, sf):
    out = judged_invoices(spark, sf)
    return out.groupBy("weakest", "type_confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.round(F.sum("warning_penalty"), 2).alias("penalties"))


def slots(spark, sf, *names):
    """id, name, value, confidence of these fields of the invoices: as a table, so that pages that are read once serve all that follows."""
    fields = B.extracted_fields(invoices(spark, sf), "doc_id", "text", "invoice", names)
    return written(fields.select("id", "name", "value", "confidence"), scratch(spark, "slots"))


def invoice_corrections(spark, sf):
    """Numbers typed in by a reviewer for invoices without one."""
    fields = slots(spark, sf, "invoice_number")
    typed = fields.filter("value is null").select("id", "name", F.concat(F.lit("INV-"), F.col("id").cast("string")).alias("value"))
    return B.corrected(fields, typed).select(F.col("id").alias("doc_id"), "value", "confidence", "corrected")


def filled_fields(spark, sf):
    """Slots that the patterns leave empty take another reader's values; others keep theirs."""
    fields = slots(spark, sf, "invoice_number", "iban")
    other = fields.select("id", "name", F.lit("from elsewhere").alias("value"), F.lit(0.5).alias("confidence"))
    return B.filled(fields, other).groupBy("name", (F.col("value") == "from elsewhere").alias("taken")).agg(F.count(F.lit(1)).alias("n"))


def review_outcomes(spark, sf):
    pages = invoices(spark, sf, mended=invoice_text(mended=True))
    return B.reviewed(pages, "doc_id", "text", "mended", "invoice", TODAY).groupBy("code", "outcome").agg(F.count(F.lit(1)).alias("n"))


def structured_invoices(spark, sf):
    out = B.structured(B.read_pages(invoices(spark, sf), "doc_id", "text", "invoice"), "invoice")
    return out.select(F.col("id").alias("doc_id"), F.size(F.json_object_keys("document")).cast("long").alias("n_fields"), F.get_json_object("document", "$.total_amount").alias("total"))


# Other types: a receipt, a purchase order or a contract for each order


def as_pages(rows, parts):
    return rows.select(F.col("k").alias("doc_id"), F.concat_ws("\n", *parts).alias("text"))


def receipts(spark, sf):
    """Every third order's till receipt: counted items, some without a number or a subtotal, some with the whole card number."""
    k = F.col("k")
    item = lambda r: F.concat(r["q"].cast("string"), F.lit(" x Part "), r["l_partkey"].cast("string"), F.lit(" rack      "), cents(r["t"]))
    return as_pages(invoice_rows(spark, sf).filter(k % 3 == 0), [
        F.concat(F.col("c_mktsegment"), F.lit(" CAFE (Leeds)")), F.when(k % 23 != 6, F.concat(F.lit("Receipt No: R-"), k.cast("string"))),
        F.concat(F.lit("Date: "), printed_day(), F.lit("     Time: 09:42")), F.lit("VAT No GB123456789"), F.lit("Till 7"), F.lit(""),
        F.array_join(F.transform("rows", item), "\n"), F.lit(""), F.when(k % 2 == 0, F.concat(F.lit("Subtotal      "), cents("s"))),
        F.concat(F.lit("VAT      "), cents("x")), F.concat(F.lit("Total   "), cents("t")),
        F.concat(F.lit("Paid by: "), F.when(k % 5 == 0, "card 4539 1488 0343 6467").otherwise("cash in full")), F.lit("Thank you")])


def purchase_orders(spark, sf):
    """Every third order as a purchase order: a table between double rules, the supplier on the line below its label, some in a stated currency."""
    k = F.col("k")
    return as_pages(invoice_rows(spark, sf).filter(k % 3 == 1), [
        F.concat(F.col("c_name"), F.lit(", of 3 Low Road")), F.lit("Purchase Order"), F.when(k % 23 != 6, F.concat(F.lit("PO Number: PO-"), k.cast("string"))),
        F.concat(F.lit("Order Date: "), printed_day()), F.concat(F.lit("Required By: "), F.date_format("due", "MMMM d, yyyy")), F.lit(""), F.lit("Supplier:"), F.lit(""),
        F.concat(F.col("c_mktsegment"), F.lit(" Goods Ltd, of 9 High Road")), F.lit(""), F.lit("=" * 40), F.array_join(F.transform("rows", printed_row), "\n"), F.lit("=" * 40),
        F.concat(F.lit("Net total   "), cents("s")), F.concat(F.lit("VAT   "), cents("x")), F.concat(F.lit("Order Total "), cents("t")),
        F.when(k % 2 == 0, "All sums in GBP"), F.concat(F.lit("Authorised by: Reader "), k.cast("string"))])


def contracts(spark, sf):
    """Every third order as a contract of a year in running text, some of which end before they begin."""
    k, day = F.col("k"), F.col("day")
    said = lambda d: F.date_format(d, "d MMMM yyyy")
    end = F.when(k % 19 == 5, F.date_add(day, 13)).otherwise(F.date_add(day, 365))
    return as_pages(invoice_rows(spark, sf).filter(k % 3 == 2), [
        F.lit("SERVICES AGREEMENT"), F.concat(F.lit("This agreement is made on "), said(day), F.lit(' ("the date")')), F.lit("between:"),
        F.concat(F.col("c_name"), F.lit(', of 12 Rowan Street ("the Client")')), F.lit("and:"), F.concat(F.col("c_mktsegment"), F.lit(' Goods Ltd ("the Supplier")')), F.lit(""),
        F.concat(F.lit("It commences on "), said(F.date_add(day, 14)), F.lit(" and continues until")), F.concat(F.lit(" "), said(end), F.lit(", hereby agreed by the parties.")),
        F.lit("3. CHARGES"), F.concat(F.lit("The annual value is "), cents("t"), F.lit(" EUR. The supplier shall be invoiced monthly.")),
        F.concat(F.lit("Payment Terms: "), (k % 60 + 11).cast("string"), F.lit(" days from the date of invoice")),
        F.concat(F.lit("Either of the parties may end it by giving "), (k % 90 + 11).cast("string"), F.lit(" days written notice.")),
        F.lit("Governing law: England and Wales"), F.lit("Signed for the Client")])


KINDS = {"receipt": receipts, "purchase_order": purchase_orders, "contract": contracts}


def document_types(spark, sf):
    out = None
    for printed in KINDS.values():
        docs = printed(spark, sf)
        out = docs if out is None else out.unionByName(docs)
    c = out.select("doc_id", B.classified(F.col("text")).alias("c"))
    return c.select("doc_id", "c.kind", "c.score", "c.sure", B.type_confidence(F.col("c")).alias("confidence"))


def page_fields(kind: str):
    def run(spark, sf):
        found = B.extracted_fields(KINDS[kind](spark, sf), "doc_id", "text", kind)
        return found.select(F.col("id").alias("doc_id"), "name", "value", "confidence")

    return run


def page_issues(spark, sf):
    out = None
    for kind, printed in KINDS.items():
        found = B.issues(printed(spark, sf), "doc_id", "text", kind, TODAY)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias("doc_id"), "code", "field", "severity")


def page_items(spark, sf):
    out = B.line_items(receipts(spark, sf).unionByName(purchase_orders(spark, sf)), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.col("item_no").cast("long").alias("item_no"), "description", "quantity", "unit_price", "total")


# Values


DAYS = ("yyyy-MM-dd", "d MMMM yyyy", "dd MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "dd/MM/yyyy", "d.M.yyyy", "dd-MM-yyyy")


def parsed_dates(spark, sf):
    """Order dates printed in eight ways, and some words, read back."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.lit("no date")
    for n, pattern in enumerate(DAYS):
        text = F.when(k % 9 == n, F.date_format(day, pattern)).otherwise(text)
    out = table(spark, sf, "orders").select(k, P.parsed_date(text).alias("d"), P.date_within(F.concat(F.lit("ref 77 on "), text, F.lit(" or so."))).alias("w"))
    return out.select("o_orderkey", F.date_format("d.value", "yyyy-MM-dd").alias("day"), "d.confidence", F.date_format("w.value", "yyyy-MM-dd").alias("within"))


def parsed_amounts(spark, sf):
    """Order totals printed in the ways of several countries, read back."""
    k, whole = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    units, rest = F.expr("whole div 100").cast("string"), F.lpad((F.col("whole") % 100).cast("string"), 2, "0")
    english = F.format_number(F.col("whole") / 100, 2)
    german = F.translate(english, ",.", ".,")
    text = F.when(k % 6 == 0, F.concat(F.lit("£"), english)).when(k % 6 == 1, F.concat(german, F.lit(" EUR"))).when(k % 6 == 2, F.concat(units, F.lit(","), rest)).when(k % 6 == 3, F.concat(F.lit("-"), units, F.lit("."), F.substring(rest, 1, 1), F.lit(" chf"))).when(k % 6 == 4, F.concat(F.lit("$ "), F.format_number(F.expr("whole div 100"), 0))).otherwise(F.lit("none"))
    rows = table(spark, sf, "orders").withColumn("whole", whole).select("o_orderkey", P.parsed_money(text).alias("m"))
    return rows.select("o_orderkey", "m.amount", "m.currency", "m.confidence")


def identifier_checks(spark, sf):
    """Account, registration and card numbers made from customer keys."""
    k = F.col("c_custkey")
    body = F.lpad(k.cast("string"), 18, "0")
    # A German account: check digits follow from the number.
    check = 98 - F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.substring(F.concat(body, F.lit("131400")), i, F.lit(1)).cast("int")), F.lit(0), lambda a, d: (a * 10 + d) % 97)
    iban = F.concat(F.lit("DE"), F.lpad((check + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"), 2, "0"), body)
    vat = F.concat(F.when(k % 2 == 0, "NL").otherwise("DE"), F.lpad(k.cast("string"), 9, "0"), F.when(k % 4 == 0, "B01").otherwise(""))
    card = F.concat(F.lit("400000"), F.lpad(k.cast("string"), 9, "0"), (k % 10).cast("string"))
    return spread(table(spark, sf, "customer")).select("c_custkey", T.iban_valid(iban, P.IBAN_LENGTHS).alias("iban"), P.vat_valid(vat).alias("vat"), T.luhn_valid(card).alias("card"))


def scanner_repairs(spark, sf):
    """Keys scanned with letters for digits, between words that stay."""
    k = F.translate(F.col("o_orderkey").cast("string"), "01", "Ol")
    out = table(spark, sf, "orders").select("o_orderkey", P.repaired_digits(F.concat(F.lit("Oil no. "), k, F.lit(", lot A1O; I0 "))).alias("r"))
    return out.select("o_orderkey", "r.text", F.col("r.repairs").cast("long").alias("repairs"))


def tidied_pages(spark, sf):
    text = F.concat(F.lit("\n\r\n"), F.replace(F.col("text"), F.lit(". "), F.lit(".  \r\n\u0007 \n\n\n\n")), F.lit("\t \n"))
    out = table(spark, sf, "conversations").select("conv_id", "turn", P.tidied(text).alias("t"))
    return out.select("conv_id", "turn", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


INV = """
l0 AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_quantity::BIGINT AS q, round(l_extendedprice * 100 / l_quantity)::BIGINT AS u FROM lineitem),
li AS (SELECT *, q * u + CASE WHEN k % 7 = 1 AND n = min(n) OVER (PARTITION BY k) THEN 100 ELSE 0 END AS t, row_number() OVER (PARTITION BY k ORDER BY n, p, q, u) - 1 AS item_no FROM l0),
sums AS (SELECT k, sum(q * u)::BIGINT AS plain, sum(t)::BIGINT AS listed FROM li GROUP BY k),
i0 AS (SELECT o_orderkey AS k, c_name, c_mktsegment || ' Goods Ltd' AS supplier, o_orderdate::DATE AS day, listed, plain + CASE WHEN o_orderkey % 11 = 2 THEN 500 ELSE 0 END AS s, CASE WHEN o_orderkey % 13 = 3 THEN 13 ELSE 20 END AS pct
  FROM orders JOIN sums ON o_orderkey = k JOIN customer ON c_custkey = o_custkey),
i1 AS (SELECT *, (s * pct + 50) // 100 AS x, day + CASE WHEN k % 19 = 5 THEN -5 ELSE 30 END::INT AS due FROM i0),
inv AS (SELECT *, s + x + CASE WHEN k % 17 = 4 THEN 1000 ELSE 0 END AS t, CASE WHEN k % 23 = 6 THEN NULL ELSE 'INV-' || k END AS number,
  CASE WHEN k % 4 IN (0, 1) THEN 0.9 WHEN k % 4 = 2 AND day(day) > 12 THEN 0.855 WHEN k % 4 = 2 THEN 0.54 ELSE 0.765 END::DOUBLE AS dconf FROM i1)"""
ISSUES = f"""
iss0 AS (
  SELECT k, 'required_field_missing' AS code, 'invoice_number' AS field FROM inv WHERE number IS NULL
  UNION ALL SELECT k, 'low_confidence_required_field', 'invoice_date' FROM inv WHERE dconf < 0.7
  UNION ALL SELECT k, 'line_item_does_not_multiply', 'line_items[' || item_no || ']' FROM li JOIN inv USING (k) WHERE li.t <> q * u
  UNION ALL SELECT k, 'line_items_do_not_sum_to_subtotal', 'subtotal' FROM inv WHERE listed <> s
  UNION ALL SELECT k, 'subtotal_plus_tax_is_not_total', 'total_amount' FROM inv WHERE k % 17 = 4
  UNION ALL SELECT k, 'unusual_tax_rate', 'tax_amount' FROM inv WHERE list_min(list_transform({list(B.TAX_RATES)}, lambda r: abs(x * 100.0::DOUBLE / s - r))) > 0.35
  UNION ALL SELECT k, 'iban_checksum_failed', 'iban' FROM inv WHERE k % 29 = 7
  UNION ALL SELECT k, 'vat_number_format_wrong', 'supplier_vat' FROM inv WHERE k % 31 = 8
  UNION ALL SELECT k, 'document_dated_in_the_future', 'invoice_date' FROM inv WHERE day > DATE '{TODAY}' + 30
  UNION ALL SELECT k, 'document_very_old', 'invoice_date' FROM inv WHERE DATE '{TODAY}' - day > 1825
  UNION ALL SELECT k, 'due_before_issue', 'due_date' FROM inv WHERE due < day
  UNION ALL SELECT k, 'document_says_it_is_a_duplicate', '' FROM inv WHERE k % 37 = 9),
iss AS (SELECT *, CASE WHEN code IN {B.WARNINGS} THEN 'warning' ELSE 'error' END AS severity FROM iss0)"""
TWO = lambda c: f"printf('%.2f', {c} / 100.0::DOUBLE)"
REPORTS = """
conf AS (SELECT inv.*, CASE WHEN number IS NULL THEN 0.865 ELSE 0.97 END::DOUBLE AS tc, CASE WHEN number IS NULL THEN 0 ELSE 0.93 END::DOUBLE AS nc,
  (SELECT count(*) FROM iss WHERE iss.k = inv.k AND severity = 'error') AS errors, (SELECT count(*) FROM iss WHERE iss.k = inv.k AND severity = 'warning') AS warnings FROM inv),
rep AS (SELECT *, least(0.12::DOUBLE, warnings * 0.03::DOUBLE) AS penalty, round(tc * 0.25::DOUBLE + round((nc + dconf + 0.85::DOUBLE + 0.92::DOUBLE) / 4, 3) * 0.75::DOUBLE - least(0.12::DOUBLE, warnings * 0.03::DOUBLE), 3) AS confidence,
  CASE WHEN nc < dconf THEN 'invoice_number' WHEN dconf < 0.85 THEN 'invoice_date' ELSE 'supplier_name' END AS weakest FROM conf)"""


def page_sql(rest: int, fields: list[tuple[str, str, str]]) -> str:
    """Fields of the pages whose key leaves a remainder by three: name, value, and confidence where there is a value."""
    rows = ", ".join(f"('{n}', ({v})::VARCHAR, CASE WHEN ({v}) IS NOT NULL THEN {c} END::DOUBLE)" for n, v, c in fields)
    return f"WITH {INV} SELECT k AS doc_id, f.name, f.value, f.confidence FROM inv, LATERAL (VALUES {rows}) f(name, value, confidence) WHERE k % 3 = {rest}"


NUMBERED = "CASE WHEN number IS NOT NULL THEN '{p}-' || k END"
RECEIPT = [("receipt_number", NUMBERED.format(p="R"), 0.93), ("receipt_date", "day", "dconf"), ("merchant_name", "replace(supplier, ' Goods Ltd', ' CAFE')", 0.85), ("supplier_vat", "'GB123456789'", 0.93), ("subtotal", f"CASE WHEN k % 2 = 0 THEN {TWO('s')} END", 0.92), ("tax_amount", TWO("x"), 0.92), ("total_amount", TWO("t"), 0.92), ("payment_method", "CASE WHEN k % 5 = 0 THEN 'card 4539 1488 0343 6467' ELSE 'cash in full' END", 0.85), ("currency", "'GBP'", 0.6)]
ORDER = [("po_number", NUMBERED.format(p="PO"), 0.93), ("order_date", "day", "dconf"), ("required_by_date", "due", 0.9), ("buyer_name", "c_name", 0.85), ("supplier_name", "supplier", 0.88), ("subtotal", TWO("s"), 0.92), ("tax_amount", TWO("x"), 0.92), ("total_amount", TWO("t"), 0.92), ("authorised_by", "'Reader ' || k", 0.85), ("currency", "CASE WHEN k % 2 = 0 THEN 'GBP' END", 0.95)]
ENDS = "(day + CASE WHEN k % 19 = 5 THEN 13 ELSE 365 END::INT)"
CONTRACT = [("agreement_date", "day", 0.9), ("party_one", "c_name", 0.88), ("party_two", "supplier", 0.88), ("start_date", "day + 14", 0.9), ("end_date", ENDS, 0.9), ("contract_value", TWO("t"), 0.92), ("payment_terms", "(k % 60 + 11) || ' days from the date of invoice'", 0.85), ("notice_period", "'Either of the parties may end it by giving ' || (k % 90 + 11) || ' days written notice.'", 0.85), ("governing_law", "'England and Wales'", 0.85), ("currency", "'EUR'", 0.95)]
#: Items of receipts have their price from the total and the count, rounded half up in cents; those of purchase orders print it.
PRINTED = "printed AS (SELECT k, item_no, 'Part ' || p || ' rack' AS description, q::DOUBLE AS quantity, CASE WHEN k % 3 = 0 THEN ((2 * li.t + q) // (2 * q)) / 100.0::DOUBLE ELSE u / 100.0::DOUBLE END AS unit_price, li.t / 100.0::DOUBLE AS total FROM li JOIN inv USING (k) WHERE k % 3 < 2)"
DATED = "CASE k % 3 WHEN 0 THEN 'receipt_date' WHEN 1 THEN 'order_date' ELSE 'agreement_date' END"
#: Subtotals stand on purchase orders and on every other receipt.
PAGE_ISSUES = f"""
pi AS (
  SELECT k, 'required_field_missing' AS code, 'po_number' AS field FROM inv WHERE k % 3 = 1 AND number IS NULL
  UNION ALL SELECT k, 'low_confidence_required_field', {DATED} FROM inv WHERE k % 3 < 2 AND dconf < 0.7
  UNION ALL SELECT k, 'line_item_does_not_multiply', 'line_items[' || item_no || ']' FROM printed WHERE abs(round(quantity * unit_price, 2) - total) > 0.02 + 1e-9
  UNION ALL SELECT k, 'line_items_do_not_sum_to_subtotal', 'subtotal' FROM inv WHERE (k % 3 = 1 OR (k % 3 = 0 AND k % 2 = 0)) AND abs(listed - s) > 2
  UNION ALL SELECT k, 'subtotal_plus_tax_is_not_total', 'total_amount' FROM inv WHERE (k % 3 = 1 OR (k % 3 = 0 AND k % 2 = 0)) AND abs(s + x - t) > 5
  UNION ALL SELECT k, 'line_items_do_not_sum_to_total', 'total_amount' FROM inv WHERE k % 3 = 0 AND k % 2 = 1 AND abs(listed + x - t) > 5
  UNION ALL SELECT k, 'unusual_tax_rate', 'tax_amount' FROM inv WHERE (k % 3 = 1 OR (k % 3 = 0 AND k % 2 = 0)) AND list_min(list_transform({list(B.TAX_RATES)}, lambda r: abs(x * 100.0::DOUBLE / s - r))) > 0.35
  UNION ALL SELECT k, 'full_card_number_on_document', 'payment_method' FROM inv WHERE k % 3 = 0 AND k % 5 = 0
  UNION ALL SELECT k, 'document_dated_in_the_future', {DATED} FROM inv WHERE day > DATE '{TODAY}' + 30
  UNION ALL SELECT k, 'document_very_old', {DATED} FROM inv WHERE DATE '{TODAY}' - day > 1825
  UNION ALL SELECT k, 'due_before_issue', 'required_by_date' FROM inv WHERE k % 3 = 1 AND due < day
  UNION ALL SELECT k, 'term_ends_before_it_starts', 'end_date' FROM inv WHERE k % 3 = 2 AND k % 19 = 5)"""
#: By kind of page: its phrases' weights, less those of the number where there is none.
TYPED = "SELECT k, CASE k % 3 WHEN 0 THEN 2.0 + CASE WHEN number IS NULL THEN 0 ELSE 7 END WHEN 1 THEN 11.0 + CASE WHEN number IS NULL THEN 0 ELSE 4 END ELSE 19.5 END::DOUBLE AS score, CASE k % 3 WHEN 2 THEN 2.5 ELSE 0 END::DOUBLE AS other FROM inv"
CARD = "lpad('400000' || lpad(c_custkey::VARCHAR, 9, '0') || c_custkey % 10, 16, '0')"
LUHN = f"list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 1 THEN substr({CARD}, i + 1, 1)::INT WHEN substr({CARD}, i + 1, 1)::INT > 4 THEN substr({CARD}, i + 1, 1)::INT * 2 - 9 ELSE substr({CARD}, i + 1, 1)::INT * 2 END)) % 10 = 0"
DIRTY = "chr(10) || chr(13) || chr(10) || replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(7) || ' ' || repeat(chr(10), 4)) || chr(9) || ' ' || chr(10)"
TIDY = rf"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({DIRTY}, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(160), ' '), '(?m)[ \t]+$', '', 'g'), '\n{{4,}}', repeat(chr(10), 3), 'g'), '^\n+|\n+$', '', 'g')"

QUERIES = {
    "invoice_fields": (invoice_fields, f"WITH {INV} SELECT k AS doc_id, f.name, f.value, f.confidence FROM inv, LATERAL (VALUES ('invoice_number', number, CASE WHEN number IS NULL THEN NULL ELSE 0.93 END::DOUBLE), ('invoice_date', day::VARCHAR, dconf), ('due_date', due::VARCHAR, 0.9), ('supplier_name', supplier, 0.85), ('supplier_vat', CASE WHEN k % 31 = 8 THEN 'GB12345' ELSE 'GB123456789' END, 0.93), ('customer_name', c_name, 0.88), ('subtotal', {TWO('s')}, 0.92), ('tax_amount', {TWO('x')}, 0.92), ('total_amount', {TWO('t')}, 0.92), ('iban', CASE WHEN k % 29 = 7 THEN '{BAD_IBAN}' ELSE '{GOOD_IBAN}' END, 0.93), ('payment_terms', '30 days net', 0.85), ('currency', 'GBP', 0.6)) f(name, value, confidence)"),
    "invoice_line_items": (invoice_line_items, f"WITH {INV} SELECT k AS doc_id, item_no, 'Part ' || p || ' rack' AS description, q::DOUBLE AS quantity, u / 100.0::DOUBLE AS unit_price, li.t / 100.0::DOUBLE AS total FROM li JOIN inv USING (k)"),
    "invoice_issues": (invoice_issues, f"WITH {INV}, {ISSUES} SELECT k AS doc_id, code, field, severity FROM iss"),
    "issue_order": (issue_order, f"WITH {INV}, {ISSUES} SELECT code, count(*) AS n FROM (SELECT code FROM iss QUALIFY row_number() OVER (PARTITION BY k ORDER BY severity, code, field) = 1) GROUP BY 1"),
    "invoice_decisions": (invoice_decisions, f"WITH {INV}, {ISSUES}, {REPORTS}, d AS (SELECT t / 100.0::DOUBLE AS amount, CASE WHEN errors > 0 THEN 'errors' WHEN confidence < 0.85 THEN 'confidence' WHEN least(nc, dconf) < 0.7 THEN 'field' WHEN t > 1000000 THEN 'amount' ELSE '' END AS reason FROM rep) SELECT CASE WHEN reason = '' THEN 'AUTO_APPROVE' ELSE 'NEEDS_REVIEW' END AS decision, reason, count(*) AS n, round(sum(amount), 2) AS amount FROM d GROUP BY 1, 2"),
    "confidence_reports": (confidence_reports, f"WITH {INV}, {ISSUES}, {REPORTS} SELECT weakest, tc AS type_confidence, count(*) AS n, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, round(sum(penalty), 2) AS penalties FROM rep GROUP BY 1, 2"),
    "invoice_corrections": (invoice_corrections, f"WITH {INV} SELECT k AS doc_id, 'INV-' || k AS value, CASE WHEN number IS NULL THEN 1.0 ELSE 0.93 END::DOUBLE AS confidence, number IS NULL AS corrected FROM inv"),
    "filled_fields": (filled_fields, f"WITH {INV} SELECT name, taken, count(*) AS n FROM (SELECT 'iban' AS name, false AS taken FROM inv UNION ALL SELECT 'invoice_number', number IS NULL FROM inv) GROUP BY 1, 2"),
    "review_outcomes": (review_outcomes, f"WITH {INV}, {ISSUES} SELECT code, CASE WHEN code IN ('iban_checksum_failed', 'required_field_missing') THEN 'fixed' ELSE 'remaining' END AS outcome, count(*) AS n FROM iss GROUP BY 1, 2"),
    "structured_invoices": (structured_invoices, f"WITH {INV} SELECT k AS doc_id, CASE WHEN number IS NULL THEN 11 ELSE 12 END AS n_fields, {TWO('t')} AS total FROM inv"),
    "receipt_fields": (page_fields("receipt"), page_sql(0, RECEIPT)),
    "purchase_order_fields": (page_fields("purchase_order"), page_sql(1, ORDER)),
    "contract_fields": (page_fields("contract"), page_sql(2, CONTRACT)),
    "document_types": (document_types, f"WITH {INV}, c AS ({TYPED}) SELECT k AS doc_id, CASE WHEN score < 4 THEN 'unknown' ELSE ['receipt', 'purchase_order', 'contract'][k % 3 + 1] END AS kind, score, score >= 4 AND score - other >= 2 AS sure, CASE WHEN score < 4 THEN 0 ELSE round(least(0.97::DOUBLE, 0.55::DOUBLE + 0.28::DOUBLE * least(1, score / 10) + 0.14::DOUBLE * least(1, (score - other) / 10)), 3) END::DOUBLE AS confidence FROM c"),
    "page_issues": (page_issues, f"WITH {INV}, {PRINTED}, {PAGE_ISSUES} SELECT k AS doc_id, code, field, CASE WHEN code IN {B.WARNINGS} THEN 'warning' ELSE 'error' END AS severity FROM pi"),
    "identifier_checks": (identifier_checks, f"SELECT c_custkey, c_custkey % 3 <> 0 AS iban, c_custkey % 2 = 1 OR c_custkey % 4 = 0 AS vat, {LUHN} AS card FROM customer"),
    "tidied_pages": (tidied_pages, f"SELECT conv_id, turn, len(t) AS chars, md5(t) AS digest FROM (SELECT conv_id, turn, {TIDY} AS t FROM conversations)"),
    "page_items": (page_items, f"WITH {INV}, {PRINTED} SELECT k AS doc_id, item_no, description, quantity, unit_price, total FROM printed"),
    "parsed_dates": (parsed_dates, "SELECT o_orderkey, CASE WHEN n < 8 THEN strftime(day, '%Y-%m-%d') END AS day, CASE n WHEN 5 THEN CASE WHEN day(day) > 12 THEN 0.95 ELSE 0.6 END WHEN 6 THEN 0.85 WHEN 7 THEN 0.7 WHEN 8 THEN NULL ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN n < 8 THEN strftime(day, '%Y-%m-%d') END AS within FROM (SELECT o_orderkey, o_orderkey % 9 AS n, o_orderdate::DATE AS day FROM orders)"),
    "parsed_amounts": (parsed_amounts, "SELECT o_orderkey, CASE n WHEN 5 THEN NULL WHEN 4 THEN w // 100 WHEN 3 THEN -((w // 10) / 10.0::DOUBLE) ELSE w / 100.0::DOUBLE END::DOUBLE AS amount, CASE n WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 3 THEN 'CHF' WHEN 4 THEN 'USD' ELSE '' END AS currency, CASE n WHEN 5 THEN 0.0 WHEN 3 THEN 0.8 WHEN 4 THEN CASE WHEN w >= 100000000 OR w < 100000 THEN 1.0 ELSE 0.55 END ELSE 1.0 END::DOUBLE AS confidence FROM (SELECT o_orderkey, o_orderkey % 6 AS n, round(o_totalprice * 100)::BIGINT AS w FROM orders)"),
    "scanner_repairs": (scanner_repairs, "SELECT o_orderkey, 'Oil no. ' || CASE WHEN regexp_matches(o_orderkey::VARCHAR, '[2-9]') THEN o_orderkey::VARCHAR ELSE translate(o_orderkey::VARCHAR, '01', 'Ol') END || ', lot A1O; 10 ' AS text, 1 + CASE WHEN regexp_matches(o_orderkey::VARCHAR, '[2-9]') AND regexp_matches(o_orderkey::VARCHAR, '[01]') THEN 1 ELSE 0 END AS repairs FROM orders"),
}
