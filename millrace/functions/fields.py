"""Values on printed pages as column expressions: numbers, money, dates, labels, registration numbers, scanner repairs."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Phrases, once

#: Shapes of numbers, dates and rules, currencies, separators, and formats of dates with their confidence.
NUMBER = r"-?\d+(?:[.,\s]\d{3})*(?:[.,]\d{1,2})?(?!\d)"
DATE_SHAPES = (r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\b", r"\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}\b", r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}\b")
RULE = r"^[\s\-=_]{10,}$"
CURRENCY_SYMBOLS = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY", "₹": "INR"}
CURRENCY_CODES = ("USD", "GBP", "EUR", "JPY", "INR", "CHF", "CAD", "AUD", "SEK", "NOK", "DKK", "PLN")
DATE_FORMATS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d", 1.0),
    (r"\d{1,2} [A-Za-z]+ \d{4}", "d MMMM yyyy", 1.0),
    (r"\d{1,2} [A-Za-z]+ \d{4}", "d MMM yyyy", 1.0),
    (r"[A-Za-z]+ \d{1,2}, \d{4}", "MMMM d, yyyy", 1.0),
    (r"[A-Za-z]+ \d{1,2}, \d{4}", "MMM d, yyyy", 1.0),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy", 0.6),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy", 0.6),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy", 0.85),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy", 0.7),
)
#: By shape of dates, the formats that may read it.
FORMATS_OF_SHAPES = (DATE_FORMATS[:1], DATE_FORMATS[1:3], DATE_FORMATS[3:5], DATE_FORMATS[5:])
VAT_SHAPES = {
    "GB": r"^GB(\d{9}|\d{12}|GD\d{3}|HA\d{3})$", "DE": r"^DE\d{9}$", "FR": r"^FR[A-Z0-9]{2}\d{9}$", "ES": r"^ES[A-Z0-9]\d{7}[A-Z0-9]$", "IT": r"^IT\d{11}$",
    "NL": r"^NL\d{9}B\d{2}$", "IE": r"^IE\d{7}[A-Z]{1,2}$", "PL": r"^PL\d{10}$", "SE": r"^SE\d{12}$", "BE": r"^BE0\d{9}$",
}
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22,
    "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SE": 24, "SI": 19, "SK": 24,
}
TOTALS = ("subtotal", "sub total", "net total", "total", "vat", "tax", "discount", "shipping", "carriage", "balance", "due", "amount payable")
HEADERS = ("description", "qty", "quantity", "unit price", "amount", "item")
SUMMARY = r"(?u:\b)(" + "|".join(TOTALS) + r")(?u:\b)"


def number(digits: Column) -> Column:
    """struct(value, confidence) of a printed number.

    With both marks the later is the decimal one; a mark that repeats groups; with two digits behind it a
    mark is decimal; with three it groups, at 0.55; any other is decimal, at 0.8.
    """
    negative = F.startswith(digits, F.lit("-"))

    def of(bare: Column) -> Column:
        commas, points = (F.length(bare) - F.length(F.replace(bare, F.lit(mark), F.lit(""))) for mark in (",", "."))
        behind_comma = F.substring_index(bare, ",", -1)
        both, repeats, none = (commas > 0) & (points > 0), commas + points > 1, commas + points == 0
        tail = F.length(F.substring_index(behind_comma, ".", -1))
        # The mark that isn't the last one goes; a comma left over is decimal.
        english, german = F.replace(bare, F.lit(","), F.lit("")), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        decimal = F.when(F.contains(behind_comma, F.lit(".")), english).otherwise(german)
        grouped = F.translate(bare, ".,", "")
        plain = F.when(none, bare).when(both, decimal).when(repeats | (tail == 3), grouped).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
        sure = F.when(none | both | repeats | (tail == 2), 1.0).when(tail == 3, 0.55).otherwise(0.8)
        value = plain.try_cast("double") * F.when(negative, -1.0).otherwise(1.0)
        return once(value, lambda v: F.struct(v.alias("value"), F.when(v.isNotNull(), sure).otherwise(0.0).alias("confidence")))

    unsigned = F.when(negative, F.substring(digits, 2, 2**31 - 1)).otherwise(digits)
    # Most have one point, before two digits, and commas that group: they are read without looking at the marks.
    english = F.struct(F.replace(digits, F.lit(","), F.lit("")).try_cast("double").alias("value"), F.lit(1.0).alias("confidence"))
    return F.when(digits.rlike(r"^-?\d+(?:,\d{3})*\.\d\d\z"), english).otherwise(once(F.translate(unsigned, " \t\n\x0b\f\r", ""), of))


def plain_number(digits: str) -> float | None:
    """The value of number(), for a text in Python."""
    # Most have no marks, or one point before two digits, which is decimal.
    if digits.isdecimal():
        return float(digits)
    if digits[-3:-2] == "." and digits[-2:].isdecimal() and digits.count(".") == 1:
        try:
            return float(digits.replace(",", ""))
        except ValueError:
            pass
    negative = digits.startswith("-")
    bare = digits[1:] if negative else digits
    if not bare.isprintable() or " " in bare:
        bare = re.sub(r"[ \t\n\x0b\f\r]", "", bare)
    commas, points = bare.count(","), bare.count(".")
    behind_comma = bare.rsplit(",", 1)[-1]
    if commas and points:
        bare = bare.replace(",", "") if "." in behind_comma else bare.replace(".", "").replace(",", ".")
    elif commas + points > 1 or (commas + points and len(behind_comma.rsplit(".", 1)[-1]) == 3):
        bare = bare.replace(",", "").replace(".", "")
    try:
        value = float(bare.replace(",", "."))
    except ValueError:
        return None
    return -value if negative else value


def half_up(x: float, places: int) -> float:
    """As F.round() rounds."""
    digits = repr(x)
    if "e" not in digits and len(digits) - digits.find(".") - 1 <= places:
        return x
    return float(Decimal(digits).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) if math.isfinite(x) else x


#: Signs of currencies that texts in capitals may hold.
SIGNS = Phrases((*CURRENCY_SYMBOLS, *CURRENCY_CODES), upper=True)


def currency(text: Column, holds: Callable[[str], Column] | None = None) -> Column:
    """By symbol, else by code as a word; '' without either. holds tells of each sign whether the text in capitals has it, if that is known."""

    def coded(upper: Column) -> Column:
        out = F.lit("")
        for code in reversed(CURRENCY_CODES):
            # Most texts hold none, which is seen without a pattern.
            out = F.when((holds(code) if holds else F.contains(upper, F.lit(code))) & upper.rlike(rf"\b{code}\b"), code).otherwise(out)
        return out

    out = coded(F.upper(text)) if holds else once(F.upper(text), coded)
    for symbol, code in reversed(CURRENCY_SYMBOLS.items()):
        out = F.when(holds(symbol) if holds else F.contains(text, F.lit(symbol)), code).otherwise(out)
    return out


def parsed_money(text: Column) -> Column:
    """struct(amount, currency, confidence) of the first number; amount null without one."""
    of = lambda n: F.struct(n["value"].alias("amount"), currency(text).alias("currency"), n["confidence"].alias("confidence"))
    return once(once(F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), NUMBER, 0), number), of)


def money_on_line(text: Column) -> Column:
    """struct(amount, confidence, raw) of the last number, rounded to cents; null without one."""
    of = lambda raw: once(number(raw), lambda n: F.when(n["value"].isNotNull(), F.struct(F.round(n["value"], 2).alias("amount"), n["confidence"].alias("confidence"), raw.alias("raw"))))
    return once(F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1)), of)


def at_confidence(sure: Column) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), sure.cast("double").alias("confidence")))


def with_raw(raw: Column) -> Callable[[Column], Column]:
    return lambda d: F.when(d.isNotNull(), F.struct(d["value"].alias("value"), d["confidence"].alias("confidence"), raw.alias("raw")))


def parsed_date(text: Column, formats: Sequence[tuple[str, str, float]] = DATE_FORMATS) -> Column:
    """struct(value, confidence): the first of the formats that reads the text; a day above 12 before a stroke settles the order at 0.95."""

    def of(bare: Column) -> Column:
        out = F.lit(None).cast("struct<value:date,confidence:double>")
        for shape, pattern, sure in reversed(formats):
            value = F.when(bare.rlike(f"^{shape}$"), F.try_to_timestamp(bare, F.lit(pattern)).cast("date"))
            settled = F.when(F.contains(bare, F.lit("/")) & (F.substring_index(bare, "/", 1).try_cast("int") > 12), 0.95).otherwise(sure) if sure < 1 else F.lit(sure)
            out = F.coalesce(once(value, at_confidence(settled)), out)
        return out

    # Capitals matter to names of months alone.
    return once(F.initcap(F.trim(text)) if any("MMM" in pattern for _, pattern, _ in formats) else F.trim(text), of)


def date_within(text: Column) -> Column:
    """struct(value, confidence, raw) of the first of DATE_SHAPES that stands in the text and can be read."""
    read = lambda formats: lambda raw: F.when(raw != "", once(parsed_date(raw, formats), with_raw(raw)))
    # Shapes are looked for until one can be read, each by the formats that texts of the shape can have.
    return F.coalesce(*[once(F.trim(F.regexp_extract(text, shape, 0)), read(formats)) for shape, formats in zip(DATE_SHAPES, FORMATS_OF_SHAPES, strict=True)])


def literally(phrase: str) -> str:
    """A pattern of the phrase itself."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)


def label_shape(label: str) -> str:
    """A pattern of a label in any case, not within a longer word."""
    return rf"(?i)(?:(?<!\w)|(?!\w)){literally(label)}(?:(?<!\w)|(?!\w))"


def behind(line: Column, shape: Column) -> Column:
    """What stands behind the first place of a shape (of label_shape), without the separators; a hyphen at digits stays."""
    rest = F.call_function("regexp_extract", line, F.concat(F.lit("(?s)^.*?"), shape, F.lit("(.*)$")), F.lit(1))
    return F.regexp_replace(rest, r"^(?:\s|[:=.–—]|-(?=\s|$))+", "")


def after_label(line: Column, label: str) -> Column:
    """What stands behind a label; null where the label doesn't stand."""
    shape = label_shape(label)
    return F.when(line.rlike(shape), behind(line, F.lit(shape)))


def to_column_gap(value: Column) -> Column:
    """The part before three blanks or more."""
    return F.trim(F.element_at(F.split(value, r"\s{3,}", 2), 1))


def company(value: Column) -> Column:
    """A party's name without the address or term behind it."""
    cut = value
    for mark in (",of ", " (", " of ", ", of "):
        cut = F.when(F.locate(mark, value) > 1, F.substring_index(value, mark, 1)).otherwise(cut)
    return F.regexp_replace(F.trim(cut), ",+$", "")


def bare_identifier(text: Column) -> Column:
    """Letters and digits, in capitals."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def matching_key(text: Column) -> Column:
    """Letters and digits, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def vat_valid(text: Column) -> Column:
    """The shape of the country's numbers where it is known; three characters or fewer are none."""
    bare = bare_identifier(text)
    known = F.lit(True)
    for country, shape in VAT_SHAPES.items():
        known = F.when(F.startswith(bare, F.lit(country)), bare.rlike(shape)).otherwise(known)
    return (F.length(bare) >= 4) & known


def repaired_digits(text: Column) -> Column:
    """struct(text, repairs): in runs of letters and digits that hold a digit and otherwise O, o, l and I only, these become 0, 0, 1 and 1."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+"), F.lit(0))
    between = F.split(text, "[A-Za-z0-9]+")
    odd = lambda r: r.rlike(r"^[0-9OolI]*$") & r.rlike("[0-9]") & r.rlike("[OolI]")
    mended = F.transform(runs, lambda r: F.when(odd(r), F.translate(r, "OolI", "0011")).otherwise(r))
    whole = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(runs)), mended, lambda b, r: F.concat(b, r)), ""), F.element_at(between, -1))
    return F.struct(whole.alias("text"), F.size(F.filter(runs, odd)).alias("repairs"))


def tidied(text: Column) -> Column:
    """Line ends as \\n, no control characters, plain blanks, none at line ends, three line ends in a row at most, none at the ends."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    out = F.regexp_replace(F.replace(out, F.lit(" "), F.lit(" ")), r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{4,}", "\n\n\n"), r"^\n+|\n+$", "")
