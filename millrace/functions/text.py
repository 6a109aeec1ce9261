"""Text as column expressions: words, stems, sentences, cleaning, windows of words, money and dates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache, lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed a single time however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


class Phrases:
    """Which of up to 63 phrases texts hold, as the bits of a number; case as of the lower-cased text, or that in capitals.

    Texts are looked through by line in an Arrow helper that keeps what it found of lines: documents of a kind share most of theirs. Where no phrase
    has a digit, lines that differ in digits alone count as the same."""

    KEPT = 50_000

    def __init__(self, phrases: Sequence[str], upper: bool = False):
        self.phrases, self.upper = list(dict.fromkeys(phrases)), upper
        if len(self.phrases) > 63 or any("\n" in p for p in self.phrases):
            raise ValueError("up to 63 phrases within lines")

    def holds(self, held: Column, phrase: str) -> Column:
        return F.getbit(held, F.lit(self.phrases.index(phrase))) == 1

    def held_by(self, text: Column) -> Column:
        phrases, case = tuple(self.phrases), str.upper if self.upper else str.lower

        @F.arrow_udf("long")
        def held(texts: pa.Array) -> pa.Array:
            by_line, likeness = bits_of(phrases)
            found = lambda t: reduce(or_, map(by_line, set(case(t).encode().translate(likeness).split(b"\n"))))
            return pa.array([None if t is None else found(t) for t in texts.to_pylist()], pa.int64())

        return held(text)


@cache
def bits_of(phrases: tuple[str, ...]) -> tuple[Callable[[bytes], int], bytes | None]:
    """A function of lines that gives the bits of the phrases they hold, and how bytes are to be made alike before."""
    encoded = [p.encode() for p in phrases]
    by_line = lru_cache(Phrases.KEPT)(lambda line: sum(1 << n for n, p in enumerate(encoded) if p in line))
    return by_line, None if any(c.isdigit() for p in phrases for c in p) else bytes.maketrans(b"123456789", b"0" * 9)


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def keywords(text: Column, stop_words: Sequence[str], least: int = 2) -> Column:
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.filter(words(text), lambda w: ~F.array_contains(stop, w) & (F.length(w) >= least))


def stem(word: Column) -> Column:
    """Words of up to four letters stay; else the first of ing, ies, ied, es, ed, s that leaves three letters goes, ies leaving y."""
    out = word
    for ending in ("s", "ed", "es", "ied", "ies", "ing"):
        cut = F.substring(word, F.lit(1), F.length(word) - len(ending))
        shorter = F.concat(cut, F.lit("y")) if ending == "ies" else cut
        out = F.when(F.endswith(word, F.lit(ending)) & (F.length(word) - len(ending) >= 3), shorter).otherwise(out)
    return F.when(F.length(word) <= 4, word).otherwise(out)


def stems(text: Column, stop_words: Sequence[str]) -> Column:
    return F.transform(keywords(text, stop_words), stem)


def sentences(text: Column) -> Column:
    """Split behind . ! ? and white space; line ends count as blanks; empty ones go."""
    pieces = F.split(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), r"(?<=[.!?])\s+")
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda s: s != "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, most: int = 280) -> Column:
    """Cut at a blank within most characters if that leaves more than 40; three dots mark the cut."""
    head = F.substring(text, 1, most)
    at_blank = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    cut = F.when(F.length(at_blank) > 40, at_blank).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(cut), F.lit("...")))


def overlap_share(question: Column, passage: Column) -> Column:
    """Part of the distinct stems of the question that the passage has; 0 without any."""
    asked = F.array_distinct(question)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, passage)), F.size(asked)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; both empty: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def word_windows(text: Column, size: int = 180, overlap: int = 40, least_tail: int = 12) -> Column:
    """Windows of size words, each beginning size - overlap behind the last; a tail of fewer than least_tail new words joins the window before it."""
    step = size - overlap

    def windows(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
        kept = F.filter(starts, lambda s: (s == 0) | (n - s - overlap >= least_tail))
        cut = lambda k: F.transform(kept, lambda s, i: F.array_join(F.slice(w, s + 1, F.when(i == k - 1, n).otherwise(F.lit(size))), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(once(F.size(kept), cut))

    return once(F.filter(F.split(text, r"\s+"), lambda x: x != ""), windows)


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles, navigation, footers, comments and tags; blank lines go."""
    bare = html
    for tag in ("script", "style", "nav", "footer"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    lines = F.split(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n"), r"\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def markers(answer: Column) -> Column:
    """Distinct citation numbers [n] in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int")))


def without_markers(answer: Column) -> Column:
    return collapsed(F.regexp_replace(answer, r"\[\d+\]", " "))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), 0), lambda x: x.try_cast("double"))


def money(text: Column) -> Column:
    """The first number of a text: with both marks the later one is the decimal mark; one mark with two digits behind it is decimal; with three, grouping; null without digits."""
    raw = F.regexp_extract(text, r"-?\d[\d.,]*", 0)
    bare = F.rtrim(F.regexp_replace(raw, r"[.,]+$", ""))
    comma, dot = F.length(F.regexp_replace(bare, r"[^,]", "")), F.length(F.regexp_replace(bare, r"[^.]", ""))
    comma_last = F.length(F.substring_index(bare, ",", -1)) < F.length(F.substring_index(bare, ".", -1))
    decimal_comma = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    decimal_dot = F.replace(bare, F.lit(","), F.lit(""))
    grouped = F.regexp_replace(bare, r"[.,]", "")
    plain = (
        F.when((comma > 0) & (dot > 0), F.when(comma_last, decimal_comma).otherwise(decimal_dot))
        .when(comma + dot > 1, grouped)
        .when(bare.rlike(r"[.,]\d{3}$"), grouped)
        .when(comma == 1, decimal_comma)
        .otherwise(bare)
    )
    return plain.try_cast("double")


def iban_valid(iban: Column, lengths: dict[str, int]) -> Column:
    """Country length where it is known, and remainder 1 of 97 over the moved digits, taken character by character: a letter stands for two digits."""
    known = F.create_map(*[F.lit(x) for pair in lengths.items() for x in pair])

    def valid(clean: Column) -> Column:
        moved = F.concat(F.substring(clean, F.lit(5), F.length(clean)), F.substring(clean, 1, 4))
        codes = F.transform(F.split(moved, ""), F.ascii)
        rest = F.aggregate(codes, F.lit(0), lambda acc, c: F.when(c >= 65, (acc * 100 + c - 55) % 97).when(c >= 48, (acc * 10 + c - 48) % 97).otherwise(acc))
        right_length = F.coalesce(F.try_element_at(known, F.substring(clean, 1, 2)) == F.length(clean), F.lit(True))
        return clean.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{10,30}$") & right_length & (rest == 1)

    return once(F.upper(F.regexp_replace(iban, r"[^0-9A-Za-z]", "")), valid)


def luhn_valid(digits: Column) -> Column:
    bare = F.regexp_replace(digits, r"[ -]", "")
    return bare.rlike(r"^\d{12,19}$") & F.call_function("luhn_check", bare)


#: Shapes of personal data, and of own identifiers that stay.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = r"\b(?:\d[ -]?){12,19}\b"
PHONE = r"(?<!\w)(?:\+\d{1,3}[ -]?)?(?:\(\d{2,4}\)[ -]?)?\d[\d -]{7,}\d(?!\w)"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
PROTECTED = r"(?i)\b(ORD|CUST|REF|TICK)-(\d+)\b"


def redacted(text: Column) -> Column:
    """Text with e-mail addresses, IBANs, Luhn-valid cards (last four digits stay) and phones replaced; own identifiers stay.

    Identifiers are hidden behind letters while the patterns run, and shown again. Texts without digits and without @ hold nothing of the kind.
    """
    hidden = F.regexp_replace(text, PROTECTED, "\u0001$1\u0002$2\u0003")
    hidden = F.regexp_replace(hidden, "(?<=\u0002[0-9]{0,30})([0-9])", "\u0004$1")
    out = F.regexp_replace(hidden, EMAIL, "[EMAIL_REDACTED]")
    out = F.regexp_replace(out, IBAN, "[IBAN_REDACTED]")
    card = lambda acc, c: F.replace(acc, F.rtrim(c), F.concat(F.lit("[CARD_ENDING_"), F.right(F.regexp_replace(c, r"\D", ""), F.lit(4)), F.lit("]")))
    cards = lambda t: F.filter(F.array_distinct(F.regexp_extract_all(t, F.lit(CARD), 0)), lambda c: luhn_valid(F.trim(c)))
    out = once(out, lambda t: F.aggregate(cards(t), t, card))
    out = F.regexp_replace(out, PHONE, "[PHONE_REDACTED]")
    shown = F.regexp_replace(F.replace(out, F.lit("\u0004"), F.lit("")), "\u0001(\\w+)\u0002(\\d+)\u0003", "$1-$2")
    return F.when(text.rlike("[0-9@]"), shown).otherwise(text)


def least_window(occurrences: Column, n_terms: Column) -> Column:
    """Words of the shortest stretch that holds every term, from structs (at, term) in order of place; terms are numbered from 0."""
    start = F.struct(F.array_repeat(F.lit(-1).cast("int"), n_terms).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, x: Column) -> Column:
        last = F.transform(state["last"], lambda v, i: F.when(i == x["term"], x["at"]).otherwise(v))
        of = lambda v: F.struct(v.alias("last"), F.least(state["best"], F.when(F.array_min(v) >= 0, x["at"] - F.array_min(v) + 1)).alias("best"))
        return once(last, of)

    return F.aggregate(occurrences, start, step)["best"]
