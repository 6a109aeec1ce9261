"""Claims, quotes, citations and replies as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import containment, jaccard, numbers, once, sentences

#: Verbs of results, phrases of instructions in data, and how far apart close numbers may be.
RESULT_VERBS = ("rose", "fell", "increased", "decreased", "declined", "improved", "reduced", "found", "showed", "reached", "achieved", "produced", "recorded", "retained")
INJECTIONS = ("ignore all previous", "ignore previous instructions", "disregard the above", "you are now", "system prompt", "drop table", "delete from", "maintenance mode", "new instructions")
CLOSE = 0.12


def singular(word: Column, e_endings: Sequence[str] = ("sses", "shes", "ches", "xes")) -> Column:
    """Words of up to three letters stay; ies becomes y beyond four letters, es goes behind hissing letters, and s but for ss, us and is."""
    ends = lambda *endings: word.rlike("(" + "|".join(endings) + ")$")
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    out = F.when(ends("ies") & (F.length(word) > 4), F.concat(cut(3), F.lit("y"))).when(ends(*e_endings), cut(2)).when(ends("s") & ~ends("ss", "us", "is"), cut(1)).otherwise(word)
    return F.when(F.length(word) <= 3, word).otherwise(out)


def root(word: Column) -> Column:
    """The singular without ing (beyond five letters) or ed (beyond four), then without a last e (beyond four)."""
    short = F.length(word) <= 3
    cut = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    verb = lambda w: F.when(F.endswith(w, F.lit("ing")) & (F.length(w) > 5), cut(w, 3)).when(F.endswith(w, F.lit("ed")) & (F.length(w) > 4), cut(w, 2)).otherwise(w)
    silent = lambda w: F.when(F.endswith(w, F.lit("e")) & (F.length(w) > 4), cut(w, 1)).otherwise(w)
    return F.when(short, word).otherwise(once(once(singular(word, ("sses", "shes", "ches", "xes", "zes")), verb), silent))


def wording_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of terms: the Jaccard similarity, or 0.85 times the containment if that is more."""
    return F.greatest(jaccard(a, b), 0.85 * containment(a, b))


def close(a: Column, b: Column, within: float = CLOSE) -> Column:
    """Whether two numbers differ by `within` of the larger at most."""
    largest = F.greatest(F.abs(a), F.abs(b))
    return (a == b) | (F.abs(a - b) <= within * largest)


def numbers_agree(a: Column, b: Column) -> Column:
    """Every number of a is close to one of b; true where either has none. Not symmetric."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.forall(a, lambda x: F.exists(b, lambda y: close(x, y)))


def unsupported_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of a text, but for citation marks and whole numbers up to ten, that aren't close to an allowed one."""
    found = numbers(F.regexp_replace(text, r"\[\d+\]", " "))
    plain = lambda x: (x == F.floor(x)) & (F.abs(x) <= 10)
    return F.filter(found, lambda x: ~plain(x) & ~F.exists(allowed, lambda y: close(x, y)))


def for_matching(text: Column) -> Column:
    """Lower case, plain quotation marks, blanks for dashes and white space."""
    plain = F.translate(F.lower(text), "’‘“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("-"), F.lit(" ")), r"\s+", " "))


def quoted_in(quote: Column, body: Column, share: float = 0.85, least_words: int = 4) -> Column:
    """The quote stands in the body, or the share of its words, least_words at least, in one of its sentences."""

    def judged(q: Column) -> Column:
        words = F.filter(F.split(q, " "), lambda w: w != "")
        clean = for_matching(body)
        near = F.exists(sentences(clean), lambda s: F.size(F.filter(words, lambda w: F.array_contains(F.split(s, " "), w))) >= share * F.size(words))
        return (q != "") & (F.contains(clean, q) | ((F.size(words) >= least_words) & near))

    return once(for_matching(quote), judged)


def measured_finding(sentence: Column, units: Sequence[str]) -> Column:
    """A digit and a unit's word."""
    low = F.lower(sentence)
    return low.rlike(r"\d") & F.exists(F.array(*[F.lit(u) for u in units]), lambda u: F.contains(low, u))


def has_result_verb(sentence: Column) -> Column:
    return F.lower(sentence).rlike("|".join(RESULT_VERBS))


def years_since(date: Column, year: int) -> Column:
    """From the first four characters; 99 where they aren't a year."""
    return F.coalesce(F.lit(float(year)) - F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int")), F.lit(99.0))


def recency(date: Column, year: int) -> Column:
    """1 for this year or later, else 1 over 1 and a fifth of the age."""
    age = years_since(date, year)
    return F.when(age <= 0, 1.0).otherwise(F.round(1 / (1 + age * 0.2), 4))


def evidence_score(relevance: Column, credibility: Column, recency_: Column) -> Column:
    return F.round(0.5 * relevance + 0.35 * credibility + 0.15 * recency_, 4)


def markers_inside(text: Column) -> Column:
    """Citation marks behind a full stop stand before it."""
    return F.trim(F.regexp_replace(text, r"([.!?])(\s*)((?:\[\d+\]\s*)+)", " $3$1 "))


def known_markers(text: Column, valid: Column) -> Column:
    """The text without the citation marks whose number isn't in valid."""
    pieces, marks = F.split(text, r"\[\d+\]"), F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1))
    kept = F.transform(marks, lambda m: F.when(F.array_contains(valid, m.cast("int")), F.concat(F.lit("["), m, F.lit("]"))).otherwise(""))
    return F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(marks)), kept, lambda p, m: F.concat(p, m)), ""), F.element_at(pieces, -1))


def has_all(text: Column, required: Column) -> Column:
    """Every required phrase, or one of its alternatives between strokes, stands in the text."""
    low = F.lower(text)
    return F.forall(required, lambda r: F.exists(F.split(r, r"\|"), lambda a: F.contains(low, F.lower(F.trim(a)))))


def answer_confidence(top: Column, cited: Column, grounded: Column) -> Column:
    """0.45 of the best score, 0.2 for citations (0.75 of that for one), 0.35 of the groundedness; null scores count 0."""
    signal = F.when(cited == 0, 0.0).when(cited == 1, 0.75).otherwise(1.0)
    return F.when(top.isNull(), 0.0).otherwise(F.round(F.least(F.lit(1.0), 0.45 * top + 0.2 * signal + 0.35 * grounded), 4))


def graded(answer: Column, expected: Column) -> Column:
    """1 if the expected number is among the whole numbers of the answer."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("long"))
    return F.array_contains(found, expected).cast("double")


def injections(text: Column) -> Column:
    """Phrases of instructions that a text holds."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(p) for p in INJECTIONS]), lambda p: F.contains(low, p))


def unfenced(text: Column) -> Column:
    """A reply without the fence of code around it."""
    bare = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n", ""), r"```\s*$", "")
    return F.when(F.startswith(bare, F.lit("```")), F.trim(inner)).otherwise(bare)


def sql_of(reply: Column) -> Column:
    """The statement in a reply: what is fenced, from its first SELECT or WITH, its first paragraph, without semicolons behind it."""
    fenced = F.regexp_extract(reply, r"(?is)```(?:sql)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(reply))
    begun = F.regexp_extract(body, r"(?is)\b((?:select|with)\b.*)$", 1)
    return F.regexp_replace(F.trim(F.substring_index(F.when(begun != "", begun).otherwise(body), "\n\n", 1)), r"[;\s]+$", "")


def name_of_address(email: Column) -> Column:
    """Two parts or more of an address before the @, each with a capital; '' otherwise."""
    parts = F.filter(F.split(F.substring_index(email, "@", 1), "[._-]+"), lambda p: (F.trim(p) != "") & ~p.rlike(r"^\d+$"))
    named = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), " ")
    return F.when(F.contains(email, F.lit("@")) & (F.size(parts) >= 2), named).otherwise("")


def sides(text: Column, head: int, tail: int) -> Column:
    """Both ends of a text that is longer than they are together."""
    return F.when(F.length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail))))


def is_test_path(path: Column) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    name = F.substring_index(low, "/", -1)
    return F.contains(low, F.lit("/tests/")) | F.startswith(low, F.lit("tests/")) | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | (name == "conftest.py")


def protected_path(path: Column, patterns: Sequence[str]) -> Column:
    """The path or its last part fits a pattern of * and ?, or a part before the last is a pattern's folder."""
    out, name = F.lit(False), F.substring_index(path, "/", -1)
    for pattern in patterns:
        shape = "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c not in "_ /" else c for c in pattern) + "$"
        folder = pattern.split("/")[0]
        out = out | path.rlike(shape) | name.rlike(shape)
        if folder and "*" not in folder:
            out = out | F.concat(F.lit("/"), path).rlike("/" + re.escape(folder) + "/")
    return out
