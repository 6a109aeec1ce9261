"""Questions and requests in plain words as column expressions: topics, parts, plans, what a request names, sums in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .claims import name_of_address
from .text import keywords, once

#: Words that frame a question, that join two, the angles of a plan, phrases of an answer that declines.
FRAMING = ("what", "how", "why", "does", "do", "is", "are", "should", "can", "which", "who", "when", "tell", "explain", "research", "evidence")
JOINS = (" versus ", " vs ", " compared with ", " compared to ", " and also ")
ANGLES = (
    "measured results and evidence for {topic}", "criticism limitations and negative results for {topic}",
    "costs practical constraints and implementation problems of {topic}", "who disagrees about {topic} and why",
)
DECLINES = ("i don't know", "i do not know", "cannot be determined from", "not mentioned in the provided", "the context does not", "no information in the provided")
#: Words by department, things to provide, words that begin a sentence and no name, and shapes of addresses, days and amounts.
DEPARTMENTS = {
    "engineering": ("engineer", "engineering", "developer", "backend", "frontend", "platform", "infrastructure", "data scientist", "sre"),
    "sales": ("sales", "account executive", "business development", "bdr"),
    "support": ("support", "customer success", "helpdesk", "service desk"),
    "finance": ("finance", "accountant", "accounts", "payroll", "bookkeeper"),
}
THINGS = ("laptop", "monitor", "desk", "chair", "phone", "headset")
STARTERS = ("hiring", "hi", "hello", "please", "we", "our", "the", "this", "new", "onboard", "onboarding", "welcome", "adding", "add", "start", "starting", "thanks", "regards", "dear", "team", "her", "his", "their", "she", "he")
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DAY = r"\b(\d{4}-\d{2}-\d{2})\b"
SALARY = r"(?i)salary\s*(?:is|:|of|at)?\s*[£$€]?\s*(\d[\d,]*(?:\.\d{2})?)"
AMOUNT = r"[£$€]\s?([\d,]+(?:\.\d{2})?)|\b(\d{2,3},\d{3})\b"
NEEDED = ("full_name", "email", "department", "start_date", "salary")


def has_any(low: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def declines(answer: Column) -> Column:
    """Whether an answer says that it has none."""
    return has_any(F.lower(answer), DECLINES)


def topic(question: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """The question's keywords without those that ask; the question itself where none is left."""
    kept = F.filter(keywords(question, stop_words), lambda w: ~w.isin(*FRAMING))
    return once(kept, lambda k: F.when(F.size(k) > 0, F.array_join(k, " ")).otherwise(F.trim(question)))


def parts(question: Column) -> Column:
    """Both sides of the first joining phrase, in order of JOINS, that leaves more than three letters on either side; none without one."""
    low = F.lower(question)

    def at(phrase: str) -> Column:
        place = F.locate(phrase, low)
        both = F.array(F.trim(F.substring(question, F.lit(1), place - 1)), F.trim(F.substring(question, place + len(phrase), F.length(question))))
        return F.when((place > 0) & F.forall(both, lambda s: F.length(s) > 3), both)

    return F.coalesce(*map(at, JOINS), F.array().cast("array<string>"))


def planned(question: Column, most: int, stop_words: tuple[str, ...] = ()) -> Column:
    """What to look for: the question's own parts, then its topic from each angle, `most` in all."""
    own = F.transform(parts(question), lambda p: F.concat(F.lit("evidence and measured results for "), p))
    around = lambda t: F.array(*[F.concat(F.lit(a.split("{topic}")[0]), t, F.lit(a.split("{topic}")[1])) for a in ANGLES])
    return F.slice(F.concat(own, once(topic(question, stop_words), around)), 1, most)


def amount(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def salary(text: Column) -> Column:
    """The number behind "salary", else the first amount with a currency's sign or a thousands mark."""
    other = F.concat(F.regexp_extract(text, AMOUNT, 1), F.regexp_extract(text, AMOUNT, 2))
    return F.coalesce(amount(F.regexp_extract(text, SALARY, 1)), amount(other))


def person(text: Column, email: Column) -> Column:
    """The name in an address, else the first two capitalised words or more in a row, without those that begin sentences."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"), F.lit(1))
    first = lambda w: F.array_position(F.transform(w, lambda x: ~F.lower(x).isin(*STARTERS)), F.lit(True))
    left = lambda w: F.when(first(w) > 0, F.slice(w, F.greatest(F.lit(1), first(w)).cast("int"), F.size(w))).otherwise(F.array().cast("array<string>"))
    names = F.filter(F.transform(runs, lambda r: once(F.split(r, r"\s+"), left)), lambda w: F.size(w) >= 2)
    named = name_of_address(F.coalesce(email, F.lit("")))
    return F.when(named != "", named).otherwise(F.array_join(F.try_element_at(names, F.lit(1)), " "))


def intake(text: Column) -> Column:
    """struct(full_name, email, department, start_date, salary, equipment, missing): what a request for a new colleague names, null where it doesn't."""
    low = F.lower(text)
    email = F.nullif(F.regexp_extract(text, ADDRESS, 0), F.lit(""))
    unit = F.coalesce(*[F.when(has_any(low, words), F.lit(name)) for name, words in DEPARTMENTS.items()])
    day = F.nullif(F.regexp_extract(text, DAY, 1), F.lit(""))
    things = F.filter(F.array(*map(F.lit, THINGS)), lambda t: F.contains(low, t))
    found = {"full_name": person(text, email), "email": email, "department": unit, "start_date": day, "salary": salary(text)}
    missing = F.filter(F.array(*[F.when(found[n].isNull(), F.lit(n)) for n in NEEDED]), lambda x: x.isNotNull())
    return F.struct(*[c.alias(n) for n, c in found.items()], things.alias("equipment"), missing.alias("missing"))


def solved(prompt: Column) -> Column:
    """The answer to a sum told in words: "each" multiplies the first two numbers, less what is given away; "less", "left" and the like take away; else all are added. Null with fewer than two numbers."""
    low = F.lower(prompt)

    def of(n: Column) -> Column:
        product, total = F.get(n, F.lit(0)) * F.get(n, F.lit(1)), F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
        taken = (F.size(n) >= 3) & has_any(low, ("less", "discount", "returns", "gives away"))
        each = F.contains(low, F.lit("each")) & has_any(low, ("total", "altogether", "how much", "how many"))
        away = has_any(low, ("less", "fewer", "spends", "gives away", "left"))
        return F.when(F.size(n) < 2, None).when(each, product - F.when(taken, F.get(n, F.lit(2))).otherwise(0)).when(away, 2 * F.get(n, F.lit(0)) - total).otherwise(total)

    return once(F.transform(F.regexp_extract_all(prompt, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long")), of)
