"""What came of cases against what was expected of them: each expectation a row, each outcome a row, and rates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of expectation: exactly these values, all of them, none of them, none at all, a share of them (recall), or numbers within bounds.
KINDS = ("equals", "all_of", "none_of", "nothing", "recall", "at_least", "at_most")


def checked(expectations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """case, field, kind, passed, missing, unwanted of every expectation.

    expectations: case, field, kind, wanted (array of strings), bound (double: the least share for recall, or the limit of a
    number). outcomes: case, field, value, a row for each. A case without outcomes has none of anything: it fails what asks
    for some. Values count once however often they come; a case's values of a field are one group. Unknown kinds fail.
    """
    seen = outcomes.filter("value is not null").groupBy("case", "field").agg(F.collect_set(F.col("value").cast("string")).alias("values"))
    none = F.array().cast("array<string>")
    rows = expectations.join(seen, ["case", "field"], "left").withColumn("values", F.coalesce("values", none)).withColumn("wanted", F.coalesce("wanted", none))
    missing, unwanted = F.array_except("wanted", "values"), F.array_intersect("wanted", "values")
    number = F.try_element_at("values", F.lit(1)).try_cast("double")
    share = F.try_divide(F.size(F.array_intersect("wanted", "values")), F.size(F.array_distinct("wanted")))
    kind = F.col("kind")
    passed = (
        F.when(kind == "equals", (F.size(missing) == 0) & (F.size(F.array_except("values", "wanted")) == 0))
        .when(kind == "all_of", F.size(missing) == 0)
        .when(kind == "none_of", F.size(unwanted) == 0)
        .when(kind == "nothing", F.size("values") == 0)
        .when(kind == "recall", F.coalesce(share, F.lit(1.0)) >= F.coalesce("bound", F.lit(0.5)))
        .when(kind == "at_least", F.coalesce(number >= F.col("bound"), F.lit(False)))
        .when(kind == "at_most", F.coalesce(number <= F.col("bound"), F.lit(False)))
        .otherwise(False)
    )
    asks = kind.isin("equals", "all_of", "recall")
    return rows.select("case", "field", "kind", passed.alias("passed"), F.when(asks, F.array_sort(missing)).otherwise(none).alias("missing"), F.when(kind == "none_of", F.array_sort(unwanted)).otherwise(none).alias("unwanted"))


def rated(checks: DataFrame, cases: DataFrame) -> DataFrame:
    """suite, cases, whole (cases that pass every check), checks, passed, rate. cases: case, suite; those without a check are whole."""
    by = checks.groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok"))
    rows = cases.select("case", "suite").distinct().join(by, "case", "left").select("suite", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ok", F.lit(0)).alias("ok"))
    out = rows.groupBy("suite").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("n") == F.col("ok")).alias("whole"), F.sum("n").alias("checks"), F.sum("ok").alias("passed"))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide("passed", "checks"), F.lit(1.0)), 4))


def answers_judged(answers: DataFrame, expected: DataFrame, cited: DataFrame | None = None, declines=None) -> DataFrame:
    """case, correct, missing, abstained, precision, leaked of every case that is expected.

    answers: case, text; expected: case, must_contain (array, with alternatives between strokes), should_abstain, relevant,
    forbidden (arrays of sources); cited: case, source. An answer abstains if it is missing, blank, or says that it has none
    (declines, a function of the text's column). Where a case should abstain, only that is correct; else the answer must not,
    and hold every phrase or one of its alternatives, in any case. Precision is the share of citations that are relevant, 0
    without any; leaked counts different sources that no one may read.
    """
    none = F.array().cast("array<string>")
    rows = expected.join(answers, "case", "left").withColumn("text", F.coalesce("text", F.lit("")))
    silent = (F.trim("text") == "") | (declines(F.col("text")) if declines else F.lit(False))
    low = F.lower("text")
    said = lambda p: F.exists(F.split(p, r"\|"), lambda a: F.contains(low, F.lower(F.trim(a))))
    missing = F.filter(F.coalesce("must_contain", none), lambda p: ~said(p))
    if cited is not None:
        rows = rows.join(cited.groupBy("case").agg(F.collect_list("source").alias("sources")), "case", "left")
    else:
        rows = rows.withColumn("sources", none)
    rows = rows.withColumn("sources", F.coalesce("sources", none)).withColumn("relevant", F.coalesce("relevant", none)).withColumn("forbidden", F.coalesce("forbidden", none))
    hits = F.size(F.filter("sources", lambda s: F.array_contains("relevant", s)))
    asked = F.coalesce("should_abstain", F.lit(False))
    return rows.select(
        "case", F.when(asked, silent).otherwise(~silent & (F.size(missing) == 0)).alias("correct"), F.when(asked, none).otherwise(missing).alias("missing"), silent.alias("abstained"),
        F.round(F.coalesce(F.try_divide(hits, F.size("sources")), F.lit(0.0)), 4).alias("precision"), F.size(F.array_intersect("sources", "forbidden")).alias("leaked"))
