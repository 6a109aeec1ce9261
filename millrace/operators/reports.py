"""Reports against what they cite: invented marks, sentences without one, figures that no source has, and how far to trust them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import text as T

#: Words from which a sentence has to cite something.
LEAST_WORDS = 6
#: What coverage, support, cleanliness, agreement and completeness weigh; what lowers cleanliness; the most without a source.
WEIGHTS = (0.25, 0.25, 0.25, 0.15, 0.1)
INVENTED, UNSUPPORTED, UNCITED = 0.4, 0.4, 0.2
WITHOUT_SOURCES = 0.25


def verified(reports: DataFrame, citations: DataFrame) -> DataFrame:
    """id, text (without invented marks), sentences, invented, uncited, unsupported (arrays), cited, credibility of reports (id, text).

    citations: id, marker, quote, date, credibility. A figure is supported if a quote or date of the report's own citations
    has one close to it, so that each report stands by itself; a report's citations are one group, its sentences one row.
    A report that cites nothing has every mark invented and is asked for none.
    """
    quoted = F.concat(T.numbers(F.coalesce("quote", F.lit(""))), T.numbers(F.coalesce("date", F.lit(""))))
    known = citations.groupBy("id").agg(
        F.collect_set(F.col("marker").cast("int")).alias("valid"), F.array_distinct(F.flatten(F.collect_list(quoted))).alias("allowed"), F.count(F.lit(1)).alias("cited"), F.avg("credibility").alias("credibility"))
    rows = reports.select("id", F.coalesce("text", F.lit("")).alias("text")).join(known, "id", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = rows.select("id", "text", F.coalesce("valid", none("int")).alias("valid"), F.coalesce("allowed", none("double")).alias("allowed"), F.coalesce("cited", F.lit(0)).alias("cited"), "credibility")
    marks = rows.withColumn("invented", F.array_except(T.markers(F.col("text")), "valid")).withColumn("text", C.known_markers(F.col("text"), F.col("valid")))
    each = marks.withColumn("said", T.sentences(C.markers_inside(F.col("text"))))
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    bare = F.filter("said", lambda s: ~s.rlike(r"\[\d+\]") & (words(s) >= LEAST_WORDS))
    return each.select(
        "id", "text", F.size("said").alias("sentences"), "invented", F.when(F.col("cited") > 0, bare).otherwise(none("string")).alias("uncited"),
        C.unsupported_numbers(F.col("text"), F.col("allowed")).alias("unsupported"), "cited", "credibility")


def trust(coverage: Column, conflicts: Column, exhausted: Column) -> Column:
    """How far to trust a report of verified(): coverage (0 to 1) of what was asked, its sources, its faults, unresolved conflicts, and whether the budget ran out."""
    support = F.when(F.col("cited") == 0, 0.0).otherwise(0.6 * F.coalesce("credibility", F.lit(0.0)) + 0.4 * F.least(F.lit(1.0), F.col("cited") / 4))
    fault = lambda c, by: F.when(F.size(c) > 0, by).otherwise(0.0)
    clean = F.greatest(F.lit(0.0), 1.0 - fault("invented", INVENTED) - fault("unsupported", UNSUPPORTED) - fault("uncited", UNCITED))
    agreement = F.when(conflicts == 0, 1.0).otherwise(F.greatest(F.lit(0.4), 1.0 - 0.2 * conflicts))
    parts = (coverage, support, clean, agreement, F.when(exhausted, 0.6).otherwise(1.0))
    whole = sum((w * p for w, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0))
    return F.round(F.when(F.col("cited") == 0, F.least(whole, F.lit(WITHOUT_SOURCES))).otherwise(whole), 4)


def composed(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (id, text) and what they cite (id, marker, quote, date, credibility, source), written from evidence alone.

    evidence: id, section, sentence, source, score, date, credibility. A report's sections go by name, their sentences by
    score; a sentence ends in the number of its source, and sources are numbered as they first come up. A sentence that a
    section has twice stands once, by its best source. Null and blank sentences are left out; a report has a handful of
    sentences, so each is one group.
    """
    rows = evidence.filter(F.trim(F.coalesce("sentence", F.lit(""))) != "").withColumn("sentence", F.trim("sentence")).withColumn("at", F.struct("section", (-F.col("score")).alias("by"), "source", "sentence"))
    once = rows.groupBy("id", "section", "sentence").agg(F.min_by(F.struct("source", "date", "credibility", "at"), "at").alias("x")).select("id", "section", "sentence", "x.*")
    first = once.groupBy("id", "source").agg(F.min("at").alias("begun"))
    numbered = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("begun", "source"))).alias("all")).select("id", F.posexplode("all").alias("k", "s")).select("id", F.col("s.source").alias("source"), (F.col("k") + 1).alias("marker"))
    marked = once.join(numbered, ["id", "source"])
    # The number stands before what ends the sentence.
    said = F.concat(F.regexp_replace("sentence", r"[.!?]+$", ""), F.lit(" ["), F.col("marker").cast("string"), F.lit("]"), F.coalesce(F.nullif(F.regexp_extract("sentence", r"[.!?]+$", 0), F.lit("")), F.lit(".")))
    text = marked.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("said")))), lambda x: x["said"]), " ").alias("text"))
    return text, marked.select("id", "marker", F.col("sentence").alias("quote"), "date", "credibility", "source")
