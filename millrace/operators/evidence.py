"""Evidence: claims that say the same thing, and the sentences of a document that answer a question."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import text as T
from ..storage import remove, scratch, written

log = logging.getLogger(__name__)
#: Similarity from which claims are the same; what independent evidence adds to a score, and at most by one item.
SAME, BONUS, MOST = 0.6, 0.08, 0.16
#: Similarity from which claims are about the same.
UNLIKE = 0.3
#: What a measured finding and a verb of results add to a sentence's share of the question.
MEASURED, RESULT = 0.45, 0.1


#: Items that a term may have before it counts as frequent: frequent terms are looked up in pairs.
FEW = 20
#: Terms of an item that go along with each of its keys, to be compared where keys meet; longer items are joined with their terms afterwards.
CARRIED = 64
#: Keys whose items a task compares.
KEYS_A_TASK = 250_000


def rarest_first(items: DataFrame, path: str) -> DataFrame:
    """rank, terms, n, rare, numbers of each item: numbers for its terms, those of figures below 0, in order of how few items have them; rare: how many FEW items have at most."""
    each = items.select("rank", "numbers", F.explode("terms").alias("term"))
    number = F.monotonically_increasing_id()
    counts = written(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("no", F.when(F.col("term").rlike(r"^\d+$"), -1 - number).otherwise(number)), f"{path}-terms")
    ordered = each.join(counts, "term").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("df", "no"))).alias("by"), F.first("numbers").alias("numbers"))
    rare = F.size(F.filter("by", lambda x: x["df"] <= FEW))
    return written(ordered.select("rank", F.transform("by", lambda x: x["no"]).alias("terms"), F.size("by").alias("n"), rare.alias("rare"), "numbers"), path)


def keys(small: bool, need: Column) -> Column:
    """Array of struct(x, y): what an item of rarest_first() is looked up by. need: terms that a small item shares with any that is like it.

    The rarest of the shared terms is among the first n - need + 1 of the small item, the next among one more. A large
    item has keys of all its terms (x twice), and of all pairs of frequent ones; a small one of these first terms alone if they
    are rare or one is all that it takes, else of pairs with the next.
    """
    key = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    first, after = (F.col("n") - need + 1, F.col("n") - need + 2) if small else (F.col("n"), F.col("n"))
    alone = F.when(need == 1, first).otherwise(F.least(F.col("rare"), first)) if small else F.col("n")
    paired = F.when(need == 1, F.lit(0)).otherwise(F.greatest(first - F.col("rare"), F.lit(0))) if small else F.col("n") - F.col("rare")
    singles = F.transform(F.slice("terms", F.lit(1), alone.cast("int")), lambda x: key(x, x))
    heads = F.slice("terms", F.col("rare") + 1, paired.cast("int"))
    others = lambda i: F.slice("terms", F.col("rare") + i + 2, F.greatest(after - F.col("rare") - i - 1, F.lit(0)).cast("int"))
    return F.concat(singles, F.flatten(F.transform(heads, lambda x, i: F.transform(others(i), lambda y: key(x, y)))))


def alike_claims(items: DataFrame, path: str, least: float) -> DataFrame:
    """later, earlier, similarity, agree, subjects of pairs of items as similar as least. items: rank, terms (distinct, not empty), numbers.

    Items that are alike share so many terms that one of the rarest of the smaller stands in the larger, or two where these
    are frequent; only such pairs are compared, where their keys meet, and never all. agree: the later one's numbers are all close to some of
    the earlier one's; subjects: common terms that aren't numbers.
    """
    part = min(2 * least / (1 + least), least / 0.85) - 1e-3
    ordered = rarest_first(items, f"{path}-ordered")
    need = F.ceil(F.col("n") * part).cast("int")
    side = lambda c: [F.col("rank").alias(c), F.col("n").alias(f"n{c}"), F.col("terms").alias(f"terms_{c}"), F.col("numbers").alias(f"numbers_{c}")]
    carried = ordered.filter(F.col("n") <= CARRIED)
    frequent = F.col("n") - F.col("rare")
    tasks = 1 + (carried.agg(F.sum(F.col("n") + (frequent * (frequent - 1) / 2).cast("long"))).first()[0] or 0) // KEYS_A_TASK
    # Dealt by number: adaptive execution would join pieces by their compressed size, and terms compress well.
    keyed = lambda c, small: carried.select(*side(c), F.explode(keys(small, need)).alias("key")).repartition(tasks, "key")
    met = keyed("a", True).join(keyed("b", False), "key").filter("a <> b and na <= nb").drop("key")
    head = F.slice("terms", F.lit(1), F.col("n") - need + 1)
    small = ordered.select(F.col("rank").alias("a"), F.col("n").alias("na"), F.explode(head).alias("term"))
    large = ordered.filter(F.col("n") > CARRIED).select(F.col("rank").alias("b"), F.col("n").alias("nb"), F.explode("terms").alias("term"))
    pairs = small.join(large, "term").filter("a <> b and na <= nb").select("a", "b").distinct()
    both = met.unionByName(pairs.join(ordered.select(*side("a")), "a").join(ordered.select(*side("b")), "b"))
    common = F.array_intersect("terms_a", "terms_b")
    shared = both.filter(F.size(common) >= F.col("na") * part).withColumn("common", F.size(common))
    jaccard, contained = F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), F.col("common") / F.col("na")
    later = lambda x, y: F.when(F.col("a") > F.col("b"), F.col(x)).otherwise(F.col(y))
    rows = shared.select(
        F.greatest("a", "b").alias("later"), F.least("a", "b").alias("earlier"), F.round(F.greatest(jaccard, 0.85 * contained), 4).alias("similarity"),
        C.numbers_agree(later("numbers_a", "numbers_b"), later("numbers_b", "numbers_a")).alias("agree"), F.size(F.filter(common, lambda t: t >= 0)).alias("subjects"))
    return rows.filter(F.col("similarity") >= least).distinct()


def same_claims(items: DataFrame, path: str, same: float = SAME) -> DataFrame:
    """later, earlier: ranks of items that say the same."""
    return alike_claims(items, path, same).filter("agree").select("later", "earlier")


def with_terms(rows: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """rows with terms and numbers in place of their claim; claims without words share a term of their own."""
    roots = F.array_distinct(F.transform(T.keywords(F.col("claim"), stop_words), C.root))
    none = F.array(F.lit("")).cast("array<string>")
    return rows.select(*[c for c in rows.columns if c != "claim"], T.once(roots, lambda r: F.when(F.size(r) == 0, none).otherwise(r)).alias("terms"), T.numbers(F.col("claim")).alias("numbers"))


def conflicts(items: DataFrame, stop_words: Sequence[str] = (), least: float = UNLIKE, subjects: int = 2) -> DataFrame:
    """id, other, similarity: pairs of claims (id, claim) about the same, with figures that disagree, the least identifier first.

    Claims conflict when a figure of the one with the greater identifier has none close to it in the other, and they
    share words that say what was measured.
    """
    spark = items.sparkSession
    path = scratch(spark, "conflicts")
    rows = written(with_terms(items.select(F.col("id").alias("rank"), F.coalesce("claim", F.lit("")).alias("claim")), stop_words), f"{path}/items")
    found = alike_claims(rows, f"{path}/claims", least).filter(~F.col("agree") & (F.col("subjects") >= subjects))
    result = written(found.select(F.col("earlier").alias("id"), F.col("later").alias("other"), "similarity"), f"{path}-result")
    remove(spark, path)
    return result


def settled(pairs: DataFrame, path: str) -> tuple[DataFrame, int]:
    """rank of the items that are removed when each is, in order, unless no kept earlier one is paired with it; and the rounds it took.

    In a round all items are kept whose earlier partners are gone, and all paired with them go: the same
    items as one after the other, in rounds by the longest chain, which is short for any but sorted chains.
    """
    left, gone, rounds = written(pairs, f"{path}-left0"), None, 0
    while not left.isEmpty():
        rounds += 1
        waiting = left.select(F.col("later").alias("earlier")).distinct()
        out = written(left.join(waiting, "earlier", "left_anti").select(F.col("later").alias("rank")).distinct(), f"{path}-out{rounds}")
        gone = out if gone is None else gone.unionByName(out)
        for side in ("later", "earlier"):
            left = left.join(out.withColumnRenamed("rank", side), side, "left_anti")
        left = written(left.select("later", "earlier"), f"{path}-left{rounds}")
    log.info("settled in %d rounds", rounds)
    return (gone if gone is not None else pairs.select(F.col("later").alias("rank")).limit(0)), rounds


def deduplicated(items: DataFrame, stop_words: Sequence[str] = (), same: float = SAME) -> DataFrame:
    """id, duplicate_of (null for kept ones), corroborated_by (count) and score of every item.

    items: id, claim, score, source, primary. The best item of a group stays (ties: the least id), and an
    item goes if it says the same as a kept one that is better; it then counts as corroboration of the best such, and
    raises its score where both are primary and of different sources. Claims of the same words and numbers share one fate: the
    first of them stands for all until the end. Claims without words are the same as one another.
    """
    spark = items.sparkSession
    path = scratch(spark, "evidence")
    score = F.col("score").cast("double")
    rows = items.select(F.struct((-score).alias("by"), F.col("id")).alias("rank"), score.alias("score"), "source", F.col("primary").cast("boolean").alias("primary"), F.coalesce("claim", F.lit("")).alias("claim"))
    said = [F.array_sort("terms").alias("terms"), F.array_sort(F.array_distinct("numbers")).alias("numbers")]
    rows = written(with_terms(rows, stop_words).select(F.col("rank.id").alias("id"), "rank", "score", "source", "primary", *said), f"{path}/rows")
    # Numbered in order, so that a number stands for a rank from here on.
    firsts = rows.groupBy("terms", "numbers").agg(F.min("rank").alias("first")).orderBy("first").withColumn("rank", F.monotonically_increasing_id())
    firsts = written(firsts, f"{path}/firsts")
    pairs = written(same_claims(firsts.select("rank", "terms", "numbers"), f"{path}/claims", same), f"{path}/pairs")
    removed, _ = settled(pairs, f"{path}/rounds")
    by_kept = pairs.join(removed.withColumnRenamed("rank", "earlier"), "earlier", "left_anti").groupBy(F.col("later").alias("rank")).agg(F.min("earlier").alias("place"))
    by_kept = by_kept.join(firsts.select(F.col("rank").alias("place"), F.col("first").alias("kept")), "place").select("rank", "kept")
    fate = firsts.join(by_kept, "rank", "left").select("terms", "numbers", "first", "kept")
    fated = rows.join(fate, ["terms", "numbers"]).withColumn("kept", F.coalesce("kept", F.when(F.col("rank") != F.col("first"), F.col("first"))))
    fated = written(fated.select("id", "rank", "score", "source", "primary", "kept"), f"{path}/fated")
    kept = fated.filter("kept is null").select(F.col("rank").alias("kept"), F.col("source").alias("kept_source"), F.col("primary").alias("kept_primary"))
    others = fated.filter("kept is not null").select("rank", "kept", "source", "primary").join(kept, "kept")
    independent = F.col("primary") & F.col("kept_primary") & (F.lower(F.trim("source")) != F.lower(F.trim("kept_source")))
    # The bonus reaches its most with the second corroboration, so only the first one's place matters.
    first = others.groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.count_if(independent).alias("independent"), F.min_by(independent, "rank").alias("first_is"))
    gain = F.col("independent") * MOST - F.when(F.col("first_is"), MOST - BONUS).otherwise(0.0)
    raised = first.select(F.col("kept").alias("rank"), "n", gain.alias("gain"))
    out = fated.join(raised, "rank", "left").select(
        "id", F.col("kept.id").alias("duplicate_of"), F.coalesce("n", F.lit(0)).alias("corroborated_by"),
        F.round(F.when(F.coalesce("gain", F.lit(0.0)) > 0, F.least(F.lit(1.0), F.col("score") + F.col("gain"))).otherwise(F.col("score")), 4).alias("score"))
    result = written(out, f"{path}-result")
    remove(spark, path)
    return result


def best_sentences(pairs: DataFrame, stop_words: Sequence[str], units: Sequence[str], top: int = 2, least_stems: int = 4) -> DataFrame:
    """query_id, id, sentence, score, rank: the sentences of each pair's text that share most of the question's stems.

    pairs: query_id, id, question (distinct stems), text. Sentences of fewer than least_stems stems, and without one of the
    question's, don't count; findings with a number and a unit, and verbs of results, come first. Ties go by place.
    """
    sentences = pairs.select("query_id", "id", "question", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    judged = sentences.withColumn("stems", T.stems(F.col("sentence"), stop_words)).filter(F.size("stems") >= least_stems)
    shared = F.size(F.array_intersect("question", "stems"))
    bonus = F.when(C.measured_finding(F.col("sentence"), units), MEASURED).otherwise(0.0) + F.when(C.has_result_verb(F.col("sentence")), RESULT).otherwise(0.0)
    scored = judged.withColumn("shared", shared).filter("shared > 0").withColumn("score", F.round(F.col("shared") / F.size("question") + bonus, 9))
    order = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "n")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "id", "n", "sentence", "score", "rank")
