"""Queries over replies, claims, citations, evidence and their evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import stats
from ..functions import text as T
from ..operators import retrieval, stretches
from ..session import table
from .logs import ARMS, experiment_arms
from .texts import BM25, STOP, documents, item_queries

UNITS = ("percent", "million", "hours", "year")
GROUNDED = 0.55
PROTECTED = ("tests/*", "*.lock", ".github/*", "conftest.py")


def conversations(spark, sf):
    return table(spark, sf, "conversations")


def stemmed_terms(spark, sf):
    """Words of conversations by three stemmers: those that ten messages or more share."""
    each = conversations(spark, sf).select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    by = F.explode(F.array(*[F.struct(F.lit(n).alias("stemmer"), s.alias("stem")) for n, s in (("ending", T.stem(F.col("w"))), ("singular", C.singular(F.col("w"))), ("root", C.root(F.col("w"))))])).alias("x")
    return each.select(by).groupBy("x.stemmer", "x.stem").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


def groundedness(spark, sf):
    """By conversation: the share of the reply's sentences of whose stems GROUNDED stand in one of the user's messages."""
    stems = lambda t: F.array_distinct(T.stems(T.without_markers(t), STOP))
    c = conversations(spark, sf)
    said = c.filter("role = 'assistant'").select("conv_id", F.posexplode(F.transform(T.sentences(F.col("text")), stems)).alias("n", "stems"), "turn")
    said = said.select("conv_id", "turn", "n", F.size("stems").alias("total"), F.explode_outer("stems").alias("stem"))
    asked = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("passage"), F.explode(stems(F.col("text"))).alias("stem"))
    shared = said.join(asked, ["conv_id", "stem"]).groupBy("conv_id", "turn", "n", "total", "passage").agg(F.count(F.lit(1)).alias("hits"))
    best = shared.groupBy("conv_id", "turn", "n").agg(F.max(F.col("hits") / F.col("total")).alias("support"))
    each = said.select("conv_id", "turn", "n", "total").distinct().join(best, ["conv_id", "turn", "n"], "left")
    supported = (F.col("total") == 0) | (F.coalesce("support", F.lit(0.0)) >= GROUNDED)
    return each.groupBy("conv_id").agg(F.count(F.lit(1)).alias("sentences"), F.round(F.count_if(supported) / F.count(F.lit(1)), 4).alias("grounded"))


def cited_replies(spark, sf):
    """conv_id, turn, text: replies with marks of the passages numbered by turn, some of them invented."""
    mark = lambda c: F.concat(F.lit(" ["), c.cast("string"), F.lit("]"))
    text = F.concat(F.lit("First claim."), mark(F.col("turn")), F.lit(" Second claim"), mark(F.col("turn") + 1), mark(F.lit(1)), F.lit(". Rest."), mark(F.col("turn")))
    return conversations(spark, sf).filter("role = 'assistant'").select("conv_id", "turn", text.alias("text"))


def citation_binding(spark, sf):
    """Marks of replies bound to the user's messages by number: bound and invented ones, and the sources in order."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    passages = conversations(spark, sf).filter("role = 'user'").select("conv_id", F.row_number().over(order).alias("mark"), F.md5("text").alias("source"))
    marks = cited_replies(spark, sf).select("conv_id", "turn", F.posexplode(T.markers(F.col("text"))).alias("pos", "mark"))
    both = marks.join(passages, ["conv_id", "mark"], "left")
    return both.groupBy("conv_id", "turn").agg(F.count("source").alias("cited"), F.count_if(F.col("source").isNull()).alias("invented"), F.min_by("source", F.when(F.col("source").isNotNull(), F.col("pos"))).alias("first_source"))


def marked_replies(spark, sf):
    out = cited_replies(spark, sf)
    return out.select("conv_id", "turn", C.markers_inside(F.col("text")).alias("moved"), C.known_markers(F.col("text"), F.array(F.lit(1), F.lit(2))).alias("known"), T.without_markers(F.col("text")).alias("bare"))


def answer_confidences(spark, sf):
    """Confidence of replies from the share of shared words, the number of citations and a groundedness."""
    top, cited = F.col("turn") % 10 / 10.0, F.col("conv_id") % 3
    return conversations(spark, sf).select("conv_id", "turn", C.answer_confidence(F.when(F.col("turn") > 0, top), cited, F.lit(0.5)).alias("confidence"))


def required_phrases(spark, sf):
    """Messages that hold every phrase of a list with alternatives."""
    needed = F.array(F.lit("the|der|les"), F.lit("and | und | y "))
    return conversations(spark, sf).select("conv_id", "turn", C.has_all(F.col("text"), needed).alias("complete"))


def findings(spark, sf):
    """Sentences by whether they hold a measured finding and a verb of results."""
    s = table(spark, sf, "documents").select(F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy(C.measured_finding(F.col("s"), UNITS).alias("measured"), C.has_result_verb(F.col("s")).alias("result")).agg(F.count(F.lit(1)).alias("n"))


def claim_comparisons(spark, sf):
    """Each message against the next of its conversation: similar wording, numbers that agree, and what follows."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = conversations(spark, sf).withColumn("next", F.lead("text").over(order)).filter("next is not null")
    roots = lambda t: F.transform(T.keywords(t, STOP), C.root)
    c = c.select("conv_id", "turn", F.array_distinct(roots(F.col("text"))).alias("a"), F.array_distinct(roots(F.col("next"))).alias("b"), T.numbers(F.col("text")).alias("x"), T.numbers(F.col("next")).alias("y"))
    c = c.withColumn("similarity", F.round(C.wording_similarity(F.col("a"), F.col("b")), 6)).withColumn("agree", C.numbers_agree(F.col("x"), F.col("y")))
    shared = F.size(F.filter(F.array_intersect("a", "b"), lambda t: ~t.rlike(r"^\d+$")))
    return c.select("conv_id", "turn", "similarity", "agree", shared.cast("long").alias("shared_subjects"), ((F.col("similarity") >= 0.5) & F.col("agree")).alias("duplicate"), ((F.col("similarity") >= 0.2) & ~F.col("agree") & (shared >= 2)).alias("conflict"))


def number_support(spark, sf):
    """Numbers of replies that no number of the user's messages in the conversation comes near."""
    c = conversations(spark, sf)
    allowed = c.filter("role = 'user'").select("conv_id", F.explode(T.numbers(F.col("text"))).alias("v")).groupBy("conv_id").agg(F.collect_set("v").alias("allowed"))
    rows = c.filter("role = 'assistant'").join(allowed, "conv_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<double>")))
    return rows.select("conv_id", "turn", F.size(C.unsupported_numbers(F.col("text"), F.col("allowed"))).cast("long").alias("unsupported"))


def evidence_scores(spark, sf):
    """Documents as evidence: relevance by length, credibility by source, recency by a year made of the identifier; the best ten of each source."""
    year = (2010 + F.col("doc_id") % 20).cast("string")
    date = F.when(F.col("doc_id") % 7 == 0, "n.d.").otherwise(F.concat(year, F.lit("-01-01")))
    credible = F.when(F.col("source") == "src0", 0.9).when(F.col("source") == "src1", 0.6).otherwise(0.3)
    score = C.evidence_score(F.least(F.lit(1.0), F.col("n_chars") / 9973), credible, C.recency(date, 2025))
    rows = table(spark, sf, "documents").select("doc_id", "source", score.alias("score"))
    order = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("source", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def evidence_numbers(spark, sf):
    """Dense numbers of sources in order of conversation and length, at their first appearance only."""
    first = conversations(spark, sf).groupBy("role", F.md5("text").alias("source")).agg(F.min(F.struct("conv_id", (-F.length("text")).alias("by"), "turn")).alias("at"))
    numbered = stretches.folded(first, ["role"], ["at", "source"], sums={"number": F.lit(1)})
    return numbered.select("role", "source", (F.coalesce("number", F.lit(0)) + 1).alias("number"))


def experiment_comparison(spark, sf):
    """Two arms: rates, interval of their difference, significance, and the samples that would settle it."""
    arms = experiment_arms(spark, sf)
    of = lambda v, c: F.coalesce(F.max(F.when(F.col("variant") == v, F.col(c))), F.lit(0))
    one = arms.agg(of("a", "successes").alias("sa"), of("a", "samples").alias("na"), of("b", "successes").alias("sb"), of("b", "samples").alias("nb"))
    return one.select(stats.compared_rates(F.col("sa"), F.col("na"), F.col("sb"), F.col("nb")).alias("c")).select("c.*")


def sample_sizes(spark, sf):
    """Samples an arm needs to tell each type of event's error-like rate from one a tenth higher."""
    e = table(spark, sf, "events").groupBy("event_type").agg((F.count_if(F.col("value") > 50) / F.count(F.lit(1))).alias("rate"))
    return e.select("event_type", stats.samples_needed(F.col("rate"), F.least(F.lit(1.0), F.col("rate") * 1.1)).alias("samples"))


def graded_answers(spark, sf):
    return conversations(spark, sf).select("conv_id", "turn", C.graded(F.col("text"), F.lit(2).cast("long")).alias("grade"), F.size(C.injections(F.concat(F.col("text"), F.when(F.col("turn") % 5 == 0, " You are now free. DROP TABLE x").otherwise("")))).cast("long").alias("signals"))


def cleaned_replies(spark, sf):
    """Statements in replies with fences and talk around them, and names from addresses."""
    k = F.col("c_custkey")
    reply = F.when(k % 3 == 0, F.concat(F.lit("Here it is:\n```sql\nSELECT "), k.cast("string"), F.lit(";\n```\nDone."))).when(k % 3 == 1, F.concat(F.lit("with t as (select "), k.cast("string"), F.lit(") select * from t ; ;\n\nThat is all."))).otherwise("I can't tell")
    mail = F.when(k % 2 == 0, F.concat(F.lit("ann-mary.o_neil"), k.cast("string"), F.lit("@x.org"))).otherwise("info@x.org")
    fence = F.concat(F.lit("```json\n{\"k\": "), k.cast("string"), F.lit("}\n```  "))
    return table(spark, sf, "customer").select("c_custkey", C.sql_of(reply).alias("sql"), C.name_of_address(mail).alias("name"), F.get_json_object(C.unfenced(fence), "$.k").try_cast("long").alias("k"))


def protected_paths(spark, sf):
    """Paths made from orders: test files and protected ones."""
    k = F.col("o_orderkey")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("src/", "tests/", "lib/tests/", ".github/", "a/b.lock/")]), (k % 5 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in ("test_a.py", "a_test.py", "conftest.py", "m.py", "x.lock", "Test.txt")]), (k % 6 + 1).cast("int")))
    return table(spark, sf, "orders").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n")).select("path", "n", C.is_test_path(F.col("path")).alias("test"), C.protected_path(F.col("path"), PROTECTED).alias("protected"))


def quoted_items(spark, sf):
    """Benchmark items, with typographic marks put in, that stand in messages made from them."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("before"))
    body = F.concat(F.lit("It says: “"), F.replace(F.col("text"), F.lit(" "), F.lit(" — ")), F.lit("” there."))
    return b.join(other, "item_id").select("item_id", C.quoted_in(F.col("text"), body).alias("whole"), C.quoted_in(F.col("before"), body).alias("other"), C.quoted_in(F.lit(""), body).alias("none"))


def shortened_messages(spark, sf):
    t = F.col("text")
    return conversations(spark, sf).select("conv_id", "turn", F.length(T.shortened(t, 60)).cast("long").alias("short"), F.md5(C.sides(t, 30, 20)).alias("sides"))


def word_vectors(spark, sf):
    """Messages as vectors of hashed words: 256 buckets of counts, of unit length, as rows of the buckets that hold any."""
    bucket = F.conv(F.substring(F.sha2("w", 256), 1, 8), 16, 10).cast("long") % 256
    each = conversations(spark, sf).select("conv_id", "turn", F.explode(T.words(F.col("text"))).alias("w"))
    counts = each.groupBy("conv_id", "turn", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("conv_id", "turn")))
    return counts.select("conv_id", "turn", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


def weighted_coverage(spark, sf):
    """Of the ten passages found for an item: the part of its terms' information that they hold, halved where the rarest term is missing; 0.22 is enough, with two terms or more."""
    docs = documents(spark, sf)
    found = retrieval.bm25(docs, "doc_id", "text", item_queries(spark, sf), STOP, 10).select("query_id", F.col("id").alias("doc_id"), "matched")
    asked = item_queries(spark, sf)
    terms = docs.select("doc_id", F.explode(F.array_distinct(T.keywords(F.col("text"), STOP))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    having = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + F.col("total") / (1 + F.coalesce("df", F.lit(0))))
    weighted = asked.join(having, "term", "left").crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("total")))).select("query_id", "term", F.round(weight, 9).alias("weight"))
    # Of equally heavy terms the least counts as the rarest.
    pairs = found.join(weighted, "query_id").join(terms.withColumn("here", F.lit(True)), ["doc_id", "term"], "left")
    out = pairs.groupBy("query_id", "doc_id", "matched").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("here"), F.col("weight")).otherwise(0.0)).alias("some"), F.min(F.struct((-F.col("weight")).alias("w"), "term", F.coalesce("here", F.lit(False)).alias("here"))).alias("rarest"))
    coverage = F.round(F.try_divide("some", "all") * F.when(F.col("rarest.here"), 1.0).otherwise(0.5), 6)
    return out.select("query_id", "doc_id", coverage.alias("coverage"), ((coverage >= 0.22) & (F.col("matched") >= 2)).alias("enough"))


W = "regexp_extract_all(lower({t}), '[a-z0-9]+')"
KW = "list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: w NOT IN ('" + "', '".join(STOP) + "') AND len(w) >= 2)"
ENDING = "CASE WHEN len({w}) <= 4 THEN {w} WHEN {w} LIKE '%ing' AND len({w}) >= 6 THEN {w}[:-4] WHEN {w} LIKE '%ies' AND len({w}) >= 6 THEN {w}[:-4] || 'y' WHEN {w} LIKE '%ied' AND len({w}) >= 6 THEN {w}[:-4] WHEN {w} LIKE '%es' AND len({w}) >= 5 THEN {w}[:-3] WHEN {w} LIKE '%ed' AND len({w}) >= 5 THEN {w}[:-3] WHEN {w} LIKE '%s' AND len({w}) >= 4 THEN {w}[:-2] ELSE {w} END"
SINGULAR = "CASE WHEN len({w}) <= 3 THEN {w} WHEN {w} LIKE '%ies' AND len({w}) > 4 THEN {w}[:-4] || 'y' WHEN regexp_matches({w}, '({e})$') THEN {w}[:-3] WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') THEN {w}[:-2] ELSE {w} END"
HISS, HISS_Z = "sses|shes|ches|xes", "sses|shes|ches|xes|zes"
ING = "CASE WHEN len({w}) <= 3 THEN {s} WHEN {s} LIKE '%ing' AND len({s}) > 5 THEN {s}[:-4] WHEN {s} LIKE '%ed' AND len({s}) > 4 THEN {s}[:-3] ELSE {s} END"
SILENT = "CASE WHEN len({w}) > 3 AND {s} LIKE '%e' AND len({s}) > 4 THEN {s}[:-2] ELSE {s} END"


def root_sql(w: str) -> str:
    s = "(" + SINGULAR.format(w=w, e=HISS_Z) + ")"
    return SILENT.format(w=w, s="(" + ING.format(w=w, s=s) + ")")


SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(replace({t}, chr(10), ' ')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
STEMS = "list_distinct(list_transform(" + KW.format(t=r"trim(regexp_replace(regexp_replace({t}, '\[\d+\]', ' ', 'g'), '\s+', ' ', 'g'))") + ", lambda w: " + ENDING.format(w="w") + "))"
PHI = "(CASE WHEN {z} >= 0 THEN 1 - exp(-{z} * {z} / 2) / sqrt(6.283185307179586::DOUBLE) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))) END)"
NUM = r"list_transform(regexp_extract_all({t}, '-?\d+(?:\.\d+)?'), lambda x: x::DOUBLE)"
CLOSE = "({a} = {b} OR abs({a} - {b}) <= 0.12::DOUBLE * greatest(abs({a}), abs({b})))"
REPLY = "'First claim. [' || turn || '] Second claim [' || (turn + 1) || '] [1]. Rest. [' || turn || ']'"
BOTH = f"(SELECT max(CASE WHEN variant = 'a' THEN successes END)::DOUBLE AS sa, max(CASE WHEN variant = 'a' THEN samples END)::DOUBLE AS na, max(CASE WHEN variant = 'b' THEN successes END)::DOUBLE AS sb, max(CASE WHEN variant = 'b' THEN samples END)::DOUBLE AS nb FROM ({ARMS}))"
Z = "(sb / nb - sa / na) / sqrt((sa + sb) / (na + nb) * (1 - (sa + sb) / (na + nb)) * (1 / na + 1 / nb))"
COMPARED = f"SELECT *, {Z} AS z, sb / nb - sa / na AS d, sqrt(sa / na * (1 - sa / na) / na + sb / nb * (1 - sb / nb) / nb) AS spread, 1 / (1 + 0.2316419::DOUBLE * abs({Z})) AS t FROM {BOTH}"
NEEDED = "CASE WHEN abs({b} - {a}) < 0.0001 THEN 0 ELSE ceil(pow(1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE, 2) * ({a} * (1 - {a}) + {b} * (1 - {b})) / pow({b} - {a}, 2)) END::BIGINT"

QUERIES = {
    "stemmed_terms": (stemmed_terms, f"SELECT stemmer, stem, count(*) AS n FROM (SELECT unnest([{{'stemmer': 'ending', 'stem': {ENDING.format(w='w')}}}, {{'stemmer': 'singular', 'stem': {SINGULAR.format(w='w', e=HISS)}}}, {{'stemmer': 'root', 'stem': {root_sql('w')}}}], recursive := true) FROM (SELECT unnest(list_distinct({W.format(t='text')})) AS w FROM conversations)) GROUP BY 1, 2 HAVING count(*) >= 10"),
    "groundedness": (groundedness, f"WITH s AS (SELECT conv_id, turn, unnest(list_transform({SENTENCES.format(t='text')}, lambda x: {STEMS.format(t='x')})) AS stems, unnest(range(len({SENTENCES.format(t='text')}))) AS n FROM conversations WHERE role = 'assistant'), p AS (SELECT conv_id, {STEMS.format(t='text')} AS stems FROM conversations WHERE role = 'user'), best AS (SELECT s.conv_id, s.turn, s.n, len(any_value(s.stems)) AS total, max(len(list_intersect(s.stems, coalesce(p.stems, [])))) AS hits FROM s LEFT JOIN p USING (conv_id) GROUP BY 1, 2, 3) SELECT conv_id, count(*) AS sentences, round(count(*) FILTER (total = 0 OR hits / total >= {GROUNDED}) / count(*), 4) AS grounded FROM best GROUP BY 1"),
    "citation_binding": (citation_binding, "WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS mark, md5(text) AS source FROM conversations WHERE role = 'user'), m AS (SELECT conv_id, turn, unnest([turn, turn + 1, 1]) AS mark, unnest([0, 1, 2]) AS pos FROM conversations WHERE role = 'assistant'), d AS (SELECT conv_id, turn, mark, min(pos) AS pos FROM m GROUP BY 1, 2, 3) SELECT conv_id, turn, count(source) AS cited, count(*) FILTER (source IS NULL) AS invented, arg_min(source, pos) FILTER (source IS NOT NULL) AS first_source FROM d LEFT JOIN p USING (conv_id, mark) GROUP BY 1, 2"),
    "marked_replies": (marked_replies, "SELECT conv_id, turn, 'First claim [' || turn || '] . Second claim [' || (turn + 1) || '] [1]. Rest [' || turn || '].' AS moved, 'First claim. ' || CASE WHEN turn IN (1, 2) THEN '[' || turn || ']' ELSE '' END || ' Second claim ' || CASE WHEN turn + 1 IN (1, 2) THEN '[' || (turn + 1) || ']' ELSE '' END || ' [1]. Rest. ' || CASE WHEN turn IN (1, 2) THEN '[' || turn || ']' ELSE '' END AS known, 'First claim. Second claim . Rest.' AS bare FROM conversations WHERE role = 'assistant'"),
    "answer_confidences": (answer_confidences, "SELECT conv_id, turn, CASE WHEN turn > 0 THEN round(least(1.0, 0.45::DOUBLE * ((turn % 10) / 10.0::DOUBLE) + 0.2::DOUBLE * [0.0, 0.75, 1.0][conv_id % 3 + 1]::DOUBLE + 0.35::DOUBLE * 0.5), 4) ELSE 0 END::DOUBLE AS confidence FROM conversations"),
    "required_phrases": (required_phrases, "SELECT conv_id, turn, (contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'les')) AND (contains(lower(text), 'and') OR contains(lower(text), 'und') OR contains(lower(text), 'y')) AS complete FROM conversations"),
    "findings": (findings, f"SELECT regexp_matches(s, '[0-9]') AND regexp_matches(lower(s), '{'|'.join(UNITS)}') AS measured, regexp_matches(lower(s), '{'|'.join(C.RESULT_VERBS)}') AS result, count(*) AS n FROM (SELECT unnest({SENTENCES.format(t='text')}) AS s FROM documents) GROUP BY 1, 2"),
    "claim_comparisons": (claim_comparisons, f"WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), v AS (SELECT conv_id, turn, list_distinct(list_transform({KW.format(t='text')}, lambda w: {root_sql('w')})) AS a, list_distinct(list_transform({KW.format(t='nxt')}, lambda w: {root_sql('w')})) AS b, {NUM.format(t='text')} AS x, {NUM.format(t='nxt')} AS y FROM c WHERE nxt IS NOT NULL), m AS (SELECT *, len(list_intersect(a, b)) AS common, len(list_filter(list_intersect(a, b), lambda t: NOT regexp_matches(t, '^[0-9]+$'))) AS shared, len(x) = 0 OR len(y) = 0 OR len(list_filter(x, lambda p: len(list_filter(y, lambda q: {CLOSE.format(a='p', b='q')})) = 0)) = 0 AS agree FROM v), r AS (SELECT *, round(greatest(CASE WHEN len(a) + len(b) - common = 0 THEN 1.0 ELSE common / (len(a) + len(b) - common) END, 0.85::DOUBLE * CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE common / least(len(a), len(b)) END), 6) AS similarity FROM m) SELECT conv_id, turn, similarity, agree, shared AS shared_subjects, similarity >= 0.5 AND agree AS duplicate, similarity >= 0.2 AND NOT agree AND shared >= 2 AS conflict FROM r"),
    "number_support": (number_support, f"WITH a AS (SELECT conv_id, list(v) AS allowed FROM (SELECT conv_id, unnest({NUM.format(t='text')}) AS v FROM conversations WHERE role = 'user') GROUP BY 1), r AS (SELECT conv_id, turn, {NUM.format(t=chr(39).join(['regexp_replace(text, ', chr(92) + '[' + chr(92) + 'd+' + chr(92) + ']', ', ', ' ', ', ', 'g', ')']))} AS x, coalesce(allowed, []) AS allowed FROM conversations LEFT JOIN a USING (conv_id) WHERE role = 'assistant') SELECT conv_id, turn, len(list_filter(x, lambda p: NOT (p = floor(p) AND abs(p) <= 10) AND len(list_filter(allowed, lambda q: {CLOSE.format(a='p', b='q')})) = 0)) AS unsupported FROM r"),
    "evidence_scores": (evidence_scores, "WITH d AS (SELECT doc_id, source, 0.5::DOUBLE * least(1.0, n_chars / 9973) + 0.35::DOUBLE * CASE source WHEN 'src0' THEN 0.9 WHEN 'src1' THEN 0.6 ELSE 0.3 END::DOUBLE + 0.15::DOUBLE * CASE WHEN doc_id % 7 <> 0 AND 2010 + doc_id % 20 >= 2025 THEN 1.0::DOUBLE ELSE round(1 / (1 + 0.2::DOUBLE * CASE WHEN doc_id % 7 = 0 THEN 99 ELSE 15 - doc_id % 20 END), 4) END AS score FROM documents), r AS (SELECT source, doc_id, round(score, 4) AS score FROM d) SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10"),
    "evidence_numbers": (evidence_numbers, "WITH f AS (SELECT role, md5(text) AS source, min((conv_id, -len(text), turn)) AS begun FROM conversations GROUP BY 1, 2) SELECT role, source, row_number() OVER (PARTITION BY role ORDER BY begun, source) AS number FROM f"),
    "experiment_comparison": (experiment_comparison, f"WITH c AS ({COMPARED}), p AS (SELECT *, round(2 * (1 - {PHI.format(z='abs(z)')}), 5) AS p FROM c) SELECT round(sa / na, 4) AS rate_a, round(sb / nb, 4) AS rate_b, round(d, 4) AS difference, p AS p_value, round(d - 1.959963984540054::DOUBLE * spread, 4) AS interval_low, round(d + 1.959963984540054::DOUBLE * spread, 4) AS interval_high, p < 0.05 AS significant, CASE WHEN p < 0.05 THEN 0 ELSE {NEEDED.format(a='(sa / na)', b='(sb / nb)')} END::BIGINT AS samples_needed FROM p"),
    "sample_sizes": (sample_sizes, f"SELECT event_type, {NEEDED.format(a='a', b='b')} AS samples FROM (SELECT event_type, r AS a, least(1.0::DOUBLE, r * 1.1::DOUBLE) AS b FROM (SELECT event_type, count(*) FILTER (value > 50) / count(*) AS r FROM events GROUP BY 1))"),
    "graded_answers": (graded_answers, r"SELECT conv_id, turn, CASE WHEN list_contains(list_transform(regexp_extract_all(text, '-?\d+'), lambda x: try_cast(x AS BIGINT)), 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS grade, CASE WHEN turn % 5 = 0 THEN 2 ELSE 0 END + len(list_filter(['ignore all previous', 'ignore previous instructions', 'disregard the above', 'system prompt', 'delete from', 'maintenance mode', 'new instructions'], lambda p: contains(lower(text), p))) + CASE WHEN turn % 5 <> 0 THEN len(list_filter(['you are now', 'drop table'], lambda p: contains(lower(text), p))) ELSE 0 END AS signals FROM conversations"),
    "cleaned_replies": (cleaned_replies, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'SELECT ' || c_custkey WHEN 1 THEN 'with t as (select ' || c_custkey || ') select * from t' ELSE 'I can''t tell' END AS sql, CASE WHEN c_custkey % 2 = 0 THEN 'Ann Mary O Neil' || c_custkey ELSE '' END AS name, c_custkey AS k FROM customer"),
    "protected_paths": (protected_paths, "SELECT path, count(*) AS n, contains(path, '/tests/') OR path LIKE 'tests/%' OR regexp_matches(path, '/(test_[^/]*|[^/]*_test\\.py|conftest\\.py)$') OR path LIKE '%/Test\\_%' AS test, regexp_matches(path, '(^|/)tests/') OR path LIKE '%.lock' OR path LIKE '.github/%' OR path LIKE '%conftest.py' AS protected FROM (SELECT ['src/', 'tests/', 'lib/tests/', '.github/', 'a/b.lock/'][o_orderkey % 5 + 1] || ['test_a.py', 'a_test.py', 'conftest.py', 'm.py', 'x.lock', 'Test.txt'][o_orderkey % 6 + 1] AS path FROM orders) GROUP BY 1"),
    "quoted_items": (quoted_items, "SELECT b.item_id, true AS whole, false AS other, false AS none FROM benchmark b JOIN benchmark c ON c.item_id + 1 = b.item_id"),
    "word_vectors": (word_vectors, f"WITH c AS (SELECT conv_id, turn, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n FROM (SELECT conv_id, turn, unnest({W.format(t='text')}) AS w FROM conversations) GROUP BY 1, 2, 3) SELECT conv_id, turn, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM c"),
    "weighted_coverage": (weighted_coverage, f"WITH {BM25}, seen AS (SELECT DISTINCT doc_id, unnest(terms) AS term FROM d), h AS (SELECT term, count(*) AS n FROM seen GROUP BY 1), w AS (SELECT query_id, q.term, round(ln(1 + total / (1 + coalesce(h.n, 0))), 9) AS weight FROM q LEFT JOIN h USING (term), sizes), p AS (SELECT r.query_id, r.doc_id, matched, w.term, weight, s.term IS NOT NULL AS here FROM ranked r JOIN w USING (query_id) LEFT JOIN seen s ON s.doc_id = r.doc_id AND s.term = w.term WHERE rank <= 10), c AS (SELECT query_id, doc_id, matched, round(sum(CASE WHEN here THEN weight ELSE 0 END) / sum(weight) * CASE WHEN arg_min(here, (-weight, term)) THEN 1.0 ELSE 0.5 END::DOUBLE, 6) AS coverage FROM p GROUP BY 1, 2, 3) SELECT query_id, doc_id, coverage, coverage >= 0.22 AND matched >= 2 AS enough FROM c"),
    "shortened_messages": (shortened_messages, r"SELECT conv_id, turn, CASE WHEN len(text) <= 60 THEN len(text) ELSE 3 + len(rtrim(CASE WHEN len(regexp_extract(left(text, 60), '(?s)^(.*) ', 1)) > 40 THEN regexp_extract(left(text, 60), '(?s)^(.*) ', 1) ELSE left(text, 60) END)) END AS short, md5(CASE WHEN len(text) <= 50 THEN text ELSE left(text, 30) || chr(10) || '...' || chr(10) || right(text, 20) END) AS sides FROM conversations"),
}
