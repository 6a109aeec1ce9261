"""Queries over the second stage of retrieval, evidence and summaries of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import context
from ..functions import text as T
from ..functions import vector as V
from ..operators import conversations as talk
from ..operators import evidence, reports, retrieval
from ..session import table
from ..storage import remove, scratch, written
from .assistant import ENDING, KW, NUM, SENTENCES, UNITS, conversations, root_sql
from .assistant import CLOSE as CLOSE_SQL
from .texts import BM25, KEY, STOP, documents, item_queries

SHORTLIST, KEPT_LINES, RECENT = 20, 12, 1
#: What a message is kept for: capitalised words of eight letters or more, which stand for identifiers.
NAMES = "[A-Z][a-z]{7,}"


def weighted_terms(asked, kept):
    """query_id, term, weight: how rare the terms of queries (query_id, term) are among documents, by kept_postings() of these."""
    having, sizes = retrieval.documents_with(kept)
    weight = F.round(F.log(1 + F.col("total") / (1 + F.coalesce("df", F.lit(0)))), 9)
    return asked.join(having, "term", "left").crossJoin(F.broadcast(sizes)).select("query_id", "term", weight.alias("weight"))


def reranked_search(spark, sf):
    """The shortlist of each query judged again: how much of its terms' weight a document holds, more if both rankings have it or its
    first line has some of it, and the words of the shortest stretch that holds all terms it has."""
    asked = item_queries(spark, sf)
    kept = retrieval.kept_postings(retrieval.postings(documents(spark, sf), "doc_id", "text", STOP), asked)
    scores = retrieval.scores_of(kept, asked)
    values = F.posexplode(F.array("score", F.col("matched").cast("double"))).alias("ranking", "value")
    ranked = retrieval.top_by(scores.select("query_id", "id", values), ["query_id", "ranking"], "value", "id", SHORTLIST)
    path = scratch(spark, "rerank")
    # Both are a few rows for each query, and read several times.
    found = written(ranked.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("lists")), f"{path}/found")
    weights = written(weighted_terms(asked, kept), f"{path}/weights")
    rows = written(retrieval.reranked(found, documents(spark, sf).select(F.col("doc_id").alias("id"), "text"), weights), f"{path}-result")
    remove(spark, path)
    return retrieval.top_by(rows, ["query_id"], "score", "id", 5).select("query_id", F.col("id").alias("doc_id"), "score", "coverage", F.col("window").cast("long").alias("window"), F.col("rank").cast("long").alias("rank"))


def variant_search(spark, sf):
    """Documents found by any form of a query, as it is (0) and with the documents' words of the same stem (1): by the best rank that a form gives them.

    Documents are read once: what is kept of them are postings of all words with a stem of the queries, which give the forms and the scores.
    """
    asked = item_queries(spark, sf)
    stems = asked.select("term", T.stem(F.col("term")).alias("stem")).distinct()
    kept = retrieval.kept_postings(retrieval.postings(documents(spark, sf), "doc_id", "text", STOP), stems.select(F.col("stem").alias("term")), T.stem)
    words = kept.filter("term is not null").groupBy(F.col("term").alias("other")).agg(F.count(F.lit(1)).alias("df")).filter("df >= 2")
    forms = retrieval.forms(asked, stems.join(words.select("other", T.stem(F.col("other")).alias("stem")), "stem").select("term", "other"))
    return retrieval.search_forms(kept, forms, 10).select("query_id", F.col("id").alias("doc_id"), F.col("best").cast("long").alias("best"), "n_forms", F.col("rank").cast("long").alias("rank"))


def claims_made(spark, sf):
    """id, claim, score, source, primary: the first sentence of every message, scored by its text; users' ones are primary."""
    c = conversations(spark, sf).filter("role <> 'system'")
    score = F.round((F.crc32(F.col("text").cast("binary")) % 1000) / 1000 * 0.8, 4)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.try_element_at(T.sentences(F.col("text")), F.lit(1)).alias("claim"), score.alias("score"), (F.col("conv_id") % 5).cast("string").alias("source"), (F.col("role") == "user").alias("primary"))


def deduplicated_evidence(spark, sf):
    return evidence.deduplicated(claims_made(spark, sf), STOP)


def conflicting_claims(spark, sf):
    """Two sources on orders by segment and year, one of which counts finished ones only: where they disagree."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    by = rows.groupBy("c_mktsegment", F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    each = by.select("c_mktsegment", "year", F.posexplode(F.array("all", "done")).alias("source", "n"))
    name = F.concat_ws("-", F.lower("c_mktsegment"), F.col("year").cast("string"), F.col("source").cast("string"))
    claim = F.concat(F.lower("c_mktsegment"), F.lit(" customers placed "), F.col("n").cast("string"), F.lit(" orders during "), F.col("year").cast("string"))
    return evidence.conflicts(each.select(name.alias("id"), claim.alias("claim")), STOP)


def extracted_sentences(spark, sf):
    """Of the ten passages found for an item, the two sentences each that answer it best."""
    found = retrieval.bm25(documents(spark, sf), "doc_id", "text", item_queries(spark, sf), STOP, 10).select("query_id", "id")
    stems = F.array_distinct(T.stems(F.col("text"), STOP))
    asked = table(spark, sf, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), stems.alias("question"))
    pairs = found.join(asked, "query_id").join(documents(spark, sf).select(F.col("doc_id").alias("id"), "text"), "id")
    out = evidence.best_sentences(pairs, STOP, UNITS)
    return out.select("query_id", F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n"), F.md5("sentence").alias("digest"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def message_overlaps(spark, sf):
    """Each message against the next of its conversation: the part of its stems that come again, on a scale from nothing to plenty, and the marks in it."""
    c = conversations(spark, sf)
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    both = c.join(nxt, ["conv_id", "turn"])
    marked = F.concat("text", F.lit(" [3] and [1][3]"))
    share = T.overlap_share(T.stems(F.col("text"), STOP), T.stems(F.col("next"), STOP))
    rows = both.select("conv_id", "turn", F.round(share, 6).alias("share"), F.array_join(T.markers(marked), ",").alias("marks"), F.md5(T.without_markers(marked)).alias("bare"))
    return rows.withColumn("scaled", F.round(V.rescaled(F.col("share"), 0.1, 0.4), 6))


def old_messages(spark, sf):
    return talk.recent_and_old(conversations(spark, sf), "conv_id", "turn", "role", RECENT).filter("not is_recent")


def conversation_summaries(spark, sf):
    """What is kept of the messages that a conversation's window leaves out: the user's words, and replies that name something; and names that got lost."""
    lines = talk.summary_lines(old_messages(spark, sf), "conv_id", "turn", "role", "text", NAMES)
    kept = talk.summaries(lines, "conv_id", KEPT_LINES)
    lost = talk.missing_names(old_messages(spark, sf), kept, "conv_id", "text", NAMES)
    return kept.join(lost, "conv_id", "left").select("conv_id", F.md5("summary").alias("digest"), F.col("lines").cast("long").alias("n_lines"), F.coalesce(F.size("missing"), F.lit(0)).cast("long").alias("missing"))


def answer_citations(spark, sf):
    """Answers that cite the three passages found first: how many hold the item itself, and how many are toxic ones, which no one may read."""
    found = retrieval.bm25(documents(spark, sf), "doc_id", "text", item_queries(spark, sf), STOP, 3).select("query_id", "id")
    # A few rows for each query. What isn't cited counts for nothing, so only cited texts are held against the items.
    cited = written(found, scratch(spark, "cited"))
    texts = documents(spark, sf).join(F.broadcast(cited.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    items = table(spark, sf, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("id"), "text")
    relevant = retrieval.quoting(texts, "doc_id", "text", items).select(F.col("quote_id").alias("query_id"), F.col("doc_id").alias("id"))
    forbidden = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return retrieval.citation_measures(cited, relevant, forbidden)


def prompt_blocks(spark, sf):
    """Prompts of five passages and a question, printed and read back: what stands in each block."""
    found = retrieval.bm25(documents(spark, sf), "doc_id", "text", item_queries(spark, sf), STOP, 5).select("query_id", F.col("id").alias("doc_id"), "rank")
    text = T.shortened(F.col("text"), 600)
    passage = F.struct("rank", F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), "source", text.alias("text"))
    passages = found.join(documents(spark, sf).select("doc_id", "text", "source"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(passage)).alias("passages"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("question"))
    prompt = F.concat_ws("\n\n", context.context_blocks(F.col("passages")), F.concat(F.lit("QUESTION: "), F.col("question")))
    prompts = passages.join(asked, "query_id").select("query_id", prompt.alias("prompt"))
    blocks = prompts.select("query_id", F.md5(context.question_of(F.col("prompt"))).alias("question"), F.explode(context.parsed_blocks(F.col("prompt"))).alias("b"))
    return blocks.select("query_id", "question", F.col("b.marker").cast("long").alias("marker"), "b.title", "b.source", F.md5("b.text").alias("digest"))


def customer_reports(spark, sf):
    """id, text of a report on each customer with orders, and its citations: some figures are wrong, some marks invented, some sentences without any."""
    k = F.col("c_custkey")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice")).cast("long").alias("total"), F.round(F.max("o_totalprice")).cast("long").alias("most"), F.year(F.max("o_orderdate")).alias("year"))
    rows = table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey")
    s = lambda c: F.col(c).cast("string")
    claimed = F.when(k % 7 == 3, F.col("most") * 3).otherwise(F.col("most")).cast("string")
    text = F.concat_ws(
        " ", F.concat(F.lit("Customer "), s("c_custkey"), F.lit(" placed "), s("n"), F.lit(" orders worth "), s("total"), F.lit(" in all [1].")), F.concat(F.lit("The largest of them came to "), claimed, F.lit(". [2]")),
        F.when(k % 5 == 1, "This sentence says something without any source."), F.when(k % 4 == 2, "It goes on [9]."), F.concat(F.lit("The last one was placed in "), s("year"), F.lit(" [2].")))
    marks = F.explode(F.when(k % 11 == 4, F.array()).otherwise(F.array(
        F.struct(F.lit(1).alias("marker"), F.concat_ws(" ", s("c_custkey"), F.lit("has"), s("n"), F.lit("orders,"), s("total")).alias("quote"), F.lit(None).cast("string").alias("date"), F.lit(0.9).alias("credibility")),
        F.struct(F.lit(2).alias("marker"), F.concat(F.lit("largest "), s("most")).alias("quote"), s("year").alias("date"), F.lit(0.5).alias("credibility"))))).alias("c")
    return rows.select(k.alias("id"), text.alias("text")), rows.select(k.alias("id"), marks).select("id", "c.*")


def report_checks(spark, sf):
    """What is wrong with each report, and how far to trust it: coverage and conflicts by key."""
    found = reports.verified(*customer_reports(spark, sf))
    trust = reports.trust(F.when(F.col("id") % 3 == 0, 0.5).otherwise(1.0), F.col("id") % 2, F.col("id") % 17 == 0)
    n = lambda c: F.size(c).cast("long")
    return found.select(F.col("id").alias("c_custkey"), F.col("sentences").cast("long").alias("sentences"), n("invented").alias("invented"), n("uncited").alias("uncited"), n("unsupported").alias("unsupported"), trust.alias("trust"))


def found_evidence(spark, sf):
    """id, section, sentence, source, score, date, credibility: the best two sentences of the ten passages found for each item, a section for each language."""
    found = retrieval.bm25(documents(spark, sf), "doc_id", "text", item_queries(spark, sf), STOP, 10).select("query_id", "id")
    asked = table(spark, sf, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.array_distinct(T.stems(F.col("text"), STOP)).alias("question"))
    texts = documents(spark, sf).select(F.col("doc_id").alias("id"), "text", "lang", "source")
    best = evidence.best_sentences(found.join(asked, "query_id").join(texts.select("id", "text"), "id"), STOP, UNITS)
    rows = best.join(texts.select("id", "lang", "source"), "id")
    return rows.select(F.col("query_id").alias("id"), F.coalesce("lang", F.lit("none")).alias("section"), "sentence", F.concat_ws("/", "source", F.col("id").cast("string")).alias("source"), F.round("score", 6).alias("score"), F.lit(None).cast("string").alias("date"), F.lit(0.8).alias("credibility"))


def research_reports(spark, sf):
    """Reports written from evidence, and held against what they cite: nothing in them may be without a source."""
    path = scratch(spark, "reports")
    text, cited = (written(x, f"{path}/{n}") for n, x in zip(("text", "cited"), reports.composed(written(found_evidence(spark, sf), f"{path}/evidence")), strict=True))
    checked = reports.verified(text, cited)
    out = checked.select("id", F.md5("text").alias("digest"), F.col("cited").cast("long").alias("cited"), F.size("invented").cast("long").alias("invented"), F.size("unsupported").cast("long").alias("unsupported"), F.size("uncited").cast("long").alias("uncited"))
    result = written(out, f"{path}-result")
    remove(spark, path)
    return result


TERMS = "list_distinct(list_transform(" + KW.format(t="claim") + f", lambda w: {root_sql('w')}))"
W = "w AS (SELECT query_id, q.term, round(ln(1 + total / (1 + coalesce(h.n, 0))), 9) AS weight FROM q LEFT JOIN (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(terms) AS term FROM d) GROUP BY 1) h USING (term), sizes)"
STEM = ENDING.format(w="{w}")

QUERIES = {
    "reranked_search": (reranked_search, rf"""
WITH {BM25}, {W},
c AS (SELECT query_id, doc_id, (rank <= {SHORTLIST})::INT + (rank2 <= {SHORTLIST})::INT AS lists FROM ranked WHERE rank <= {SHORTLIST} OR rank2 <= {SHORTLIST}),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+') AS head FROM documents),
o AS (SELECT query_id, doc_id, i, words[i] AS term FROM (SELECT query_id, doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM c JOIN t USING (doc_id)) JOIN q USING (query_id) WHERE q.term = words[i]),
nx AS (SELECT a.query_id, a.doc_id, a.i, b.term, min(b.i) AS j FROM o a JOIN o b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.i >= a.i GROUP BY 1, 2, 3, 4),
k AS (SELECT query_id, doc_id, count(DISTINCT term) AS k FROM o GROUP BY 1, 2),
win AS (SELECT query_id, doc_id, min(span) AS span FROM (SELECT query_id, doc_id, i, max(j) - i + 1 AS span, count(*) AS n FROM nx GROUP BY 1, 2, 3) JOIN k USING (query_id, doc_id) WHERE n = k GROUP BY 1, 2),
p AS (SELECT c.query_id, c.doc_id, lists, w.term, weight, list_contains(t.words, w.term) AS here, list_contains(t.head, w.term) AS above FROM c JOIN t USING (doc_id) JOIN w ON w.query_id = c.query_id),
s AS (SELECT query_id, doc_id, any_value(lists) AS lists, sum(CASE WHEN here THEN weight ELSE 0 END) / sum(weight) * CASE WHEN arg_min(here, (-weight, term)) THEN 1.0 ELSE 0.5 END::DOUBLE AS coverage,
        sum(CASE WHEN above THEN weight ELSE 0 END) / sum(weight) * CASE WHEN arg_min(above, (-weight, term)) THEN 1.0 ELSE 0.5 END::DOUBLE AS heading FROM p GROUP BY 1, 2),
r AS (SELECT query_id, doc_id, round(least(1.0, round(coverage, 9) * (1 + CASE WHEN lists = 2 THEN 0.08 ELSE 0 END::DOUBLE + 0.1::DOUBLE * round(heading, 9))), 4) AS score, round(coverage, 6) AS coverage FROM s)
SELECT query_id, doc_id, score, coverage, span AS window, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r JOIN win USING (query_id, doc_id) QUALIFY rank <= 5"""),
    "variant_search": (variant_search, f"""
WITH d AS (SELECT doc_id, {KEY} AS terms FROM documents), sizes AS (SELECT count(*) AS total, avg(len(terms)) AS mean FROM d),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({KEY}) AS term FROM benchmark WHERE item_id % 20 = 0),
v AS (SELECT other, {STEM.format(w='other')} AS stem FROM (SELECT unnest(list_distinct(terms)) AS other FROM d) GROUP BY 1 HAVING count(*) >= 2),
q AS (SELECT query_id, 0 AS form, term FROM asked UNION SELECT query_id, 1, term FROM asked UNION SELECT query_id, 1, other FROM asked JOIN v ON v.stem = {STEM.format(w='asked.term')}),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query_id, form, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 9) AS score FROM tf JOIN df USING (term) JOIN q USING (term), sizes GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, form ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10),
best AS (SELECT query_id, doc_id, min(rank) AS best, count(*) AS n_forms FROM ranked GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, n_forms DESC, doc_id) AS rank FROM best QUALIFY rank <= 10"""),
    "deduplicated_evidence": (deduplicated_evidence, f"""
WITH RECURSIVE c AS (
  SELECT conv_id * 1000 + turn AS id, coalesce({SENTENCES.format(t='text')}[1], '') AS claim, round(crc % 1000 / 1000.0::DOUBLE * 0.8::DOUBLE, 4) AS score, (conv_id % 5)::VARCHAR AS source, role = 'user' AS prime
  FROM (SELECT *, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::BIGINT FOR i IN range(1, octet_length(encode(text)) + 1)]), lambda c, b: xor(c >> 8, of[(xor(c, b) & 255) + 1])), 4294967295) AS crc
        FROM conversations, (SELECT list(r ORDER BY i) AS of FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) t(i))) WHERE role <> 'system')),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k, {TERMS} AS terms, {NUM.format(t='claim')} AS nums FROM c),
m AS (SELECT a.k AS later, b.k AS earlier, len(list_intersect(a.terms, b.terms)) AS common, len(a.terms) AS na, len(b.terms) AS nb,
        len(a.nums) = 0 OR len(b.nums) = 0 OR len(list_filter(a.nums, lambda p: len(list_filter(b.nums, lambda q: {CLOSE_SQL.format(a='p', b='q')})) = 0)) = 0 AS agree FROM r a JOIN r b ON b.k < a.k),
p AS (SELECT later, earlier FROM m WHERE agree AND round(greatest(CASE WHEN na + nb = 0 THEN 1 ELSE common / (na + nb - common) END, CASE WHEN least(na, nb) = 0 THEN 0 ELSE 0.85::DOUBLE * common / least(na, nb) END), 4) >= 0.6),
near AS (SELECT k, coalesce(list(earlier) FILTER (earlier IS NOT NULL), []) AS x FROM r LEFT JOIN p ON later = k GROUP BY 1),
l AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT i + 1, CASE WHEN list_has_any(x, kept) THEN kept ELSE list_append(kept, i + 1) END FROM l JOIN near ON k = i + 1),
z AS (SELECT kept FROM l ORDER BY i DESC LIMIT 1),
f AS (SELECT r.*, list_min(list_intersect(x, kept)) AS dup FROM r JOIN near USING (k), z),
g AS (SELECT a.*, a.prime AND b.prime AND a.source <> b.source AS free, row_number() OVER (PARTITION BY a.dup ORDER BY a.k) AS nth FROM f a JOIN f b ON b.k = a.dup),
s AS (SELECT dup, count(*) AS n, sum(CASE WHEN free THEN least(0.16::DOUBLE, 0.08::DOUBLE * nth) ELSE 0 END) AS gain FROM g GROUP BY 1)
SELECT f.id, e.id AS duplicate_of, coalesce(n, 0) AS corroborated_by, round(CASE WHEN gain > 0 THEN least(1.0, f.score + gain) ELSE f.score END, 4) AS score FROM f LEFT JOIN s ON s.dup = f.k LEFT JOIN f e ON e.k = f.dup"""),
    "conflicting_claims": (conflicting_claims, f"""
WITH b AS (SELECT lower(c_mktsegment) AS s, year(o_orderdate) AS y, count(*) AS n0, count(*) FILTER (o_orderstatus = 'F') AS n1 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
e AS (SELECT s, y, 0 AS src, n0 AS n FROM b UNION ALL SELECT s, y, 1, n1 FROM b),
i AS (SELECT s || '-' || y || '-' || src AS id, s || ' customers placed ' || n || ' orders during ' || y AS claim FROM e),
r AS (SELECT id, {TERMS} AS terms, {NUM.format(t='claim')} AS nums FROM i),
m AS (SELECT a.id, b.id AS other, len(list_intersect(a.terms, b.terms)) AS common, len(a.terms) AS na, len(b.terms) AS nb, len(list_filter(list_intersect(a.terms, b.terms), lambda t: NOT regexp_matches(t, '^[0-9]+$'))) AS subjects,
        len(list_filter(b.nums, lambda p: len(list_filter(a.nums, lambda q: {CLOSE_SQL.format(a='p', b='q')})) = 0)) = 0 AS agree FROM r a JOIN r b ON a.id < b.id),
s AS (SELECT *, round(greatest(common / (na + nb - common), 0.85::DOUBLE * common / least(na, nb)), 4) AS similarity FROM m)
SELECT id, other, similarity FROM s WHERE similarity >= 0.3 AND NOT agree AND subjects >= 2"""),
    "extracted_sentences": (extracted_sentences, f"""
WITH {BM25}, a AS (SELECT item_id AS query_id, list_distinct(list_transform({KW.format(t='text')}, lambda w: {ENDING.format(w='w')})) AS question FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT query_id, doc_id, question, unnest({SENTENCES.format(t='t.text')}) AS sentence, unnest(range(len({SENTENCES.format(t='t.text')}))) AS n FROM ranked JOIN documents t USING (doc_id) JOIN a USING (query_id) WHERE rank <= 10),
j AS (SELECT *, list_transform({KW.format(t='sentence')}, lambda w: {ENDING.format(w='w')}) AS stems FROM s),
k AS (SELECT query_id, doc_id, n, sentence, len(list_intersect(question, stems)) AS shared, len(question) AS total FROM j WHERE len(stems) >= 4),
o AS (SELECT *, round(shared / total + CASE WHEN regexp_matches(sentence, '[0-9]') AND regexp_matches(lower(sentence), '{'|'.join(UNITS)}') THEN 0.45 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(lower(sentence), '{'|'.join(C.RESULT_VERBS)}') THEN 0.1 ELSE 0 END::DOUBLE, 9) AS score FROM k WHERE shared > 0)
SELECT query_id, doc_id, n, md5(sentence) AS digest, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, n) AS rank FROM o QUALIFY rank <= 2"""),
    "message_overlaps": (message_overlaps, rf"WITH c AS (SELECT conv_id, turn, text, list_distinct(list_transform({KW.format(t='text')}, lambda w: {ENDING.format(w='w')})) AS st FROM conversations), m AS (SELECT a.conv_id, a.turn, a.text, round(CASE WHEN len(a.st) = 0 THEN 0 ELSE len(list_intersect(a.st, b.st)) / len(a.st) END, 6) AS share FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, share, '3,1' AS marks, md5(trim(regexp_replace(text || ' and ', '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS bare, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (share - 0.1::DOUBLE) / 0.3::DOUBLE)), 6) AS scaled FROM m"),
    "answer_citations": (answer_citations, f"WITH {BM25}, c AS (SELECT query_id, doc_id FROM ranked WHERE rank <= 3), j AS (SELECT query_id, doc_id, contains(d.text, b.text) AS hit, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS closed FROM c JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id) SELECT query_id, count(*) AS cited, round(count(*) FILTER (hit) / count(*), 4) AS precision, count(DISTINCT doc_id) FILTER (closed) AS leaked FROM j GROUP BY 1"),
    "research_reports": (research_reports, rf"""
WITH {BM25}, a AS (SELECT item_id AS query_id, list_distinct(list_transform({KW.format(t='text')}, lambda w: {ENDING.format(w='w')})) AS question FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT query_id, doc_id, question, coalesce(lang, 'none') AS section, concat_ws('/', source, doc_id::VARCHAR) AS source, unnest({SENTENCES.format(t='t.text')}) AS sentence, unnest(range(len({SENTENCES.format(t='t.text')}))) AS n FROM ranked JOIN documents t USING (doc_id) JOIN a USING (query_id) WHERE rank <= 10),
j AS (SELECT *, list_transform({KW.format(t='sentence')}, lambda w: {ENDING.format(w='w')}) AS stems FROM s),
k AS (SELECT *, len(list_intersect(question, stems)) AS shared, len(question) AS total FROM j WHERE len(stems) >= 4),
o AS (SELECT *, round(shared / total + CASE WHEN regexp_matches(sentence, '[0-9]') AND regexp_matches(lower(sentence), '{'|'.join(UNITS)}') THEN 0.45 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(lower(sentence), '{'|'.join(C.RESULT_VERBS)}') THEN 0.1 ELSE 0 END::DOUBLE, 9) AS score FROM k WHERE shared > 0),
e AS (SELECT query_id AS id, section, sentence, source, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, n) <= 2),
u AS (SELECT *, (section, -score, source, sentence) AS place FROM e QUALIFY row_number() OVER (PARTITION BY id, section, sentence ORDER BY -score, source) = 1),
f AS (SELECT id, source, row_number() OVER (PARTITION BY id ORDER BY min(place)) AS marker FROM u GROUP BY id, source),
m AS (SELECT u.*, marker, regexp_replace(sentence, '[.!?]+$', '') || ' [' || marker || ']' || CASE WHEN regexp_matches(sentence, '[.!?]+$') THEN regexp_extract(sentence, '[.!?]+$') ELSE '.' END AS said FROM u JOIN f USING (id, source))
SELECT id, md5(string_agg(said, ' ' ORDER BY place)) AS digest, count(*) AS cited, 0 AS invented, 0 AS unsupported, 0 AS uncited FROM m GROUP BY id"""),
    "report_checks": (report_checks, f"""
WITH o AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice))::BIGINT AS total, round(max(o_totalprice))::BIGINT AS most, year(max(o_orderdate)) AS y FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
f AS (SELECT *, k % 11 = 4 AS bare, [k, n, total, CASE WHEN k % 7 = 3 THEN 3 * most ELSE most END, y]::DOUBLE[] AS said, CASE WHEN k % 11 = 4 THEN []::DOUBLE[] ELSE [k, n, total, most, y]::DOUBLE[] END AS known FROM o),
c AS (SELECT k, 3 + (k % 5 = 1)::INT + (k % 4 = 2)::INT AS sentences, CASE WHEN bare THEN 2 ELSE 0 END + (k % 4 = 2)::INT AS invented, CASE WHEN NOT bare AND k % 5 = 1 THEN 1 ELSE 0 END AS uncited,
        len(list_filter(said, lambda p: abs(p) > 10 AND len(list_filter(known, lambda q: {CLOSE_SQL.format(a='p', b='q')})) = 0)) AS unsupported, bare FROM f),
t AS (SELECT *, 0.25::DOUBLE * CASE WHEN k % 3 = 0 THEN 0.5 ELSE 1 END::DOUBLE + 0.25::DOUBLE * CASE WHEN bare THEN 0 ELSE 0.62 END::DOUBLE + 0.25::DOUBLE * greatest(0, 1 - CASE WHEN invented > 0 THEN 0.4 ELSE 0 END - CASE WHEN unsupported > 0 THEN 0.4 ELSE 0 END - CASE WHEN uncited > 0 THEN 0.2 ELSE 0 END)::DOUBLE + 0.15::DOUBLE * CASE WHEN k % 2 = 1 THEN 0.8 ELSE 1 END::DOUBLE + 0.1::DOUBLE * CASE WHEN k % 17 = 0 THEN 0.6 ELSE 1 END::DOUBLE AS w FROM c)
SELECT k AS c_custkey, sentences, invented, uncited, unsupported, round(CASE WHEN bare THEN least(w, 0.25) ELSE w END, 4) AS trust FROM t"""),
    "prompt_blocks": (prompt_blocks, rf"WITH {BM25}, c AS (SELECT query_id, doc_id, rank, source, CASE WHEN len(text) <= 600 THEN text ELSE rtrim(CASE WHEN len(regexp_extract(left(text, 600), '(?s)^(.*) ', 1)) > 40 THEN regexp_extract(left(text, 600), '(?s)^(.*) ', 1) ELSE left(text, 600) END) || '...' END AS t FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5) SELECT query_id, md5(trim(string_split(b.text, chr(10))[1])) AS question, rank AS marker, 'document ' || doc_id AS title, source, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')) AS digest FROM c JOIN benchmark b ON item_id = query_id"),
    "conversation_summaries": (conversation_summaries, rf"""
WITH o AS (SELECT * FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS u FROM conversations) WHERE NOT (u < {RECENT} OR (u = {RECENT} AND role = 'user'))),
l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Customer asked: ' ELSE 'Agent said: ' END || left(trim(text, ' ' || chr(10) || chr(9)), 160) AS line FROM o WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' AND (role = 'user' OR (role = 'assistant' AND regexp_matches(text, '{NAMES}')))),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM l),
s AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS summary, count(*) AS n_lines FROM k WHERE back <= {KEPT_LINES} GROUP BY 1),
n AS (SELECT DISTINCT conv_id, upper(unnest(regexp_extract_all(text, '{NAMES}'))) AS name FROM o)
SELECT s.conv_id, md5(summary) AS digest, n_lines, (SELECT count(*) FROM n WHERE n.conv_id = s.conv_id AND NOT contains(upper(summary), name)) AS missing FROM s"""),
}
