"""Queries over documents, pages, vectors, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations, ingest, retrieval
from ..session import spread, table

#: Words that say little: those of one's own choice, given to every operator as a parameter.
STOP = ("the", "of", "and", "to", "in", "a", "is", "it", "for", "on")
INTENTS = [
    ("the", [("the", 2), ("that", 1)]),
    ("and", [("and", 2), ("for", 1)]),
    ("que", [("que", 2), ("las", 1)]),
    ("und", [("und", 2), ("der", 1)]),
]


def documents(spark, sf):
    return spread(table(spark, sf, "documents"))


def documents_by_language(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


def document_facts(spark, sf):
    w = T.words(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.greatest(F.lit(1), F.length("text") / 4).cast("long").alias("tokens"))


def content_hashes(spark, sf):
    return documents(spark, sf).select("doc_id", ingest.content_hash(F.col("text"), F.col("source")).alias("hash"))


def first_by_content(spark, sf):
    """Documents that stay when the first of equal content within a source wins."""
    hashed = documents(spark, sf).select("source", F.sha2("text", 256).alias("hash"), "doc_id")
    return ingest.first_by(hashed, ["source", "hash"], "doc_id").select("doc_id", "source")


def allowed_documents(spark, sf):
    return retrieval.allowed(documents(spark, sf), "lang", ["en", "de"], "source", ["src1", "src2", "src3"]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


def denied_documents(spark, sf):
    """What a caller may not see: the rest of those that are permitted, those without a tag included."""
    docs = documents(spark, sf)
    return docs.join(retrieval.allowed(docs, "lang", ["en", "de"], "source", ["src1", "src2", "src3"]).select("doc_id"), "doc_id", "left_anti").select("doc_id")


def term_frequencies(spark, sf):
    each = documents(spark, sf).select("doc_id", F.explode(F.array_distinct(T.keywords(F.col("text"), STOP))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 20")


def item_queries(spark, sf):
    """The stated queries, items whose identifier 20 divides: query_id, term."""
    items = table(spark, sf, "benchmark").filter("item_id % 20 = 0")
    return items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.keywords(F.col("text"), STOP))).alias("term"))


def bm25_search(spark, sf):
    found = retrieval.bm25(documents(spark, sf), "doc_id", "text", item_queries(spark, sf), STOP, 10)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def query_vectors(spark, sf):
    v = table(spark, sf, "embeddings").filter("vec_id % 20 = 0")
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")


def vector_search(spark, sf):
    q = query_vectors(spark, sf).drop("label")
    return retrieval.vector_search(table(spark, sf, "embeddings"), "vec_id", "embedding", q, top=10).select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def scoped_vector_match(spark, sf):
    """Semantic cache: the best vector of the same scope above a threshold."""
    found = retrieval.vector_search(table(spark, sf, "embeddings"), "vec_id", "embedding", query_vectors(spark, sf), scope="label", top=2, least=0.0)
    return found.select("query_id", F.col("id").alias("vec_id"), "score")


def hybrid_search(spark, sf):
    """Fusion of two rankings of documents by query: BM25, and the number of matched terms."""
    scores = retrieval.bm25_scores(documents(spark, sf), "doc_id", "text", item_queries(spark, sf), STOP)
    # Both rankings in one pass over the scores: a row for each.
    values = F.posexplode(F.array("score", F.col("matched").cast("double"))).alias("ranking", "value")
    ranked = retrieval.top_by(scores.select("query_id", "id", values), ["query_id", "ranking"], "value", "id", 20)
    fused = ranked.groupBy("query_id", "id").agg(F.sum(1 / (retrieval.FUSION + F.col("rank"))).alias("score"))
    return retrieval.top_by(fused, ["query_id"], "score", "id", 5).select("query_id", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


def retrieval_measures(spark, sf):
    """How the ten passages found for an item do, where relevant ones contain its text: counted by item, never listed."""
    found = retrieval.bm25(documents(spark, sf), "doc_id", "text", item_queries(spark, sf), STOP, 10).select("query_id", F.col("id").alias("doc_id"), "rank")
    relevant = items_in_documents(spark, sf).filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "doc_id", F.lit(1).alias("hit"))
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    judged = found.join(relevant, ["query_id", "doc_id"], "left").groupBy("query_id").agg(*retrieval.counted(F.col("hit").isNotNull(), F.col("rank"), 5))
    both = judged.join(wanted, "query_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    return both.select("query_id", *[F.round(c, 6).alias(name) for name, c in retrieval.rates(5).items()])


def items_in_documents(spark, sf):
    """Quotes that a document contains word for word."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.quoting(documents(spark, sf), "doc_id", "text", items).select("doc_id", F.col("quote_id").alias("item_id"))


def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), F.parse_url("url", F.lit("HOST")).alias("host"))


def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(T.html_text(F.col("html"))).cast("long").alias("chars"), F.md5(T.html_text(F.col("html"))).alias("digest"))


def pages_by_host(spark, sf):
    return table(spark, sf, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def repeated_lines(spark, sf):
    out = ingest.without_repeated_lines(documents(spark, sf), "doc_id", "text")
    return out.select("doc_id", F.length("text").cast("long").alias("chars"))


def chunks(spark, sf):
    out = ingest.chunks(documents(spark, sf), "doc_id", "text")
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size(F.split("chunk", " "))).cast("long").alias("words"))


def section_lines(spark, sf):
    out = ingest.numbered_sections(documents(spark, sf), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.coalesce("heading", F.lit("")).alias("heading"))


def emails(spark, sf):
    found = F.regexp_extract_all("text", F.lit(T.EMAIL), 0)
    return documents(spark, sf).select("doc_id", F.explode(found).alias("email")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def redactions(spark, sf):
    count = lambda mark: F.size(F.split("clean", mark)).cast("long") - 1
    clean = documents(spark, sf).select("doc_id", T.redacted(F.col("text")).alias("clean"))
    return clean.select("doc_id", count(r"\[EMAIL_REDACTED\]").alias("emails"), count(r"\[CARD_ENDING_").alias("cards"), count(r"\[IBAN_REDACTED\]").alias("ibans"), count(r"\[PHONE_REDACTED\]").alias("phones"))


def numbers_in_texts(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(T.numbers(F.col("text"))).cast("long").alias("n")).filter("n > 0")


def similar_to_next(spark, sf):
    """Jaccard and containment of each document's words with those of the next by identifier."""
    a = documents(spark, sf).select("doc_id", F.array_distinct(T.words(F.col("text"))).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(T.containment(F.col("a"), F.col("b")), 6).alias("containment"))


def content_diff(spark, sf):
    """Documents whose text differs between two sources' snapshots, keyed by length."""
    d = documents(spark, sf).groupBy("source", "n_chars").agg(F.max(F.md5("text")).alias("digest"))
    before, after = (d.filter(F.col("source") == s).select("n_chars", "digest") for s in ("src0", "src1"))
    return ingest.snapshot_diff(before, after, "n_chars", "digest")


def label_quality(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", "lang")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").cast("long").alias("toxic"), F.round(F.avg("quality"), 6).alias("quality"))


def turn_counts(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("users"), F.max("turn").alias("last_turn"))


def recent_turns(spark, sf):
    return conversations.recent_and_old(table(spark, sf, "conversations"), "conv_id", "turn", "role", 2).select("conv_id", "turn", "is_recent")


def message_intents(spark, sf):
    found = conversations.classified(F.col("text"), INTENTS, "other")
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", found["label"].alias("label"), found["score"].alias("score"))


def long_conversations(spark, sf):
    """Escalation by turns: those with four user turns or more, and their first user message's length."""
    c = table(spark, sf, "conversations").filter("role = 'user'")
    out = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("users"), F.min_by(F.length("text"), "turn").cast("long").alias("first_chars"))
    return out.filter("users >= 4")


def similarity_sweep(spark, sf):
    """Pairs of the stated query vectors with all vectors that reach each threshold, of the same label and of others."""
    return retrieval.threshold_counts(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", query_vectors(spark, sf), [k / 10 for k in range(11)])


def tokens_by_role(spark, sf):
    tokens = F.when(F.length("text") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).cast("long")
    price = F.when(F.col("role") == "assistant", 0.6).otherwise(0.15)
    c = table(spark, sf, "conversations").withColumn("tokens", tokens)
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") / 1e6 * price), 8).alias("cost"))


def review_decisions(spark, sf):
    """Ordered gates: toxic ones are rejected, low quality is reviewed, the rest approved; documents without a label are reviewed."""
    docs = documents(spark, sf).select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    decision = F.when(F.col("toxic") == 1, "REJECT").when(F.coalesce("quality", F.lit(0)) == 0, "NEEDS_REVIEW").otherwise("AUTO_APPROVE")
    return docs.groupBy("source", decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


def cache_keys(spark, sf):
    """Messages by the key of an exact cache: the first word of the normalised text within its role."""
    first = F.try_element_at(F.split(F.lower(T.collapsed(F.col("text"))), " "), F.lit(1))
    key = F.sha2(F.concat_ws("||", first, "role"), 256)
    return table(spark, sf, "conversations").groupBy(F.substring(key, 1, 32).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_tiers(spark, sf):
    """Documents seen before: with the same text in the same source, the same text elsewhere, or the same length, source and first words."""
    d = documents(spark, sf).select("doc_id", "source", F.md5("text").alias("digest"), "n_chars", F.substring("text", 1, 40).alias("head"))
    first = lambda keys, name: d.groupBy(*keys).agg(F.min("doc_id").alias(name))
    tiers = [(["source", "digest"], "one"), (["digest"], "two"), (["source", "n_chars", "head"], "three")]
    for keys, name in tiers:
        d = d.join(first(keys, name), keys)
    tier = F.when(F.col("one") < F.col("doc_id"), 1).when(F.col("two") < F.col("doc_id"), 2).when(F.col("three") < F.col("doc_id"), 3)
    return d.select("doc_id", tier.alias("tier")).filter("tier is not null")


def supported_replies(spark, sf):
    """By conversation: the mean part of the words of replies that stand in what the user wrote in it."""
    c = table(spark, sf, "conversations").select("conv_id", "role", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"), "turn")
    asked = c.filter("role = 'user'").select("conv_id", "w").distinct().withColumn("known", F.lit(1))
    said = c.filter("role = 'assistant'").join(asked, ["conv_id", "w"], "left")
    return said.groupBy("conv_id").agg(F.round(F.count("known") / F.count(F.lit(1)), 6).alias("support"))


def conflicting_labels(spark, sf):
    """Documents of a source that begin with the same letters and have labels of different quality: pairs are counted by beginning, not joined."""
    d = documents(spark, sf).select("doc_id", "source", F.lower(F.substring("text", 1, 3)).alias("head")).join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source", "head").agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")


WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
STOPPED = "('" + "', '".join(STOP) + "')"
KEY = f"list_filter({WORDS}, lambda x: x NOT IN {STOPPED} AND len(x) >= 2)"
BM25 = f"""
d AS (SELECT doc_id, {KEY} AS terms FROM documents),
sizes AS (SELECT count(*) AS total, avg(len(terms)) AS mean FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest({KEY}) AS term FROM benchmark WHERE item_id % 20 = 0),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 9) AS score, count(*) AS matched
  FROM tf JOIN df USING (term) JOIN q USING (term), sizes GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id) AS rank2 FROM scored)"""
DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
NEAREST = f"SELECT q.vec_id AS query_id, e.vec_id, round({DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"
SUM_OF = "list_sum(list_transform(range(len(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, len(d) - i, 1)::INT WHEN substr(d, len(d) - i, 1)::INT > 4 THEN substr(d, len(d) - i, 1)::INT * 2 - 9 ELSE substr(d, len(d) - i, 1)::INT * 2 END))"
#: Patterns of what is looked for stand alone in a text here: no own identifiers, and nothing within a word.
REDACTED = rf"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{T.EMAIL}', '[EMAIL_REDACTED]', 'g'), '{T.IBAN}', '[IBAN_REDACTED]', 'g') AS t FROM documents),
c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '{T.CARD}')) AS card FROM a),
v AS (SELECT doc_id, rtrim(card) AS card FROM (SELECT *, regexp_replace(card, '[^0-9]', '', 'g') AS d FROM c) WHERE len(d) BETWEEN 12 AND 19 AND {SUM_OF} % 10 = 0),
w AS (SELECT a.doc_id, list_reduce(list_prepend(t, coalesce(cards, [])), lambda acc, x: replace(acc, x, '[CARD_ENDING_]')) AS t FROM a LEFT JOIN (SELECT doc_id, list(card ORDER BY card) AS cards FROM v GROUP BY 1) USING (doc_id))
SELECT doc_id, len(string_split(t, '[EMAIL_REDACTED]')) - 1 AS emails, len(string_split(t, '[CARD_ENDING_]')) - 1 AS cards, len(string_split(t, '[IBAN_REDACTED]')) - 1 AS ibans,
       len(regexp_extract_all(t, '(?:^|\W)(?:\+\d{{1,3}}[ -]?)?(?:\(\d{{2,4}}\)[ -]?)?\d[\d -]{{7,}}\d(?:\W|$)')) AS phones FROM w"""
HTML = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<nav\b.*?</nav\s*>', ' ', 'g'), '(?is)<footer\b.*?</footer\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
TOKENS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
HEADING = r"regexp_matches(line, '^#{1,6} \S|^\d+(\.\d+)*\.? [A-Z]') OR (regexp_matches(line, '^[^a-z]*$') AND regexp_matches(line, '[A-Z].*[A-Z].*[A-Z]') AND len(line) <= 70)"
INTENT = lambda k: "(" + " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN {float(w)} ELSE 0.0 END" for p, w in INTENTS[k][1]) + ")"
BEST = "greatest(" + ", ".join(INTENT(k) for k in range(len(INTENTS))) + ")"
LABEL = "CASE WHEN " + BEST + " = 0 THEN 'other' " + " ".join(f"WHEN {INTENT(k)} = {BEST} THEN '{INTENTS[k][0]}'" for k in range(len(INTENTS))) + " END"

QUERIES = {
    "documents_by_language": (documents_by_language, "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1"),
    "document_facts": (document_facts, rf"SELECT doc_id, len({WORDS}) AS n_words, len(list_distinct({WORDS})) AS n_distinct, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(replace(text, chr(10), ' ')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS n_sentences, greatest(1, len(text) // 4) AS tokens FROM documents"),
    "content_hashes": (content_hashes, r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) || '||' || source) AS hash FROM documents"),
    "first_by_content": (first_by_content, "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text"),
    "allowed_documents": (allowed_documents, "SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3') GROUP BY 1, 2"),
    "denied_documents": (denied_documents, "SELECT doc_id FROM documents WHERE NOT coalesce(lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3'), false)"),
    "term_frequencies": (term_frequencies, f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({KEY}) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 20"),
    "bm25_search": (bm25_search, f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10"),
    "vector_search": (vector_search, f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({NEAREST}) QUALIFY rank <= 10"),
    "scoped_vector_match": (scoped_vector_match, f"SELECT * FROM ({NEAREST} AND e.label = q.label) WHERE score >= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 2"),
    "hybrid_search": (hybrid_search, f"WITH {BM25}, f AS (SELECT query_id, doc_id, CASE WHEN rank <= 20 THEN 1.0 / (60 + rank) ELSE 0.0 END + CASE WHEN rank2 <= 20 THEN 1.0 / (60 + rank2) ELSE 0.0 END AS score FROM ranked WHERE rank <= 20 OR rank2 <= 20) SELECT query_id, doc_id, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5"),
    "retrieval_measures": (retrieval_measures, f"WITH {BM25}, rel AS (SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), m AS (SELECT r.query_id, rank, rel.doc_id IS NOT NULL AS hit FROM ranked r LEFT JOIN rel USING (query_id, doc_id) WHERE rank <= 10), c AS (SELECT query_id, count(*) FILTER (hit AND rank <= 5) AS hits, count(*) FILTER (rank <= 5) AS top, coalesce(max(CASE WHEN hit THEN 1.0::DOUBLE / rank END), 0) AS rr, coalesce(sum(CASE WHEN hit AND rank <= 5 THEN 1 / log2(rank + 1) END), 0) AS gain FROM m GROUP BY 1), w AS (SELECT query_id, count(*) AS wanted FROM rel GROUP BY 1), b AS (SELECT c.*, coalesce(wanted, 0) AS wanted FROM c LEFT JOIN w USING (query_id)) SELECT query_id, round(CASE WHEN wanted = 0 THEN 1 ELSE hits / wanted END, 6) AS recall, round(hits / top, 6) AS precision, round(rr, 6) AS reciprocal_rank, round(CASE WHEN wanted = 0 THEN 1 ELSE gain / list_sum(list_transform(range(1, least(wanted, 5) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg FROM b"),
    "items_in_documents": (items_in_documents, "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
    "page_titles": (page_titles, "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages"),
    "page_text": (page_text, f"SELECT page_id, len(t) AS chars, md5(t) AS digest FROM (SELECT page_id, array_to_string({HTML}, chr(10)) AS t FROM pages)"),
    "pages_by_host": (pages_by_host, "SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1"),
    "repeated_lines": (repeated_lines, "SELECT doc_id, sum(len(line)) + count(line) - 1 AS chars FROM (SELECT doc_id, line, n, count(*) OVER (PARTITION BY doc_id, trim(line)) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)) WHERE trim(line) = '' OR len(trim(line)) > 70 OR k < 4 GROUP BY 1 UNION ALL SELECT doc_id, 0 FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR len(trim(x)) > 70 OR len(list_filter(string_split(text, chr(10)), lambda y: trim(y) = trim(x))) < 4)) = 0"),
    "chunks": (chunks, f"WITH w AS (SELECT doc_id, len({TOKENS}) AS n FROM documents), s AS (SELECT doc_id, n, unnest(CASE WHEN n = 0 THEN [] ELSE list_filter(range(0, greatest(0, n - 41) + 1, 140), lambda s: s = 0 OR n - s - 40 >= 12) END) AS s FROM w), c AS (SELECT doc_id, CASE WHEN s = max(s) OVER (PARTITION BY doc_id) THEN n - s ELSE 180 END AS k FROM s) SELECT doc_id, count(*) AS n_chunks, sum(k)::BIGINT AS words FROM c WHERE k >= 6 GROUP BY 1"),
    "section_lines": (section_lines, f"SELECT doc_id, n - 1 AS line_no, coalesce(last_value(CASE WHEN {HEADING} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"),
    "emails": (emails, r"SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS n FROM documents) WHERE n > 0"),
    "redactions": (redactions, REDACTED),
    "numbers_in_texts": (numbers_in_texts, r"SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '-?\d+(?:\.\d+)?')) AS n FROM documents) WHERE n > 0"),
    "similar_to_next": (similar_to_next, f"WITH w AS (SELECT doc_id, list_distinct({WORDS}) AS a FROM documents) SELECT x.doc_id, round(CASE WHEN len(list_distinct(x.a || y.a)) = 0 THEN 1.0 ELSE len(list_intersect(x.a, y.a)) / len(list_distinct(x.a || y.a)) END, 6) AS jaccard, round(CASE WHEN least(len(x.a), len(y.a)) = 0 THEN 0.0 ELSE len(list_intersect(x.a, y.a)) / least(len(x.a), len(y.a)) END, 6) AS containment FROM w x JOIN w y ON y.doc_id = x.doc_id + 1"),
    "content_diff": (content_diff, "WITH d AS (SELECT source, n_chars, max(md5(text)) AS h FROM documents GROUP BY 1, 2) SELECT coalesce(b.n_chars, a.n_chars) AS n_chars, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT * FROM d WHERE source = 'src0') b FULL JOIN (SELECT * FROM d WHERE source = 'src1') a ON a.n_chars = b.n_chars WHERE a.h IS DISTINCT FROM b.h"),
    "label_quality": (label_quality, "SELECT source, count(*) AS n, sum(toxic)::BIGINT AS toxic, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1"),
    "turn_counts": (turn_counts, "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS users, max(turn) AS last_turn FROM conversations GROUP BY 1"),
    "recent_turns": (recent_turns, "SELECT conv_id, turn, (u < 2 OR (u = 2 AND role = 'user')) AS is_recent FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM conversations)"),
    "message_intents": (message_intents, f"SELECT conv_id, turn, {LABEL} AS label, {BEST}::DOUBLE AS score FROM conversations WHERE role = 'user'"),
    "similarity_sweep": (similarity_sweep, f"WITH p AS (SELECT round({DOT}, 6) AS score, e.label = q.label AS same FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) SELECT threshold, count(*) FILTER (same) AS same, count(*) FILTER (NOT same) AS different FROM p, (SELECT unnest(range(11)) / 10.0::DOUBLE AS threshold) WHERE score >= threshold GROUP BY 1"),
    "tokens_by_role": (tokens_by_role, "SELECT role, count(*) AS n, sum(t)::BIGINT AS tokens, round(sum(t / 1e6 * CASE WHEN role = 'assistant' THEN 0.6::DOUBLE ELSE 0.15::DOUBLE END), 8) AS cost FROM (SELECT role, CASE WHEN len(text) = 0 THEN 0 ELSE greatest(1, len(text) // 4) END AS t FROM conversations) GROUP BY 1"),
    "review_decisions": (review_decisions, "SELECT source, CASE WHEN toxic = 1 THEN 'REJECT' WHEN coalesce(quality, 0) = 0 THEN 'NEEDS_REVIEW' ELSE 'AUTO_APPROVE' END AS decision, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"),
    "cache_keys": (cache_keys, r"SELECT substr(sha256(string_split(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))), ' ')[1] || '||' || role), 1, 32) AS key, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1"),
    "duplicate_tiers": (duplicate_tiers, "SELECT doc_id, CASE WHEN a < doc_id THEN 1 WHEN b < doc_id THEN 2 WHEN c < doc_id THEN 3 END AS tier FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, text) AS a, min(doc_id) OVER (PARTITION BY text) AS b, min(doc_id) OVER (PARTITION BY source, n_chars, substr(text, 1, 40)) AS c FROM documents) WHERE tier IS NOT NULL"),
    "supported_replies": (supported_replies, f"WITH c AS (SELECT conv_id, role, turn, unnest(list_distinct({WORDS})) AS w FROM conversations), a AS (SELECT DISTINCT conv_id, w FROM c WHERE role = 'user') SELECT c.conv_id, round(count(a.w) / count(*), 6) AS support FROM c LEFT JOIN a ON a.conv_id = c.conv_id AND a.w = c.w WHERE role = 'assistant' GROUP BY 1"),
    "conflicting_labels": (conflicting_labels, "SELECT source, lower(substr(text, 1, 3)) AS head, min(quality) AS low, max(quality) AS high, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2 HAVING min(quality) <> max(quality)"),
    "long_conversations": (long_conversations, "SELECT conv_id, count(*) AS users, len(arg_min(text, turn)) AS first_chars FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) >= 4"),
}
