"""Queries over questions and requests in plain words, changes to files, approvals, and evaluations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import requests as R
from ..functions import text as T
from ..operators import changes, evaluation, workflow
from ..operators import ledger as ledger_module
from ..session import table
from .stores import NOW, events
from .texts import STOP, documents

MOST, EXPIRY = 5, 3 * 86400.0
PROTECTED = ("tests/*", "*.lock")


def questions(spark, sf):
    """item_id, question: the first sentence of each item, some with another behind a joining phrase."""
    first = F.try_element_at(T.sentences(F.col("text")), F.lit(1))
    k = F.col("item_id")
    text = F.when(k % 4 == 1, F.concat(first, F.lit(" versus the others"))).when(k % 4 == 2, F.concat(F.lit("What is "), first, F.lit(" vs x"))).when(k % 4 == 3, F.concat(F.lit("How are "), first)).otherwise(first)
    return table(spark, sf, "benchmark").select(k, text.alias("question"))


def question_plans(spark, sf):
    plan = R.planned(F.col("question"), MOST, STOP)
    return questions(spark, sf).select("item_id", F.size(R.parts(F.col("question"))).cast("long").alias("n_parts"), F.md5(R.topic(F.col("question"), STOP)).alias("topic"), F.size(plan).cast("long").alias("n_steps"), F.md5(F.array_join(plan, "|")).alias("steps"))


def solved_questions(spark, sf):
    """Sums told in words, made from lines of orders, and answered by their words alone."""
    n, q, p = (F.col(c).cast("long").cast("string") for c in ("l_linenumber", "l_quantity", "l_partkey"))
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    kind = F.col("l_partkey") % 5
    prompt = F.when(kind == 0, say("A shop sells ", q, " packs at ", p, " pence each. How much is that in total?")).when(kind == 1, say(q, " boxes hold ", p, " pens each; she gives away ", n, ". How many are there altogether?")).when(kind == 2, say("Of ", p, " people ", q, " went home. How many are left?")).when(kind == 3, say("Add ", q, ", ", p, " and ", n, ".")).otherwise(say("It is ", q, " o'clock."))
    answered = table(spark, sf, "lineitem").select(kind.alias("kind"), R.solved(prompt).alias("answer"))
    return answered.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("answer").alias("answered"), F.sum("answer").alias("total"))


def letters(c):
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


def intake_requests(spark, sf):
    """Requests for new colleagues, made from customers, and what they name."""
    k, name = F.col("c_custkey"), F.concat(F.lit("Na"), letters(F.col("c_custkey")))
    low, text = F.lower(name), F.col("c_custkey").cast("string")
    said = (
        F.when(k % 4 == 0, F.concat(F.lit("Hiring Ann "), name, F.lit(" as a backend engineer, salary 45,000 from 2024-05-01. Laptop and desk please.")))
        .when(k % 4 == 1, F.concat(F.lit("Welcome to ann."), low, F.lit("@example.com in sales at £"), text, F.lit("00.50, with a phone")))
        .when(k % 4 == 2, F.concat(F.lit("We add "), name, F.lit(" to payroll: Salary is 61,500. Start on 2024-06-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))
        .otherwise(F.concat(F.lit("New monitor and headset for our service desk, the Old "), name, F.lit(" Team, worth 12,345 or so")))
    )
    found = table(spark, sf, "customer").select("c_custkey", R.intake(said).alias("f"))
    return found.select("c_custkey", "f.full_name", "f.email", "f.department", "f.start_date", "f.salary", F.array_join("f.equipment", ",").alias("equipment"), F.array_join("f.missing", ",").alias("missing"))


def approval_outcomes(spark, sf):
    """Errors ask for approval, purchases grant what their owner asked for by then, sign-ups refuse it; the rest expires or waits."""
    return approvals(spark, sf).select("event_id", "user_id", "state", F.round("waited", 3).alias("waited"))


def approvals(spark, sf):
    now = datetime.datetime.fromisoformat(NOW).replace(tzinfo=datetime.UTC).timestamp()
    return workflow.approvals(events(spark, sf), "user_id", "ts", "event_id", "event_type", "error", {"purchase": "approved", "signup": "rejected"}, EXPIRY, now)


def resumed_runs(spark, sf):
    """Where runs stand once their questions are answered: they go on, end, or wait."""
    return workflow.resumed(approvals(spark, sf), "user_id")


def file_edits(spark, sf):
    """Edits of documents as files: a line that is quoted once is changed, others can't be told apart or aren't there; a second edit sees what the first left."""
    k, first = F.col("doc_id"), F.substring_index("text", "\n", 1)
    files = documents(spark, sf).select(k.cast("string").alias("path"), "text")
    quoted = F.when(k % 4 == 0, first).when(k % 4 == 1, F.substring(first, 1, 3)).when(k % 4 == 2, F.lit("not there at all")).otherwise(F.lit(""))
    one = documents(spark, sf).select(k.cast("string").alias("path"), F.lit(1).alias("place"), quoted.alias("old_text"), F.concat(F.lit("<"), quoted, F.lit(">")).alias("new_text"))
    two = documents(spark, sf).filter(k % 3 == 0).select(k.cast("string").alias("path"), F.lit(2).alias("place"), F.concat(F.lit("<"), first, F.lit(">")).alias("old_text"), F.lit("second").alias("new_text"))
    out = changes.apply_edits(files, one.unionByName(two))
    return out.select(F.col("path").cast("long").alias("doc_id"), F.array_join("statuses", ",").alias("statuses"), F.md5("text").alias("digest"))


def change_reviews(spark, sf):
    """Documents of two sources as a project before and after, held against a third as its tests: what changed, and what speaks against it."""
    d = documents(spark, sf).filter("source in ('src0', 'src1', 'src2')").select("source", (F.col("doc_id") % 200).alias("slot"), "doc_id", "text")
    path = F.concat(F.when(F.col("slot") % 10 == 0, "tests/").when(F.col("slot") % 10 == 1, "locks/").otherwise("lib/"), F.col("slot").cast("string"), F.when(F.col("slot") % 10 == 1, ".lock").otherwise(".py"))
    of = lambda s: d.filter(F.col("source") == s).groupBy(path.alias("path")).agg(F.min_by("text", "doc_id").alias("text"))
    shortcut = F.when(F.length("text") % 3 == 0, F.concat("text", F.lit("\n  except:\n    pass"))).otherwise(F.col("text"))
    out = changes.judged_changes(of("src0"), of("src1").withColumn("text", shortcut), of("src2"), PROTECTED)
    return out.select("path", "change", "forbidden", F.size("copied").cast("long").alias("copied"), F.size("shortcuts").cast("long").alias("shortcuts"))


def conversation_cases(spark, sf):
    """Conversations as cases: who spoke, how many turns there were, and words of the first message."""
    c = table(spark, sf, "conversations")
    case = F.col("conv_id").alias("case")
    roles = c.select(case, F.lit("roles").alias("field"), F.col("role").alias("value"))
    turns = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("string").alias("value")).select(case, F.lit("turns").alias("field"), "value")
    words = c.filter("role = 'user'").select(case, F.lit("words").alias("field"), F.explode(T.words(F.col("text"))).alias("value"))
    k = F.col("conv_id")
    ask = lambda field, kind, wanted, bound=None: F.struct(F.lit(field).alias("field"), kind.alias("kind"), F.array(*map(F.lit, wanted)).cast("array<string>").alias("wanted"), F.lit(bound).cast("double").alias("bound"))
    asks = F.array(
        ask("roles", F.when(k % 3 == 0, "equals").otherwise("all_of"), ("user", "assistant")), ask("roles", F.when(k % 7 == 0, "nothing").otherwise("none_of"), ("system",)),
        ask("turns", F.when(k % 2 == 0, "at_least").otherwise("at_most"), (), 6.0), ask("words", F.lit("recall"), ("the", "of", "die", "que"), 0.5))
    wanted = c.select("conv_id").distinct().select(case, F.explode(asks).alias("x")).select("case", "x.*")
    return wanted, roles.unionByName(turns).unionByName(words), c.select(case, (F.col("conv_id") % 5).alias("suite"))


def scenario_checks(spark, sf):
    wanted, outcomes, _ = conversation_cases(spark, sf)
    out = evaluation.checked(wanted, outcomes)
    return out.select(F.col("case").alias("conv_id"), "field", "kind", "passed", F.array_join("missing", ",").alias("missing"), F.array_join("unwanted", ",").alias("unwanted"))


def scenario_rates(spark, sf):
    wanted, outcomes, cases = conversation_cases(spark, sf)
    return evaluation.rated(evaluation.checked(wanted, outcomes), cases)


def ledger(spark, sf):
    """A log of the first fortnight's events, one for each owner, type and day, and later events that are submitted to it, some again."""
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "dd"))
    rows = events(spark, sf).select(key.alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("entry_id"), (F.floor("value") % 3).cast("string").alias("digest"), (F.dayofmonth("ts") <= 14).alias("old"))
    first = rows.filter("old").groupBy("key").agg(F.min(F.struct("at", "entry_id", "digest")).alias("x"))
    log = first.select("key", F.col("x.digest").alias("digest"), (F.col("x.entry_id") + 1).alias("entry_no"))
    submitted = rows.filter("not old or entry_id % 7 = 0").withColumn("key", F.when(F.col("entry_id") % 50 != 0, F.col("key")))
    return log, submitted.drop("old")


def ledger_appends(spark, sf):
    """What becomes of entries that are submitted to a log: appended with the next number, repeated, or refused."""
    return ledger_module.appended(*ledger(spark, sf)).select("entry_id", "outcome", "entry_no")


def uncompensated_effects(spark, sf):
    """Purchases of each owner as effects, undone where an error of the same hour says so: what is left to undo, the last one first."""
    e = events(spark, sf).select(F.col("user_id").alias("run"), "event_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    effects = e.filter("event_type = 'purchase'").select("run", F.col("event_id").alias("effect_no"), F.lit("purchase").alias("kind"), "hour")
    marks = effects.join(e.filter("event_type = 'error'").select("run", "hour"), ["run", "hour"]).select("run", "effect_no")
    return ledger_module.outstanding(effects, marks).select(F.col("run").alias("user_id"), "effects", "compensated", "left", F.col("next").alias("next_effect"))


def answers_given(spark, sf):
    """case, text; expectations; citations: each conversation's last reply as an answer to its first question, cut short or declined by key."""
    c = table(spark, sf, "conversations")
    k = F.col("conv_id")
    reply = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    text = F.when(k % 6 == 0, "Sorry, I do not know that.").when(k % 6 == 1, "  ").otherwise(F.col("text"))
    asked = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    word = lambda n: F.coalesce(F.try_element_at(T.words(F.col("q")), F.lit(n)), F.lit("none"))
    expected = asked.select(
        k.alias("case"), F.array(F.concat_ws("|", word(1), word(2)), word(3)).alias("must_contain"), (k % 4 == 0).alias("should_abstain"),
        F.array(F.concat(F.lit("s"), (k % 3).cast("string")), F.lit("s1")).alias("relevant"), F.array(F.lit("s2")).alias("forbidden"))
    cited = c.filter("role = 'assistant'").select(k.alias("case"), F.concat(F.lit("s"), (F.col("turn") % 4).cast("string")).alias("source"))
    return reply.select(k.alias("case"), text.alias("text")), expected, cited


def judged_answers(spark, sf):
    """Which answers are right, which decline, and what they cite."""
    out = evaluation.answers_judged(*answers_given(spark, sf), declines=R.declines)
    return out.select(F.col("case").alias("conv_id"), "correct", F.size("missing").cast("long").alias("missing"), "abstained", "precision", F.col("leaked").cast("long").alias("leaked"))


FIRST = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(replace(text, chr(10), ' ')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1]"
KEPT = "list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda w: len(w) >= 2 AND w NOT IN ('" + "', '".join((*STOP, *R.FRAMING)) + "'))"
PLANS = f"""
WITH b AS (SELECT item_id, item_id % 4 AS n, {FIRST} AS f FROM benchmark),
q AS (SELECT item_id, n, f, CASE n WHEN 1 THEN f || ' versus the others' WHEN 2 THEN 'What is ' || f || ' vs x' WHEN 3 THEN 'How are ' || f ELSE f END AS q FROM b),
t AS (SELECT item_id, CASE WHEN len({KEPT}) > 0 THEN array_to_string({KEPT}, ' ') ELSE trim(q) END AS topic, CASE WHEN n = 1 AND len(trim(f)) > 3 THEN [trim(f), 'the others'] ELSE [] END AS parts FROM q),
s AS (SELECT *, list_concat(list_transform(parts, lambda p: 'evidence and measured results for ' || p), [{", ".join("'" + a.replace("{topic}", "' || topic || '") + "'" for a in R.ANGLES)}])[1:{MOST}] AS steps FROM t)
SELECT item_id, len(parts) AS n_parts, md5(topic) AS topic, len(steps) AS n_steps, md5(array_to_string(steps, '|')) AS steps FROM s"""
NAMED = "'Na' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij')"
INTAKE = f"""
WITH c AS (SELECT c_custkey, c_custkey % 4 AS n, {NAMED} AS who, c_custkey::VARCHAR AS k FROM customer),
f AS (SELECT c_custkey, CASE n WHEN 0 THEN 'Ann ' || who WHEN 1 THEN 'Ann ' || upper(who[1]) || lower(who[2:]) WHEN 3 THEN 'Old ' || who || ' Team' END AS full_name, CASE WHEN n = 1 THEN 'ann.' || lower(who) || '@example.com' END AS email,
  ['engineering', 'sales', 'finance', 'support'][n + 1] AS department, CASE n WHEN 0 THEN '2024-05-01' WHEN 2 THEN '2024-06-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') END AS start_date,
  CASE n WHEN 0 THEN 45000 WHEN 1 THEN c_custkey * 100 + 0.5 WHEN 2 THEN 61500 ELSE 12345 END::DOUBLE AS salary, ['laptop,desk', 'phone', '', 'monitor,desk,headset'][n + 1] AS equipment FROM c)
SELECT *, array_to_string(list_filter([CASE WHEN full_name IS NULL THEN 'full_name' END, CASE WHEN email IS NULL THEN 'email' END, CASE WHEN start_date IS NULL THEN 'start_date' END], lambda x: x IS NOT NULL), ',') AS missing FROM f"""
ASKED = f"""
a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
n AS (SELECT a.event_id, arg_min(CASE d.event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END, (d.ts, d.event_id)) AS state, (min(epoch_us(d.ts)) - min(epoch_us(a.ts))) / 1e6::DOUBLE AS waited FROM a JOIN events d ON d.user_id = a.user_id AND d.event_type IN ('purchase', 'signup') AND (d.ts, d.event_id) > (a.ts, a.event_id) GROUP BY 1),
asked AS (SELECT a.event_id, a.user_id, CASE WHEN waited <= {EXPIRY} THEN n.state WHEN epoch_us(a.ts) / 1e6::DOUBLE + {EXPIRY} < epoch_us(TIMESTAMP '{NOW}') / 1e6::DOUBLE THEN 'expired' ELSE 'pending' END AS state, CASE WHEN waited <= {EXPIRY} THEN round(waited, 3) END AS waited FROM a LEFT JOIN n USING (event_id))"""
COUNT = "(len({t}) - len(replace({t}, {p}, ''))) // len({p})"
EDITS = f"""
WITH d AS (SELECT doc_id, doc_id % 4 AS n, text, string_split(text, chr(10))[1] AS f FROM documents),
q AS (SELECT *, CASE n WHEN 0 THEN f WHEN 1 THEN left(f, 3) WHEN 2 THEN 'not there at all' ELSE '' END AS old FROM d),
s AS (SELECT *, CASE WHEN old = '' THEN 'invalid' WHEN {COUNT.format(t='text', p='old')} = 0 THEN 'not_found' WHEN {COUNT.format(t='text', p='old')} > 1 THEN 'ambiguous' ELSE 'applied' END AS one FROM q),
u AS (SELECT doc_id, one, '<' || f || '>' AS g, CASE WHEN one = 'applied' THEN replace(text, old, '<' || old || '>') ELSE text END AS t FROM s),
v AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN CASE {COUNT.format(t='t', p='g')} WHEN 0 THEN 'not_found' WHEN 1 THEN 'applied' ELSE 'ambiguous' END END AS two FROM u)
SELECT doc_id, one || coalesce(',' || two, '') AS statuses, md5(CASE WHEN two = 'applied' THEN replace(t, g, 'second') ELSE t END) AS digest FROM v"""
OF = "SELECT slot, arg_min(text, doc_id) AS t FROM (SELECT *, doc_id % 200 AS slot FROM documents) WHERE source = '{s}' GROUP BY 1"
REVIEWS = f"""
WITH o AS ({OF.format(s='src0')}), n0 AS ({OF.format(s='src1')}), n AS (SELECT slot, t || CASE WHEN len(t) % 3 = 0 THEN chr(10) || '  except:' || chr(10) || '    pass' ELSE '' END AS t FROM n0), x AS ({OF.format(s='src2')}),
j AS (SELECT coalesce(o.slot, n.slot) AS slot, coalesce(o.t, '') AS was, coalesce(n.t, '') AS now, CASE WHEN o.t IS NULL THEN 'added' WHEN n.t IS NULL THEN 'removed' WHEN o.t <> n.t THEN 'modified' END AS change FROM o FULL JOIN n ON o.slot = n.slot)
SELECT CASE slot % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'locks/' ELSE 'lib/' END || slot || CASE WHEN slot % 10 = 1 THEN '.lock' ELSE '.py' END AS path, change, slot % 10 < 2 AS forbidden,
  len(list_filter(list_distinct(regexp_extract_all(now, '\\b\\d+(?:\\.\\d+)?\\b')), lambda d: NOT contains(was, d) AND contains(coalesce(x.t, ''), d))) AS copied,
  (len(regexp_extract_all(now, '(?m)^\\s*except\\s*:')) > len(regexp_extract_all(was, '(?m)^\\s*except\\s*:')))::BIGINT AS shortcuts
FROM j LEFT JOIN x USING (slot) WHERE change IS NOT NULL"""
CHECKS = """
r AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS roles, count(*) AS turns FROM conversations GROUP BY 1),
w AS (SELECT conv_id, count(DISTINCT w) AS hits FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations WHERE role = 'user') WHERE w IN ('the', 'of', 'die', 'que') GROUP BY 1),
m AS (SELECT conv_id, list_sort(list(x)) AS missing FROM (SELECT r.conv_id, v.x FROM r, (VALUES ('the'), ('of'), ('die'), ('que')) v(x) WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = r.conv_id AND role = 'user' AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), v.x))) GROUP BY 1),
checks AS (
  SELECT conv_id, 'roles' AS field, CASE WHEN conv_id % 3 = 0 THEN 'equals' ELSE 'all_of' END AS kind, CASE WHEN conv_id % 3 = 0 THEN roles = ['assistant', 'user'] ELSE list_has_all(roles, ['assistant', 'user']) END AS passed, array_to_string(list_filter(['assistant', 'user'], lambda x: NOT list_contains(roles, x)), ',') AS missing, '' AS unwanted FROM r
  UNION ALL SELECT conv_id, 'roles', CASE WHEN conv_id % 7 = 0 THEN 'nothing' ELSE 'none_of' END, CASE WHEN conv_id % 7 = 0 THEN false ELSE NOT list_contains(roles, 'system') END, '', CASE WHEN conv_id % 7 <> 0 AND list_contains(roles, 'system') THEN 'system' ELSE '' END FROM r
  UNION ALL SELECT conv_id, 'turns', CASE WHEN conv_id % 2 = 0 THEN 'at_least' ELSE 'at_most' END, CASE WHEN conv_id % 2 = 0 THEN turns >= 6 ELSE turns <= 6 END, '', '' FROM r
  UNION ALL SELECT conv_id, 'words', 'recall', coalesce(hits, 0) >= 2, coalesce(array_to_string(missing, ','), ''), '' FROM r LEFT JOIN w USING (conv_id) LEFT JOIN m USING (conv_id))"""
LEDGER = """
WITH e AS (SELECT user_id || '/' || event_type || '/' || strftime(ts, '%d') AS key, epoch_us(ts) AS t, event_id, (floor(value)::BIGINT % 3)::VARCHAR AS digest, day(ts) <= 14 AS old FROM events),
log AS (SELECT key, digest, event_id + 1 AS entry_no FROM e WHERE old QUALIFY row_number() OVER (PARTITION BY key ORDER BY t, event_id) = 1),
s AS (SELECT CASE WHEN event_id % 50 <> 0 THEN key END AS key, t, event_id, digest FROM e WHERE NOT old OR event_id % 7 = 0),
f AS (SELECT key, event_id, digest, (SELECT max(entry_no) FROM log) + row_number() OVER (ORDER BY t, event_id) AS entry_no FROM (SELECT * FROM s WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM log) QUALIFY row_number() OVER (PARTITION BY key ORDER BY t, event_id) = 1)),
j AS (SELECT s.event_id, CASE WHEN s.key IS NULL THEN 'conflict' WHEN log.key IS NULL AND f.event_id = s.event_id THEN 'appended' WHEN coalesce(log.digest, f.digest) = s.digest THEN 'repeated' ELSE 'conflict' END AS outcome, coalesce(log.entry_no, f.entry_no) AS entry_no FROM s LEFT JOIN log ON log.key = s.key LEFT JOIN f ON f.key = s.key)
SELECT event_id AS entry_id, outcome, CASE WHEN outcome <> 'conflict' THEN entry_no END AS entry_no FROM j"""
UNDONE = """
WITH p AS (SELECT user_id, event_id, EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND date_trunc('hour', x.ts) = date_trunc('hour', e.ts)) AS done FROM events e WHERE event_type = 'purchase')
SELECT user_id, count(*) AS effects, count(*) FILTER (done) AS compensated, count(*) FILTER (NOT done) AS "left", max(event_id) FILTER (NOT done) AS next_effect FROM p GROUP BY 1"""
JUDGED = """
WITH w AS (SELECT conv_id, regexp_extract_all(lower(arg_min(text, turn)), '[a-z0-9]+') AS w FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT conv_id, arg_max(text, turn) AS t, list('s' || turn % 4) AS src FROM conversations WHERE role = 'assistant' GROUP BY 1),
a AS (SELECT w.conv_id, [coalesce(w[1], 'none'), coalesce(w[2], 'none'), coalesce(w[3], 'none')] AS w, coalesce(CASE w.conv_id % 6 WHEN 0 THEN CASE WHEN t IS NOT NULL THEN 'Sorry, I do not know that.' END WHEN 1 THEN '' ELSE t END, '') AS t, coalesce(src, []) AS src FROM w LEFT JOIN r USING (conv_id)),
m AS (SELECT *, trim(t) = '' OR contains(t, 'I do not know that') AS silent, CASE WHEN conv_id % 4 = 0 THEN 0 ELSE (NOT (contains(lower(t), w[1]) OR contains(lower(t), w[2])))::INT + (NOT contains(lower(t), w[3]))::INT END AS missing FROM a)
SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN silent ELSE NOT silent AND missing = 0 END AS correct, missing, silent AS abstained, round(CASE WHEN len(src) = 0 THEN 0 ELSE len(list_filter(src, lambda x: x IN ('s' || conv_id % 3, 's1'))) / len(src) END, 4) AS precision, CASE WHEN list_contains(src, 's2') THEN 1 ELSE 0 END AS leaked FROM m"""

QUERIES = {
    "ledger_appends": (ledger_appends, LEDGER),
    "uncompensated_effects": (uncompensated_effects, UNDONE),
    "judged_answers": (judged_answers, JUDGED),
    "question_plans": (question_plans, PLANS),
    "solved_questions": (solved_questions, "SELECT kind, count(*) AS n, count(a) AS answered, sum(a)::BIGINT AS total FROM (SELECT l_partkey % 5 AS kind, CASE l_partkey % 5 WHEN 0 THEN l_quantity * l_partkey WHEN 1 THEN l_quantity * l_partkey - l_linenumber WHEN 2 THEN l_partkey - l_quantity WHEN 3 THEN l_quantity + l_partkey + l_linenumber END AS a FROM lineitem) GROUP BY 1"),
    "intake_requests": (intake_requests, INTAKE),
    "approval_outcomes": (approval_outcomes, f"WITH {ASKED} SELECT * FROM asked"),
    "resumed_runs": (resumed_runs, f"WITH {ASKED} SELECT user_id, CASE WHEN bool_or(state = 'rejected') THEN 'cancelled' WHEN bool_or(state = 'expired') THEN 'failed' WHEN bool_or(state = 'pending') THEN 'waiting' ELSE 'running' END AS state, count(*) FILTER (state IN ('approved', 'rejected')) AS answered, count(*) FILTER (state = 'pending') AS open FROM asked GROUP BY 1"),
    "file_edits": (file_edits, EDITS),
    "change_reviews": (change_reviews, REVIEWS),
    "scenario_checks": (scenario_checks, f"WITH {CHECKS} SELECT * FROM checks"),
    "scenario_rates": (scenario_rates, f"WITH {CHECKS}, c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (passed) AS ok FROM checks GROUP BY 1) SELECT conv_id % 5 AS suite, count(*) AS cases, count(*) FILTER (n = ok) AS whole, sum(n)::BIGINT AS checks, sum(ok)::BIGINT AS passed, round(sum(ok) / sum(n), 4) AS rate FROM c GROUP BY 1"),
}
