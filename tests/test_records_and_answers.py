"""Ordered folds, leases, evidence, vectors, lines and tables as wholes against plain loops on small cases."""

from __future__ import annotations

import collections
import datetime
import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import catalog, conversations, evidence, lines, retrieval, stretches, vector_index
from millrace.storage import scratch
from millrace.streaming import leases

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


# Ordered folds


def ordered_rows(seed, n):
    """Half of all rows have one key."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "a", "b", "c", "hot", None, "hot"]), rng.randrange(40), k, rng.choice([None, 1, 2, 5]), rng.choice([None, "x", "y", "z"]), rng.random() < 0.6) for k in range(n)]


def test_sums_and_last_values_before_each_row(spark):
    rows = ordered_rows(1, 500)
    data = spark.createDataFrame(rows, "key string, at long, id long, v long, s string, ok boolean")
    cut = stretches.in_stretches(data, "key", ["at", "id"], scratch(spark, "test"))
    assert cut.filter("key = 'hot'").select("stretch").distinct().count() > 1
    out = stretches.before(cut, "key", ["at", "id"], sums={"total": F.col("v")}, lasts={"last": F.col("s"), "seen": F.when(F.col("ok"), F.struct("id", "s"))})
    got = {r["id"]: (r["total"], r["last"], r["seen"] and tuple(r["seen"])) for r in out.collect()}
    total, last, seen = {}, {}, {}
    for key, _, i, v, s, ok in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        assert got[i] == (total.get(key), last.get(key), seen.get(key)), i
        total[key] = v if total.get(key) is None else total[key] + (v or 0)
        last[key] = s or last.get(key)
        seen[key] = (i, s) if ok else seen.get(key)


def test_folds_both_ways_keep_all_columns(spark):
    """Keys of several columns, null ones too, and the order turned around."""
    rows = [(k, a, b, at, v, f"r{k}") for k, (a, at, _, v, b, _) in enumerate(ordered_rows(4, 300))]
    data = spark.createDataFrame(rows, "id long, a string, b string, at long, v long, _keys string")
    ahead = stretches.folded(data, ["a", "b"], ["at", "id"], sums={"n": F.lit(1)}, lasts={"last": F.struct("_row.id")})
    back = stretches.folded(data, ["a", "b"], ["-at", "-id"], sums={"n": F.lit(1), "total": F.col("_row.v")}, lasts={"next": F.col("_row.id")})
    groups = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        groups[r[1], r[2]].append(r)
    for r in ahead.collect():
        group = groups[r["a"], r["b"]]
        at = next(k for k, x in enumerate(group) if x[0] == r["id"])
        assert (r["n"] or 0, r["last"] and r["last"]["id"]) == (at, group[at - 1][0] if at else None) and r["_keys"] == f"r{r['id']}"
    for r in back.collect():
        group = groups[r["a"], r["b"]]
        at = next(k for k, x in enumerate(group) if x[0] == r["id"])
        later = [x[4] for x in group[at + 1 :] if x[4] is not None]
        assert (r["n"] or 0, r["next"], r["total"]) == (len(group) - at - 1, group[at + 1][0] if at + 1 < len(group) else None, sum(later) if later else None)


def test_last_different_against_a_loop(spark):
    rows = ordered_rows(2, 600)
    data = spark.createDataFrame(rows, "key string, at long, id long, v long, s string, ok boolean")
    out = stretches.last_different(data, "key", ["at", "id"], "s", F.col("ok"), scratch(spark, "test"))
    got = {r["id"]: (r["expected"]["s"], r["expected"]["id"], r["since_last"]) for r in out.collect()}
    want, past = {}, collections.defaultdict(list)
    for key, _, i, _, s, ok in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key is None or s is None:
            continue
        others = [x for x in past[key] if x[0] != s]
        if others:
            want[i] = (*others[-1], past[key][-1][0] != s)
        if ok:
            past[key].append((s, i))
    assert got == want and len({w[2] for w in want.values()}) == 2


def test_folds_of_empty_tables(spark):
    data = spark.createDataFrame([], "key string, at long, id long, s string")
    assert stretches.last_different(data, "key", ["at", "id"], "s", F.lit(True), scratch(spark, "test")).collect() == []


# Evidence


def plain_similarity(a, b):
    if not a and not b:
        return 1.0
    both = len(a & b)
    return round(max(both / len(a | b), 0.85 * both / min(len(a), len(b)) if a and b else 0.0), 4)


def plain_agree(x, y):
    near = lambda p, q: p == q or abs(p - q) <= 0.12 * max(abs(p), abs(q))
    return not x or not y or all(any(near(p, q) for q in y) for p in x)


def test_deduplicated_evidence_against_a_loop(spark):
    rng = random.Random(3)
    base = [" ".join(rng.sample(WORDS, rng.randrange(2, 8))) for _ in range(25)]
    items = []
    for k in range(220):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        claim = rng.choice([" ".join(words), " ".join(words) + f" {rng.choice([10, 11, 50])}", None if k % 40 == 0 else "", rng.choice(base)])
        items.append((k, claim, round(rng.random(), 2), rng.choice(["s1", "S1 ", "s2", "s3"]), rng.random() < 0.7))
    data = spark.createDataFrame(items, "id long, claim string, score double, source string, primary boolean")
    got = {r["id"]: (r["duplicate_of"], r["corroborated_by"], r["score"]) for r in evidence.deduplicated(data).collect()}
    # Numbers are words too: they are terms of the claim.
    root = {r["w"]: r["r"] for r in spark.createDataFrame([(w,) for w in [*WORDS, "10", "11", "50"]], "w string").select("w", evidence.C.root(F.col("w")).alias("r")).collect()}
    facts = {i: ({root[w] for w in (c or "").split() if len(w) >= 2}, [float(x) for x in re.findall(r"\d+", c or "")]) for i, c, *_ in items}
    kept, of, count, score = [], {}, collections.Counter(), {i: s for i, _, s, _, _ in items}
    by = {i: x for i, *x in items}
    for i, *_ in sorted(items, key=lambda x: (-x[2], x[0])):
        match = next((e for e in kept if plain_similarity(facts[i][0], facts[e][0]) >= 0.6 and plain_agree(facts[i][1], facts[e][1])), None)
        if match is None:
            kept.append(i)
            continue
        of[i] = match
        count[match] += 1
        if by[i][3] and by[match][3] and by[i][2].strip().lower() != by[match][2].strip().lower():
            score[match] = round(min(1.0, score[match] + min(0.16, 0.08 * count[match])), 4)
    assert {i: g[:2] for i, g in got.items()} == {i: (of.get(i), count[i]) for i in score}
    assert all(abs(got[i][2] - score[i]) < 1e-6 for i in score)
    assert len(kept) < len(items) and any(len(of) and o in of.values() for o in kept)


def test_claims_of_frequent_words_meet_by_pairs_of_these(spark):
    rng = random.Random(8)
    names = [f"w{k}" for k in range(60)]
    sets = [tuple(rng.sample(names, rng.choice([1, 2, 3, 4, 5, 6, 8, 8, 8]))) for _ in range(400)]
    sets += [tuple(f"x{k}" for k in range(90)), tuple(f"x{k}" for k in range(70)), ("x1", "x2", "x3"), (*(f"x{k}" for k in range(80)), "w1")]
    items = spark.createDataFrame([(k, list(t), []) for k, t in enumerate(sets)], "rank long, terms array<string>, numbers array<double>")
    path = scratch(spark, "test")
    got = {(r["later"], r["earlier"]): r["similarity"] for r in evidence.alike_claims(items, f"{path}/a", 0.6).collect()}
    all_ = {(i, j): plain_similarity(set(sets[i]), set(sets[j])) for i in range(len(sets)) for j in range(i)}
    assert got == {p: x for p, x in all_.items() if x >= 0.6} and len(got) > 100
    # By one word alone, nearly every item of eight meets every other.
    ordered = evidence.rarest_first(items.filter("size(terms) between 6 and 8"), f"{path}/o")
    met = [ordered.select("rank", F.explode(evidence.keys(small, F.ceil(F.col("n") * 0.7).cast("int"))).alias("key")) for small in (True, False)]
    pairs = met[0].join(met[1].withColumnRenamed("rank", "other"), "key").filter("rank <> other").select("rank", "other").distinct().count()
    n = ordered.count()
    assert pairs < n * n / 4


def test_a_chain_is_settled_as_one_by_one(spark):
    pairs = spark.createDataFrame([(k + 1, k) for k in range(9)], "later long, earlier long")
    gone, rounds = evidence.settled(pairs, scratch(spark, "test"))
    assert {r["rank"] for r in gone.collect()} == {1, 3, 5, 7, 9} and rounds == 5
    gone, rounds = evidence.settled(pairs.limit(0), scratch(spark, "test"))
    assert gone.count() == 0 and rounds == 0


def test_best_sentences_prefer_findings(spark):
    text = "Alpha beta gamma delta here now. Unrelated words stand here alone today. Alpha beta rose to 12 percent for gamma now. Short alpha."
    rows = spark.createDataFrame([(1, 7, ["alpha", "beta", "gamma", "delta"], text), (2, 7, ["alpha"], ""), (3, 7, ["alpha"], None)], "query_id long, id long, question array<string>, text string")
    got = [(r["query_id"], r["n"], r["rank"]) for r in evidence.best_sentences(rows, ("the",), ("percent",)).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 1), (1, 0, 2)]


def test_least_window_against_all_windows(spark):
    rng = random.Random(4)
    cases = []
    for _ in range(60):
        n = rng.randrange(1, 5)
        text = [rng.randrange(7) for _ in range(rng.randrange(1, 40))]
        cases.append((n, [(k, t) for k, t in enumerate(text) if t < n]))
    data = spark.createDataFrame([(k, n, o) for k, (n, o) in enumerate(cases)], "k int, n int, o array<struct<at:int,term:int>>")
    got = {r["k"]: r["w"] for r in data.select("k", T.least_window(F.col("o"), F.col("n")).alias("w")).collect()}
    for k, (n, o) in enumerate(cases):
        spans = [b - a + 1 for a, _ in o for b, _ in o if a <= b and {t for at, t in o if a <= at <= b} == set(range(n))]
        assert got[k] == min(spans, default=None)


def test_quotes_against_a_search(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 60))).replace(" ", rng.choice([" ", "\n", "  "]), 5) for _ in range(80)] + [None, "", "eta theta"]
    quotes = [t[a : a + rng.randrange(1, 60)] for t in texts if t for a in [rng.randrange(len(t))]] + [None, "a", "missing words are not there at all", " ", "eta theta"]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(quotes)), "id long, text string")
    got = {tuple(r) for r in retrieval.quoting(docs, "doc_id", "text", items).select("doc_id", "quote_id").collect()}
    assert got == {(k // 2, n) for k, t in enumerate(texts) if t is not None for n, q in enumerate(quotes) if q is not None and q in t}


def test_quotes_take_time_by_length(spark):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7")], "id long, text string")
    took = []
    for n in (16_000, 64_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(n)))], "doc_id long, text string")
        retrieval.quoting(docs, "doc_id", "text", items).count()
        began = time.time()
        assert retrieval.quoting(docs, "doc_id", "text", items).count() == 1
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 2, took


# Vectors


def test_live_matches_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    entries = [(k, unit(rng.standard_normal(16)), f"s{k % 3}", float(k)) for k in range(900)] + [(900, None, "s0", 5.0), (901, [], "s0", 5.0), (902, [1.0, 0.0], "s1", 880.0)]
    requests = [(k, unit(np.array(entries[j][1]) + 0.25 * rng.standard_normal(16) / 4), entries[j][2], float(j + rng.integers(1, 150))) for k, j in enumerate(rng.integers(0, 900, 400).tolist())]
    requests += [(400, None, "s0", 9.0), (401, [1.0, 0.0], "s1", 890.0)]
    schema = "id long, vector array<double>, scope string, at double"
    got = {r["request_id"]: (r["id"], r["score"]) for r in vector_index.live_matches(spark.createDataFrame(entries, schema), spark.createDataFrame(requests, schema), 100.0, 0.9).collect()}
    want = {}
    for i, v, scope, at in requests:
        near = [(-round(float(np.dot(v, w)), 4), t, j) for j, w, s, t in entries if v and w and len(v) == len(w) and s == scope and t < at < t + 100.0]
        if near and -min(near)[0] >= 0.9:
            want[i] = (min(near)[2], -min(near)[0])
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and len(want) > 200
    assert sum(got[i] == want[i] for i in got) >= 0.99 * len(got)


def test_tables_follow_from_recall():
    for rows, least, recall in ((1000, 0.9, 0.99), (10**6, 0.8, 0.95), (10**12, 0.95, 0.999), (0, 0.9, 0.9)):
        bits, tables = vector_index.tables_for(rows, least, recall)
        assert 1 - (1 - (1 - math.acos(least) / math.pi) ** bits) ** tables >= recall and bits <= vector_index.MOST_BITS


# Leases


def plain_leases(rows, lease):
    steps, out = {}, []
    for step, i, at, kind, worker in sorted(rows, key=lambda r: (r[2], r[1])):
        state, holder, expires, attempts = steps.get(step, ("ready", -1, None, 0))
        if expires is not None and expires <= at:
            out.append((step, None, "released", True, "ready", attempts))
            state, holder, expires = "ready", -1, None
        ok = {"claim": state == "ready", "start": state == "claimed" and holder == worker, "renew": state in ("claimed", "running") and holder == worker, "finish": state == "running" and holder == worker}.get(kind, False)
        if ok and kind == "claim":
            state, holder, expires = "claimed", worker, at + lease
        elif ok and kind == "start":
            state, attempts = "running", attempts + 1
        elif ok and kind == "renew":
            expires = at + lease
        elif ok:
            state, holder, expires = "done", -1, None
        steps[step] = (state, holder, expires, attempts)
        out.append((step, i, kind, ok, state, attempts))
    return out, steps


def test_leases_as_a_stream_with_a_restart_equal_a_batch_fold(spark, tmp_path):
    rng = random.Random(7)
    rows, now = [], 0
    for k in range(400):
        now += rng.randrange(1, 40)
        rows.append((rng.randrange(12), k, now, rng.choice(["claim", "claim", "start", "renew", "finish", "other"]), rng.randrange(2)))
    end = now + 100_000
    rows.append((999, 400, end, "other", 0))
    schema = "step long, event_id long, at timestamp, micros long, kind string, worker long"
    moment = lambda s: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    made = [(step, i, moment(at), int(moment(at).timestamp() * 1e6), kind, worker) for step, i, at, kind, worker in rows]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # Three runs from one checkpoint; within a file rows are out of order.
        for part in (made[:150], made[150:151], made[151:400], made[400:]):
            spark.createDataFrame(rng.sample(part, len(part)), schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            query = leases.leased(stream, 300.0, "1 second").writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
            query.trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = collections.Counter((r["step"], r["event_id"], r["kind"], r["accepted"], r["state"], r["attempts"]) for r in spark.read.parquet(out).collect())
    want, steps = plain_leases(rows, 300)
    # What the batch leaves claimed is given back by timers once the watermark has passed.
    held = [(step, None, "released", True, "ready", attempts) for step, (_, _, expires, attempts) in steps.items() if expires is not None]
    assert held and got == collections.Counter(want + held)


def test_a_lease_is_held_started_and_given_back():
    step, ok = leases.Lease().after("claim", 1, 100, 50)
    assert ok and not step.after("claim", 2, 120, 50)[1] and not step.after("start", 2, 120, 50)[1]
    assert step.at(149) is step and step.at(150).state == "ready" and step.at(150).after("claim", 2, 150, 50)[1]
    running, ok = step.after("start", 1, 110, 50)
    assert ok and running.attempts == 1 and running.after("finish", 1, 120, 50) == (leases.Lease("done", -1, -1, 1), True)
    assert running.at(150).attempts == 1


# Lines and tables


def plain_joined(text):
    joined = []
    for line in text.split("\n"):
        line = line.rstrip()
        if joined and joined[-1].strip() and not joined[-1].endswith((".", "!", "?", ":", ";")) and line[:1].islower():
            joined[-1] += " " + line
        else:
            joined.append(line)
    return "\n".join(joined)


def test_joined_lines_against_a_loop(spark):
    rng = random.Random(8)
    parts = ["a", "b", "One", "two.", "three ", "  four", "", " ", "\t", "é", "É", "x:", "y;", "9", "word\xa0", "end!\t"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(400)] + ["", "\n", "a\n" * 50, "  \na"]
    got = {r["t"]: r["j"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines.joined_lines(F.col("t")).alias("j")).collect()}
    assert got == {t: plain_joined(t) for t in texts}


def test_joined_lines_take_time_by_length(spark):
    for text in ("word\n" * 20_000, "a b  c" * 20_000, " " * 200_000 + "x"):
        data = spark.createDataFrame([(text,)], "t string").persist()
        data.count()
        began = time.time()
        assert data.select(F.length(lines.joined_lines(F.col("t")))).first()[0] > 0
        assert time.time() - began < 10


def test_unique_blocks_against_a_search(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(["x", "y", "z", "", " ", "w"]) for _ in range(rng.randrange(0, 25))) for _ in range(60)] + ["", "one", "a\na\na", "\n\n", "x\n" * 30 + "y"]
    got = {(r["id"], r["line_no"]): (r["first"], r["span"]) for r in lines.unique_blocks(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    want = {}
    for k, text in enumerate(texts):
        rows = text.split("\n")
        starts = collections.Counter((s, tuple(rows[i : i + s])) for s in range(1, 13) for i in range(len(rows) - s + 1))
        for n in range(len(rows)):
            fits = [(s, i) for s in range(1, 13) for i in range(max(0, n - s + 1), n + 1) if i + s <= len(rows) and starts[s, tuple(rows[i : i + s])] == 1 and any(x.strip() for x in rows[i : i + s])]
            if fits:
                want[k, n + 1] = (min(fits)[1] + 1, min(fits)[0])
    assert got == want


def test_unique_blocks_deal_no_lines_anew(spark):
    data = spark.createDataFrame([("a", "x\ny\nx\nx"), ("b", None), ("c", ""), ("d", "x\ny"), ("e", " \n\n\t")], "id string, text string")
    found = lines.unique_blocks(data, "id", "text")
    assert sorted(map(tuple, found.collect())) == [("a", 1, 1, 2), ("a", 2, 2, 1), ("a", 3, 2, 2), ("a", 4, 3, 2), ("d", 1, 1, 1), ("d", 2, 2, 1)]
    # A task's memory must not grow with the table: no exchange, sort or window.
    assert "MapInArrow" in (plan := found._jdf.queryExecution().executedPlan().toString()) and not re.search("Exchange|Sort|Window|Aggregate", plan)
    texts = ["\n".join(str(k % m) for k in range(200)) for m in (7, 50, 200)]
    alone = [tuple(int(x) for x in row[1:]) + (n,) for n, t in enumerate(texts) for row in zip(*lines.least_blocks([t], 12))]
    assert alone == [tuple(int(x) for x in row[1:]) + (int(row[0]),) for row in zip(*lines.least_blocks(texts, 12))]


def test_postings_are_the_keywords_and_documents_are_read_once(spark):
    texts = ["The cat, the CAT and a dog", None, "", "\u0130stanbul \u212Aelvin \u00c9t\u00e9 x", "dog9 dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    found = retrieval.postings(docs, "doc", "text", ["the", "and"])
    got = {(r["id"], r["term"]): (r["length"], r["tf"]) for r in found.collect()}
    plain = {r["doc"]: r["w"] for r in docs.select("doc", T.keywords(F.col("text"), ["the", "and"]).alias("w")).collect()}
    want = {(k, w): (len(ws), ws.count(w)) for k, ws in plain.items() if ws for w in ws} | {(k, None): (None if ws is None else len(ws), 0) for k, ws in plain.items()}
    assert got == want
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(found)
    queries = spark.createDataFrame([(1, "dog"), (1, "cat"), (2, "none")], "query_id long, term string")
    scores = retrieval.bm25_scores(docs, "doc", "text", queries, ["the", "and"])
    assert "regexp" not in plan(scores) and "MapInArrow" not in plan(scores)
    assert {(r["query_id"], r["id"]): r["matched"] for r in scores.collect()} == {(1, 0): 2, (1, 4): 1}


def test_join_paths_are_the_shortest(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("x", "y")], "a string, b string")
    got = {(r["first"], r["second"]): (r["path"], r["between"]) for r in catalog.join_paths(edges).collect()}
    assert got == {("a", "b"): ("a > b", ""), ("a", "c"): ("a > b > c", "b"), ("a", "d"): ("a > d", ""), ("b", "c"): ("b > c", ""), ("b", "d"): ("b > a > d", "a"), ("c", "d"): ("c > d", ""), ("x", "y"): ("x > y", "")}


def test_fingerprints_tell_multisets_apart(spark):
    rows = [(1, "a"), (2, None), (2, ""), (3, "a"), (3, "a")]
    of = lambda some, parts=2: tuple(catalog.fingerprint(spark.createDataFrame(some, "k long, s string").repartition(parts), [F.col("k"), F.col("s")]).first())
    assert of(rows) == of(rows[::-1], 7)
    others = [rows[:-1], [*rows, rows[0]], [(1, "b"), *rows[1:]], [(1, "a"), (2, ""), (2, ""), (3, "a"), (3, "a")], [(1, "a"), (1, "a"), *rows[1:3], (3, "a")], []]
    assert len({of(x) for x in [rows, *others]}) == 7 and of([]) == (0, 0)


def test_summaries_keep_names_and_tell_lost_ones(spark):
    rows = [(1, 0, "user", " Where is ORD-1? "), (1, 1, "assistant", "No name here"), (1, 2, "assistant", "It is REF-2"), (1, 3, "tool", "ord-1 REF-2 ORD-1"), (1, 4, "tool", "nothing"), (1, 5, "user", "  "), (2, 0, "assistant", "x"), (3, 0, "user", None)]
    rows += [(4, k, "user", f"ORD-{k}") for k in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = r"(?i)(?:ORD|REF)-[0-9]+"
    kept = conversations.summaries(conversations.summary_lines(turns, "conv_id", "turn", "role", "text", names), "conv_id")
    got = {r["conv_id"]: r["summary"].split("\n") for r in kept.collect()}
    assert got[1] == ["Customer asked: Where is ORD-1?", "Agent said: It is REF-2", "Looked up: ORD-1, REF-2"] and set(got) == {1, 4}
    assert got[4] == [f"Customer asked: ORD-{k}" for k in range(8, 20)]
    lost = {r["conv_id"]: r["missing"] for r in conversations.missing_names(turns, kept, "conv_id", "text", names).collect()}
    # ORD-1 stands in ORD-10, as in a search of the summary's text.
    assert lost == {4: ["ORD-0", *[f"ORD-{k}" for k in range(2, 8)]]}


def test_reranked_scores_are_absolute(spark):
    docs = spark.createDataFrame([(1, "alpha beta\ngamma"), (2, "nothing here"), (3, "gamma x x alpha"), (4, None)], "id long, text string")
    weights = spark.createDataFrame([(9, "alpha", 1.0), (9, "beta", 2.0), (9, "gamma", 1.0)], "query_id long, term string, weight double")
    found = spark.createDataFrame([(9, 1, 2), (9, 2, 1), (9, 3, 1), (9, 4, 1)], "query_id long, id long, lists long")
    got = {r["id"]: (r["score"], r["coverage"], r["window"]) for r in retrieval.reranked(found, docs, weights).collect()}
    assert got[1] == (1.0, 1.0, 3) and got[2] == (0.0, 0.0, None) == got[4]
    # Without beta, the rarest: half of 2 / 4, and a tenth of that for the first line.
    assert got[3] == (0.2563, 0.25, 4)
