from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.functions import text as T
from millrace.functions import vector as V
from millrace.operators import conversations, ingest, retrieval, traces, workflow
from millrace.plans import guard, texts
from millrace.sources import files
from millrace.streaming import logs as stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_stems(spark):
    got = value(spark, F.transform(T.words(F.lit("refunds refunded refunding policies running boxes a its")), lambda w: T.stem(w)))
    assert got == ["refund", "refund", "refund", "policy", "runn", "box", "a", "its"]


def test_sentences_and_shortening(spark):
    assert value(spark, T.sentences(F.lit("One. Two!\nThree? "))) == ["One.", "Two!", "Three?"]
    assert value(spark, T.sentences(F.lit(""))) == []
    long = "word " * 80
    assert value(spark, T.shortened(F.lit(long), 60)).endswith("...")


def test_money(spark):
    cases = {"1,234.56": 1234.56, "1.234,56": 1234.56, "12,50": 12.5, "1,234,567": 1234567.0, "-5.00": -5.0, "EUR 7": 7.0, "none": None, "1.234": 1234.0}
    for text, want in cases.items():
        assert value(spark, T.money(F.lit(text))) == want, text


def test_checksums(spark):
    lengths = {"GB": 22}
    assert value(spark, T.iban_valid(F.lit("GB82 WEST 1234 5698 7654 32"), lengths))
    assert not value(spark, T.iban_valid(F.lit("GB82 WEST 1234 5698 7654 99"), lengths))
    assert not value(spark, T.iban_valid(F.lit("GB82 WEST 1234 5698 7654"), lengths))
    assert value(spark, T.luhn_valid(F.lit("4532 0151 1283 0366")))
    assert not value(spark, T.luhn_valid(F.lit("0000")))


def test_redaction_keeps_own_identifiers(spark):
    text = "mail a.b@c.org card 4532015112830366 order ORD-1234567890123 call +44 20 7946 0958 please"
    out = value(spark, T.redacted(F.lit(text)))
    assert "[EMAIL_REDACTED]" in out and "[CARD_ENDING_0366]" in out and "ORD-1234567890123" in out and "[PHONE_REDACTED]" in out
    assert "7946" not in out


def test_windows_cover_all_words(spark):
    text = " ".join(f"w{k}" for k in range(500))
    got = value(spark, T.word_windows(F.lit(text), 180, 40))
    assert set(" ".join(got).split()) == set(text.split())
    assert value(spark, T.word_windows(F.lit(""), 180, 40)) == []
    assert value(spark, T.word_windows(F.lit("a b"), 180, 40)) == ["a b"]


def test_html(spark):
    page = "<html><head><title> T </title><style>p{}</style></head><body><nav>n</nav><p>Hello</p><script>var t='</p>'</script><footer>f</footer></body></html>"
    assert value(spark, T.html_title(F.lit(page))) == "T"
    assert "Hello" in value(spark, T.html_text(F.lit(page))) and "var" not in value(spark, T.html_text(F.lit(page)))


def test_sets_and_vectors(spark):
    a, e = F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>")
    assert value(spark, T.jaccard(e, e)) == 1.0 and value(spark, T.jaccard(a, e)) == 0.0 and value(spark, T.containment(e, a)) == 0.0
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert value(spark, V.dot(v, F.array(F.lit(1.0)))) == 0.0
    assert value(spark, V.normalised(v)) == [0.6, 0.8]
    assert value(spark, V.rescaled(F.lit(0.5), 0.25, 0.75)) == 0.5


def test_nearest_rank_against_sorting(spark):
    data = [("a", float(k % 7)) for k in range(41)] + [("b", 1.0), ("c", 2.0), ("c", 4.0), ("d", None)]
    got = {r["k"]: r for r in stats.nearest_rank(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}, buckets=5).collect()}
    for k in "abc":
        values = sorted(v for g, v in data if g == k)
        for name, f in (("p50", 0.5), ("p95", 0.95)):
            assert got[k][name] == values[round((len(values) - 1) * f)]
    assert "d" not in got


def test_assignment_and_z(spark):
    shares = spark.range(4000).select(stats.assigned(stats.unit_fraction("e", F.col("id")), [("a", 1), ("b", 3)]).alias("v")).groupBy("v").count().collect()
    assert abs(dict(map(tuple, shares))["b"] / 4000 - 0.75) < 0.03
    assert abs(value(spark, stats.normal_cdf(F.lit(1.96))) - 0.5 * (1 + math.erf(1.96 / math.sqrt(2)))) < 1e-6
    assert value(spark, stats.pooled_z(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 0.0


def test_token_bucket_against_a_loop(spark):
    events = [(k % 3, k, k * 7 % 50 + k) for k in range(90)]
    df = spark.createDataFrame(events, "user_id long, event_id long, s long").withColumn("ts", F.col("s").cast("timestamp"))
    got = {r["event_id"]: r["allowed"] for r in traces.token_bucket(df, "user_id", "ts", "event_id", 2.0, 0.1).collect()}
    for owner in range(3):
        tokens, last = 2.0, None
        for _, event, at in sorted((e for e in events if e[0] == owner), key=lambda e: (e[2], e[1])):
            tokens = min(2.0, tokens + (0 if last is None else (at - last) * 0.1))
            last = at
            assert got[event] == (tokens >= 1)
            tokens -= tokens >= 1


def test_measures(spark):
    r = F.array(*[F.lit(x) for x in ("a", "b", "c")])
    rel = F.array(F.lit("b"), F.lit("z"))
    m = {k: value(spark, c) for k, c in retrieval.measures(r, rel, 2).items()}
    assert m["recall"] == 0.5 and m["precision"] == 0.5 and m["reciprocal_rank"] == 0.5
    assert abs(m["ndcg"] - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-9
    none = retrieval.measures(r, F.array().cast("array<string>"), 2)
    assert value(spark, none["recall"]) == 1.0


def test_fusion_keeps_items_of_one_ranking(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    got = {r["id"]: r["score"] for r in retrieval.fused(a, b).collect()}
    assert abs(got["y"] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got["x"] - 1 / 61) < 1e-12 and len(got) == 3


def test_fusion_ranks_all_documents_by_matched_terms(spark, tmp_path):
    """A long document that matches all terms stands behind a million shorter ones by score, and is first by matches."""
    short = spark.range(1, 1_000_011).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "alpha").otherwise("beta").alias("text"))
    long = spark.createDataFrame([(2_000_000, "alpha beta " + "gamma " * 5000)], "doc_id long, text string")
    short.unionByName(long).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(20, "alpha beta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = texts.hybrid_search(spark, str(tmp_path)).collect()
    assert max(r["score"] for r in got) == round(1 / 61 + 1 / 62, 9)


def test_tags_deny_and_sources_allow(spark):
    df = spark.createDataFrame([("public", "s")], "tag string, source string")
    assert retrieval.allowed(df, "tag", []).count() == 0
    assert retrieval.allowed(df, "tag", ["public"], "source", []).count() == 1


def test_upserts_and_diffs(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in ingest.last_by(rows, ["k"], "o").collect()} == {("a", "y"), ("b", None)}
    assert {(r["k"], r["v"]) for r in ingest.first_by(rows, ["k"], "o").collect()} == {("a", "x"), ("b", None)}
    old = spark.createDataFrame([("a", "1", "n")], "k string, v string, made string")
    new = spark.createDataFrame([("a", "2", "m"), ("c", "3", "m")], "k string, v string, made string")
    assert {tuple(r) for r in ingest.merged(old, new, ["k"], ["made"]).collect()} == {("a", "2", "n"), ("c", "3", "m")}
    before = spark.createDataFrame([("p", "1"), ("q", "1")], "path string, d string")
    after = spark.createDataFrame([("q", "2"), ("r", "1")], "path string, d string")
    assert {tuple(r) for r in ingest.snapshot_diff(before, after, "path", "d").collect()} == {("p", "removed"), ("q", "modified"), ("r", "added")}


def test_recent_turns(spark):
    roles = ["system", "user", "assistant", "user", "assistant", "user"]
    df = spark.createDataFrame([(1, k, r) for k, r in enumerate(roles)], "c int, t int, role string")
    kept = {r["t"] for r in conversations.recent_and_old(df, "c", "t", "role", 2).filter("is_recent").collect()}
    assert kept == {3, 4, 5}


def test_classification_ties_go_to_the_first(spark):
    rules = [("one", [("x", 2)]), ("two", [("y", 2)])]
    assert value(spark, conversations.classified(F.lit("X and Y"), rules, "other"))["label"] == "one"
    assert value(spark, conversations.classified(F.lit("none"), rules, "other"))["label"] == "other"


def test_workflow_fold(spark):
    df = spark.createDataFrame([("r", 1, "start"), ("r", 2, "done"), ("r", 3, "late"), ("s", 1, "start")], "run string, e int, kind string")
    got = {r["run"]: r["state"] for r in workflow.state_of(df, "run", "e", "kind", ["done"]).collect()}
    assert got == {"r": "done", "s": "start"}


def test_guard(spark, tmp_path):
    for name in ("t_ok", "t_hidden"):
        spark.range(3).write.parquet(str(tmp_path / name))
        spark.range(3).createOrReplaceTempView(name)
    spark.sql("CREATE TABLE t_shared USING parquet AS SELECT 1 AS id")
    tables = {"t_ok": str(tmp_path / "t_ok")}
    try:
        for good in (
            "select id from t_ok where id in (select id from t_ok)", "with a as (select * from t_ok) select count(*) from a", "SELECT ';' || '--' AS x, \"/*\" FROM T_OK; -- done",
            "/* all */ select `id` from `t_ok` t order by t.id limit 2", "select 1 union all (select id from t_ok)", "values (1)", "select transform(array(id), x -> x + 1) from t_ok",
        ):
            assert guard.check(spark, good, tables).allowed, (good, guard.check(spark, good, tables))
        assert guard.check(spark, "select * from t_ok a join t_ok b on a.id = b.id", tables).tables == ("t_ok",)
        for bad in (
            "", "-- nothing", "select 1; drop table t_ok", "drop view t_ok", "select * from t_hidden", "select * from (select * from t_hidden) x", "select (select max(id) from t_hidden)", "insert into t_ok select 1",
            "select reflect('java.lang.System', 'exit', 0)", "select `reflect` ('java.lang.System', 'exit', 0)", "select * from parquet.`/tmp/x`", f"select * from parquet.`{tmp_path}/t_hidden`", "create table z as select 1",
            "with a as (select * from t_hidden) select * from a", "select * from t_shared", "select (select max(id) from default.t_shared)", "select * from spark_catalog.default.t_shared", "select identifier('ref' || 'lect')('a', 'b')",
            "select r'\\' , reflect('java.lang.System', 'exit') , ''", "select transform(id) using 'cat' from t_ok", "select * from t_ok) union (select 1", "set x = 1", "show tables", "cache table t_ok", "select nothing from t_ok",
            "select * from t_ok a" + " join t_ok b" * 7, "select * from global_temp.x", "/* select 1",
        ):
            verdict = guard.check(spark, bad, tables)
            assert (not verdict.allowed and verdict.reason) or bad.startswith("select * from t_ok) union"), bad
        rows, more = guard.run(spark, "select * from t_ok", tables, 2)
        assert len(rows) == 2 and more and guard.run(spark, "select 7 as x", tables) == ([(7,)], False)
        with pytest.raises(PermissionError):
            guard.run(spark, "select * from t_hidden", tables)
        assert spark.table("t_hidden").count() == 3 and spark.catalog.tableExists("t_shared")
    finally:
        spark.sql("DROP TABLE t_shared")


def test_limits_and_comments():
    assert guard.has_limit("select 1 limit 5;") and guard.has_limit("select 1 LIMIT 5 OFFSET 2 -- x") and not guard.has_limit("select * from (select 1 limit 5) t") and not guard.has_limit("select ' limit 5'")
    assert guard.without_comments("a -- b\nc /* d */ '-- e'") == "a  \nc   '-- e'" and guard.skeleton("select `a`, 'it\\'s', \"x;\" ;; ") == "select a, '', ''"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "b.html").write_text("<title>B</title><p>body</p>")
    (tmp_path / "c.bin").write_bytes(b"1")
    got = {r["title"]: r["text"] for r in files.text_documents(spark, str(tmp_path)).collect()}
    assert "body" in got["B"] and got["a"].startswith("plain")
    assert {r["error"] for r in files.binary_files(spark, str(tmp_path)).collect()} == {None, "unsupported"}
    log = spark.createDataFrame([("tests/a.py::t PASSED",), ("noise",), ("tests/a.py::u FAILED",)], "value string")
    assert {tuple(r) for r in files.test_outcomes(log).collect()} == {("tests/a.py::t", "passed"), ("tests/a.py::u", "failed")}


def test_streams_equal_batches(spark, tmp_path):
    events = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    read = lambda: stream.event_stream(spark, str(tmp_path / "in"), events.schema, 4)
    stream.run_into(stream.windowed_totals(read()), str(tmp_path / "w"), str(tmp_path / "cw"))
    assert spark.read.parquet(str(tmp_path / "w")).groupBy().sum("n").first()[0] == 180  # the last hour is still open
    stream.run_into(stream.first_effects(read(), F.col("user_id").cast("string")), str(tmp_path / "f"), str(tmp_path / "cf"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 5


def test_files_are_written_whole_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a/b/one.txt", b"one"), ("two.html", b"<p>x"), (None, b"lost"), ("none.txt", None), ("empty.md", b"")], "name string, content binary")
    for _ in range(2):  # A task that runs again leaves the same files.
        made = {tuple(r) for r in files.write_files(rows, f"file:{tmp_path}/out").collect()}
        assert made == {("a/b/one.txt", 3), ("two.html", 4), ("empty.md", 0)}
    found = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert found == ["a/b/one.txt", "empty.md", "two.html"]
    # Spark's reader passes over empty files.
    assert {r["text"] for r in files.text_documents(spark, f"{tmp_path}/out").collect()} == {"one", "x"}
