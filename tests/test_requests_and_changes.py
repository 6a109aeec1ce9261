"""Requests in plain words, edits, changes, evaluations and approvals against plain versions."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from millrace.functions import requests as R
from millrace.operators import changes, evaluation, workflow


def values(spark, items, of):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(items)], "k int, v string")
    return [r["x"] for r in rows.select("k", of(F.col("v")).alias("x")).orderBy("k").collect()]


def test_questions_are_cut_and_planned(spark):
    got = values(spark, ["Solid state versus lithium cells", "a vs lithium", "Cats compared to dogs and also birds", "nothing here", "", None], R.parts)
    assert got[:5] == [["Solid state", "lithium cells"], [], ["Cats", "dogs and also birds"], [], []]
    assert values(spark, ["What is the yield of solar cells?", "How are", ""], lambda q: R.topic(q, ("the", "of"))) == ["yield solar cells", "How are", ""]
    plan = values(spark, ["Cats versus dogs"], lambda q: R.planned(q, 3))[0]
    assert plan == ["evidence and measured results for Cats", "evidence and measured results for dogs", "measured results and evidence for cats versus dogs"]
    assert values(spark, ["I do not know that.", "Yes."], R.declines) == [True, False]


def test_requests_name_people_and_pay(spark):
    texts = [
        "Hiring Ada Lovelace as a backend engineer, salary: £52,000 from 2024-03-01. A laptop.", "Please welcome mary.ann_smith@x.org to sales for $41,500.25", "New desk for Bob", "The New Team", "Dear Our Grace Hopper, 45,000",
        "salary of none, but €9", "", None, "Hi Hello Please",
    ]
    got = values(spark, texts, R.intake)
    assert (got[0]["full_name"], got[0]["salary"], got[0]["department"], got[0]["start_date"], got[0]["equipment"], got[0]["missing"]) == ("Ada Lovelace", 52000.0, "engineering", "2024-03-01", ["laptop"], ["email"])
    assert (got[1]["full_name"], got[1]["email"], got[1]["salary"], got[1]["department"]) == ("Mary Ann Smith", "mary.ann_smith@x.org", 41500.25, "sales")
    assert got[2]["full_name"] is None and got[3]["full_name"] is None and got[4]["full_name"] == "Grace Hopper" and got[4]["salary"] == 45000.0 and got[5]["salary"] == 9.0
    assert got[6]["missing"] == list(R.NEEDED) == got[7]["missing"] and got[8]["full_name"] is None


def test_sums_in_words(spark):
    prompts = ["3 boxes of 4 each. How many in total?", "3 boxes of 4 each, less 2. How much is it altogether?", "Of 9, 4 left", "She spends 2 of 10 and 3", "1 and 2 and 3", "7", "", None, "5 at 6 each"]
    assert values(spark, prompts, R.solved) == [12, 10, 5, -11, 6, None, None, None, 11]


def test_edits_are_applied_in_order(spark):
    files = {"a": "one\ntwo\ntwo\n", "b": "x", "c": None, "d": ""}
    edits = [("a", 1, "one", "1"), ("a", 2, "two", "2"), ("a", 3, "1\n", "one two\n"), ("a", 4, "zzz", "y"), ("a", 5, "", "y"), ("a", 6, "x", "x"), ("b", 2, "y", "z"), ("b", 1, "x", "y"), ("b", 3, None, "q"), ("e", 1, "a", "b"), ("c", 1, "a", "b"), ("d", 1, "a", None)]
    rows = changes.apply_edits(spark.createDataFrame(list(files.items()), "path string, text string"), spark.createDataFrame(edits, "path string, place int, old_text string, new_text string"))
    got = {r["path"]: (r["text"], r["statuses"]) for r in rows.collect()}
    assert got["a"] == ("one two\ntwo\ntwo\n", ["applied", "ambiguous", "applied", "not_found", "invalid", "invalid"])
    assert got["b"] == ("z", ["applied", "applied", "invalid"]) and got["e"] == (None, ["missing"]) == got["c"] and got["d"] == ("", ["not_found"])


def test_changes_are_held_against_their_tests(spark):
    before = [("lib/a.py", "def f():\n    return 1\n"), ("tests/a.py", "assert 1"), ("lib/same.py", "x"), ("lib/gone.py", "y")]
    after = [("lib/a.py", "def f():\n    try:\n        return 120.5\n    except:\n        pass\n"), ("tests/a.py", "assert 2"), ("lib/same.py", "x"), ("new.lock", "77 78")]
    tests = [("lib/a.py", "assert f() == 120.5 and 1"), ("new.lock", "78")]
    schema = "path string, text string"
    got = {r["path"]: tuple(r)[1:] for r in changes.judged_changes(*(spark.createDataFrame(x, schema) for x in (before, after, tests)), ("tests/*", "*.lock")).collect()}
    assert got == {
        "lib/a.py": ("modified", False, ["120.5"], [changes.SHORTCUTS[0]]), "tests/a.py": ("modified", True, [], []), "lib/gone.py": ("removed", False, [], []), "new.lock": ("added", True, ["78"], []),
    }


def test_expectations_of_every_kind(spark):
    outcomes = [(1, "tools", "a"), (1, "tools", "b"), (1, "tools", "a"), (1, "n", "3"), (2, "n", "x"), (2, "tools", None)]
    asks = [
        (1, "tools", "equals", ["b", "a"], None, True), (1, "tools", "equals", ["a"], None, False), (1, "tools", "all_of", ["a", "c"], None, False), (1, "tools", "none_of", ["c"], None, True), (1, "tools", "none_of", ["b", "c"], None, False),
        (1, "tools", "nothing", [], None, False), (2, "tools", "nothing", [], None, True), (3, "tools", "all_of", ["a"], None, False), (1, "tools", "recall", ["a", "c"], None, True), (1, "tools", "recall", ["a", "c", "d"], 0.5, False),
        (1, "n", "at_least", None, 3.0, True), (1, "n", "at_most", None, 2.0, False), (2, "n", "at_least", None, 0.0, False), (3, "n", "at_most", None, 9.0, False), (1, "n", "other", None, None, False), (3, "x", "recall", [], None, True),
    ]
    rows = spark.createDataFrame([a[:5] for a in asks], "case int, field string, kind string, wanted array<string>, bound double")
    checks = evaluation.checked(rows, spark.createDataFrame(outcomes, "case int, field string, value string"))
    got = sorted((r["case"], r["field"], r["kind"], r["passed"]) for r in checks.collect())
    assert got == sorted((a[0], a[1], a[2], a[5]) for a in asks)
    assert {tuple(r["missing"]) for r in checks.filter("kind = 'all_of'").collect()} == {("c",), ("a",)} and checks.filter("kind = 'none_of' and not passed").first()["unwanted"] == ["b"]
    rates = {r["suite"]: tuple(r)[1:] for r in evaluation.rated(checks, spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, "u"), (4, "u")], "case int, suite string")).collect()}
    assert rates == {"s": (2, 0, 13, 5, round(5 / 13, 4)), "t": (1, 0, 3, 1, 0.3333), "u": (1, 1, 0, 0, 1.0)}


def test_approvals_against_a_loop(spark):
    rng = random.Random(2)
    base = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(rng.choice([1, 1, 1, 2, 3]), base + datetime.timedelta(hours=rng.randrange(400)), k, rng.choice(["ask", "yes", "no", "other"])) for k in range(300)]
    now = base + datetime.timedelta(hours=410)
    out = workflow.approvals(spark.createDataFrame(rows, "run long, at timestamp, id long, kind string"), "run", "at", "id", "kind", "ask", {"yes": "approved", "no": "rejected"}, 6 * 3600.0, now.timestamp())
    got = {r["id"]: (r["state"], r["waited"]) for r in out.collect()}
    want = {}
    for run, at, k, kind in rows:
        if kind == "ask":
            later = sorted((x[1], x[2], x[3]) for x in rows if x[0] == run and x[3] in ("yes", "no") and (x[1], x[2]) > (at, k))
            waited = (later[0][0] - at).total_seconds() if later else None
            if waited is not None and waited <= 6 * 3600:
                want[k] = ("approved" if later[0][2] == "yes" else "rejected", waited)
            else:
                want[k] = ("expired" if at + datetime.timedelta(hours=6) < now else "pending", None)
    assert got == want and len({s for s, _ in want.values()}) >= 3
    states = {r["run"]: (r["state"], r["answered"]) for r in workflow.resumed(spark.createDataFrame([(1, "approved"), (1, "approved"), (2, "approved"), (2, "pending"), (3, "expired"), (4, "expired"), (4, "rejected")], "run int, state string"), "run").collect()}
    assert states == {1: ("running", 2), 2: ("waiting", 1), 3: ("failed", 0), 4: ("cancelled", 1)}


def test_entries_are_appended_once(spark):
    from millrace.operators import ledger

    rng = random.Random(6)
    log = [(f"k{n}", str(n % 3), 100 + n) for n in range(20)]
    entries = [(rng.choice([None, *(f"k{n}" for n in range(60))]), rng.randrange(30), n, str(rng.randrange(3))) for n in range(300)]
    out = ledger.appended(spark.createDataFrame(log, "key string, digest string, entry_no long"), spark.createDataFrame(entries, "key string, at long, entry_id long, digest string"))
    got = {r["entry_id"]: (r["outcome"], r["entry_no"]) for r in out.collect()}
    held, following = {k: (d, n) for k, d, n in log}, 120
    for key, _, n, digest in sorted(entries, key=lambda e: (e[1], e[2])):
        if key is None:
            want = ("conflict", None)
        elif key not in held:
            held[key] = (digest, following)
            want, following = ("appended", following), following + 1
        else:
            want = ("repeated", held[key][1]) if held[key][0] == digest else ("conflict", None)
        assert got[n] == want, (key, n)
    empty = ledger.appended(spark.createDataFrame([], "key string, digest string, entry_no long"), spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, None)], "key string, at long, entry_id long, digest string"))
    assert sorted((r["entry_id"], r["outcome"], r["entry_no"]) for r in empty.collect()) == [(1, "appended", 1), (2, "repeated", 1)]


def test_what_is_left_to_undo(spark):
    from millrace.operators import ledger

    effects = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 4, "d")], "run int, effect_no int, kind string")
    marks = spark.createDataFrame([(1, 3), (1, 3), (2, 4), (9, 9)], "run int, effect_no int")
    assert {tuple(r) for r in ledger.outstanding(effects, marks).collect()} == {(1, 3, 1, 2, 2, "b"), (2, 1, 1, 0, None, None)}


def test_answers_are_judged(spark):
    answers = spark.createDataFrame([(1, "The Blue house has 3 rooms"), (2, "I don't know."), (3, "I do not know."), (4, " "), (6, "red")], "case int, text string")
    expected = spark.createDataFrame([(1, ["red|blue", "rooms"], False, ["a"], ["z"]), (2, ["x"], False, None, None), (3, [], True, [], []), (4, None, True, None, None), (5, ["x"], None, None, None), (6, ["red", "green|grey"], False, ["a"], ["z"])], "case int, must_contain array<string>, should_abstain boolean, relevant array<string>, forbidden array<string>")
    cited = spark.createDataFrame([(1, "a"), (1, "z"), (1, "z"), (6, "a")], "case int, source string")
    got = {r["case"]: tuple(r)[1:] for r in evaluation.answers_judged(answers, expected, cited, R.declines).collect()}
    assert got == {1: (True, [], False, 0.3333, 1), 2: (False, ["x"], True, 0.0, 0), 3: (True, [], True, 0.0, 0), 4: (True, [], True, 0.0, 0), 5: (False, ["x"], True, 0.0, 0), 6: (False, ["green|grey"], False, 1.0, 0)}
