"""Arguments of calls, blocks of prompts, citations and reports against plain versions."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from millrace.functions import context
from millrace.operators import arguments, reports, retrieval

SCHEMA = (arguments.Argument("a", required=True), arguments.Argument("n", "number", required=True), arguments.Argument("k", "integer"))


def plain_problem(call):
    missing = [a.name for a in SCHEMA if a.required and (call.get(a.name) is None or (isinstance(call[a.name], str) and not call[a.name].strip()))]
    if missing:
        return "missing: " + ", ".join(missing)
    kinds = {a.name: a.kind for a in SCHEMA}
    for name, v in call.items():
        kind = kinds.get(name)
        if kind == "string" and not isinstance(v, str | int | float):
            return f"{name} must be text"
        if kind == "number":
            try:
                good = not isinstance(v, bool) and v is not None and not isinstance(v, list | dict) and float(v) is not None
            except ValueError:
                good = False
            if not good:
                return f"{name} must be a number"
        if kind == "integer" and not ((isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, str) and v.isdigit())):
            return f"{name} must be a whole number"
    return ""


def test_arguments_against_a_plain_check(spark):
    rng = random.Random(1)
    values = ["x", " y ", "", "  ", None, 1, 2.5, True, False, [1], {"z": 1}, "12", "1.5", "-3", "1e3", 10**20]
    calls = []
    for _ in range(600):
        names = rng.sample(["a", "n", "k", "other"], rng.randrange(0, 5))
        calls.append({x: rng.choice(values) for x in names})
    rows = spark.createDataFrame([(n, json.dumps(c)) for n, c in enumerate(calls)], "n int, call string")
    got = {r["n"]: r for r in rows.select("n", arguments.problem(F.col("call"), SCHEMA).alias("p"), arguments.cleaned(F.col("call"), SCHEMA).alias("c")).collect()}
    for n, call in enumerate(calls):
        assert got[n]["p"] == plain_problem(call), call
        if got[n]["p"] == "":
            c = got[n]["c"]
            assert c["n"] == float(call["n"]) and c["k"] == (min(int(call["k"]), 2**63) if call.get("k") is not None and abs(int(call["k"])) < 2**63 else c["k"])
            if isinstance(call["a"], str):
                assert c["a"] == call["a"].strip()


def test_what_is_no_object_misses_everything(spark):
    rows = spark.createDataFrame([("no json",), (None,), ("[1, 2]",), ("{}",), ('{"a": "x", "n": 1}',)], "call string")
    assert [r[0] for r in rows.select(arguments.problem(F.col("call"), SCHEMA)).collect()] == ["missing: a, n"] * 4 + [""]


def plain_blocks(prompt):
    if "<<<CONTEXT" not in prompt:
        return []
    section = prompt.split("<<<CONTEXT", 1)[1].split(">>>END CONTEXT", 1)[0]
    blocks = []
    for line in map(str.strip, section.split("\n")):
        head = re.match(r"^\[(\d+)\]\s*title:\s*(.*?)\s*\|\s*source:\s*(.*)$", line)
        if head:
            blocks.append([int(head[1]), head[2], head[3], []])
        elif blocks and line:
            blocks[-1][3].append(line)
    return [(m, t, s, " ".join(x)) for m, t, s, x in blocks]


def test_blocks_go_in_and_come_out(spark):
    passages = [[("One", "src a", "Line one.\n\n  line two  \n"), ("T|x", None, ""), (None, "s", None)], [], [("[3] title: a | source: b", "c", "text\nQUESTION: no")]]
    rows = spark.createDataFrame(list(enumerate(passages)), "k int, p array<struct<title:string,source:string,text:string>>")
    prompts = {r["k"]: r["t"] for r in rows.select("k", context.context_blocks(F.col("p")).alias("t")).collect()}
    assert prompts[1] == "<<<CONTEXT\n>>>END CONTEXT" and prompts[0].startswith("<<<CONTEXT\n[1] title: One | source: src a\nLine one.")
    prompts |= {3: "nothing", 4: "<<<CONTEXT\n[7]  title:  a  |  source: b \n x \n", 5: "x\nQUESTION:  who? \nQUESTION: two", 6: ""}
    got = {r["k"]: r for r in spark.createDataFrame(list(prompts.items()), "k int, t string").select("k", context.parsed_blocks(F.col("t")).alias("b"), context.question_of(F.col("t")).alias("q")).collect()}
    for k, prompt in prompts.items():
        assert [tuple(b) for b in got[k]["b"]] == plain_blocks(prompt), k
    assert got[5]["q"] == "who?" and got[3]["q"] == "" and got[2]["q"] == "no"


def test_citation_measures(spark):
    cited = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 12), (3, 13)], "query_id int, id int")
    relevant = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 99)], "query_id int, id int")
    got = {r["query_id"]: tuple(r)[1:] for r in retrieval.citation_measures(cited, relevant, spark.createDataFrame([(11,), (11,), (12,)], "id int")).collect()}
    assert got == {1: (3, 1.0, 1), 2: (1, 0.0, 1), 3: (1, 0.0, 0)}


def test_reports_are_checked_by_their_own_citations(spark):
    texts = [
        (1, "Sales rose by 12.5 percent in 2031. [1] They were 400 before [2][8]. Nobody can say why that came about. Few."),
        (2, "There were 95 cases. [1]"), (3, "All of these six words cite nothing [1]."), (4, None), (5, "Counting 3 things and 10 more is fine with any source [1]."),
    ]
    cites = [(1, 1, "up 12.4 percent", "2031-02-01", 1.0), (1, 2, "some 420 of them", None, 0.5), (2, 1, "100 cases", None, 0.9), (5, 1, None, None, None)]
    found = reports.verified(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(cites, "id int, marker int, quote string, date string, credibility double"))
    trust = reports.trust(F.lit(1.0), F.lit(0), F.lit(False))
    got = {r["id"]: r for r in found.withColumn("trust", trust).collect()}
    assert (got[1]["invented"], got[1]["uncited"], got[1]["unsupported"], got[1]["sentences"]) == ([8], ["Nobody can say why that came about."], [], 4) and "[8]" not in got[1]["text"]
    assert got[2]["unsupported"] == [] and got[5]["unsupported"] == [] and got[3]["invented"] == [1] and got[3]["uncited"] == [] and got[4]["sentences"] == 0
    assert got[2]["trust"] == round(0.25 + 0.25 * (0.6 * 0.9 + 0.4 / 4) + 0.25 + 0.15 + 0.1, 4) and got[3]["trust"] == got[4]["trust"] == 0.25
    assert got[1]["trust"] == round(0.25 + 0.25 * (0.6 * 0.75 + 0.4 / 2) + 0.25 * 0.4 + 0.15 + 0.1, 4)


def test_field_search_counts_names_double(spark):
    items = spark.createDataFrame([(1, ["a", "b"], ["c", "c"]), (2, ["c"], ["a"]), (3, [], ["z"]), (4, ["a"], [])], "id int, name array<string>, body array<string>")
    asked = spark.createDataFrame([(7, "a"), (7, "c"), (7, "a"), (8, "nothing"), (9, "z")], "query_id int, term string")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in retrieval.field_search(items, asked, 2).collect()}
    assert got == {(7, 1): (1, 3.0), (7, 2): (2, 3.0), (8, 1): (1, 0.0), (8, 2): (2, 0.0), (9, 1): (3, 1.0)}


def test_tables_as_text(spark):
    from millrace.functions import tables

    rows = spark.createDataFrame([(1, [("a|b", 1), (None, None), ("x\n y", 3)]), (2, [])], "k int, r array<struct<name:string,n:int>>")
    got = {r["k"]: r["t"] for r in rows.select("k", tables.markdown(F.col("r"), ("name", "n"), 2).alias("t")).collect()}
    assert got[1] == "| name | n |\n|---|---|\n| a\\|b | 1 |\n|  |  |\n... 1 more rows" and got[2].startswith("| name | n |\n|---|---|")
    assert spark.range(1).select(tables.described(F.lit("t"), F.array(F.lit("a"), F.lit("b")), F.lit(3), F.array(F.lit("a = u.x")))).first()[0] == "table t (3 rows)\n  a, b\n  joins a = u.x"


def test_reports_are_composed_of_evidence_alone(spark):
    rows = [
        (1, "b", "Second section says so!", "s2", 0.9, None, 0.5), (1, "a", "Low one", "s1", 0.1, None, 1.0), (1, "a", "High one.", "s3", 0.8, "2020", 1.0), (1, "a", "High one.", "s9", 0.2, None, 1.0), (1, "b", "Again from s1.", "s1", 0.3, None, 1.0),
        (1, "b", " ", "s8", 1.0, None, 1.0), (1, "b", None, "s8", 1.0, None, 1.0), (2, "a", "Alone at 95 percent.", "x", None, None, None),
    ]
    text, cited = reports.composed(spark.createDataFrame(rows, "id int, section string, sentence string, source string, score double, date string, credibility double"))
    assert {r["id"]: r["text"] for r in text.collect()} == {1: "High one [1]. Low one [2]. Second section says so [3]! Again from s1 [2].", 2: "Alone at 95 percent [1]."}
    assert {(r["id"], r["marker"], r["source"]) for r in cited.collect()} == {(1, 1, "s3"), (1, 2, "s1"), (1, 3, "s2"), (2, 1, "x")}
    for r in reports.verified(text, cited).collect():
        assert r["invented"] == [] and r["unsupported"] == [] and r["uncited"] == []


def test_conflicts_are_about_the_same_with_other_figures(spark):
    from millrace.operators import evidence

    claims = [(1, "staff turnover fell by 57 percent"), (2, "staff turnover fell by 12 percent"), (3, "staff turnover fell by 55 percent"), (4, "rain fell on 12 days"), (5, None), (6, "staff turnover")]
    got = {(r["id"], r["other"]) for r in evidence.conflicts(spark.createDataFrame(claims, "id int, claim string")).collect()}
    assert got == {(1, 2), (2, 3)}
