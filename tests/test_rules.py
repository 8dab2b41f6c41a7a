"""First-match rules against a plain loop, and sheets that are changed."""

from __future__ import annotations

import csv
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from stallwise.operators import rules as operator
from stallwise.operators.rules import Tested, first_match
from stallwise.sources.mappings import mapping_sheet, packaged_sheet

FACTS = "id int, channel string, purpose string, text string, items array<string>, day date, own double"
TESTED = Tested(equal=("channel", "purpose"), text="text", items="items", day="day")
HEADER = ["cascade", "priority", "from_day", "until_day", "channel", "purpose", "like", "unlike", "any_of", "none_of", "exactly", "result"]


def sheet_file(path, rules: list[dict]) -> str:
    with open(path, "w", newline="") as out:
        writer = csv.DictWriter(out, HEADER)
        writer.writeheader()
        writer.writerows(rules)
    return str(path)


def like(text: str, pattern: str) -> bool:
    return re.fullmatch(re.escape(pattern).replace("%", ".*").replace("_", "."), text, re.S) is not None


def holds(rule: dict, fact: tuple) -> bool:
    _, channel, purpose, text, items, day, _ = fact
    for name, value in (("channel", channel), ("purpose", purpose)):
        asked = rule.get(name)
        if asked and (value is None or (value == asked[1:] if asked[0] == "!" else value != asked)):
            return False
    if rule.get("from_day") and (day is None or str(day) < rule["from_day"]):
        return False
    if rule.get("until_day") and (day is None or str(day) > rule["until_day"]):
        return False
    if rule.get("like") and (text is None or not any(like(text, p) for p in rule["like"].split("|"))):
        return False
    if rule.get("unlike") and (text is None or any(like(text, p) for p in rule["unlike"].split("|"))):
        return False
    if any(rule.get(c) for c in ("any_of", "none_of", "exactly")) and items is None:
        return False
    if rule.get("any_of") and not set(items) & set(rule["any_of"].split("|")):
        return False
    if rule.get("none_of") and set(items) & set(rule["none_of"].split("|")):
        return False
    return not rule.get("exactly") or set(items) == set(rule["exactly"].split("|"))


def expected(rules: list[dict], facts: list[tuple]) -> list[tuple]:
    out = []
    for fact in facts:
        found = next((r["result"] for r in sorted(rules, key=lambda r: r["priority"]) if holds(r, fact)), "none")
        out.append((fact[0], str(fact[-1]) if found == "@own" else found))
    return sorted(out)


def found(spark, facts: list[tuple], path: str) -> list[tuple]:
    df = spark.createDataFrame(facts, FACTS)
    sheet = mapping_sheet(spark, path, TESTED.schema())
    out = first_match(df, sheet, "c", TESTED, "result", F.lit("none"), {"own": F.col("own")})
    assert out.columns == [*df.columns, "result"]
    return sorted((r["id"], r["result"]) for r in out.collect())


def facts(chance: random.Random, n: int) -> list[tuple]:
    pick = lambda values: chance.choice([None, *values])
    rows = []
    for k in range(n):
        items = pick([[], ["a"], ["a", "b"], ["b", "a"], ["c"], ["a", "b", "c"], ["d"]])
        day = pick([dt.date(2021, 1, 1) + dt.timedelta(days=d) for d in (0, 40, 100)])
        rows.append((k, pick("xyz"), pick("pq"), pick(["red bolt", "old red", "", "bolt"]), items, day, k / 2))
    return rows


def rules(chance: random.Random, n: int) -> list[dict]:
    out = []
    for k in range(n):
        rule = {"cascade": "c", "priority": 10 * chance.randrange(100) + k, "result": chance.choice(["@own", f"r{k}"])}
        tests = {
            "channel": ["x", "y", "!x", "!z"], "purpose": ["p", "q", "!p"], "like": ["red%", "%bolt|old%", "_olt"],
            "unlike": ["red%", "%red|bolt"], "any_of": ["a", "c|d"], "none_of": ["b", "a|c"], "exactly": ["a", "a|b", "b|a"],
            "from_day": ["2021-01-20"], "until_day": ["2021-02-10"],
        }
        for name in chance.sample(sorted(tests), chance.choice([1, 2, 2, 3])):
            rule[name] = chance.choice(tests[name])
        out.append(rule)
    return out


@pytest.mark.parametrize("compiled", [0, 150])
@pytest.mark.parametrize("seed", range(3))
def test_random_sheets(spark, tmp_path, monkeypatch, seed, compiled):
    monkeypatch.setattr(operator, "COMPILED", compiled)
    chance = random.Random(seed)
    cascade, rows = rules(chance, 12), facts(chance, 300)
    other = {"cascade": "other", "priority": 0, "result": "wrong"}
    assert found(spark, rows, sheet_file(tmp_path / "s.csv", [other, *cascade])) == expected(cascade, rows)


def test_a_changed_sheet_changes_results_and_no_code(spark, tmp_path):
    rows = facts(random.Random(9), 80)
    first = [{"cascade": "c", "priority": 1, "channel": "x", "result": "one"}, {"cascade": "c", "priority": 2, "like": "%bolt", "result": "two"}]
    second = [{**first[0], "priority": 3, "until_day": "2021-01-31"}, first[1], {"cascade": "c", "priority": 9, "result": "rest"}]
    for k, cascade in enumerate((first, second)):
        assert found(spark, rows, sheet_file(tmp_path / f"{k}.csv", cascade)) == expected(cascade, rows)


def test_sheets_that_cannot_be_applied(spark, tmp_path):
    rows = facts(random.Random(1), 3)
    rule = {"cascade": "c", "priority": 1, "result": "x"}
    with pytest.raises(ValueError, match="priority of their own"):
        found(spark, rows, sheet_file(tmp_path / "a.csv", [rule, {**rule, "result": "y"}]))
    with pytest.raises(ValueError, match="no rules"):
        found(spark, rows, sheet_file(tmp_path / "b.csv", [{**rule, "cascade": "d"}]))
    with pytest.raises(ValueError, match="tests like"):
        path = sheet_file(tmp_path / "c.csv", [{**rule, "like": "a%"}])
        plain = Tested(equal=TESTED.equal)
        first_match(spark.createDataFrame(rows, FACTS), mapping_sheet(spark, path, plain.schema()), "c", plain, "r", F.lit("none"))
    path = tmp_path / "d.csv"
    path.write_text("cascade,priority\nc,many\n")
    with pytest.raises(Exception, match=r"(?s)header|schema|MALFORMED|FAILED"):
        found(spark, rows, str(path))


@pytest.mark.parametrize("compiled", [0, 150])
def test_no_fact_is_moved(spark, tmp_path, monkeypatch, compiled):
    monkeypatch.setattr(operator, "COMPILED", compiled)
    cascade = rules(random.Random(3), 20)
    sheet = mapping_sheet(spark, sheet_file(tmp_path / "s.csv", cascade), TESTED.schema())
    df = spark.createDataFrame(facts(random.Random(4), 50), FACTS)
    out = first_match(df, sheet, "c", TESTED, "result", F.lit("none"), {"own": F.col("own")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan


def test_packaged_sheet(spark):
    schema = "cascade string, priority int, from_day date, until_day date, channel string, purpose string, refunded string, home string, "
    schema += "like string, unlike string, any_of string, none_of string, exactly string, result string"
    for _ in range(2):
        assert packaged_sheet(spark, "budget_rules", schema).filter("cascade = 'share'").count() == 8
