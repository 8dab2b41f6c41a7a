"""First-match rules kept in a sheet: cascades that change without changing code.

A rule is a row of the sheet: the cascade it belongs to, its priority, the days
it is valid on, and tests.  A test that is left empty always holds.

* One column per fact column that is tested for equality: a value, or ``!`` and a
  value for any other value.
* ``like`` and ``unlike``: patterns of a text, of which one must, or none may, match.
* ``any_of``, ``none_of`` and ``exactly``: items of a list, of which one must, none
  may, or all and no others must, be there (in any order).

Patterns and items are parted by ``|``.  As under WHEN, a test of a NULL fails,
whatever it asks.  The rule with the least priority among those that hold gives
the result; ``@name`` stands for a column of the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: A sheet is read by the driver and given to every task; more rules than this are an error.
MOST_RULES = 2_000
#: Up to so many rules become one CASE expression, which is compiled; more are joined.
COMPILED = 150
PARTED = "[|]"
RULE = (
    "priority int, from_day date, until_day date, others map<string,string>, like array<string>, unlike array<string>, "
    "any_of array<string>, none_of array<string>, exactly array<string>, result string"
)


@dataclass(frozen=True)
class Tested:
    """What the tests of a sheet are about, as columns of the facts: equality columns, text, list and day."""

    equal: tuple[str, ...] = ()
    text: str | None = None
    items: str | None = None
    day: str | None = None

    def schema(self) -> str:
        """The columns that a sheet for these tests has."""
        names = "".join(f"{name} string, " for name in self.equal)
        return (
            f"cascade string, priority int, from_day date, until_day date, {names}"
            "like string, unlike string, any_of string, none_of string, exactly string, result string"
        )


def _parts(value: str | None) -> list[str] | None:
    return None if value is None else [part.strip() for part in value.split("|")]


def _is_other(value: str | None) -> bool:
    return value is not None and value.startswith("!")


def rules_of(sheet: DataFrame, cascade: str, tested: Tested) -> list[Row]:
    """The rules of one cascade; a sheet that cannot be applied is an error, not a silent default."""
    rows = sheet.filter(F.col("cascade") == cascade).limit(MOST_RULES + 1).collect()
    if not rows:
        raise ValueError(f"no rules of the cascade {cascade}")
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules of the cascade {cascade}")
    priorities = [r["priority"] for r in rows]
    if None in priorities or len(set(priorities)) < len(priorities):
        raise ValueError(f"rules of the cascade {cascade} without a priority of their own")
    needs = {"like": tested.text, "unlike": tested.text, "any_of": tested.items, "none_of": tested.items, "exactly": tested.items,
             "from_day": tested.day, "until_day": tested.day}
    for row in rows:
        for column, about in needs.items():
            if row[column] is not None and about is None:
                raise ValueError(f"rule {row['priority']} of the cascade {cascade} tests {column}, which the facts do not have")
    return rows


def _rule(row: Row, tested: Tested) -> tuple:
    others = {name: row[name][1:] for name in tested.equal if _is_other(row[name])}
    lists = [_parts(row[c]) for c in ("like", "unlike", "any_of", "none_of", "exactly")]
    return (row["priority"], row["from_day"], row["until_day"], others, *lists, row["result"])


def _holds(rule: Column, tested: Tested) -> Column:
    """The tests of a rule that are not part of the join."""
    tests = []
    if tested.day:
        tests += [rule["from_day"].isNull() | (F.col(tested.day) >= rule["from_day"])]
        tests += [rule["until_day"].isNull() | (F.col(tested.day) <= rule["until_day"])]
    for name in tested.equal:
        other = F.try_element_at(rule["others"], F.lit(name))
        tests.append(other.isNull() | (F.col(name).cast("string") != other))
    if tested.text:
        matches = lambda pattern: F.like(F.col(tested.text), pattern)
        tests.append(rule["like"].isNull() | F.exists(rule["like"], matches))
        tests.append(rule["unlike"].isNull() | ~F.exists(rule["unlike"], matches))
    if tested.items:
        items = F.col(tested.items)
        has = lambda item: F.array_contains(items, item)
        tests.append(rule["any_of"].isNull() | F.exists(rule["any_of"], has))
        tests.append(rule["none_of"].isNull() | ~F.exists(rule["none_of"], has))
        same = F.array_sort(F.array_distinct(items)) == F.array_sort(F.array_distinct(rule["exactly"]))
        tests.append(rule["exactly"].isNull() | same)
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(True)


def first_match(
    facts: DataFrame,
    sheet: DataFrame,
    cascade: str,
    tested: Tested,
    name: str,
    otherwise: Column,
    values: dict[str, Column] | None = None,
) -> DataFrame:
    """Every fact with the result of the first rule of a cascade that holds, else ``otherwise``, of its type.

    The rules of an ordinary sheet become the branches of one CASE, in order of
    priority.  Those of a long one are found by joins on their equality columns (see
    ``_joined``).  Either way no fact is listed twice and none is moved for it.
    """
    rows = sorted(rules_of(sheet, cascade, tested), key=lambda r: r["priority"])
    kind = facts.select(otherwise.alias("otherwise")).schema["otherwise"].dataType
    named = {f"@{key}": column.cast(kind) for key, column in (values or {}).items()}
    if len(rows) > COMPILED:
        return _joined(facts, rows, tested, name, otherwise, kind, named)
    chosen = None
    for row in rows:
        result = named[row["result"]] if row["result"] in named else F.lit(row["result"]).cast(kind)
        chosen = (F if chosen is None else chosen).when(_compiled(row, tested), result)
    return facts.withColumn(name, chosen.otherwise(otherwise))


def _compiled(row: Row, tested: Tested) -> Column:
    """All tests of a rule as a condition."""
    tests = [F.lit(True)]
    for column in tested.equal:
        if row[column] is not None:
            value = F.col(column).cast("string")
            tests.append(value != row[column][1:] if _is_other(row[column]) else value == row[column])
    if row["from_day"] is not None:
        tests.append(F.col(tested.day) >= F.lit(row["from_day"]))
    if row["until_day"] is not None:
        tests.append(F.col(tested.day) <= F.lit(row["until_day"]))
    any_ = lambda conditions: reduce(lambda a, b: a | b, conditions)
    for column, wanted in (("like", True), ("unlike", False)):
        if row[column] is not None:
            found = any_([F.col(tested.text).like(pattern) for pattern in _parts(row[column])])
            tests.append(found if wanted else ~found)
    for column, wanted in (("any_of", True), ("none_of", False)):
        if row[column] is not None:
            found = any_([F.array_contains(tested.items, item) for item in _parts(row[column])])
            tests.append(found if wanted else ~found)
    if row["exactly"] is not None:
        items = F.array_sort(F.array_distinct(tested.items))
        tests.append(items == F.array(*[F.lit(item) for item in sorted(set(_parts(row["exactly"])))]))
    return reduce(lambda a, b: a & b, tests)


def _joined(
    facts: DataFrame, rows: list[Row], tested: Tested, name: str, otherwise: Column, kind: DataType, named: dict[str, Column]
) -> DataFrame:
    """Rules are grouped by the columns that they test for equality.

    Each group is joined on these columns and gives a fact the list of rules that can
    hold; what is left of the tests thins out the list, and its least priority is the
    result.  The rules are at most ``MOST_RULES`` rows, which are given to every task.
    """
    spark = facts.sparkSession
    by_columns: dict[tuple[str, ...], dict[tuple[str, ...], list[tuple]]] = {}
    for row in rows:
        given = tuple(c for c in tested.equal if row[c] is not None and not _is_other(row[c]))
        by_columns.setdefault(given, {}).setdefault(tuple(row[c] for c in given), []).append(_rule(row, tested))
    found, lists = facts, []
    for k, (given, rules) in enumerate(sorted(by_columns.items())):
        if not given:  # rules for every fact are a constant
            lists.append(F.array(*[_constant(rule) for rule in rules[()]]))
            continue
        keys = [f"_rule_{k}_{i}" for i in range(len(given))]
        entries = [
            F.struct(*[F.lit(v).alias(key) for v, key in zip(values, keys, strict=True)], F.array(*map(_constant, own)).alias(f"_rules_{k}"))
            for values, own in sorted(rules.items())
        ]
        side = spark.range(1).select(F.explode(F.array(*entries)).alias("_entry")).select("_entry.*")
        on = reduce(lambda a, b: a & b, [F.col(c).cast("string") == F.col(key) for c, key in zip(given, keys, strict=True)])
        found = found.join(F.broadcast(side), on, "left").drop(*keys)  # at most MOST_RULES rules, counted above
        lists.append(F.coalesce(F.col(f"_rules_{k}"), F.array().cast(f"array<struct<{_struct(RULE)}>>")))
    able = F.filter(F.concat(*lists), lambda rule: _holds(rule, tested))
    first = F.array_min(F.transform(able, lambda rule: F.struct(rule["priority"].alias("priority"), rule["result"].alias("result"))))
    result = F.col("_first")["result"]
    out = result.cast(kind)
    for mark, column in named.items():
        out = F.when(result == mark, column).otherwise(out)
    found = found.withColumn("_first", first)
    chosen = F.when(F.col("_first").isNull(), otherwise).otherwise(out)
    return found.withColumn(name, chosen).drop("_first", *[c for c in found.columns if c.startswith("_rules_")])


def _constant(rule: tuple) -> Column:
    """A rule as a literal."""
    priority, from_day, until_day, others, *lists, result = rule
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    columns = [F.lit(priority), F.lit(from_day), F.lit(until_day), F.map_from_arrays(texts(others), texts(others.values()))]
    columns += [F.lit(None) if values is None else texts(values) for values in lists]
    kinds = [part.split(" ", 1) for part in RULE.split(", ")]
    return F.struct(*[c.cast(kind).alias(n) for c, (n, kind) in zip([*columns, F.lit(result)], kinds, strict=True)])


def _struct(ddl: str) -> str:
    """Column definitions as fields of a struct."""
    return ", ".join(f"{n}: {t}" for n, t in (part.split(" ", 1) for part in ddl.split(", ")))
