"""Classification by a table of rules on whole texts: what is moved for it, and rules and values of any length."""

from __future__ import annotations

import random

import pytest

from rankloom.operators import classify_by_rules
from rankloom.operators.rules import HEAD, PLACES

RULES = "priority int, text string, label string"


def moved(df) -> tuple[int, int, int]:
    """Rows and bytes that all shuffles of the finished query wrote, and rows that its joins made; without subqueries."""
    df.collect()

    def under(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from under(node.finalPhysicalPlan())
        elif name.endswith("QueryStage"):
            yield from under(node.plan())
        elif name != "ReusedExchange":
            if name == "Exchange":
                yield node.metrics().apply("shuffleRecordsWritten").value(), node.metrics().apply("dataSize").value(), 0
            if name.endswith("Join"):
                yield 0, 0, node.metrics().apply("numOutputRows").value()
            for k in range(node.children().size()):
                yield from under(node.children().apply(k))

    return tuple(map(sum, zip(*under(df._jdf.queryExecution().executedPlan()), strict=True)))


@pytest.fixture
def texts(spark, tmp_path):
    """200 texts of 20,000 letters, one in four with a needle."""
    rng = random.Random(3)
    data = [(k, "".join(rng.choices("abcdefgh ", k=20_000)) + "Needle" * (k % 4 == 0)) for k in range(200)]
    spark.createDataFrame(data, "id int, v string").write.parquet(f"{tmp_path}/texts")
    return spark.read.parquet(f"{tmp_path}/texts")


def test_whole_texts_move_once(spark, texts):
    rules = spark.createDataFrame([(1, "needle", "found"), (2, "xyz", "never")], RULES)
    found = classify_by_rules(texts, "v", rules, "none").drop("v")
    assert moved(found)[1] < 1.2 * 200 * 20_000
    assert sorted(map(tuple, found.collect())) == [(k, "none" if k % 4 else "found") for k in range(200)]


def test_rules_of_one_text_meet_a_value_once(spark, texts):
    rules = spark.createDataFrame([(k, "needle" if k % 2 else "NEEDLE", f"rule {k}") for k in range(1000, 0, -1)], RULES)
    found = classify_by_rules(texts, "v", rules, "none").drop("v")
    assert moved(found)[2] < 1000  # 50 values hold the text
    assert sorted(map(tuple, found.collect())) == [(k, "none" if k % 4 else "rule 1") for k in range(200)]


def test_rules_and_values_of_any_length(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abä日É", k=n))
    head, long = text(HEAD), text(3 * PLACES)
    rules = [(9, head + text(k % 150 + 1), f"long {k}") for k in range(40)]
    rules += [(8, text(40) + "é" * (k % 2) + head, f"end {k}") for k in range(5)]
    rules += [(5, long[PLACES - 9 : PLACES + 9], "border"), (6, long[700:1700], "inside"), (7, head[:30], "start"), (4, "Z" * HEAD, "z"), (3, "z" * (HEAD + 1), "zz")]
    values = [None, "", head, long, long[:1500], long[1700:], "z" * HEAD, "z" * (HEAD + 1), "z" * (HEAD - 1), *[text(9) + t + text(k % 3) for k, (_, t, _) in enumerate(rules)]]
    values += [t[:-1] for _, t, _ in rules[:45]] + [t[1:] for _, t, _ in rules[:45]]
    df = spark.createDataFrame(list(enumerate(values)) * 2, "id int, v string").repartition(3)
    for some in (rules, rules[:40], [r for r in rules if len(r[1].encode()) <= HEAD]):
        got = classify_by_rules(df, "v", spark.createDataFrame(some * 2, RULES), "none")
        fits = lambda v: [(p, lb) for p, t, lb in some if v is not None and t.lower() in v.lower()]  # noqa: B023, E731
        assert {r.id: r.label for r in got.collect()} == {k: min(fits(v), default=(0, "none"))[1] for k, v in enumerate(values)} and got.count() == 2 * len(values)


def test_long_rules_that_begin_alike_meet_only_what_holds_their_own_block(spark):
    rng = random.Random(6)
    head = "the same beginning of all rules " * 4
    rules = [(k, head + "".join(rng.choices("abcdef", k=200)), f"rule {k}") for k in range(100)]
    df = spark.createDataFrame([(k, rules[k % 100][1] + str(k)) for k in range(400)], "id int, v string")
    found = classify_by_rules(df, "v", spark.createDataFrame(rules, RULES), "none")
    assert {(r.id, r.label) for r in found.collect()} == {(k, f"rule {k % 100}") for k in range(400)}
    assert moved(found.drop("v"))[2] < 4000  # not 100 rules a value
