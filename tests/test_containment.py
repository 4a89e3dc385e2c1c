"""Containment by anchors against a comparison of all texts with all items."""

import random

from tracemill.operators import containment


def test_contained(spark):
    rng = random.Random(6)
    words = ["alpha", "be", "a", "gamma", "été", "x.y", "b", "aa", "$1"]
    blanks = [" ", "\n", "  ", "\t"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(blanks) for _ in range(n)).strip(rng.choice(["", " "]))
    docs = [(i, text(rng.randint(0, 30))) for i in range(120)] + [(500, None), (501, ""), (502, " ")]
    items = [(i, rng.choice(docs[:120])[1]) for i in range(60)]
    items = [(i, t[(a := rng.randrange(len(t))) : a + rng.choice([1, 2, 3, 5, 9, 20])] if t else t) for i, t in items]
    items += [(100, "gamma"), (101, "amm"), (102, "alpha be"), (103, "pha\nb"), (104, None), (105, ""), (106, "  "), (107, "no such"), (108, items[3][1]), (109, " a "), (110, "$1 a"), (111, "b ")]
    want = sorted((d, i) for d, t in docs for i, x in items if t is not None and x is not None and x in t)
    df = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, item int, kind string")
    table = spark.createDataFrame([(*r, 1, "m") for r in items], "item_id long, text string, doc int, word string")
    assert sorted(map(tuple, containment.contained(df, table).collect())) == want and len(want) > 500
    assert containment.contained(df.limit(0), table).count() == 0 and containment.contained(df, table.limit(0)).count() == 0
    same = containment.contained(df.withColumnsRenamed({"doc_id": "a", "text": "b"}), table.withColumnsRenamed({"item_id": "c", "text": "e"}), "a", "b", "c", "e")
    assert same.columns == ["a", "c"] and sorted(map(tuple, same.collect())) == want


def test_no_nested_loop(spark):
    """Neither a nested loop nor a product in the plan, and no text in a shuffle but that of its own row."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "a b c")], "item_id long, text string")
    found = containment.contained(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (1, 3), (2, 2)]
