import json
import random

import pytest

from tallyfold.operators import topics as T
from tallyfold.operators.nearest import nearest_smaller

LINES = "forest string, ord long, line string"


def lines(spark, text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], LINES)


def shape(frame):
    return [(r["id"], r["level"], r["parent_id"]) for r in frame.orderBy("ord").collect()]


def test_markdown_outline(spark):
    got = shape(T.outline_topics(lines(spark, "# A\nnote\n## B b\n## B b\n#### C\n# A")))
    assert got == [("a", 1, None), ("b_b", 2, "a"), ("b_b_2", 2, "a"), ("c", 4, "b_b_2"), ("a_2", 1, None)]


def test_indented_outline(spark):
    got = shape(T.outline_topics(lines(spark, "- One\n   1.2. Two\n   a) Three\n     Four\n\n- Five")))
    assert got == [("one", 1, None), ("two", 2, "one"), ("three", 2, "one"), ("four", 3, "three"), ("five", 1, None)]


def test_json_lists(spark):
    flat = json.dumps([{"name": "A", "level": 1}, {"name": "B", "level": "2", "id": "bb"}, {"name": "C", "level": 2, "parent_id": "x"}])
    tree = json.dumps([{"name": "A", "children": [{"name": "B", "children": [{"name": "A"}]}]}, {"name": "C", "id": "cc"}])
    frame = lambda t: spark.createDataFrame([("f", t)], "forest string, json string")
    assert shape(T.flat_json_topics(frame(flat))) == [("a", 1, None), ("bb", 2, "a"), ("c", 2, "x")]
    assert shape(T.nested_json_topics(frame(tree))) == [("a", 1, None), ("b", 2, "a"), ("a_2", 3, "b"), ("cc", 1, None)]


def test_parents_agree_with_a_stack(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for f in range(100):
        above = []
        for o in range(rng.randint(1, 15)):
            level, own = rng.randint(1, 5), f"{f}-{o}"
            while above and above[-1][0] >= level:
                above.pop()
            expected[own] = above[-1][1] if above and level > 1 else None
            above.append((level, own))
            rows.append((str(f), o, own, level, None))
    frame = spark.createDataFrame(rows, "forest string, ord long, id string, level int, parent_id string")
    assert {r["id"]: r["parent_id"] for r in T.derive_parents(frame).collect()} == expected


def test_cycles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", None), ("g", "gone")]
    got = T.cycle_members(spark.createDataFrame(rows, "id string, parent_id string"))
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c", "e"]


def test_tested_topics(spark):
    rows = [("a", None, 0), ("b", "a", 0), ("c", "b", 2), ("d", "a", 0), ("e", None, 1)]
    got = T.tested_topics(spark.createDataFrame(rows, "id string, parent_id string, total_occurrences long"))
    assert {r["id"] for r in got.where("tested").collect()} == {"a", "b", "c", "e"}


def test_validation_codes(spark):
    rows = [
        ("a", "A", 1, None, [5], "resolved"),
        ("b", "", 2, "a", [5], "resolved"),
        ("c", "1.2", 2, "a", [99], "resolved"),
        ("d", "D", 3, "a", [5], "ambiguous"),
        ("e", "E", 1, "a", [5], "resolved"),
        ("f", "F", 2, None, [5], "resolved"),
        ("g", "a", 2, "g", [5], "resolved"),
        ("h", "H", 2, "zz", [5], "resolved"),
    ]
    rows = [(*r, i) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, "id string, name string, level int, parent_id string, source_pages array<int>, resolution_status string, ord long")
    got = sorted(((r["code"], r["topic_id"]) for r in T.validate(frame, 1, 10).collect()), key=str)
    assert got == sorted(
        [
            ("empty_name", "b"), ("inconsistent_resolution_status", "c"), ("source_page_out_of_range", "c"), ("unresolved_topic", "d"), ("inconsistent_child_level", "d"),
            ("root_has_parent", "e"), ("missing_parent_for_nested_level", "f"), ("self_parent", "g"), ("parent_cycle", "g"), ("unknown_parent", "h"), ("duplicate_topic_name", None),
        ]
    )


def test_headings_and_tree(spark):
    rows = [("t", i, x) for i, x in enumerate(["One", "one ", "x" * 130, "Two"])]
    assert T.rendered_headings(spark.createDataFrame(rows, "topic_id string, pos long, text string")).first()["evidence"] == "One\nTwo"
    forest = [("b", "B", None, 2), ("a", "A", None, 1), ("c", "C", "b", 3), ("d", "D", "a", 4)]
    paths = T.tree_paths(spark.createDataFrame(forest, "id string, name string, parent_id string, ord long")).orderBy("path").collect()
    assert [(r["id"], r["depth"]) for r in paths] == [("a", 0), ("d", 1), ("b", 0), ("c", 1)]


def test_validation_of_repeated_ids_and_names(spark):
    schema = "id string, name string, level int, parent_id string, source_pages array<int>, resolution_status string, ord long"
    rows = [("p", "One", 3, None, [1], "resolved", 0), ("p", "Two", 1, None, [1], "resolved", 1), ("c", "two", 2, "p", [1], "resolved", 2), ("e", "Five", 1, "", [1], "resolved", 3)]
    got = sorted((r["code"], r["topic_id"]) for r in T.validate(spark.createDataFrame(rows, schema), 1, 10).collect())
    # The last topic of an id is the parent; a repeated name names no topic; an empty parent is an unknown one.
    assert got == [("duplicate_topic_id", "p"), ("duplicate_topic_name", None), ("missing_parent_for_nested_level", "p"), ("unknown_parent", "e")]


def test_long_chains(spark):
    rows = [(str(i), "t", None if i == 0 else str(i - 1), i) for i in range(200)] + [("x", "t", "y", 500), ("y", "t", "x", 501), ("z", "t", "gone", 502)]
    frame = spark.createDataFrame(rows, "id string, name string, parent_id string, ord long")
    above = T.ancestors_or_self(frame, frame.where("id = '199'"))
    assert {r["id"] for r in above.collect()} == {str(i) for i in range(200)}
    assert {r["id"] for r in T.ancestors_or_self(frame, frame.where("id = 'x'")).collect()} == {"x", "y"}
    paths = {r["id"]: (r["depth"], r["path"]) for r in T.tree_paths(frame).collect()}
    assert {k: d for k, (d, _) in paths.items()} == {str(i): i for i in range(200)} | {"z": 0}
    assert [k for k, _ in sorted(paths.items(), key=lambda x: x[1][1])] == [str(i) for i in range(200)] + ["z"]


def test_a_tab_before_a_heading(spark):
    assert shape(T.outline_topics(lines(spark, "\t# A\n## B"))) == [("a", 1, None), ("b", 2, "a")]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_smaller_against_a_stack(spark, seed):
    rng = random.Random(seed)
    rows = [(g, i * 3, rng.randrange((seed + 1) * 6)) for g in "ab" for i in range(120)]
    want, stack = {}, []
    for g, o, v in rows:
        stack = [] if o == 0 else stack
        while stack and stack[-1][1] >= v:
            stack.pop()
        want[g, o] = stack[-1][0] if stack else None
        stack.append((o, v))
    odd = [("a", None, 1), (None, 1, 1), ("a", 999, None)]
    frame = spark.createDataFrame(rows + odd, "g string, o int, v int").repartition(3)
    assert {(r["g"], r["o"]): r["before"] for r in nearest_smaller(frame, "g", "o", "v").collect()} == want


def test_a_deep_outline_and_tree_without_python_workers(spark):
    text = "\n".join(" " * (i % 200) + f"- Topic {i}" for i in range(450))
    topics = T.outline_topics(lines(spark, text))
    assert "Python" not in topics._jdf.queryExecution().toString() and "Pandas" not in topics._jdf.queryExecution().toString()
    rows = topics.orderBy("ord").collect()
    assert [r["level"] for r in rows] == [i % 200 + 1 for i in range(450)]
    assert all(r["parent_id"] == (None if i % 200 == 0 else rows[i - 1]["id"]) for i, r in enumerate(rows))
    tree = [{"name": "leaf"}]
    for i in range(12):
        tree = [{"name": f"N {i}", "children": tree}, {"name": f"N {i}", "id": f"own{i}"}, {"name": "leaf", "children": None}]
    nested = T.nested_json_topics(spark.createDataFrame([("f", json.dumps(tree)), ("g", "[]"), ("h", "no json"), ("i", None), ("j", '[{"name": " x "}]')], "forest string, json string"))
    assert "Python" not in nested._jdf.queryExecution().toString()
    got = {}
    for r in nested.orderBy("forest", "ord").collect():
        got.setdefault(r["forest"], []).append((r["ord"], r["id"], r["name"], r["level"], r["parent_id"]))
    want, used = [], {}

    def walk(nodes, parent, level):
        for node in nodes or []:
            slug = node["name"].strip().lower().replace(" ", "_")
            if not node.get("id"):
                used[slug] = used.get(slug, 0) + 1
            own = node.get("id") or (slug if used[slug] == 1 else f"{slug}_{used[slug]}")
            want.append((len(want), own, node["name"].strip(), level, parent))
            walk(node.get("children"), own, level + 1)

    walk(tree, None, 1)
    assert got == {"f": want, "j": [(0, "x", "x", 1, None)]}
