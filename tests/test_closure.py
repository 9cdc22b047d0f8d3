"""Closures of parent links: deep chains, orphans and cycles."""

from __future__ import annotations

import pytest

from corpuscope.operators import access, closure, listing


def test_deep_tags(spark):
    tags = spark.createDataFrame([(f"t{i}", f"t{i - 1}" if i else None) for i in range(200)] + [("a", "b"), ("b", "a"), ("c", "gone")], "tag_id string, parent_tag string")
    found = {(r["tag_id"], r["ancestor"]): r["depth"] for r in access.tag_ancestors(tags).collect()}
    assert all(found[(f"t{i}", f"t{j}")] == i - j for i in range(200) for j in range(i + 1))
    assert found[("a", "a")] == 0 and found[("a", "b")] == 1 and found[("c", "gone")] == 1
    assert len(found) == 200 * 201 // 2 + 4 + 2
    tree = {r["tag_id"]: r for r in access.tag_tree(tags.where("tag_id LIKE 't%'")).collect()}
    assert tree["t199"]["root"] == "t0" and tree["t199"]["level"] == 199
    asked = spark.createDataFrame([("t0", "t199"), ("t199", "t0")], "tag_id string, new_parent string")
    assert {r["tag_id"]: r["cycle"] for r in access.forms_cycle(asked, tags).collect()} == {"t0": True, "t199": False}


def test_every_run_has_a_root(spark):
    rows = [(f"g{i}", f"g{i - 1}" if i else None, "COMPLETED") for i in range(200)] + [("o1", "absent", "FAILED"), ("o2", "o1", "COMPLETED"), ("x", "y", "FAILED"), ("y", "x", "COMPLETED")]
    runs = spark.createDataFrame(rows, "generation_id string, retry_of string, status string")
    found = {r["generation_id"]: (r["root"], r["depth"], r["recovered"]) for r in listing.retry_lineage(runs).collect()}
    assert len(found) == len(rows)
    assert all(found[f"g{i}"] == ("g0", i, i > 0) for i in range(200))
    assert found["o1"] == ("o1", 0, False) and found["o2"] == ("o1", 1, True) and found["x"] == ("x", 0, False)


@pytest.mark.parametrize("hot", [3, 10**6])
def test_hot_parents_are_looked_up_apart(spark, monkeypatch, hot):
    """Beyond a broadcast no row is repeated over salts, and rows without a parent take no part in a join."""
    rows = [(f"g{i}", f"g{i // 10}" if i >= 10 else None) for i in range(60)] + [("o", "absent"), *((f"p{i}", "absent") for i in range(9)), ("x", "y"), ("y", "x"), (None, None)]
    monkeypatch.setattr(closure, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(closure, "HOT_ROWS", hot, raising=False)
    monkeypatch.setattr(closure, "join_on_hot_keys", lambda *a, **k: pytest.fail("rows were repeated"))
    asked, real = [], closure._looked_up
    monkeypatch.setattr(closure, "_looked_up", lambda some, side, key, *how: asked.append(some.where(f"{key} IS NULL").count()) or real(some, side, key, *how))
    found = {r["node"]: (r["root"], r["depth"]) for r in closure.chain_starts(spark.createDataFrame(rows, "node string, up string"), "node", "up").collect()}
    parent, want = dict(rows), {}
    for node in parent:
        at, depth, seen = node, 0, set()
        while parent[at] in parent and parent[at] is not None and at not in seen:
            seen.add(at)
            at, depth = parent[at], depth + 1
        want[node] = (node, 0) if at in seen else (at, depth)
    assert found == want and asked and not any(asked)
