import json

from folioscope.operators import folds

SCHEMA = "user_id long, kind string, key string, seq long, updated_us long, moved_us long, device string, deleted boolean, data string, seen long"


def run(spark, kind, *changes):
    """changes: (updated, moved, device, data or None for a delete, seen)."""
    rows = [(1, kind, "k", i + 1, u, m, d, x is None, None if x is None else json.dumps(x), s) for i, (u, m, d, x, s) in enumerate(changes)]
    got = folds.merge_changes(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    last = got[-1]
    return [r.status for r in got], json.loads(last.data) if last.data else None, json.loads(last.copy) if last.copy else None, last


def test_newer_tie_and_delete(spark):
    a, b = {"c": 1}, {"c": 2}
    assert run(spark, "highlight", (5, None, "A", a, 0), (4, 9, "A", b, 0))[:2] == (["applied", "older_ignored"], a)
    assert run(spark, "bookmark", (5, None, "B", a, 0), (5, None, "C", b, 0), (5, None, "A", a, 0))[:2] == (["applied", "applied", "older_ignored"], b)
    assert run(spark, "bookmark", (5, None, "A", a, 0), (6, None, "A", None, 0))[1] is None
    assert run(spark, "bookmark", (5, None, "A", None, 0), (6, None, "A", b, 0))[1] == b


def test_order_field_has_its_own_clock(spark):
    status, data, _, last = run(spark, "noteFolder", (10, 0, "A", {"title": "new", "sortIndex": 1}, 0), (0, 5, "B", {"title": "old", "sortIndex": 7}, 1))
    assert status == ["applied", "applied"] and data == {"title": "new", "sortIndex": 7}
    assert (last.updated_us, last.moved_us, last.device) == (10, 5, "B")


def test_lost_notes_are_kept(spark):
    x, y = {"title": "T", "bodyText": "x"}, {"title": "T", "bodyText": "y"}
    assert run(spark, "note", (5, None, "A", x, 0), (6, None, "B", y, 0))[:3] == (["applied", "applied_with_copy"], y, x)
    assert run(spark, "note", (5, None, "A", x, 0), (4, None, "B", y, 0))[:3] == (["applied", "older_ignored_with_copy"], x, y)
    for change in ((6, None, "A", y, 1), (6, None, "A", x, 0), (6, None, "A", None, 0)):
        assert run(spark, "note", (5, None, "A", x, 0), change)[2] is None


def test_nulls_and_empty(spark):
    rows = [(None, None, None, 1, None, None, None, None, None, None)] * 2
    assert folds.merge_changes(spark.createDataFrame(rows, SCHEMA)).count() == 2
    assert folds.merge_changes(spark.createDataFrame([], SCHEMA)).count() == 0
