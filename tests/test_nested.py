import json

from netweave.core import nested as n

ROUND = {"phase": "ladder", "outer": 1, "round": 1, "n_tied": 4, "converged": True, "residual": 1e-9, "retired": 1, "retired_pair": [3, 7]}
CASES = [
    (1, json.dumps({"phase": "patterns", "rounds": [ROUND, None, {"phase": None}], "weights": [[1, 2, 0.5]], "base_weight": {"4": 0.25, "x": 1}})),
    (2, json.dumps({"rounds": ROUND, "reopened": [{"rounds": json.dumps([ROUND])}, 5, {"rounds": []}, {"rounds": "[{\"phase\": "}]})),
    (3, json.dumps(json.dumps({"rounds": [{"phase": "x"}]}))),
    (4, None), (5, ""), (6, "null"), (7, '{"rounds": [{"phase": "a"}'), (8, "[]"), (9, '{"rounds": 3, "reopened": {"rounds": [{}]}}'),
]


def frame(spark, cases):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in cases], "record_id long, tied string, key string, face_pos int")


def test_rounds_keep_their_place(spark, rows):
    t = n.flatten_tied(frame(spark, CASES))
    got = rows(t["round"], "record_id", "face_pos", "round_pos", "phase")
    assert got == sorted([(1, 0, 0, "ladder"), (1, 0, 2, ""), (2, 0, 0, "ladder"), (2, 1, 0, "ladder"), (3, 0, 0, "x"), (9, 1, 0, "")], key=repr)
    assert rows(t["weight"], "record_id", "kind", "dest", "link", "weight") == [(1, "base", 4, None, 0.25), (1, "tied", 1, 2, 0.5)]
    first = t["round"].where("record_id = 1 and round_pos = 0").first()
    assert (first.residual, first.retired_dest, first.retired_link, first.converged) == (1e-9, 3, 7, True)


def test_children_have_parents(spark):
    t = n.flatten_tied(frame(spark, CASES))
    faces, rounds, weights = t["face"], t["round"], t["weight"]
    assert rounds.join(faces, rounds.parent_key == faces.key, "left_anti").count() == 0
    assert weights.join(faces, weights.parent_key == faces.key, "left_anti").count() == 0
    assert faces.count() == faces.select("key").distinct().count() and rounds.count() == rounds.select("key").distinct().count()
    assert faces.where("parent_key <> cast(record_id as string)").count() == 0


def test_empty_table_and_long_text(spark):
    assert [t.count() for t in n.flatten_tied(frame(spark, []).limit(0)).values()] == [0, 0, 0, 0]
    long = json.dumps({"rounds": [{"phase": "p" * 1000} for _ in range(2000)]})
    assert n.flatten_tied(frame(spark, [(1, long), (1, long)]))["round"].count() == 4000


def test_constants_are_numbers_and_other_texts_stay_strict(spark, rows):
    text = '{"walk": {"live_initial": 5, "pivots": NaN}, "rounds": [{"phase": "a", "residual": NaN}, {"residual": -Infinity}, {"residual": 1e400}, {"residual": 2}], "weights": [[1, 2, NaN]]}'
    t = n.flatten_tied(frame(spark, [(1, text), (2, '{"rounds": [{"residual": NAN}]}'), (3, json.dumps(text))]))
    assert rows(t["round"].where("record_id <> 3"), "round_pos", "phase", "residual") == [(0, "a", None), (1, "", None), (2, "", None), (3, "", 2.0)]
    assert rows(t["round"].where("record_id = 3"), "round_pos") == [(0,), (1,), (2,), (3,)]
    assert rows(t["face"], "record_id", "walk_live", "walk_pivots") == [(1, 5, None), (3, 5, None)]
    assert t["weight"].where("weight is null").count() == 2


def test_ladders_and_faces_opened_again_at_second_hand(spark, rows):
    deep = {"phase": "c", "rounds": [ROUND]}
    face = {"ladder": {"rung": "x", "status": "ok", "trail": [{"rung": "p", "phase": "q", "status": "r"}, 7, {"rung": None}]}, "reopened": [{"phase": "b", "reopened": deep}, {"phase": "d"}]}
    text = json.dumps(face)
    for _ in range(7):
        text = json.dumps(text)
    t = n.flatten_tied(frame(spark, [(9, text)]))
    assert rows(t["face"], "key", "face_pos", "depth", "opened_by", "phase", "ladder_rung") == [
        ("9/0", 0, 0, None, "", "x"), ("9/1", 1, 1, "9/0", "b", ""), ("9/1.1", None, 2, "9/1", "c", ""), ("9/2", 2, 1, "9/0", "d", "")]
    assert rows(t["rung"], "key", "parent_key", "rung_pos", "rung", "phase", "status") == [("9/0/r0", "9/0", 0, "p", "q", "r"), ("9/0/r2", "9/0", 2, "", "", "")]
    assert rows(t["round"], "key", "parent_key", "face_pos") == [("9/1.1/0", "9/1.1", None)]
