"""Trees of keys: merging, nested columns and tables of several levels, query models."""

import pytest

from halyard.operators import find as Q


def test_merging():
    of_file = {"A": ["1"], "S": {"x": ["1"], "y": [], "T": {"p": ["1"], "q": ["2"]}}, "B": [], "E": {}}
    own = {"A": ["2"], "S": {"y": ["3"], "T": {"p": ["9"]}}, "C": [], "E": {"z": ["1"]}}
    assert Q.merge_trees(of_file, own) == {"A": ["2"], "S": {"x": ["1"], "y": ["3"], "T": {"p": ["9"]}}, "B": [], "E": {"z": ["1"]}, "C": []}
    assert Q.merge_trees(of_file, own, deep=True)["S"]["T"] == {"p": ["9"], "q": ["2"]}
    assert Q.merge_trees(of_file, own, ["B"]) == {"B": [], "A": ["2"], "S": own["S"], "C": [], "E": {"z": ["1"]}}
    assert Q.merge_trees({"S": {"x": ["1"]}}, {"S": []}) == {"S": []} and of_file["S"]["y"] == []


ROWS = [
    (1, "MR", [{"code": "a", "steps": [{"n": 1, "t": "x"}, {"n": 2, "t": "y"}]}, {"code": "b", "steps": []}]),
    (2, "CT", [{"code": "a", "steps": [{"n": 2, "t": "x"}]}]),
    (3, "CT", [{"code": "b", "steps": [{"n": 1, "t": "y"}, {"n": 2, "t": "x"}]}, {"code": "a", "steps": None}]),
    (4, None, None),
]
CASES = [
    ({"items": {"code": ["a"], "steps": {"n": ["1"]}}}, {1}),  # all keys in one item
    ({"items": {"steps": {"n": ["2"], "t": ["x"]}}}, {2, 3}),
    ({"items": {"code": ["b"], "steps": {"t": ["*"]}}, "modality": ["C?", "MR"]}, {3}),
    ({"items": {"code": [], "steps": {}}}, {1, 2, 3, 4}),  # nothing is asked for
    ({"modality": ["CT"]}, {2, 3}),
]


@pytest.mark.parametrize("tree,want", CASES)
def test_columns_and_tables_agree(spark, tree, want):
    schema = "id int, modality string, items array<struct<code:string,steps:array<struct<n:int,t:string>>>>"
    nested = spark.createDataFrame(ROWS, schema)
    assert {r.id for r in Q.where_tree(nested, tree).collect()} == want
    rows = [(i, 10 * i + k, x["code"]) for i, _, items in ROWS for k, x in enumerate(items or [])]
    steps = [(10 * i + k, s["n"], s["t"]) for i, _, items in ROWS for k, x in enumerate(items or []) for s in x["steps"] or []] + [(None, 1, "x")]
    deep = Q.Child(spark.createDataFrame(steps, "of int, n int, t string"), "of", "item")
    child = Q.Child(spark.createDataFrame(rows, "parent int, item int, code string"), "parent", "id", {"steps": deep})
    assert {r.id for r in Q.where_tree(nested.drop("items"), tree, {"items": child}).collect()} == want


def test_models(spark):
    p = spark.createDataFrame([(1, "A"), (2, "B")], "pid int, name string")
    st = spark.createDataFrame([(10, 1, "x"), (11, 2, "y"), (12, 2, "x")], "study int, of_p int, kind string")
    se = spark.createDataFrame([(100, 10, "m"), (101, 12, "m"), (102, 12, "n"), (103, 11, "m")], "series int, of_s int, mod string")
    levels = {"PATIENT": Q.Level(p), "STUDY": Q.Level(st, ("of_p", "pid")), "SERIES": Q.Level(se, ("of_s", "study"))}
    find = lambda model, tree, level="STUDY": sorted(map(tuple, Q.find_level(model, levels, tree, level).collect()))
    assert find("PatientRoot", {"study": [], "name": ["B"]}) == [(11, "B"), (12, "B")]
    assert find("StudyRoot", {"series": [], "mod": ["m"], "kind": ["x"], "name": [], "study": []}, "SERIES") == [(100, "m", "x", "A", 10), (101, "m", "x", "B", 12)]
    assert find("StudyRoot", {"series": [], "name": ["B"]}, "SERIES") == [(101, "B"), (102, "B"), (103, "B")]  # through a level without keys
    assert find("PatientRoot", {"name": []}, "PATIENT") == [("A",), ("B",)]
    assert Q.find_level("PatientRoot", levels, {"study": []}, limit=1).count() == 1
    assert "kind" not in Q.find_level("StudyRoot", levels, {"series": []}, "SERIES")._jdf.queryExecution().optimizedPlan().toString()
    for model, tree, level in (("StudyRoot", {"name": []}, "PATIENT"), ("PatientStudyOnly", {"series": []}, "SERIES"), ("PatientRoot", {"mod": []}, "STUDY")):
        with pytest.raises(ValueError):
            Q.find_level(model, levels, tree, level)
