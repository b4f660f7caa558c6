import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.sources import arrays as A

VALUE = st.recursive(
    st.one_of(st.none(), st.integers(0, 9), st.text(alphabet='a"\\{}[],: \né', max_size=6)),
    lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(st.text(alphabet='ab"}{', max_size=2), inner, max_size=3)),
    max_leaves=8,
)
ROWS = st.lists(st.dictionaries(st.text(alphabet='ab"}', max_size=2), VALUE, max_size=3), max_size=6)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.sampled_from([None, 1]), st.randoms(use_true_random=False))
def test_splits_come_out_as_the_whole_text(rows, indent, rng):
    """Fragments cut at every closing brace, dealt to splits at random: starts follow from the counts, elements from the starts."""
    fragments = json.dumps(rows, indent=indent, ensure_ascii=False).split("}")
    splits, k = [], 0
    while k < len(fragments):
        size = rng.randint(1, 4)
        splits.append(fragments[k : k + size])
        k += size
    within, depth, found, held = False, 0, [], ""
    for split in splits:
        cutter = A._Cutter(within, depth)
        for fragment in split:
            cutter.feed(fragment + "}")
        for kind, text in cutter.out:
            found.append(held + text if kind == "tail" else text)
            held = ""
        held += "".join(cutter.held)
        ends = []
        for state in (False, True):
            change = 0
            for fragment in split:
                state, more = A.turns(fragment + "}", state)
                change += more
            ends.append((state, change))
        within, change = ends[within]
        depth += change
    assert [json.loads(x) for x in found] == rows and depth == -1 and held == ""


def rows_of(n):
    rng = random.Random(n)
    return [{"id": f"i{k}", "text": "".join(rng.choice('ab"\\{}[] \n') for _ in range(rng.randint(0, 60))), "inner": {"n": [k, {"m": "}"}]}} for k in range(n)]


@pytest.mark.parametrize("most", ["200", "1000", "10m"])
@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_files_in_many_splits(spark, tmp_path, monkeypatch, most, limit):
    monkeypatch.setattr(A, "MOST_SPLITS", limit)
    first, second = rows_of(80), rows_of(3)
    (tmp_path / "a.json").write_text(json.dumps(first, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(second))
    (tmp_path / "c.json").write_text(" [ ]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        found = A.read_array(spark, str(tmp_path), "id string, text string, inner struct<n:array<string>>").orderBy("file", "start", "place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["id"], r["text"]) for r in found] == [(r["id"], r["text"]) for r in first + second]


@pytest.mark.parametrize(("text", "message"), [('[{"a":1}', "does not end"), ('[{"a":1},2]', "no object"), ('["x",{"a":1}]', "no object"), ('[{"a":1},[{}]]', "no object")])
def test_damaged_arrays_fail(spark, tmp_path, text, message):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=message):
        A.read_array(spark, str(tmp_path), "a int").collect()


def test_written_arrays_come_back(spark, tmp_path):
    frame = spark.createDataFrame([(k, None if k % 3 == 0 else f'"{k}}}') for k in range(50)], "n int, t string").repartition(7)
    A.write_arrays(frame, f"{tmp_path}/out")
    assert sorted((r["n"], r["t"]) for r in A.read_array(spark, f"{tmp_path}/out", "n int, t string").collect()) == sorted(tuple(r) for r in frame.collect())


def test_a_prefix_is_enough(spark, tmp_path):
    rows = rows_of(40_000)
    for name, whole in (("bare", rows), ("wrapped", {"note": {"data": [1]}, "n": 3, "outputs": rows, "gold": []})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(whole, indent=1))
        found, read = A.first_elements(spark, str(path), 5)
        assert found == rows[:5] and read <= A.BLOCK < path.stat().st_size / 20
        assert A.first_elements(spark, str(path), 1500)[0] == rows[:1500]
    short = tmp_path / "short.json"
    short.write_text('[{"a":1},\n{"a":2}]')
    assert A.first_elements(spark, str(short), 9)[0] == [{"a": 1}, {"a": 2}]
    for text, message in (('[{"a":1},\n{"a":]', "row 1 at line 2"), ('[{"a":1},\n\n7 ]', "row 1 at line 3"), ('{"a":1}', "no list"), ("3", "no list"), ("", "no list")):
        short.write_text(text)
        with pytest.raises(ValueError, match=message):
            A.first_elements(spark, str(short), 9)


def test_lines_that_do_not_fit(spark, tmp_path):
    lines = [json.dumps({"id": f"i{k}", "n": k}) for k in range(60)]
    lines[7], lines[41], lines[20] = '{"id": ', '{"id":"x","n":"many"}', "  "
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = A.bad_lines(spark, str(tmp_path), "id string, n int").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line"], r["text"]) for r in found) == [(8, lines[7]), (42, lines[41])]


def test_the_first_target_key_that_is_there(spark):
    cases = {'{"gold":"g","answer":"a"}': "a", '{"output":["x","y"],"target":"t"}': "x", '{"title":null,"gold":"g"}': "None", '{"other":1}': None, '{"gold":"[x] y"}': "[x] y", '{"target":7}': "7"}
    frame = spark.createDataFrame([(k,) for k in cases], "e string")
    assert {r["e"]: r["t"] for r in frame.select("e", A.present_target(A.F.col("e")).alias("t")).collect()} == cases
