from datetime import datetime

import pytest

from scriptorium.sources import config as C

FILES = {"a": {"x": {"p": 1, "q": [1]}, "y": 2}, "b": {"base": "a", "x": {"p": 3}}, "c": {"base": "b", "x": 4}, "d": {"base": "e"}, "e": {"base": "d"}}


def test_inheritance():
    assert C.load("b", FILES.__getitem__) == {"x": {"p": 3, "q": [1]}, "y": 2}
    assert C.load("c", FILES.__getitem__) == {"x": 4, "y": 2}
    with pytest.raises(ValueError, match="circle"):
        C.load("d", FILES.__getitem__)
    merged = C.merged(FILES["a"], {})
    merged["x"]["q"].append(2)
    assert FILES["a"]["x"]["q"] == [1]


def test_names_and_paths():
    assert C.safe_name(" My Run! (v2)") == "my_run_v2"
    assert C.run_name("A b", datetime(2020, 1, 2, 3, 4, 5)) == "a_b_20200102_030405"
    assert C.stage_path("/r/", "train", "03_seeds") == "/r/train/03_seeds" and C.round_path("/r", 2, "p") == "/r/round_2/p"
    with pytest.raises(ValueError):
        C.stage_path("/r", "train", "99")
    assert C.ranker_view({"ranker": {"model": "m", "target": 1}, "secret": 2}, "test") == {"ranker": {"model": "m"}, "split": "test", "data": ""}


def test_tables():
    assert C.markdown_table([{"a": 0.5, "b": "x|y"}, {"a": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| 0.5000 | x\\|y |\n| - | - |"
