import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.functions import repair as R

JSON = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-(10**6), 10**6), st.text(max_size=8)),
    lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(st.text(max_size=6), inner, max_size=4)),
    max_leaves=12,
).filter(lambda v: isinstance(v, dict | list))


@settings(max_examples=300, deadline=None)
@given(JSON, st.sampled_from(["{}", "```json\n{}\n```", "```\n{}```", "Sure:\n{}\nDone.", "  {}  "]))
def test_sound_json_is_read_as_it_is(value, frame):
    assert R.extract(frame.replace("{}", json.dumps(value), 1)) == value


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_the_lenient_reader_reads_sound_json_alike(value):
    text = json.dumps(value, ensure_ascii=True)
    if '\\"' in text or "\\u00" in text and '"' in text[1:]:
        return  # quotes within strings are told from closing ones by what follows
    assert R.read_leniently(text) == value


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="{}[]:,'\"\\ \nabtrue01-.n", max_size=40))
def test_any_text_ends_in_a_value_or_an_error(text):
    for scalar in (False, True):
        try:
            json.dumps(R.extract(text, scalar))
        except ValueError:
            pass
    for mode in R.EDITOR_MODES.values():
        try:
            mode(R.unfenced(text))
        except ValueError:
            pass


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a":1', {"a": 1}),
        ('{"a":[1,2', {"a": [1, 2]}),
        ('{"a":[1,2}', {"a": [1, 2]}),
        ('{"a":{"b":[1]]', {"a": {"b": [1]}}),
        ("{'a': 'it's', 'b': \"c\"}", {"a": "it's", "b": "c"}),
        ('{"a": "he said "no" to it"}', {"a": 'he said "no" to it'}),
        ('{"a" "b" "c": 2}', {"a": "b", "c": 2}),
        ('{"a", "b": 2}', {"a": None, "b": 2}),
        ('{"a":}', {"a": None}),
        ("{a: True, b: None, c: -1.5e3, d: some words}", {"a": True, "b": None, "c": -1500.0, "d": "some words"}),
        ('{"a":"\\alpha\\q"}', {"a": "\\alpha\\q"}),
        ('[{{"a":1},{"b":2}]', [{"a": 1}, {"b": 2}]),
        ('{{"a":1}}', {"a": 1}),
        ('text {"a":"line\nbreak\ttab"} more', {"a": "line\nbreak\ttab"}),
        ('{"a":"\\u00e9\\u12"', {"a": "é\\u12"}),
        ("3", 3),
    ],
)
def test_each_kind_of_damage(text, value):
    assert R.extract(text) == value


def test_lines_of_words():
    assert R.extract('"A title', scalar=True) == "A title"
    for text in ("two\nlines", "", " \n "):
        with pytest.raises(ValueError):
            R.extract(text, scalar=True)
    with pytest.raises(ValueError):
        R.extract("A title")


def test_long_answers_in_linear_time():
    for text in ("{" * 200_000, "[1," * 200_000, '{"a":"' + "x'\\" * 200_000, "```json" + " " * 300_000, '{"a" ' * 100_000, "[" + "'a' " * 100_000):
        began = time.time()
        try:
            R.extract(text)
        except (ValueError, RecursionError):
            pass
        assert time.time() - began < 5
