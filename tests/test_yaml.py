import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.plans import engine as e
from treeloom.sources import yaml


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("size: 4\nname: a b # note\n", {"size": 4, "name": "a b"}),
        ("a: |\n  # one\n\n  two\nb: 2", {"a": "# one\n\ntwo\n", "b": 2}),
        ("a: >\n  long\n  line\n\n    kept\n  end\n", {"a": "long line\n\n  kept\nend\n"}),
        ("a: |-\n  x\n\nb: |+\n  y\n\n", {"a": "x", "b": "y\n\n"}),
        ("a: |2\n   x\n  y\n", {"a": " x\ny\n"}),
        ('a: [1, "p, q", {k: v, w: [x, ~]}]', {"a": [1, "p, q", {"k": "v", "w": ["x", None]}]}),
        ("a: [1,\n  2, # two\n  3]\nb: {x: 1,\n y}", {"a": [1, 2, 3], "b": {"x": 1, "y": None}}),
        ("base: &all\n  x: 1\nuse: *all\nlist: [&n 7, *n]", {"base": {"x": 1}, "use": {"x": 1}, "list": [7, 7]}),
        ("- a: 1\n  b:\n  - 2\n- - 3\n  - 4\n-\n  c: 5\n- ", [{"a": 1, "b": [2]}, [3, 4], {"c": 5}, None]),
        ("'it''s': \"a\\tb\\u00e9\\x21\"\n\"k: l\": 'm # n'", {"it's": "a\tbé!", "k: l": "m # n"}),
        ("a: words\n  go on\n\n  after\nb: 'q\n  r'", {"a": "words go on\nafter", "b": "q r"}),
        ("d: 2024-05-06\ni: -7\nf: 1.5e3\nh: 0x1f\no: 0o17\nt: True\nn: null\ns: !!str 12\ninf: -.inf\nv: 1.2.3", {"d": "2024-05-06", "i": -7, "f": 1500.0, "h": 31, "o": 15, "t": True, "n": None, "s": "12", "inf": float("-inf"), "v": "1.2.3"}),
        ("url: http://a.b:80/c#d\ntime: 10:30", {"url": "http://a.b:80/c#d", "time": "10:30"}),
        ("1: a\ntrue: b\n", {"1": "a", "true": "b"}),
        ("", None), ("# only\n", None), ("plain words", "plain words"), ("a:\n\n  # c\n  b: 1\n", {"a": {"b": 1}}),
    ],
)
def test_documents(text, want):
    assert yaml.load(text) == want


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: [1, 2", "a: 'x", "a: b: c", "a: *none", "a: 1\n  b: 2", "a: [1]]", "\ta: 1", "a: @x", "a: \"\\q\"", "x: {a: 1, a: 2}", "[" * 500])
def test_what_cannot_be_read(text):
    with pytest.raises(ValueError):
        yaml.load(text)


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 99) | st.text("ab :#-'\"[]{},|>&*!\\é\n\t ", max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc :#'", min_size=1, max_size=4), x, max_size=3), max_leaves=8)


def written(x, depth=0):
    """Block style, with scalars in double quotes."""
    import json

    pad = "  " * depth
    if isinstance(x, dict) and x:
        return "".join(f"\n{pad}{json.dumps(k)}:{' ' if not v or not isinstance(v, (dict, list)) else ''}{written(v, depth + 1)}" for k, v in x.items())
    if isinstance(x, list) and x:
        return "".join(f"\n{pad}-{' ' if not v or not isinstance(v, (dict, list)) else ''}{written(v, depth + 1)}" for v in x)
    return json.dumps(x)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_round_trips(x):
    import json

    assert yaml.load(written(x)) == x
    assert yaml.load(json.dumps(x)) == x  # flow style


@settings(max_examples=300, deadline=None)
@given(st.text("ab:- \n#'\"[]{},|>&*!", max_size=30))
def test_anything_is_read_or_refused(x):
    try:
        yaml.load(x)
    except ValueError:
        pass


def test_changes_of_front_matter():
    def meta(old, new):
        root, _ = e.compare(f"---\n{old}\n---\n", f"---\n{new}\n---\n")
        return [m for c in e.walk(root) for m in c.meta]

    assert meta("a: |\n  # one\nb: 1", "a: |\n  # two\nb: 1") == [("$.a", "replace", "# one\n", "# two\n")]
    assert meta("a: [1, \"p, q\"]", "a: [1, \"p, r\"]") == [("$.a", "replace", [1, "p, q"], [1, "p, r"])]
    assert meta("x: &n {p: 1}\ny: *n", "x: &n {p: 2}\ny: *n") == [("$.x.p", "replace", 1, 2), ("$.y.p", "replace", 1, 2)]
    assert meta("a: 1 # note", "a: 1 # other") == []
    assert [m[0] for m in meta("a: [", "a: 1")] == ["$"]
