"""Code indented by tabs."""

from treeloom.sources.markdown import parse


def test_code_indented_by_tabs_ends():
    found = [(b["type"], b.get("value"), b["line"], b["end"]) for b in parse("one\n\n\tcode\tx\n  \tmore\n\n\t\tdeep\n    four\n\ntwo")]
    assert found == [("paragraph", None, 1, 1), ("code", "code\tx\nmore\n\n    deep\nfour", 3, 7), ("paragraph", None, 9, 9)]
    assert [b["type"] for b in parse("- a\n\n  \tb")] == ["list"]
