import pytest

from folioscan.functions.porter import family, stem
from folioscan.plans.querylang import Node, QueryError, filename_term, negative_term, parse

T = lambda t: Node("term", t)


@pytest.mark.parametrize(
    "text,tree",
    [
        ("a", T("a")),
        ("a b", Node("and", left=T("a"), right=T("b"))),
        ("a or b AND c", Node("or", left=T("a"), right=Node("and", left=T("b"), right=T("c")))),
        ("a AND b NOT c", Node("and", left=T("a"), right=Node("not", left=T("b"), right=T("c")))),
        ("a NOT b c", Node("not", left=T("a"), right=Node("and", left=T("b"), right=T("c")))),
        ('"AND" x', Node("and", left=T("AND"), right=T("x"))),
        ('"" x', T("x")),
        ("Section (Paragraphs)", Node("and", left=T("Section"), right=T("(Paragraphs)"))),
        ("   ", None),
    ],
)
def test_parse(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text,code", [('"a', "unpaired_phrase"), ("AND a", "operator_position"), ("a OR", "operator_position"), ("a AND NOT b", "repeated_operator"), ("NOT a b", "operator_position")])
def test_errors(text, code):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.code == code


def test_special_forms():
    assert negative_term("NOT budget") == "budget" and negative_term('not "a b"') == "a b" and negative_term("a NOT b") is None
    assert filename_term("filename: x y") == "x y" and filename_term('檔名："x"') == "x" and filename_term("x") is None
    for text, code in (("filename:", "filename_empty"), ('filename:"x', "filename_quotes")):
        with pytest.raises(QueryError) as e:
            filename_term(text)
        assert e.value.code == code


def test_stems():
    pairs = {"outstandings": "outstand", "running": "run", "runway": "runwai", "happy": "happi", "news": "new", "foxes": "fox", "caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "relational": "relat", "vietnamization": "vietnam", "electrical": "electr", "hopefulness": "hope", "adoption": "adopt", "controll": "control", "sky": "sky", "Éa": "éa"}
    assert {w: stem(w) for w in pairs} == pairs
    assert {"review", "reviews", "reviewing", "reviewer"} <= set(family("reviewed")) and all(stem(w) == "review" for w in family("reviewed"))
