import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.lang.builder import Groups, clean_literal, combined, equivalent, to_groups
from sparkfolio.lang.nodes import And, AtLeast, Meta, Near, Not, Or, QueryError, Term, is_monotone, metadata_nodes, negative_terms, requires_term, terms
from sparkfolio.lang.parser import fold_operators, parse_query
from sparkfolio.lang.printer import display_name, to_query_string

A, B, C, D = map(Term, "ABCD")


@pytest.mark.parametrize(
    "query, tree",
    [
        ("AAA", Term("AAA")),
        ("A B", Or((A, B))),
        ("A&B", And((A, B))),
        ("A,B", Or((A, B))),
        ("A;B", Or((A, B))),
        ("A | B", Or((A, B))),
        ("A B,C D", Or((And((A, B)), And((C, D))))),
        ("A,B C", Or((A, And((B, C))))),
        ("2of(A,B,C)", AtLeast(2, (A, B, C))),
        ("2OF(A B C)", AtLeast(2, (A, B, C))),
        ("1of((A),B)", AtLeast(1, (A, B))),
        ("2of(A,1of(B,C))", AtLeast(2, (A, AtLeast(1, (B, C))))),
        ("A，B", Or((A, B))),
        ("A＆B", And((A, B))),
        ("ＡＢＣ－１２３", Term("ＡＢＣ－１２３")),
        ("A かつ B", And((A, B))),
        ("A または B", Or((A, B))),
        ("A and B or C", Or((And((A, B)), C))),
        ("!A", Not(A)),
        ("-A", Not(A)),
        ("!!A", Not(Not(A))),
        ("-123", Term("-123")),
        ("ABC-123", Term("ABC-123")),
        ("-ABC-123", Term("-ABC-123")),
        ("(A | B) & C", And((Or((A, B)), C))),
        ("A & (B & C)", And((A, B, C))),
        ('"of the"', Term("of the", phrase=True)),
        ('"say \\"hi\\""', Term('say "hi"', phrase=True)),
        ("NEAR(A,B)", Near(A, B, 100)),
        ("near(A,B,7)", Near(A, B, 7)),
        ("NEAR & A", And((Term("NEAR"), A))),
        ("A & !B", And((A, Not(B)))),
        ("type:powerpoint", Meta("type", "eq", "ppt")),
        ("ext:.XLSX,xls", Meta("ext", "in", "xlsx,xls")),
        ("ext:xlsx,xls A", Or((Meta("ext", "in", "xlsx,xls"), A))),
        ("size:<50MB", Meta("size", "lt", str(50 << 20))),
        ("size:1.5k", Meta("size", "ge", "1536")),
        ("size:1MB..100MB", Meta("size", "range", f"{1 << 20}..{100 << 20}")),
        ("modified:>=2025/1/2", Meta("modified", "ge", "2025-01-02")),
        ("confirmed:no", Meta("confirmed", "eq", "false")),
        (r"C:\temp", Term(r"C:\temp")),
        ("A　B", Or((A, B))),
    ],
)
def test_parse(query, tree):
    assert parse_query(query) == tree


def test_spaces_can_mean_and():
    assert parse_query("A B", spaces="AND") == And((A, B))
    assert parse_query("A !B", spaces="AND") == And((A, Not(B)))


@pytest.mark.parametrize("query", ["()", "(", ")", '"abc', "0of(A,B)", "2of(A)", "3of(A,B)", "2of(", "NEAR(A,B,0)", "NEAR(A)", "NEAR(A,B,x)", "NEAR(A,(B|C))", "A !", "A &", "size:5XB", "size:1..", "modified:2025/13/01", "modified:2025-02-31", "type:unknown", "source:dropbox", "confirmed:maybe", "ext:", 'A"B"', '""', "2of(A,!B)", "(" * 201, "a" * 20_001])
def test_errors(query):
    with pytest.raises(QueryError):
        parse_query(query)


def test_error_points_at_its_place():
    with pytest.raises(QueryError) as e:
        parse_query("AAA & ()")
    assert e.value.position > 0 and e.value.pretty("AAA & ()").endswith("^")


def test_empty_queries():
    assert parse_query("") is parse_query("  ") is parse_query(None) is None


def trees():
    leaf = st.one_of(
        st.sampled_from([A, B, Term("of the", True), Term('x"y\\', True), Term("ABC-1"), Near(A, Term("b c", True), 5)]),
        st.sampled_from([Meta("type", "eq", "pdf"), Meta("size", "range", "1024..4096"), Meta("ext", "in", "a,b"), Meta("modified", "ge", "2024-01-02"), Meta("name", "contains", "x")]),
    )
    several = lambda c: st.lists(c, min_size=2, max_size=3).map(tuple)
    flat = lambda kind: lambda xs: kind(tuple(y for x in xs for y in (x.children if isinstance(x, kind) else (x,))))
    return st.recursive(leaf, lambda c: st.one_of(c.map(Not), several(c).map(flat(And)), several(c).map(flat(Or)), several(leaf).map(lambda xs: AtLeast(1, xs))), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(trees())
def test_writing_and_reading_is_the_identity(tree):
    assert parse_query(to_query_string(tree)) == tree


def test_random_strings_raise_query_errors_only():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(["A", " ", "(", ")", "&", ",", "!", "-", '"', "\\", "2of", "NEAR", "type:", "size:", "1..2", "かつ", "＆", ":", "*"], k=rng.randint(0, 12)))
        try:
            parse_query(text)
        except QueryError:
            pass


def test_labels_and_questions():
    tree = parse_query("A & !B & 2of(C,D)")
    assert display_name(tree) == "A&!B&2of(C,D)"
    assert terms(tree) == [A, C, D] and negative_terms(tree) == [B]
    assert not is_monotone(tree) and is_monotone(parse_query("A|type:pdf"))
    assert metadata_nodes(parse_query("type:pdf & A")) == [Meta("type", "eq", "pdf")]
    assert fold_operators("a、b／c") == "a,b/c"


@pytest.mark.parametrize("query, needs", [("A", True), ("A|type:pdf", False), ("A&type:pdf", True), ("A|!B", False), ("1of(A,type:pdf)", False), ("2of(A,B,type:pdf)", True), ("!A", False), ("NEAR(A,B)", True)])
def test_requires_term(query, needs):
    assert requires_term(parse_query(query)) is needs


@pytest.mark.parametrize("query", ["A", "A&B", "A|B", "A & !B", "2of(A,B,C)", "NEAR(A,B,50)", "type:pdf & A", 'A & "x y"', "ext:pdf & !A", "(A|B) & (C|D)", "size:1MB & A", "!(A&B)", "A & 2of(B,C) & !D"])
def test_form_round_trip(query):
    tree = parse_query(query)
    assert equivalent(to_groups(tree).build(), tree)


def test_forms_and_refinement():
    assert Groups(every=["A", '"x y"'], none=["B"]).query() == 'A & "x y" & !B'
    assert clean_literal('  "a  b" ') == "a b"
    assert combined("A|B", "C", "x, y") == And((Or((A, B)), C, Not(Term("x")), Not(Term("y"))))
    assert equivalent(parse_query("A|B|A"), parse_query("B|A")) and equivalent(parse_query("type:pdf"), parse_query("ext:pdf"))
    assert not equivalent(parse_query("A&B"), parse_query("A|B"))
