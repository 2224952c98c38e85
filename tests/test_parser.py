"""Generated trees printed in both syntaxes and read again; broken ones are refused."""

import random

import pytest

from conceptmill.ecl import ParseError, parse
from conceptmill.ecl import tree as t
from trees import Maker, Printer

IDS = [73211009, 404684003, 22298006, 138875005]
MAKER = lambda seed: Maker(random.Random(seed), IDS, IDS[:2], IDS[2:])


@pytest.mark.parametrize("seed", range(40))
def test_both_syntaxes_read_as_printed(seed):
    maker = MAKER(seed)
    for _ in range(10):
        made = maker.expression(4)
        for long in (False, True):
            assert parse(Printer(long).text(made)) == made
            assert parse(Printer(long, maker.rng).text(made)) == made


def refused(text: str, *kinds: str) -> ParseError:
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.kind in (kinds or ("Syntax",)), text
    return e.value


BRACKETS = ["(", ")", "{", "}", "{{", "}}"]


@pytest.mark.parametrize("seed", range(40))
def test_one_wrong_token_is_refused(seed):
    rng, maker, printer = random.Random(seed), MAKER(1000 + seed), Printer()
    for _ in range(10):
        tokens = printer.tokens(maker.expression(3))
        places = {
            "without": [i for i, x in enumerate(tokens) if x in BRACKETS],
            "twice": [i for i, x in enumerate(tokens) if x in ("AND", "OR", "MINUS", ":", "{{", "=", "!=")],
            "short": [i for i, x in enumerate(tokens) if x in map(str, IDS)],
            "cut": [i for i, x in enumerate(tokens) if x in ("AND", "OR", "MINUS", ":", "(", "{", "{{", "^", "<", ">")],
        }
        for how, at in places.items():
            if at:
                i = rng.choice(at)
                broken = {"without": tokens[:i] + tokens[i + 1 :], "twice": tokens[: i + 1] + tokens[i:], "short": [*tokens[:i], tokens[i][:5], *tokens[i + 1 :]], "cut": tokens[: i + 1]}[how]
                refused(printer.joined(broken))


def test_grammatical_forms_without_meaning():
    told = {"[3..2] 73211009 = *": "bounds", "{ R 73211009 = * }": "reverse in a group", "R 73211009 = #4": "reverse of a number", "73211009 = *, 22298006 = * OR 404684003 = *": "mixed"}
    for refinement in told:
        refused(f"* : {refinement}", "Semantic")
        refused(f"* : {refinement} )")  # malformed text is reported first
    refused('* {{ C effectiveTime = "20230230" }}', "Semantic")
    refused("^ [x, X] 73211009", "Semantic")


def test_precedence_needs_brackets():
    a, b, c = IDS[:3]
    refused(f"{a} AND {b} OR {c}")
    refused(f"{a} MINUS {b} MINUS {c}")
    assert parse(f"{a} AND ({b} OR {c})") == t.And((t.Concept(a), t.Or((t.Concept(b), t.Concept(c)))))
    assert parse(f"{a}.{b}.{c}") == t.Dotted(t.Dotted(t.Concept(a), t.Concept(b)), t.Concept(c))


@pytest.mark.parametrize("number, good", [("#0", True), ("#-3.25", True), ("#+7", True), ("#007", False), ("#3.", False), ("#.5", False), ("#--1", False)])
def test_numbers(number, good):
    text = f"* : {IDS[0]} = {number}"
    if good:
        assert parse(text).refinement.value.kind == "number"
    else:
        refused(text)


def test_terms_dialects_and_fields():
    got = parse('* {{ D term = ("wide saw" wild:"ha*er"), dialect = (en-gb (prefer) en-us) }}')
    assert got.filters[0].value == (t.Term("match", "wide saw"), t.Term("wild", "ha*er"))
    assert got.filters[1].value == (t.Dialect("en-gb", ("prefer",)), t.Dialect("en-us"))
    assert parse(f"^ [weight, maker] {IDS[0]}") == t.Members(t.Concept(IDS[0]), ("weight", "maker"))
    assert parse(f'^ {IDS[0]} {{{{ M weight > #2, maker = "ac" }}}}').filters == (t.MemberFilter("weight", ">", "number", "2"), t.MemberFilter("maker", "=", "text", (t.Term("match", "ac"),)))
    assert parse(f"* {{{{ +HISTORY-MOD }}}}") == t.History(t.Any(), "MOD")
    assert parse("lab#77-1") == t.Identifier("lab", "77-1")


def test_terms_between_bars_are_no_part_of_the_tree():
    assert parse(f"{IDS[0]} |sugar, long known| OR {IDS[1]}|x|") == parse(f"{IDS[0]} OR {IDS[1]}")
    refused(f"{IDS[0]} | open")


def test_places_of_errors_count_bytes():
    text = f"{IDS[0]} |naïve| : {{ R {IDS[1]} = * }}"
    assert refused(text, "Semantic").offset == text.encode().index(b"R ")
    two = f"{IDS[0]} |naïve| OR\n( {IDS[1]} AND"
    shown = refused(two).caret(two).split("\n")
    assert shown[0] == two.split("\n")[1] and shown[1].strip() == "^"


def test_limits():
    for text in ("(" * 90 + "*" + ")" * 90, " OR ".join(["*"] * 6000), "*" + " " * 80_000):
        refused(text, "Limit")


def test_any_tokens_parse_or_fail_cleanly():
    rng = random.Random(8)
    tokens = [x for seed in range(30) for x in Printer().tokens(MAKER(seed).expression(3))] + ["é", "/*", "|", '"', "#", "..", "+"]
    for _ in range(4000):
        try:
            parse("".join(rng.choice(tokens) + rng.choice(["", " "]) for _ in range(rng.randint(1, 14))))
        except ParseError:
            pass
