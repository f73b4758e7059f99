"""Compiled automata against Python's own expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm.automata import compile_rules
from ledgerlark.llm.secrets import BASE, RULES, _reach, find, mask, scanner

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(BASE[k], s, e) for s, k, e in sorted(found)]


PARTS = ["password", "passwd", "secret", "ToKen", "api_key", "APIkey", "=", " ", ":", "'", '"', "abc", "é", "AKIA", "A1B2C3D4E5F6", "0a1b2c3d", "deadbeef", "\n", "ghp_", "𝔘"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=24).map("".join))
def test_base_kinds_agree_with_expressions(text):
    assert [x for x in find(text) if x[0] in BASE] == brute(text)


@pytest.mark.parametrize("pattern", ["a+b", "(?:ab|a)c?", "[^a]b{2,3}", "(?i:aB)c*", "a.b"])
@settings(max_examples=200, deadline=None)
@given(st.text("abcAB\n", max_size=9))
def test_longest_anchored_match(pattern, text):
    longest = max((n for n in range(len(text) + 1) if re.fullmatch(pattern, text[:n])), default=0)
    assert _reach(compile_rules([pattern]), text.encode()) == longest
    ends = max((n for n in range(len(text) + 1) if re.fullmatch(pattern, text[len(text) - n :])), default=0)
    assert _reach(compile_rules([pattern], back=True), text.encode()[::-1]) == ends


def test_automata_are_minimal():
    assert len(compile_rules(["(?:ab|cb)"]).accepts) == 4  # start, middle, end, dead
    assert len(scanner(RULES).all.accepts) < 2000


def test_further_kinds_and_masking():
    text = "é ghp_" + "a1B2" * 10 + " x -----BEGIN RSA PRIVATE KEY----- token=" + "ab" * 20
    spans = find(text)
    assert [k for k, _, _ in spans] == ["github", "pem", "assign", "hex"]
    assert text[spans[0][1] : spans[0][2]] == "ghp_" + "a1B2" * 10
    assert mask(text, spans) == "é [SECRET] x [SECRET] [SECRET]"
    assert mask("plain", []) == "plain" and find(None) == [] and find("") == []


def test_unknown_syntax_is_refused():
    with pytest.raises(ValueError):
        compile_rules([r"\d+"])
