"""Compatibility forms and escapes of signs are folded, and map back to the characters that held them."""

import time

import pytest

from lumenlake.llm import pii


@pytest.mark.parametrize(
    "kind, span",
    [("email", s) for s in ("john&#64;example.com", "john%40example.com", "john&#x0040;example&#46;com", "john&COMMAT;example&period;com", "𝒿𝑜𝒽𝓃@example.com", "ⓙⓞⓗⓝ@example.com", "ｊｏｈｎ＠example．com", "john%40example%2Ecom")]
    + [("phone", "+①②③ ④⑤⑥ ⑦⑧⑨⓪"), ("ip", "𝟏𝟎.𝟬.0.𝟷"), ("ip", "10&#46;1&#x2e;2%2e3"), ("card", "④111 1111 1111 1111")],
)
def test_folds_give_their_exact_source_spans(kind, span):
    for before, after in (("see ", " today"), ("é \U0001f642 ", "\nmore")):
        text = before + span + after
        base, more = pii.find(text)
        assert [(k, text[a:b]) for k, v in more.items() for a, b in v] == [(kind, span)] and not any(base.values())


@pytest.mark.parametrize("text", ["AT&T, 40%2 and 100%40 of &#8217;things&#46;", "mc² and x₁ + x₂ at 10³", "№ ½ ℃ ㎏ ﬁne", "&#64;", "%40%40%2e", "① one ② two"])
def test_plain_use_of_such_characters_is_left_alone(text):
    base, more = pii.find(text)
    assert not any(base.values()) and not any(more.values())


def test_long_runs_of_escapes_take_linear_time():
    began = time.perf_counter()
    for text in ("%40" * 60_000, "&#0" + "0" * 200_000, "&#64;" * 40_000, "①" * 200_000, "a%40b%2e" * 20_000):
        pii.find(text)
    assert time.perf_counter() - began < 20
