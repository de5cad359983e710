"""The field of personal data: one value, one kind, wherever it stands in a document."""

import pytest

from ridgeline.llm.pii import find, train

FILLER = "and then some other words stand here before "
CLEAN = ["In 1999 he paid $300.25 for 12 items, 45% off.", "no digits at all"]


def found(texts, value):
    return [[k for k, s, e in spans if t[s:e] == value] for t, (_, spans) in zip(texts, find(texts, *train()), strict=True)]


@pytest.mark.parametrize("value", ["2125550199", "030 1234567", "212 555 0199"])
@pytest.mark.parametrize("repeats", [1, 12, 49])
def test_one_cue_reaches_every_repeat(value, repeats):
    text = f"Phone {value} " + (FILLER + value + " ") * repeats
    assert found([text], value) == [["phone"] * (repeats + 1)]
    assert found([*CLEAN, text, "card 4821 9934 1023 7765"], value)[2] == ["phone"] * (repeats + 1)


@pytest.mark.parametrize("repeats", [0, 1, 5, 30])
def test_bare_digits_after_a_cue(repeats):
    assert found(["word phone: 5551234567 then " + (FILLER + "5551234567 ") * repeats], "5551234567") == [["phone"] * (repeats + 1)]
    assert found(["they ordered 5551234567 of these " + (FILLER + "5551234567 ") * repeats], "5551234567") == [[]]


def test_repeats_alone_are_no_evidence():
    assert found([(FILLER + "2125550199 ") * 50], "2125550199") == [[]]


def test_written_out_address():
    text = "Email name[at]host[dot]com and later name[at]host[dot]com again; he came (at) five."
    assert found([text], "name[at]host[dot]com") == [["email"] * 2]
