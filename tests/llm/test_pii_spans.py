"""Spans that the network adds, longer than its context and in other spellings."""

import numpy as np
import pytest

from quillgauge.llm import pii

LONG = "maximilian.featherstonehaugh.department{}mail.university-hospital.example.org"


@pytest.mark.parametrize("at", pii.SPELLINGS)
def test_emails_are_whole(at):
    text = f"write to {LONG.format(at)} today"
    begin, end = text.index("maxi"), text.index(" today")
    middle = text.index(at)
    for proposed in ((begin, end), (middle - 3, middle + len(at) + 3), (middle, middle + len(at))):
        assert pii.additions(text, [], [("email", *proposed)]) == [("email", begin, end)]
    covered = pii.regions(text, 16)
    assert len(covered) == 1 and covered[0][0] <= begin and covered[0][1] >= end


def test_what_no_check_verifies_stays_out():
    for text in ("meet me (at) noon", "(at) mail.example.org", "name at mail.example.org", "we @ home"):
        assert pii.additions(text, [], [("email", 0, len(text))]) == []
    text = "a.b@c.example.org"
    assert pii.additions(text, pii.rules(text), [("email", 0, len(text))]) == []
    two = "ann (at) a.example.org, bob [AT] b.example.org"
    assert [two[a:b] for _, a, b in pii.additions(two, [], [("email", 0, len(two))])] == two.split(", ")


def test_digits_are_not_cut():
    text = "call 0049 170 5557713 or pay 4111.1111.1111.1111 now"
    got = pii.additions(text, [], [("phone", 6, 19), ("card", 31, 46)])
    assert [text[a:b] for _, a, b in got] == ["0049 170 5557713", "4111.1111.1111.1111"]


def test_regions_are_linear():
    text = "1a" * 200_000 + "@" + "b" * 200_000
    assert pii.regions(text, 16) == [(0, len(text))]


def test_network_finds_planted_long_emails():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), n))
    plain = lambda: " ".join(word(int(rng.integers(3, 9))) for _ in range(12))
    mail = lambda n: f"{word(n)}.{word(n)}@{word(n)}.{word(4)}.org"
    model = pii.train([f"{plain()} {mail(int(rng.integers(4, 14)))} {plain()}" for _ in range(240)])
    right, every = 0, 0
    for at in pii.SPELLINGS:
        for _ in range(10):
            planted = mail(16).replace("@", at)
            text = f"{plain()} {planted} {plain()}"
            got = pii.additions(text, pii.rules(text), pii.decode(model, [text])[0])
            right += planted in [text[a:b] for _, a, b in got]
            every += 1
    assert right >= 0.9 * every, right
