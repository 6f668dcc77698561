"""Recall of every disguise of personal data, and what only looks like it, with a field trained on a small corpus."""

import random

import pytest

from loomstone.llm import pii_spans as p

WORDS = "the of and report meeting please contact write call reach server host log from office desk about see order item value near until".split()


def text(r, n=8):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(2, n)))


def digits(r, n):
    return "".join(r.choice("0123456789") for _ in range(n))


def name(r):
    return r.choice(["jane.doe", "bob", "info", "a.smith99", "m_k", "sales-team", "x1", "Peter"])


def host(r):
    return r.choice(["example", "acme", "mail.big-co", "uni-x", "sub.dom"]) + "." + r.choice(["com", "org", "co.uk", "de", "io"])


def card(r):
    d = r.choice("3456") + digits(r, 14)
    return next(d + c for c in "0123456789" if p.luhn(d + c))


def four(c):
    return [c[k : k + 4] for k in range(0, 16, 4)]


def octets(r):
    return [str(r.randint(1, 255)) for _ in range(4)]


def nanp(r, sep):
    return sep.join((r.choice("23456789") + digits(r, 2), r.choice("23456789") + digits(r, 2), digits(r, 4)))


def date(r):
    return f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"


def clock(r):
    return f"{r.randint(0, 23):02}:{r.randint(0, 59):02}"


DISGUISES = {
    "boxed": (0, lambda r: f"{name(r)} [at] {host(r).replace('.', ' [dot] ')}"),
    "bracketed": (0, lambda r: f"{name(r)} (at) {host(r).replace('.', ' (dot) ')}"),
    "spelled": (0, lambda r: f"{name(r)} at {host(r).replace('.', ' dot ')}"),
    "capitals": (0, lambda r: f"{name(r)} AT {host(r).replace('.', ' DOT ')}"),
    "blanks": (0, lambda r: f"{name(r)} @ {host(r)}"),
    "tight": (0, lambda r: f"{name(r)}(at){host(r)}"),
    "tight boxed": (0, lambda r: f"{name(r)}[at]{host(r).replace('.', '[dot]')}"),
    "ip blanks": (1, lambda r: " . ".join(octets(r))),
    "ip boxed": (1, lambda r: "[.]".join(octets(r))),
    "ip bracketed": (1, lambda r: "(dot)".join(octets(r))),
    "ip spelled": (1, lambda r: " dot ".join(octets(r))),
    "card dots": (2, lambda r: ".".join(four(card(r)))),
    "card blanks": (2, lambda r: "  ".join(four(card(r)))),
    "card slashes": (2, lambda r: "/".join(four(card(r)))),
    "area": (3, lambda r: f"({digits(r, 3)}) {digits(r, 3)}-{digits(r, 4)}"),
    "dashes": (3, lambda r: nanp(r, "-")),
    "dots": (3, lambda r: nanp(r, ".")),
    "gaps": (3, lambda r: nanp(r, " ")),
    "zeros": (3, lambda r: f"00{r.randint(1, 99)} {r.randint(10, 999)} {digits(r, 7)}"),
    "zeros dashes": (3, lambda r: f"00{r.randint(1, 99)}-{r.randint(10, 999)}-{digits(r, 3)}-{digits(r, 4)}"),
    "plus slashes": (3, lambda r: f"+{r.randint(1, 99)}/{r.randint(10, 999)}/{digits(r, 7)}"),
}
LOOKALIKES = {
    "timestamp": lambda r: f"{date(r)} {clock(r)}:{r.randint(0, 59):02}",
    "minutes": lambda r: f"{date(r)} {clock(r)}",
    "zone": lambda r: f"{date(r)}T{clock(r)}:00+02:00",
    "millis": lambda r: f"{date(r)} {clock(r)}:11.{digits(r, 3)}",
    "german": lambda r: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)} {clock(r)}",
    "american": lambda r: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}",
    "dates": lambda r: f"{date(r)} - {date(r)}",
    "compact": lambda r: f"{r.randint(1990, 2030)}{r.randint(10, 12)}{r.randint(10, 28)}{digits(r, 6)}",
    "iban": lambda r: f"{r.choice(['DE', 'FR', 'GB'])}{digits(r, 2)} {digits(r, 4)} {digits(r, 4)} {digits(r, 4)} {digits(r, 4)} {digits(r, 2)}",
    "iban run": lambda r: f"DE{digits(r, 20)}",
    "order": lambda r: f"order {r.choice('123456789')}{digits(r, 3)}-{digits(r, 6)}",
    "amount": lambda r: f"{digits(r, 3)}.{digits(r, 3)}.{digits(r, 3)},00",
    "isbn": lambda r: f"978-{r.randint(1, 9)}-{digits(r, 4)}-{digits(r, 4)}-{r.randint(1, 9)}",
    "version": lambda r: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
    "numbers": lambda r: " ".join(digits(r, r.randint(1, 3)) for _ in range(6)),
    "handle": lambda r: f"@{name(r)} said",
    "at the dot": lambda r: "look at the dot on it",
    "uuid": lambda r: f"{digits(r, 8)}-{digits(r, 4)}-{digits(r, 4)}-{digits(r, 4)}-{digits(r, 12)}",
}


@pytest.fixture(scope="module")
def field(spark):
    r = random.Random(7)
    rows = []
    for k in range(160):
        found = r.choice([f"{r.choice(['anna', 'bob.c', 'd_e', 'ff'])}@mail{k % 5}.example.{r.choice(['com', 'org'])}", f"+1 ({200 + k}) 555-{1000 + k}", f"+49 30 {1234567 + k}", " ".join(four(card(r))), f"10.1.{k}.7"])
        rows.append((f"{text(r)} {found}{r.choice([' ', ', ', '. '])}{text(r)}",))
    return p.train(spark.createDataFrame(rows, "text string"))


@pytest.mark.parametrize("way", DISGUISES)
def test_recall_of(field, way):
    kind, make = DISGUISES[way]
    r, hits = random.Random(way), 0
    for _ in range(30):
        before, span = text(r) + " ", make(r)
        _, every = p.all_spans(before + span + r.choice([". ", " ", ", ", "\n"]) + text(r), field, 2.0)
        hits += (len(before), len(before) + len(span)) in every[kind]
    assert hits >= 27


@pytest.mark.parametrize("way", LOOKALIKES)
def test_left_alone(field, way):
    r = random.Random(way)
    for _ in range(30):
        whole = f"{text(r)} {LOOKALIKES[way](r)}{r.choice(['. ', ' ', ', '])}{text(r)}"
        base, every = p.all_spans(whole, field, 2.0)
        assert base == every, whole


def test_dates_stay_in_masked_texts(spark, field):
    texts = ["Log 2024-01-15 10:30:00 start", "on 2024-01-15 10:30", "IBAN GB82 0044 0532 0130 00", "write jane.doe at example dot com"]
    got = [r.text for r in p.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).orderBy("doc_id").collect()]
    assert got == [*texts[:3], "write [EMAIL]"]
