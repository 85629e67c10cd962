"""Disguised identifiers put into clean text at known places, against the places; and clean text, which has none."""

import random

import pytest

from coinbrook.llm import pii

SPELLED = ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zero um dois três quatro cinco seis sete oito nove", "zero uno due tre quattro cinque sei sette otto nove", "nul een twee drie vier vijf zes zeven acht negen")
CLEAN = (
    "We looked at the result and arrived at noon.", "See the table at no.10 or at 5.pm today", "an error at main.py line 3", "He runs at U.S. pace, at e.g. six.", "null null null null null null null null null null null null null null",
    "one two or three of them met @ the cafe . It was late", "they live at St.Ives and point out the dot", "arrived at Dungeness point lighthouse", "visit us at example.com", "available at www.firma.ch", "un dos tres, un paso adelante",
)
FILLER = ("the report was long", "see below", "Zürich ist schön", "\U0001f600 ok")


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_has_no_spans(text):
    assert pii.find(text) == ([], [])


def test_letters_of_other_cases_are_no_crash():
    assert pii.find("one two ſix fıve one two three four five six seven") == ([], [])


def luhn_number(rng) -> str:
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


def disguised(rng) -> tuple[str, str]:
    """Kind and one disguised identifier."""
    name, host, end = rng.choice(("anna", "j.doe", "x_1")), rng.choice(("firma", "uni-4", "mail7")), rng.choice(("ch", "ac.jp", "com", "pl", "museum", "info"))
    last = end.rpartition(".")[2]
    words = rng.choice(SPELLED).split()
    spell = lambda digits: rng.choice((" ", "-")).join(words[int(d)] for d in digits)
    phone = "4" + "".join(rng.choice("0123456789") for _ in range(10))
    return rng.choice((
        ("email", f"{name} at {host}.{end}"), ("email", f"{name} @ {host}.{end}"), ("email", f"{name} @ {host} . {last}"), ("email", f"{name}[at]{host}(dot){last}"), ("email", f"{name} (arroba) {host} [punto] {last}"),
        ("email", f"{name} arroba {host} punto {last}"), ("email", f"{name} arobase {host} point {last}"), ("email", f"{name} at {host} punkt {last}"), ("email", f"{name} at {host} dot {last}"),
        ("card", spell(luhn_number(rng))), ("phone", f"+{spell(phone)}"), ("phone", f"{rng.choice(('plus', 'Plus', 'más', 'più', 'mais'))} {spell(phone)}"),
    ))


@pytest.mark.parametrize("seed", range(300))
def test_spans_are_where_they_were_put(seed):
    rng = random.Random(seed)
    text, want = "", []
    for _ in range(rng.randrange(1, 5)):
        kind, identifier = disguised(rng)
        text += f"{rng.choice(FILLER)}; "
        want.append((kind, len(text), len(text) + len(identifier)))
        text += f"{identifier}; "
    base, added = pii.find(text)
    assert not base and sorted(added) == sorted(want), text
    assert all(f"<{k.upper()}>" in pii.redacted(text) for k, _, _ in want)
