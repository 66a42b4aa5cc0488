"""Recall and precision of personal details on texts made here: other sentences, numbers, streets and names than those of the tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lumatwin.llm import personal

GIVEN = [a + b for a in ("Mar", "Hal", "Sev", "Ori", "Lud", "Tam", "Jor", "Vik", "Nel", "Bas") for b in ("ek", "wen", "ista", "ovic", "iel", "ane", "olt", "ymir")]
FAMILY = [a + b for a in ("Dorn", "Wick", "Halm", "Pell", "Strat", "Quen", "Morg", "Tarn", "Vess", "Lind") for b in ("feld", "mora", "grave", "holt", "ansky", "oux", "ert", "ides")]
STREETS = ["Orchard", "Mill Bank", "Saint Hilda's", "Upper Cross", "Kiln"]
TOWNS = ["Elmsworth", "North Pell", "Granholm"]
WORDS = "the negatives were scanned again on a rainy morning and everyone agreed that light from north was softer than before".split()


def details(rng):
    """(kind, value, sentence around it) of random details."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    g, f = rng.choice(GIVEN), rng.choice(FAMILY)
    mail = f"{g.lower()}.{f.lower()}{d(2)}@{rng.choice(['studio', 'mail.archive'])}.{rng.choice(['example', 'org', 'co.uk'])}"
    words = rng.choice([f"{g.lower()}{d(1)} (at) lab.example", f"{g.lower()}[at]photo[dot]example", f"{f.lower()} at desk dot example"])
    street = f"{rng.randint(1, 299)} {rng.choice(STREETS)} {rng.choice(['Road', 'Lane', 'Street', 'Avenue', 'Close'])}"
    german = f"{rng.choice(['Linden', 'Bahnhof', 'Garten'])}{rng.choice(['straße', 'weg', 'allee'])} {rng.randint(1, 99)}, {d(5)} {rng.choice(['Granholm', 'Elmsdorf'])}"
    french = f"{rng.randint(1, 99)}, rue {rng.choice(['des Lilas', 'du Moulin', 'de la Gare'])}, {d(5)} Granville"
    yield from (
        ("email", mail, f"Send them to {mail}, please."), ("email", mail, f"mailto:{mail}"), ("email", words, f"You reach us under {words}."),
        ("phone", p := f"+44 7{d(3)} {d(6)}", f"Ring {p} after six."), ("phone", p := f"+49 30 {d(4)} {d(4)}", f"Telefon: {p}"), ("phone", p := f"({rng.randint(201, 989)}) {rng.randint(201, 989)}-{d(4)}", f"or {p} in the evening"),
        ("phone", p := f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"Appelez le {p}."), ("phone", p := f"+1-{rng.randint(201, 989)}-{rng.randint(201, 989)}-{d(4)}", f"My mobile is {p}!"),
        ("id_number", n := f"{d(3)}-{d(2)}-{d(4)}", f"SSN {n} is on the form"), ("id_number", n := f"{rng.choice('ABCE')}{rng.choice('KLMN')}{d(7)}", f"passport {n}, valid"), ("id_number", n := f"{d(8)}{rng.choice('ABCDEFGHJ')}", f"DNI: {n}."),
        ("id_number", n := f"C01X{d(5)}T{d(2)}", f"Her passport no. {n} expired"), ("id_number", n := d(9), f"Identity card no: {n}"),
        ("address", street, f"He lives at {street}."), ("address", a := f"{street}, {rng.choice(TOWNS)}", f"Prints go to {a}."), ("address", a := f"{street}, Flat {rng.randint(1, 30)}, {rng.choice(TOWNS)}", f"to {a}; thanks"), ("address", german, f"Sie wohnt {german}."), ("address", french, f"au {french}."),
        ("name", v := f"{g} {f}", f"shown by {v} again"), ("name", v := f"{g} {rng.choice('ABCD')}. {f}", f"(c) {v}."), ("name", v := f"{g} van der {f}", f"with {v} in it"), ("name", v := f"{f}, {g}", f"Author: {v}; 2019"), ("name", v := f"{rng.choice('ABCD')}. {f}", f"Photo: {v}."),
    )


DECOYS = [
    "Serial 123-45-6789 of the lens", "order no. AB1234567", "album #2019-04-20", "on 2021-04-20 at 10:15", "IMG_20210420_101530.jpg", "ratio 3:2, f/2.8, 1/250 s", "see page 12 Street photography", "a way of seeing", "Lot 77, box 4",
    "version 1.2.3-4567", "posted by @marek at noon", "12 places to visit", "ISBN 978-3-16-148410-0", "The drive is 200 km", "device id no. 4658592", "look at the place names",
]


@pytest.fixture(scope="module")
def finder():
    listed = random.Random(0)
    return personal.Finder(personal.name_words(listed.sample(GIVEN, 60)), personal.name_words(listed.sample(FAMILY, 60)))


def test_recall_by_kind(finder):
    rng, all_, hit, extra = random.Random(5), Counter(), Counter(), 0
    for _ in range(150):
        fill = lambda: " ".join(rng.sample(WORDS, 6))
        rows = list(details(rng))
        rng.shuffle(rows)
        parts = [s for _, _, s in rows]
        text = "\n".join(f"{fill()}. {s} {fill()}." if not s.startswith("mailto") else f"<a href='{s}'>{fill()}</a>" for s in parts) + "\n" + "\n".join(f"{fill()}: {x}." for x in DECOYS)
        got = {(kind, text[a:b]) for a, b, kind in finder.spans(text)}
        wanted = {(k, v) for k, v, _ in rows}
        all_.update(k for k, _ in wanted)
        hit.update(k for k, _ in wanted & got)
        extra += len(got - wanted)
    recall = {k: hit[k] / all_[k] for k in all_}
    print({k: round(v, 4) for k, v in recall.items()}, extra, sum(all_.values()))
    assert all(v >= 0.97 for v in recall.values()), recall
    assert extra <= 0.02 * sum(all_.values())


def test_nothing_is_lost_far_from_its_anchor(finder):
    """Words of any length between a number and its street word, and cues with gaps."""
    long = "Q" + "u" * 300
    text = f"at 12 {long} {long} {long} Road. Serial  number : 123-45-6789, serial number:  987-65-4321"
    assert {(k, text[a:b]) for a, b, k in finder.spans(text)} == {("address", f"12 {long} {long} {long} Road")}


def test_unlisted_names_are_found_however_many_are_listed():
    """Stems and endings are matched where they stand; their products aren't built, so no number of them is too large."""
    stems, endings = [f"{x}{y}r" for x in "bcdfghjklm" for y in "aeiou"], [f"{x}{y}n" for x in "npqrstvwxz" for y in "aeiou"]
    rng = random.Random(1)
    names = [rng.choice(stems) + rng.choice(endings) for _ in range(1500)]
    words = personal.name_words(names)
    f = personal.Finder(words, personal.name_words([]))
    unlisted = [s.capitalize() + e for s in stems for e in endings if s + e not in words.whole]
    found = sum(bool(f.spans(f"by {n}!")) for n in unlisted)
    assert len(unlisted) > 1000 and found >= 0.75 * len(unlisted)
