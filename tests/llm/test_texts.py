"""Tokens, mixtures, survivors and personal details."""

from __future__ import annotations

import base64
import importlib.util
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumatwin.llm import mixing, personal, survivors, tokens

TEXTS = ["", None, " ", "plain text", "naïve café 你好 🙂👨‍👩‍👧", "<|endoftext|> is text", "a" * 20_000, "\r\n\t x​", "é vs é", "ÐŸÑ\u0080Ð¸", "\u0001\u0000z", "1234567890 " * 50]


def tiktoken_encoding():
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", "/opt/tokenizers/__init__.py")
    p = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(p)
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_another_library(spark, tiny):
    e = tiktoken_encoding()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "k long, text string, ids string")
    got = {r.k: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {k: e.encode_ordinary(t or "") for k, t in enumerate(TEXTS)}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert all(list(r.ids) == e.encode_ordinary(docs[r.doc_id] or "") for r in tokens.document_ids(spark, tiny).collect())


def test_round_trip_and_offsets(spark, tiny):
    assert tokens.round_trip(spark, tiny).where("NOT same").count() == 0
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, text string")
    for r in tokens.encode(df, offsets=True).collect():
        t = TEXTS[r.k] or ""
        assert tokens.decode(r.ids) == t and len(r.ids) == len(r.starts) == len(r.ends)
        covered = set()
        for a, b in zip(r.starts, r.ends):
            assert 0 <= a <= b <= len(t)
            covered.update(range(a, b))
        assert covered == set(range(len(t)))
    assert tokens.sizes(df).agg(F.sum("tokens")).first()[0] == tokens.encode(df).agg(F.sum(F.size("ids"))).first()[0]


def test_part_of_a_character(spark):
    ids = tokens.encode(spark.createDataFrame([("𝔘",)], "text string")).first().ids
    assert len(ids) > 1 and "�" in tokens.decode(ids[:1]) and tokens.decode(None) == ""
    assert len(tokens.byte_of_character()) == 256
    text = "naïve 𝔘 你好 🙂"
    whole = tokens.encode(spark.createDataFrame([(text,)], "text string")).first().ids
    d = tokens.Decoder()
    parts = [d.feed([k]) for k in whole]
    assert "".join(parts) == text and "" in parts and d.feed([], last=True) == ""
    assert d.feed(ids[:1]) == "" and d.feed([], last=True) == "�"


# --- mixing ---


def test_flight_keeps_its_totals():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400):
        x, p = [float(rng.randint(1, 500)) for _ in range(n)], [rng.choice([0.0, 1.0, rng.random()]) for _ in range(n)]
        q = mixing.flight(x, p, rng.random)
        assert sum(1e-9 < v < 1 - 1e-9 for v in q) <= 2
        assert sum(q) == pytest.approx(sum(p), abs=1e-4) and sum(a * b for a, b in zip(x, q)) == pytest.approx(sum(a * b for a, b in zip(x, p)), abs=0.1)
    same = mixing.flight([7.0] * 40, [0.25] * 40, rng.random)
    assert sum(same) == pytest.approx(10)


def test_flight_is_unbiased():
    rng, n = random.Random(2), 12
    x, p = [float(k % 5 + 1) for k in range(n)], [0.3 + 0.04 * k for k in range(n)]
    total = [0.0] * n
    for _ in range(4000):
        for k, v in enumerate(mixing.flight(x, p, rng.random)):
            total[k] += v
    assert all(abs(t / 4000 - v) < 0.04 for t, v in zip(total, p))


@pytest.mark.parametrize("chunk", [20_000, 150])
def test_mixture(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rng = random.Random(3)
    docs = [(k, rng.choice(["big", "big", " BIG", "small", "mid-size"]), rng.randint(0, 300)) for k in range(2000)] + [(9001, None, 5), (None, "big", 5), (9002, "big", None)]
    targets = [("m", "Big ", 0.5, 1, 0.5), ("m", "small", 0.3, 2, 0.5), ("m", "mid_size", 0.2, 3, 0.5), ("m", "none", 1.0, 9, 0.5), ("m", "none", 0.5, 9, 0.5), ("z", "big", None, 1, 1.0), ("w", "small", 1.0, 3, 5.0), (None, "big", 1.0, 1, 1.0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int, size_factor double")
    chosen, planned = mixing.mix(spark, d, t)
    rows = chosen.collect()
    assert len({(r.mix_id, r.source, r.doc_id) for r in rows}) == len(rows) and {r.mix_id for r in rows} == {"m", "w"}
    plan = {(r.mix_id, r.source): r for r in planned.collect()}
    got = {}
    for r in rows:
        assert 1 <= r.repeats <= plan[r.mix_id, r.source].max_repeats
        got[r.mix_id, r.source] = got.get((r.mix_id, r.source), 0) + r.tokens * r.repeats
    for key in (("m", "big"), ("m", "small"), ("m", "mid_size"), ("w", "small")):
        assert got[key] == pytest.approx(plan[key].planned_tokens, abs=3)
    assert plan["m", "none"].planned_tokens == 0 and plan["m", "none"].target_share == pytest.approx(0.5)
    small = sum(x for _, s, x in docs if s == "small")
    assert got["w", "small"] == 3 * small  # capped


# --- survivors ---


def test_votes(spark):
    rows = spark.createDataFrame([(1, 10, "f", "x", 1.0, 0.0), (1, 11, "f", "y", 0.6, 0.0), (1, 12, "f", "y", 0.6, 0.0), (1, 13, "f", "x", 0.1, 10.0), (2, 20, "f", "b", 1.0, 1.0), (2, 21, "f", "a", 1.0, 1.0)], "g long, s long, field_name string, value string, trust double, age double")
    got = {r.g: (r.value, r.s) for r in survivors.vote(rows, "g", "s", F.col("trust"), F.col("age"), 1.0).collect()}
    assert got == {1: ("y", 11), 2: ("b", 20)}


def test_hot_group(spark):
    """A group with most rows is ranked in ranges, all of it; the first of 3,000 members wins, whatever the others agree on."""
    rows = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("s"), F.lit("f").alias("field_name"), F.when(F.col("id") == 0, "first").otherwise("rest").alias("value"), F.struct("id").alias("precedence"))
    aged = survivors.positions(rows, "g", "precedence")
    assert aged.count() == 3000 and aged.agg(F.max("age")).first()[0] == 2999
    assert survivors.vote(aged, "g", "s", F.lit(1.0), F.col("age"), 1.0).first().value == "first"


def test_values_are_normalised(spark):
    cases = [("1000", "1000"), ("1e3", "1000"), (" 1000.0 ", "1000"), ("1.7E9", "1700000000"), ("-2.5", "-3"), ("Nikon ", "nikon"), ("", ""), (None, None), ("1.2.3", "1.2.3")]
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, v string")
    got = {r.k: r.n for r in df.select("k", survivors.normalised(F.col("v")).alias("n")).collect()}
    assert [got[k] for k in range(len(cases))] == [n for _, n in cases]


# --- personal details ---

PEOPLE = [(a + b, c + d) for a in ("Bri", "Corv", "Théo", "Zel") for b in ("da", "lin", "mond", "rane", "tis") for c in ("Brack", "Grö", "Ñar", "Ost") for d in ("by", "enko", "strand", "weld")][::3]

FOUND = [
    ("Write to info.brida+x@post.example.org.", {("email", "info.brida+x@post.example.org")}),
    ("a_b(at)lab(dot)invalid, c [at] studio.test or d.e at mail dot example dot net", {("email", "a_b(at)lab(dot)invalid"), ("email", "c [at] studio.test"), ("email", "d.e at mail dot example dot net")}),
    ("連絡先はx.y@photos.exampleまで", {("email", "x.y@photos.example")}),
    ("posted by @fog.index40 at dawn, look at IMG_1.jpg. It dot", set()),
    ("Call +44 7700 900206, +33 6 39 98 29 66 or +1 (202) 555‑0184 5 times", {("phone", "+44 7700 900206"), ("phone", "+33 6 39 98 29 66"), ("phone", "+1 (202) 555‑0184")}),
    ("0044 7700 900375; 030/23125297; 202.555.0155; (555) 555-0108; 555-0152; 01 99 00 33 43; +49 (0)30 23125 233", {("phone", p) for p in ("0044 7700 900375", "030/23125297", "202.555.0155", "(555) 555-0108", "555-0152", "01 99 00 33 43", "+49 (0)30 23125 233")}),
    ("SSN: 953 12 7909, XK9739874. Serial 953-20-3312 (serial 4658592) MODEL RELEASE 261-6462242", {("id_number", "953 12 7909"), ("id_number", "XK9739874")}),
    ("QQ 31 94 25 B and 110390-969H and 25354785D and ZZ57H6981N6 scan-227-20-7146.tif", {("id_number", x) for x in ("QQ 31 94 25 B", "110390-969H", "25354785D", "ZZ57H6981N6")}),
    ("Prints go to 63B Weir Lane, Flat 2, Harrow Quay ZQ4 1XX, second floor.", {("address", "63B Weir Lane, Flat 2, Harrow Quay ZQ4 1XX")}),
    ("My address is 6 Saltmarsh Road\r\nSkelby; the old one. Since 25 the shared drive is full, IN 2023 THE SHARED DRIVE WAS.", {("address", "6 Saltmarsh Road\r\nSkelby")}),
    ("an Gerberstraße 59, 00474 Dunmarrow. Die", {("address", "Gerberstraße 59, 00474 Dunmarrow")}),
    ("au 64 bis, rue des Tanneurs, 00845 Vellbrook. Le", {("address", "64 bis, rue des Tanneurs, 00845 Vellbrook")}),
    ("a Calle del Molino, 26, bajo, 00519 Harrow Quay.", {("address", "Calle del Molino, 26, bajo, 00519 Harrow Quay")}),
    ("Dr. Brida M. Gröby's camera, T. Ñarby, Ostenko, Zelmond and CORVLIN VAN OSTWELD", {("name", "Brida M. Gröby"), ("name", "T. Ñarby"), ("name", "Ostenko, Zelmond"), ("name", "CORVLIN VAN OSTWELD")}),
    ("zeltis brackby-ostby and Théorane\nNarweld, but Ostermere, most corn and @brida", {("name", "zeltis brackby-ostby"), ("name", "Théorane\nNarweld")}),
    (unicodedata.normalize("NFD", "Von Théolin Gröstrand."), {("name", unicodedata.normalize("NFD", "Théolin Gröstrand"))}),
    ("ThÃ©otis Brackby", {("name", "ThÃ©otis Brackby")}),
    ("", set()), ("\u0000�🙂" * 50, set()), ("x" * 200_000, set()), ("1-" * 50_000, set()), ("a@" * 20_000, set()),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([*[(k, g, f) for k, (g, f) in enumerate(PEOPLE)], (None, None, None)], "person_id int, given_name string, family_name string")


def test_found(spark, people):
    df = spark.createDataFrame([*[(k, t) for k, (t, _) in enumerate(FOUND)], (999, None)], "doc_id long, text string")
    got = {}
    for r in personal.found(df, people).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.value))
    for k, (text, expected) in enumerate(FOUND):
        assert got.get(k, set()) == expected, text[:80]
    assert 999 not in got


def test_redacted(spark, people):
    df = spark.createDataFrame([(1, "Mail Brida Gröby, a@b.example,\r\n+44 7700 900206!"), (2, None), (3, "nothing here ")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in personal.redacted(df, people).collect()}
    assert got == {1: "Mail [NAME], [EMAIL],\r\n[PHONE]!", 2: None, 3: "nothing here "}


def test_long_lists_of_people(spark, people, monkeypatch):
    """A list too long to be sent to every task gives the same details and the same texts."""
    df = spark.createDataFrame([*[(k, t) for k, (t, _) in enumerate(FOUND)], (999, None), (1000, FOUND[0][0])], "doc_id long, text string")
    both = lambda: ({tuple(r) for r in personal.found(df, people).collect()}, {tuple(r) for r in personal.redacted(df, people).collect()})
    short = both()
    monkeypatch.setattr(personal, "MOST_NAMES", 3)
    assert personal.known_names(people) is None and both() == short


def test_values_stand_in_their_texts(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = personal.details(spark, tiny).collect()
    assert len(rows) == len({(r.doc_id, r.kind, r.value) for r in rows}) > 20 and {r.kind for r in rows} <= set(personal.KINDS)
    assert all(r.value in docs[r.doc_id] for r in rows)


def test_names_without_a_list(spark):
    df = spark.createDataFrame([(1, "Brida Gröby a@b.example")], "doc_id long, text string")
    none = spark.createDataFrame([], "person_id int, given_name string, family_name string")
    assert [tuple(r) for r in personal.found(df, none).collect()] == [(1, "email", "a@b.example")]
