"""Personal data: detection against planted entities, round trips of the permutations, coreference and the collision check."""

import datetime
import ipaddress
import random
import time

import pytest

from chronolith.llm import pii

KEY = b"a key for tests"


def _planted(rng):
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = rng.choice("45") + digits(14)
        return body + str(pii._luhn(body))

    day = datetime.date.fromordinal(rng.randrange(datetime.date(1931, 1, 1).toordinal(), datetime.date(2024, 1, 1).toordinal()))
    name = rng.choice(["Anna", "Erik", "Jo"])
    family = rng.choice(["Marsh", "O'Neil", "Weiß"])[:5]
    return rng.choice(
        [
            ("email", f"{rng.choice('abcxyz')}.{digits(2)}@host{digits(1)}.example.org", "", ""),
            ("phone", f"+{rng.randrange(1, 99)} {digits(3)} {digits(7)}", "", ""),
            ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}", "", ""),
            ("ip", ".".join(str(rng.randrange(256)) for _ in range(4)), "", ""),
            ("ip6", ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)), "", ""),
            ("card", card(), "", ""),
            ("iban", "DE" + digits(20), "", ""),
            ("secret", digits(8) + "abcDEF" + digits(10), "token = ", ""),
            ("date", day.isoformat(), "born on ", ""),
            ("date", f"{day.day}.{day.month}.{day.year}", "geboren am ", ""),
            ("address", f"{rng.randrange(1, 999)} Old Mill Road", "", ""),
            ("address", f"Lindenallee {rng.randrange(1, 99)}", "", ""),
            ("given", name, "Ms. ", f" {family}" if family.isalpha() else " Stone"),
        ]
    )


def test_detection_finds_what_is_planted_and_nothing_else():
    rng = random.Random(3)
    words = "the of und la que house seven, run. Nothing here at noon; version 4.0 costs 12 or 1234567812345678 on 10:30 (a:b) x@y 3/4".split()
    for _ in range(600):
        text, want = "", []
        for _ in range(rng.randrange(1, 5)):
            text += " ".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) + " : "
            kind, value, before, after = _planted(rng)
            text += before
            want.append((len(text), len(text) + len(value), kind))
            text += value + after
            if after:
                want.append((len(text) - len(after) + 1, len(text), "family"))
            text += " ; "
        got = [x[:3] for x in pii.find(text)]
        named = {text[a:b] for a, b, k in want if k in ("given", "family")}
        assert [x for x in got if text[x[0] : x[1]] not in named] == [x for x in want if text[x[0] : x[1]] not in named], text
        assert set(want) <= set(got)
        new, n = pii.rewrite(text, KEY)
        assert n == len(want) - sum(k == "family" for *_, k in want) + sum(k == "family" and x[2] != "given" for x, (*_, k) in zip(got, got[1:]))
        for a, b, k in want:
            assert k in ("given", "family") or text[a:b] not in new
        assert [x[2] for x in pii.find(new)] == [x[2] for x in got]  # surrogates are of the same type


def test_permutations_are_whole():
    for size in (2, 3, 10, 37, 1000):
        for tweak in ("a", "b"):
            assert sorted(pii.permute(k, size, b"k", tweak) for k in range(size)) == list(range(size))
    assert [pii.permute(k, 1000, b"k", "a") for k in range(50)] != [pii.permute(k, 1000, b"l", "a") for k in range(50)]
    texts = [f"{a}{b}" for a in "xyz" for b in range(10)]
    assert len({pii._by_shape(t, KEY, "") for t in texts}) == 30
    long = ["a" * 100 + c + "b" * 300 for c in "abcdef"]
    new = [pii._by_shape(t, KEY, "") for t in long]
    assert len(set(new)) == 6 and all(len(t) == 401 for t in new) and len({t[200:] for t in new}) == 6


def test_surrogates_keep_type_and_format():
    rng = random.Random(8)
    for _ in range(50):
        card = pii.surrogate("card", "4111111111111111", "", KEY, rng.randrange(9))
        assert pii._luhn(card[:-1]) == int(card[-1])
        iban = pii.surrogate("iban", "DE89370400440532013000", "", KEY, rng.randrange(9))
        assert iban[:2] == "DE" and pii._iban_check("DE", iban[4:]) == iban[2:4]
    assert ipaddress.ip_address(pii.surrogate("ip6", "2001:db8::8a2e:370:7334", "", KEY))
    assert ipaddress.ip_address(pii.surrogate("ip", "97.51.17.173", "", KEY))
    assert pii.surface("date", "2.3.85", "1990-11-04") == "4.11.90" and pii.surface("date", "3/25/1985", "1990-11-04") == "11/04/1990"
    assert pii.surrogate("given", "anna", "f", KEY)[-1] == "a" and pii.surrogate("given", "иван", "m", KEY)[-1] in "нрлй"
    street = pii.surrogate("address", "Hauptstraße 12", "", KEY)
    assert street.split()[0].endswith("straße") and len(street.split()[1]) == 2 and "Haupt" not in street


def test_mentions_of_one_person_agree():
    text = "Dr. John Smith met Mr. John Smith. John Smith, JOHN and Smith left; Mrs. Smith and Bob.S@mail7.example.com, BOB.S@mail7.example.com stayed: +1 (017) 555-7713 or +1 017 555 7713. Johnson did too."
    new, n = pii.rewrite(text, KEY)
    w = new.replace(",", "").replace(".", "").replace(";", "").split()
    given, family = w[1], w[2]
    assert n == 10 and w[5:7] == [given, family] and w[7:9] == [given, family] and w[9] == given.upper() and w[11] == family and w[14] == family
    assert given.lower() == pii.surrogate("given", "john", "m", KEY) and new.endswith("Johnson did too.")
    mails = [x for x in new.split() if "@" in x]
    assert mails[0].lower().strip(",") == mails[1].lower() and mails[1][:3].isupper()
    digits = "".join(c for c in new.split(":")[1] if c.isdigit() or c == "+").split("+")
    assert digits[1] == digits[2] != "10175557713"


def test_one_gender_for_a_name_over_all_documents(spark):
    rows = [(1, "Dr. Kim Long was here"), (2, "Mrs. Kim Long was here"), (3, "Mrs. Kim Poe, too"), (4, "Mr. Kim Fry, too"), (None, "Prof. Kim Long"), (5, None), (6, ""), (7, "no one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_entities(docs, key=KEY).collect()}
    kim = pii.surrogate("given", "kim", "f", KEY).capitalize()
    assert all(got[i]["text"].split()[1] == kim for i in (1, 2, 3, 4, None))
    assert got[5]["text"] is None and got[6]["text"] == "" and got[7]["text"] == "no one"
    assert [got[i]["_n_entities"] for i in (1, 5, 6, 7)] == [1, 0, 0, 0]


def test_collisions_draw_again(spark):
    def clash(kind, canon, gender="", key=b"", attempt=0):
        return f"same{attempt}" if attempt < 2 else f"{canon}{attempt}"

    e = spark.createDataFrame([("family", n, "") for n in ("ann", "bob", "cyd")] + [("phone", "123", "")], "kind string, canon string, gender string")
    got = {r["canon"]: r["attempt"] for r in pii.collisions(e, KEY, make=clash).collect()}
    assert got == {"bob": 1, "cyd": 2}
    assert pii.collisions(e.where("canon = 'ann'"), KEY, make=clash).count() == 0
    with pytest.raises(RuntimeError):
        pii.collisions(e, KEY, rounds=3, make=lambda *_: "same")


def test_no_surrogate_is_an_entity_of_the_corpus(spark):
    # a shape that the corpus fills to nine tenths: permutations alone would map it onto itself
    mails = [f"{a}{b}@h.org" for a in "abcdefghijklmnopqrstuvwxyz" for b in range(10)][:230]
    docs = spark.createDataFrame([(k, f"write to {m} now") for k, m in enumerate(mails)], "doc_id long, text string")
    got = [r["text"].split()[2] for r in pii.replace_entities(docs, key=KEY).collect()]
    assert len(set(got)) == 230 and not set(got) & set(mails)
    numbers = [f"+1 555 {k:07d}" for k in range(500)]
    docs = spark.createDataFrame([(k, m) for k, m in enumerate(numbers)], "doc_id long, text string")
    got = {r["text"] for r in pii.replace_entities(docs, key=KEY).collect()}
    assert len(got) == 500 and not got & set(numbers)


@pytest.mark.parametrize("text", ["555-123-4567 " * 80_000, "aaaa.@" * 170_000, "a" * 10**6 + ".@", "a" * 10**6 + "@x.org", "Mr. Abc Def " * 80_000, "1." * 500_000, "token = " + "aB3" * 10**5])
def test_a_megabyte_takes_linear_time(text):
    start = time.time()
    pii.rewrite(text, KEY)
    assert time.time() - start < 10


def test_key_comes_from_the_session_or_is_new(spark):
    assert pii.configured_key(spark) != pii.configured_key(spark)
    spark.conf.set(pii.KEY_SETTING, "some key")
    assert pii.configured_key(spark) == b"some key"
    spark.conf.unset(pii.KEY_SETTING)
    with pytest.raises(TypeError):
        pii.replace_entities(spark.createDataFrame([("x",)], "text string"))
