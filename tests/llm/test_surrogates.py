"""Surrogates against what was planted: nothing left, nothing mixed up, nothing lost."""

import random
import re

import pytest

from saltmarsh.llm import pii

SHORT = "doc_id long, text string"
KEY = b"key"


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_no_planted_value_is_left_and_the_map_is_one_to_one(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{''.join(rng.choices(letters, k=n))}@{''.join(rng.choices(letters, k=m))}.com" for n in (3, 41, 70, 200) for m in (1, 5, 61, 90) for _ in range(4)]
    numbers = [f"+{code} {rng.randrange(10**6, 10**7)} {rng.randrange(100, 1000)}" for code in (1, 7, 49, 44, 351, 972) for _ in range(4)]
    planted = list(dict.fromkeys([*mails, *numbers]))
    rows = [(i, f"note {i} about <{v}> and again <{v}>") for i, v in enumerate(planted)] + [(1000 + i, f"later: <{v}>") for i, v in enumerate(planted)]
    got = texts_of(pii.surrogates(spark.createDataFrame(rows, SHORT), KEY))
    mapped = {}
    for i, value in enumerate(planted):
        first, second = re.findall("<([^>]*)>", got[i])
        assert first == second == re.search("<([^>]*)>", got[1000 + i])[1]
        mapped[value] = first
    assert len(set(mapped.values())) == len(planted) and not set(mapped.values()) & set(planted)
    for value, other in mapped.items():
        assert len(other) >= len(value) and re.sub("[a-z]", "a", re.sub(r"\d", "0", other)).endswith(re.sub("[a-z]", "a", re.sub(r"\d", "0", value))[-20:])
        if value[0] == "+":
            assert other.split(" ")[0] == value.split(" ")[0]
        else:  # no run of the original is left
            local = value.split("@")[0]
            assert not any(local[k : k + 8] in other for k in range(len(local) - 7))


def test_addresses_that_could_collide_stay_apart(spark):
    mails = [f"{a}@{b}.io" for a in "abcdefghijklm" for b in "xyz"]
    got = texts_of(pii.surrogates(spark.createDataFrame(list(enumerate(mails)), SHORT), KEY))
    assert len(set(got.values())) == len(mails) and not set(got.values()) & set(mails)


def test_a_space_without_room_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda *_: "the same")
    with pytest.raises(ValueError, match="no surrogates left"):
        pii.drawn(spark.createDataFrame([("ip", "1.1.1.1", ""), ("ip", "1.1.1.2", "")], "kind string, value string, role string"), KEY, rounds=3)


def test_a_name_is_one_person_whatever_its_title(spark):
    texts = ["Dr. Xavier Vogel met Mr. Xavier Vogel.", "Mr. Xavier Vogel came.", "Ms. Kim Vogel and Dr. Kim Vogel.", "Vogel alone is not looked for here."]
    got = texts_of(pii.surrogates(spark.createDataFrame(list(enumerate(texts)), SHORT), KEY))
    given, surname, again, surname_again = re.match(r"Dr. (\w+) (\w+) met Mr. (\w+) (\w+).$", got[0]).groups()
    assert (given, surname) == (again, surname_again) and got[1] == f"Mr. {given} {surname} came."
    other = re.match(r"Ms. (\w+) (\w+) and Dr. (\w+) (\w+).$", got[2]).groups()
    assert other[:2] == other[2:] and other[1] == surname and other[0] not in (given, surname)
    assert got[3] == texts[3]


def test_different_name_words_never_share_a_surrogate(spark):
    words = [f"{a}{b}".title() for a in ("ka", "lo", "mi", "ru", "te", "vo") for b in ("ran", "dil", "sor", "tem", "bas")]
    texts = [f"{t} {w} {v} spoke" for t, w, v in zip(["Mr.", "Mrs.", "Dr."] * 20, words, words[7:] + words[:7], strict=False)]
    found = pii.surrogates(spark.createDataFrame(list(enumerate(texts)), SHORT), KEY).collect()
    mapped = {}
    for r in found:
        for old, new in zip(texts[r["doc_id"]].split(" ")[1:3], r["text"].split(" ")[1:3], strict=True):
            assert mapped.setdefault(old, new) == new
    assert len(set(mapped.values())) == len(mapped) == len(words)


@pytest.mark.parametrize(
    "text",
    [
        "Marie Curie <marie@lab.org> replied",
        "My name is Mehmet Öz and I live here",
        "then Zoë Vogel wrote a letter",
        "Best regards,\nŁukasz Żółty",
        "Dear Ngozi Okafor, thank you",
        "Контакт: Меня зовут Пётр Чайковский",
        "Contact: Ana de la Cruz",
    ],
)
def test_names_are_found_by_what_stands_beside_them(text):
    names = [text[m.start : m.end] for m in pii.mentions(text) if m.kind.startswith("name")]
    assert len(names) >= 2 and not any(x.lower() in ("best", "contact", "dear", "my") for x in names)


def test_no_mention_is_passed_over_and_clean_texts_stay(spark):
    import pyarrow as pa

    seen = ["Mr. Smith", "Dear Bob Stone, hi", "Hans Weber", "Lu Xun wrote it", "Ana Paz +34 600 123 456", "a_@b.co", "123-45-6789", "AB12 3456 7890 1234"]
    assert all(pii.hits(pa.array([t]))[0].as_py() for t in seen if pii.mentions(t))
    clean = ["The Company said so. Hello World, how are you?", "Dear Sir or Madam, version 1.2.3 of 2024-01-02", "A Great Day in New York", "x" * 200_000, "", None]
    got = texts_of(pii.surrogates(spark.createDataFrame(list(enumerate(clean)), SHORT), KEY))
    assert got == dict(enumerate(clean))


def test_other_columns_repeated_rows_and_long_texts(spark):
    long = "word " * 50_000 + "bob@example.com " * 2000
    rows = [(1, long, "x"), (1, long, "x"), (None, "bob@example.com", "y")]
    got = pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string, surrogate string"), KEY).collect()
    assert sorted(r["n_entities"] for r in got) == [1, 2000, 2000] and not any("bob@" in r["text"] for r in got)
    assert len({r["text"].split(" ")[-1] or r["text"].split(" ")[-2] for r in got}) == 1
