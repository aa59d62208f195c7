"""Pseudonyms: valid, of the same format, one to one, never the value itself; the rest of a text untouched."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from rows import awkward, empty

from linkloom.llm import pii


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mapped(spark, values, key="k"):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.p for r in df.select("v", pii.pseudonym(F.col("v"), key).alias("p")).collect()}


def shape(s):
    return re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))


def test_cards(spark):
    good = [s for i in range(300) if luhn(s := f"4{i:012d}{i % 10}{i % 7}{i * 3 % 10}")]
    bad = [s for i in range(40) if not luhn(s := f"5{i:015d}")]
    got = mapped(spark, good + bad + ["4111-1111-1111-1111", "4111 1111 1111 1111"])
    assert all(got[s] == s for s in bad)
    assert all(got[s] != s and luhn(got[s]) and len(got[s]) == len(s) for s in good)
    assert len({got[s] for s in good}) == len(good)
    assert re.sub("[ -]", "", got["4111-1111-1111-1111"]) == re.sub("[ -]", "", got["4111 1111 1111 1111"])
    assert shape(got["4111-1111-1111-1111"]) == "9999-9999-9999-9999"


def test_dates_are_one_to_one(spark):
    days = [dt.date(1900, 1, 1) + dt.timedelta(i * 37) for i in range(1900)]
    got = mapped(spark, [f"{d:%Y-%m-%d}" for d in days])
    assert len(set(got.values())) == len(days) and all(k != v for k, v in got.items())
    assert all(1900 <= dt.date.fromisoformat(v).year < 2100 for v in got.values())
    same = mapped(spark, ["2020-02-29", "2020/02/29", "29.02.2020", "02/29/2020", "2021-02-29", "30/40/2020", "2020-02/29", "1850-01-01"])
    iso = dt.date.fromisoformat(same["2020-02-29"])
    assert same["2020/02/29"] == f"{iso:%Y/%m/%d}" and same["29.02.2020"] == f"{iso:%d.%m.%Y}" and same["02/29/2020"] == f"{iso:%m/%d/%Y}"
    assert all(same[x] == x for x in ("2021-02-29", "30/40/2020", "2020-02/29", "1850-01-01"))


def test_small_networks_are_permutations(spark):
    for n in (1, 2, 3):
        rows = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
        got = {r.d: r.p for r in rows.select("d", pii.permute_digits(F.col("d"), "k", "t").alias("p")).collect()}
        assert sorted(got.values()) == sorted(got) and all(a != b for a, b in got.items())
    names = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.p for r in rows.select("n", pii.permute_name(F.col("n"), "k", "t").alias("p")).collect()}
    assert sorted(got.values()) == sorted(names) and all(a != b for a, b in got.items())


def test_other_formats(spark):
    got = mapped(spark, ["+1 (017) 555-7713", "97.51.17.173", "256.1.1.1", "078-05-1120", "000-12-3456", "666-12-3456", "Jo.Doe+x7@mail7.example.com", "+49 30 1234567"])
    assert got["256.1.1.1"] == "256.1.1.1" and got["000-12-3456"] == "000-12-3456" and got["666-12-3456"] == "666-12-3456"
    assert shape(got["+1 (017) 555-7713"]) == "+9 (999) 999-9999" and got["+1 (017) 555-7713"].startswith("+1 (")
    assert got["+49 30 1234567"].startswith("+49 ")
    assert all(0 <= int(x) < 256 for x in got["97.51.17.173"].split("."))
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", got["078-05-1120"])
    mail = got["Jo.Doe+x7@mail7.example.com"]
    assert shape(mail) == shape("Jo.Doe+x7@mail7.example.com") and mail.endswith("@mail7.example.com")
    assert all(k != v for k, v in got.items() if k[0] not in "206")


TEXT = "Call +1 (017) 555-7713 or a.b@mail.example.com, card 4111111111111111!! from 97.51.17.173. On 2020-02-29 paid 12.50, not 4111111111111112 nor v1.2.3.4.5."


def test_texts(spark):
    docs = awkward(spark, [TEXT, TEXT + TEXT, "é" + TEXT])
    new = pii.pseudonymize(docs, "k")
    assert new.columns == docs.columns and new.schema == docs.schema
    before, after = ({(r.doc_id, r.n_chars): r.text for r in x.collect()} for x in (docs, new))
    assert all(after[k] == v for k, v in before.items() if (k[0] or 0) < 100)
    one = after[(100, len(TEXT))]
    assert after[(101, 2 * len(TEXT))] == 2 * one and after[(102, len(TEXT) + 1)] == "é" + one
    for secret in ("555-7713", "a.b@", "4111111111111111", "97.51.17.173", "2020-02-29"):
        assert secret not in one
    for kept in ("paid 12.50, not 4111111111111112 nor v1.2.3.4.5.", "Call +1 (", "@mail.example.com, card "):
        assert kept in one
    told = {r.doc_id: r for r in pii.found_values(docs, "k").where("doc_id >= 100").collect()}
    assert [told[i].text for i in (100, 101, 102)] == [one, 2 * one, "é" + one]
    assert [s.kind for s in told[100].spans] == ["phone", "email", "card", "ipv4", "date"]
    assert all(one[s.s : s.e] == s.pseudonym or len(one[: s.s]) for s in told[100].spans)


def test_empty(spark):
    assert pii.pseudonymize(empty(spark), "k").count() == 0 and pii.found_values(empty(spark), "k").count() == 0


def test_values_beside_numbers(spark):
    card, spaced, ssn, date = "4111111111111111", "4111 1111 1111 1111", "078-05-1120", "2024-01-05"
    cases = {
        f"{card} 12 items": [card], f"{spaced} 12/27": [spaced], f"{spaced} 123": [spaced], f"4 {card}": [card], f"Invoice 12345 {date}": [date],
        f"id 7 {date} {ssn}": [date, ssn], f"1234 {spaced}": [spaced], f"{spaced} 05.01.2024": [spaced, "05.01.2024"], f"{card} 97.51.17.173": [card, "97.51.17.173"],
        f"{card} {card} 5 {spaced}": [card, card, spaced], "3782 822463 10005 1234": ["3782 822463 10005"], f"{spaced} 12abc": [spaced], f"4111-1111-1111-1111 123 {date}": ["4111-1111-1111-1111", date],
        f"+49 30 1234567 {spaced}": ["+49 30 1234567", spaced], f"+1 (017) 555-7713 {date}": ["+1 (017) 555-7713", date], f"{card} 12@mail.example.com": [card, "12@mail.example.com"],
        "41 1111 1111 1111 11": ["41 1111 1111 1111 11"], "+49 123-45-6789": ["+49 123-45-6789"], "12345 " * 3000 + card: [card], "4111111111111112 12 items": [], f"{card}-abc": [],
    }
    texts = list(cases)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    new = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k").collect()}
    rows = pii.found_values(docs, "k").collect()
    got = {texts[r.doc_id][-60:]: [texts[r.doc_id][x.s : x.e] for x in r.spans] for r in rows}
    assert got == {x[-60:]: v for x, v in cases.items()}
    assert all(new[r.doc_id] == r.text and re.sub("9+", "9", shape(r.text)) == re.sub("9+", "9", shape(texts[r.doc_id])) for r in rows)


def test_keys(spark):
    docs = spark.createDataFrame([(1, "card 4111111111111111", "a", "b", "c")], "doc_id bigint, text string, __left string, __own string, __pii string")
    one = pii.pseudonymize(docs, "one").first()
    assert one == pii.pseudonymize(docs, "one").first() and one.text != pii.pseudonymize(docs, "two").first().text
    assert (one["__left"], one["__own"], one["__pii"]) == ("a", "b", "c")
    with pytest.raises(ValueError):
        pii.pseudonymize(docs, "")
    assert pii.run_key(spark) != pii.run_key(spark)
    spark.conf.set(pii.KEY_SETTING, "kept")
    try:
        assert pii.run_key(spark) == "kept"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
