"""Pseudonyms against a plain Python permutation, and the formats they keep."""

import hashlib
import random
import re

import pytest

from lodespark.llm import pii as P


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def keyed(key, *parts):
    return sha(key, sha(key, *parts))


def permuted(value, a, b, kind, key):
    left, right = divmod(value, b)
    for i in range(P.ROUNDS):
        if i % 2 == 0:
            left = (left + int(keyed(key, kind, a, b, i, right)[:12], 16)) % a
        else:
            right = (right + int(keyed(key, kind, a, b, i, left)[:12], 16)) % b
    return left * b + right


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10


def run(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id bigint, text string, extra string")
    return {r.doc_id: r for r in P.pseudonymize(docs, more.get("key", "k")).collect()}


def test_permutation_is_the_plain_one_and_one_to_one(spark):
    for a, b in ((10, 10), (10, 100), (21, 13)):
        made = [r[0] for r in spark.range(a * b).selectExpr(P.permuted("id", f"{a}L", f"{b}L", "x", "k")).collect()]
        assert sorted(made) == list(range(a * b)) and made == [permuted(v, a, b, "x", "k") for v in range(a * b)]


def test_formats(spark):
    out = run(spark, ["call +1 (017) 555-7713.", "4845168114407329 or 4845-1681-1440-7329", "97.51.17.173", "2024-02-29, 29/02/2024", "078-05-1120", "Und.34@mail7.example.com und", 'token = "04dbebab91ab8568a1b2c3d4e5f60718293a4b5c"'])
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.", out[0].text) and "017" not in out[0].text
    plain, dashed = re.fullmatch(r"(\d{16}) or (\d{4}-\d{4}-\d{4}-\d{4})", out[1].text).groups()
    assert luhn(plain) == 0 and dashed.replace("-", "") == plain != "4845168114407329"
    assert all(int(o) < 256 for o in out[2].text.split(".")) and len(out[2].text.split(".")) == 4
    iso, slashed = out[3].text.split(", ")
    assert slashed == "/".join(reversed(iso.split("-")))
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", out[4].text) and out[4].text != "078-05-1120"
    assert re.fullmatch(r"[0-9a-f]{12}@[0-9a-f]{8}\.invalid und", out[5].text)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[6].text) and "04dbebab" not in out[6].text
    assert [out[i].pii_kinds for i in range(7)] == [["phone"], ["card", "card"], ["address"], ["date", "date"], ["ssn"], ["mail"], ["secret"]]


def test_what_fails_its_check_stays(spark):
    texts = ["4845168114407328", "300.1.1.1", "1.2.3.4.5", "2023-02-30", "000-12-3456", "12345678901234567890123", None, "", "no number", "a@b", "0123456789" * 4, "x" * 50_000]
    out = run(spark, texts)
    assert [out[i].text for i in range(len(texts))] == texts and not any(out[i].pii_kinds for i in range(len(texts)))
    assert out[0].extra == "e"


def test_equal_values_stay_linked_and_the_key_decides(spark):
    text = "a 97.51.17.173 b 97.51.17.173"
    first, other = run(spark, [text, text[2:14]]), run(spark, [text], key="other")
    a, b = re.findall(r"[\d.]{7,}", first[0].text)
    assert a == b == first[1].text and a not in other[0].text


def test_empty_table(spark):
    assert P.pseudonymize(spark.createDataFrame([], "doc_id bigint, text string"), "k").count() == 0


def one_to_one(spark, texts, kind):
    """Pseudonyms of many values, each in a row; all of one kind, unlike each other, and each passes as that kind again."""
    out = run(spark, texts)
    made = [out[i].text for i in range(len(texts))]
    assert all(out[i].pii_kinds == [kind] for i in range(len(texts))) and len(set(made)) == len(set(texts))
    again = run(spark, made)
    assert all(again[i].pii_kinds == [kind] for i in range(len(made)))
    return made


def test_dates_of_all_readings_are_one_to_one(spark):
    import datetime

    days = [datetime.date(2000, 1, 1) + datetime.timedelta(n) for n in range(1500)]
    texts = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    made = one_to_one(spark, texts, "date")
    for t, m in zip(texts, made, strict=True):  # what can't be read day first stays so
        assert (int(t[3:5]) > 12) == (int(m[3:5]) > 12)
    dotted = one_to_one(spark, [d.strftime("%d.%m.%Y") for d in days], "date")
    iso = one_to_one(spark, [d.strftime("%Y-%m-%d") + "T10:00:00Z" for d in days], "date")
    assert [x[:10] for x in iso] == ["-".join(reversed(x.split("."))) for x in dotted] and all(x.endswith("T10:00:00Z") for x in iso)


def test_numbers_with_checks_are_one_to_one(spark):
    rnd = random.Random(3)
    social = sorted({f"{rnd.choice([1, 77, 665, 667, 899]):03d}-{rnd.randrange(1, 100):02d}-{rnd.randrange(1, 10000):04d}" for _ in range(3000)})
    for m in one_to_one(spark, social, "ssn"):
        assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", m)
    phones = sorted({f"+1 ({rnd.randrange(200, 1000)}) {rnd.randrange(200, 1000)}-{rnd.randrange(10000):04d}" for _ in range(2000)})
    for m in one_to_one(spark, phones, "phone"):
        assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", m)
    bare = run(spark, [re.sub(r"[^+\d]", "", phones[0])])[0].text
    assert bare == re.sub(r"[^+\d]", "", run(spark, phones[:1])[0].text)
    for m in one_to_one(spark, sorted({f"+44 20 {rnd.randrange(1000, 9999)} {rnd.randrange(1000, 9999)}" for _ in range(500)}), "phone"):
        assert m.startswith("+44 ")
    cards = sorted({(c := f"4{rnd.randrange(10**14):014d}") + next(x for x in "0123456789" if luhn(c + x) == 0) for _ in range(1000)})
    assert all(luhn(m) == 0 for m in one_to_one(spark, cards, "card"))


def iban(country, own):
    number = "".join(str(int(c, 36)) for c in own + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{own}"


def test_ibans(spark):
    rnd = random.Random(4)
    texts = sorted({iban("DE", f"{rnd.randrange(10**18):018d}") for _ in range(400)} | {iban("GB", f"WEST{rnd.randrange(10**14):014d}") for _ in range(400)} | {iban("FR", f"{rnd.randrange(10**22):022d}P") for _ in range(9)})
    for t, m in zip(texts, one_to_one(spark, texts, "iban"), strict=True):
        assert m == iban(m[:2], m[4:]) and m[:2] == t[:2] and re.sub("[0-9]", "", m) == re.sub("[0-9]", "", t)
    out = run(spark, ["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "GB83WEST12345698765432"])
    assert out[0].text.replace(" ", "") == out[1].text != "GB82WEST12345698765432" and out[0].text[4] == " " and out[2].pii_kinds == []


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError, match="key"):
        P.pseudonymize(spark.createDataFrame([], "text string"), "")


def test_columns_of_any_name_and_long_texts(spark):
    names = ["found", "made", "_found", "v", "m", "s", "i", "x", "j", "gap", "k"]
    text = "word " * 200_000 + "97.51.17.173"
    docs = spark.createDataFrame([(1, text, *range(len(names)))], ", ".join(["doc_id bigint", "text string", *(f"{n} int" for n in names)]))
    out = P.pseudonymize(docs, "k").first()
    assert [out[n] for n in names] == list(range(len(names))) and out.pii_kinds == ["address"]
    assert out.text.rpartition(" ")[0] == text.rpartition(" ")[0] and out.text != text
