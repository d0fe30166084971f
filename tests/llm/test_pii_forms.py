"""Usual forms of personal data, each between words and numbers, against a recogniser of their own."""

import random
import re

import pytest

from textweir.llm import pii

#: A recogniser per kind in plain Python: text of a form -> whether it is a right value of it.
def luhn(text):
    d = [int(c) for c in re.sub(r"\D", "", text)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def mod97(text):
    plain = re.sub(r"[^A-Z0-9]", "", text)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def day(text):
    import datetime

    a, b, c = (int(x) for x in re.findall(r"\d+", text))
    y, m, d = (a, b, c) if a > 99 else (c, b, a) if "." in text else (c, a, b)
    try:
        return 1800 <= datetime.date(y, m, d).year < 2200
    except ValueError:
        return False


FORMS = {
    "card": (luhn, ["4111 1111 1111 1111", "4111\u00a01111\u00a01111\u00a01111", "4111.1111.1111.1111", "4111\u20111111\u20111111\u20111111",
                    "3782 822463 10005", "4111111111111111", "6011-1111-1111-1117"]),
    "iban": (mod97, ["DE89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00", "GB82WEST12345698765432", "DE89\u202f3704\u202f0044\u202f0532\u202f0130\u202f00"]),
    "date": (day, ["2024-02-29", "2024/02/29", "29.02.2024", "1.2.1984", "02/29/2024", "2/9/1984", "31.1.1999"]),
    "phone": (lambda t: 7 <= len(re.sub(r"\D", "", t)) <= 15, ["+1 212 555 0100", "(+1) 212-555-0100", "212-555-0100", "212.555.0100", "(212) 555-0100",
              "+44 20 7946 0958", "+1\u00a0212\u00a0555\u00a00100"]),
    "ssn": (lambda t: True, ["123-45-6789"]), "ip": (lambda t: all(int(x) < 256 for x in t.split(".")), ["192.168.10.7"]),
    "mail": (lambda t: t.endswith("@mail.invalid"), ["josé@mail.com", "a@münchen.de", "x.y+z@a-b.example.org"]),
}
FRAMES = ["{}", "see {} now", "({})", "a: {}, b", "x ({}) 12", "7; {}; 8", "end {}."]


def shape(text):
    return re.sub(r"\d", "0", text)


def test_every_form_in_every_frame(spark):
    rows = [(kind, form, frame.format(form)) for kind, (_, forms) in FORMS.items() for form in forms for frame in FRAMES]
    rows += [("card", "4111111111111111", "Visa4111111111111111"), ("phone", "+1 212 555 0100", "Tel.+1 212 555 0100"),
             ("phone", "+1 212 555 0100", "Tel+1 212 555 0100"), ("date", "1.2.1984", "geb.1.2.1984")]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id int, text string").repartition(4)
    made = {r.doc_id: r for r in pii.pseudonymize(df, "k1").collect()}
    back = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame([(i, r.text) for i, r in made.items()], df.schema), "k1", back=True).collect()}
    seen = {}
    for i, (kind, form, text) in enumerate(rows):
        assert made[i].kinds == [kind], (text, made[i])
        before, after = text.split(form)
        got = made[i].text
        assert form not in got and got.startswith(before) and got.endswith(after), (text, got)
        value = got[len(before):len(got) - len(after)]
        assert FORMS[kind][0](value), (text, got)
        assert seen.setdefault(form, value) == value  # equal values stay linked
        if kind == "mail":
            continue
        if not (kind == "date" and shape(form) in ("0.0.0000", "0/0/0000", "00.0.0000")) and kind != "ip":
            assert shape(value) == shape(form), (form, value)
        assert back[i] == text, (text, got, back[i])


@pytest.mark.parametrize("text", ["version 1.2.3.4567", "in 2024/13/45 or 31.2.2020", "4111 1111 1111 1112", "112-555-0100", "a5b4111111111111111f",
                                  "12.34.56", "price 212.555", "DE88 3704 0044 0532 0130 00", "isbn 978-3-16-148410-0", "1-212-55", "a.b@c"])
def test_what_only_looks_like_one_stays(spark, text):
    got = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id int, text string"), "k").first()
    assert (got.text, got.kinds) == (text, [])


def test_short_dates_are_permuted_among_themselves(spark):
    rng = random.Random(6)
    dates = sorted({f"{rng.randint(1, 28)}.{rng.randint(1, 9)}.{rng.randint(1900, 2020)}" for _ in range(300)})
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "doc_id int, text string")
    got = [r.text for r in pii.pseudonymize(df, "k").orderBy("doc_id").collect()]
    assert len(set(got)) == len(dates) and all(day(g) and re.search(r"(^|\.)\d\.", g) for g in got)
