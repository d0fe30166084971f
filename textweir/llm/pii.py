"""Format-preserving pseudonyms of personal data, in DataFrame functions only.

Validated numbers and dates go through a keyed Feistel network on exactly the values of their
format, so a pseudonym is a valid value of the same format, equal values have equal
pseudonyms in all documents, and the holder of the key can invert them:

=========  ====================================================================  =====================
kind       recognised                                                            permuted
=========  ====================================================================  =====================
card       13 to 19 digits with a right Luhn sum; blanks, hyphens, dots inside   all but the check digit
iban       right remainder modulo 97; blanks and hyphens inside                  digits of the account part
ssn        123-45-6789 with a possible area, group and serial number             possible numbers
ip         four numbers up to 255                                                32-bit addresses
date       1800 to 2199 as 2024-02-29, 2024/02/29, 29.02.2024 or 02/29/2024,     days (146,097 of them), or days
           the last two also as 1.2.2024                                         with a one-digit day or month
phone      7 to 15 digits that begin with + or (+, or an area code in            the last 7, 8, 9 or 10 digits
           parentheses; 212-555-0100 and 212.555.0100
=========  ====================================================================  =====================

Blanks and hyphens are those of Unicode. Mail addresses are neither numbers nor dates: they become a keyed hash at ``mail.invalid``.

Every place where a kind may begin is tried, each with all ends at a boundary of its groups, so a number is
found whatever words or numbers stand beside it. What is `sure` (see ``_forms``) goes before what is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_BLANK, _HYPHEN = " \u00a0\u2007\u2009\u202f", "\u2010-\u2013-"
#: What may stand between the groups of a number; of an IBAN; between those of a plain phone number.
SEP, IBAN_SEP, HYPHEN = f"[{_BLANK}.{_HYPHEN}]", f"[{_BLANK}{_HYPHEN}]", f"[{_HYPHEN}]"
_ADDRESS = r"\p{L}\p{N}"
MAIL = rf"(?<![{_ADDRESS}._%+-])[{_ADDRESS}._%+-]++@[{_ADDRESS}-]++(?:\.[{_ADDRESS}-]++)+"
IBAN = rf"(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:{IBAN_SEP}?[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"
_AREA = rf"{SEP}?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}}){SEP}?"
_PLAIN = rf"[2-9][0-9]{{2}}(?:{HYPHEN}[0-9]{{3}}{HYPHEN}|\.[0-9]{{3}}\.)[0-9]{{4}}"
PHONE = (rf"(?:(?:(?<![0-9+])\+[0-9]{{1,3}}{_AREA}|(?<![0-9A-Za-z+])\(\+[0-9]{{1,3}}\){_AREA}|(?<![A-Za-z0-9+-])\([0-9]{{2,4}}\){SEP}?)"
         rf"[0-9]{{2,4}}(?:{SEP}?[0-9]{{2,4}}){{1,3}}(?![0-9])"
         rf"|(?<![0-9A-Za-z+])(?<![0-9][{_BLANK}.{_HYPHEN}(])(?<![{_HYPHEN}]){_PLAIN}(?![0-9A-Za-z]|[.{_HYPHEN}][0-9]))")
IP = r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
DATE = (r"(?<![0-9A-Za-z/-])(?<![0-9]\.)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
        r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?!(?![Tt][0-9]{2}:?[0-9]{2})[0-9A-Za-z]|[./-][0-9])")
CARD = rf"(?<![0-9])(?<![0-9][A-Za-z])[0-9](?:{SEP}?[0-9]){{12,18}}(?![0-9A-Za-z])"
#: Earlier kinds win where two begin at the same place.
ANY = "|".join((MAIL, IBAN, PHONE, IP, SSN, DATE, CARD))
#: Each place where one may begin, without taking its text; group 1 is what decides about it (no number is longer).
START = rf"(?=(?:{ANY}))(?=({MAIL}|[^\n]{{1,100}}))"
#: Groupings in which cards are written.
CARD_SHAPE = (rf"^(?:[0-9]{{13,19}}|[0-9]{{4}}({SEP})[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}(?:\1[0-9]{{3}})?|[0-9]{{4}}({SEP})[0-9]{{6}}\2[0-9]{{4,5}})$")
#: Numbers of the North American plan, whose length is known.
PHONE_SHAPE = rf"^(?:\(?\+1(?:[^0-9]*[0-9]){{10}}|\([0-9]{{3}}\){SEP}?[0-9]{{3}}{SEP}?[0-9]{{4}}|{_PLAIN})$"
#: Characters of an IBAN by country.
IBAN_LENGTH = {code: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for code in codes.split()}

DAYS = 146_097  # of 400 Gregorian years; 189 * 773
_FIRST_DAY = "1800-01-01"


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(v)`` with ``value`` computed once."""
    return F.transform(F.array(value), make)[0]


def feistel(left: Column, right: Column, m: Column | int, n: Column | int, key: str, tweak: Column, back: bool = False) -> Column:
    """struct(l, r): a permutation of the pairs below ``m`` and ``n``, keyed by ``key`` and ``tweak``.

    Round i adds a hash of the other half modulo the half's size: SHA-256 of
    ``key|tweak|i|half``, its first 15 hex digits. ``back`` runs the rounds in reverse.
    """
    m, n = (F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (m, n))

    def noise(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        word = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
        return -word if back else word

    def round_(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, F.pmod(s["l"] + F.pmod(noise(i, s["r"]), m), m)).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(noise(i, s["l"]), n), n)).alias("r"))

    rounds = F.lit(list(range(ROUNDS))[::-1] if back else list(range(ROUNDS)))
    return F.aggregate(rounds, F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), round_)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """Another string of as many digits (2 to 36); the permutation depends on their number."""
    def swap(d: Column) -> Column:
        half = F.floor(F.char_length(d) / 2).cast("int")
        rest = F.char_length(d) - half
        tweak = F.concat(F.lit(kind), F.char_length(d).cast("string"))
        pair = feistel(F.left(d, half), F.right(d, rest), _power(half), _power(rest), key, tweak, back)
        return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))

    return _let(digits, swap)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    chars = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(chars, start, lambda s, c: F.when(c.between("0", "9") & (F.char_length(c) == 1), F.struct(
        F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The check digit that makes ``digits`` and it a right card number."""
    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, b: a + b)
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(chars: Column) -> Column:
    """Remainder modulo 97 of digits and letters (A is 10)."""
    def step(acc: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return F.pmod(acc * F.when(value < 10, 10).otherwise(100) + value, F.lit(97)).cast("int")

    return F.aggregate(F.split(chars, ""), F.lit(0), step)


def _walk(value: Column, step: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """``value`` after as many more steps of a permutation as it takes until it fits: a permutation of what fits.

    Half of the values or more fit; one that took 200 steps (a chance of 1 in 10^60) ends the job, and does not go out wrong.
    """
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(200)), value, lambda v, _: F.when(fits(v), v).otherwise(step(v)))
    return _let(walked, lambda v: F.when(fits(v), v).otherwise(F.raise_error("no pseudonym of the same format").cast("string")))


def _right_card(digits: Column) -> Column:
    return _let(digits, lambda d: _luhn(F.substr(d, F.lit(1), F.char_length(d) - 1)) == F.right(d, F.lit(1)))


def _card(x: Column, key: str, back: bool, refused: Column) -> Column:
    """``refused``: digits of the forms that were tried before ``x`` at its place. They must stay wrong, or the
    inversion would take them: the permutation is repeated until they are, which keeps it one."""
    def change(d: Column) -> Column:
        def swap(v: Column) -> Column:
            return _let(permute_digits(F.substr(v, F.lit(1), F.char_length(v) - 1), key, "card", back),
                        lambda b: F.concat(b, _luhn(b)))

        def fits(v: Column) -> Column:
            return F.forall(refused, lambda o: ~_right_card(
                F.concat(F.left(v, F.char_length(o)), F.substr(o, F.char_length(v) + 1, F.lit(19)))))

        return _refill(x, _walk(swap(d), swap, fits))

    return _let(_digits(x), change)


def _iban(x: Column, key: str, back: bool) -> Column:
    def change(plain: Column) -> Column:
        head, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
        right = _mod97(F.concat(body, F.substring(plain, 1, 4))) == 1
        changed = F.when(F.char_length(_digits(body)) >= 2, _refill(body, permute_digits(_digits(body), key, "iban", back)))
        return F.when(right, _let(changed, lambda b: _refill(x, F.concat(
            F.lpad((98 - _mod97(F.concat(b, head, F.lit("00")))).cast("string"), 2, "0"), _digits(b)))))

    return _let(F.regexp_replace(x, IBAN_SEP, ""), change)


def _ssn(x: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(x, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)  # 898 possible areas
    pair = feistel(place * 99 + (group - 1), serial - 1, 898 * 99, 9999, key, F.lit("ssn"), back)

    def show(p: Column) -> Column:
        at = F.floor(p["l"] / 99).cast("int")
        return F.format_string("%03d-%02d-%04d", at + F.when(at >= 665, 2).otherwise(1),
                               (p["l"] % 99 + 1).cast("int"), (p["r"] + 1).cast("int"))

    return F.when(good, _let(pair, show))


def _ip(x: Column, key: str, back: bool) -> Column:
    part = F.transform(F.split(x, r"\."), lambda c: c.cast("int"))
    pair = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536, key, F.lit("ip"), back)
    byte = lambda v: (F.shiftright(v, 8).cast("string"), F.pmod(v, F.lit(256)).cast("string"))
    return _let(pair, lambda p: F.concat_ws(".", *byte(p["l"]), *byte(p["r"])))


def _date(x: Column, key: str, back: bool) -> Column:
    short = x.rlike(r"(?:^|[./])[0-9][./]")  # a day or month of one digit: stays one of those
    layouts = (("-", "yyyy-MM-dd", "yyyy-MM-dd"), (".", "dd.MM.yyyy", "d.M.yyyy"), ("/", "MM/dd/yyyy", "M/d/yyyy"))

    def swap(day: Column) -> Column:
        pair = feistel(F.floor(day / 773), F.pmod(day, F.lit(773)), 189, 773, key, F.lit("date"), back)
        return _let(pair, lambda p: p["l"] * 773 + p["r"])

    def date_of(day: Column) -> Column:
        return F.date_add(F.lit(_FIRST_DAY).cast("date"), day.cast("int"))

    def fits(text: Column) -> Column:
        date = date_of(text.cast("bigint"))
        return ~short | (F.dayofmonth(date) < 10) | (F.month(date) < 10)

    def change(iso: Column) -> Column:
        # a day that the calendar lacks is not a date
        day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date"))
        step = lambda v: swap(v.cast("bigint")).cast("string")
        moved = date_of(_walk(step(day.cast("string")), step, fits).cast("bigint"))

        def show(date: Column) -> Column:
            shown = F.when(x.rlike("^[0-9]{4}/"), F.date_format(date, "yyyy/MM/dd"))
            for mark, full, bare in layouts:
                shown = shown.when(F.contains(x, F.lit(mark)), F.when(short, F.date_format(date, bare)).otherwise(F.date_format(date, full)))
            return shown

        return F.when(day.between(0, DAYS - 1), _let(moved, show))

    def padded(order: str) -> Column:
        parts = F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
        return F.concat_ws("-", *(F.lpad(F.get(parts, F.lit(int(i))), 4 if n == 0 else 2, "0") for n, i in enumerate(order)))

    iso = (F.when(F.contains(x, F.lit("-")) | x.rlike("^[0-9]{4}/"), F.replace(x, F.lit("/"), F.lit("-")))
           .when(F.contains(x, F.lit(".")), padded("210")).otherwise(padded("201")))
    return _let(iso, change)


def _phone(x: Column, key: str, back: bool) -> Column:
    def change(d: Column) -> Column:
        n = F.char_length(d)
        # a country code stays, and the area code of a plain number
        own = (F.when(F.contains(x, F.lit("+")), F.least(F.lit(10), n - 1)).when(x.rlike(f"^{_PLAIN}$"), F.lit(7))
               .otherwise(F.least(F.lit(10), n)))
        return F.when(n.between(7, 15), _refill(x, F.concat(
            F.substr(d, F.lit(1), n - own), permute_digits(F.right(d, own), key, "phone", back))))

    return _let(_digits(x), change)


def _mail(x: Column, key: str) -> Column:
    return F.concat(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(x)), 256), 1, 16),
                    F.lit("@mail.invalid"))


def _prefixes(form: Column, group: str) -> Column:
    """``form`` cut after each of its groups, the longest first."""
    def cut(parts: Column) -> Column:
        return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), ""))

    return F.when(form != "", _let(F.regexp_extract_all(form, F.lit(group), F.lit(0)), cut)).otherwise(
        F.array().cast("array<string>"))


def _form(kind: str, raw: Column, sure: Column, refused: Column | None = None) -> Column:
    refused = F.array().cast("array<string>") if refused is None else refused
    return F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), sure.alias("sure"), refused.alias("refused"))


def _forms(x: Column, key: str) -> Column:
    """What may be meant at the beginning of ``x``, best first: array of struct(kind, raw, sure, refused).

    Sure is what has a fixed form, or a right checksum in a usual length or grouping.
    """
    def at(pattern: str) -> Column:
        return F.regexp_extract(x, f"^(?:{pattern})", 0)

    def iban(raw: Column) -> Column:
        plain = F.regexp_replace(raw, IBAN_SEP, "")
        own = F.element_at(F.create_map(*(F.lit(v) for pair in IBAN_LENGTH.items() for v in pair)), F.left(plain, F.lit(2)))
        return _form("iban", raw, F.coalesce(own == F.char_length(plain), F.lit(True)))

    def right_iban(raw: Column) -> Column:
        plain = F.regexp_replace(raw, IBAN_SEP, "")
        return F.char_length(plain).between(15, 34) & (F.char_length(_digits(F.substr(plain, F.lit(5)))) >= 2) & (
            _mod97(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))) == 1)

    def ordered(forms: Column) -> Column:
        return F.concat(F.filter(forms, lambda f: f["sure"]), F.filter(forms, lambda f: ~f["sure"]))

    def cards(tried: Column) -> Column:
        return F.transform(
            F.filter(F.transform(tried, lambda f, i: F.struct(f.alias("f"), i.alias("i"))), lambda t: _right_card(_digits(t["f"]["raw"]))),
            lambda t: _form("card", t["f"]["raw"], t["f"]["sure"], F.transform(
                F.filter(tried, lambda o, i: (i < t["i"]) & ~_right_card(_digits(o["raw"]))), lambda o: _digits(o["raw"]))))

    def fixed(kind: str, pattern: str, good: Callable[[Column], Column]) -> Column:
        return F.filter(F.array(_form(kind, at(pattern), F.lit(True))), lambda f: (f["raw"] != "") & good(f["raw"]))

    def numbers(pattern: str, group: str, good: Callable[[Column], Column]) -> Column:
        return F.filter(_prefixes(at(pattern), group), good)

    def phone(raw: Column) -> Column:
        return raw.rlike(f"^(?:{PHONE})$") & F.char_length(_digits(raw)).between(7, 15)

    phones = numbers(PHONE, rf"{SEP}?(?:\(\+[0-9]+\)|\+[0-9]+|\([0-9]+\)|[0-9]+)", phone)
    usual = lambda raw: raw.rlike(PHONE_SHAPE)
    kinds = F.concat(
        ordered(F.transform(numbers(IBAN, f"{IBAN_SEP}?[A-Z0-9]+", right_iban), iban)),
        F.transform(F.concat(F.filter(phones, usual), F.filter(phones, lambda r: ~usual(r))), lambda r: _form("phone", r, F.lit(False))),
        fixed("ip", IP, lambda r: F.lit(True)),
        fixed("ssn", SSN, lambda r: _ssn(r, key, False).isNotNull()),
        fixed("date", DATE, lambda r: _date(r, key, False).isNotNull()),
        _let(ordered(F.transform(numbers(CARD, f"{SEP}?[0-9]+", lambda r: F.char_length(_digits(r)).between(13, 19)),
                                 lambda r: _form("card", r, r.rlike(CARD_SHAPE)))), cards))
    return F.when(F.contains(x, F.lit("@")) & x.rlike(f"^(?:{MAIL})$"), F.array(_form("mail", x, F.lit(True)))).otherwise(kinds)


def _overlaps(sure: Column, at: Column, form: Column) -> Column:
    """Whether a form at ``at`` takes from a sure one that begins in it. A phone number may hold one, not cut it."""
    end = at + F.char_length(form["raw"])
    return F.exists(sure, lambda s: (s["at"] > at) & (s["at"] < end) & ((form["kind"] != "phone") | (s["end"] > end)))


def _hits(line: Column, key: str) -> Column:
    """What is to be replaced in a line, in order: array of struct(at, end, form), places counted from 0."""
    marked = F.concat(F.lit("\n"), line)  # no kind begins at the first character: pieces and places correspond
    pieces = F.split(marked, START, -1)
    places = F.aggregate(pieces, F.array(F.lit(-1)), lambda ends, p: F.concat(ends, F.array(F.element_at(ends, -1) + F.char_length(p))))
    forms = F.transform(F.regexp_extract_all(marked, F.lit(START), F.lit(1)), lambda x: _forms(x, key))
    spots = _let(places, lambda at: F.filter(
        F.transform(forms, lambda f, i: F.struct(at[i + 1].alias("at"), f.alias("forms"))), lambda s: F.size(s["forms"]) > 0))

    def span(at: Column, form: Column) -> Column:
        return F.struct(at.alias("at"), (at + F.char_length(form["raw"])).alias("end"), form.alias("form"))

    def leftmost(spans: Column) -> Column:
        return _let(spans, lambda all_: F.aggregate(all_, F.slice(all_, 1, 0), lambda got, s: F.when(
            (F.size(got) == 0) | (F.try_element_at(got, F.lit(-1))["end"] <= s["at"]), F.concat(got, F.array(s))).otherwise(got)))

    def choose(s: Column) -> Column:
        sure = leftmost(F.transform(F.filter(s, lambda p: p["forms"][0]["sure"]), lambda p: span(p["at"], p["forms"][0])))

        def best(p: Column, known: Column) -> Column:
            fit = F.filter(p["forms"], lambda f: f["sure"] | ~_overlaps(known, p["at"], f))
            return F.transform(F.slice(fit, 1, 1), lambda f: span(p["at"], f))

        return _let(sure, lambda known: leftmost(F.flatten(F.transform(s, lambda p: best(p, known)))))

    return _let(spots, choose)


def pseudonym(form: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one of ``_forms``."""
    x = form["raw"]
    made = F.when(form["kind"] == "mail", F.when(F.lit(back), x).otherwise(_mail(x, key)))
    for name, f in (("iban", _iban), ("phone", _phone), ("ip", _ip), ("ssn", _ssn), ("date", _date)):
        made = made.when(form["kind"] == name, f(x, key, back))
    return made.otherwise(_card(x, key, back, form["refused"]))


def _line(line: Column, key: str, back: bool) -> Column:
    """struct(text, kinds) of a line."""
    def build(hits: Column) -> Column:
        last = F.coalesce(F.try_element_at(hits, F.lit(-1))["end"], F.lit(0))
        parts = F.transform(hits, lambda h, i: _let(F.when(i == 0, F.lit(0)).otherwise(hits[F.greatest(i - 1, F.lit(0))]["end"]), lambda end: F.concat(
            F.substr(line, end + 1, h["at"] - end), pseudonym(h["form"], key, back))))
        return F.struct(F.concat(F.array_join(parts, ""), F.substr(line, last + 1)).alias("text"),
                        F.transform(hits, lambda h: h["form"]["kind"]).alias("kinds"))

    plain = F.struct(line.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(line.rlike(ANY), _let(_hits(line, key), build)).otherwise(plain)


def pseudonymize(docs: DataFrame, key: str, column: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with ``column`` pseudonymised and ``kinds``, the kinds found in order (array of strings).

    The key must be secret and the same for all runs whose values shall stay linked. ``back``
    inverts everything but mail addresses; where several numbers touch and can be read in more than
    one way, the changed digits may by chance be read differently, and then it does not. Null stays null with no
    kinds; empty texts stay empty; what only looks like a number but fails its check stays as it is. All other
    columns stay (one called ``kinds`` is replaced) and so do rows that repeat. One narrow
    stage: no row moves.
    """
    text = F.col(f"`{column}`").cast("string")

    def change(t: Column) -> Column:
        # no kind goes over a line end
        return _let(F.transform(F.split(t, "\n", -1), lambda line: _line(line, key, back)), lambda f: F.struct(
            F.array_join(f["text"], "\n").alias("text"), F.flatten(f["kinds"]).alias("kinds")))

    nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    made = docs.withColumn("__made", F.when(text.rlike("@|[0-9][^\\n]{0,6}[0-9]") & text.rlike(ANY), _let(text, change)).otherwise(nothing))
    keep = [F.col("__made.text").alias(column) if c == column else F.col(f"`{c}`") for c in docs.columns if c != "kinds"]
    return made.select(*keep, F.col("__made.kinds").alias("kinds"))
