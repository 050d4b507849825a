"""Format-preserving pseudonyms of numbers and dates, by keyed Feistel networks in column expressions.

Candidates are found by one pattern and validated: payment cards by their check digit, addresses by octet range,
social security numbers by area, group and serial, dates by the calendar from 1900 to 2099. A valid value is numbered
within its format's own domain, its number is split into two digits of a mixed base, and ``ROUNDS`` alternating
rounds add a keyed digest of one to the other. Every round can be undone, so the map is a permutation of the domain:
equal values get equal pseudonyms in all documents, different ones different pseudonyms, separators stay, and
the result is valid again (check digits are computed anew). E-mail names of letters and digits are permuted as
numbers of base 36, block by block of 24.

Slash dates are read with the day first where that is a date, else with the month first. The latter have a day of 13 or more, and so
have their pseudonyms: both readings are permuted apart, and no two dates get one text. A phone number's country code is the one that
the international plan assigns, so a number has one pseudonym however it is written.

Each pattern looks at a character a bounded number of times, also in texts without any break: what is repeated without bound is
possessive and starts at a boundary only. A host has at most 126 labels before its last one.

Defined cases: a null text stays null; what fails validation stays as it is; an empty text and an empty table are
fine; rows that repeat get equal results; other columns pass through, whatever their names, and columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.words import held

ROUNDS = 8
KINDS = ["email", "ip", "date", "ssn", "phone", "card"]

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?<=[A-Za-z0-9])@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+"
_IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])|(?<![0-9./])[0-3]?[0-9]([./])[0-3]?[0-9]\1(?:19|20)[0-9]{2}(?![0-9/])|(?<![0-9./])(?:19|20)[0-9]{2}/[01]?[0-9]/[0-3]?[0-9](?![0-9/])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])|(?<![0-9(-])\([0-9]{3}\)[0-9]{3}[ .-]?[0-9]{4}(?![0-9-])|(?<![0-9(-])(?<![0-9][.,])[2-9][0-9]{2}[ -]?[0-9]{3}[ -]?[0-9]{4}(?![0-9-]|[.,][0-9])"
_CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PATTERN = "|".join([_EMAIL, _IP, _DATE, _SSN, _PHONE, _CARD])
# The shape of country codes in the international numbering plan.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)
#: Days of these that are the 13th or later, a prime number; all but one are 8 * 5531.
_LATE, _LATE_DAYS = 44249, (8, 5531)


def _digest(key: str, *parts: Column | str) -> Column:
    """60 keyed bits."""
    text = F.concat_ws("|", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: Column | str) -> Column:
    """Struct (l, r), a permutation of the pairs below (a, b)."""

    def turn(pair: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        new_l = F.when(even, F.pmod(pair["l"] + F.pmod(_digest(key, kind, a, b, i, pair["r"]), a), a)).otherwise(pair["l"])
        new_r = F.when(even, pair["r"]).otherwise(F.pmod(pair["r"] + F.pmod(_digest(key, kind, a, b, i, pair["l"]), b), b))
        return F.struct(new_l.alias("l"), new_r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _permuted(digits: Column, base: int, key: str, kind: Column | str) -> Column:
    """A string of 2 to 24 digits of the base, as another of its length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    size = lambda x: F.pow(F.lit(float(base)), x).cast("long")
    number = lambda x: F.conv(x, base, 10).cast("long")
    pair = feistel(number(F.substr(digits, F.lit(1), h)), number(F.substr(digits, h + 1, n - h)), size(h), size(n - h), key, kind)
    text = lambda x, k: F.call_function("lpad", F.lower(F.conv(x.cast("string"), 10, base)), k, F.lit("0"))
    both = F.transform(F.array(pair), lambda p: F.concat(text(p["l"], h), text(p["r"], n - h)))
    return F.when(n >= 2, both[0]).otherwise(digits)


def _refilled(form: Column, digits: Column, kept: str) -> Column:
    """``form`` with its characters of the class replaced in order."""
    at = lambda i: F.substr(form, i, F.lit(1))
    seat = lambda i: F.length(_only(F.substr(form, F.lit(1), i), kept))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(at(i).rlike(f"[{kept}]"), F.substr(digits, seat(i), F.lit(1))).otherwise(at(i))), "")


def _luhn(digits: Column) -> Column:
    """Sum of a number's digits, every second one from the right (not the last) doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return total + F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    digits = _only(m, "0-9")
    body = _permuted(F.substr(digits, F.lit(1), F.length(digits) - 1), 10, key, "card")
    made = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return F.when(F.pmod(_luhn(digits), F.lit(10)) == 0, _refilled(m, made, "0-9")).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, _COUNTRY, 0)
    rest = F.substr(m, F.length(country) + 1, F.length(m))
    return F.concat(country, _refilled(rest, _permuted(_only(rest, "0-9"), 10, key, "phone"), "0-9"))


def _ip(m: Column, key: str) -> Column:
    octet = lambda i: F.split(m, r"\.")[i].cast("long")
    pair = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key, "ip")
    parts = lambda x: [F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string")]
    return F.transform(F.array(pair), lambda p: F.concat_ws(".", *parts(p["l"]), *parts(p["r"])))[0]


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def text(p: Column) -> Column:
        new_area = p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(p["r"], F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.when(good, F.transform(F.array(pair), text)[0]).otherwise(m)


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none."""
    two = lambda x: F.lpad(x, 2, "0")
    return F.try_to_timestamp(F.concat_ws("-", year, two(month), two(day)), F.lit("yyyy-MM-dd")).cast("date")


def _other_day(day: Column, key: str) -> Column:
    """An array of one date, to be used more than once."""
    number = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
    pair = feistel(F.floor(number / _DAYS[1]), F.pmod(number, F.lit(_DAYS[1])), F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date")
    return F.transform(F.array(pair), lambda p: F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["l"] * _DAYS[1] + p["r"]).cast("int")))


def _other_late_day(day: Column, key: str) -> Column:
    """As _other_day, among the days that are the 13th of their month or later.

    Shifted, permuted but for the last number, and shifted again."""
    first = F.lit(_FIRST_DAY).cast("date")
    months = (F.year(day) - 1900) * 12 + F.month(day) - 1
    turned = lambda x, k: F.pmod(x + F.pmod(_digest(key, "late date", F.lit(k)), F.lit(_LATE)), F.lit(_LATE))
    number = turned(F.datediff(day, first).cast("long") - 12 * (months + 1), 0)
    pair = lambda x: feistel(F.floor(x / _LATE_DAYS[1]), F.pmod(x, F.lit(_LATE_DAYS[1])), F.lit(_LATE_DAYS[0]), F.lit(_LATE_DAYS[1]), key, "late date")
    moved = F.transform(F.array(number), lambda x: F.when(x == _LATE - 1, x).otherwise(F.transform(F.array(pair(x)), lambda p: p["l"] * _LATE_DAYS[1] + p["r"])[0]))
    made = F.transform(moved, lambda x: turned(x, 1))

    def date_of(x: Column) -> Column:
        guess = F.floor(x * 2400 / _LATE).cast("int")
        before = lambda m: F.datediff(F.add_months(first, m), first) - 12 * m
        month = F.array_max(F.filter(F.sequence(F.greatest(guess - 2, F.lit(0)), F.least(guess + 2, F.lit(2399))), lambda m: before(m) <= x))
        return F.date_add(first, (x + 12 * (month + 1)).cast("int"))

    return F.transform(made, date_of)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _date(m: Column, key: str) -> Column:
    def told(v: Column) -> Column:
        # a month and a day without zeros get none
        padded = F.length(v["b"]) + F.length(F.when(v["year_first"], v["c"]).otherwise(v["a"])) == 4
        number = lambda x: F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        joined = lambda x, y, z: F.concat(x, v["mark"], y, v["mark"], z)
        year, month, day = (lambda d: F.year(d).cast("string")), (lambda d: number(F.month(d))), (lambda d: number(F.day(d)))
        plain = F.when(v["year_first"], _day(v["a"], v["b"], v["c"])).otherwise(_day(v["c"], v["b"], v["a"]))
        written = lambda d: F.when(v["year_first"], joined(year(d), month(d), day(d))).otherwise(joined(day(d), month(d), year(d)))
        late = lambda d: F.when(d.isNotNull(), F.transform(_other_late_day(d, key), lambda x: joined(month(x), day(x), year(x)))[0]).otherwise(m)
        month_first = F.when((v["mark"] == "/") & ~v["year_first"], _once(_day(v["c"], v["a"], v["b"]), late)).otherwise(m)
        return _once(plain, lambda d: F.when(d.isNotNull(), F.transform(_other_day(d, key), written)[0]).otherwise(month_first))

    part = lambda i: F.get(F.split(m, "[./-]"), F.lit(i))
    return _once(F.struct(part(0).alias("a"), part(1).alias("b"), part(2).alias("c"), F.regexp_extract(m, "[./-]", 0).alias("mark"), m.rlike("^[0-9]{4}").alias("year_first")), told)


def _shifted(letter: Column, key: str, kind: Column | str) -> Column:
    """A letter or digit as another one: a keyed shift of 1 to 35 places, so none stays."""
    by = 1 + F.pmod(_digest(key, kind, F.lit(36)), F.lit(35))
    return F.lower(F.conv(F.pmod(F.conv(letter, 36, 10).cast("long") + by, F.lit(36)).cast("string"), 10, 36))


def _email(m: Column, key: str, one: bool) -> Column:
    name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

    def block(letters: Column, i: Column) -> Column:
        own = F.substr(letters, i * 24 + 1, F.lit(24))
        kind = F.when(i == 0, "email").otherwise(F.concat(F.lit("email "), i.cast("string")))
        return F.when((F.length(own) == 1) & (F.lit(one) | (i > 0)), _shifted(own, key, kind)).otherwise(_permuted(own, 36, key, kind))

    blocks = lambda letters: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(letters) - 1) / 24).cast("int")), lambda i: block(letters, i)), "")
    whole = F.transform(F.array(F.lower(_only(name, "A-Za-z0-9"))), blocks)
    return F.concat(F.transform(whole, lambda w: _refilled(name, w, "A-Za-z0-9"))[0], F.lit("@"), host)


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}$|^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), "date")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(f"^(?:{_CARD})$"), "card")
        .otherwise("phone")
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts_col: str = "n_pseudonyms", one: bool = False) -> DataFrame:
    """``docs`` with values in the text column replaced; ``counts_col`` is how many were. ``one``: e-mail names of one character too."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, counts_col)]
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    t, hit, m, g, n = (mark + x for x in "thmgn")
    df = docs.select(*own, F.col(f"`{text_col}`").alias(t), held(F.col(f"`{text_col}`").rlike(PATTERN)).alias(hit))
    df = df.select(*own, t, held(F.when(F.col(hit), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))).alias(m), held(F.when(F.col(hit), F.split(t, PATTERN, -1))).alias(g))
    df = df.select(*own, t, m, g, held(F.transform(m, lambda x: _replaced(x, key, one))).alias(n))
    woven = F.array_join(F.transform(F.sequence(F.lit(0), F.size(m)), lambda i: F.concat(F.get(g, i), F.coalesce(F.get(n, i), F.lit("")))), "")
    changed = F.size(F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.get(m, i) != F.get(n, i)))
    found = F.col(m).isNotNull()
    values = {text_col: F.when(found, woven).otherwise(F.col(t)), counts_col: F.when(found, changed).otherwise(0).cast("long")}
    names = [*docs.columns, *([counts_col] if counts_col not in docs.columns else [])]
    return df.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in names])


def _replaced(m: Column, key: str, one: bool) -> Column:
    def by_kind(kind: Column) -> Column:
        out = F.when(kind == "email", _email(m, key, one))
        for name, work in (("ip", _ip), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("card", _card)):
            out = out.when(kind == name, work(m, key))
        return out.otherwise(m)

    return _once(_kind(m), by_kind)
