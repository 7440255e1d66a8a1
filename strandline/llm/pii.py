"""Format-preserving pseudonyms of personal numbers, dates and addresses by keyed Feistel permutations.

A value found by its pattern is validated (Luhn, octets, calendar, issued ranges) and its free
digits are permuted within its format by ``ROUNDS`` rounds of a two-sided Feistel network whose
round function is SHA-256 of key, kind, round and the other side. Equal values of a format become
equal pseudonyms in every document, different ones stay different, and a pseudonym is again a valid
value: cards keep their first digit and get a new check digit, phone numbers keep the country
code and the first digit of the area, dates stay between 1900 and 2099 and keep how many digits day and
month have, identity numbers
stay in issued ranges, and addresses keep their form. Of mail addresses the local part is permuted
sign by sign within its class (digit, lower, upper), the domain stays. Separators stay.

Covered: mail addresses; dates as y-m-d, y/m/d, d/m/y, m/d/y and d.m.y, with one digit or two; identity numbers as
3-2-4 digits; phone numbers as 3-3-4 digits with or without a country code, and + with 10 to 15 digits in a run; four
octets; cards of 13 to 19 digits in a run, as 4-4-4-n or as 4-6-4 and 4-6-5. Other forms (account numbers, phone
numbers in other groups) and numbers that fail validation are left alone. NULL texts stay NULL; empty texts, ties and repeated
rows have no special case; every text is read as a whole. No row leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import col, free_names

ROUNDS = 8
KINDS = ["email", "date", "ssn", "phone", "ip", "card"]
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[1-9][0-9]{9,14}(?![0-9])|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]))",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])",
}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)


def _draw(key: str, kind: str, i: Column, other: Column) -> Column:
    """A number below 2 ** 60 from key, kind, round and the other side."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _permuted(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """(l, r): a permutation of the pairs with left below a and right below b."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        new_l = F.when(even, F.pmod(s["l"] + _draw(key, kind, i, s["r"]), a)).otherwise(s["l"])
        new_r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _draw(key, kind, i, s["l"]), b))
        return F.struct(new_l.cast("bigint").alias("l"), new_r.cast("bigint").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def _part(text: Column, start: Column | int, length: Column | int) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substring(text, as_col(start), as_col(length))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """The value with its digits, in order, replaced by others; what stands between them stays."""
    place = lambda i: F.length(digits_of(_part(value, 1, i)))
    signs = F.transform(
        F.sequence(F.lit(1), F.length(value)), lambda i: F.when(_part(value, i, 1).rlike("[0-9]"), _part(digits, place(i), 1)).otherwise(_part(value, i, 1))
    )
    return F.array_join(signs, "")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, the last counted single."""

    def weight(i: Column) -> Column:
        d = _part(digits, i, 1).cast("int")
        return F.when((F.length(digits) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weight), F.lit(0), lambda s, x: s + x)


def _digit_run(key: str, kind: str, digits: Column) -> Column:
    """A permutation of the digit strings of this length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    size = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")
    left = F.when(half > 0, _part(digits, 1, half)).otherwise("0")
    moved = _permuted(key, kind, left, _part(digits, half + 1, rest), size(half), size(rest))
    return _let(moved, lambda s: F.concat(F.when(half > 0, _padded(s["l"], half)).otherwise(""), _padded(s["r"], rest)))


def _card(key: str, value: Column) -> Column:
    def made(digits: Column) -> Column:
        n = F.length(digits)
        moved = F.concat(_part(digits, 1, 1), _digit_run(key, "card", _part(digits, 2, n - 2)))
        check = lambda d: F.pmod(10 - luhn_sum(F.concat(d, F.lit("0"))) % 10, F.lit(10)).cast("string")
        return F.when(luhn_sum(digits) % 10 == 0, _let(moved, lambda d: _refilled(value, F.concat(d, check(d))))).otherwise(value)

    return _let(digits_of(value), made)


def _phone(key: str, value: Column) -> Column:
    def made(digits: Column) -> Column:
        n = F.length(digits)
        return _refilled(value, F.concat(_part(digits, 1, n - 9), _digit_run(key, "phone", _part(digits, n - 8, 9))))

    return _let(digits_of(value), made)


def _ip(key: str, value: Column) -> Column:
    def made(o: Column) -> Column:
        moved = _permuted(key, "ip", F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), F.lit(65536), F.lit(65536))
        octets = lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)])
        return F.when(F.array_max(o) <= 255, _let(moved, octets)).otherwise(value)

    return _let(F.split(value, r"\.").cast("array<int>"), made)


def _ssn(key: str, value: Column) -> Column:
    """898 areas (001-899 without 666), 99 groups and 9999 serials."""

    def made(p: Column) -> Column:
        area, group, serial = (F.get(p, k) for k in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
        moved = _permuted(key, "ssn", place, serial - 1, F.lit(898 * 99), F.lit(9999))

        def shown(s: Column) -> Column:
            index = F.floor(s["l"] / 99)
            issued = index + 1 + F.when(index >= 665, 1).otherwise(0)
            return F.concat_ws("-", _padded(issued, F.lit(3)), _padded(s["l"] % 99 + 1, F.lit(2)), _padded(s["r"] + 1, F.lit(4)))

        return F.when(valid, _let(moved, shown)).otherwise(value)

    return _let(F.split(value, "-").cast("array<int>"), made)


#: Steps of a walk through days that a month may lack, one in ten or fewer: a longer one has a chance below 1e-60.
WALK = 64


def _last_day(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, F.greatest(F.lit(1), F.least(month, F.lit(12))), F.lit(1))))


def date_parts(value: Column) -> Column:
    """(y, m, d, order) of a date in one of the forms: year first, day first where that is a date, else month first."""
    p = F.split(value, "[-/.]")
    n = [F.get(p, k).cast("int") for k in range(3)]
    valid = lambda y, m, d: m.between(1, 12) & (d >= 1) & (d <= _last_day(y, m))
    part = lambda y, m, d, order: F.struct(n[y].alias("y"), n[m].alias("m"), n[d].alias("d"), F.lit(order).alias("order"))
    year_first = F.length(F.get(p, 0)) == 4
    return (
        F.when(year_first, F.when(valid(n[0], n[1], n[2]), part(0, 1, 2, "ymd")))
        .when(valid(n[2], n[1], n[0]), part(2, 1, 0, "dmy"))
        .when(valid(n[2], n[0], n[1]), part(2, 0, 1, "mdy"))
    )


def _date(key: str, value: Column) -> Column:
    """A day of 1900 to 2099 within its class: days of one digit, of 10 to 12 and above 12, months of one digit and of two.

    So a pseudonym can be written like its value, with one digit or two, and read as the value is, and one day
    has one pseudonym in every notation. Of the days above 12, those that a month lacks are walked past.
    """

    def made(p: Column) -> Column:
        late, months = p["m"] >= 10, F.when(p["m"] >= 10, 3).otherwise(9)
        first = F.when(p["d"] < 10, 1).when(p["d"] <= 12, 10).otherwise(13)
        days = F.when(first == 1, 9).when(first == 10, 3).otherwise(19)
        left = (p["y"] - 1900) * months + p["m"] - F.when(late, 10).otherwise(1)
        day = lambda s: F.struct(
            (F.floor(s["l"] / months) + 1900).cast("int").alias("y"), (s["l"] % months + F.when(late, 10).otherwise(1)).cast("int").alias("m"), (s["r"] + first).cast("int").alias("d")
        )

        def step(s: Column, _: Column) -> Column:
            new = lambda x: _let(day(x), lambda t: F.struct(x["l"].alias("l"), x["r"].alias("r"), (t["d"] <= _last_day(t["y"], t["m"])).alias("done")))
            return F.when(s["done"], s).otherwise(_let(_permuted(key, "date", s["l"], s["r"], 200 * months, days), new))

        start = F.struct(left.cast("bigint").alias("l"), (p["d"] - first).cast("bigint").alias("r"), F.lit(False).alias("done"))
        walked = F.when(p["y"].between(1900, 2099), F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step))
        return _let(walked, lambda s: F.when(s["done"], _let(day(s), lambda t: shown(p["order"], t))))

    def shown(order: Column, t: Column) -> Column:
        """The day in the value's order, each part as wide as the value's."""
        p, mark = F.split(value, "[-/.]"), F.regexp_extract(value, "[-/.]", 0)
        wide = lambda part, k: F.lpad(part.cast("string"), F.length(F.get(p, k)), F.lit("0"))
        write = lambda *parts: F.concat_ws("", wide(parts[0], 0), mark, wide(parts[1], 1), mark, wide(parts[2], 2))
        return F.when(order == "ymd", write(t["y"], t["m"], t["d"])).when(order == "dmy", write(t["d"], t["m"], t["y"])).otherwise(write(t["m"], t["d"], t["y"]))

    return F.coalesce(_let(date_parts(value), made), value)


def _email(key: str, value: Column) -> Column:
    """The letters and digits of the local part, each moved within its class by the other half."""
    at = F.instr(value, "@")
    local = _part(value, 1, at - 1)

    def shifted(text: Column, i: Column, other: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other), 256)

        def move(h: Column) -> Column:
            def sign(k: Column) -> Column:
                c = _part(text, k, 1)
                step = F.conv(_part(h, k * 2 - 1, 2), 16, 10).cast("int")
                first = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
                return F.char(first + F.pmod(F.ascii(c) - first + step, F.when(first == 48, 10).otherwise(26)))

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), sign), "")

        return F.when(text == "", text).otherwise(_let(hashed, move))

    def moved(signs: Column) -> Column:
        half = F.floor(F.length(signs) / 2).cast("int")
        start = F.struct(_part(signs, 1, half).alias("l"), _part(signs, half + 1, F.length(signs) - half).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            return F.struct(
                F.when(even, shifted(s["l"], i, s["r"])).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(shifted(s["r"], i, s["l"])).alias("r")
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)

    def shown(s: Column) -> Column:
        signs = F.concat(s["l"], s["r"])
        place = lambda i: F.length(F.regexp_replace(_part(local, 1, i), "[^A-Za-z0-9]", ""))
        one = lambda i: F.when(_part(local, i, 1).rlike("[A-Za-z0-9]"), _part(signs, place(i), 1)).otherwise(_part(local, i, 1))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(local)), one), ""), _part(value, at, F.length(value)))

    return _let(F.regexp_replace(local, "[^A-Za-z0-9]", ""), lambda signs: _let(moved(signs), shown))


PERMUTED = {"email": _email, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}


def kind_of(value: Column) -> Column:
    """The kind of a match, by its form; the patterns can't match each other's values."""
    out = F.when(value.contains("@"), "email")
    for kind in KINDS[1:]:
        out = out.when(value.rlike("^(?:" + PATTERNS[kind].replace("(?<![0-9])", "").replace("(?<![0-9+])", "").replace("(?<![0-9.])", "") + ")$"), kind)
    return out


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one matched value; the value itself where it isn't valid."""

    def made(kind: Column) -> Column:
        out = F.when(kind == "email", _email(key, value))
        for k in KINDS[1:]:
            out = out.when(kind == k, PERMUTED[k](key, value))
        return out.otherwise(value)

    return _let(kind_of(value), made)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows in their columns, with pseudonyms in the text, and ``n_pseudonyms``: how many values changed."""
    whole, found, gaps, new = free_names(docs, "_whole_text", "_found", "_gaps", "_new")
    [count] = free_names(docs, "n_pseudonyms")
    source = F.coalesce(col(text).cast("string"), F.lit(""))
    matches = F.regexp_extract_all(col(whole), F.lit(ANY), F.lit(0))
    out = docs.withColumn(whole, source)
    out = out.withColumn(found, F.when(col(whole).rlike("[0-9@]"), matches).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(new, F.transform(col(found), lambda m: pseudonym(m, key)))
    out = out.withColumn(gaps, F.when(F.size(col(found)) > 0, F.split(col(whole), ANY, -1)).otherwise(F.array(col(whole))))
    rest = F.zip_with(col(new), F.slice(col(gaps), F.lit(2), F.size(col(found))), lambda m, g: F.concat(m, g))
    text_out = F.when(F.size(col(found)) > 0, F.concat(F.get(col(gaps), 0), F.array_join(rest, ""))).otherwise(col(text))
    changed = F.size(F.filter(F.zip_with(col(found), col(new), lambda a, b: a != b), lambda x: x)).cast("bigint")
    return out.select(*[text_out.alias(c) if c == text else col(c) for c in docs.columns], changed.alias(count))
