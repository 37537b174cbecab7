"""Format-preserving pseudonyms for personal data (DataFrame functions only).

One regular expression finds candidates; each is validated by its kind (Luhn
sum, calendar, octets, number ranges) and its value goes through a keyed
Feistel network on exactly the values of its format: L and R live in Z_a and
Z_b with a * b values in all, and rounds add keyed hashes of one side to the
other. The network is a permutation, so equal values get equal pseudonyms in
every document, different ones stay different, and the key undoes it.
Nothing is shuffled.

Kinds: ``card`` (13 to 19 digits with a valid Luhn sum, plain, in fours or
4-6-5; the new number is Luhn-valid too), ``phone`` (ten digits grouped 3-3-4,
country prefix kept; number plans differ, so the grouping is the test, and
groups parted by blanks count only after a prefix or brackets), ``ssn``,
``ip`` (IPv4), ``date`` (YYYY-MM-DD or DD/MM/YYYY of the years 1500 to 2400,
permuted among all days of those years; what is no date as DD/MM is read as
MM/DD/YYYY, whose days are 13 to 31 before and after), ``email`` (letters stay
letters and digits digits in the local part; the domain stays).

Defined results: null text stays null with no finds; empty texts stay; what
fails validation stays as it is; repeated rows are treated alike; input
columns named like a count (in any case) are replaced, all others stay; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried

KEY, ROUNDS = "a fixed key for tests; give your own", 8
#: The days of the years 1500 to 2400 are 644 * 511; steps until a day over 12.
YEARS, SIDES, WALK = (1500, 2400), (644, 511), 64
#: Patterns by kind, tried in this order. No run of characters is scanned twice.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "date": r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:(?<![0-9])\+[0-9]{1,3}[ .-](?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-]|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-])[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` written and worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _hash(key: str, tweak: Column, x: Column) -> Column:
    """A keyed hash below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key + "|"), tweak, F.lit("|"), x.cast("string"), F.lit("|" + key)), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str, tweak: str, back: bool = False) -> Column:
    """``value`` in [0, a * b) permuted; ``back`` undoes it."""
    start = F.struct(((value - F.pmod(value, b)) / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    sign = -1 if back else 1

    def turn(s, i):
        name = F.concat(F.lit(tweak + "|"), i.cast("string"))
        left = F.struct(F.pmod(s["l"] + sign * F.pmod(_hash(key, name, s["r"]), a), a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * F.pmod(_hash(key, name, s["l"]), b), b).alias("r"))
        return F.when(i % 2 == 1, left).otherwise(right)

    return F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ten(n: Column) -> Column:
    """10 ** n as a long."""
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("long")


def _luhn(d: Column, skip: int) -> Column:
    """Luhn sum of a digit string; ``skip`` 0 if its last digit is a check digit."""
    places = F.sequence(F.lit(1), F.length(d))

    def add(s, i):
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return s + F.when((i + skip) % 2 == 0, twice).otherwise(x)

    return F.aggregate(places, F.lit(0), add)


def _card(m: Column, key: str, back: bool) -> Column:
    d = _digits(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    n = F.length(body)
    low = F.floor(n / 2)
    tweak = "card"
    new = F.lpad(feistel(body.cast("long"), _ten(n - low), _ten(low), key, tweak, back).cast("string"), n, "0")
    whole = F.concat(new, F.pmod(-_luhn(new, 1), F.lit(10)).cast("string"))
    sep = F.regexp_extract(m, "[ -]", 0)
    four = F.concat_ws("", F.substring(whole, 1, 4), sep, F.substring(whole, 5, 4), sep, F.substring(whole, 9, 4), sep, F.substring(whole, 13, 4))
    odd = F.concat_ws("", F.substring(whole, 1, 4), sep, F.substring(whole, 5, 6), sep, F.substring(whole, 11, 5))
    valid = (F.pmod(_luhn(d, 0), F.lit(10)) == 0) & F.length(d).between(13, 19)
    return F.when(valid, F.when(sep == "", whole).when(F.length(d) == 15, odd).otherwise(four))


def _phone(m: Column, key: str, back: bool) -> Column:
    prefix = F.regexp_extract(m, r"^\+[0-9]{1,3}[ .-]", 0)
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    d = _digits(rest)
    new = F.lpad(feistel(d.cast("long"), F.lit(100_000).cast("long"), F.lit(100_000).cast("long"), key, "phone", back).cast("string"), 10, "0")
    sep = [F.regexp_extract(rest, r"^(\(?)[0-9]{3}(\) ?|[ .-])[0-9]{3}([ .-])", k) for k in (1, 2, 3)]
    return F.concat(prefix, sep[0], F.substring(new, 1, 3), sep[1], F.substring(new, 4, 3), sep[2], F.substring(new, 7, 4))


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)  # 1 to 899 without 666
    value = (index * 99 + group - 1) * 9999 + serial - 1
    new = feistel(value, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn", back)
    top = F.floor(new / 9999).cast("long")
    a = F.floor(top / 99).cast("long") + 1
    a = a + F.when(a >= 666, 1).otherwise(0)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.concat_ws("-", pad(a, 3), pad(F.pmod(top, F.lit(99).cast("long")) + 1, 2), pad(F.pmod(new, F.lit(9999).cast("long")) + 1, 4)))


def _ip(m: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = feistel(value, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip", back)
    octet = lambda k: F.pmod(F.floor(new / 256**k).cast("long"), F.lit(256).cast("long")).cast("string")
    return F.when(F.forall(parts, lambda x: x <= 255), F.concat_ws(".", octet(3), octet(2), octet(1), octet(0)))


def _date(m: Column, key: str, back: bool) -> Column:
    iso = m.contains("-")
    start = F.lit(f"{YEARS[0]}-01-01").cast("date")
    first = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(m, "dd/MM/yyyy"))
    month_first = F.when(~iso & first.isNull(), F.try_to_date(m, "MM/dd/yyyy"))
    a, b = (F.lit(x).cast("long") for x in SIDES)
    move = lambda n, tweak: feistel(n, a, b, key, tweak, back)
    at = lambda n: F.date_add(start, n.cast("int"))
    days = lambda d: F.datediff(d, start).cast("long")
    plain = _let(at(move(days(first), "date")), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy")))
    # walk the cycle until the day can't be a month; 64 steps fail once in 10 ** 26 dates
    steps = F.sequence(F.lit(1), F.lit(WALK))
    walked = F.aggregate(steps, days(month_first), lambda n, i: F.when((i > 1) & (F.dayofmonth(at(n)) > 12), n).otherwise(move(n, "date-mdy")))
    other = _let(at(walked), lambda d: F.when(F.dayofmonth(d) > 12, F.date_format(d, "MM/dd/yyyy")))
    return F.when(F.year(first).between(*YEARS), plain).when(F.year(month_first).between(*YEARS), other)


def _shifted(text: Column, other: Column, key: str, tweak: Column, sign: int) -> Column:
    """Letters and digits of ``text`` moved within their kind by a keyed hash of ``other``."""
    stream = F.sha2(F.concat(F.lit(key + "|email|"), tweak, F.lit("|"), F.length(text).cast("string"), F.lit("|"), other, F.lit("|" + key)), 256)

    def move(c, i):
        k = F.conv(F.substring(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        at = lambda base, n: F.char(F.pmod(F.ascii(c) - base + sign * k, F.lit(n)) + base)
        return F.when(c.between("a", "z"), at(97, 26)).when(c.between("A", "Z"), at(65, 26)).when(c.between("0", "9"), at(48, 10)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), move), "")


def _email(m: Column, key: str, back: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    half = F.ceil(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    sign = -1 if back else 1

    def turn(s, i):
        t = i.cast("string")
        return F.when(i % 2 == 1, F.struct(_shifted(s["l"], s["r"], key, t, sign).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), _shifted(s["r"], s["l"], key, t, sign).alias("r")))

    return F.concat(F.aggregate(rounds, start, turn, lambda s: F.concat(s["l"], s["r"])), F.lit("@"), F.substring_index(m, "@", -1))


MAKERS = {"card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "email": _email}


def pseudonyms(docs: DataFrame, text: str = "text", key: str = KEY, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_<kind>`` for each kind.

    ``back`` with the same key restores the original texts.
    """
    counts = tuple(f"n_{k}" for k in KINDS)
    x, back_columns = carried(docs, counts, p_text=text)
    kept = [c for c in docs.columns if c.lower() not in counts]
    place = kept.index(text) if text in kept else [c.lower() for c in kept].index(text.lower())
    t = F.col("p_text")
    none = F.expr("CAST(array() AS array<string>)")
    x = x.withColumn("p_found", F.when(t.rlike(ANY), F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1))).otherwise(none))
    x = x.withColumn("p_gaps", F.when(F.size("p_found") > 0, F.split(t, ANY, -1)).otherwise(none))

    def renamed(m):
        same = F.struct(F.lit(None).cast("string").alias("k"), m.alias("v"))
        out = F
        for k in KINDS:
            kind = F.lit(k).alias("k")
            named = _let(MAKERS[k](m, key, back), lambda v: F.when(v.isNotNull(), F.struct(kind, v.alias("v"))).otherwise(same))  # noqa: B023
            out = out.when(m.rlike(f"^(?:{PATTERNS[k]})$"), named)
        return out.otherwise(same)

    x = x.withColumn("p_new", F.transform("p_found", renamed))
    joined = F.array_join(F.zip_with("p_gaps", F.transform("p_new", lambda n: n["v"]), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    fresh = F.when(F.size("p_found") > 0, joined).otherwise(t)
    of_kind = lambda k: F.filter("p_new", lambda n: F.coalesce(n["k"] == k, F.lit(False)))
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    back_columns[place] = fresh.alias(kept[place])
    return x.select(*back_columns, *count)
