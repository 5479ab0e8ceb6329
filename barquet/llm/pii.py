"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A value that passes its validation is written as digits in its own mixed radix (card: ten; phone: ten, but the first
digits of area and exchange stay in 2-9 or in 0-1; IPv4: four
bytes; date: the day number as 17 x 4297; social security number: area, group, serial) and these digits go through
a keyed Feistel network: in turn each half gets, digit by digit and modulo the digit's radix, a SHA-512 value of
the key, the kind, the round and the other half. The network is a permutation of the valid values of that format,
so equal values, however they are punctuated, get equal pseudonyms in all documents and different values different
ones. E-mail addresses have no such format: their local part becomes a keyed hash of 128 bits, the domain stays.

Defined cases: null text stays null, empty text stays empty; numbers that fail their validation (check digit, octet
range, calendar, a phone number that is one digit ten times; area codes from 0 or 1, which nobody has but invented
numbers do, aren't refused) and all other text stay byte for byte as they were; repeated rows get the same result. Of values
side by side each is replaced on its own: a card ends where a valid value of another kind begins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The written forms that are looked for, first match wins.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
BYTE = "(?:[01]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])"
#: Digits that begin one of these belong to it, not to a card before them.
OTHER = "|".join(
    (
        EMAIL,
        f"(?=(?:19|20)[0-9]{{2}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])){DATE}",
        f"(?!000|666|9|[0-9]{{3}}-00|[0-9]{{3}}-[0-9]{{2}}-0000){SSN}",
        PHONE,
        rf"(?={BYTE}(?:\.{BYTE}){{3}}(?![0-9])){IPV4}",
    )
)
#: Groups of digits, one blank or hyphen between, of 13 digits or more in all: which of them are cards, ``_cards`` says.
CARD = rf"(?<![0-9])(?=(?:[0-9](?:[ -](?!{OTHER}))?){{12}}[0-9])[0-9]{{1,19}}+(?![0-9])(?:[ -](?!{OTHER})[0-9]{{1,19}}+(?![0-9]))*+"
#: Groups that belong together: none apart, or those printed on cards with one kind of separator.
TOGETHER = "^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?:\\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{4,5})$"
CARD_DIGITS = (13, 19)
ANY = f"{EMAIL}|(?=[0-9(+])(?:{'|'.join((DATE, SSN, PHONE, IPV4, CARD))})"
#: Every match of ``ANY`` has a match of this, which is quick to look for: most texts have none.
HINT = "[0-9@](?:(?<=@)|[0-9. -]?[0-9])"
MARK = "\u0001"  #: put around each match; texts that have it are taken apart in another, slower way

#: Days 1900-01-01 to 2099-12-31 are 17 x 4297.
EPOCH, DAY_RADICES = "1900-01-01", (17, 4297)
ROUNDS = 8
HEX_PER_DIGIT = 6


def _ints(*values: int) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _digits(text: Column) -> Column:
    """The decimal digits of a string as integers."""
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("int"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shift(half: Column, radices: Column, other: Column, tweak: Column) -> Column:
    """One round: add a keyed value of the other half to each digit, modulo its radix."""
    stream = F.sha2(F.concat_ws("|", tweak, F.array_join(other.cast("array<string>"), ",")), 512)
    add = lambda hexes: lambda d, i: F.pmod(
        d + F.conv(F.substr(hexes, i * HEX_PER_DIGIT + 1, F.lit(HEX_PER_DIGIT)), 16, 10).cast("long"), F.get(radices, i)
    ).cast("int")
    return let(stream, lambda hexes: F.transform(half, add(hexes)))


def feistel(digits: Column, radices: Column, key: Column, kind: str) -> Column:
    """Keyed permutation of the digit strings with these radices (array<int> to array<int>, up to 42 digits)."""
    cut = lambda a: F.floor(F.size(a) / 2).cast("int")
    left, right = (lambda a: F.slice(a, F.lit(1), cut(a))), (lambda a: F.slice(a, cut(a) + 1, F.size(a) - cut(a)))
    start = F.struct(left(digits).alias("l"), right(digits).alias("r"), left(radices).alias("rl"), right(radices).alias("rr"))

    def turn(s: Column, i: Column) -> Column:
        tweak = F.concat_ws("|", key, F.lit(kind), (F.size(s["rl"]) + F.size(s["rr"])).cast("string"), i.cast("string"))
        even = F.pmod(i, F.lit(2)) == 0
        new_l = F.when(even, _shift(s["l"], s["rl"], s["r"], tweak)).otherwise(s["l"])
        new_r = F.when(even, s["r"]).otherwise(_shift(s["r"], s["rr"], s["l"], tweak))
        return F.struct(new_l.alias("l"), new_r.alias("r"), s["rl"].alias("rl"), s["rr"].alias("rr"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn_sum(digits: Column, from_right: int) -> Column:
    """Luhn's sum, where the last digit stands ``from_right`` places before the end."""
    n = F.size(digits)
    term = lambda d, i: F.when(F.pmod(n - 1 - i + from_right, F.lit(2)) == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.transform(digits, term), F.lit(0), lambda a, x: a + x)


def _refill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in turn."""
    put = lambda c, i: F.when(
        c.rlike("^[0-9]$"), F.get(digits, F.length(F.regexp_replace(F.substr(form, F.lit(1), i + 1), "[^0-9]", "")) - 1).cast("string")
    ).otherwise(c)
    return F.array_join(F.transform(F.split(form, ""), put), "")


def _card(m: Column, key: Column) -> Column:
    """The pseudonym of a valid card number."""

    def new(d: Column) -> Column:
        payload = F.slice(d, F.lit(1), F.size(d) - 1)
        mixed = feistel(payload, F.transform(payload, lambda _: F.lit(10)), key, "card")
        check = lambda p: F.pmod(10 - F.pmod(_luhn_sum(p, 1), F.lit(10)), F.lit(10))
        return let(let(mixed, lambda p: F.concat(p, F.array(check(p)))), lambda p: _refill(m, p))

    return let(_digits(m), new)


def _cards(m: Column, key: Column) -> Column:
    """Groups of digits with the cards among them replaced, and the number of cards: ``new`` (null if none), ``n``.

    Every run of whole groups is tried. Of valid runs that overlap, groups that belong together go first, then the
    leftmost, then the longest.
    """
    least, most = CARD_DIGITS

    def runs(parts: Column) -> Column:
        joined = lambda i, k: F.regexp_replace(F.array_join(F.slice(parts, i + 1, k), ""), "[ -]$", "")
        run = lambda i: lambda k: F.struct(i.alias("start"), (i + k).alias("end"), joined(i, k).alias("form"))
        lengths = lambda i: F.sequence(F.lit(1), F.least(F.size(parts) - i, F.lit(most)))
        every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.transform(lengths(i), run(i))))
        sized = F.filter(every, lambda r: F.length(F.regexp_replace(r["form"], "[^0-9]", "")).between(least, most))
        return F.filter(sized, lambda r: F.pmod(_luhn_sum(_digits(r["form"]), 0), F.lit(10)) == 0)

    def ranked(valid: Column) -> Column:
        rank = lambda r: (~r["form"].rlike(TOGETHER)).cast("int")
        order = lambda r: F.struct(rank(r).alias("rank"), r["start"].alias("start"), (-r["end"]).alias("last"), r.alias("run"))
        return F.transform(F.array_sort(F.transform(valid, order)), lambda r: r["run"])

    def chosen(order: Column) -> Column:
        apart = lambda r: lambda p: (p["end"] <= r["start"]) | (r["end"] <= p["start"])
        take = lambda had, r: F.when(F.forall(had, apart(r)), F.array_append(had, r)).otherwise(had)
        return F.array_sort(F.aggregate(order, F.slice(order, F.lit(1), F.lit(0)), take))

    def written(parts: Column, cards: Column) -> Column:
        between = lambda a, b: F.array_join(F.slice(parts, a + 1, b - a), "")
        before = lambda q: F.when(q > 0, F.get(cards, q - 1)["end"]).otherwise(0)
        gap = lambda r: F.regexp_extract(F.get(parts, r["end"] - 1), "[ -]$", 0)
        put = lambda r, q: F.concat(between(before(q), r["start"]), _card(r["form"], key), gap(r))
        rest = between(F.get(cards, F.size(cards) - 1)["end"], F.size(parts))
        new = F.when(F.size(cards) > 0, F.concat(F.array_join(F.transform(cards, put), ""), rest))
        return F.struct(new.alias("new"), F.size(cards).alias("n"))

    pick = lambda parts: let(let(let(runs(parts), ranked), chosen), lambda cards: written(parts, cards))
    return let(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), pick)


def _phone(m: Column, key: Column) -> Column:
    first = lambda i: (i == 0) | (i == 3)
    low = lambda x, i: F.when(first(i) & (x >= 2), 2).otherwise(0)
    radix = lambda x, i: F.when(first(i), F.when(x >= 2, 8).otherwise(2)).otherwise(10)

    def mixed(ten: Column) -> Column:
        new = feistel(F.transform(ten, lambda x, i: x - low(x, i)), F.transform(ten, radix), key, "phone")
        return F.when(F.size(F.array_distinct(ten)) > 1, F.zip_with(new, F.transform(ten, low), lambda x, a: x + a))

    def whole(d: Column) -> Column:
        lead = F.size(d) - 10
        return F.concat(F.slice(d, F.lit(1), lead), let(F.slice(d, lead + 1, F.lit(10)), mixed))

    return let(let(_digits(m), whole), lambda new: F.when(new.isNotNull(), _refill(m, new)))


def _ipv4(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    write = lambda d: F.array_join(feistel(d, _ints(*[256] * 4), key, "ipv4").cast("array<string>"), ".")
    return let(octets, lambda d: F.when(F.forall(d, lambda x: x <= 255), write(d)))


def _date(m: Column, key: Column) -> Column:
    first = F.lit(EPOCH).cast("date")
    a, b = DAY_RADICES
    digits = lambda day: F.array(F.floor(day / b).cast("int"), F.pmod(day, F.lit(b)).cast("int"))
    write = lambda d: F.date_format(F.date_add(first, F.get(d, F.lit(0)) * b + F.get(d, F.lit(1))), "yyyy-MM-dd")
    new = lambda day: let(feistel(digits(day), _ints(a, b), key, "date"), write)
    return let(F.date_diff(m.try_cast("date"), first), lambda day: F.when(day.between(0, a * b - 1), new(day)))


def _ssn(m: Column, key: Column) -> Column:
    def new(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)) for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        digits = F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1)
        return F.when(valid, let(feistel(digits, _ints(898, 99, 9999), key, "ssn"), write))

    def write(d: Column) -> Column:
        area = F.get(d, F.lit(0)) + 1
        return F.format_string("%03d-%02d-%04d", area + (area >= 666).cast("int"), F.get(d, F.lit(1)) + 1, F.get(d, F.lit(2)) + 1)

    return let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), new)


def _email(m: Column, key: Column) -> Column:
    local = F.lower(F.substring_index(m, "@", 1))
    name = F.substr(F.sha2(F.concat_ws("|", key, F.lit("email"), local, F.lower(F.substring_index(m, "@", -1))), 256), F.lit(1), F.lit(32))
    return F.concat(F.lit("u"), name, F.lit("@"), F.substring_index(m, "@", -1))


def _one(new):
    """A kind whose matches are one value each."""
    return lambda m, key: F.struct(new(m, key).alias("new"), F.lit(1).alias("n"))


#: Kind, test of a match, pseudonym (null where the validation fails) and number of values. The order is that of ``ANY``.
KINDS = (
    ("email", "@", _one(_email)),
    ("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", _one(_date)),
    ("ssn", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _one(_ssn)),
    ("phone", r"^(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$", _one(_phone)),
    ("ipv4", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", _one(_ipv4)),
    ("card", "", _cards),
)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", findings: str = "pii_kinds") -> DataFrame:
    """Replace ``text`` by its pseudonymized form and add ``findings``: array<string>, the kind of each replaced value.

    A map over rows: no shuffle. Only texts that hold a candidate are taken apart. All other columns stay as they
    are; a column that is already called ``findings`` is replaced.
    """
    secret = F.lit(key)

    def judged(m: Column) -> Column:
        choice = lambda of: reduce(
            lambda rest, k: F.when(m.rlike(k[1]), of(k)).otherwise(rest), reversed(KINDS[:-1]), of(KINDS[-1])
        )
        return F.struct(choice(lambda k: F.lit(k[0])).alias("kind"), choice(lambda k: k[2](m, secret)).alias("made"), m.alias("old"))

    body = F.col(f"`{text}`")
    marked = F.split(F.regexp_replace(body, f"({ANY})", f"{MARK}$1{MARK}"), MARK, -1)
    matches = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    slow = F.flatten(F.zip_with(F.split(body, ANY, -1), matches, lambda gap, m: F.array(gap, F.coalesce(m, F.lit("")))))
    pieces = F.when(body.contains(MARK), slow).otherwise(marked)
    # Every second piece is a match.
    plain = lambda p: F.struct(F.lit(None).cast("string").alias("kind"), F.struct(F.lit(None).cast("string").alias("new"), F.lit(0).alias("n")).alias("made"), p.alias("old"))
    found = F.transform(pieces, lambda p, i: F.when((F.pmod(i, F.lit(2)) == 1) & (p != ""), judged(p)).otherwise(plain(p)))
    kept = docs.withColumn("__found", F.when(body.rlike(HINT), found))
    parts = F.transform("__found", lambda m: F.coalesce(m["made"]["new"], m["old"]))
    replaced = F.filter("__found", lambda m: m["made"]["new"].isNotNull())
    kinds = F.flatten(F.transform(replaced, lambda m: F.array_repeat(m["kind"], m["made"]["n"])))
    return kept.withColumns(
        {
            text: F.when(F.col("__found").isNotNull(), F.array_join(parts, "")).otherwise(body),
            findings: F.coalesce(kinds, F.array().cast("array<string>")),
        }
    ).drop("__found")
