"""Pseudonyms against a plain Python version of the same network."""

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from barquet.llm import pii

KEY = "k1"


def net(digits, radices, kind):
    cut = len(digits) // 2
    l, r, rl, rr = digits[:cut], digits[cut:], radices[:cut], radices[cut:]

    def stream(other, i):
        t = f"{KEY}|{kind}|{len(digits)}|{i}|" + ",".join(map(str, other))
        h = hashlib.sha512(t.encode()).hexdigest()
        return lambda j: int(h[6 * j : 6 * j + 6], 16)

    for i in range(8):
        if i % 2 == 0:
            f = stream(r, i)
            l = [(d + f(j)) % rl[j] for j, d in enumerate(l)]
        else:
            f = stream(l, i)
            r = [(d + f(j)) % rr[j] for j, d in enumerate(r)]
    return l + r


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10


def refill(form, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: str(next(it)), form)


def plain(m):
    d = [int(c) for c in m if c.isdigit()]
    if "@" in m:
        local, domain = m.rsplit("@", 1)
        return "u" + hashlib.sha256(f"{KEY}|email|{local.lower()}|{domain.lower()}".encode()).hexdigest()[:32] + "@" + domain
    if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
        try:
            n = (dt.date.fromisoformat(m) - dt.date(1900, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= n < 73049:
            return m
        a, b = net([n // 4297, n % 4297], [17, 4297], "date")
        return (dt.date(1900, 1, 1) + dt.timedelta(a * 4297 + b)).isoformat()
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, g, s = map(int, m.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and s):
            return m
        a, g, s = net([a - 1 - (a > 666), g - 1, s - 1], [898, 99, 9999], "ssn")
        a += 1
        return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = list(map(int, m.split(".")))
        return ".".join(map(str, net(o, [256] * 4, "ipv4"))) if max(o) < 256 else m
    if re.fullmatch(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}", m):
        ten = d[-10:]
        if len(set(ten)) == 1:
            return m
        low = [2 if i in (0, 3) and x > 1 else 0 for i, x in enumerate(ten)]
        radices = [(8 if x > 1 else 2) if i in (0, 3) else 10 for i, x in enumerate(ten)]
        return refill(m, d[:-10] + [x + a for x, a in zip(net([x - a for x, a in zip(ten, low)], radices, "phone"), low)])
    if luhn(d):
        return m
    p = net(d[:-1], [10] * (len(d) - 1), "card")
    return refill(m, p + [next(c for c in range(10) if luhn([*p, c]) == 0)])


def brute(text):
    return None if text is None else re.sub(pii.ANY, lambda m: plain(m[0]), text)


CASES = [
    None,
    "",
    "no numbers here, only words",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111111; not 4111111111111112",
    "0007687199101951 is short of valid? 12345678901234567890123 too long",
    "call +1 (017) 555-7713 or 1-217-555-0199 or (217) 555-0199.",
    "no phones: 000-000-0000, +1 (222) 222-2222; a mark \x01 beside 8.8.8.8\x01, 217-555-0199 \x01",
    "ip 97.51.17.173, not 297.51.17.173, version 1.2.3.4.5",
    "born 1984-02-29, not 1983-02-29, not 1850-01-01, 2099-12-31 1900-01-01",
    "ssn 078-05-1120 667-01-0001 665-99-9999 but 666-12-1234 000-12-3456 900-12-1234 123-00-1234",
    "mail Of.55@mail9.example.com, of.55@MAIL9.example.com; not a@b",
    "é" * 50_000 + " 4111111111111111 " + "x" * 200_000,
]


def test_against_plain_version(spark):
    rows = [(i, t, "kept") for i, t in enumerate(CASES)] + [(3, CASES[3], "kept")]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, pii_kinds string"), KEY).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == brute(CASES[r.doc_id])
    kinds = {r.doc_id: r.pii_kinds for r in out}
    assert kinds[3] == ["card"] * 3 and kinds[0] == [] and kinds[5] == ["phone"] * 3 and kinds[8] == ["date"] * 3
    assert kinds[6] == ["ipv4", "phone"] and kinds[9] == ["ssn"] * 3 and kinds[7] == ["ipv4"] and kinds[10] == ["email"] * 2


def test_equal_values_stay_linked(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("4111111111111111",)], "text string")
    a, b = (r.text for r in pii.pseudonymize(df, KEY).collect())
    assert a.replace(" ", "") == b != "4111111111111111"


def test_dates_are_permuted(spark):
    days = spark.range(0, 73049, 7).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = pii.pseudonymize(days, KEY)
    assert out.select("text").distinct().count() == days.count()


def test_empty_table(spark):
    assert pii.pseudonymize(spark.createDataFrame([], "text string"), KEY).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: r.text for r in pii.pseudonymize(docs, KEY).collect()}
    assert got == want


def cards_of(run):
    """Brute force over all runs of whole groups: the run with its cards replaced, and their number."""
    groups = list(re.finditer("[0-9]+", run))
    spans = [(a.start(), b.end()) for i, a in enumerate(groups) for b in groups[i:]]
    good = [s for s in spans if 13 <= len(re.sub(r"\D", "", run[s[0] : s[1]])) <= 19 and not luhn([int(c) for c in run[s[0] : s[1]] if c.isdigit()])]
    shapes = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)}

    def together(s):
        part = run[s[0] : s[1]]
        return len(set(re.sub("[0-9]", "", part))) <= 1 and (part.isdigit() or tuple(map(len, re.split("[ -]", part))) in shapes)

    had = []
    for s in sorted(good, key=lambda s: (not together(s), s[0], -s[1])):
        if all(s[1] <= t[0] or t[1] <= s[0] for t in had):
            had.append(s)
    for a, b in sorted(had, reverse=True):
        run = run[:a] + plain(run[a:b]) + run[b:]
    return run, len(had)


def test_adjacent_values(spark):
    """Each value beside a card is replaced as if it stood alone; other digit groups don't hide a card."""
    forms = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "6011000990139424", "4222222222222", "30569309025904"]
    others = ["170.106.47.218", "8.8.8.8", "123-45-6789", "1984-02-29", "217-555-0199", "1-217-555-0199", "12ab@mail.example.com", *forms]
    rows, want = [], []
    for card in forms:
        for other in others:
            for left, right in ((card, other), (other, card)):
                for end in ("", ".", " and so on"):
                    rows.append(f"{left} {right}{end}")
                    want.append((f"{plain(left)} {plain(right)}{end}", 2))
        for few in ("1", "12", "123", "9", "007"):
            rows += [f"{card} {few}", f"{few} {card}", f"x {few}-{card} {few} y"]
            want += [cards_of(t) for t in rows[-3:]]
    rows += ["4111 11 1111-1111 11", "12 34 56 78 90 12 34 56 78 90 12 34", "4111111111111112 123", "4111111111111111-170.106.47.218", "4111 1111 1111 1111 1234 8.8.8.8"]
    want += [cards_of(t) for t in rows[-5:-2]] + [(f"{plain(forms[0])}-{plain('170.106.47.218')}", 2), (f"{plain(forms[1])} 1234 {plain('8.8.8.8')}", 2)]
    out = pii.pseudonymize(spark.createDataFrame(list(enumerate(rows)), "id int, text string"), KEY).orderBy("id").collect()
    assert [(r.text, len(r.pii_kinds)) for r in out] == want


def test_random_groups(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        text = "".join("".join(rng.choices("0123456789", k=rng.choice((1, 2, 3, 4, 4, 4, 6, 13, 16)))) + rng.choice("   -") for _ in range(rng.randint(1, 12)))[:-1]
        if len(re.sub(r"\D", "", text)) >= 13 and not re.search("|".join((pii.DATE, pii.SSN, pii.PHONE)), text):
            rows.append(text)
    out = pii.pseudonymize(spark.createDataFrame(list(enumerate(rows)), "id int, text string"), KEY).orderBy("id").collect()
    assert len(rows) > 100 and [(r.text, len(r.pii_kinds)) for r in out] == [cards_of(t) for t in rows]


def test_very_long_run_of_groups(spark):
    text = "1234 5678 " * 2000
    row = pii.pseudonymize(spark.createDataFrame([(text,)], "text string"), KEY).first()
    assert len(row.text) == len(text)


def test_phones_keep_their_rules(spark):
    """Area and exchange from 2-9 stay so, and no two numbers of a form become one."""
    rng = random.Random(6)
    numbers = sorted({f"{rng.randint(2, 9)}{rng.randint(0, 99):02d}-{rng.randint(2, 9)}{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}" for _ in range(2000)})
    out = [r.text for r in pii.pseudonymize(spark.createDataFrame([(n,) for n in numbers], "text string"), KEY).collect()]
    assert all(re.fullmatch(r"[2-9]\d\d-[2-9]\d\d-\d{4}", x) for x in out) and len(set(out)) == len(numbers) and set(out) != set(numbers)
