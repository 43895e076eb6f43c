"""Pseudonyms against a plain version that rewrites one match at a time."""

import datetime as dt
import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from gatherum.llm import pii

KEY = "a key of the test"


def keyed(tweak, side, value):
    return int(hashlib.sha256(f"{KEY}|{tweak}|{side}|{value}".encode()).hexdigest()[:15], 16)


def permuted(v, a, b, tweak):
    left, right = divmod(v, b)
    for i in range(1, 9):
        if i % 2:
            left = (left + keyed(tweak, i, right) % a) % a
        else:
            right = (right + keyed(tweak, i, left) % b) % b
    return left * b + right


def digits_permuted(digits, tweak):
    n = len(digits)
    return str(permuted(int(digits), 10 ** (n - n // 2), 10 ** (n // 2), f"{tweak}{n}")).zfill(n)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10


def refilled(form, fresh, letter):
    it = iter(fresh)
    return "".join(next(it) if letter(c) else c for c in form)


def card(m):
    head = regex.match(r"(?:[A-Z]{2}\d{2} ?)?", m)[0]
    rest = m[len(head) :]
    d = regex.sub(r"\D", "", rest)
    if not regex.fullmatch(r"\d[\d -]*", rest) or luhn(d) or not 13 <= len(d) <= 19:
        return None
    body = digits_permuted(d[:-1], "card")
    return head + refilled(rest, body + str(-luhn(body + "0") % 10), str.isdigit)


def phone(m):
    d = regex.sub(r"\D", "", m)
    w = 1 if d[0] in "17" else 2 if d[:2] in pii._CODES_OF_TWO else 3
    return refilled(m, d[:w] + digits_permuted(d[w:], "phone"), str.isdigit)


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    v = permuted(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
    v, serial = divmod(v, 9999)
    area, group = divmod(v, 99)
    return f"{area + 1 + (area + 1 >= 666):03}-{group + 1:02}-{serial + 1:04}"


def date(m):
    iso = m[4] == "-" if len(m) > 4 else False
    mark = regex.search(r"\D", m)[0]
    parts = m.split(mark)
    y, mo, d = map(int, parts if iso else parts[::-1])
    try:
        days = (dt.date(y, mo, d) - dt.date(1800, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= days < 146_097:
        return None
    new = dt.date(1800, 1, 1) + dt.timedelta(permuted(days, 189, 773, "date"))
    return new.isoformat() if iso else mark.join([str(new.day).zfill(len(parts[0])), str(new.month).zfill(len(parts[1])), str(new.year)])


def ip(m):
    octets = [int(x) for x in m.split(".")]
    if max(octets) > 255:
        return None
    v = permuted(int.from_bytes(bytes(octets), "big"), 65_536, 65_536, "ip")
    return ".".join(map(str, v.to_bytes(4, "big")))


def shifted(text, tweak):
    cells = []
    for p in map(ord, text):
        first, size = next(((f, n) for f, n in pii.ALPHABETS if f <= p < f + n), (p // 32 * 32, 32))
        cells.append([p - first, first, size])
    for k in range(len(cells) * pii.TURNS):
        i = k % len(cells)
        others = ",".join("*" if j == i else str(c[0] + c[1]) for j, c in enumerate(cells))
        cells[i][0] = (cells[i][0] + keyed(tweak, k, others)) % cells[i][2]
    return "".join(chr(c[0] + c[1]) for c in cells)


def email(m):
    local, domain = m.lower().partition("@")[0], m.rpartition("@")[2]
    letter = lambda c: bool(regex.match(r"[\p{L}\p{N}]", c))
    letters, digits = "".join(filter(letter, local)), "0123456789abcdefghijklmnopqrstuvwxyz"
    new = digits[permuted(int(letters, 36), 6, 6, "email1")] if regex.fullmatch("[a-z0-9]", letters) else shifted(letters, f"email|{domain.lower()}")
    return refilled(local, new, letter) + "@" + domain


def remainder(solid):
    return int("".join(str(int(c, 36)) for c in solid[4:] + solid[:4])) % 97


def iban(m):
    solid = m.replace(" ", "")
    body = shifted(solid[4:], "iban")
    return refilled(m, solid[:2] + f"{98 - remainder(solid[:2] + '00' + body):02}" + body, lambda c: c != " ")


def rewritten(text):
    counts = dict.fromkeys(pii.KINDS, 0)

    def one(match):
        m = match[0]
        if "@" in m:
            kind = "email"
        elif regex.match(r"[A-Z]{2}\d{2}", m):
            kind = "iban" if 15 <= len(m.replace(" ", "")) <= 34 and remainder(m.replace(" ", "")) == 1 else "card"
        elif m[0] == "+":
            kind = "phone"
        elif regex.fullmatch(r"\d{4}-\d\d-\d\d|\d{1,2}([./])\d{1,2}\1\d{4}", m):
            kind = "date"
        elif regex.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
            kind = "ip"
        else:
            kind = "ssn" if regex.fullmatch(r"\d{3}-\d\d-\d{4}", m) else "card"
        new = {"email": email, "phone": phone, "date": date, "ip": ip, "ssn": ssn, "card": card, "iban": iban}[kind](m)
        counts[kind] += new is not None
        return m if new is None else new

    return regex.sub(pii.PATTERN, one, text), counts


def samples():
    rng = random.Random(8)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = [
        "write to jürgen.müller@beispiel.de, Jürgen.Müller@beispiel.de or иван_5@почта.example.ru 李雷@example.cn a+b.c-d@x.org", "Call +49 30 1234567, +49 30 1234568, +1 (212) 555-0100 and +420 601 123 456.",
        "IBAN DE89 3704 0044 0532 0130 00 AND DE89370400440532013000, GB29NWBK60161331926819; bad DE88370400440532013000", "AB12 4111 1111 1111 1111 and 4111-1111-1111-1111 4111 1111 1111 1111 5500000000000004 378282246310005 3782 822463 10005",
        "29.02.2000 1/2/1999 31.12.2199 2199-12-31 1800-01-01 1799-12-31 2001-02-30 29.2.1900", "10.0.0.255 999.1.1.1 0.0.0.0 255.255.255.255 1.2.3.4.5", "123-45-6789 000-12-3456 666-01-0001 899-99-9999 667-01-0001", "", "no data @ all 12", "x@y",
    ]
    for _ in range(150):
        body = d(rng.randrange(12, 19))
        parts = [body + next(c for c in "0123456789" if luhn(body + c) == 0), d(16), f"+{d(rng.randrange(8, 16))}", f"{d(3)}-{d(2)}-{d(4)}", f"{rng.randrange(1, 40)}.{rng.randrange(1, 14)}.{rng.randrange(1750, 2250)}"]
        parts += [f"{rng.choice(['eva', 'öz', 'a_b', 'x9'])}{d(rng.randrange(0, 15))}@m{d(1)}.example.com", ".".join(str(rng.randrange(300)) for _ in range(4))]
        country, bban = rng.choice(["DE", "FR", "CH"]), d(rng.randrange(11, 24)) + rng.choice(["", "AB", "Z1"])
        parts.append(country + f"{98 - remainder(country + '00' + bban):02}" + bban)
        rng.shuffle(parts)
        out.append("; ".join(parts))
    return out


def test_texts_are_those_of_the_plain_version(spark):
    texts = [*samples(), None, "word " * 30_000 + "eva@example.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("a.b", F.lit(1)).withColumn("named", F.lit(2))
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, KEY).collect()}
    total = dict.fromkeys(pii.KINDS, 0)
    for k, text in enumerate(texts):
        want, counts = (None, dict.fromkeys(pii.KINDS, 0)) if text is None else rewritten(text)
        assert got[k]["text"] == want
        assert {kind: got[k][f"n_{kind}"] for kind in pii.KINDS} == counts and got[k]["n_pii"] == sum(counts.values())
        total = {kind: total[kind] + counts[kind] for kind in total}
    assert min(total.values()) >= 3
    kept = pii.with_pseudonyms(df, KEY)
    assert kept.columns == df.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == {k: got[k]["text"] for k in got}


def test_formats_stay(spark):
    values = ["jürgen.müller@beispiel.de", "+49 30 1234567", "+420 601 123 456", "DE89 3704 0044 0532 0130 00"]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, KEY).collect()}
    assert regex.fullmatch(r"\p{L}{6}\.\p{L}{6}@beispiel\.de", new[0]) and new[0] != values[0]
    assert regex.fullmatch(r"\+49 \d\d \d{7}", new[1]) and regex.fullmatch(r"\+420 \d{3} \d{3} \d{3}", new[2])
    assert regex.fullmatch(r"DE\d\d( \d{4}){4} \d\d", new[3]) and remainder(new[3].replace(" ", "")) == 1 and new[3] != values[3]


def test_character_shifts_permute(spark):
    texts = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "0123456789"] + [a + b for a in map(chr, range(0x430, 0x450)) for b in "0123456789"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["x"] for r in df.select(pii.shift_characters(F.col("t"), "t", KEY).alias("x")).collect()]
    assert len(set(got)) == len(texts) and set(got) == set(texts)


def test_key_is_never_a_default(spark):
    with pytest.raises(TypeError):
        pii.pseudonymise(spark.range(1).selectExpr("id as doc_id", "'x' as text"))
    spark.conf.unset(pii.KEY_SETTING)
    made = pii.configured_key(spark)
    assert made == pii.configured_key(spark) and len(made) == 64
    spark.conf.set(pii.KEY_SETTING, "set by hand")
    assert pii.configured_key(spark) == "set by hand"
    spark.conf.unset(pii.KEY_SETTING)


def test_addresses_are_permuted_whole(spark):
    pairs = [("abcdefghijkl.one@x.org", "abcdefghijkl.two@x.org"), ("anna.m@x.org", "anna.n@x.org"), ("long.name.of.many.letters@x.org", "long.name.of.many.letterz@x.org")]
    singles = [f"{c}@x.org" for c in "abcdefgh"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*sum(pairs, ()), *singles])], "doc_id long, text string")
    new = [r["text"] for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]
    for a, b in zip(new[:6:2], new[1:6:2]):
        assert a.endswith("@x.org") and sum(x == y for x, y in zip(a.partition("@")[0], b.partition("@")[0]) if x.isalpha()) < 6 and a[:4] != b[:4]
    letters = [t[0] for t in new[6:]]
    assert len(set(letters)) == 8 and letters != sorted(letters)
