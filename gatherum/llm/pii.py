"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted within their format by a keyed Feistel network, so equal values have equal
pseudonyms in every document and a value of a format stays one of that format:

* payment card numbers (13 to 19 digits, Luhn): all digits but the check digit, which is computed anew; separators stay;
* bank accounts (IBAN, mod 97): letters and digits behind the check digits, which are computed anew; country and spaces stay;
* phone numbers (+ and 8 to 15 digits): all digits behind the country code; punctuation stays;
* US social security numbers: a permutation of the valid ones;
* dates (calendar days of 1800 to 2199, as Y-M-D, D.M.Y or D/M/Y): a permutation of the 146,097 days of that cycle;
* IPv4 addresses: a permutation of all addresses;
* e-mail addresses: the local part, punctuation, length and domain stay. ASCII letters and digits are permuted in blocks of
  twelve; local parts with letters beyond ASCII character by character, each within its own alphabet.

Half-blocks have mixed radices whose product is exactly the size of the domain, so no cycle walking is needed. Where characters
have alphabets of their own, the network is unbalanced: each step shifts one character by a keyed function of all others, so it
can be undone step by step. Values that fail their check (a Luhn sum, a calendar day) are no personal data and stay.
DataFrame functions only, no shuffle. The key is secret: who has it can undo the permutations. It is never a default of the
library: callers give it, and queries take it from the configuration (``configured_key``).
"""

from __future__ import annotations

import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherum.llm.quality import let

#: The configuration that holds the key.
KEY_SETTING = "spark.gatherum.pii.key"
ROUNDS = 8
#: Times that each character is shifted in the unbalanced network.
TURNS = 3
_EPOCH, _DAYS = "1800-01-01", 146_097
#: Alphabets of single characters: (first code point, size). All others are runs of 32 code points.
ALPHABETS = [(48, 10), (65, 26), (97, 26), (0xE0, 23), (0xF8, 8), (0x3B1, 25), (0x430, 32), (0x450, 16), (0x4E00, 20_992), (0xAC00, 11_172)]
# Country calling codes of one and two digits; all others have three.
_CODES_OF_ONE = "17"
_CODES_OF_TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: What may be personal data, in this order where two start at one place.
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4})(?: (?=[A-Z]*\d)[A-Z0-9]{4}){1,6}(?: \d{1,3})?)(?![\p{L}\p{N}])",
    r"(?<!\d)\d{4}-\d{2}-\d{2}(?!-?\d)",
    r"(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?![./]?\d)",
    r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    r"\+\d(?:[ .()-]{0,2}\d){7,14}(?!\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    r"(?<!\d)\d{13,19}(?!\d)",
    r"(?<![\d-])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?![ -]?\d)",
    r"(?<![\d-])\d{4}[ -]\d{6}[ -]\d{5}(?![ -]?\d)",
])
KINDS = ("email", "date", "ip", "phone", "ssn", "card", "iban")


_made: dict[str, str] = {}


def configured_key(spark: SparkSession) -> str:
    """The key of the session's configuration; where none is set, one at random that lasts as long as the application, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key
    app = spark.sparkContext.applicationId
    if app not in _made:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms link within this application only", stacklevel=2)
        _made[app] = secrets.token_hex(32)
    return _made[app]


def _round(value: Column, side: Column, tweak: str, radix: int, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), side.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(radix))


def feistel(value: Column, a: int, b: int, tweak: str, key: str) -> Column:
    """A keyed permutation of the whole numbers from 0 to a * b - 1, for radices up to about 2**31."""

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 1, F.pmod(s["l"] + _round(s["r"], i, tweak, a, key), F.lit(a))).otherwise(s["l"])
        right = F.when(i % 2 == 0, F.pmod(s["r"] + _round(s["l"], i, tweak, b, key), F.lit(b))).otherwise(s["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = let(value, lambda v: F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r")))
    if a * b > 1 << 52:  # beyond what a quotient of doubles gives exactly
        start = let(value, lambda v: F.struct(((v - F.pmod(v, F.lit(b))) / b).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])


def _refill(form: Column, fresh: Column, letter: str) -> Column:
    """``form`` with the characters that match ``letter`` replaced by those of ``fresh``, in order."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
    step = lambda s, c: F.when(c.rlike(letter), F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substr(fresh, s["i"] + 1, F.lit(1))).alias("out"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out")))
    return F.aggregate(F.regexp_extract_all(form, F.lit("(?s)."), F.lit(0)), start, step, lambda s: s["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _permute_digits(digits: Column, sizes: range, tweak: str, key: str) -> Column:
    """A permutation of the digit strings of each length in ``sizes``."""
    out = F.lit(None).cast("string")
    for n in sizes:
        half = n // 2
        new = feistel(digits.cast("long"), 10 ** (n - half), 10**half, f"{tweak}{n}", key)
        out = F.when(F.length(digits) == n, F.lpad(new.cast("string"), n, "0")).otherwise(out)
    return out


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string; 0 modulo 10 if it is valid."""
    value = lambda c, i: let(c.cast("int"), lambda v: F.when(i % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", F.lit(0)).otherwise(value(F.when(c == "", F.lit("0")).otherwise(c), i))), F.lit(0), lambda a, b: a + b)


def _card(m: Column, key: str) -> Column:
    """A match that looks like an account number but isn't one may hold a card number behind its first four characters."""
    head = F.regexp_extract(m, r"^(?:[A-Z]{2}\d{2} ?)?", 0)

    def new(d: Column) -> Column:
        body = _permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), range(12, 19), "card", key)
        return F.when(luhn_sum(d) % 10 == 0, let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    def behind(rest: Column) -> Column:
        return F.when(rest.rlike(r"^\d[\d -]*$"), F.concat(head, let(_digits(rest), lambda d: _refill(rest, new(d), r"\d"))))

    return let(F.substr(m, F.length(head) + 1), behind)


def _phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        width = F.when(F.substr(d, F.lit(1), F.lit(1)).isin(*_CODES_OF_ONE), 1).when(F.substr(d, F.lit(1), F.lit(2)).isin(*_CODES_OF_TWO), 2).otherwise(3)
        return let(width, lambda w: F.concat(F.substr(d, F.lit(1), w), _permute_digits(F.substr(d, w + 1), range(5, 15), "phone", key)))

    return let(_digits(m), lambda d: _refill(m, new(d), r"\d"))


def _code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")


def _alphabet(point: Column) -> Column:
    """(first, size) of the alphabet of a code point."""
    entry = lambda first, size: F.struct(first.cast("long").alias("first"), F.lit(size).cast("long").alias("size"))
    out = entry(F.floor(point / 32) * 32, 32)
    for first, size in ALPHABETS:
        out = F.when((point >= first) & (point < first + size), entry(F.lit(first), size)).otherwise(out)
    return out


def shift_characters(text: Column, tweak: str | Column, key: str) -> Column:
    """A permutation of the texts with the same alphabets at each place: TURNS times, each character moves on in its alphabet by a keyed function of all others."""
    points = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), _code_point)
    cells = F.transform(points, lambda p: let(_alphabet(p), lambda a: F.struct((p - a["first"]).alias("at"), a["first"].alias("first"), a["size"].alias("size"))))

    def step(now: Column, k: Column) -> Column:
        place = F.pmod(k, F.size(now))
        others = F.array_join(F.transform(now, lambda x, i: F.when(i == place, F.lit("*")).otherwise((x["first"] + x["at"]).cast("string"))), ",")
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak) if isinstance(tweak, str) else tweak, k.cast("string"), others).cast("binary"), 256)
        by = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        moved = lambda x, d: F.struct(F.pmod(x["at"] + d, x["size"]).alias("at"), x["first"].alias("first"), x["size"].alias("size"))
        return let(by, lambda d: F.transform(now, lambda x, i: F.when(i == place, moved(x, d)).otherwise(x)))

    shown = lambda cells: F.array_join(F.transform(cells, lambda x: F.decode(F.unhex(F.lpad(F.hex(x["first"] + x["at"]), 8, "0")), "UTF-32")), "")
    turned = let(cells, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) * TURNS - 1), c, step, shown))
    return F.when(F.length(text) > 0, turned).otherwise(text)


def iban_remainder(solid: Column) -> Column:
    """What is left modulo 97 of an account number without spaces: 1 if it is valid."""
    turned = F.concat(F.substr(solid, F.lit(5)), F.substr(solid, F.lit(1), F.lit(4)))
    value = lambda c: F.conv(c, 36, 10).cast("long")
    return F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0).cast("long"), lambda a, c: F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    def new(solid: Column) -> Column:
        country = F.substr(solid, F.lit(1), F.lit(2))
        fresh = lambda body: F.concat(country, F.lpad((98 - iban_remainder(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body)
        return F.when(F.length(solid).between(15, 34) & (iban_remainder(solid) == 1), let(shift_characters(F.substr(solid, F.lit(5)), "iban", key), fresh))

    return let(F.regexp_replace(m, " ", ""), lambda s: _refill(m, new(s), "[A-Z0-9]"))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n)).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    number = (((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1).cast("long")

    def shown(v: Column) -> Column:
        serial_new, rest = v % 9999 + 1, F.floor(v / 9999)
        area_new = let(F.floor(rest / 99) + 1, lambda a: a + F.when(a >= 666, 1).otherwise(0))
        return F.concat_ws("-", F.lpad(area_new.cast("string"), 3, "0"), F.lpad((rest % 99 + 1).cast("string"), 2, "0"), F.lpad(serial_new.cast("string"), 4, "0"))

    return F.when(valid, let(feistel(number, 898 * 99, 9999, "ssn", key), shown))


def _date(m: Column, key: str) -> Column:
    number = lambda group: F.regexp_extract(m, r"^(\d+)[-./](\d+)[-./](\d+)$", group)
    iso = m.rlike(r"^\d{4}-")
    text = F.when(iso, m).otherwise(F.concat_ws("-", number(3), F.lpad(number(2), 2, "0"), F.lpad(number(1), 2, "0")))
    epoch = F.lit(_EPOCH).cast("date")

    def shown(day: Column) -> Column:
        new = F.date_add(epoch, feistel(F.date_diff(day, epoch).cast("long"), 189, 773, "date", key).cast("int"))
        wide = lambda form, n, group: F.when(F.length(number(group)) == 2, F.lpad(F.date_format(new, form), 2, "0")).otherwise(F.date_format(new, n))
        mark = F.substr(F.regexp_extract(m, r"(\D)", 1), F.lit(1), F.lit(1))
        other = F.concat(wide("dd", "d", 1), mark, wide("MM", "M", 2), mark, F.date_format(new, "yyyy"))
        return F.when((day >= epoch) & (F.date_diff(day, epoch) < _DAYS), F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(other))

    return let(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), shown)


def _ip(m: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        octet = lambda i: F.get(p, F.lit(i)).cast("long")
        value = octet(0) * 16_777_216 + octet(1) * 65_536 + octet(2) * 256 + octet(3)
        fine = (octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256)
        shown = lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / d), F.lit(256)).cast("string") for d in (16_777_216, 65_536, 256, 1)])
        return F.when(fine, let(feistel(value, 65_536, 65_536, "ip", key), shown))

    return let(F.split(m, r"\."), new)


def _email(m: Column, key: str) -> Column:
    """The local part's letters and digits are permuted as one, each within its alphabet, by a permutation of the domain; the domain stays.

    A local part of one ASCII character is permuted among the 36 of them, as a shift would keep their order.
    """
    local, domain = F.lower(F.substring_index(m, "@", 1)), F.lower(F.substring_index(m, "@", -1))
    letters = F.regexp_replace(local, r"[^\p{L}\p{N}]", "")
    single = lambda c: F.lower(F.conv(feistel(F.conv(c, 36, 10).cast("long"), 6, 6, "email1", key).cast("string"), 10, 36))
    fresh = lambda c: F.when(c.rlike("^[a-z0-9]$"), single(c)).otherwise(shift_characters(c, F.concat(F.lit("email|"), domain), key))
    return F.concat(let(letters, lambda c: let(fresh(c), lambda f: _refill(local, f, r"[\p{L}\p{N}]"))), F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[A-Z]{2}\d{2}") & (iban_remainder(F.regexp_replace(m, " ", "")) == 1), "iban")
        .when(m.rlike(r"^\+"), "phone")
        .when(m.rlike(r"^\d{4}-\d\d-\d\d$|^\d{1,2}([./])\d{1,2}\1\d{4}$"), "date")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
        .otherwise("card")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a match of PATTERN; null if it fails its check."""
    make = {"email": _email, "phone": _phone, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "iban": _iban}
    out = F.lit(None).cast("string")
    for name, of in make.items():
        out = F.when(kind == name, of(m, key)).otherwise(out)
    return out


def _rewritten(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    """``row`` (all columns as they came), ``text`` with pseudonyms, ``valid``: what was replaced."""
    none = F.array().cast("array<string>")
    text = F.col(text_col)
    found = F.coalesce(F.when(text.rlike("[@0-9]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))), none)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), found.alias("found"))
    named = F.transform("found", lambda m: let(kind_of(m), lambda k: F.struct(m.alias("raw"), k.alias("kind"), pseudonym(m, k, key).alias("new"))))
    rows = rows.select("row", "text", F.when(F.size("found") > 0, named).alias("named"))

    def rebuilt(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("named"), i)["new"], F.get(F.col("named"), i)["raw"], F.lit("")))), "")

    whole = F.when(F.col("named").isNull(), F.col("text")).otherwise(let(F.split("text", PATTERN, -1), rebuilt))
    valid = F.filter(F.coalesce("named", F.array().cast("array<struct<raw:string,kind:string,new:string>>")), lambda x: x["new"].isNotNull())
    return rows.select("row", whole.alias("text"), valid.alias("valid"))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_<kind> for each kind, n_pii.

    Null texts stay null with zero counts; texts without personal data stay as they are, texts of any length are read whole;
    repeated rows stay, equal values have equal pseudonyms; an empty table gives no rows; other columns are ignored.
    """

    def number_of(kind: str) -> Column:
        return F.size(F.filter("valid", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kept = docs.select(F.col(id_col), F.col(text_col))
    return _rewritten(kept, text_col, key).select(F.col("row")[id_col].cast("long").alias("doc_id"), "text", *map(number_of, KINDS), F.size("valid").cast("long").alias("n_pii"))


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced; all other columns as they came."""
    return _rewritten(docs, text_col, key).select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
