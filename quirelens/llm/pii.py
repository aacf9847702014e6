"""Pseudonyms for personal data that keep its format, by a keyed Feistel permutation.

Everything is an expression of built-in functions. A value's free characters are cut
in two halves; in each round one half is shifted, character by character within its
class (digit, small letter, capital), by a stream made of the key and the other half.
That can be undone, so different values get different pseudonyms, and equal values get
equal ones in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm.common import fresh

ROUNDS = 8  # even, so that both halves end where they began
KEY = "a key of the data owner"  # for tests; whoever publishes pseudonyms gives a secret one

# Marks around what was found; a text that holds them itself has them set apart first.
MARK, AWAY = "\x01", "\x02"

# The formats that are looked for.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
# A digit at a time, so that no run of digits is tried in more than one way.
PHONE = r"(?<![0-9+])(?:\+[0-9](?:(?:[ .-]|[ .-]?\(|\)[ .-]?)?[0-9]){7,14}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9])"
# A longer run of groups is looked at in pieces of whole groups: a pattern without a limit is too deep for long texts.
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,63}(?![0-9])"
CARD_LEAST, CARD_MOST = 13, 19  # digits of a card number
# How a card number is written inside a longer run: in one piece, by fours, as 4-6-4 or 4-6-5, or digit by digit.
LAYOUT = (
    r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?"
    r"|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9](?:([ -])[0-9])(?:\3[0-9]){11,17})$"
)
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9/-])"
FORMATS = (("email", EMAIL), ("date", DATE), ("ssn", SSN), ("ip", IPV4), ("phone", PHONE), ("card", CARD))
FIRST_YEAR, YEARS = 1900, 200


def _stream(key: Column, label: str, turn: Column, half: Column) -> Column:
    """128 hex digits that depend on all of what is given."""
    return F.sha2(F.concat_ws("|", key, F.lit(label), turn.cast("string"), half), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shifted(half: Column, stream: Column) -> Column:
    """Each character moved on within its class; others stay."""

    def move(i):
        letter = F.substring(half, i + 1, F.lit(1))
        code = F.ascii(letter)
        turn = lambda base, size: F.chr((F.pmod(code - base + _byte(stream, i), F.lit(size)) + base).cast("bigint"))
        small = F.when((code >= 97) & (code <= 122), turn(97, 26))
        return small.when((code >= 48) & (code <= 57), turn(48, 10)).when((code >= 65) & (code <= 90), turn(65, 26)).otherwise(letter)

    places = F.sequence(F.lit(0), F.char_length(half) - 1)
    return F.when(half == "", F.lit("")).otherwise(F.array_join(F.transform(places, move), ""))


def permuted(value: Column, key: Column, label: str) -> Column:
    """A permutation of the strings of the same length and character classes."""
    middle = F.floor(F.char_length(value) / 2).cast("int")
    # The accumulator holds both halves, so no round repeats an earlier one's expression.
    start = F.struct(F.substring(value, F.lit(1), middle).alias("a"), F.substring(value, middle + 1, F.char_length(value)).alias("b"))
    turns = F.array(*[F.lit(i) for i in range(ROUNDS)])
    step = lambda s, i: F.struct(s["b"].alias("a"), _shifted(s["a"], _stream(key, label, i, s["b"])).alias("b"))
    return F.aggregate(turns, start, step, lambda s: F.concat(s["a"], s["b"]))


def permuted_pair(a: Column, b: Column, size_a: int, size_b: int, key: Column, label: str) -> Column:
    """A permutation of the pairs below ``size_a`` and ``size_b``: a struct of a and b."""

    def number(turn, half):
        return F.conv(F.substring(_stream(key, label, turn, half.cast("string")), F.lit(1), F.lit(12)), 16, 10).cast("bigint")

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(s, i):
        left = F.pmod(s["a"] + number(i * 2, s["b"]), F.lit(size_a))
        return F.aggregate(F.array(left), s, lambda t, x: F.struct(x.alias("a"), F.pmod(t["b"] + number(i * 2 + 1, x), F.lit(size_b)).alias("b")))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS // 2)]), start, step)


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one not doubled."""
    reverse = F.reverse(digits)

    def add(total, i):
        d = F.substring(reverse, i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add)


def _laid_out(layout: Column, digits: Column) -> Column:
    """``digits`` put in the places of the digits of ``layout``."""
    state = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def put(s, letter):
        digit = letter.between("0", "9")
        return F.struct(
            F.concat(s["text"], F.when(digit, F.substring(digits, s["next"], F.lit(1))).otherwise(letter)).alias("text"),
            F.when(digit, s["next"] + 1).otherwise(s["next"]).alias("next"),
        )

    return F.aggregate(F.split(layout, ""), state, put, lambda s: s["text"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _card(v: Column, key: Column) -> Column:
    """The run of digits with its card numbers replaced, null if it holds none.

    A number has 13 to 19 digits and passes the Luhn check. It is the whole run, or whole groups of it laid out as
    card numbers are; from the left, the longest that begins at a group wins. So an expiry date or a
    check value behind a number does not hide it, and neither digits from the inside of a longer group nor
    dates and numbers in a row are taken for one.
    """

    def changed(text):
        body = lambda d: permuted(F.substring(d, F.lit(1), F.char_length(d) - 1), key, "card")
        check = lambda b: F.concat(b, F.pmod(F.lit(10) - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))
        return _once(_digits(text), lambda d: _laid_out(text, _once(body(d), check)))

    def valid(text):
        fits = lambda d: F.when(F.char_length(d).between(CARD_LEAST, CARD_MOST), (F.pmod(luhn(d), F.lit(10)) == 0) & (F.translate(d, "0", "") != "")).otherwise(F.lit(False))
        return F.when((text == v) | text.rlike(LAYOUT), _once(_digits(text), fits)).otherwise(F.lit(False))

    def whole(parts):
        n = F.size(parts)

        def upto(i):
            # Longest first; every group has a digit and every second part is a separator.
            ends = F.sequence(F.least(n, i + 2 * CARD_MOST - 2), i, F.lit(-1))
            texts = F.transform(ends, lambda j: F.struct(j.alias("j"), F.array_join(F.slice(parts, i, j - i + 1), "").alias("text")))
            return F.get(F.filter(texts, lambda t: valid(t["text"])), F.lit(0))

        def step(s, i):
            kept = F.struct(F.concat(s["text"], F.element_at(parts, i)).alias("text"), (i + 1).alias("next"), s["any"].alias("any"))
            found = lambda t: F.when(t.isNull(), kept).otherwise(
                F.struct(F.concat(s["text"], changed(t["text"])).alias("text"), (t["j"] + 1).alias("next"), F.lit(True).alias("any")))
            return F.when(i < s["next"], s).otherwise(_once(upto(i), found))

        start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"), F.lit(False).alias("any"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.when(s["any"], s["text"]))

    return _once(F.regexp_extract_all(v, F.lit("[0-9]+|[ -]"), F.lit(0)), whole)


def _phone(v: Column, key: Column) -> Column:
    code = F.regexp_extract(v, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(v, F.char_length(code) + 1, F.char_length(v))
    count = F.char_length(_digits(v))
    return F.when(count.between(8, 15), F.concat(code, _laid_out(rest, permuted(_digits(rest), key, "phone"))))


def _ip(v: Column, key: Column) -> Column:
    def make(o):
        pair = permuted_pair(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 65536, 65536, key, "ip")
        show = lambda p: F.concat_ws(".", *[F.floor(p[x] / 256).cast("string") if high else F.pmod(p[x], F.lit(256)).cast("string") for x in "ab" for high in (True, False)])
        return _once(pair, show)

    return _once(F.split(v, "[.]").try_cast("array<int>"), lambda o: F.when(F.forall(o, lambda x: x <= 255), make(o)))


def _ssn(v: Column, key: Column) -> Column:
    area, group, serial = (F.substring(v, F.lit(i), F.lit(n)).try_cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    at = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    pair = permuted_pair(at, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def show(p):
        number = F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1)
        return F.concat_ws(
            "-", F.lpad(number.cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0")
        )

    return F.when(valid, _once(pair, show))


def _date(v: Column, key: Column) -> Column:
    """Days of 365-day years among themselves, leap days among leap days; the layout stays."""
    iso = v.substr(5, 1) == "-"
    plain = F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2))
    swapped = F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 1, 2), F.substring(v, 4, 2))
    read = lambda text: F.try_to_date(text, "yyyy-MM-dd")

    def make(s):
        day, form = s["day"], s["form"]
        year, of_year = F.year(day), F.dayofyear(day)
        leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        leap_day = leap(year) & (of_year == 60)
        short = of_year - 1 - F.when(leap(year) & (of_year > 60), 1).otherwise(0)

        def to_date(p):
            y = p["a"] + FIRST_YEAR
            n = p["b"] + F.when(leap(y) & (p["b"] >= 59), 1).otherwise(0)
            return F.date_add(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), n.cast("int"))

        days = _once(permuted_pair(year - FIRST_YEAR, short, YEARS, 365, key, "date"), to_date)
        # 49 leap years from 1904 to 2096, as 7 times 7.
        number = F.floor((year - 1904) / 4)
        leaps = _once(
            permuted_pair(F.floor(number / 7), number % 7, 7, 7, key, "leap"),
            lambda p: F.make_date(((p["a"] * 7 + p["b"]) * 4 + 1904).cast("int"), F.lit(2), F.lit(29)),
        )
        new = F.when(leap_day, leaps).otherwise(days)
        # The separator is the value's own.
        mark = F.substring(v, 3, 1)
        laid = F.when(form == 0, F.date_format(new, "yyyy-MM-dd")).when(
            form == 1, F.concat(F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy"))
        ).otherwise(F.concat(F.date_format(new, "MM"), mark, F.date_format(new, "dd"), mark, F.date_format(new, "yyyy")))
        return F.when(year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), laid)

    found = F.when(iso, F.struct(read(v).alias("day"), F.lit(0).alias("form"))).when(
        read(plain).isNotNull(), F.struct(read(plain).alias("day"), F.lit(1).alias("form"))
    ).otherwise(F.struct(read(swapped).alias("day"), F.lit(2).alias("form")))
    return _once(found, lambda s: F.when(s["day"].isNotNull(), make(s)))


def _email(v: Column, key: Column) -> Column:
    return F.concat(permuted(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


MAKERS = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: Column) -> Column:
    """kind and text of a value's pseudonym, null when it is not a valid value of its format."""

    def made(kind):
        return _once(MAKERS[kind](value, key), lambda t: F.when(t.isNotNull(), F.struct(F.lit(kind).alias("kind"), t.alias("text"))))

    out = F.lit(None).cast("struct<kind:string,text:string>")
    for kind, pattern in reversed(FORMATS):
        out = F.when(value.rlike("^(?:" + pattern + ")$"), made(kind)).otherwise(out)
    return out


def pseudonymize(documents: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with their columns, pseudonyms in ``text``, and ``found``: how many of each kind.

    Looked for are card numbers that pass the Luhn check, phone numbers, valid IPv4
    addresses, valid US social security numbers, valid dates from 1900 to 2099 and
    e-mail addresses (their local part). A pseudonym has the layout of its value, is
    valid itself (a number behind a card's in the same run of digits stays), and is the same wherever the value comes: for a pair of spellings
    that differ in separators the digits stay the same too. Invalid numbers and dates
    stay as they are. A day-month order that could be read both ways is read as day
    first.

    Null texts stay null, texts without finds come back unchanged with an empty map,
    texts are read whole, repeated rows are treated alike, an empty table gives no
    rows, and other columns are carried along, but for an own ``found``.
    """
    union = "(" + "|".join(p for _, p in FORMATS) + ")"
    text = F.col("text")
    # No narrower than the formats: each has an @ or two digits with at most two other characters between them.
    likely = text.rlike("[0-9][^0-9]{0,2}[0-9]|@")
    marked = text.contains(MARK) | text.contains(AWAY)
    safe = F.when(marked, F.replace(F.replace(text, F.lit(AWAY), F.lit(AWAY + "2")), F.lit(MARK), F.lit(AWAY + "1"))).otherwise(text)
    pieces = F.split(F.regexp_replace(safe, union, MARK + "$1" + MARK), MARK, -1)
    # Odd pieces are finds, as every find has a mark on both sides.
    made = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, pseudonym(p, F.lit(key))))
    split, put = fresh(documents, "_pieces"), fresh(documents, "_made")
    rows = documents.withColumn(split, F.when(likely, pieces)).withColumn(put, F.when(likely, made))
    joined = F.array_join(F.zip_with(split, put, lambda p, m: F.coalesce(m["text"], p)), "")
    back = F.replace(F.replace(joined, F.lit(AWAY + "1"), F.lit(MARK)), F.lit(AWAY + "2"), F.lit(AWAY))
    done = F.when(F.col(split).isNull(), text).when(marked, back).otherwise(joined)
    kinds = F.filter(F.transform(put, lambda m: m["kind"]), lambda k: k.isNotNull())
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("key"), F.size(F.filter(kinds, lambda x: x == k)).alias("value")))).cast("map<string,int>")
    found = F.coalesce(counts, F.create_map().cast("map<string,int>"))
    return rows.select(*[done.alias("text") if c == "text" else F.col(c) for c in documents.columns if c != "found"], found.alias("found"))
