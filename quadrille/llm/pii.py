"""Personal data replaced by format-preserving Feistel pseudonyms, in DataFrame functions alone.

Numbers, dates and addresses are found by pattern, validated, and permuted by a keyed Feistel network
over the values of their own format: a card number becomes another card number with a right check
digit, a date another date, an address another address. The same value gives the same
pseudonym in every document, so values stay linked, and whoever has the key can turn each back.
The network works on two halves of sizes a and b: left and right are raised in turn by a keyed
hash of the other, modulo their size, which permutes a * b values for any a and b.

Kinds:
* card: 13 to 19 digits, spaces or hyphens between groups. Of the runs of whole groups whose Luhn sum is
  right the longest counts, then the first; what stands beside it stays. The check digit is made anew.
* phone: after a plus sign 7 to 15 digits in groups parted by spaces, dots or hyphens; the country code
  (what stands before the first mark, at most 3 digits, else the first two, or a first 1 or 7) stays. Without a
  plus sign ten digits as 3-3-4, the first three in brackets or not.
* ipv4: numbers to 255, no port read. ssn: assignable areas, groups and serials.
* date: 1900-01-01 to 2100-01-31 as yyyy-mm-dd (a time may follow after T), yyyy/mm/dd, dd.mm.yyyy and
  dd/mm/yyyy; what can't be read with the day first is read as mm/dd/yyyy, and becomes another such date.
* iban: two letters, right check digits, up to 30 digits; letters stay, check digits are made anew.
* email: the letters of the local part are permuted as letters, its digits as digits; marks, case and domain stay.
Not known: IPv6 addresses, dates with month names, two-digit years or single digits, national numbers in other groups.

What does not validate stays as it is.

Defined results: a null text stays null with no finds; empty texts and those without finds stay
as they are. Repeated rows are masked alike. Texts of any length are searched whole. No id or other column is read;
columns of any name are carried along, and the counts come under the first free of pii, _pii, __pii ...
An empty table stays empty.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.shared import cut, fresh, let, table

KINDS = ("email", "iban", "ssn", "date", "ipv4", "phone", "card")
#: An address is at most 64 + 1 + 255 characters; possessive bounds keep long runs linear.
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,250}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!(?!T\d{2}:)[\w/-]|\.\d)",
    "ipv4": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{3}\) ?|(?<![.-])\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])",
    "card": r"(?<![\w-])(?:\d{4}(?:[ -]\d{4}){3}[ -]\d{3}(?![\w./-])|\d{4}(?:[ -]\d{4}){3}(?![\w-])|\d{4}[ -]\d{6}[ -]\d{4,5}(?![\w-])|\d{13,19}(?![\w-])|\d(?:[ -]?\d){12,40}(?![\w-]))",
}
ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1)
DAYS = (252, 290)
#: Times that a date is permuted again at most until it is one that can't be read with the day first; three in five dates are.
WALK = 64
#: Longest strings of digits and of letters that are permuted as one number: halves must be exact as doubles.
DIGITS, LETTERS = 30, 22


def _any(kinds: tuple[str, ...]) -> str:
    return "|".join(PATTERNS[k] for k in kinds)


def _hash(key: str, kind: str, turn: Column, value: Column, size: Column | int) -> Column:
    """A keyed hash of a value, below size."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), size)


def permute(key: str, kind: str, left: Column, right: Column, a: Column | int, b: Column | int, back: bool = False) -> Column:
    """struct(l, r): the permuted halves, left below a and right below b; back: the inverse."""
    a, b = (F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint") for x in (a, b))
    sign = -1 if back else 1

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        raised_left = F.pmod(acc["l"] + sign * _hash(key, kind, i, acc["r"], a), a)
        raised_right = F.pmod(acc["r"] + sign * _hash(key, kind, i, acc["l"], b), b)
        return F.struct(F.when(even, raised_left).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(raised_right).alias("r"))

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, r"\D", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    part = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda s, x: s + x) % 10


def _refilled(found: Column, put: Column, kept: str) -> Column:
    """What was found, with the characters of `put` in turn for those of the class `kept`."""
    step = lambda new: lambda acc, c: F.struct(F.concat(acc["out"], F.when(c.rlike(kept), F.substring(new, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + F.when(c.rlike(kept), 1).otherwise(0)).alias("k"))
    return let(put, lambda new: F.aggregate(_characters(found), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step(new), lambda acc: acc["out"]))


def _number(text: Column, base: int) -> Column:
    """The number that a string of digits or, for base 26, of small letters stands for; 0 for an empty one."""
    first = ord("0") if base == 10 else ord("a")
    return F.aggregate(_characters(text), F.lit(0).cast("bigint"), lambda n, c: n * base + F.ascii(c) - first)


def _written(number: Column, n: Column, base: int) -> Column:
    """The string of n characters for a number."""
    if base == 10:
        return F.when(n > 0, F.lpad(number.cast("string"), n, "0")).otherwise("")
    step = lambda acc, _: F.struct(F.concat(F.chr(97 + acc["rest"] % base), acc["out"]).alias("out"), ((acc["rest"] - acc["rest"] % base) / base).cast("bigint").alias("rest"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit("").alias("out"), number.alias("rest")), step, lambda acc: acc["out"])).otherwise("")


def _string(text: Column, key: str, kind: str, back: bool, base: int = 10) -> Column:
    """A string of digits, or of small letters, permuted among all such of its length."""
    power = lambda k: F.round(F.pow(F.lit(base), k)).cast("bigint")

    def halved(t: Column) -> Column:
        n, half = F.length(t), F.floor(F.length(t) / 2).cast("int")
        out = permute(key, kind, _number(F.substring(t, F.lit(1), half), base), _number(F.substring(t, half + 1, n - half), base), power(half), power(n - half), back)
        return let(out, lambda o: F.concat(_written(o["l"], half, base), _written(o["r"], n - half, base)))

    return let(text, halved)


def _long_string(text: Column, key: str, kind: str, back: bool, base: int, most: int, longest: int) -> Column:
    """As _string, in pieces of `most` characters, for strings of up to `longest`."""
    pieces = lambda t: [F.substring(t, F.lit(i + 1), F.lit(most)) for i in range(0, longest, most)]
    return let(text, lambda t: F.concat(*(F.when(F.length(p) > 0, _string(p, key, f"{kind}{i}", back, base)).otherwise("") for i, p in enumerate(pieces(t)))))


def _card(found: Column, key: str, back: bool) -> Column:
    def longest(groups: Column) -> Column:
        last = F.size(groups) - 1
        joined = lambda s, e: F.array_join(F.slice(groups, s + 1, e - s + 1), "")
        before = lambda s: F.aggregate(F.slice(groups, F.lit(1), s), F.lit(0), lambda n, g: n + F.length(g) + 1)
        every = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda s: F.transform(F.sequence(s, last), lambda e: F.struct(F.length(joined(s, e)).alias("n"), (-s).alias("back"), e.alias("e"), joined(s, e).alias("digits")))))
        right = F.array_max(F.filter(every, lambda r: F.when(r["n"].between(13, 19), _luhn(r["digits"]) == 0).otherwise(False)))
        return let(right, lambda r: F.struct(r["digits"].alias("digits"), before(-r["back"]).alias("start"), (before(r["e"]) + F.length(F.get(groups, r["e"])) - before(-r["back"])).alias("length")))

    def put(r: Column) -> Column:
        body = _string(F.substring(r["digits"], F.lit(1), F.length(r["digits"]) - 1), key, "card", back)
        whole = let(body, lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), 10).cast("string")))
        part = F.substring(found, r["start"] + 1, r["length"])
        return F.when(r["digits"].isNotNull(), F.concat(F.substring(found, F.lit(1), r["start"]), _refilled(part, whole, r"\d"), F.substring(found, r["start"] + r["length"] + 1, F.length(found))))

    return let(let(F.split(found, "[ -]"), longest), put)


def _phone(found: Column, key: str, back: bool) -> Column:
    marked = F.length(F.regexp_extract(found, r"^\+(\d{1,3})[ .(-]", 1))

    def put(d: Column) -> Column:
        code, n = d["code"], F.length(d["digits"]) - d["code"]
        enough = F.when(found.startswith("+"), F.length(d["digits"]).between(7, 15) & (n >= 4)).otherwise(n == 10)
        return F.when(enough, _refilled(found, F.concat(F.substring(d["digits"], F.lit(1), code), _string(F.substring(d["digits"], code + 1, n), key, "phone", back)), r"\d"))

    code = F.when(~found.startswith("+"), 0).when(marked > 0, marked).otherwise(F.when(_digits(found).rlike("^[17]"), 1).otherwise(2))
    return let(F.struct(_digits(found).alias("digits"), code.alias("code")), put)


def _ipv4(found: Column, key: str, back: bool) -> Column:
    part = [F.get(F.split(found, r"\."), F.lit(i)).cast("int") for i in range(4)]
    octets = lambda out: [F.floor(out["l"] / 256), out["l"] % 256, F.floor(out["r"] / 256), out["r"] % 256]
    new = let(permute(key, "ipv4", part[0] * 256 + part[1], part[2] * 256 + part[3], 65_536, 65_536, back), lambda out: F.concat_ws(".", *(o.cast("string") for o in octets(out))))
    return F.when(F.greatest(*part) <= 255, new)


def _ssn(found: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.get(F.split(found, "-"), F.lit(i)).cast("int") for i in range(3))
    right = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    put = lambda x, n: F.lpad(x.cast("string"), n, "0")
    written = lambda out: F.concat_ws("-", put(out["l"] + 1 + F.when(out["l"] >= 665, 1).otherwise(0), 3), put(F.floor(out["r"] / 9_999) + 1, 2), put(out["r"] % 9_999 + 1, 4))
    return F.when(right, let(permute(key, "ssn", place, (group - 1) * 9_999 + serial - 1, 898, 99 * 9_999, back), written))


def _date(found: Column, key: str, back: bool) -> Column:
    read = lambda form: F.date_diff(F.try_to_timestamp(found, F.lit(form)).cast("date"), F.lit(FIRST_DAY))
    inside = lambda at: let(at, lambda a: F.when((a >= 0) & (a < DAYS[0] * DAYS[1]), a))
    on = lambda at: F.date_add(F.lit(FIRST_DAY), at.cast("int"))

    def moved(at: Column, kind: str) -> Column:
        out = permute(key, kind, F.floor(at / DAYS[1]), at % DAYS[1], *DAYS, back)
        return let(out, lambda o: o["l"] * DAYS[1] + o["r"])

    def written(form: str) -> Column:
        return let(inside(read(form)), lambda at: F.when(at.isNotNull(), F.date_format(on(moved(at, "date")), form)))

    def walk(acc: Column, _: Column) -> Column:
        step = lambda then: F.struct(then.alias("at"), (F.dayofmonth(on(then)) > 12).alias("done"))
        return F.when(acc["done"], acc).otherwise(let(moved(acc["at"], "date-month-first"), step))

    def walked(at: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(at.alias("at"), F.lit(False).alias("done")), walk)
        return F.when(at.isNotNull(), let(end, lambda e: F.when(e["done"], F.date_format(on(e["at"]), "MM/dd/yyyy"))))

    return (
        F.when(found.rlike(r"^\d{4}-"), written("yyyy-MM-dd")).when(found.rlike(r"^\d{4}/"), written("yyyy/MM/dd")).when(found.contains("."), written("dd.MM.yyyy"))
        .when(read("dd/MM/yyyy").isNotNull(), written("dd/MM/yyyy")).otherwise(let(inside(read("MM/dd/yyyy")).cast("bigint"), walked))
    )


def _remainder(text: Column) -> Column:
    """A string of digits and capital letters (A is 10) as a number modulo 97."""
    step = lambda n, c: F.when(c.rlike("[0-9]"), n * 10 + F.ascii(c) - 48).otherwise(n * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_characters(text), F.lit(0), step)


def _iban(found: Column, key: str, back: bool) -> Column:
    check = lambda country, body: F.lpad((98 - _remainder(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    body_of, country_of = (lambda whole: F.substring(whole, F.lit(5), F.length(whole))), (lambda whole: F.substring(whole, F.lit(1), F.lit(2)))

    def longest(groups: Column) -> Column:
        heads = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(groups, F.lit(1), k), "").alias("whole"), F.length(F.array_join(F.slice(groups, F.lit(1), k), " ")).alias("length")))
        return F.array_max(F.filter(heads, lambda h: (F.length(h["whole"]) >= 15) & (check(country_of(h["whole"]), body_of(h["whole"])) == F.substring(h["whole"], F.lit(3), F.lit(2)))))

    def put(r: Column) -> Column:
        digits = _digits(body_of(r["whole"]))
        body = _refilled(body_of(r["whole"]), _string(digits, key, "iban", back), r"\d")
        whole = let(body, lambda b: F.concat(country_of(found), check(country_of(found), b), b))
        new = F.concat(_refilled(F.substring(found, F.lit(1), r["length"]), whole, r"[A-Z0-9]"), F.substring(found, r["length"] + 1, F.length(found)))
        return F.when(r["whole"].isNotNull() & F.length(digits).between(1, DIGITS), new)

    return let(let(F.split(found, " "), longest), put)


def _email(found: Column, key: str, back: bool) -> Column:
    def put(local: Column) -> Column:
        digits = _long_string(_digits(local), key, "email-digits", back, 10, DIGITS, 64)
        letters = _long_string(F.regexp_replace(F.lower(local), "[^a-z]", ""), key, "email-letters", back, 26, LETTERS, 64)
        new = _refilled(_refilled(local, digits, r"\d"), letters, "[A-Za-z]")
        cased = F.array_join(F.zip_with(_characters(new), _characters(local), lambda a, b: F.when(b.rlike("[A-Z]"), F.upper(a)).otherwise(a)), "")
        return F.when(local.rlike("[A-Za-z0-9]"), F.concat(cased, F.substring(found, F.length(local) + 1, F.length(found))))

    return let(F.substring_index(found, "@", 1), put)


_OF = {"email": _email, "iban": _iban, "ssn": _ssn, "date": _date, "ipv4": _ipv4, "phone": _phone, "card": _card}


def kind_of(found: Column) -> Column:
    """The kind whose pattern a find is, by shape alone."""
    shape = F.when(found.contains("@"), "email").when(found.rlike("^[A-Z]"), "iban")
    for kind, form in (("ssn", r"^\d{3}-\d{2}-\d{4}$"), ("date", r"^(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), ("ipv4", r"^\d{1,3}(?:\.\d{1,3}){3}$"), ("phone", r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$")):
        shape = shape.when(found.rlike(form), kind)
    return shape.otherwise("card")


def _replaced(found: Column, key: str, back: bool) -> Column:
    """struct(kind, text): the pseudonym, or a null kind and what was found if that isn't valid."""
    def put(kind: Column) -> Column:
        new = None
        for k in KINDS:
            new = F.when(kind == k, _OF[k](found, key, back)) if new is None else new.when(kind == k, _OF[k](found, key, back))
        return let(new, lambda n: F.struct(F.when(n.isNotNull(), kind).alias("kind"), F.coalesce(n, found).alias("text")))

    return let(kind_of(found), put)


def _pieces(text: Column) -> Column:
    """A text cut so that every second piece is a find."""
    # Most texts hold neither a digit nor an at sign; those are not searched, and without an at sign not for addresses.
    return F.when(~text.rlike("[0-9@]"), F.array(text)).when(text.contains("@"), cut(text, _any(KINDS))).otherwise(cut(text, _any(KINDS[1:])))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """docs with the text masked, and a column `pii` of how many values of each kind were replaced."""
    pieces, new, counts_col = fresh(docs, "_q_cut"), fresh(docs, "_q_new"), fresh(docs, "pii")
    put = docs.withColumn(pieces, _pieces(docs[text_col]))
    put = put.withColumn(new, F.transform(pieces, lambda p, i: F.when(i % 2 == 1, _replaced(p, key, back)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), p.alias("text")))))
    masked = F.when(F.size(pieces) > 1, F.array_join(F.transform(new, lambda p: p["text"]), "")).otherwise(F.col(text_col))
    number = lambda k: F.coalesce(F.size(F.filter(new, lambda m: m["kind"] == k)), F.lit(0)).cast("bigint")
    counts = F.struct(*(F.when(F.col(text_col).isNotNull(), number(k)).otherwise(0).alias(k) for k in KINDS))
    return put.withColumns({text_col: masked, counts_col: counts}).drop(pieces, new)


#: The key of the registered query; a real one is given by the caller and kept secret.
DEMO_KEY = "demonstration"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return masked.select("doc_id", "text", *(F.col(f"pii.{k}").alias(f"n_{k}") for k in KINDS))
