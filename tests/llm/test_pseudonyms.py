"""Pseudonyms against a network of its own in plain Python, over whole tables and over each format; and turned back."""

import datetime
import hashlib
import re

import pandas as pd
import pytest

from quadrille.llm import pii, registry

FIRST = datetime.date(1900, 1, 1)
TEXTS = [
    "card 4111 1111 1111 1111 12/27", "4111111111111111 123", "4111111111111111 97.51.17.173", "12 4111-1111-1111-1111", "amex 3782 822463 10005 ok", "4111 1111 1111 1112",
    "on 12/25/2020 and 25/12/2020, 02/03/2004", "2021-02-28T10:00:00Z at 2021/03/01, 31.12.1999. 2021-02-30 31/31/2020", "call 415 555 2671 or +44 20 7946 0958 or +49 30 1234567, +1 (017) 555-7713 +4930123456",
    "(415) 555-2671 415.555.2671", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 BE68 5390 0754 7034 ABCD GB83 WEST 1234 5698 7654 32", "mail Ann.Lee99@Example.org, a@b.co, 34@mail7.example.com, x_y-z+q.w1234567890@host.net",
    "123-45-6789 000-12-3456 666-12-3456 899-99-9999", "v1.2.3.4 1.2.3.4.5 300.1.1.1 10:20:30 255.0.0.255", "mark  stands here 4111 1111 1111 1111  and 1.2.3.4", "", "no data at all", "7" * 400, "1 " * 300,
]


def keyed(key, kind, turn, value, size):
    return int(hashlib.sha256(f"{key}:{kind}:{turn}:{value}".encode()).hexdigest()[:15], 16) % size


def permute(key, kind, left, right, a, b):
    for turn in range(8):
        if turn % 2 == 0:
            left = (left + keyed(key, kind, turn, right, a)) % a
        else:
            right = (right + keyed(key, kind, turn, left, b)) % b
    return left, right


def string(text, key, kind, base=10):
    first = "0" if base == 10 else "a"
    number = lambda s: sum((ord(c) - ord(first)) * base**i for i, c in enumerate(reversed(s)))
    half, rest = len(text) // 2, len(text) - len(text) // 2
    out = permute(key, kind, number(text[:half]), number(text[half:]), base**half, base**rest)

    def written(n, k):
        s = ""
        for _ in range(k):
            n, c = divmod(n, base)
            s = chr(ord(first) + c) + s
        return s

    return written(out[0], half) + written(out[1], rest)


def refill(found, put, kept):
    rest = iter(put)
    return "".join(next(rest) if re.match(kept, c) else c for c in found)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def card(found, key):
    groups, best = re.split("[ -]", found), None
    for s in range(len(groups)):
        for e in range(s, len(groups)):
            digits = "".join(groups[s : e + 1])
            if 13 <= len(digits) <= 19 and luhn(digits) == 0 and (best is None or len(digits) > len(best[2])):
                best = (s, e, digits)
    if not best:
        return None
    s, e, digits = best
    start = sum(len(g) + 1 for g in groups[:s])
    end = start + sum(len(g) + 1 for g in groups[s : e + 1]) - 1
    body = string(digits[:-1], key, "card")
    return found[:start] + refill(found[start:end], body + str(-luhn(body + "0") % 10), r"\d") + found[end:]


def phone(found, key):
    digits = re.sub(r"\D", "", found)
    code = 0
    if found[0] == "+":
        marked = re.match(r"\+(\d{1,3})[ .(-]", found)
        code = len(marked[1]) if marked else 1 if digits[0] in "17" else 2
    if not (7 <= len(digits) <= 15 and len(digits) - code >= 4 if found[0] == "+" else len(digits) == 10):
        return None
    return refill(found, digits[:code] + string(digits[code:], key, "phone"), r"\d")


def date(found, key):
    def read(form):
        try:
            at = (datetime.datetime.strptime(found, form).date() - FIRST).days
        except ValueError:
            return None
        return at if 0 <= at < 252 * 290 else None

    def moved(at, kind):
        left, right = permute(key, kind, at // 290, at % 290, 252, 290)
        return left * 290 + right

    on = lambda at: FIRST + datetime.timedelta(at)
    forms = ["%Y-%m-%d"] if "-" in found else ["%Y/%m/%d"] if re.match(r"\d{4}/", found) else ["%d.%m.%Y"] if "." in found else ["%d/%m/%Y"]
    if (at := read(forms[0])) is not None:
        return on(moved(at, "date")).strftime(forms[0])
    if forms == ["%d/%m/%Y"] and (at := read("%m/%d/%Y")) is not None:
        at = moved(at, "date-month-first")
        while on(at).day <= 12:
            at = moved(at, "date-month-first")
        return on(at).strftime("%m/%d/%Y")
    return None


def ipv4(found, key):
    a, b, c, d = map(int, found.split("."))
    if max(a, b, c, d) > 255:
        return None
    left, right = permute(key, "ipv4", a * 256 + b, c * 256 + d, 65_536, 65_536)
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def ssn(found, key):
    area, group, serial = map(int, found.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    left, right = permute(key, "ssn", area - 1 - (area > 666), (group - 1) * 9_999 + serial - 1, 898, 99 * 9_999)
    return f"{left + 1 + (left >= 665):03d}-{right // 9_999 + 1:02d}-{right % 9_999 + 1:04d}"


def iban(found, key):
    check = lambda country, body: f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"
    groups = found.split(" ")
    for k in range(len(groups), 0, -1):
        whole = "".join(groups[:k])
        if len(whole) >= 15 and check(whole[:2], whole[4:]) == whole[2:4]:
            digits = re.sub(r"\D", "", whole[4:])
            body = refill(whole[4:], string(digits, key, "iban"), r"\d")
            part = " ".join(groups[:k])
            return refill(part, whole[:2] + check(whole[:2], body) + body, "[A-Z0-9]") + found[len(part) :]
    return None


def email(found, key):
    local, domain = found.split("@")
    if not re.search("[A-Za-z0-9]", local):
        return None
    cut = lambda s, n: [s[i : i + n] for i in range(0, len(s), n)]
    digits = "".join(string(p, key, f"email-digits{i}") for i, p in enumerate(cut(re.sub(r"\D", "", local), 30)))
    letters = "".join(string(p, key, f"email-letters{i}", 26) for i, p in enumerate(cut(re.sub("[^a-z]", "", local.lower()), 22)))
    new = refill(refill(local, digits, r"\d"), letters, "[A-Za-z]")
    return "".join(a.upper() if b.isupper() else a for a, b in zip(new, local)) + "@" + domain


OF = {"email": email, "iban": iban, "ssn": ssn, "date": date, "ipv4": ipv4, "phone": phone, "card": card}


def masked(text, key):
    counts = dict.fromkeys(pii.KINDS, 0)
    pattern = re.compile("|".join(f"(?P<{k}>{pii.PATTERNS[k]})" for k in pii.KINDS), re.ASCII)

    def put(m):
        new = OF[m.lastgroup](m[0], key)
        if new is not None:
            counts[m.lastgroup] += 1
        return m[0] if new is None else new

    return pattern.sub(put, text), counts


@pytest.fixture(scope="module")
def formats(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_formats_against_plain_python(formats):
    for r in pii.pseudonymise(formats, "k").collect():
        assert (r["text"], r["pii"].asDict()) == masked(TEXTS[r["doc_id"]], "k")


def test_formats_are_masked_and_turn_back(formats):
    once = pii.pseudonymise(formats, "k")
    assert {k: sum(r["pii"][k] for r in once.collect()) for k in pii.KINDS} == {"email": 4, "iban": 3, "ssn": 2, "date": 6, "ipv4": 3, "phone": 7, "card": 6}
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(once.drop("pii"), "k", back=True).collect()}
    assert back == dict(enumerate(TEXTS))


def test_documents_against_plain_python(spark, sf):
    texts = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    got = registry.QUERIES["op5_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want, counts = masked(texts[r["doc_id"]], pii.DEMO_KEY) if texts[r["doc_id"]] else (texts[r["doc_id"]], dict.fromkeys(pii.KINDS, 0))
        assert (r["text"], {k: r[f"n_{k}"] for k in pii.KINDS}) == (want, counts)
