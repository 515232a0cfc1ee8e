"""The pseudonyms against a plain version, value by value, in Python integers."""

import calendar
import hashlib
import re
from datetime import date, timedelta

from tessera.llm import pii

ROUNDS, START = 10, date(1800, 1, 1)


def mac(bits, *parts):
    return hashlib.new(f"sha{bits}", "|".join(map(str, parts)).encode()).hexdigest()


def pair(left, right, a, b, key, kind):
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = (left + int(mac(256, key, kind, a, b, k, right)[:14], 16)) % a
        else:
            right = (right + int(mac(256, key, kind, a, b, k, left)[:14], 16)) % b
    return left, right


def digits(text, key, kind):
    half = len(text) // 2
    left, right = pair(int(text[:half] or 0), int(text[half:]), 10**half, 10 ** (len(text) - half), key, kind)
    return (str(left).zfill(half) if half else "") + str(right).zfill(len(text) - half)


def letters(text, key, kind, hexadecimal=False):
    half = len(text) // 2
    if hexadecimal:
        base, radix = [0] * len(text), [16] * len(text)
        codes, shape = [int(c, 16) for c in text], len(text)
    else:
        kinds = [next((x for x in ("09", "az", "AZ") if x[0] <= c <= x[1]), None) for c in text]
        base = [ord(k[0]) if k else ord(c) for k, c in zip(kinds, text)]
        radix = [1 if k is None else 10 if k == "09" else 26 for k in kinds]
        codes, shape = [ord(c) - b for c, b in zip(text, base)], "".join(k[0] if k else c for k, c in zip(kinds, text))
    for k in range(ROUNDS):
        moved, fixed = (range(half), codes[half:]) if k % 2 == 0 else (range(half, len(text)), codes[:half])
        stream = mac(512, key, kind, shape, k, ",".join(map(str, fixed)))
        for i in moved:
            at = 2 * (i % 64)
            codes[i] = (codes[i] + int(stream[at : at + 2], 16)) % radix[i]
    if hexadecimal:
        out = "".join(f"{c:x}" for c in codes)
        return out.upper() if re.search("[A-F]", text) else out
    return "".join(chr(c + b) for c, b in zip(codes, base))


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10


def filled(mask, new):
    new = iter(new)
    return re.sub("[0-9]", lambda _: next(new), mask)


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def day(text, key):
    a, b, c = map(int, re.split("[-/.]", text))
    if re.match("[0-9]{4}", text):
        y, m, d = a, b, c
    elif "." in text or a > 12:
        d, m, y = a, b, c
    else:
        m, d, y = a, b, c
    late = not re.match("[0-9]{4}", text) and "." not in text and a > 12
    if not (1800 <= y <= 2199 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    n = (date(y, m, d) - START).days
    while True:
        left, right = pair(n // 233, n % 233, 627, 233, key, "date")
        n = left * 233 + right
        out = START + timedelta(n)
        if not late or out.day > 12:
            break
    y, m, d = f"{out.year}", f"{out.month:02}", f"{out.day:02}"
    if re.match("[0-9]{4}", text):
        return (("-" if "-" in text else "/")).join((y, m, d))
    return ".".join((d, m, y)) if "." in text else "/".join((d, m, y) if late else (m, d, y))


def pseudonym(kind, text, key):
    """None where the value fails its validation."""
    only = re.sub("[^0-9]", "", text)
    if kind == "email":
        top = re.search(r"\.[A-Za-z]+$", text)[0]
        return letters(text[: -len(top)], key, "email") + top
    if kind == "card":
        moved = digits(only[:-1], key, "card")
        return filled(text, moved + str((10 - luhn(moved + "0")) % 10)) if luhn(only) == 0 else None
    if kind == "phone":
        code = m[0] if (m := re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)) else ""
        rest = text[len(code) :]
        return code + filled(rest, digits(re.sub("[^0-9]", "", rest), key, "phone")) if 8 <= len(only) <= 15 else None
    if kind == "ip":
        o = [int(x) for x in text.split(".")]
        if max(o) > 255:
            return None
        left, right = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "ssn":
        area, group, serial = map(int, text.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        left, right = pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        area = left // 99 + 1
        return f"{area + (area > 665):03}-{left % 99 + 1:02}-{right + 1:04}"
    if kind == "date":
        return day(text, key)
    if kind == "iban":
        plain = text.replace(" ", "")
        if mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = letters(plain[4:], key, "iban")
        out = plain[:2] + f"{98 - mod97(body + plain[:2] + '00'):02}" + body
        return re.sub("(.{4})", r"\1 ", out).strip() if " " in text else out
    value = re.search("[0-9A-Fa-f]{24,}$", text)[0]
    if not re.search("[0-9]", value):
        return None
    one_case = not (re.search("[a-f]", value) and re.search("[A-F]", value))
    return text[: -len(value)] + letters(value, key, "secret", hexadecimal=one_case)


PYTHON = {k: re.sub(r"\(\?i:", "(?i:", v.replace("(?<between>", "(?P<between>").replace("(?<fours>", "(?P<fours>").replace("(?<six>", "(?P<six>").replace("\\k<between>", "(?P=between)").replace("\\k<fours>", "(?P=fours)").replace("\\k<six>", "(?P=six)")) for k, v in pii.PATTERNS.items()}


def plain(text, key):
    kinds = []

    def one(match):
        kind = next(k for k, p in PYTHON.items() if re.fullmatch(p, match[0]))
        out = pseudonym(kind, match[0], key)
        if out is not None:
            kinds.append(kind)
        return match[0] if out is None else out

    return re.sub("|".join(PYTHON.values()), one, text, flags=re.ASCII), kinds


def test_query_against_plain_version(spark, sf_dir):
    from tessera.llm import queries as Q

    key = pii.session_key(spark)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q.QUERIES["op5_feistel"](spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r["n_replaced"] for r in rows) > 10
    for r in rows:
        text, kinds = plain(texts[r["doc_id"]], key)
        assert (r["text"], r["pii_kinds"], r["n_replaced"]) == (text, ",".join(kinds), len(kinds))


def test_every_kind_against_plain_version(spark):
    import random

    random.seed(2)
    number = lambda n: "".join(random.choices("0123456789", k=n))
    texts = ["so " + make() + " it is" for make in (
        lambda: f"{random.choice('abX')}.{number(3)}@mail-{number(2)}.example.org", lambda: number(16), lambda: "4111 1111 1111 1111", lambda: "378282246310005", lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}",
        lambda: f"{number(3)} {number(3)} {number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}", lambda: ".".join(str(random.randint(0, 299)) for _ in range(4)), lambda: f"{number(3)}-{number(2)}-{number(4)}",
        lambda: f"{random.randint(1790, 2210)}-{random.randint(1, 13):02}-{random.randint(1, 31):02}", lambda: f"{random.randint(1, 31)}/{random.randint(1, 13)}/20{number(2)}", lambda: f"{random.randint(1, 31)}.{random.randint(1, 12)}.19{number(2)}",
        lambda: random.choice(["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432"]), lambda: "api_key='" + "".join(random.choices("0123456789abcdef", k=random.choice([24, 40, 200]))) + "'",
        lambda: "secret: " + "".join(random.choices("0123456789abcdefABCDEF", k=30)),
    ) for _ in range(25)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["text"], r["kinds"]) for r in pii.pseudonymize(rows, "k", found="kinds").orderBy("doc_id").collect()]
    assert got == [plain(t, "k") for t in texts]


def test_keys_of_sessions(spark):
    own = pii.session_key(spark)
    assert own == pii.session_key(spark) and len(own) == 64
    spark.conf.set(pii.KEY_SETTING, "from a secret store")
    assert pii.session_key(spark) == "from a secret store"
    spark.conf.unset(pii.KEY_SETTING)
