"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Found by pattern and then validated: e-mail addresses, IBANs (mod 97), dates of the calendar,
IPv4 addresses, US social security numbers, phone numbers, payment cards (Luhn) and hex
secrets that are assigned to a name such as token or api_key. What fails its validation stays.

Each value is permuted by a keyed Feistel network within its own format: the digits of a
phone number stay digits, a card keeps its length and a right Luhn digit, a date stays a
date of the same notation, an IBAN keeps its country and right check digits. The key decides
the permutation; separators do not enter it. So equal values get equal pseudonyms in all
documents, different values of a format different ones, and no table of values is kept.

One pass over the texts, no shuffle. Null and empty texts stay as they are; other columns,
rows and repeated rows are untouched; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Callable

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: The Spark setting that has the key; it comes from a secret store.
KEY_SETTING = "spark.tessera.pii.key"
_own_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting names. Without it, a random key that lasts as long as
    the application: its pseudonyms link nothing beyond it, and nobody can reverse them later."""
    key = spark.conf.get(KEY_SETTING, None)
    return key or _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))

#: Patterns by kind, in the order in which they are tried at each place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,4}[=:]\s{0,4}[\"']?[0-9A-Fa-f]{24,}(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-]|\.[0-9]|(?!T[0-9])[A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)(?:[ .-]?[0-9]{2,4}){2,3}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?<between>[ .-])[0-9]{3}\k<between>[0-9]{4})(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?<fours>[ -])[0-9]{4}\k<fours>[0-9]{4}\k<fours>[0-9]{1,7}|[0-9]{4}(?<six>[ -])[0-9]{6}\k<six>[0-9]{5})(?![0-9A-Za-z])",
}
#: The days of 400 years of the calendar from 1800-01-01, as a product.
_FIRST_DAY, _DATE_LEFT, _DATE_RIGHT = "1800-01-01", 627, 233

_let = lambda value, then: F.transform(F.array(value), then)[0]


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _mac(key: str, *parts: Column | str, bits: int = 256) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"), bits)


def feistel_pair(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs (left below a, right below b), as a struct."""

    def turn(pair: Column, k: Column) -> Column:
        moved = lambda x, other, size: F.pmod(x + _number(F.substring(_mac(key, kind, a, b, k, other), 1, 14)), size)
        even = F.struct(moved(pair["left"], pair["right"], a).alias("left"), pair["right"].alias("right"))
        odd = F.struct(pair["left"].alias("left"), moved(pair["right"], pair["left"], b).alias("right"))
        return F.when(k % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def feistel_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of the same length, up to 36 digits."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda width: F.pow(F.lit(10.0), width).cast("long")
    left = F.when(half > 0, F.substring(digits, F.lit(1), half)).otherwise(F.lit("0"))
    pair = feistel_pair(left, F.substring(digits, half + 1, n - half), size(half), size(n - half), key, kind)
    joined = lambda p: F.concat(F.when(half > 0, F.lpad(p["left"].cast("string"), half, "0")).otherwise(""), F.lpad(p["right"].cast("string"), n - half, "0"))
    return _let(pair, joined)


def feistel_letters(value: Column, key: str, kind: str, radix16: bool = False) -> Column:
    """A keyed permutation of the texts of one shape: digits, small and capital letters each
    change within their own class, all else stays. `radix16`: hex digits within 0-f."""
    sign = lambda c: F.ascii(c)
    if radix16:
        code = lambda c: _number(c).cast("int")
        radix = lambda c: F.lit(16)
    else:
        base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(sign(c))
        code = lambda c: sign(c) - base(c)
        radix = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1)
    chars = F.split(value, "")
    size = F.length(value)
    half = F.floor(size / 2).cast("int")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A") if not radix16 else size
    radixes = F.transform(chars, radix)

    def turn(codes: Column, k: Column) -> Column:
        first = k % 2 == 0
        fixed = F.when(first, F.slice(codes, half + 1, size - half)).otherwise(F.slice(codes, F.lit(1), half))
        stream = _mac(key, kind, shape, k, F.concat_ws(",", fixed.cast("array<string>")), bits=512)
        step = lambda h: F.transform(codes, lambda x, i: F.when((i < half) == first, F.pmod(x + _number(F.substring(h, 2 * F.pmod(i, F.lit(64)) + 1, F.lit(2))).cast("int"), F.get(radixes, i))).otherwise(x))
        return _let(stream, step)

    codes = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.transform(chars, code), turn)
    if radix16:
        upper = value.rlike("[A-F]")
        show = lambda x, c: F.when(upper, F.hex(x)).otherwise(F.lower(F.hex(x)))
    else:
        show = lambda x, c: F.char(x + base(c))
    return F.array_join(F.zip_with(codes, chars, show), "")


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum; doubled_last: the last digit counts twice (a check digit will follow)."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _let(c.cast("int") * F.when(F.pmod(i, F.lit(2)) == (0 if doubled_last else 1), 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _filled(mask: Column, digits: Column) -> Column:
    """The mask's digits replaced by those given, in order."""
    parts = F.split(F.regexp_replace(mask, "[0-9]", "\u0001"), "\u0001", -1)
    return F.array_join(F.zip_with(parts, F.concat(F.split(digits, ""), F.array(F.lit(""))), lambda p, d: F.concat(p, d)), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def done(digits: Column) -> Column:
        moved = feistel_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        checked = _let(moved, lambda x: F.concat(x, F.pmod(F.lit(10) - F.pmod(_luhn_sum(x, True), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(_luhn_sum(digits, False), F.lit(10)) == 0, _filled(m, checked))

    return _let(_digits(m), done)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    ok = F.length(_digits(m)).between(8, 15)
    return F.when(ok, F.concat(code, _filled(rest, feistel_digits(_digits(rest), key, "phone"))))


def _ip(m: Column, key: str) -> Column:
    def done(octets: Column) -> Column:
        pair = feistel_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, "ip")
        dotted = lambda p: F.concat_ws(".", *[x.cast("string") for half in ("left", "right") for x in (F.floor(p[half] / 256), p[half] % 256)])
        return F.when(F.forall(octets, lambda o: o <= 255), _let(pair, dotted))

    return _let(F.transform(F.split(m, r"\."), lambda o: o.cast("int")), done)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)  # of the 898 areas in use
    pair = feistel_pair(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def shown(p: Column) -> Column:
        out = F.floor(p["left"] / 99)
        number = F.when(out >= 665, out + 2).otherwise(out + 1)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(number, 3), pad(p["left"] % 99 + 1, 2), pad(p["right"] + 1, 4))

    return F.when(ok, _let(pair, shown))


def _date(m: Column, key: str) -> Column:
    """Year first, D.M.Y, M/D/Y, or D/M/Y where the first number can be no month; such a
    date goes to one of days after the 12th, so that its notation can still be told."""
    number = lambda k: F.element_at(F.split(m, "[-/.]"), k).cast("int")
    year_first, dots = m.rlike(r"^[0-9]{4}"), m.contains(".")
    day_first = dots | (~year_first & (number(1) > 12))
    year = F.when(year_first, number(1)).otherwise(number(3))
    month = F.when(year_first, number(2)).when(day_first, number(2)).otherwise(number(1))
    day = F.when(year_first, number(3)).when(day_first, number(1)).otherwise(number(2))
    late = day_first & ~dots
    start = F.lit(_FIRST_DAY).cast("date")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")

    def done(d: Column) -> Column:
        first = F.make_date(d["y"], d["m"], F.lit(1))
        valid = F.when(d["y"].between(1800, 2199) & d["m"].between(1, 12), d["d"].between(1, F.dayofmonth(F.last_day(first)))).otherwise(False)
        permuted = lambda n: _let(feistel_pair(F.floor(n / _DATE_RIGHT), n % _DATE_RIGHT, F.lit(_DATE_LEFT), F.lit(_DATE_RIGHT), key, "date"), lambda p: (p["left"] * _DATE_RIGHT + p["right"]).cast("int"))
        fits = lambda n: ~late | (F.dayofmonth(F.date_add(start, n)) > 12)
        offset = F.date_diff(F.date_add(first, d["d"] - 1), start)
        # a walk along the permutation's cycle; 64 steps that all miss have a chance of 1e-24
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(64)), permuted(offset), lambda n, _: F.when(fits(n), n).otherwise(permuted(n)))

        def shown(n: Column) -> Column:
            out = F.date_add(start, n)
            y, mm, dd = F.year(out).cast("string"), pad(F.month(out)), pad(F.dayofmonth(out))
            dash = F.when(m.contains("-"), "-").otherwise("/")
            return F.when(year_first, F.concat(y, dash, mm, dash, dd)).when(dots, F.concat_ws(".", dd, mm, y)).when(late, F.concat_ws("/", dd, mm, y)).otherwise(F.concat_ws("/", mm, dd, y))

        return F.when(valid, _let(walked, shown))

    return _let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), done)


def _mod97(text: Column) -> Column:
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(text, ""), code), F.lit(0), lambda r, v: F.pmod(F.when(v > 9, r * 100 + v).otherwise(r * 10 + v), F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    checked = lambda x: F.concat(country, F.lpad((F.lit(98) - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x)
    out = _let(feistel_letters(body, key, "iban"), checked)
    grouped = F.when(m.contains(" "), F.trim(F.regexp_replace(out, "(.{4})", "$1 "))).otherwise(out)
    return F.when(_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1, grouped)


def _email(m: Column, key: str) -> Column:
    top = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(feistel_letters(F.substring(m, F.lit(1), F.length(m) - F.length(top)), key, "email"), top)


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[0-9A-Fa-f]{24,}$", 0)
    head = F.substring(m, F.lit(1), F.length(m) - F.length(value))
    one_case = ~(value.rlike("[a-f]") & value.rlike("[A-F]"))
    mixed = value.rlike("[0-9]")
    return F.when(mixed, F.concat(head, F.when(one_case, feistel_letters(value, key, "secret", radix16=True)).otherwise(feistel_letters(value, key, "secret"))))


_PSEUDONYMS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "iban": _iban, "secret": _secret, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card,
}


def pseudonymize(docs: DataFrame, key: str, *, text: str = "text", found: str | None = None) -> DataFrame:
    """The documents with pseudonyms in `text`; `found` names an added column with the kinds of
    the replaced values in order (it replaces a column of that name)."""
    pattern = "|".join(PATTERNS.values())

    def one(match: Column) -> Column:
        """kind and pseudonym; a null pseudonym where no kind's validation holds."""
        kind = F.lit(None).cast("string")
        out = F.lit(None).cast("string")
        for name, whole in reversed(PATTERNS.items()):
            is_kind = match.rlike(f"^(?:{whole})$")
            kind = F.when(is_kind, F.lit(name)).otherwise(kind)
            out = F.when(is_kind, _PSEUDONYMS[name](match, key)).otherwise(out)
        return F.struct(match.alias("was"), kind.alias("kind"), out.alias("out"))

    body = F.col(text)
    matches = F.transform(F.regexp_extract_all(body, F.lit(pattern), 0), one)
    pieces = F.split(body, pattern, -1)
    names = list(dict.fromkeys(docs.columns))
    marked = docs.withColumn("__matches", F.when(body.rlike("[0-9@]"), matches).otherwise(F.array().cast("array<struct<was:string,kind:string,out:string>>")))
    m = F.col("__matches")
    rebuilt = F.array_join(F.zip_with(pieces, m, lambda p, x: F.concat(p, F.coalesce(x["out"], x["was"], F.lit("")))), "")
    new_text = F.when(F.size(m) > 0, rebuilt).otherwise(body)
    if found is None:
        return marked.select(*[new_text.alias(c) if c == text else F.col(c) for c in names])
    kinds = F.transform(F.filter(m, lambda x: x["out"].isNotNull()), lambda x: x["kind"])
    return marked.select(*[new_text.alias(c) if c == text else F.col(c) for c in names if c != found], kinds.alias(found))
