"""String functions over columns: normalization, lists, character n-grams."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Terminal legal forms of business names, as an alternation.
LEGAL_FORMS = (
    r"pvt\s+ltd|private\s+limited|limited\s+liability\s+partnership|"
    r"ltd|limited|llc|inc|corp|corporation|co|company|pllc|llp|pc|gmbh|sa|srl|lp|"
    r"प्राइवेट\s+लिमिटेड|लिमिटेड|एलएलपी"
)


@F.arrow_udf(StringType())
def nfkd(column: pa.Array) -> pa.Array:
    """Unicode compatibility decomposition, the one step that SQL functions lack."""
    return pc.utf8_normalize(column, form="NFKD")


def norm_basic(c: Column) -> Column:
    """Decomposed, without combining marks below U+0900, letters, marks and numbers only, in
    small letters, single spaces between words. Marks of Indic scripts stay."""
    stripped = F.regexp_replace(nfkd(F.coalesce(c, F.lit(""))), r"[\p{Mn}&&[\x{0000}-\x{08FF}]]", "")
    return F.trim(F.regexp_replace(F.lower(stripped), r"[^\p{L}\p{M}\p{N}]+", " "))


def norm_legal(normalized: Column) -> Column:
    """A normalized name without one terminal legal form; a name that is only that stays."""
    rest = F.trim(F.regexp_replace(normalized, rf"(?i)\b({LEGAL_FORMS})\b$", ""))
    return F.coalesce(F.nullif(rest, F.lit("")), normalized)


def norm_audit(c: Column) -> Column:
    """The audit's normalization: small letters, decomposed, all that is no word character or
    space (combining marks too) becomes a space, spaces collapse."""
    low = nfkd(F.lower(F.trim(F.coalesce(c, F.lit("")))))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def norm_light(c: Column) -> Column:
    """Small letters without surrounding spaces."""
    return F.trim(F.lower(c))


def parse_list(c: Column, separator: str = ",") -> Column:
    """The trimmed, non-blank items of a separated list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """All character n-grams of low to high characters, spaces included, with repetitions."""
    size = F.length(c)
    of = lambda k: F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(k) for k in range(low, high + 1)])


def has_devanagari(c: Column) -> Column:
    return c.rlike(r"[\x{0900}-\x{097F}]")


def excerpt(c: Column, size: int) -> Column:
    """The start of a text, fit for a table cell of Markdown."""
    return F.replace(F.substring(c, 1, size), F.lit("|"), F.lit("/"))
