"""Names, hashes, scores and reason lists."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import Value, _c


def named(code: Value, names: dict[str, str]) -> Column:
    """The name of a code; UNKNOWN_ and the code where it has none."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(pairs, _c(code)), F.concat(F.lit("UNKNOWN_"), _c(code)))


def tri_state(code: Value) -> Column:
    """Y, N and ~ as names; empty and null, and unmapped bytes (in hex), are told apart."""
    c = _c(code)
    return F.when(c.isNull() | (c == ""), "UNKNOWN_EMPTY").when(c == "Y", "YES").when(c == "N", "NO").when(c == "~", "NOT_AVAILABLE").otherwise(F.concat(F.lit("UNKNOWN_"), F.hex(c)))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Sorted codes of all failed checks; a check that is null fails."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in checks))))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Code of the first failed check in order, null if none fails."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in checks))


def canonical_json(*columns: str) -> Column:
    """Compact JSON of flat columns in the order of their names; nulls are kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def row_hash(*columns: str, separator: str = "|") -> Column:
    """SHA-256 over the columns as text; a null is the empty string with a mark of its own."""
    return F.sha2(F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns)), 256)


def seed(name: Value, index: Value) -> Column:
    """First four bytes of sha256(name:index) as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", _c(name), _c(index).cast("string")), 256), 1, 8), 16, 10).cast("long")


MONTHS = "FGHJKMNQUVXZ"


def contract_root(symbol: Value) -> Column:
    return F.regexp_extract(_c(symbol), rf"^([A-Z0-9]{{1,3}}?)([{MONTHS}])(\d{{1,2}})$", 1)


def contract_month(symbol: Value) -> Column:
    return F.locate(" ", F.lit(" ")) * 0 + F.instr(F.lit(MONTHS), F.regexp_extract(_c(symbol), rf"^([A-Z0-9]{{1,3}}?)([{MONTHS}])(\d{{1,2}})$", 2))


def url_host(url: Value) -> Column:
    """Host of an http(s) URL in lower case, empty otherwise."""
    return F.lower(F.regexp_extract(_c(url), r"^(?i:https?)://([^/?#:]+)", 1))


def bounded_score(long_r: Value, short_r: Value) -> Column:
    """(long - short) / (|long| + |short|), 0 where both are 0."""
    a, b = _c(long_r), _c(short_r)
    size = F.abs(a) + F.abs(b)
    return F.when(size == 0, 0.0).otherwise((a - b) / F.nullif(size, F.lit(0.0)))


def direction(score: Value, threshold: float) -> Column:
    s = _c(score)
    return F.when(s >= threshold, "LONG").when(s <= -threshold, "SHORT").otherwise("NEUTRAL")


def sigmoid(score: Value) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), _c(score)))))


def entropy3(*shares: Value) -> Column:
    """Entropy of three shares over ln 3; empty shares count nothing."""
    return sum((F.when(_c(p) > 0, -_c(p) * F.log(_c(p))).otherwise(0.0) for p in shares), F.lit(0.0)) / math.log(3)


def gate(psi: Value, missing: Value, warn: tuple[float, float] = (0.1, 0.02), pause: tuple[float, float] = (0.25, 0.05)) -> Column:
    """PAUSE before WARN before CLEAR, by population stability and missingness."""
    return F.when((_c(psi) >= pause[0]) | (_c(missing) >= pause[1]), "PAUSE").when((_c(psi) >= warn[0]) | (_c(missing) >= warn[1]), "WARN").otherwise("CLEAR")
