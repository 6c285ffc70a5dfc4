"""Format rules as boolean Columns: TRUE valid, NULL for NULL input."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Length limits, schemes, and the label rules of host names.
URL_MAX, HOST_MAX, EMAIL_MAX, DOMAIN_MAX = 2048, 253, 320, 255
SCHEMES = ("http", "https", "ftp", "ftps")
LETTER = "a-z¡-￿"
LABEL = f"[{LETTER}0-9](?:[{LETTER}0-9-]{{0,61}}[{LETTER}0-9])?"
MIDDLE = rf"(?:\.(?!-)[{LETTER}0-9-]{{1,63}}(?<!-))*"
TOP = rf"\.(?!-)(?:[{LETTER}-]{{2,63}}|xn--[a-z0-9]{{1,59}})(?<!-)"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ATOM = "[-!#$%&'*+/=?^_`{}|~0-9A-Z]+"
QUOTED = r'"(?:[\x01-\x08\x0b\x0c\x0e-\x1f!#-\[\]-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*"'


def _full(col: Column, rx: str) -> Column:
    return col.rlike(rf"(?i)\A(?:{rx})\z")


@F.pandas_udf(T.BooleanType())
def _is_ipv6(s: pd.Series) -> pd.Series:
    def ok(x):
        if x is None:
            return None
        try:
            ipaddress.IPv6Address(x)
        except ValueError:
            return False
        return "%" not in x

    return s.map(ok).astype("boolean")


def ipv4(col: Column) -> Column:
    return _full(col, rf"{OCTET}(?:\.{OCTET}){{3}}")


def ipv6(col: Column) -> Column:
    """Only texts of the right letters reach the Python check."""
    shaped = col.rlike(r"(?i)\A[0-9a-f:.]{2,45}\z") & col.contains(":")
    return F.when(col.isNull(), None).when(shaped, _is_ipv6(F.when(shaped, col))).otherwise(False)


def ip(col: Column) -> Column:
    return ipv4(col) | ipv6(col)


def domain(col: Column) -> Column:
    return _full(col, LABEL + MIDDLE + TOP + r"\.?") & (F.length(col) <= DOMAIN_MAX)


def email(col: Column, allowed: tuple[str, ...] = ("localhost",)) -> Column:
    """Split at the last @; plain or quoted user; domain, listed name or [IP]."""
    user = F.regexp_extract(col, r"(?s)\A(.*)@[^@]*\z", 1)
    host = F.regexp_extract(col, r"@([^@]*)\z", 1)
    literal = F.regexp_extract(host, r"(?i)\A\[([a-f0-9:.]+)\]\z", 1)
    user_ok = _full(user, rf"{ATOM}(?:\.{ATOM})*|{QUOTED}")
    host_ok = host.isin(*allowed) | _full(host, LABEL + MIDDLE + TOP) | ((literal != "") & ip(literal))
    return F.when(col.isNotNull(), col.contains("@") & (F.length(col) <= EMAIL_MAX) & user_ok & host_ok)


def url(col: Column, schemes: tuple[str, ...] = SCHEMES) -> Column:
    """Scheme, host name or address, port of at most five digits, no blanks."""
    scheme = F.lower(F.split_part(col, F.lit("://"), F.lit(1)))
    behind = F.substring(col, F.length(scheme) + 4, F.length(col))
    place = F.regexp_extract(behind, "^[^/?#]*", 0)  # user, host and port
    tail = F.substring(behind, F.length(place) + 1, F.length(behind))
    served = F.regexp_extract(place, "[^@]*$", 0)  # host and port
    user = F.substring(place, F.lit(1), F.length(place) - F.length(served) - 1)
    user_ok = ~place.contains("@") | user.rlike(r"^[^\s:@/]+(?::[^\s:@/]*)?\z")
    port = F.regexp_extract(served, r":([^:\]]*)$", 1)
    port_ok = ~served.rlike(r":[^:\]]*$") | port.rlike(r"^[0-9]{1,5}\z")
    host = F.regexp_replace(served, r":[^:\]]*$", "")
    six = F.regexp_extract(host, r"(?i)^\[([0-9a-f:.]+)\]$", 1)
    numbers = _full(host, rf"{OCTET}(?:\.{OCTET}){{3}}")
    host_ok = F.when(host.startswith("["), ipv6(six)).otherwise(
        numbers | _full(host, LABEL + MIDDLE + TOP + r"\.?") | (F.lower(host) == "localhost"))
    sizes = (F.length(col) <= URL_MAX) & (F.length(host) <= HOST_MAX)
    return scheme.isin(*schemes) & col.contains("://") & user_ok & port_ok & host_ok & ~tail.rlike(r"\s") & sizes


def slug(col: Column) -> Column:
    return _full(col, "[-a-zA-Z0-9_]+")


def unicode_slug(col: Column) -> Column:
    return _full(col, r"[-\p{L}\p{N}_]+")


def integer(col: Column) -> Column:
    return _full(col, r"-?\d+")


def integer_list(col: Column, sep: str = ",", negative: bool = False) -> Column:
    n = r"-?\d+" if negative else r"\d+"
    return _full(col, rf"{n}(?:\Q{sep}\E{n})*")


def file_extension(col: Column, allowed: list[str]) -> Column:
    return F.lower(F.regexp_extract(col, r"\.([^./]*)$", 1)).isin([a.lower() for a in allowed])


def no_nul(col: Column) -> Column:
    return ~col.contains("\x00")


def matches(col: Column, regex: str, inverse: bool = False) -> Column:
    return ~col.rlike(regex) if inverse else col.rlike(regex)


def step(col: Column, size: float, offset: float = 0.0) -> Column:
    """Remainder of (value - offset) by the step is zero within 1e-9."""
    r = F.abs((col - offset) - F.rint((col - offset) / size) * size)
    return r <= 1e-9


def decimal_shape(text: Column, max_digits: int, places: int) -> Column:
    """Digits, places and whole digits of a decimal given as text."""
    number = F.regexp_extract(text, r"^[-+]?(\d*)(?:\.(\d*))?$", 0)
    whole = F.regexp_replace(F.regexp_extract(text, r"^[-+]?(\d*)", 1), "^0+", "")
    frac = F.regexp_extract(text, r"\.(\d*)$", 1)
    # Leading zeros count only behind the point of a number below one.
    lead = F.when(whole == "", F.regexp_replace(frac, "^0+", "")).otherwise(frac)
    digits = F.greatest(F.length(whole) + F.length(lead), F.length(frac), F.lit(1))
    ok = (digits <= max_digits) & (F.length(frac) <= places) & (digits - F.length(frac) <= max_digits - places)
    return F.when(text.isNotNull(), (number != "") & text.rlike(r"\d") & ok)
