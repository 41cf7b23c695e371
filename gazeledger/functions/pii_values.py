"""Checks and masks for single personal-data values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeledger.functions import constants as C
from gazeledger.functions.regex import let, strip


def _digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)[-\s]", "")


def _stars(count: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(count, F.lit(0)).cast("int"))


def _digit_sum(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(digits, i + 1, 1).cast("int") * w
    return total


def valid_rrn(value: Column) -> Column:
    """Month and day in range and weighted mod-11 check digit."""

    def check(d: Column) -> Column:
        month, day = F.substring(d, 3, 2).cast("int"), F.substring(d, 5, 2).cast("int")
        check_digit = (11 - _digit_sum(d, C.RRN_WEIGHTS) % 11) % 10
        return F.when(
            d.rlike(r"\A[0-9]{13}\z"),
            month.between(1, 12) & day.between(1, 31) & (check_digit == F.substring(d, 13, 1).cast("int")),
        ).otherwise(F.lit(False))

    return let(_digits_only(value), check)


def valid_luhn(value: Column) -> Column:
    """Luhn check of the 16 digits of a card match (doubling starts at the first digit)."""

    def check(d: Column) -> Column:
        total = F.lit(0)
        for i in range(16):
            digit = F.substring(d, i + 1, 1).cast("int")
            total = total + (F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2) if i % 2 == 0 else digit)
        return F.when(d.rlike(r"\A[0-9]{16}\z"), total % 10 == 0).otherwise(F.lit(False))

    return let(_digits_only(value), check)


def valid_ip(value: Column) -> Column:
    """Drop loopback, zero, broadcast and link-local IPv4, and the IPv6 loopback and unspecified forms."""
    v6_off = value.isin("::1", "::", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0")
    v4_off = value.rlike(r"\A(?:127|0|255)\.|\A169\.254\.")
    return F.when(value.contains(":"), ~v6_off).otherwise(~v4_off)


def valid_name(value: Column) -> Column:
    """First letter is a surname, last one is no office suffix."""
    return value.rlike(rf"\A[{C.SURNAMES}]") & ~value.rlike(rf"[{C.OFFICE_SUFFIXES}]\z")


VALIDATORS = {
    "RRN": valid_rrn,
    "CREDIT_CARD": valid_luhn,
    "IP_ADDRESS": valid_ip,
    "NAME_IN_QUERY": valid_name,
}


def _mask_rrn(v: Column) -> Column:
    d = _digits_only(v)
    return F.when(F.char_length(d) == 13, F.concat(F.substring(d, 1, 2), F.lit("****-*******"))).otherwise(
        _stars(F.char_length(v)))


def _mask_phone(v: Column) -> Column:
    d = _digits_only(v)
    return F.when(
        F.char_length(d) >= 10,
        F.concat(F.substring(d, 1, 3), F.lit("-****-"), F.right(d, F.lit(4))),
    ).otherwise(F.concat(F.substring(v, 1, 3), F.lit("****")))


def _mask_card(v: Column) -> Column:
    d = _digits_only(v)
    return F.concat(
        F.substring(d, 1, 4),
        F.lit("-****-****-"),
        F.when(F.char_length(d) == 16, F.right(d, F.lit(4))).otherwise(F.lit("****")),
    )


def _mask_account(v: Column) -> Column:
    n = F.char_length(v)
    return F.when(n >= 6, F.concat(F.substring(v, 1, 3), _stars(n - 6), F.right(v, F.lit(3)))).otherwise(F.lit("***"))


def _mask_email(v: Column) -> Column:
    parts = F.split(v, "@", -1)
    local = F.get(parts, 0)
    masked = F.when(
        F.char_length(local) > 2, F.concat(F.substring(local, 1, 2), _stars(F.char_length(local) - 2))
    ).otherwise(F.lit("**"))
    return F.when(F.size(parts) == 2, F.concat(masked, F.lit("@"), F.get(parts, 1))).otherwise(
        F.concat(F.substring(v, 1, 3), F.lit("***")))


def _mask_name(v: Column) -> Column:
    n = F.char_length(v)
    return F.when(n >= 2, F.concat(F.substring(v, 1, 1), _stars(n - 1))).otherwise(_stars(n))


def _mask_employee(v: Column) -> Column:
    n = F.char_length(v)
    return F.when(n >= 3, F.concat(F.substring(v, 1, 1), _stars(n - 2), F.right(v, F.lit(1)))).otherwise(_stars(n))


def _mask_birthdate(v: Column) -> Column:
    return F.concat(
        F.substring(v, 1, 4), F.when(v.rlike(r"(?U)\A\d{4}"), F.lit("-**-**")).otherwise(F.lit("****")))


def _mask_ip(v: Column) -> Column:
    groups, octets = F.split(v, ":", -1), F.split(v, r"\.", -1)
    return F.when(
        v.contains(":"),
        F.concat(F.get(groups, 0), F.lit(":"), F.get(groups, 1), F.lit(":****:****")),
    ).when(
        F.size(octets) == 4,
        F.concat(F.concat_ws(".", F.slice(octets, 1, 3)), F.lit("."), _stars(F.char_length(F.get(octets, 3)))),
    ).otherwise(F.concat(F.substring(v, 1, 7), F.lit("***")))


def _mask_other(v: Column) -> Column:
    n = F.char_length(v)
    return F.when(n > 4, F.concat(F.substring(v, 1, 2), _stars(n - 4), F.right(v, F.lit(2)))).otherwise(_stars(n))


_MASKS = {
    "RRN": _mask_rrn,
    "PHONE": _mask_phone,
    "CREDIT_CARD": _mask_card,
    "ACCOUNT_NO": _mask_account,
    "EMAIL": _mask_email,
    "NAME_IN_QUERY": _mask_name,
    "EMP_ID_IN_QUERY": _mask_employee,
    "EMP_ID_STANDALONE": _mask_employee,
    "BIRTHDATE": _mask_birthdate,
    "IP_ADDRESS": _mask_ip,
}


def mask_value(value: Column, pii_type: str) -> Column:
    """Mask of one value whose type is known when the plan is built."""
    return let(strip(value), _MASKS.get(pii_type, _mask_other))


def mask_by_type(value: Column, pii_type: Column) -> Column:
    """Mask of one value whose type is a column."""
    clean = strip(value)

    def choose(v: Column) -> Column:
        chain = F
        for name, mask in _MASKS.items():
            chain = chain.when(pii_type == name, mask(v))
        return chain.otherwise(_mask_other(v))

    return let(clean, choose)
