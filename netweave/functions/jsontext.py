"""JSON records as values: completeness, canonical form and type names.

Small per-row helpers that run inside Arrow batches; Spark partitions and shuffles the work.
"""

from __future__ import annotations

import hashlib
import json
import re

_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?")
#: White space that JSON allows around a value, and the byte order mark.
_AROUND = " \t\r\n"


class _Num(str):
    """A number in canonical decimal form: digits without outer zeros, and a power of ten."""


def _number(text: str) -> _Num:
    sign, whole, frac, exp = _NUMBER.fullmatch(text).groups()
    frac = frac or ""
    digits = (whole + frac).lstrip("0")
    if not digits:
        return _Num("0")
    kept = digits.rstrip("0")
    power = int(exp or 0) - len(frac) + len(digits) - len(kept)
    return _Num(f"{sign}{kept}e{power}")


def _refuse(text: str):
    raise ValueError(f"{text} is not JSON")


_exact = json.JSONDecoder(parse_float=_number, parse_int=_number, parse_constant=_refuse)
_plain = json.JSONDecoder(parse_constant=_refuse)
_lenient = json.JSONDecoder()


def parse(text: str | None, exact: bool = False, constants: bool = False):
    """The JSON value of a text, or None if the text is null, blank or not one complete value.

    The JSON value null also gives None. With exact, numbers come in canonical decimal form. With constants, the
    literals NaN, Infinity and -Infinity, which many writers emit, are numbers; without, they make a text no JSON.
    """
    if text is None:
        return None
    text = text.lstrip("﻿").strip(_AROUND)
    if not text:
        return None
    try:
        return (_exact if exact else _lenient if constants else _plain).decode(text)
    except (ValueError, RecursionError):
        return None


def _canonical(value) -> str:
    if isinstance(value, _Num):
        return value
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    return json.dumps(value)


def record_key(text: str | None) -> bytes | None:
    """A 16-byte digest that two texts share if they are the same JSON object; None if not a complete object."""
    value = parse(text, exact=True)
    if not isinstance(value, dict):
        return None
    return hashlib.blake2b(_canonical(value).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def type_name(value) -> str:
    """boolean, number, string, object, array or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "object" if isinstance(value, dict) else "array"
