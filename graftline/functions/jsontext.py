"""JSON text to Python values and back, member order and repeated names kept.

An object is a ``Members``, a list of (name, value) pairs; an array is a list;
every number is a float. The dialect that is accepted: any byte up to 32 is white
space, numbers may have leading zeros or nothing after the point, control
characters may stand in strings, text after the value is ignored, and 1000
containers may be nested. ``Invalid`` is raised for anything else.
"""

from __future__ import annotations

import json
import math
import re
import sys

# Fixed values
NESTING_LIMIT = 1000
EPSILON = 2.220446049250313e-16
INT_MAX, INT_MIN = 2147483647, -2147483648

sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))  # a few frames for each nested container


class Invalid(ValueError):
    """The text is not JSON of the accepted dialect; ``at`` is the place of the
    first character that doesn't fit."""

    def __init__(self, what: str, at: int = 0):
        super().__init__(f"{what} at {at}")
        self.at = at


class Members(list):
    """The (name, value) pairs of an object."""


def _no_constant(name: str):
    raise Invalid(name)


_decoder = json.JSONDecoder(object_pairs_hook=Members, parse_int=float, parse_constant=_no_constant, strict=False)
_space = re.compile(r"[\x00-\x20]*")
_number = re.compile(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_plain = re.compile(r'[^"\\]*')
_brackets = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[\[{]+|[\]}]+', re.S)  # or a string, to step over
_escapes = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/"}
_ends = str.maketrans("[{", "]}")
_out = {i: f"\\u{i:04x}" for i in range(32)} | {8: "\\b", 12: "\\f", 10: "\\n", 13: "\\r", 9: "\\t", 34: '\\"', 92: "\\\\"}


def parse(text: str, strict: bool = False, placed: bool = True):
    """The value that ``text`` starts with; with ``strict`` nothing but white space
    may follow it. Without ``placed`` an error isn't always the first one."""
    text = text.partition("\0")[0]
    if strict:
        mark = int(text.startswith("\ufeff") and len(text) > 1)
        value, end = _value(text, _space.match(text, mark).end(), 0)
        if (end := _space.match(text, end).end()) < len(text):
            raise Invalid("text after the value", end)
        return value
    if text.startswith("﻿") and len(text) > 1:
        text = text[1:]
    at = _space.match(text).end()
    # The standard decoder is fast, and right where the dialects agree.
    if text[at : at + 1] in ("{", "[", '"') and "\\u" not in text:
        deep = _too_deep(text, at) if text[at] != '"' and text.count("[") + text.count("{") > NESTING_LIMIT else None
        if deep and not placed:
            raise Invalid("nesting", deep[0])
        try:
            if deep is None:
                return _decoder.raw_decode(text, at)[0]
            # If all before the place is right, nesting is what is wrong first.
            place, opened = deep
            _decoder.raw_decode(f"{text[:place]}null{opened[::-1].translate(_ends)}", at)
        except ValueError:
            pass
        else:
            raise Invalid("nesting", place)
    return _value(text, at, 0)[0]


def _too_deep(text: str, at: int) -> tuple[int, str] | None:
    """The place of the first container that is nested too deep in the container
    at ``at``, and those open there."""
    opened = ""
    for m in _brackets.finditer(text, at):
        run = m[0]
        if run[0] in "[{":
            if len(opened) + len(run) > NESTING_LIMIT:
                within = NESTING_LIMIT - len(opened)
                return m.start() + within, opened + run[:within]
            opened += run
        elif run[0] in "]}":
            opened = opened[: -len(run)]
            if not opened:
                return None
    return None


def _value(s: str, at: int, depth: int):
    c = s[at : at + 1]
    for word, value in (("null", None), ("false", False), ("true", True)):
        if s.startswith(word, at):
            return value, at + len(word)
    if c == '"':
        return _string(s, at)
    if c and c in "-0123456789":
        m = _number.match(s, at)
        if not m:
            raise Invalid("number", at)
        return float(m[0]), m.end()
    if c not in ("[", "{") or not c:
        raise Invalid("value", at)
    if depth >= NESTING_LIMIT:
        raise Invalid("nesting", at)
    close, out = ("]", []) if c == "[" else ("}", Members())
    at = _space.match(s, at + 1).end()
    if s.startswith(close, at):
        return out, at + 1
    while True:
        if c == "{":
            if not s.startswith('"', at):
                raise Invalid("name", min(at + 1, len(s)))
            name, at = _string(s, at)
            at = _space.match(s, at).end()
            if not s.startswith(":", at):
                raise Invalid("colon", at)
            at = _space.match(s, at + 1).end()
        value, at = _value(s, at, depth + 1)
        out.append((name, value) if c == "{" else value)
        at = _space.match(s, at).end()
        if s.startswith(close, at):
            return out, at + 1
        if not s.startswith(",", at):
            raise Invalid("comma", at)
        at = _space.match(s, at + 1).end()


def _unit(s: str, at: int, escape: int) -> int:
    digits = s[at : at + 4]
    if len(digits) < 4:
        raise Invalid("escape", escape)
    try:
        return int(digits, 16) if digits.isalnum() else 0
    except ValueError:
        return 0


def _string(s: str, at: int) -> tuple[str, int]:
    parts, at = [], at + 1
    first = at
    while True:
        m = _plain.match(s, at)
        parts.append(m[0])
        at = m.end()
        c = s[at : at + 1]
        if c == '"':
            return "".join(parts).partition("\0")[0], at + 1
        e = s[at + 1 : at + 2]
        if not c or not e:
            raise Invalid("string without end", first)
        escape = at
        at += 2
        if e == "u":
            code = _unit(s, at, escape)
            at += 4
            if 0xDC00 <= code <= 0xDFFF:
                raise Invalid("low surrogate", escape)
            if 0xD800 <= code <= 0xDBFF:
                low = _unit(s, at + 2, escape) if s.startswith("\\u", at) else 0
                if not 0xDC00 <= low <= 0xDFFF:
                    raise Invalid("high surrogate", escape)
                code, at = 0x10000 + ((code & 0x3FF) << 10 | low & 0x3FF), at + 6
            parts.append(chr(code))
        elif e in _escapes:
            parts.append(_escapes[e])
        else:
            raise Invalid("escape", escape)


def is_int32(number: float) -> bool:
    return INT_MIN <= number <= INT_MAX and number == int(number)


def close(a: float, b: float) -> bool:
    """Equality of numbers: within the relative machine epsilon."""
    return a == b or abs(a - b) <= max(abs(a), abs(b)) * EPSILON


def number_text(number: float) -> str:
    if math.isnan(number) or math.isinf(number):
        return "null"
    if is_int32(number):
        return str(int(number))
    short = f"{number:.15g}"
    return short if close(float(short), number) else f"{number:.17g}"


def string_text(value: str) -> str:
    return f'"{value.translate(_out)}"'


def scalar_text(value) -> str:
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    return string_text(value) if isinstance(value, str) else number_text(value)


def dump(value, pretty: bool = False, depth: int = 0) -> str:
    """Compact text, or one member a line with tabs; arrays stay on their line."""
    if isinstance(value, Members):
        if not pretty:
            return "{" + ",".join([f"{string_text(k)}:{dump(v)}" for k, v in value]) + "}"
        rows = ",\n".join(["\t" * (depth + 1) + f"{string_text(k)}:\t{dump(v, True, depth + 1)}" for k, v in value])
        return "{\n" + rows + ("\n" if value else "") + "\t" * depth + "}"
    if isinstance(value, list):
        return "[" + (", " if pretty else ",").join([dump(v, pretty, depth + 1) for v in value]) + "]"
    return scalar_text(value)
