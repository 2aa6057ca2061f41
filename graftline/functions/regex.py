"""POSIX extended regular expressions, as Python's and Java's engines take them.

Only whether a pattern is found matters, so leftmost-longest makes no
difference. Anchors stand for the ends of the string and a point for any
character, newlines included.
"""

from __future__ import annotations

import functools
import re

# The classes of the POSIX locale
CLASSES = {
    "alpha": "A-Za-z",
    "digit": "0-9",
    "alnum": "A-Za-z0-9",
    "upper": "A-Z",
    "lower": "a-z",
    "space": r"\x09-\x0D\x20",
    "blank": r"\x09\x20",
    "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E",
    "print": r"\x20-\x7E",
    "graph": r"\x21-\x7E",
    "cntrl": r"\x00-\x1F\x7F",
    "xdigit": "0-9A-Fa-f",
}


class BadPattern(ValueError):
    """The pattern is not a valid extended regular expression."""


def _literal(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02X}"


def _bracket(p: str, at: int) -> tuple[str, int]:
    """The set that starts after the bracket before ``at``."""
    out, at = ["["], at
    if p.startswith("^", at):
        out, at = ["[^"], at + 1
    first = True
    while True:
        if at >= len(p):
            raise BadPattern("bracket without end")
        if p[at] == "]" and not first:
            return "".join(out) + "]", at + 1
        first = False
        if p.startswith("[:", at):
            name, found, _ = p[at + 2 :].partition(":]")
            if not found or name not in CLASSES:
                raise BadPattern("character class")
            out.append(CLASSES[name])
            at += len(name) + 4
            continue
        if p.startswith(("[.", "[="), at):
            close = p[at + 1] + "]"
            name, found, _ = p[at + 2 :].partition(close)
            if not found or len(name) != 1:
                raise BadPattern("collating element")
            low, at = name, at + 5
        else:
            low, at = p[at], at + 1
        if p.startswith("-", at) and at + 1 < len(p) and p[at + 1] != "]":
            high = p[at + 1]
            if high < low:
                raise BadPattern("range")
            out.append(f"{_literal(low)}-{_literal(high)}")
            at += 2
        else:
            out.append(_literal(low))


def translate(pattern: str, end: str = r"\Z") -> str:
    """``pattern`` for an engine whose mark for the very end is ``end``: ``\\Z`` in
    Python, ``\\z`` in Java. Raises BadPattern."""
    stack: list[list[str]] = [["(?s)"]]  # pieces of the open groups, the last one being what a quantifier repeats
    at, can_repeat = 0, False
    while at < len(pattern):
        c = pattern[at]
        at += 1
        top = stack[-1]
        if c in "*+?{":
            m = re.match(r"([0-9]+)(,([0-9]*))?\}", pattern[at:]) if c == "{" else None
            if not can_repeat or (c == "{" and not m) or (m and m[3] and int(m[3]) < int(m[1])) or (m and max(int(m[1]), int(m[3] or 0)) > 32767):
                raise BadPattern("repetition")
            times = "{" + m[0] if m else c
            at += m.end() if m else 0
            top[-1] = f"(?:{top[-1]}){times}"
        elif c == "(":
            stack.append([""])
            can_repeat = False
        elif c == ")" and len(stack) > 1:
            inner = "".join(stack.pop())
            stack[-1].append(f"(?:{inner})")
            can_repeat = True
        elif c == "|":
            top.append("|")
            can_repeat = False
        elif c in "^$":
            top.append(r"\A" if c == "^" else end)
            can_repeat = c == "$"
        elif c == "[":
            piece, at = _bracket(pattern, at)
            top.append(piece)
            can_repeat = True
        elif c == "\\":
            if at >= len(pattern):
                raise BadPattern("trailing backslash")
            e = pattern[at]
            at += 1
            top.append({"w": "[A-Za-z0-9_]", "W": "[^A-Za-z0-9_]", "s": r"[\x09-\x0D\x20]", "S": r"[^\x09-\x0D\x20]", "b": r"\b", "B": r"\B", "<": r"\b(?=\w)", ">": r"\b(?<=\w)", "`": r"\A", "'": end}.get(e, _literal(e)))
            can_repeat = True
        else:
            top.append("." if c == "." else _literal(c))
            can_repeat = True
    if len(stack) > 1:
        raise BadPattern("parenthesis without end")
    return "".join(stack[0])


def java(pattern: str) -> str:
    """For ``rlike``."""
    return translate(pattern, r"\z")


@functools.lru_cache(maxsize=1024)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(translate(pattern))
