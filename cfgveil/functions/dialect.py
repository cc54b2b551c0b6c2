"""Rule text is written in Python's regular-expression dialect; Spark runs Java's.

The two differ in ways that fail silently (``\\1`` in a replacement is a literal
``1`` for Java, ``.`` stops at more characters than ``\\n``), so every rule goes
through the two functions below before it reaches a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# Flag names of the Python dialect and their Java inline letters.
FLAG_LETTERS = {
    "IGNORECASE": "iu",
    "I": "iu",
    "MULTILINE": "m",
    "M": "m",
    "DOTALL": "s",
    "S": "s",
}
IGNORED_FLAGS = {"UNICODE", "U", "NOFLAG"}

# The letter escapes a replacement template may hold.
TEMPLATE_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b"}

_NAMED_GROUP = re.compile(r"\(\?P<\w+>")
_NAMED_BACKREF = re.compile(r"\(\?P=(\w+)\)")
_OPEN_ENDED_REPEAT = re.compile(r"\{,(\d+)\}")
_TEMPLATE_TOKEN = re.compile(r"\\g<(\w+)>|\\(\d{1,2})|\\(.)|(\$)|([^\\$]+)", re.DOTALL)


def inline_flags(flags: Iterable[str], *, any_case: bool) -> str:
    """Java inline flags; with ``any_case`` false, ``ignorecase`` is not ``IGNORECASE``."""
    letters = ["d"]
    names = [f.upper() if any_case else f for f in flags]
    if not {"ASCII", "A"} & set(names):
        letters.append("U")
    for name in names:
        if name in {"VERBOSE", "X"}:
            raise ValueError("VERBOSE rules are not supported; write the pattern on one line")
        for letter in FLAG_LETTERS.get(name, ""):
            if letter not in letters:
                letters.append(letter)
    return "(?" + "".join(letters) + ")"


def java_pattern(pattern: str, flags: Iterable[str] = (), *, any_case: bool = True) -> str:
    """The same language in Java's dialect, with the flags as an inline prefix."""
    names = re.compile(pattern).groupindex
    pieces: list[str] = []
    at, in_class = 0, False
    while at < len(pattern):
        rest = pattern[at:]
        if rest[0] == "\\":
            pieces.append("\\z" if rest[:2] == "\\Z" and not in_class else rest[:2])
            at += 2
        elif in_class:
            if rest[0] == "[" or rest.startswith("&&"):
                pieces.append("\\" + rest[0])
            else:
                pieces.append(rest[0])
                in_class = rest[0] != "]"
            at += 1
        elif rest[0] == "[":
            head = re.match(r"\[\^?\]?", rest).group()
            pieces.append(head.replace("]", "\\]"))
            at, in_class = at + len(head), True
        elif named := _NAMED_GROUP.match(rest):
            pieces.append("(")
            at += named.end()
        elif back := _NAMED_BACKREF.match(rest):
            pieces.append(f"(?:\\{names[back.group(1)]})")
            at += back.end()
        elif repeat := _OPEN_ENDED_REPEAT.match(rest):
            pieces.append(f"{{0,{repeat.group(1)}}}")
            at += repeat.end()
        else:
            pieces.append(rest[0])
            at += 1
    return inline_flags(flags, any_case=any_case) + "".join(pieces)


def java_replacement(template: str, pattern: str = "") -> str:
    """The replacement template with ``$n`` references and literal ``$`` and ``\\`` escaped."""
    compiled = re.compile(pattern)
    pieces: list[str] = []
    after_group = False
    for named, number, escaped, dollar, plain in _TEMPLATE_TOKEN.findall(template):
        group = number if number and number[0] != "0" else ""
        if named:
            group = named if named.isdigit() else str(compiled.groupindex[named])
        if group:
            if int(group) > compiled.groups:
                raise ValueError(f"no group {group} in pattern {pattern!r}")
            pieces.append(f"${int(group)}")
        elif dollar or escaped == "\\":
            pieces.append("\\" + (dollar or escaped))
        elif escaped:
            if escaped not in TEMPLATE_ESCAPES:
                raise ValueError(f"bad escape \\{escaped} in replacement {template!r}")
            pieces.append(TEMPLATE_ESCAPES[escaped])
        elif number:
            raise ValueError(f"octal escape in replacement {template!r}")
        else:
            # Java would read a digit after $n as part of the group number.
            pieces.append("\\" + plain if after_group and plain[0].isdigit() else plain)
        after_group = bool(group)
    return "".join(pieces)


def capture_groups(pattern: str) -> int:
    """Number of capture groups, i.e. which group a detection reports (the last one)."""
    return re.compile(pattern).groups
