"""Format strings of the dialect (letters as in .NET) in Spark's pattern letters."""

from __future__ import annotations

import re

# Pattern letters that differ.
LETTERS = {"dddd": "EEEE", "ddd": "EEE", "tt": "a", "fffffff": "SSSSSSS", "ffffff": "SSSSSS", "fffff": "SSSSS", "ffff": "SSSS", "fff": "SSS", "ff": "SS", "f": "S", "zzz": "xxx", "zz": "xx", "K": "XXX"}
TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|d+|t+|f+|z+|K|y+|M+|H+|h+|m+|s+|\\.|[A-Za-z]|.", re.S)


def date_pattern(text: str) -> str:
    out = []
    for t in TOKEN.findall(text):
        if t[0] == '"':
            out.append("'" + t[1:-1] + "'")
        elif t[0] == "\\":
            out.append("'" + t[1] + "'")
        elif t[0] in "'yMdHhmsftzK" or not t.isalpha():
            out.append(LETTERS.get(t, t))
        else:
            out.append("'" + t + "'")
    return "".join(out)


def number_pattern(text: str) -> tuple[str, str] | None:
    """Standard letters with digits, as (kind, digits); None for a custom pattern."""
    m = re.fullmatch(r"([CcDdEeFfGgNnPpXx])(\d*)", text)
    return (m[1].upper(), m[2]) if m else None
