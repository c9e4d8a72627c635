"""Personal data by pattern: spans as (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")

# The four patterns and the limits of their matches.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
IP_PART_AT_MOST = 255
CARD_DIGITS = range(14, 20)
PHONE_DIGITS = range(10, 16)

#: Where the ip pattern fails at the first digit of a run, it fails at the others: they are not tried.
_IP = re.compile(r"(?<![0-9])" + PATTERNS["ip"].pattern)
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

Span = tuple[int, int, str]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def ip_holds(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= IP_PART_AT_MOST for p in parts)


def _holds(kind: str, match: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return ip_holds(match)
    digits = digits_of(match)
    if kind == "card":
        return len(digits) in CARD_DIGITS and luhn(digits)
    return len(digits) in PHONE_DIGITS


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from each @ so that long words cost nothing twice."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_PART:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1)
        if begin < at and domain:
            out.append((begin, domain.end(), "email"))
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of every match that holds, by start, then kind as listed."""
    spans = _emails(text) if "@" in text else []
    if any(d in text for d in "0123456789"):
        for kind in KINDS[1:]:
            if kind == "ip" and "." not in text or kind == "phone" and "+" not in text:
                continue
            spans += [
                (m.start(), m.end(), kind)
                for m in (_IP if kind == "ip" else PATTERNS[kind]).finditer(text)
                if _holds(kind, m[0])
            ]
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)
