"""Base patterns of personal data, the check of what a model adds, and the choice among its spans."""

from __future__ import annotations

import re
from bisect import bisect_right

KINDS = ("email", "ip", "card", "phone")

#: (start, end) in code points, end exclusive.
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Other spellings that a model's span may have; each becomes a base one by these replacements.
AT = re.compile(r"\s*(?:@|[\[(]\s*at\s*[\])])\s*", re.I)
DOT = re.compile(r"\s*(?:\.|[\[(]\s*(?:dot|\.)\s*[\])])\s*", re.I)
LOOSE_CARD = re.compile(r"[0-9](?:[ ./_-]{0,3}[0-9])+")
LOOSE_PHONE = re.compile(r"(?:\+|\()?[0-9][0-9 ()./-]*[ ()./-][0-9 ()./-]*[0-9]")

#: What every span in any of these spellings holds; a window without it can hold none.
TRIGGER = re.compile(r"[0-9@]|[\[(]\s*at\s*[\])]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    out, done = [], 0
    sign = text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, sign + 1) if start < sign else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = sign + 1
        sign = text.find("@", done)
    return out


def valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in text.split("."))


def valid_card(text: str) -> bool:
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 8 <= len(_digits(text)) <= 15


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind; one that fails its check is dropped."""
    out = {"email": emails(text)}
    for kind, pattern, valid in (("ip", IP, valid_ip), ("card", CARD, valid_card), ("phone", PHONE, valid_phone)):
        out[kind] = [m.span() for m in pattern.finditer(text) if valid(m.group())]
    return out


def accepted(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a model's span reads as its kind once its spelling is normalised."""
    body = text[start:end]
    before, after = text[start - 1 : start], text[end : end + 1]
    if before.isalnum() or after.isalnum():
        return False
    if kind == "email":
        plain = DOT.sub(".", AT.sub("@", body))
        return emails(plain) == [(0, len(plain))]
    if kind == "ip":
        plain = DOT.sub(".", body)
        return bool(IP.fullmatch(plain)) and valid_ip(plain)
    if kind == "card":
        return bool(LOOSE_CARD.fullmatch(body)) and valid_card(body)
    return bool(LOOSE_PHONE.fullmatch(body)) and valid_phone(body)


def overlaps(span: Span, taken: list[Span]) -> bool:
    """``taken`` is sorted and without overlaps."""
    k = bisect_right(taken, (span[1],)) - 1
    return k >= 0 and taken[k][1] > span[0]


def reconciled(found: list[tuple[int, int, str, float]], taken: list[Span]) -> list[tuple[int, int, str]]:
    """The spans of all windows of a text, weighed together.

    Of (start, end, kind, score) the non-overlapping choice of the highest total score, beside
    the spans already taken.  Equal spans of several windows count once, with the best score.
    """
    best: dict[tuple[int, int, str], float] = {}
    for start, end, kind, score in found:
        if score > 0 and not overlaps((start, end), taken):
            best[start, end, kind] = max(score, best.get((start, end, kind), 0.0))
    spans = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    total, use = [0.0], []
    for k, span in enumerate(spans):
        before = bisect_right(ends, span[0], 0, k)
        with_it = total[before] + best[span]
        use.append(with_it > total[k])
        total.append(max(total[k], with_it))
    out, k = [], len(spans)
    while k:
        if use[k - 1]:
            out.append(spans[k - 1])
            k = bisect_right(ends, spans[k - 1][0], 0, k - 1)
        else:
            k -= 1
    return out[::-1]


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans.get(kind, [])))
