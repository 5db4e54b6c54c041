"""Free-text detectors as native regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake import fixed_values as fx

# ECMAScript and Java read two classes differently: \b there knows ASCII word
# characters only, and \s there includes every Unicode space.
_ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_UNICODE_SPACE = r"\s\p{Z}\x{FEFF}"


# What may follow a leading \b so that the next character is surely a word character.
_WORD_START = re.compile(r"\w|\(\?:(?:\w+\|)*\w+\)|\(\?:\\d", re.ASCII)
_LITERAL_START = re.compile(r"\\b([A-Za-z0-9_]+-?)(?=[^*+?{|])")


def java_pattern(pattern: str) -> str:
    """The Java pattern that matches what the ECMAScript pattern matches.

    A leading boundary moves behind the literal it precedes: Java then searches
    for the literal instead of testing the boundary at every character.
    """
    out, in_class, i = [], False, 0
    literal = _LITERAL_START.match(pattern)
    if literal:
        start = re.escape(literal[1])
        out.append(f"{start}(?<!\\w{start})")
        i = literal.end()
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\b" and not in_class:
            out.append(r"(?<!\w)" if _WORD_START.match(pattern, i + 2) and i == 0 else _ASCII_BOUNDARY)
        elif pair == r"\s":
            out.append(_UNICODE_SPACE if in_class else f"[{_UNICODE_SPACE}]")
        elif pattern[i] == "\\":
            out.append(pair)
        else:
            in_class = (in_class or pattern[i] == "[") and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return "".join(out)


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


#: What deny terms become, as a replacement of ``regexp_replace``.
DENY_REPLACEMENT = _literal(fx.DENY_TEXT)


def _replace(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, _literal(replacement))


def _contains_any(text: Column, *needles: str) -> Column:
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


# Each scanner first looks for a literal that every match contains: most texts
# hold none, and a substring search costs far less than the expressions.


_SECRET_HINTS = (("-----BEGIN ",), ("eyJ",), ("sk-",), ("ghp_", "gho_", "ghs_", "ghu_"), ("AKIA",), ("xox",))
_PATH_HINTS = ("/Users/", "/home/", "\\")


def may_find(text: Column) -> Column:
    """Whether a text, or one of the texts it was joined of, holds the literal of any scanner but the deny list."""
    return _contains_any(text, *[n for needles in _SECRET_HINTS for n in needles], *_PATH_HINTS, "@") | _ip_hint(text)


def scan_secrets(text: Column) -> Column:
    """Run, one after the other, only the detectors whose literal occurs in the text."""
    detectors = [
        F.when(_contains_any(text, *needles), F.lit(java_pattern(pattern)))
        for needles, pattern in zip(_SECRET_HINTS, fx.SECRET_PATTERNS, strict=True)
    ]
    return F.aggregate(
        F.array_compact(F.array(*detectors)),
        text,
        lambda scrubbed, pattern: F.regexp_replace(scrubbed, pattern, F.lit(fx.SECRET_TEXT)),
    )


def _without_email(text: Column) -> Column:
    return _replace(text, java_pattern(fx.EMAIL_PATTERN), fx.EMAIL_TEXT)


def _without_ip(text: Column) -> Column:
    return _replace(text, java_pattern(fx.IP_PATTERN), fx.IP_TEXT)


def _ip_hint(text: Column) -> Column:
    return text.rlike(r"\d\.\d")


def scan_email(text: Column) -> Column:
    return F.when(text.contains("@"), _without_email(text)).otherwise(text)


def scan_ip(text: Column) -> Column:
    return F.when(_ip_hint(text), _without_ip(text)).otherwise(text)


def scan_pii(text: Column) -> Column:
    hint = text.contains("@") | _ip_hint(text)
    return F.when(hint, _without_ip(_without_email(text))).otherwise(text)


def scan_paths(text: Column) -> Column:
    scrubbed = _replace(text, java_pattern(fx.UNIX_HOME_PATTERN), fx.PATH_TEXT)
    scrubbed = _replace(scrubbed, "(?i)" + java_pattern(fx.WINDOWS_HOME_PATTERN), fx.PATH_TEXT)
    return F.when(_contains_any(text, *_PATH_HINTS), scrubbed).otherwise(text)


def deny_pattern(term: str) -> str:
    """Pattern for a literal term in any case; ASCII letters fold to ASCII letters only."""
    parts = []
    for ch in term:
        cased = {ch, ch.lower(), ch.upper()}
        variants = sorted(v for v in cased if len(v) == 1 and (v.isascii() == ch.isascii()))
        parts.append(re.escape(ch) if len(variants) == 1 else f"[{''.join(variants)}]")
    return "".join(parts)


def scan_deny_list(text: Column, terms) -> Column:
    """Replace literal terms in any case, one after the other: a later term may match an earlier replacement."""
    for term in terms:
        if term:
            text = _replace(text, deny_pattern(term), fx.DENY_TEXT)
    return text


def deny_list_hit(before: Column, after: Column, terms) -> Column:
    """True when any term fired; a term equal to the replacement fires without changing the text."""
    hit = before != after
    for term in terms:
        if term.lower() == fx.DENY_TEXT.lower():
            hit = hit | after.contains(fx.DENY_TEXT)
    return hit
