"""Readers of configuration notations: every value with the path of its keys and where it stands in the text.

``script_entries`` reads what object literals, assignments, arguments and JSON say, in whole files or in pieces
that begin or end anywhere; ``line_entries`` reads YAML, INI, property and environment files by lines, with values
that need no quotes. Both go once over the text, whatever its length and that of its values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Entry(NamedTuple):
    path: tuple[str, ...]  # keys from the outermost on; empty for a mere argument
    start: int  # of the value, without quotes, in characters
    stop: int
    notation: str  # script, yaml or ini
    role: str  # direct, fallback, call (within a call that makes the value), argument
    lead: int  # where the last key begins, or the call

    def span(self, text: str) -> tuple[int, int]:
        """Where the value stands in the bytes of the text's UTF-8 form."""
        return byte_offset(text, self.start), byte_offset(text, self.stop)


def byte_offset(text: str, at: int) -> int:
    return at if text.isascii() else len(text[:at].encode("utf-8", "surrogatepass"))


#: A quote that opens does not follow a word (but for a few keywords) and one that closes does not precede one:
#: apostrophes, and texts that begin within a literal, put only themselves out of step.
_OPENS = "(?:(?<!\\w{0})|" + "|".join(rf"(?<=\b{word}{{0}})" for word in ("return", "case", "typeof", "throw", "default", "yield", "await", "from", "import")) + ")"
_QUOTES = (
    r"(?P<pattern>/(?:(?<=[(,=:\[!&|?;{}]/)|(?<=[(,=:\[!&|?;{}][ \t]/))(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
    rf"|(?P<one>'{_OPENS.format("'")}(?:[^'\\\n]|\\.)*+'(?!\w))|(?P<two>\"{_OPENS.format(chr(34))}(?:[^\"\\\n]|\\.)*+\"(?!\w))|(?P<template>`(?:[^`\\]|\\.)*+`)"
)
_LITERAL = re.compile(_QUOTES, re.S)
_TOKEN = re.compile(
    r"(?P<skip>[ \t\r]+|//[^\n'\"`]*(?=\n|\Z)|/\*[^'\"`]*?\*/)|(?P<nl>\n)|" + _QUOTES + r"|(?P<name>[\w$](?:[\w$]|[.\-](?=[\w$]))*)|(?P<sign>=>|[=!]==?|[<>]=|\?\?=?|\|\|=?|&&=?|\?\.|\+=|[{}()\[\],;:=?+.<>|&!*])|(?P<other>.)",
    re.S,
)
_KEY_FOLLOWS = re.compile(r"\s*\]?\s*\??(?:\s*:(?!:)|\s*=(?![=>]))")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_GOES_ON = frozenset(("=", ":", "??", "||", "??=", "||=", "(", "[", "{", ",", "?", "+", "&&", "."))


class _Frame(NamedTuple):
    bracket: str
    label: str
    key: str | None
    callee: str
    lead: int
    separator: str


def literals(text: str) -> Iterator[str]:
    """The values in quotes, whatever they belong to."""
    for m in _LITERAL.finditer(text):
        if m.lastgroup != "pattern":
            yield m[0][1:-1]


def script_entries(text: str) -> Iterator[Entry]:
    """Values in quotes with the keys, names or calls they belong to; lengths don't matter, nor do comments between."""
    frames: list[_Frame] = []
    key: str | None = None
    separator = state = last = name = ""
    lead = at_name = place = angles = 0
    worded = False  # the call's first argument is a literal
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "nl":
            if key is not None and last not in _GOES_ON and not _joined(text, m.end()):
                key = None
            continue
        if kind in ("one", "two", "template"):
            start, stop = m.start() + 1, m.end() - 1
            if kind != "template" and state != "ternary" and _KEY_FOLLOWS.match(text, m.end()):
                name, at_name, last = text[start:stop], m.start(), "name"
                if key is not None and state == "direct":
                    state = "named"
                continue
            if key is not None and state in ("direct", "fallback", "ternary", "call"):
                labels = tuple(f.label for f in frames if f.label)
                own = () if frames and frames[-1].bracket == "[" and frames[-1].label == key else (key,)
                yield Entry((*labels, *own), start, stop, "script", "fallback" if state == "ternary" else state, lead)
                state = "fallback" if state == "ternary" else "other"
            elif frames and frames[-1].bracket == "(" and frames[-1].callee:
                if place == 1 and worded and last == ",":
                    yield Entry((), start, stop, "script", "argument", frames[-1].lead)
            if place == 0 and last == "(":
                worded = True
            last = "string"
            continue
        if kind == "name":
            if key is not None and state in ("direct", "fallback", "ternary"):
                state = "ternary" if state == "ternary" else "named"
            name, at_name, last = m[0], m.start(), "name"
            continue
        if kind in ("pattern", "other"):
            state, last = ("other" if key is not None else state), kind
            continue
        sign = m[0]
        if sign in "({[":
            callee = name if last == "name" and sign == "(" else ""
            if sign == "[" and last == "name" and key is None:
                frames.append(_Frame(sign, "", None, "", lead, ""))  # an index
            else:
                label = key if key is not None and state in ("direct", "fallback", "call") and sign != "(" else ""
                frames.append(_Frame(sign, label or "", key, callee, at_name if callee else m.start(), separator))
                if sign == "(" and key is not None and state in ("named", "direct", "fallback"):
                    state = "call" if state == "named" else state
                elif sign == "[" and label:
                    state = "direct"
                else:
                    key = None
            place, worded = 0, False
        elif sign in ")}]":
            while frames:
                frame = frames.pop()
                if frame.bracket == _PAIRS[sign]:
                    key, separator = frame.key, frame.separator
                    break
            else:
                key = None
            if not (sign == "]" and last == "name"):
                state, last = "other", sign
            place, worded = 2, False
            continue
        elif sign == "," and angles > 0:
            pass  # between type arguments
        elif sign in "<>" and key is not None and separator == ":":
            angles += 1 if sign == "<" else -1
        elif sign == ",":
            place += 1
            if frames and frames[-1].bracket == "[" and frames[-1].label:
                key, state = frames[-1].label, "direct"
            else:
                key = None
        elif sign == ";":
            key = None
        elif sign == ":" and key is not None and state == "ternary":
            state = "fallback"
        elif sign == ":" and key is not None and separator == "=" and state == "fallback" and last == "string":
            state = "fallback"  # the other branch
        elif sign in (":", "=", "??=", "||=", "+=") and last == "name":
            if not (sign == "=" and key is not None and separator == ":" and state == "named"):  # but for a type
                key, lead = name, at_name
            separator, state, angles = sign[-1], "direct", 0
        elif sign == "=" and key is not None and separator == ":":
            separator, state = "=", "direct"  # behind a longer type
        elif sign == "?":
            if last != "name" or not _KEY_FOLLOWS.match(text, m.start()):
                state = "ternary" if key is not None else state
            else:
                continue  # an optional key
        elif sign in ("??", "||"):
            state = "fallback"
        elif key is not None and state == "direct":
            state = "other"
        last = sign


def _joined(text: str, at: int) -> bool:
    """Whether the next line goes on with an expression."""
    return re.compile(r"\s*(?:\?\?|\|\||\?|:|\+|\.|&&)").match(text, at) is not None


_YAML = re.compile(r"^(?P<indent>[ \t]*)(?:-[ \t]+)*(?P<q>['\"]?)(?P<key>[\w$][\w$ ./\-]*?)(?P=q)[ \t]*:(?:[ \t]+(?P<value>[^\n]*?))?[ \t]*\r?$")
_PROPERTY = re.compile(r"^(?P<indent>[ \t]*)(?:(?:export|set|env)[ \t]+)?(?P<key>[\w$][\w$.\-]*)(?P<gap>[ \t]*)=[ \t]*(?P<value>[^\n]*?)[ \t]*\r?$")
_SECTION = re.compile(r"^[ \t]*\[(?P<name>[^\]\n]+)\][ \t]*\r?$")
_PASSED = re.compile(r"^[ \t]*(?:[#;!].*|---.*|\.\.\.|-[ \t]+[^:=]*|)\r?$")
_CODE = re.compile(r"[;{(,\[]\s*\r?$|=>|\b(?:const|let|var|function|return|import|export default)\b\s|^\s*[})\]]")


def line_notation(text: str) -> str | None:
    """yaml or ini if every line fits (blank lines and comments aside) and one at least has a value; else None."""
    found = {"yaml": 0, "ini": 0}
    for line in text.split("\n"):
        if _PASSED.match(line):
            continue
        if _CODE.search(line):
            return None
        if _SECTION.match(line):
            found["ini"] += 1
        elif _PROPERTY.match(line):
            found["ini"] += 1
        elif _YAML.match(line):
            found["yaml"] += 1
        else:
            return None
    if found["yaml"] and found["ini"]:
        return None
    return "yaml" if found["yaml"] else "ini" if found["ini"] else None


def line_entries(text: str, notation: str, offset: int = 0) -> Iterator[Entry]:
    """The values of a YAML (by indentation) or INI, property or environment text (by sections)."""
    at, above, section = offset, [], ()
    for line in text.split("\n"):
        m = None if _PASSED.match(line) else (_YAML if notation == "yaml" else _PROPERTY).match(line)
        if m is None:
            head = _SECTION.match(line) if notation == "ini" else None
            section = tuple(head["name"].split(".")) if head else section
        else:
            if notation == "yaml":
                width = len(m["indent"].expandtabs()) + 2 * line[len(m["indent"]) :].startswith("- ")
                while above and above[-1][0] >= width:
                    above.pop()
                path = (*(k for _, k in above), m["key"])
            else:
                width, path = 0, (*section, *m["key"].split("."))
            value = m["value"] or ""
            start = at + m.start("value") if value else at
            if notation == "yaml" and not value or value in ("|", ">", "|-", ">-"):
                above.append((width, m["key"]))
            elif value:
                quoted = re.match(r"(['\"])(.*?)\1\s*(?:#.*)?$", value)
                inner = quoted[2] if quoted else re.split(r"[ \t]+[#;]", value)[0].rstrip()
                start += 1 if quoted else 0
                if inner:
                    yield Entry(path, start, start + len(inner), notation, "direct", at + m.start("key"))
        at += len(line) + 1
