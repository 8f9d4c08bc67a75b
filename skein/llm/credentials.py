"""Credentials embedded in source code and configuration: where they begin, and texts with them blanked.

The readers of ``configs`` give the values of configuration notations (object and JSON entries, assignments, call
arguments, YAML, INI, property and environment lines) with the paths of their keys and where they stand in the
bytes; query strings, addresses, headers, command options and remarks in comments are read by their own forms. A
value is a credential if its own shape says so (issuers' prefixes, signed sessions, key blocks), or if its path is
sensitive and the value is neither a placeholder nor read from elsewhere nor a mere name. Redactions are spliced
into the original bytes at these offsets: quotes, line breaks and everything else stay.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.configs import byte_offset, line_entries, line_notation, literals, script_entries


class Finding(NamedTuple):
    start: int  # where the credential begins, as characters
    spans: tuple[tuple[int, int], ...]  # what is to be blanked
    path: str
    kind: str


#: Prefixes and shapes that issuers give to their keys and tokens.
ISSUED = re.compile(
    r"(?:gh[opsur]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|npm_[A-Za-z0-9]{30,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|AIza[\w-]{35,}|glpat-[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|pypi-[\w-]{50,}|dop_v1_[0-9a-f]{64}|shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}|ya29\.[\w-]{20,}|sk-(?:ant-|proj-)?[A-Za-z0-9_-]{32,}"
    r"|eyJ[\w=-]{8,}\.eyJ[\w=-]{8,}\.[\w=-]{8,})"
)
_ISSUER = re.compile(r"(?:gh[opsur]|npm|[sr]k_(?:live|test))_[A-Za-z0-9]|(?:xox[abeoprs]|glpat)-[\w-]|github_pat_|eyJ[\w-]{8}")
KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
KEY_END = re.compile(r"-----END ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_BODY_LINE = re.compile(r"[\s'\"`+*/#>|,]*[A-Za-z0-9+/=]{16,}[\s'\"`+,;\\n]*$")

#: The last words of names whose values are secret, in the languages that occur in code.
_SECRET = frozenset(
    "password passwords passwd pass pwd passphrase passcode passwort kennwort kennung geheimnis secret secrets token tokens credential credentials cred creds auth authorization authentication "
    "apikey apikeys accesskey secretkey privatekey signingkey encryptionkey session sessionid sessiontoken jwt bearer pat otp mdp motdepasse senha contrasena contraseña clave parola wachtwoord "
    "segreto secreto segredo cookie passkey pin".split()
)
_PHRASES = frozenset("password passphrase passwd pwd passwort kennwort senha contrasena contraseña wachtwoord".split())
_SENTENCE_WORDS = frozenset("the your you and for must not with that this are has have was were will can cannot should from into least required invalid missing wrong please enter forgot reset change new old does did match too short long characters letters word words field input value label login user name".split())
_GENERIC = ("value", "default", "str", "string", "text", "raw", "hex")
_PLAIN = re.compile(r"^[A-Za-z0-9+/=_\-]{24,}$")
_SOURCE = re.compile(r"(?:env|config|settings|options|vault|secrets?)\b[\w.$\[\]'\"(]*?[.\['\"(]([\w$]+)['\")\]]*\s*(?:\?\?|\|\|)\s*$")
_LONG_TEMPLATE = re.compile(r"`((?:[^`\\\n]|\\.)*+\n(?:[^`\\]|\\.)*+)`")
_LINE = re.compile(r"^[ \t]*(?:export[ \t]+)?([A-Za-z][A-Za-z0-9_]{3,})=([^\s'\"`;,(){}\[\]]{6,})[ \t]*\r?$", re.M)
_KEY_OWNERS = frozenset("api access secret private signing encryption master shared service account auth client storage deploy license app session hmac webhook".split())
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+")
_PLACEHOLDER = re.compile(
    r"^(?:[x*.#?_\-•0]+|<.*>|\[.*\]|\{.*\}|%[a-z_]+%|\$\w+|\$\{.*\}|\{\{.*\}\}"
    r"|(?:your|my|the|an?|some|any|new|insert|enter|put|add|replace|change|fill|set|example|sample|dummy|fake|test|todo|tbd|none|null|nil|undefined|redacted|removed|hidden|masked|placeholder|default)(?:[-_ .][a-z]+)*[-_ .!?]*"
    r"|(?:your|my|insert|enter|replace|change|example|sample|dummy|fake|test|placeholder)(?:api|access|secret|auth|client|private|me|this|the|with)*(?:key|token|password|secret|pass|here|value|me)*[!?]*)$",
    re.I,
)
_NAME_LIKE = re.compile(r"^[@./]?[A-Za-z]+(?:[._/:\-][A-Za-z0-9]+)*$|^[a-z]+(?:[._\-][a-z0-9]+)+$|^[A-Z]+(?:_[A-Z0-9]+)+$")
_UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)

_INNER_ENTRY = re.compile(r"\\?\"([\w.\-]+)\\?\"\s*:\s*\\?\"((?:[^\"\\]|\\[^\"])*)\\?\"")
_CALL = re.compile(r"(?:\b|_)(?:log_?in|sign_?in|log_?on|authenticate|auth|connect\w*|basic_?auth|set_?credentials|with_?credentials|bind)\w{0,8}$", re.I)
_USERINFO = re.compile(r"[a-z][a-z0-9+.\-]{1,20}://[^\s/:@'\"`<>]*:([^\s/@'\"`]{3,})@", re.I)
_QUERY = re.compile(r"[?&]((?:[\w\-]*(?:token|key|secret|password|passwd|pwd|sig|signature|auth))|code|session\w*)=([^&\s'\"`#)]{6,})", re.I)
_HEADER = re.compile(r"\b(Basic|Bearer|Token)\s+([A-Za-z0-9+/._~=\-]{8,})", re.I)
_ENV = re.compile(r"(?:\bexport\s+|\bset\s+|^[\s/*#>\-]*|\benv\s+)([A-Za-z_][\w.]{2,})\s*=\s*['\"]?([^\s'\"`;,]{6,})", re.M)
_SAID = re.compile(
    r"\b(pass(?:word|wd|phrase|code)?|pwd|pw|secret|token|api[ _-]?key|key|log-?in|credentials?|kennwort|passwort|mot de passe|mdp|senha|contraseña|contrasena|clave|parola)\b"
    r"(?:\s+(?:for|of|on|to|in|at)\s+[\w.\-]+)?\s*(?:\b(?:is|was|are|were|ist|war|est|era|es)\b|[:=])\s*(?:['\"`])?(?:[\w.@\-]{2,40}\s+/\s+|[\w.@\-]{2,40}:(?=\S))?([^\s'\"`]{6,})",
    re.I,
)
_OPTION = re.compile(r"--?(?:password|passwd|token|secret|api-?key|auth)(?:=|\s+)['\"]?([^\s'\"`]{6,})|\bcurl\b[^\n]*?\s-u\s+['\"]?[\w.@\-]+:([^\s'\"`]{6,})", re.I)
_COMMENT_SECRET = re.compile(r"//[^\n]*\b(?:secret|private key|api key|signing key|encryption key|password|credentials?)\b|/\*[^\n]*\b(?:secret|password|private key)\b", re.I)
_COMMENT = re.compile(r"(?:(?<=\s)|^)(?://|/\*|\*|#|<!--)[^\n]*", re.M)
_CONTINUES = re.compile(r"\s*\+\s*\n\s*(['\"`])([^'\"`\n]+)\1")
_STARTS_INSIDE = re.compile(r"[ \t]*(['\"`])([A-Za-z0-9+/=_\-]{12,})\1[ \t]*\+?[ \t]*[;,)]?[ \t]*(?:\r?\n|$)")
_INSIDE_BLOCK = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n){7,}")


def opaque(value: str, least: int) -> bool:
    """Long enough, with letters and digits, and not just a name or number."""
    return len(value) >= least and bool(re.search(r"[A-Za-z]", value)) and bool(re.search(r"\d", value)) and not _UUID.match(value) and not re.match(r"^(?:v?\d+(?:\.\d+)+\S*|0x[0-9a-f]+|\d+[a-z]{1,3})$", value, re.I)


def jumbled(value: str) -> bool:
    """Twelve or more characters in which the letter case changes too often for words."""
    runs = re.findall(r"[A-Z]+|[a-z]+", value)
    return len(value) >= 12 and re.match(r"^[A-Za-z0-9+/=_\-]+$", value) is not None and len(runs) >= 6 and sum(map(len, runs)) / len(runs) < 2.6


def password_like(value: str) -> bool:
    """A value that someone may have chosen: not a placeholder, a name, a path or a sentence, with a digit or a sign."""
    if len(value) < 6 or re.search(r"\s", value) or _PLACEHOLDER.match(value) or "${" in value or "{{" in value or value.startswith(("process.", "env.", "http:", "https:", "@", "data:")):
        return False
    if _UUID.match(value) or re.match(r"^sha\d{3}-", value) or re.match(r"^[\d.,:\-+ ]+$", value):
        return False
    if jumbled(value) or _ISSUER.match(value) and len(value) >= 12:
        return True
    if re.match(r"^\.{0,2}/[\w./\-]*$", value):
        return False
    mixed = re.search(r"[a-z]", value) and re.search(r"[A-Z]", value) and re.search(r"\d", value)
    if _NAME_LIKE.match(value) and not (opaque(value, 12) and (mixed or re.search(r"\d.*[a-z].*\d|[a-z]\d[a-z]", value)) and not re.match(r"^[a-z]+(?:[._\-][a-z0-9]+)+$", value)):
        return False
    return bool(re.search(r"\d", value) or re.search(r"[!$%&*?#^+~]|-$", value)) and bool(re.search(r"[A-Za-z]", value))


def passphrase_like(value: str) -> bool:
    """Letters only: four to nine words in small letters, none of which makes a sentence, or one of sixteen letters or more."""
    words = re.split(r"[ \-]", value)
    if not all(re.match(r"^[a-z]{3,12}$", w) for w in words):
        return re.match(r"^[a-z]{16,}$", value) is not None and not _PLACEHOLDER.match(value)
    return 4 <= len(words) <= 9 and not _SENTENCE_WORDS.intersection(words)


def _last_words(name: str) -> list[str]:
    words = [w.lower() for w in _NAME_WORDS.findall(name.rsplit(".", 1)[-1] if "." in name else name)]
    while words and (words[-1].isdigit() or words[-1] in _GENERIC):
        words.pop()
    return words


def sensitive(path: tuple[str, ...], secret: frozenset[str] | None = None) -> bool:
    """Whether the value at the end of these keys is secret: by the last words of the last key that says something."""
    for name in reversed(path):
        words = _last_words(name)
        if not words:
            continue  # as in password: { value: ... }
        if secret is not None:
            return words[-1] in secret
        if words[-1] in _SECRET or "".join(words[-2:]) in _SECRET or "".join(words[-3:]) in _SECRET:
            return True
        return words[-1] in ("key", "keys") and len(words) > 1 and words[-2] in _KEY_OWNERS
    return False


def _key_block(text: str, m: re.Match[str]) -> Finding | None:
    rest = text[m.end() :]
    escaped = re.match(r"(?:\\r)?\\n[A-Za-z0-9+/=\\]{16,}", rest)
    if escaped:
        stop = re.search(r"-----END|['\"`\n]", rest)
        end = m.end() + (stop.start() if stop else len(rest))
        return Finding(m.start(), ((m.end() + 2, end),), "", "private key")
    lines, at, spans = rest.split("\n"), m.end(), []
    if len(lines) == 1 and not rest.strip("'\"`+; \r"):
        return Finding(m.start(), (), "", "private key")  # the text ends here
    at += len(lines[0]) + 1
    for line in lines[1:]:
        if "-----END" in line:
            break
        if line.strip() and not _BODY_LINE.match(line) and not re.match(r"^[\s'\"`+]*(?:[\w-]+: .*|[A-Za-z0-9+/=]+['\"`+\s\\n]*)$", line):
            break
        body = re.search(r"[A-Za-z0-9+/=]{4,}", line)
        if body:
            spans.append((at + body.start(), at + body.end()))
        at += len(line) + 1
    return Finding(m.start(), tuple(spans), "", "private key") if spans or at >= len(text) else None


def _worth_reading(value: str) -> bool:
    """Whether a value could be a credential under some key."""
    return len(value) >= 6 and (_PLAIN.match(value) is not None or '":' in value or password_like(value) or passphrase_like(value))


def find_credentials(text: str) -> list[Finding]:
    """All credentials of a text, by where they begin; none overlap."""
    if not text:
        return []
    found: list[Finding] = []
    # a text that begins inside a key block or a split string
    end = KEY_END.search(text)
    if end and not KEY_BLOCK.search(text, 0, end.start()):
        spans, at = [], 0
        for line in text[: end.start()].split("\n")[:-1] if "\n" in text[: end.start()] else []:
            body = re.search(r"[A-Za-z0-9+/=]{16,}", line)
            if body and _BODY_LINE.match(line):
                spans.append((at + body.start(), at + body.end()))
            else:
                spans = []
            at += len(line) + 1
        if spans:
            found.append(Finding(spans[0][0], tuple(spans), "", "private key"))
    elif not end and (body := _INSIDE_BLOCK.match(text)) and not KEY_BLOCK.search(text, 0, body.end()):
        # more lines than a public key has
        spans, at = [], 0
        for line in body[0].split("\n"):
            part = re.search(r"[A-Za-z0-9+/=]{16,}", line)
            spans += [(at + part.start(), at + part.end())] if part else []
            at += len(line) + 1
        found.append(Finding(spans[0][0], tuple(spans), "", "private key"))
    inside = _STARTS_INSIDE.match(text)
    if inside and opaque(inside[2], 12) and not _NAME_LIKE.match(inside[2].rstrip("=")) and not re.match(r"^[a-z]+$", inside[2]):
        found.append(Finding(inside.start(2), (inside.span(2),), "", "split string"))
    elif inside and opaque(inside[2], 12) and re.search(r"[a-z]\d|\d[a-z]", inside[2]) and not re.search(r"[/\-]", inside[2]):
        found.append(Finding(inside.start(2), (inside.span(2),), "", "split string"))
    for m in KEY_BLOCK.finditer(text):
        block = _key_block(text, m)
        if block:
            found.append(block)

    def add(start: int, stop: int, name: str, kind: str) -> None:
        spans, at = [(start, stop)], stop + 1
        while more := _CONTINUES.match(text, at):
            spans.append(more.span(2))
            at = more.end()
        found.append(Finding(start, tuple(spans), name, kind))

    for m in ISSUED.finditer(text):
        if m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_-"):
            add(m.start(), m.end(), "", "issued")
    for start, stop in [(0, len(text)), *(m.span(1) for m in _LONG_TEMPLATE.finditer(text))]:
        notation = line_notation(text[start:stop])
        for e in line_entries(text[start:stop], notation, start) if notation else ():
            value = text[e.start : e.stop]
            if sensitive(e.path) and password_like(value) or passphrase_like(value) and sensitive(e.path, _PHRASES):
                add(e.start, e.stop, ".".join(e.path), notation)
    for e in script_entries(text) if any(map(_worth_reading, literals(text))) else ():
        value = text[e.start : e.stop]
        if len(value) < 6:
            continue
        if '":' in value and value.lstrip().startswith("{"):
            for inner in _INNER_ENTRY.finditer(text, e.start, e.stop):
                if sensitive((*e.path, inner[1])) and password_like(inner[2]):
                    add(inner.start(2), inner.end(2), ".".join((*e.path, inner[1])), "entry")
            continue
        if "\n" in value:
            continue  # read by lines below
        likely = password_like(value)
        if not likely and not _PLAIN.match(value) and not passphrase_like(value):
            continue
        if text[e.start - 1] != "'" and text.count("'", text.rfind("\n", 0, e.start) + 1, e.start - 1) % 2:
            continue  # inside another string
        if e.role == "argument":
            if likely and _CALL.search(text[e.lead : text.find("(", e.lead)]):
                add(e.start, e.stop, "argument", "argument")
            continue
        name, path = e.path[-1], ".".join(e.path)
        if passphrase_like(value) and sensitive(e.path, _PHRASES):
            add(e.start, e.stop, path, "entry")
            continue
        if not likely and not _PLAIN.match(value):
            continue
        strong = sensitive(e.path)
        if not strong and e.role == "fallback":
            source = _SOURCE.search(text[e.lead : e.start - 1])
            strong = bool(source) and (sensitive((source[1],)) or re.search(r"(?i)key$", source[1]) is not None and name.lower().endswith("key"))
        if strong and likely:
            add(e.start, e.stop, path, "entry")
        elif re.search(r"(?i)(?<!public)(?<!public_)key$", name) and len(value) >= 24 and _PLAIN.match(value) and all(re.search(x, value) for x in ("[a-z]", "[A-Z]", r"\d")) and not re.match(r"^(?:sha\d|data)", value):
            add(e.start, e.stop, path, "entry")
        elif opaque(value, 24) and _PLAIN.match(value) and not re.search(r"(?i)checksum|digest|hash|commit|revision|integrity|\bid$|icon|image|public|etag|sri", name):
            eol = text.find("\n", e.stop)
            if _COMMENT_SECRET.search(text, e.stop, len(text) if eol < 0 else eol):
                add(e.start, e.stop, path, "entry")
    for m in _USERINFO.finditer(text):
        value = m[1]
        if not ("${" in value or re.match(r"^[<{$\[]|^%[a-z_]+%$", value) or _PLACEHOLDER.match(value) or re.match(r"^(?:password|passwd|pass|pwd|secret|token)$", value, re.I)):
            add(m.start(1), m.end(1), "address", "address")
    for m in _QUERY.finditer(text):
        if opaque(m[2], 12) and not _PLACEHOLDER.match(m[2]) and not re.search(r"[${<]", m[2]):
            add(m.start(2), m.end(2), m[1], "query")
    for m in _HEADER.finditer(text):
        value = m[2]
        if m[1].lower() == "basic":
            try:
                ok = b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
            except (binascii.Error, ValueError):
                ok = False
        else:
            ok = opaque(value, 16) and (not _NAME_LIKE.match(value) or jumbled(value)) or bool(re.match(r"^[0-9a-f]{32,}$", value))
        if ok:
            add(m.start(2), m.end(2), m[1], "header")
    for c in _COMMENT.finditer(text):
        for m in _ENV.finditer(text, c.start(), c.end()):
            if sensitive((m[1],)) and password_like(m[2]):
                add(m.start(2), m.end(2), m[1], "environment")
        for m in _SAID.finditer(text, c.start(), c.end()):
            value = m[2].rstrip(".,;)") or m[2]
            if password_like(value) and re.search(r"\d|[!$%&*?#^+~]", value) and len(value) >= 8 and not re.search(r"\(\)?$|://", value):
                add(m.start(2), m.start(2) + len(value), m[1], "comment")
    for m in _OPTION.finditer(text):
        g = m.lastindex
        if password_like(m[g]) and re.search(r"\d", m[g]):
            add(m.start(g), m.end(g), "option", "option")
    for m in _LINE.finditer(text):
        if sensitive((m[1],)) and password_like(m[2]):
            add(m.start(2), m.end(2), m[1], "environment")
    found.sort(key=lambda f: (f.start, -len(f.spans), -max((b for _, b in f.spans), default=0)))
    out: list[Finding] = []
    reach = -1
    for f in found:
        if f.start >= reach:
            out.append(f)
            reach = max([f.start + 1, *(b for _, b in f.spans)])
    return out


def redacted(text: str, findings: list[Finding], blank: str = "REDACTED") -> str:
    """The text with each span replaced, spliced in the bytes of its UTF-8 form."""
    data = text.encode("utf-8", "surrogatepass")
    parts, at, done = [], 0, 0
    for start, stop in sorted(s for f in findings for s in f.spans):
        a = at + len(text[done:start].encode("utf-8", "surrogatepass"))
        parts += [data[at:a], blank.encode()]
        at, done = a + len(text[start:stop].encode("utf-8", "surrogatepass")), stop
    return b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")


def credential_lines(df: DataFrame, identity: str, text: str) -> DataFrame:
    """``id``, ``line`` (from 1), ``kind``, ``path`` and, in bytes, ``start`` of each credential, once for rows delivered twice.

    Each row is read whole, where it lies. Null and empty texts hold none; a null id is kept as null.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, t.count("\n", 0, f.start) + 1, f.kind, f.path, byte_offset(t, f.start)) for i, t in zip(pdf["id"], pdf["t"]) if t for f in find_credentials(t)]
            yield pd.DataFrame(rows, columns=["id", "line", "kind", "path", "start"])

    return df.select(F.col(identity).alias("id"), F.col(text).alias("t")).mapInPandas(scan, "id string, line int, kind string, path string, start bigint").distinct()


def redact(df: DataFrame, text: str, into: str = "redacted") -> DataFrame:
    """The rows of ``df`` with a column ``into``: the text with credentials blanked; null stays null, others stay as they are."""

    @F.pandas_udf("string")
    def blank(texts: pd.Series) -> pd.Series:
        return pd.Series([redacted(t, f) if t and (f := find_credentials(t)) else t for t in texts], dtype=object)

    return df.withColumn(into, blank(F.col(text)))
