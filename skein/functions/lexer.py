"""Lexemes of JavaScript and TypeScript sources, grouped by brackets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = frozenset(
    "var const function class extends return if else for while do switch case default break continue throw try catch finally new delete typeof void in instanceof this super null true false import export with debugger enum".split()
)
CONTEXTUAL = frozenset("let async await of get set static from as type interface namespace module declare abstract readonly public private protected override implements is keyof infer asserts satisfies unique yield global require accessor out using".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}

_LEX = re.compile(
    r"[ \t\f\v\xa0\ufeff]*(?:(?P<nl>\r\n|[\n\r\u2028\u2029])|(?P<lc>//[^\n\r\u2028\u2029]*)|(?P<bc>/\*.*?\*/)|(?P<id>(?:[^\W\d]|[$\\])[\w$\\\u200c\u200d]*)"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))"
    r"|(?P<str>'(?:[^'\\\n\r]|\\(?:\r\n|.))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|.))*\")|(?P<priv>\#[^\W\d][\w$]*|\#\$[\w$]*)|(?P<bt>`)"
    r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|>>>|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|>>|[{}()\[\];,<>+\-*/%&|^!~?:=.@]))",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_JSX_NAME = re.compile(r"\s*([A-Za-z_$][\w$.:\-]*)?")
_JSX_SPACE = re.compile(r"(?:\s|/\*.*?\*/|//[^\n]*)*", re.S)
_JSX_ATTRIBUTE = re.compile(r"[A-Za-z_$][\w$:\-]*")
_JSX_STRING = re.compile(r"\s*=\s*(?:\"[^\"]*\"|'[^']*')")
_JSX_TEXT = re.compile(r"[^<{}>]*")

_LINE_END = re.compile(r"[\n\r\u2028\u2029]|\Z")
_BLANK = re.compile(r"[ \t\f\v\xa0\ufeff]*")
_STRAY = re.compile(r"[\w$]+|.", re.S)
#: Words whose brackets a statement follows, so that / begins a pattern there.
_HEADS = frozenset(("if", "while", "for", "with"))

#: Kinds after which an operand has ended, so that / divides and a line break may end the statement.
ENDS = frozenset(("id", "num", "str", "tpl", "re", "priv", "this", "super", "null", "true", "false", "++", "--", "return", "break", "continue", "debugger")) | CONTEXTUAL
_NO_DIVISION = frozenset(("return", "break", "continue", "of", "await", "yield", "as", "keyof"))
#: Kinds that may begin a statement or member on the next line and never go on with the one before.
STARTS = frozenset(("id", "num", "str", "re", "priv", "this", "super", "null", "true", "false", "jsx", "@", "~", "!", "++", "--")) | (KEYWORDS - {"extends", "in", "instanceof", "else", "catch", "finally"}) | (CONTEXTUAL - {"as", "satisfies", "of", "is", "from", "implements"})


class LexError(Exception):
    def __init__(self, at: int, what: str) -> None:
        super().__init__(what)
        self.at, self.what = at, what


@dataclass(slots=True)
class Group:
    """Bracketed lexemes. ``kinds`` holds kinds of lexemes and groups; ``at`` where each begins."""

    open: str
    start: int
    kinds: list = field(default_factory=list)
    at: list = field(default_factory=list)
    end: int = -1
    head: bool = False  # of a statement: what follows begins one


class Lexer:
    """``typed``: TypeScript; ``markup``: elements may stand for operands. Comments go to ``comments`` as (start, end).

    A text that has no lexemes or brackets that don't match raises LexError. A ``tolerant`` lexer mends it instead,
    by one edit for each fault, kept in ``faults`` as (place of the edit, what): a quote, comment sign or bracket is put in (at
    the end of the line, the bracket before the one that doesn't fit), a stray character or bracket is left out.
    """

    def __init__(self, text: str, typed: bool = False, markup: bool = False, tolerant: bool = False) -> None:
        self.text, self.typed, self.markup, self.tolerant = text, typed, markup, tolerant
        self.comments: list[tuple[int, int]] = []
        self.faults: list[tuple[int, str]] = []

    def fault(self, at: int, what: str) -> None:
        if not self.tolerant:
            raise LexError(at, what)
        self.faults.append((at, what))

    def line_end(self, at: int) -> int:
        return _LINE_END.search(self.text, at).start()

    def program(self) -> Group:
        at = 0
        if self.text.startswith("\ufeff"):
            at = 1
        if self.text.startswith("#!", at):
            at = self.line_end(at)
        group, end = self.group("", at, at)
        return group

    def group(self, opened: str, start: int, at: int) -> tuple[Group, int]:
        """Lexemes up to the bracket that closes ``opened``, without recursion for plain brackets."""
        text, match, typed = self.text, _LEX.match, self.typed
        top = Group(opened, start)
        stack = [top]
        kinds, places, want = top.kinds, top.at, opened in ("", "{")
        last, fresh, before = "", False, ""
        while True:
            m = match(text, at)
            if m is None:
                rest = _BLANK.match(text, at).end()
                if rest == len(text):
                    if len(stack) > 1 or opened:
                        for g in reversed(stack if opened else stack[1:]):
                            self.fault(len(text), f"unclosed {g.open}")
                    for g in stack:
                        g.end = len(text)
                    return top, rest
                sign = text[rest]
                what = "unterminated comment" if text.startswith("/*", rest) else "unterminated string" if sign in "'\"" else "stray character"
                self.fault(rest, what)
                if sign in "'\"":
                    kinds.append("str")
                    places.append(rest)
                    at, last, fresh = self.line_end(rest), "str", False
                else:
                    at = _STRAY.match(text, rest).end()
                continue
            what, begin, at = m.lastgroup, m.start(m.lastgroup), m.end()
            if what == "nl":
                fresh = True
                continue
            if what == "lc":
                self.comments.append((begin, at))
                continue
            if what == "bc":
                self.comments.append((begin, at))
                fresh = fresh or "\n" in m["bc"]
                continue
            value = m[what]
            if what == "id":
                kind = value if value in KEYWORDS or value in CONTEXTUAL else "id"
                if kind != "id" and last in (".", "?."):
                    kind = "id"
            elif what == "p":
                kind = value
                operand = last not in ENDS and last != "group" and not (typed and last in ("void", ">")) or last in _NO_DIVISION and last != ")"
                if kind in ("/", "/=") and operand:
                    r = _REGEX.match(text, begin)
                    if r is not None:
                        kind, at = "re", r.end()
                    elif text.startswith("/*", begin):
                        self.fault(begin, "unterminated comment")
                        at = self.line_end(begin)
                        self.comments.append((begin, at))
                        continue
                    else:
                        self.fault(begin, "unterminated pattern")
                elif kind[0] == ">" and typed and kind in (">>", ">>>", ">>=", ">>>="):
                    kind, at = ">", begin + 1
                elif kind == "<" and self.markup and operand and (text[begin + 1 : begin + 2].isalpha() or text[begin + 1 : begin + 2] in "_$>") and not (typed and re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)").match(text, begin)):
                    kind, at = self.element(begin)
                elif kind in OPEN:
                    inner = Group(kind, begin)
                    inner.head = kind == "(" and (last in _HEADS or last == "await" and before == "for")
                    kinds.append(inner)
                    places.append(begin)
                    stack.append(inner)
                    kinds, places, want = inner.kinds, inner.at, kind == "{"
                    last, fresh, before = "", False, ""
                    continue
                elif kind in CLOSE:
                    while stack[-1].open != CLOSE[kind] and not (kind == "}" and stack[-1] is top and opened in ("${", "{jsx")):
                        fits = len(stack) > 1 and any(g.open == CLOSE[kind] or kind == "}" and g is top and opened in ("${", "{jsx") for g in stack[:-1])
                        self.fault(begin, f"unclosed {stack[-1].open}" if fits else f"unmatched {kind}")
                        if not fits:
                            break
                        stack.pop().end = begin
                    else:
                        fits = True
                    if not fits:
                        continue
                    stack[-1].end = at
                    head = stack.pop().head
                    if not stack:
                        return top, at
                    parent = stack[-1]
                    kinds, places, want = parent.kinds, parent.at, parent.open in ("", "{")
                    last, fresh, before = "head" if head else "group", False, ""
                    continue
            elif what == "bt":
                kind, at = self.template(begin)
            else:
                kind = what
            if fresh:
                fresh = False
                name = "jsx" if isinstance(kind, Group) and kind.open == "jsx" else kind
                ended = last in ENDS or last == "group" or typed and (last in (">", "void") or last == "const" and before == "as")
                if want and ended and not isinstance(name, Group) and name in STARTS:
                    kinds.append("NL")
                    places.append(begin)
            kinds.append(kind)
            places.append(begin)
            before, last = last, "group" if isinstance(kind, Group) else kind

    def template(self, start: int) -> tuple[object, int]:
        at, parts = start + 1, []
        while True:
            at = _TEMPLATE.match(self.text, at).end()
            here = self.text[at : at + 1]
            if here == "`":
                if not parts:
                    return "tpl", at + 1
                group = Group("`", start, parts, [p.start for p in parts], at + 1)
                return group, at + 1
            if here != "$":
                self.fault(len(self.text), "unterminated template")
                return ("tpl" if not parts else Group("`", start, parts, [p.start for p in parts], len(self.text))), max(at, start + 1)
            inner, at = self.group("${", at, at + 2)
            parts.append(inner)

    def element(self, start: int) -> tuple[Group, int]:
        """A mark-up element from its < on; its parts are the groups in braces and the inner elements."""
        text, parts = self.text, []
        name = _JSX_NAME.match(text, start + 1)
        at = name.end()
        tag = name[1]
        if self.typed and text[at : at + 1] == "<":
            close = text.find(">", at)
            at = close + 1 if close > 0 else at
        while tag:
            at = _JSX_SPACE.match(text, at).end()
            here = text[at : at + 1]
            if here == "/" and text[at + 1 : at + 2] == ">":
                return Group("jsx", start, parts, [p.start for p in parts], at + 2), at + 2
            if here == ">":
                break
            if here == "{":
                inner, at = self.group("{jsx", at, at + 1)
                parts.append(inner)
                continue
            attribute = _JSX_ATTRIBUTE.match(text, at)
            if attribute is None:
                self.fault(at, "unclosed tag")
                return Group("jsx", start, parts, [p.start for p in parts], at), max(at, start + 1)
            at = attribute.end()
            value = _JSX_STRING.match(text, at)
            if value:
                at = value.end()
            elif (eq := re.compile(r"\s*=\s*").match(text, at)) is not None:
                at = eq.end()
                if text[at : at + 1] == "{":
                    inner, at = self.group("{jsx", at, at + 1)
                elif text[at : at + 1] == "<":
                    inner, at = self.element(at)
                else:
                    self.fault(at, "bad attribute")
                    continue
                parts.append(inner)
        if text[at : at + 1] != ">":
            self.fault(at, "unclosed tag")
            return Group("jsx", start, parts, [p.start for p in parts], at), max(at, start + 1)
        at += 1
        while True:
            at = _JSX_TEXT.match(text, at).end()
            here = text[at : at + 1]
            if here == "{":
                inner, at = self.group("{jsx", at, at + 1)
                parts.append(inner)
            elif here == "<":
                close = re.compile(r"<\s*/\s*([A-Za-z_$][\w$.:\-]*)?\s*>").match(text, at)
                if close:
                    if (close[1] or None) != tag:
                        self.fault(at, f"closing tag of {tag} expected")
                    return Group("jsx", start, parts, [p.start for p in parts], close.end()), close.end()
                inner, at = self.element(at)
                parts.append(inner)
            else:
                self.fault(at, "unclosed element" if not here else "stray character in mark-up")
                if not here:
                    return Group("jsx", start, parts, [p.start for p in parts], at), at
                at += 1
