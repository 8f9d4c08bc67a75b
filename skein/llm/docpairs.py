"""Functions paired with their documentation.

An island grammar per language family says what is looked for in a source file: documentation comments,
annotations, signatures and balanced bodies. Everything else is water: it is skipped, except that strings,
templates and regular expressions are passed as wholes, so that comment signs and braces in them don't count.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class IslandGrammar:
    """``lexeme``: comments and the parts of the water that hide signs; ``signature``: what may follow a documentation
    comment, with the groups ``name`` and, for blocks, an opening brace to come; ``annotation``: lines between."""

    lexeme: re.Pattern[str]
    signature: re.Pattern[str]
    annotation: re.Pattern[str]


_QUOTED = r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\""
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`'\"]|`(?:[^`\\]|\\.)*`|" + _QUOTED + r"|\{[^{}]*\})*\})*`"
_REGEX = r"(?:(?<=[=(,:\[!&|?{;+>])|(?<=return))[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
#: JavaScript and TypeScript, with or without mark-up.
SCRIPT = IslandGrammar(
    lexeme=re.compile(r"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<water>" + "|".join((_QUOTED, _TEMPLATE, _REGEX)) + ")", re.S),
    signature=re.compile(
        r"[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:"
        r"(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<function>[\w$]*)"
        r"|(?:const|let|var)[ \t]+(?P<arrow>[\w$]+)[^=;{}]*=\s*(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>|<)"
        r"|(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*\*?[ \t]*(?P<method>(?!(?:if|for|while|switch|catch|return|function|class|new|typeof|do|else)\b)#?[\w$]+)[ \t]*(?:<[^>\n]*>)?[ \t]*(?P<head>\()"
        r"|(?P<property>[\w$]+)[ \t]*[:=]\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]*)?=>|[\w$]+\s*=>))"
    ),
    annotation=re.compile(r"[ \t]*@[\w$.]+(?:\([^\n]*\))?[ \t]*$"),
)
GRAMMARS = dict.fromkeys((".js", ".jsx", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx"), SCRIPT)


def documented_lines(text: str, grammar: IslandGrammar) -> list[tuple[int, str, int, int]]:
    """(line of what is documented, the comment, where its first line starts, where that line starts), lines from 1.

    A comment documents the first line after it that isn't blank, if at most one blank line is between.
    """
    starts = [0]
    find = text.find
    at = find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = find("\n", at + 1)
    out: list[tuple[int, str, int, int]] = []
    run: tuple[int, int, int] | None = None  # start, end, last line of a run of // lines

    def close(start: int, end: int, last: int) -> None:
        for line in (last + 1, last + 2):
            if line >= len(starts):
                return
            stop = starts[line + 1] if line + 1 < len(starts) else len(text)
            here = text[starts[line] : stop].strip()
            if here:
                if not here.startswith(("//", "/*")):
                    out.append((line + 1, text[start:end], start, starts[line]))
                return

    for m in grammar.lexeme.finditer(text):
        kind = m.lastgroup
        if kind == "water":
            continue
        start, end = m.span()
        first = bisect_right(starts, start) - 1
        if text[starts[first] : start].strip(" \t\ufeff"):
            continue  # behind code
        if kind == "line":
            if run and run[2] + 1 == first:
                run = (run[0], end, first)
            else:
                if run:
                    close(*run)
                run = (start, end, first)
            continue
        if run:
            close(*run)
            run = None
        last = bisect_right(starts, end - 1) - 1
        rest = text[end : starts[last + 1] if last + 1 < len(starts) else len(text)]
        if not rest.strip():
            close(start, end, last)
    if run:
        close(*run)
    return out


def signature_at(text: str, at: int, grammar: IslandGrammar) -> str | None:
    """The name that the signature at ``at`` declares, on however many lines it stands; empty without one, None if there is no signature."""
    m = grammar.signature.match(text, at)
    if not m:
        return None
    if m["head"]:  # a method, if a body or a type follows its parameters
        close = balanced_body(text, m.start("head"), grammar, parentheses=True)
        if not _METHOD_GOES_ON.match(text, close):
            return None
    return next((g for g in (m["function"], m["arrow"], m["method"], m["property"]) if g), "")


def balanced_body(text: str, start: int, grammar: IslandGrammar, parentheses: bool = False) -> int:
    """End of the function that starts at ``start``: behind the brace that closes its body, or at the end of the statement;
    with ``parentheses`` behind the one that closes the first."""
    depth, at, stop = 0, start, len(text)
    hidden = ((m.start(), m.end()) for m in grammar.lexeme.finditer(text, start, stop))
    skip = next(hidden, (stop, stop))
    opened = False
    for m in _BRACKET.finditer(text, start, stop):
        at = m.start()
        while skip[1] <= at:
            skip = next(hidden, (stop, stop))
        if skip[0] <= at < skip[1]:
            continue
        c = m[0]
        if c in "([{":
            depth += 1
            opened = opened or (c == "{" and depth == 1)
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return at
            if depth == 0 and parentheses:
                return at + 1
            if depth == 0 and c == "}" and opened and not _GOES_ON.match(text, at + 1):
                return at + 1
        elif c == ";" and depth == 0:
            return at + 1
    return stop


_BRACKET = re.compile(r"[()\[\]{};]")
_METHOD_GOES_ON = re.compile(r"\s*(?:\{|:|=>)")
_GOES_ON = re.compile(r"[ \t]*(?:\)|:|=>|,|\|)")

# -- what a comment says ---------------------------------------------------------------------------------------

_DELIMITER = re.compile(r"^\s*(?:/\*+!?|//+!?|\*+/?)?\s*|\s*\*+/\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
#: Directives of tools, notices and marks that say nothing about a function.
_DIRECTIVE = re.compile(
    r"^(?:es-?lint|tslint|jshint|jslint|jscs|istanbul|c8|v8|nyc|prettier|biome|stylelint|webpack\w*|vite|sourceMappingURL|noinspection|nolint|cspell|spell-?checker|"
    r"flow|global|globals|exported|ts-(?:ignore|expect-error|nocheck|check)|type-coverage|rollup|deno-lint\S*|#?__PURE__|#?(?:end)?region|#\s*source|endregion|<reference|<amd|jsx|jest-\S+)\b", re.I
)
_NOTICE = re.compile(r"copyright|\(c\)\s*\d{4}|©|spdx|all rights reserved|licen[cs]ed? (?:under|by)|released under|\blicen[cs]e\b.{0,30}$|^\S+\s+v?\d+\.\d+(?:\.\d+)*$|^@?file(?:overview)?\b", re.I)
_TODO = re.compile(r"^(?:to-?\s?do|fix-?me|xxx+|hack|tbd|tba|wip|noch offen|à compléter|a compléter|da scrivere|da fare|à faire|por hacer|pendiente|pendente|por fazer|a fazer|offen)\b\W*(?:\([^)]*\)\W*)?(?P<sign>[:!\-]*)\s*(?P<rest>.*)$", re.I)
_TODO_SIGN = re.compile(r"^\S+?(?:\([^)]*\))?\s*[:!\-]")
_CODE_END = re.compile(r"[;{}]\s*$|^[\w$.]+\([^)]*\)[;,]?$|^[)\]}]+[;,]?$|=>\s*$")
_CODE_START = re.compile(r"^(?:const|let|var|return|if|for|while|switch|case|await|throw|new|import|export|else|try|catch|function|class)\b.*[=(){};]|^[\w$.]+\s*(?:=|\+=|-=)\s*\S+")
_REFERENCE = re.compile(r"^(?:see|cf\.?|siehe|voir|véase|ver|vedi)\b\W*(?:[\w.#/:@-]+\W*){0,3}$|^#\d+$|^\S+://\S+$|^v?\d+(?:\.\d+)+$|^[A-Z]{2,10}-\d+$", re.I)
_FILLER = frozenset(
    "a an the this that it its is are to of for and or in on with by from will shall does do function method helper helpers utility util utils callback handler getter setter constructor main "
    "internal use only private public protected description summary documentation doc docs comment note notes name see above below here n na none null void misc general default stub placeholder "
    "hilfsfunktion funktion methode fonction méthode función método funzione metodo función funktionsbeschreibung beschreibung descripción descrição descrizione auxiliaire auxiliar "
    "implementation implements implement simple simply just used component class object type performs perform executes execute called call calls".split()
)


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ing", "ies", "es", "ed", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def telling_lines(comment: str, name: str | None) -> list[str]:
    """The lines of a documentation comment that say something about what they document."""
    own = {_stem(w) for w in _CAMEL.findall(name or "")} | {_stem(name or "")}
    out, in_tag = [], False
    for raw in comment.replace("\r", "").split("\n"):
        line = _DELIMITER.sub("", raw.strip("\ufeff")).strip()
        line = _DELIMITER.sub("", line).strip() if line.endswith("*/") else line
        if line.startswith("@"):
            text = re.match(r"@(?:description|desc|summary|remarks)\s+(.+)", line)
            if not text:
                in_tag = True
                continue
            line = text[1]
        elif in_tag and re.match(r"\s*(?://|\*)?\s{3,}\S", raw):
            continue  # a tag goes on
        in_tag = False
        words = _WORD.findall(line)
        if len(words) < 3 or _DIRECTIVE.match(line) or _NOTICE.search(line) or _REFERENCE.match(line):
            continue
        todo = _TODO.match(line)
        if todo and (todo["sign"] or _TODO_SIGN.match(line) or len(_WORD.findall(todo["rest"])) <= 4):
            continue
        if _CODE_END.search(line) or _CODE_START.match(line):
            continue
        if re.match(r"^([=\-*#~_+/<>])\1{2,}.*([=\-*#~_+/<>])\2{2,}$", line):
            continue  # a divider with a heading
        parts = [p for w in words for p in _CAMEL.findall(w)]
        if all(p.lower() in _FILLER or _stem(p) in own or w.lower() in _FILLER for w in words for p in _CAMEL.findall(w)) or not parts:
            continue
        out.append(line)
    return out


# -- operators ------------------------------------------------------------------------------------------------


def documented_islands(files: DataFrame, path: str = "path", content: str = "content", bodies: bool = True) -> DataFrame:
    """``path``, ``line`` (from 1), ``doc`` and, with ``bodies``, ``name``, ``end_line``, ``code`` of what follows a
    documentation comment. Without a signature there, ``name`` and ``code`` are null.

    Files are handled one at a time where they lie. Null and empty contents and unknown endings give no rows,
    as do comments with code behind them on the line. Files delivered twice give their rows twice.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, text in zip(pdf["p"], pdf["t"]):
                grammar = GRAMMARS.get("." + p.rpartition(".")[2].lower())
                if not grammar or not text:
                    continue
                for line, doc, _, begin in documented_lines(text, grammar):
                    row = {"path": p, "line": line, "doc": doc}
                    if bodies:
                        at = begin
                        while m := grammar.annotation.match(text, at, text.find("\n", at) if "\n" in text[at:] else len(text)):
                            at = m.end() + 1
                        name = signature_at(text, at, grammar)
                        if name is not None:
                            end = balanced_body(text, at, grammar)
                            row |= {"name": name or None, "end_line": text.count("\n", 0, end) + 1, "code": text[at:end]}
                    out.append(row)
            yield pd.DataFrame(out, columns=["path", "line", "doc", *(["name", "end_line", "code"] if bodies else [])])

    rows = files.where(F.col(path).isNotNull() & (F.length(content) > 0)).select(F.col(path).alias("p"), F.col(content).alias("t"))
    return rows.mapInPandas(scan, "path string, line int, doc string" + ", name string, end_line int, code string" * bodies)


@F.pandas_udf(T.StringType())
def description(docs: pd.Series, names: pd.Series) -> pd.Series:
    """What a comment says about the function of this name, on one line; null if it says nothing."""
    return pd.Series([" ".join(telling_lines(d, n)) or None if d else None for d, n in zip(docs, names)], dtype=object)


def function_pairs(files: DataFrame) -> DataFrame:
    """``path``, ``line``, ``name``, ``end_line``, ``code``, ``summary`` of each function whose documentation says something, once."""
    rows = documented_islands(files).where("name IS NOT NULL").withColumn("summary", description("doc", "name"))
    return rows.where("summary IS NOT NULL").drop("doc").distinct()


def documented_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol_id``, ``summary``: symbols (id, path, name, line) that have a documentation comment that says something.

    The comment must end one or two lines above ``line``, and the signature that the island parser reads there must
    declare the symbol's name, if it declares one. Symbols without a file, or with a null line, drop
    out; several contents or lives of one symbol can give several summaries.
    """
    islands = documented_islands(files).select("path", "line", "doc", F.col("name").alias("declared"), F.col("code").isNotNull().alias("signed"))
    met = islands.join(symbols, ["path", "line"]).where("declared IS NULL OR name IS NULL OR declared = name OR NOT signed")
    return met.withColumn("summary", description("doc", "name")).where("summary IS NOT NULL").select(F.col("id").alias("symbol_id"), "summary").distinct()
