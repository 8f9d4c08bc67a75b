"""Source files that do not parse in the language that their path promises.

Each file is brought to bracketed lexemes and parsed by the error-correcting parser of ``chart``, which finds the
least number of edits, however many there are. A file that needs an edit is invalid. Quotes,
comment signs and brackets that are missing or too many are edits too; they are made first, in the lexemes, then
every piece that does not parse is repaired at least cost, and the costs are summed. Where the edits lie tells
truncation, merge conflicts and wrong languages apart from other damage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.lexer import Group, Lexer, LexError
from skein.llm.chart import MOST_KEPT, SPLIT, Parser, cuts, pieces

#: Dialect of each ending: typed, markup.
DIALECTS = {".js": (False, False), ".mjs": (False, False), ".cjs": (False, False), ".jsx": (False, True), ".ts": (True, False), ".mts": (True, False), ".cts": (True, False), ".tsx": (True, True)}
_CONFLICT = re.compile(r"(?m)^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$")
#: Files that are diagnosed together.
AT_ONCE = 1000
_DECLARES = frozenset(("import", "export", "const", "let", "var", "function", "class"))
_PARSERS: dict[tuple[bool, bool], Parser] = {}


def parser(typed: bool, markup: bool) -> Parser:
    """The worker's parser for a dialect; it forgets what it knows when that grows beyond bounds."""
    out = _PARSERS.get((typed, markup))
    if out is None:
        out = _PARSERS[typed, markup] = Parser(typed, markup)
    if len(out.known) + len(out.numbers) > MOST_KEPT:
        out.clear()
    return out


def edits(chart: Parser, group: Group, role: str) -> tuple[int, list[int]]:
    """Cost of making a group's content fit its role, and where in the text the first edit of each faulty piece lies."""
    kinds = tuple(chart.intern(k) if isinstance(k, Group) else k for k in group.kinds)
    spans = cuts(kinds) if role in SPLIT and ";" in kinds else [[range(len(kinds))]]
    total, places = 0, []
    for own in spans:
        where = [k for r in own for k in r]
        part = tuple(kinds[k] for k in where)
        if chart.piece(part, role):
            continue
        cost, first = chart.repair(part, role)
        total += cost
        at = group.at[where[first]] if first < len(where) else group.at[where[-1]] + 1 if where else group.start
        inner = group.kinds[where[first]] if first < len(where) else None
        if isinstance(inner, Group) and inner.open in "([{":
            # the edit may lie within: look where the cheapest of its roles needs one
            roles = [t[1:-1] for t in chart.look(kinds[where[first]]) if len(t) > 2]
            best = min(roles, key=lambda r: (chart.cost(kinds[where[first]], r, cost), r), default=None)
            if best is not None and 0 < chart.cost(kinds[where[first]], best, cost) <= cost:
                at = (edits(chart, inner, best)[1] or [at])[0]
        places.append(at)
    return total, places


def diagnose(text: str | None, extension: str, most: int | None = None) -> tuple[int, int, str, str] | None:
    """(edits, offset of the first, cause, detail) of an invalid text; None if it needs no edit.

    All edits count; if ``most`` is given, ``most`` + 1 stands for all costs above it, and nothing else changes. Causes
    come from where the edits lie: within conflict markers; all at the end of the text (truncated); none in another
    dialect, nothing that parses here, or a lone value (mismatch); other.
    """
    return diagnose_all([(text, extension)], most)[0]


def diagnose_all(texts: list[tuple[str | None, str]], most: int | None = None) -> list[tuple[int, int, str, str] | None]:
    """``diagnose`` for many texts; what is faulty in them is repaired together."""
    out: list[tuple[int, int, str, str] | None] = [None] * len(texts)
    bad: dict[tuple[bool, bool], list[tuple[int, Group, list]]] = {}
    for k, (text, extension) in enumerate(texts):
        dialect = DIALECTS.get(extension)
        if not text or dialect is None:
            continue
        chart = parser(*dialect)
        faults: list[tuple[int, str]] = []
        try:
            program = Lexer(text, *dialect).program()
            if chart.parses(chart.intern(program), "Program"):
                continue
        except LexError:  # once more, with an edit for each fault
            lexer = Lexer(text, *dialect, tolerant=True)
            program, faults = lexer.program(), lexer.faults
        bad.setdefault(dialect, []).append((k, program, faults))
    for dialect, own in bad.items():
        chart = parser(*dialect)
        chart.prepare([p for _, g, _ in own for p in pieces(chart.content[chart.intern(g)][1], "Program") if not chart.piece(p, "Program")])
        for k, program, faults in own:
            out[k] = _verdict(chart, dialect, texts[k][0], program, faults, most)
    return out


def _verdict(chart: Parser, dialect: tuple[bool, bool], text: str, program: Group, faults: list[tuple[int, str]], most: int | None) -> tuple[int, int, str, str]:
    cost, places = edits(chart, program, "Program")
    cost += len(faults)
    if most is not None:
        cost = min(cost, most + 1)
    places = sorted([at for at, _ in faults] + places)
    end = len(text.rstrip())
    marks = [m.span() for m in _CONFLICT.finditer(text)]
    if marks and any(marks[0][0] <= at <= marks[-1][1] for at in places):
        cause = "conflict"
    elif len(program.kinds) == 1 and not faults and isinstance(program.kinds[0], Group) and places[0] == program.at[0]:
        cause = "mismatch"  # one value, no program
    elif all(at >= end - 1 for at in places):
        cause = "truncated"
    elif _foreign(chart, program) or any(_valid(text, other) for other in sorted(set(DIALECTS.values()) - {dialect}) if other[0] >= dialect[0] or other[1] >= dialect[1]):
        cause = "mismatch"
    else:
        cause = "other"
    return cost, places[0], cause, faults[0][1] if faults else "syntax"


def _foreign(chart: Parser, program: Group) -> bool:
    """Whether nothing of a program parses and nothing in it begins as a declaration does."""
    kinds = tuple(chart.intern(k) if isinstance(k, Group) else k for k in program.kinds)
    return not _DECLARES.intersection(k for k in kinds if isinstance(k, str)) and not any(part and chart.piece(part, "Program") for part in pieces(kinds, "Program"))


def _valid(text: str, dialect: tuple[bool, bool]) -> bool:
    try:
        chart = parser(*dialect)
        return chart.parses(chart.intern(Lexer(text, *dialect).program()), "Program")
    except LexError:
        return False


def syntax_faults(files: DataFrame, path: str = "path", extension: str = "extension", content: str = "content", most: int | None = None) -> DataFrame:
    """``path``, ``cost``, ``line`` (of the first edit), ``cause``, ``detail`` of every file whose content is not valid for its ending, once.

    Costs are counted in full; if ``most`` is given, ``most`` + 1 stands for all that need more.

    Null and empty contents are valid, endings of other languages are not judged. A null ending is taken from
    the path, letter case does not matter. Files are read whole, where they lie.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys

        sys.setrecursionlimit(10**7)  # nested groups are followed in frames on the heap, as deep as they go
        for pdf in batches:
            rows = []
            texts = [(t, (e or "." + (p or "").rpartition(".")[2]).lower()) for p, e, t in zip(pdf["p"], pdf["e"], pdf["t"])]
            for k in range(0, len(texts), AT_ONCE):
                for p, (t, _), found in zip(pdf["p"][k : k + AT_ONCE], texts[k : k + AT_ONCE], diagnose_all(texts[k : k + AT_ONCE], most)):
                    if found:
                        rows.append((p, found[0], t.count("\n", 0, found[1]) + 1, found[2], found[3]))
            yield pd.DataFrame(rows, columns=["path", "cost", "line", "cause", "detail"])

    rows = files.where(F.length(content) > 0).select(F.col(path).alias("p"), F.col(extension).alias("e"), F.col(content).alias("t"))
    return rows.mapInPandas(scan, "path string, cost int, line int, cause string, detail string").distinct()


def fault_rates(files: DataFrame, faults: DataFrame) -> DataFrame:
    """Files, invalid files and their rate by repository and the language that the ending promises."""
    language = F.when(F.lower("extension").isin(".ts", ".mts", ".cts", ".tsx"), "typescript").otherwise("javascript")
    every = files.select("repo", "path", language.alias("language")).distinct()
    bad = faults.groupBy("path").agg(F.first("cause").alias("cause"))
    rows = every.join(bad, "path", "left").groupBy("repo", "language").agg(F.count("*").alias("files"), F.count("cause").alias("invalid"), *[F.count_if(F.col("cause") == c).alias(c) for c in ("truncated", "conflict", "mismatch", "other")])
    return rows.withColumn("rate", F.col("invalid").cast(T.DoubleType()) / F.col("files"))
