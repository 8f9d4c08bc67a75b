"""What a source file declares: stripped text, file-level metadata, symbols. One file at a time, where it lies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.lexer import Group, Lexer, LexError

DIALECTS = {".js": (False, True), ".mjs": (False, True), ".cjs": (False, True), ".jsx": (False, True), ".ts": (True, False), ".mts": (True, False), ".cts": (True, False), ".tsx": (True, True)}
#: Most values kept of imports, exports, call sites, symbols and decorators.
CAPS = {"imports": 50, "exports": 50, "call_sites": 100, "symbols_defined": 50, "decorators": 20}
METADATA = "imports array<string>, exports array<string>, call_sites array<string>, symbols_defined array<string>, decorators array<string>, class_name string, is_exported boolean, visibility string, node_type string"
SYMBOL = (
    "label string, name string, start_line int, end_line int, is_exported boolean, visibility string, parameters array<string>, decorators array<string>, is_async boolean, parent_class string, parent_function string, "
    "call_sites array<string>, type_annotation string, is_constant boolean, module string, names array<string>, is_wildcard boolean, extends array<string>, type_expression string"
)
#: What a type alias can stand for, by the sign or bracket that tells it.
TYPE_FORMS = (("=>", "function"), ("|", "union"), ("&", "intersection"), ("?", "conditional"))


def lexed(text: str, extension: str) -> tuple[Group | None, Lexer]:
    """The lexemes, mended where the text has faults; None if it is nested too deeply."""
    dialect = DIALECTS.get(extension, (True, True))
    lexer = Lexer(text, *dialect)
    try:
        return lexer.program(), lexer
    except LexError:
        lexer = Lexer(text, *dialect, tolerant=True)
    except RecursionError:
        return None, lexer
    try:
        return lexer.program(), lexer
    except RecursionError:
        return None, lexer


def without_comments(text: str, comments: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, stop in comments:
        if start >= at:
            out.append(text[at:start])
            at = stop
    return "".join([*out, text[at:]])


class Declarations:
    """Walks bracketed lexemes once and collects declarations, calls and names."""

    def __init__(self, text: str, program: Group) -> None:
        self.text = text
        self.symbols: list[dict] = []
        self.found: dict[str, list[str]] = {k: [] for k in CAPS}
        self.last_class: str | None = None
        self.owners: list[dict] = []  # the functions around
        self.any_export = False
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.walk(program, None)
        self.common_exports(program)

    def common_exports(self, program: Group) -> None:
        """What ``module.exports`` is given, or a part of it, counts as exported too."""
        names: set[str] = set()
        for m in re.finditer(r"(?m)^(?:module\.)?exports(?:\.[\w$]+)?\s*=\s*(?:\{(?P<several>[^{}]*)\}|(?P<one>[\w$]+)\s*;?\s*$)", self.text):
            listed = m["one"] or ",".join(x.rpartition(":")[2] for x in m["several"].split(","))
            names.update(re.findall(r"[\w$]+", listed))
        if not names:
            return
        for s in self.symbols:
            own = s["name"] if s["label"] in ("Class", "Function", "Variable") else s["parent_class"] if s["label"] in ("Method", "Field") and s["visibility"] not in ("protected",) else None
            if own in names and not s["is_exported"] and not (s["label"] == "Field" and s["visibility"] == "private"):
                s |= {"is_exported": True, "visibility": "public"}

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.breaks, at) + 1

    def word(self, group: Group, i: int) -> str:
        m = re.compile(r"[\w$#]+").match(self.text, group.at[i])
        return m[0] if m else ""

    def value(self, group: Group, i: int) -> str:
        m = re.compile(r"'((?:[^'\\\n]|\\.)*)'|\"((?:[^\"\\\n]|\\.)*)\"").match(self.text, group.at[i])
        return (m[1] if m[1] is not None else m[2]) if m else ""

    def add(self, label: str, name: str | None, start: int, end: int, exported: bool | None = False, parent: str | None = None, **more) -> dict:
        visibility = more.pop("visibility", None) or (None if exported is None else "public" if exported else "private")
        made = {"label": label, "name": name, "start_line": self.line(start), "end_line": self.line(max(start, end - 1)), "is_exported": exported, "visibility": visibility, "parent_class": parent, **more}
        if label in ("Function", "Method"):
            made |= {"call_sites": {}, "parent_function": self.owners[-1]["name"] if self.owners else None, "decorators": made.get("decorators") or []}
        self.symbols.append(made)
        return made

    def names_of(self, group: Group) -> list[str]:
        """The parameters in brackets: their names, for a pattern those in it."""
        out, fresh, angles = [], True, 0
        for j, k in enumerate(group.kinds):
            if k in ("<", ">") and not fresh:
                angles += 1 if k == "<" else -1  # of type arguments, or nearly so in a default value
            elif k == ",":
                fresh = fresh or angles <= 0
                angles = 0 if fresh else angles
            elif fresh and isinstance(k, Group):
                if k.open in "{[":
                    out += self.names_of(k)
                    fresh = False
            elif fresh and k in ("public", "private", "protected", "readonly", "override", "...", "@") and j + 1 < len(group.kinds) and (k == "..." or group.kinds[j + 1] not in (",", ":", "=", "?")):
                continue
            elif fresh and k != "NL":
                following = group.kinds[j + 1] if j + 1 < len(group.kinds) else ""
                if group.open == "{" and following == ":":
                    continue  # renamed: the name is behind the colon
                out.append(self.word(group, j))
                fresh = False
        return out

    def decorated(self, group: Group, i: int) -> list[str]:
        """Names of the decorators right before place i, the first first."""
        out, j = [], i - 1
        while j >= 1:
            if group.kinds[j] == "NL" or group.kinds[j] in ("export", "default", "abstract", "static", "async", "public", "private", "protected", "readonly", "override"):
                j -= 1
                continue
            k = j - (isinstance(group.kinds[j], Group) and group.kinds[j].open == "(")
            first = k
            while first >= 2 and group.kinds[first - 1] == ".":
                first -= 2
            if first < 1 or group.kinds[first - 1] != "@":
                break
            out.append(self.word(group, first))
            j = first - 2
        return out[::-1]

    def body_of(self, group: Group, i: int) -> tuple[Group | None, int | None]:
        """Parameters and place of the body of what is declared at i."""
        params = next((group.kinds[x] for x in range(i, len(group.kinds)) if isinstance(group.kinds[x], Group) and group.kinds[x].open == "("), None)
        body = None
        for x in range(i, len(group.kinds)):
            k = group.kinds[x]
            if isinstance(k, Group) and k.open == "{" and group.kinds[x - 1] not in (":", "|", "<", ",", "&"):
                body = x
                break
        return params, body

    def inside(self, made: dict, *groups: Group | None) -> None:
        self.owners.append(made)
        first = len(self.symbols)
        for g in groups:
            if g is not None:
                self.walk(g, None)
        self.forget(made, first)

    def forget(self, made: dict, first: int) -> None:
        """Functions declared within a function are no call sites of it."""
        self.owners.pop()
        for inner in self.symbols[first:]:
            if inner["label"] == "Function":
                made["call_sites"].pop(inner["name"], None)

    def walk(self, group: Group, parent: str | None) -> None:
        kinds, i, exported = group.kinds, 0, False
        while i < len(kinds):
            k = kinds[i]
            if isinstance(k, Group):
                before = kinds[i - 1] if i else ""
                if k.open == "(" and (before in ("id", "super", "import") or isinstance(before, Group) and before.open in "(["):
                    self.call(group, i)
                self.walk(k, parent)
            elif k == "export":
                exported = self.any_export = True
                i += 1
                if i < len(kinds) and isinstance(kinds[i], Group) and kinds[i].open == "{":
                    g = kinds[i]
                    self.found["exports"] += [self.word(g, j) for j, x in enumerate(g.kinds) if not isinstance(x, Group) and x not in (",", "as", "NL")]
                elif i + 1 < len(kinds) and kinds[i] == "default" and kinds[i + 1] == "id":
                    self.found["exports"].append(self.word(group, i + 1))
                continue
            elif k == "@" and i + 1 < len(kinds) and not isinstance(kinds[i + 1], Group):
                self.found["decorators"].append(self.word(group, i + 1))
                i += 1
            elif k == "import" and not (i + 1 < len(kinds) and (isinstance(kinds[i + 1], Group) and kinds[i + 1].open == "(" or kinds[i + 1] == ".")):
                i = self.imported(group, i)
            elif k == "class":
                i = self.classy(group, i, exported)
            elif k == "function":
                j = i + 1 + (i + 1 < len(kinds) and kinds[i + 1] == "*")
                if j < len(kinds) and not isinstance(kinds[j], Group):
                    name = self.word(group, j)
                    self.found["symbols_defined"].append(name)
                    params, body = self.body_of(group, j)
                    start = i - (i > 0 and kinds[i - 1] == "async")
                    made = self.add("Function", name, group.at[start], kinds[body].end if body is not None else group.at[j], exported, parameters=self.names_of(params) if params else [], is_async=start < i, decorators=self.decorated(group, start))
                    self.inside(made, params, kinds[body] if body is not None else None)
                    i = body if body is not None else j
            elif k in ("const", "let", "var") and i + 1 < len(kinds):
                i = self.variables(group, i, exported, parent)
            elif k == "interface" and i + 1 < len(kinds) and kinds[i + 1] == "id":
                body = next((x for x in range(i + 1, len(kinds)) if isinstance(kinds[x], Group) and kinds[x].open == "{"), None)
                stop = body if body is not None else i + 2
                bases = [self.word(group, x) for x in range(i + 3, stop) if kinds[i + 2] == "extends" and not isinstance(kinds[x], Group) and kinds[x - 1] in ("extends", ",")]
                self.add("Interface", self.word(group, i + 1), group.at[i], kinds[body].end if body is not None else group.at[i + 1], exported, extends=bases)
                i = body if body is not None else i + 1
            elif k == "type" and i + 2 < len(kinds) and kinds[i + 1] == "id" and kinds[i + 2] in ("=", "<"):
                stop = next((x for x in range(i + 2, len(kinds)) if kinds[x] in (";", "NL")), len(kinds))
                told = [x for x in kinds[i + 2 : stop] if not isinstance(x, Group)]
                told = told[told.index("=") + 1 :] if "=" in told else told
                last = kinds[stop - 1]
                form = next((f for sign, f in TYPE_FORMS if sign in told), None) or ("object" if isinstance(last, Group) and last.open == "{" else "reference")
                self.add("TypeAlias", self.word(group, i + 1), group.at[i], last.end if isinstance(last, Group) else group.at[stop - 1] + 1, exported, type_expression=form)
                i = stop - 1
            if k not in ("async", "default", "abstract", "declare", "export"):
                exported = False
            i += 1

    def call(self, group: Group, i: int) -> None:
        """The text before the bracket: names, dots and what is between them."""
        j = i - 1
        while j > 0 and (group.kinds[j] in (".", "?.") or group.kinds[j - 1] in (".", "?.")):
            j -= 1
        if j > 0 and group.kinds[j - 1] in ("function", "class", "*"):
            return
        if isinstance(group.kinds[j], Group) or group.kinds[j] in ("tpl", "str", "re"):  # called on a value: the last name tells
            if group.kinds[i - 1] != "id":
                return
            j = i - 1
        after = group.kinds[i + 1] if i + 1 < len(group.kinds) else ""
        if isinstance(after, Group) and after.open == "{" and group.open == "{" and j == i - 1:
            return  # a method
        called = re.sub(r"\s+|\?", "", self.text[group.at[j] : group.at[i]])
        self.found["call_sites"].append(called)
        for owner in self.owners:
            owner["call_sites"][called] = None

    def imported(self, group: Group, i: int) -> int:
        names, j = [], i + 1
        while j < len(group.kinds) and group.kinds[j] not in ("str", ";", "NL"):
            k = group.kinds[j]
            if isinstance(k, Group):
                names += [self.word(k, n) for n, x in enumerate(k.kinds) if not isinstance(x, Group) and x not in (",", "as", "NL", "type")]
            elif k == "*":
                names.append("*")
            elif k == "id" and group.kinds[j - 1] != "as":
                names.append(self.word(group, j))
            j += 1
        if j < len(group.kinds) and group.kinds[j] == "str":
            module = self.value(group, j)
            self.found["imports"].append(module)
            self.add("Import", None, group.at[i], group.at[j] + len(module) + 2, None, module=module, names=names, is_wildcard="*" in names)
        return j

    def classy(self, group: Group, i: int, exported: bool) -> int:
        kinds = group.kinds
        name = self.word(group, i + 1) if i + 1 < len(kinds) and kinds[i + 1] not in ("extends",) and not isinstance(kinds[i + 1], Group) else None
        body = next((x for x in range(i + 1, len(kinds)) if isinstance(kinds[x], Group) and kinds[x].open == "{"), None)
        if body is None:
            return i
        bases = [self.word(group, x + 1) for x in range(i + 1, body - 1) if kinds[x] in ("extends", "implements")]
        self.last_class = name or self.last_class
        self.add("Class", name, group.at[i], kinds[body].end, exported, extends=bases or None, decorators=self.decorated(group, i))
        inner, j, first = kinds[body], 0, 0
        member: int | None = None
        while j < len(inner.kinds):
            k = inner.kinds[j]
            if k in (";", "NL"):
                first, member = j + 1, None
            elif isinstance(k, Group) and k.open == "(" and member is None and j > first and inner.kinds[j - 1] not in ("=", ":") and "@" not in inner.kinds[max(first, j - 2) : j]:
                stop = next((x for x in range(j, len(inner.kinds)) if inner.kinds[x] in (";", "NL") or isinstance(inner.kinds[x], Group) and inner.kinds[x].open == "{" and inner.kinds[x - 1] not in (":", "|", "<", ",", "&")), None)
                if stop is not None and isinstance(inner.kinds[stop], Group):
                    words = [x for x in inner.kinds[first:j] if not isinstance(x, Group)]
                    hidden = next((x for x in ("private", "protected") if x in words), None)
                    decorators = self.decorated(inner, j - 1)
                    start = next((x for x in range(first, j) if not isinstance(inner.kinds[x], Group) and inner.kinds[x] not in ("@", ".") and inner.kinds[x - 1] not in ("@", ".")), first) if decorators else first
                    made = self.add("Method", self.word(inner, j - 1), inner.at[start], inner.kinds[stop].end, exported and not hidden, name, visibility=hidden, parameters=self.names_of(k), is_async="async" in words, decorators=decorators)
                    self.inside(made, k, inner.kinds[stop])
                    j, first, member = stop, stop + 1, None
                else:
                    member = j
            elif k in ("=", ":") and member is None and j > first:
                words = [x for x in inner.kinds[first:j] if not isinstance(x, Group)]
                hidden = next((x for x in ("private", "protected") if x in words), None)
                self.add("Field", self.word(inner, j - 1), inner.at[first], inner.at[j], exported and not hidden, name, visibility=hidden)
                member = j
            elif isinstance(k, Group):
                self.walk(k, name)
            j += 1
        return body

    def variables(self, group: Group, i: int, exported: bool, parent: str | None) -> int:
        kinds = group.kinds
        if kinds[i + 1] == "enum":
            return i
        stop = next((x for x in range(i + 1, len(kinds)) if kinds[x] in (";", "NL")), len(kinds))
        equals = next((x for x in range(i + 2, stop) if kinds[x] == "="), None)
        if equals is not None and kinds[equals + 1 : equals + 2] == ["require"] and equals + 2 < stop and isinstance(kinds[equals + 2], Group) and kinds[equals + 2].kinds[:1] == ["str"]:
            module = self.value(kinds[equals + 2], 0)
            self.found["imports"].append(module)
            self.add("Import", None, group.at[i], kinds[equals + 2].end, None, module=module, names=self.names_of(kinds[i + 1]) if isinstance(kinds[i + 1], Group) else [self.word(group, i + 1)], is_wildcard=False)
            return equals + 2
        if isinstance(kinds[i + 1], Group):
            return i
        at = i + 1
        while at < stop:  # each declarator
            comma = next((x for x in range(at, stop) if kinds[x] == ","), stop)
            if not isinstance(kinds[at], Group):
                self.declarator(group, i if at == i + 1 else at, at, comma, exported, parent, kinds[i])
            else:
                self.walk_range(group, at, comma)
            at = comma + 1
        return stop - 1

    def walk_range(self, group: Group, start: int, stop: int) -> None:
        """What stands between two places, as an expression."""
        self.walk(Group(group.open if group.open != "{" else "(", group.start, group.kinds[start:stop], group.at[start:stop]), None)

    def declarator(self, group: Group, begin: int, at: int, stop: int, exported: bool, parent: str | None, word: str) -> None:
        kinds, name = group.kinds, self.word(group, at)
        end = kinds[stop - 1].end if isinstance(kinds[stop - 1], Group) else group.at[stop - 1] + 1
        equals = next((x for x in range(at + 1, stop) if kinds[x] == "="), None)
        if word == "var":
            self.found["symbols_defined"].append(name)
        if equals is None:
            self.add("Variable", name, group.at[begin], end, exported, is_constant=word == "const")
            return
        after = kinds[equals + 1 : stop]
        is_async = after[:1] == ["async"]
        head = after[1:] if is_async else after
        arrow = "=>" in head[:12] and (isinstance(head[0], Group) or head[0] in ("id", "<"))
        if head and (arrow or head[0] == "function"):
            arrow_at = head.index("=>") if arrow else 0
            params = next((x for x in head if isinstance(x, Group) and x.open == "("), None)
            names = [self.word(group, equals + 1 + is_async)] if arrow and head[0] == "id" else self.names_of(params) if params else []
            made = self.add("Function", name, group.at[begin], end, exported, parameters=names, is_async=is_async)
            self.found["symbols_defined"].append(name)
            self.owners.append(made)
            first = len(self.symbols)
            self.walk_range(group, equals + 1 + is_async + (arrow_at + 1 if arrow else 1), stop)
            self.forget(made, first)
            return
        self.add("Variable", name, group.at[begin], end, exported, is_constant=word == "const")
        self.walk_range(group, equals + 1, stop)

    def metadata(self) -> dict:
        out: dict = {k: list(dict.fromkeys(v for v in self.found[k] if v))[:cap] for k, cap in CAPS.items()}
        return out | {"class_name": self.last_class, "is_exported": self.any_export, "visibility": "public" if self.any_export else "private", "node_type": "program"}


def _scan(files: DataFrame, schema: str, rows_of) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", schema)]
        for pdf in batches:
            out = [[row.get(n) for n in names] if isinstance(row, dict) else row for p, t in zip(pdf["path"], pdf["content"]) for row in rows_of(p, t or "")]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return files.where("path IS NOT NULL").select("path", "content").mapInPandas(scan, schema)


def _extension(path: str) -> str:
    return "." + path.rpartition(".")[2].lower()


def strip_comments(files: DataFrame) -> DataFrame:
    """path, stripped_text, comments (number), status: ok, or partial if the text has faults (those up to its end are mended)."""

    def rows(path: str, text: str):
        program, lexer = lexed(text, _extension(path))
        return [(path, without_comments(text, lexer.comments), len(lexer.comments), "partial" if program is None or lexer.faults else "ok")]

    return _scan(files, "path string, stripped_text string, comments int, status string", rows)


def file_metadata(files: DataFrame) -> DataFrame:
    """path and the file-level metadata; what cannot be lexed has empty lists and is private."""

    def rows(path: str, text: str):
        program, _ = lexed(text, _extension(path))
        m = Declarations(text, program).metadata() if program else {k: [] for k in CAPS} | {"class_name": None, "is_exported": False, "visibility": "private", "node_type": None}
        return [{"path": path, **m}]

    return _scan(files, "path string, " + METADATA, rows)


def symbols(files: DataFrame) -> DataFrame:
    """path and a row for each class, method, field, function, variable, import, interface and type alias, by ``ordinal``.

    Each with the properties of its label; call sites are those of the function and of what it holds, once, in
    order. A name that is bound to a function is a function, one bound to ``require`` an import.
    """

    def rows(path: str, text: str):
        program, _ = lexed(text, _extension(path))
        if program is None:
            return []
        return [{"path": path, "ordinal": n, **s, "call_sites": list(s["call_sites"]) if "call_sites" in s else None} for n, s in enumerate(Declarations(text, program).symbols)]

    return _scan(files, "path string, ordinal int, " + SYMBOL, rows)


def comments(files: DataFrame) -> DataFrame:
    """path, start_line, end_line, text of each comment."""

    def rows(path: str, text: str):
        _, lexer = lexed(text, _extension(path))
        return [(path, text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1, text[a:b]) for a, b in lexer.comments]

    return _scan(files, "path string, start_line int, end_line int, text string", rows)


def detailed_nodes(files: DataFrame) -> DataFrame:
    """The symbols as graph nodes with the properties of their label, one for each id: the first of its file."""
    from skein.functions.ids import node_id

    found = symbols(files)
    name = F.when(F.col("label") == "Import", F.col("module")).otherwise(F.coalesce("name", F.lit("anonymous")))
    rows = found.withColumns({"id": node_id(F.col("path"), F.col("label"), name, F.col("start_line")), "name": F.when(F.col("label") != "Import", name)})
    own = [c for c in rows.columns if c not in ("id", "path", "ordinal")]
    first = rows.groupBy("id", F.col("path").alias("file_path")).agg(F.min_by(F.struct(*own), "ordinal").alias("s"))
    return first.select("id", "file_path", "s.*")


def extracted_nodes(files: DataFrame) -> DataFrame:
    """The symbols as graph nodes: id, label, file_path, name, start_line, end_line, is_exported; distinct."""
    return detailed_nodes(files).select("id", "label", "file_path", "name", "start_line", "end_line", "is_exported").distinct()
