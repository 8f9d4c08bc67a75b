"""Where source files come from: written by hand, or generated, minified, copied from elsewhere, or data.

Copies are found by Merkle hashes, bottom-up: top-level blocks of a file, the file, its directory, and so on to
the root of the repository. A hash that occurs in repositories of different owners marks everything below it as
a third-party copy. Hashes are of code only (no comments, white space or names of files), and those of
directories add up their children's, so a hot directory is combined before it is shuffled. A directory is one of
its repository: paths may be relative to it. Everything else is told by rules on headers (who says the file was made by a tool, or under whose licence) and on layout (how
regular its lines are, how short its names, how much of it is literals).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import hot_among, skew_join
from skein.session import materialize

#: Characters of code below which a block, a file and a directory are no evidence of copying.
LEAST_BLOCK, LEAST_FILE, LEAST_DIRECTORY = 60, 120, 240
#: Part of a file's code in shared blocks from which the file is a copy.
COPIED_SHARE = 0.5
#: Levels of directories that are hashed in one plan; a deeper tree takes more plans, one after the other.
BAND = 6

_COMMENT = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)", re.S)
_LITERAL = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|(?<![\w$.])-?(?:0x[0-9a-fA-F]+|\d[\d.eE]*)")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"-?\b\d[\w.]*")
_STRING = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`[^`\n]*`")
_ACTIVE = re.compile(r"\b(?:function|class|return|import|require|if|for|while|switch|throw|await|new)\b|=>|(?<![=!<>])=(?!=)[^=]*\([^)]*\)\s*\{")
_DECLARED = re.compile(r"\b(?:interface|enum)\s+\w|\btype\s+\w+\s*=")
_STATEMENT = re.compile(r"(?m)^(?=(?:export\s+)?(?:default\s+)?(?:const|let|var|module\.exports)\b)")
_JSON = re.compile(r"\s*[\[{]\s*(?:\"(?:[^\"\\]|\\.)*\"\s*[:,\]]|[\[{\]}]|-?\d)")
#: What tools write at the top of the files they make, by the language of the notice.
GENERATED = re.compile(
    r"^(?:@(?:auto-?)?generated\b|auto-?\s?generated\b|(?:code|file|source|module|types?|bindings)?\s*(?:automatically |auto-?\s?)?(?:generated|produced|emitted) (?:by|on|from|with|using|automatically)\b"
    r"|this (?:file|code|module|source) (?:is|was|has been) (?:(?:automatically |auto-?\s?)?(?:generated|produced|emitted)|automatically (?:created|built|written))\b"
    r"|output of [\w./-]+\.?$|(?:please )?(?:do not|don't|never) (?:edit|modify|change|touch)(?:\s+(?:this|the|file|it|by|hand|manually|directly|here))*\s*[.!]*$|.{0,80}\b(?:do not edit|do not modify(?: by hand)?|manual changes will be lost|changes will be overwritten)[.!]*$|source: \S+\.\w+$"
    r"|diese datei wurde .{0,60}(?:erzeugt|generiert|erstellt)|(?:bitte )?nicht (?:bearbeiten|ändern|verändern)\b|ce fichier (?:a été|est) .{0,20}(?:généré|produit|créé)|ne pas (?:modifier|éditer)\b|fichier généré"
    r"|(?:este (?:archivo|fichero|arquivo|ficheiro)|archivo|arquivo) .{0,30}(?:generado|gerado)|no (?:editar|modificar)\b|não (?:editar|modificar)\b|questo file .{0,30}generato|file generato|non (?:modificare|toccare)\b)",
    re.I,
)
FOREIGN = re.compile(
    r"^(?:taken|copied|adapted|vendored|imported|extracted|backported|borrowed) from\b|^(?:vendored|third[- ]party)\b|^@license\b|^@preserve\b|^released under\b|^licensed under\b|^permission is hereby\b|\bthe [\w.-]+ (?:contributors|authors)\b|\band other authors\b"
    r"|^[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\s*(?:\||-|\(c\)|$)|^(?:bundled|minified) (?:from|by)\b",
    re.I,
)
_WRAPPER = re.compile(r"typeof globalThis === ?['\"]object['\"] \? globalThis : this|\(function ?\((?:root|global|window), ?(?:factory|undefined)\)|typeof define === ?['\"]function['\"] && define\.amd|__webpack_(?:require|modules)__|parcelRequire|System\.register\(")
_MARK = re.compile(r"^\s*(?:/\*+!?|//+!?|#+!?|<!--|\*+/?|--)?\s*|\s*(?:\*+/|-->)\s*$")


def without_comments(text: str) -> str:
    return _COMMENT.sub(lambda m: " " if m["comment"] else m[0], text)


def head_lines(text: str) -> list[str]:
    """The lines of the comments before the first line of code, however many."""
    out, block = [], False
    for line in text.lstrip("\ufeff").split("\n"):
        stripped = line.strip()
        if not stripped:
            continue
        if not block and not stripped.startswith(("//", "/*", "#!", "<!--", "--")):
            break
        if stripped.startswith("/*"):
            block = True
        out.append(_MARK.sub("", _MARK.sub("", stripped)).strip())
        if "*/" in stripped:
            block = False
            if stripped.split("*/", 1)[1].strip():
                break
    return out


def line_shape(line: str) -> str:
    return _IDENTIFIER.sub("a", _NUMBER.sub("9", _STRING.sub("s", line)))


def regularity(code: str) -> tuple[float, int]:
    """Part of the lines whose shape is one of the six most frequent and occurs five times or more; and the lines."""
    lines = [line_shape(x) for x in map(str.strip, code.split("\n")) if len(x) > 3 and not x.startswith("import ")]
    return (sum(n for _, n in Counter(lines).most_common(6) if n >= 5) / len(lines), len(lines)) if lines else (0.0, 0)


def signs(text: str) -> list[str]:
    """What speaks against a file having been written by hand for this repository: generated, minified, foreign, data."""
    out = set()
    head = head_lines(text)
    if any(GENERATED.search(x) for x in head):
        out.add("generated")
    if any(FOREIGN.search(x) for x in head):
        out.add("foreign")
    body = text.lstrip("\ufeff")
    code = without_comments(body)
    if _WRAPPER.search(code):
        out.add("foreign")
    solid = re.sub(r"\s+", "", code)
    if len(solid) < 40:
        return sorted(out)
    if _JSON.match(code):
        try:
            json.loads(code)
            out.add("data")
        except ValueError:
            if re.search(r"\"\s*:", code) and not _ACTIVE.search(_STRING.sub("", code)):
                out.add("data")
    literals = sum(len(m) for m in _LITERAL.findall(code))
    bare = _LITERAL.sub("", code)
    if not _ACTIVE.search(bare) and not _DECLARED.search(bare) and len(solid) >= 300:
        count, longest = len(_LITERAL.findall(code)), max(map(len, _LITERAL.findall(code) or [""]))
        largest = max(len(re.sub(r"\s+", "", part)) for part in _STATEMENT.split(code))
        if literals / len(solid) >= 0.35 and (count >= 40 or longest >= 300) and largest >= 0.75 * len(solid):
            out.add("data")
    share, lines = regularity(code)
    if share >= 0.8 and lines >= 12:
        out.add("generated" if _ACTIVE.search(bare) else "data")
    names = _IDENTIFIER.findall(_STRING.sub("", code))
    short = sum(len(x) <= 2 for x in names) / len(names) if names else 0
    rows = [x for x in code.split("\n") if x.strip()]
    width = len(code.strip()) / max(1, len(rows))
    if len(solid) >= 200 and width >= 120 and short >= 0.3 and len(names) >= 30 and (len(code.strip()) - len(solid)) / len(code.strip()) < 0.15:
        out.add("minified")
    elif re.search(r"(?m)^//[#@] sourceMappingURL=", body) and short >= 0.25:
        out.add("minified")
    return sorted(out)


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def code_blocks(text: str) -> tuple[int, int, list[dict[str, int]]]:
    """Hash and size of the file's code, and of its blocks between blank lines (imports and the like left out)."""
    code = without_comments(text.lstrip("\ufeff")).replace("\r", "")
    solid = re.sub(r"\s+", "", code)
    blocks = []
    for block in re.split(r"\n[ \t]*\n", code):
        plain = re.sub(r"\s+", "", block)
        if len(plain) >= LEAST_BLOCK and block.strip().count("\n") >= 2 and not plain.startswith(("import", "const{")):
            blocks.append({"h": hashed(plain), "w": len(plain)})
    return hashed(solid), len(solid), blocks


def file_origins(files: DataFrame, path: str = "path", repo: str = "repo", content: str = "content") -> DataFrame:
    """``path``, ``reasons`` (array) of every file that isn't hand-written here; each path once.

    Reasons: generated, minified, data, foreign (its header or wrapper says so), copied (its blocks, its code or
    a directory above it occur under another owner). Null and empty contents have no reasons of their own, but
    lie below a copied directory like others. A null path takes no part, a null repository is one of no owner,
    which never counts as another. Paths with several contents get the reasons of all.
    """

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, r, t in zip(pdf["p"], pdf["r"], pdf["t"]):
                leaf, weight, blocks = code_blocks(t or "")
                rows.append((p, r, leaf, weight, signs(t) if t else [], blocks))
            yield pd.DataFrame(rows, columns=["path", "repo", "leaf", "weight", "signs", "blocks"])

    known = files.where(F.col(path).isNotNull()).select(F.col(path).alias("p"), F.col(repo).alias("r"), F.col(content).alias("t"))
    nodes = known.mapInPandas(features, "path string, repo string, leaf bigint, weight int, signs array<string>, blocks array<struct<h:bigint, w:int>>")
    nodes = nodes.dropDuplicates(["repo", "path", "leaf"]).withColumns({"owner": F.split_part("repo", F.lit("/"), F.lit(1)), "repo": F.coalesce("repo", F.lit(""))})
    nodes = materialize(nodes, "origins")

    blocks = nodes.select("repo", "path", "leaf", "owner", "weight", F.explode("blocks").alias("b")).select("repo", "path", "leaf", "owner", "weight", "b.h", "b.w")
    common = in_several(blocks, "h").groupBy("repo", "path", "leaf").agg(F.sum("w").alias("common"), F.first("weight").alias("weight"))
    by_block = common.where(F.col("common") >= COPIED_SHARE * F.col("weight")).select("path")
    by_file = in_several(nodes.where(F.col("weight") >= LEAST_FILE), "leaf").select("path")
    trees = directories(nodes)
    by_tree = nodes.select("path").limit(0) if trees is None else below(nodes, in_several(trees, "hash"))
    copied = by_block.union(by_file).union(by_tree).select("path", F.lit("copied").alias("reason"))
    told = nodes.select("path", F.explode("signs").alias("reason"))
    return told.union(copied).groupBy("path").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def in_several(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs under two owners or more. Keys are counted once, for the owners and for the hot ones."""
    stats = materialize(rows.groupBy(key).agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.count("*").alias("count")), "shared")
    return skew_join(rows, stats.where("a <> b").select(key), [key], "left_semi", hot=hot_among(stats, [key]))


def directories(nodes: DataFrame) -> DataFrame | None:
    """Merkle hashes of all directories with enough code: repo, owner, dir, hash; from the deepest level up.

    A level needs the one below it, so there is a shuffle for each, of one row for each directory. BAND levels
    make one plan; what it leaves for the levels above is written, so plans stay short however deep the tree.
    """
    deepest = nodes.agg(F.max(F.size(F.split("path", "/")))).first()[0]
    if deepest is None:
        return None
    parent = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    depth = F.size(F.split("path", "/"))
    files = nodes.select("repo", "owner", parent("path").alias("dir"), depth.alias("depth"), "leaf", F.col("weight").cast("bigint").alias("weight"), F.lit(1).cast("bigint").alias("n"))
    key = ["repo", "owner", "dir"]
    files = files.groupBy(*key, "depth").agg(F.sum(F.xxhash64("leaf").cast("decimal(20,0)")).cast("decimal(38,0)").alias("sum"), F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    files = materialize(files, "folders")
    level, every, fresh = None, None, []
    for at in range(deepest, 1, -1):
        here = files.where(F.col("depth") == at).drop("depth")
        here = here if level is None else here.unionByName(level)
        here = here.groupBy(*key).agg(F.xxhash64(F.sum("sum"), F.sum("n")).alias("hash"), F.sum("weight").alias("weight"), F.sum("n").alias("n"))
        fresh.append(here.withColumn("depth", F.lit(at)))
        if len(fresh) == BAND or at == 2:
            band = materialize(reduce(DataFrame.unionByName, fresh), "levels")
            here, fresh = band.where(F.col("depth") == at).drop("depth"), []
            kept = band.where(f"weight >= {LEAST_DIRECTORY} AND n >= 2").select(*key, "hash")
            every = kept if every is None else every.unionByName(kept)
        level = here.select("repo", "owner", parent("dir").alias("dir"), F.xxhash64("hash").cast("decimal(38,0)").alias("sum"), "weight", "n")
    return every


def below(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """Paths of the files at any depth below the marked directories."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = nodes.where(F.size(parts) > 1).select("path", "repo", F.explode(above).alias("dir"))
    return rows.join(marked.select("repo", "dir").distinct(), ["repo", "dir"], "left_semi").select("path")
