"""Evaluation texts that leak into training text.

Words of both sides are brought to a template: numbers, code names and units of measure become typed
placeholders. Windows of ten are hashed and joined, of the template words as they are written, of those in lower
case (where a code name may be a plain word) and of the plain words in lower case; a match gives an alignment (the
distance between the positions in both texts), which is then checked word by word. Two kinds come out:

* ``literal``: at least ``least`` consecutive words of which at most one in any ``least`` is replaced. Such a
  stretch holds ten equal words in a row on one side of the replaced word, and windows of plain words depend on
  nothing else, so the join finds all of them;
* ``reparameterised``: at least ``least`` consecutive words that agree as templates but not as words, and
  whose slots are filled consistently: equal fillings of the item have equal fillings in the document, and
  different ones different ones.

Sentences that ``shared`` or more items have in common are instructions and count for neither kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import materialize

WINDOW = 10
#: The item windows are broadcast up to this many rows (about 60 bytes each), beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000

UNITS = frozenset("ms s sec secs second seconds minute minutes min hour hours day days kb mb gb tb bytes byte px percent units km cm mm kg".split())
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--|-->|&(?:[a-z]{2,8}|#\d{1,6});|https?://\S+")
_WORD = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
_NUMBERED = re.compile(r"^[ \t]*(\d{1,7})(?:[ \t]*[|:.)\]]|\t|[ ]{2,})[ \t]?")
_MAY_BE_NUMBERED = re.compile(r"^[ \t]*\d{1,7}(?:[ \t]*[|:.)\]]|\t|[ ]{2,})[^\n]*\n[ \t]*\d", re.M)
_SENTENCE = re.compile(r"(?<=[.?!;:])\s+|\n+")
_NAME = re.compile(r"[a-z0-9][A-Z]|[A-Za-z]\d|\d[A-Za-z]|_")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def without_line_numbers(text: str) -> str:
    """Drops numbers in front of lines if three or more lines on end are numbered upwards by one."""
    lines = text.split("\n")
    found = [_NUMBERED.match(x) for x in lines]
    i = 0
    while i < len(lines):
        j = i
        while j + 1 < len(lines) and found[j] and found[j + 1] and int(found[j + 1][1]) == int(found[j][1]) + 1:
            j += 1
        if j - i >= 2:
            for n in range(i, j + 1):
                lines[n] = lines[n][found[n].end() :]
        i = j + 1
    return "\n".join(lines)


def templates(raw: list[str], plain: list[str]) -> list[str]:
    """Words with placeholders; what is a code name is told by ``raw``."""
    typed: list[str] = []
    for i, (r, w) in enumerate(zip(raw, plain)):
        if w.isdigit():
            typed.append("0number")
        elif _NAME.search(r):
            typed.append("0name")
        elif w in UNITS and i and typed[-1] == "0number":
            typed.append("0unit")
        else:
            typed.append(w)
    return typed


def words(text: str | None) -> tuple[list[str], list[str]]:
    """Words (without letter case, accents and mark-up) and their templates."""
    raw = raw_words(text)
    plain = [w.casefold() for w in raw]
    return plain, templates(raw, plain)


class Coder:
    """Hashes of words: plain, as a template as written, as a template in lower case; what it has seen it keeps, within bounds."""

    MOST = 300_000
    NUMBER, UNIT = (xxhash.xxh64_intdigest(x) for x in ("0number", "0unit"))

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int, int]] = {}

    def code(self, raw: str) -> tuple[int, int, int, int]:
        """The three hashes, and 1 for a number, 2 for a unit (which is one behind a number)."""
        found = self.known.get(raw)
        if found is None:
            plain = raw.casefold()
            own = xxhash.xxh64_intdigest(plain)
            number = self.NUMBER if plain.isdigit() else None
            typed = [number or (xxhash.xxh64_intdigest("0name") if _NAME.search(w) else own) for w in (raw, plain)]
            found = self.known[raw] = (own, *typed, 1 if number else 2 if plain in UNITS else 0)
        return found

    def windows(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all windows of the three kinds; equal ones at one position once."""
        many = len(raw) - WINDOW + 1
        if many < 1:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.known) > self.MOST:
            self.known.clear()
        codes = np.array([self.code(w) for w in raw], dtype=np.uint64).T.copy()
        unit = np.flatnonzero((codes[3, 1:] == 2) & (codes[3, :-1] == 1)) + 1
        for row in (1, 2):
            codes[row, unit[codes[row, unit] == codes[0, unit]]] = self.UNIT
        sums = np.zeros((3, many), np.uint64)
        for k in range(WINDOW):
            sums += codes[:3, k : k + many] * _POWERS[k]
        fresh = np.ones((3, many), bool)
        fresh[1] = sums[1] != sums[0]
        fresh[2] = (sums[2] != sums[0]) & (sums[2] != sums[1])
        kind, at = np.nonzero(fresh)
        return at.astype(np.int32), sums[kind, at].astype(np.int64)


def raw_words(text: str | None) -> list[str]:
    """Words as they are written, without accents and mark-up."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _MAY_BE_NUMBERED.search(text):
        text = without_line_numbers(text)
    if "<" in text or "&" in text or "://" in text or "-->" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text)


def item_runs(items: DataFrame, identity: str, text: str, shared: int) -> DataFrame:
    """Items as runs of their own sentences: item, run, words (as one string), windows and their places."""

    @F.pandas_udf("array<string>")
    def sentences(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s for s in _SENTENCE.split(without_line_numbers(t)) if _WORD.search(s)] if t else [])

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(words(t)[0]))

    rows = items.select(F.col(identity).alias("item"), F.posexplode(sentences(F.col(text))).alias("at", "sentence")).withColumn("key", key("sentence"))
    common = rows.where(F.col("key") != "").select("item", "key").distinct().groupBy("key").count().where(F.col("count") >= shared).select("key")
    tagged = rows.join(common.withColumn("common", F.lit(True)), "key", "left")

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        out, run, coder = [], [], Coder()
        for s, shared_by_all in [*zip(pdf.sort_values("at")["sentence"], pdf.sort_values("at")["common"].notna()), ("", True)]:
            if not shared_by_all:
                run.append(s)
            elif run:
                plain, typed = words(" ".join(run))
                at, hashes = coder.windows(raw_words(" ".join(run)))
                out.append({"item": pdf["item"].iloc[0], "run": len(out), "words": " ".join(plain), "typed": " ".join(typed), "at": at, "hash": hashes})
                run = []
        return pd.DataFrame(out, columns=["item", "run", "words", "typed", "at", "hash"])

    return tagged.groupBy("item").applyInPandas(runs, "item bigint, run int, words string, typed string, at array<int>, hash array<bigint>")  # one item's sentences


def stretches(doc: tuple[list[str], list[str]], item: tuple[list[str], list[str]], shift: int, least: int) -> list[tuple[str, int]]:
    """Kinds and lengths found on one alignment: document position = item position + shift."""
    lo, hi = max(0, -shift), min(len(item[0]), len(doc[0]) - shift)
    if hi - lo < least:
        return []
    a, b = item[0][lo:hi], doc[0][lo + shift : hi + shift]
    equal = np.fromiter((x == y for x, y in zip(a, b)), bool, hi - lo)
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = sums[least:] - sums[:-least] >= least - 1
    if good.any():
        covered = np.zeros(hi - lo, bool)
        for i in np.flatnonzero(good):
            covered[i : i + least] = True
        return [("literal", int(covered.sum()))]
    s, t = item[1][lo:hi], doc[1][lo + shift : hi + shift]
    i = 0
    while i < hi - lo:
        j = i
        there: dict[str, str] = {}
        back: dict[str, str] = {}
        while j < hi - lo and (s[j] == t[j] or a[j] == b[j]):
            if (s[j][0] == "0" and s[j] != a[j] or t[j][0] == "0" and t[j] != b[j]) and (there.setdefault(a[j], b[j]) != b[j] or back.setdefault(b[j], a[j]) != a[j]):
                break
            j += 1
        if j - i >= least and any(x != y for x, y in there.items()):
            return [("reparameterised", j - i)]
        i = max(j, i + 1)
    return []


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = 20, shared: int = 3) -> DataFrame:
    """``doc_id``, ``item_id``, ``kind``, ``words``: each document and item of which it holds a passage, once.

    If an item leaked in both kinds it counts as literal. Null and empty texts, and texts of fewer than
    ``least`` words, leak nothing; documents of any length are read whole. Identifiers are whole numbers,
    null ones take no part. Repeated rows give one result. Two empty tables give no rows.
    """
    runs = materialize(item_runs(items.where(F.col(item_id).isNotNull()), item_id, text, shared), "runs")
    index = runs.select("item", "run", F.inline(F.arrays_zip(F.col("at").alias("ipos"), "hash"))).groupBy("hash").agg(F.collect_set(F.struct("item", "run", "ipos")).alias("places"))
    small = runs.agg(F.sum(F.size("hash"))).first()[0] or 0
    texts = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("body"))
    # few item windows are known to all tasks, which pass on only those that occur; otherwise all windows are shuffled
    wanted = None
    if small <= BROADCAST_ROWS:
        hashes = np.sort(np.array([r.hash for r in index.select("hash").collect()], np.int64))
        wanted = documents.sparkSession.sparkContext.broadcast(hashes)

    @F.pandas_udf(T.StructType().add("at", T.ArrayType(T.IntegerType())).add("hash", T.ArrayType(T.LongType())))
    def text_windows(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder, items_hashes = Coder(), wanted.value if wanted else None
        for part in parts:
            found = [coder.windows(raw_words(t)) for t in part]
            if items_hashes is not None and found:
                every = np.concatenate([h for _, h in found])
                place = np.minimum(np.searchsorted(items_hashes, every), max(0, len(items_hashes) - 1))
                kept = items_hashes[place] == every if len(items_hashes) else np.zeros(len(every), bool)
                ends = np.cumsum([len(h) for _, h in found])
                found = [(at[keep], h[keep]) for (at, h), keep in zip(found, np.split(kept, ends[:-1]))]
            yield pd.DataFrame(found, columns=["at", "hash"])

    windows = texts.select("doc", text_windows("body").alias("w")).select("doc", F.inline(F.arrays_zip(F.col("w.at").alias("dpos"), F.col("w.hash").alias("hash"))))
    hits = windows.join(F.broadcast(index) if small <= BROADCAST_ROWS else index, "hash").select("doc", "dpos", F.explode("places").alias("p"))
    aligned = hits.groupBy("doc", "p.item", "p.run").agg(F.collect_set(F.col("dpos") - F.col("p.ipos")).alias("shifts"))  # no more than the words of both texts

    @F.pandas_udf("array<struct<kind:string, words:int>>")
    def check(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        last: tuple[str | None, tuple] = (None, ([], []))
        for bodies, plain, typed, shifts in parts:
            out = []
            for body, w, t, at in zip(bodies, plain, typed, shifts):
                if last[0] is not body and last[0] != body:
                    last = (body, words(body))
                item = (w.split(" "), t.split(" "))
                found = [x for s in at for x in stretches(last[1], item, int(s), least)]
                out.append([{"kind": k, "words": max(n for x, n in found if x == k)} for k in sorted({x for x, _ in found})])
            yield pd.Series(out, dtype=object)

    facts = runs.select("item", "run", "words", "typed")
    # only the texts of candidates travel: those hold a window of some item
    aligned = materialize(aligned, "alignments")
    candidates = aligned.select("doc").distinct()
    texts = texts.join(F.broadcast(candidates) if candidates.count() <= BROADCAST_ROWS else candidates, "doc", "left_semi")
    checked = aligned.join(F.broadcast(facts) if small <= BROADCAST_ROWS else facts, ["item", "run"]).join(texts, "doc").select("doc", "item", F.explode(check("body", "words", "typed", "shifts")).alias("f"))
    return checked.groupBy("doc", "item").agg(F.min_by("f.kind", F.struct(F.col("f.kind"))).alias("kind"), F.max_by("f.words", F.struct(F.col("f.kind") == "literal", F.col("f.words"))).alias("words")).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "kind", "words")
