"""Token-aware packing of lines into overlapping chunks, as a fold over each text's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import words

#: Lines end as str.splitlines has it.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"


def split_lines(text: Column) -> Column:
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def spans(tokens: Column, size: int, overlap: int) -> Column:
    """Chunks as (first line, last line, piece), lines from 1. ``tokens`` holds the tokens of each line.

    Lines are packed while their tokens fit. The next chunk begins with the longest tail of at most ``overlap``
    tokens of the one before, unless that and the next line do not fit together, then without it. A line of more
    than ``size`` tokens becomes chunks of its own, numbered by ``piece`` from 0; for others piece is null.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and smaller than size")
    span = lambda a, b, p: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), p.cast("int").alias("p"))
    none = F.lit(None).cast("int")
    state = lambda start, cur, out: F.struct(start.cast("int").alias("start"), cur.cast("int").alias("cur"), out.alias("out"))
    empty = F.array().cast("array<struct<a:int,b:int,p:int>>")
    count = lambda i: F.element_at(tokens, i.cast("int"))

    def tail(first: Column, last: Column) -> Column:
        """Start and tokens of the tail that is carried over."""
        begin = F.struct((last + 1).cast("int").alias("s"), F.lit(0).alias("t"), F.lit(True).alias("on"))

        def step(acc: Column, j: Column) -> Column:
            fits = acc["on"] & (acc["t"] + count(j) <= overlap)
            return F.struct(F.when(fits, j).otherwise(acc["s"]).cast("int").alias("s"), F.when(fits, acc["t"] + count(j)).otherwise(acc["t"]).cast("int").alias("t"), fits.alias("on"))

        return F.aggregate(F.reverse(F.sequence(first, last)), begin, step)

    def step(acc: Column, i: Column) -> Column:
        n = count(i)
        held = i > acc["start"]
        flushed = F.when(held, F.concat(acc["out"], F.array(span(acc["start"], i - 1, none)))).otherwise(acc["out"])
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / size).cast("int") - 1)), lambda p: span(i, i, p))
        long = state(i + 1, F.lit(0), F.concat(flushed, pieces))
        over = tail(acc["start"], i - 1)
        packed = F.when(over["t"] + n <= size, state(over["s"], over["t"] + n, flushed)).otherwise(state(i, n, flushed))
        return F.when(n > size, long).when((acc["cur"] + n <= size) | ~held, state(acc["start"], acc["cur"] + n, acc["out"])).otherwise(packed)

    def finish(acc: Column) -> Column:
        rest = acc["start"] <= F.size(tokens)
        return F.when(rest, F.concat(acc["out"], F.array(span(acc["start"], F.size(tokens), none)))).otherwise(acc["out"])

    fold = F.aggregate(F.sequence(F.lit(1), F.size(tokens)), state(F.lit(1), F.lit(0), empty), step, finish)
    return F.when(F.size(tokens) > 0, fold).otherwise(empty)


def chunk_text(df: DataFrame, identity: str, text: str, size: int = 400, overlap: int = 64) -> DataFrame:
    """``identity``, chunk_index (from 1), total_chunks, start_line, end_line, token_count, text_content.

    Tokens are blank-separated words, lines are joined by a line feed. Null and empty texts give no chunks; a
    text of blank lines gives one.
    """
    rows = df.where(F.length(text) > 0).select(F.col(identity), split_lines(F.col(text)).alias("_l"))
    rows = rows.select(identity, "_l", F.transform("_l", lambda x: F.size(words(x))).alias("_t"))
    found = rows.select(identity, "_l", F.posexplode(spans(F.col("_t"), size, overlap)).alias("_i", "_s"), F.size(spans(F.col("_t"), size, overlap)).alias("total_chunks"))
    piece = F.array_join(F.slice(words(F.element_at("_l", F.col("_s.a"))), F.col("_s.p") * size + 1, size), " ")
    lines = F.array_join(F.slice("_l", F.col("_s.a"), F.col("_s.b") - F.col("_s.a") + 1), "\n")
    body = F.when(F.col("_s.p").isNotNull(), piece).otherwise(lines)
    return found.select(identity, (F.col("_i") + 1).alias("chunk_index"), "total_chunks", F.col("_s.a").alias("start_line"), F.col("_s.b").alias("end_line"), F.size(words(body)).alias("token_count"), body.alias("text_content"))


def number_chunks(chunks: DataFrame, file: str = "file_path", *order: str) -> DataFrame:
    """chunk_index from 1 and total_chunks of each file's chunks, by ``order``."""
    w = Window.partitionBy(file)
    return chunks.withColumn("chunk_index", F.row_number().over(w.orderBy(*order))).withColumn("total_chunks", F.count("*").over(w))


def long_line_pieces(df: DataFrame, identity: str, text: str, size: int) -> DataFrame:
    """Lines of more than ``size`` words cut into pieces: identity, line (from 1), piece (from 1), words, text."""
    lines = df.select(identity, F.posexplode(F.split(text, "\n")).alias("_n", "_x")).select(identity, (F.col("_n") + 1).alias("line"), words(F.col("_x")).alias("_w")).where(F.size("_w") > size)
    cut = lines.select(identity, "line", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size)), lambda i: F.slice("_w", i + 1, size))).alias("_p", "_s"))
    return cut.select(identity, "line", (F.col("_p") + 1).alias("piece"), F.size("_s").alias("words"), F.array_join("_s", " ").alias("text"))


def merged_ranges(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Ranges of each key with those that touch or overlap made one: key, start, end, parts. Null bounds take no part."""
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, start, end)
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    return marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island")
