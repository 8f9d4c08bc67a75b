import random

import pytest

from skein.operators.chunking import chunk_text, long_line_pieces, merged_ranges, number_chunks


def brute(text, size, overlap):
    lines = text.splitlines()
    n = [len(x.split()) for x in lines]
    out, start, cur = [], 0, 0
    for i, t in enumerate(n):
        if t > size:
            if i > start:
                out.append((start + 1, i, "\n".join(lines[start:i])))
            w = lines[i].split()
            out += [(i + 1, i + 1, " ".join(w[k : k + size])) for k in range(0, t, size)]
            start, cur = i + 1, 0
        elif cur + t <= size or i == start:
            cur += t
        else:
            out.append((start + 1, i, "\n".join(lines[start:i])))
            s, k = i, 0
            while s > start and k + n[s - 1] <= overlap:
                s -= 1
                k += n[s]
            start, cur = (s, k + t) if k + t <= size else (i, t)
    if start < len(lines):
        out.append((start + 1, len(lines), "\n".join(lines[start:])))
    return [(k + 1, len(out), a, b, len(x.split()), x) for k, (a, b, x) in enumerate(out)]


def test_fold_against_brute_force(spark, rows):
    rng = random.Random(5)
    texts = ["", None, "a", "\n\n", "one\r\ntwo\n", " ".join(["w"] * 100), "x y z", "\n".join(" ".join(["t"] * k) for k in (200, 100, 60, 350))]
    texts += ["\n".join(" ".join(["w"] * rng.choice([0, 1, 3, 5, 9, 14, 30])) for _ in range(rng.randint(1, 25))) for _ in range(120)]
    for size, overlap in ((20, 4), (12, 6), (10, 9), (5, 0)):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        want = sorted((i, *c) for i, t in enumerate(texts) if t for c in brute(t, size, overlap))
        assert rows(chunk_text(df, "id", "t", size, overlap)) == sorted(want, key=repr)
    df = spark.createDataFrame([(1, texts[7])], "id int, t string")
    assert chunk_text(df, "id", "t", 400, 64).count() == 2  # the case that must end
    assert chunk_text(df.limit(0), "id", "t", 400, 64).count() == 0
    with pytest.raises(ValueError):
        chunk_text(df, "id", "t", 10, 10)


def test_numbering_and_pieces(spark, rows):
    df = spark.createDataFrame([("f", 5), ("f", 1), ("g", 3)], "file_path string, start_line int")
    assert rows(number_chunks(df, "file_path", "start_line")) == [("f", 1, 1, 2), ("f", 5, 2, 2), ("g", 3, 1, 1)]
    df = spark.createDataFrame([(1, "a b c d e\nshort\n"), (2, None)], "id int, t string")
    assert rows(long_line_pieces(df, "id", "t", 2)) == [(1, 1, 1, 2, "a b"), (1, 1, 2, 2, "c d"), (1, 1, 3, 1, "e")]


def test_merged_ranges(spark, rows):
    df = spark.createDataFrame([("f", 1, 5), ("f", 3, 4), ("f", 5, 9), ("f", 11, 12), ("g", 2, 2), ("g", None, 3)], "k string, a int, b int")
    assert rows(merged_ranges(df, "k", "a", "b")) == [("f", 1, 9, 3), ("f", 11, 12, 1), ("g", 2, 2, 1)]
