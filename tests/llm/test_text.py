"""Neighbours, leaks, mixtures and languages."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import languages, leaks, mixing, neighbours

# -- p6 -------------------------------------------------------------------------------------------------------


def brute_neighbours(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    return {(a, ids[j]) for n, a in enumerate(ids) for j in sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-s[n, j], ids[j]))[:k]}


def test_neighbours_are_exact_with_few_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    vectors = {f"v{i:03d}": (base[i % 40] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist() for i in range(300)}
    for i in range(9):
        vectors[f"c{i}"] = vectors["v000"]  # more copies than are asked for
    vectors["d0"] = vectors["d1"] = vectors["v007"]
    rows = [(i, v, 1) for i, v in vectors.items()] + [("v001", vectors["v001"], 1), ("bad1", None, 1), ("bad2", [0.0] * 8, 1), ("bad3", [float("nan")] * 8, 1), ("bad4", [1.0] * 7, 1), ("bad5", [1.0] * 7 + [None], 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "id string, e array<float>, n int")
    got = {(r.id, r.neighbour) for r in neighbours.similar_vectors(df, "id", "e", 8, 5, probes=16, block_rows=32).collect()}
    assert got == brute_neighbours(vectors, 5)
    pairs = neighbours.neighbour_pairs(neighbours.similar_vectors(df, "id", "e", 8, 5)).collect()
    assert all(r.chunk_a < r.chunk_b for r in pairs) and {(r.chunk_a, r.chunk_b) for r in pairs} == {(min(p), max(p)) for p in got}


def test_recall_with_many_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    vectors = {f"{i:05d}": (centres[i % 60] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(vectors.items()), "id string, e array<float>")
    got = {(r.id, r.neighbour) for r in neighbours.similar_vectors(df, "id", "e", 16, 5, probes=12, block_rows=50).collect()}
    want = brute_neighbours(vectors, 5)
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_blocks_of_two_levels(spark, monkeypatch):
    """Recall with a tree of centroids fitted in tasks; exact when all blocks are asked."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    vectors = {f"{i:05d}": (centres[i % 60] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(4000)}
    df = spark.createDataFrame(list(vectors.items()), "id string, e array<float>")
    want = brute_neighbours(vectors, 5)
    monkeypatch.setattr(neighbours, "TILE_DATA", 700)
    got = {(r.id, r.neighbour) for r in neighbours.similar_vectors(df, "id", "e", 16, 5, probes=12, block_rows=40, flat=16).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9
    few = dict(list(vectors.items())[:900])
    exact = neighbours.similar_vectors(df.where("id < '00900'"), "id", "e", 16, 5, probes=None, block_rows=40, flat=8)
    assert {(r.id, r.neighbour) for r in exact.collect()} == brute_neighbours(few, 5)


def test_products_grow_with_the_vectors():
    """Comparisons of a vector with others, counted from the blocks it asks, at three sizes."""
    rng = np.random.default_rng(7)
    counts = []
    for n in (2000, 8000, 32000):
        rows = neighbours.unit(rng.normal(size=(n, 12))).astype(np.float32)
        cells = neighbours.centroids(rows[: n // 2], n // 50 // 8)
        cell = np.argmax(rows[: n // 2] @ cells.T, axis=1)
        own = [neighbours.centroids(rows[: n // 2][cell == c], max(1, int((cell == c).sum() / 25))) for c in range(len(cells))]
        tree = neighbours.Tree(np.concatenate(own), cells, np.repeat(np.arange(len(cells)), [len(x) for x in own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]), False)
        best = tree.nearest(rows, 12)
        held = np.bincount(best[:, 0], minlength=len(tree.blocks))
        counts.append(held[best].sum())
        tiling = neighbours.lay_out(tree.cell, held, np.bincount(best.ravel(), minlength=len(tree.blocks)), 500, 3000)
        size = np.zeros(len(tiling.parts))
        np.add.at(size, tiling.first, held)
        assert size.max() <= 500
    growth = np.log(counts[-1] / counts[0]) / np.log(16)
    assert growth < 1.2


def test_large_blocks_share_tiles():
    tiling = neighbours.lay_out(np.array([0, 0, 0, 1]), np.array([10, 95, 5, 7]), np.array([30, 400, 20, 10]), 30, 100)
    assert tiling.many.tolist() == [1, 4, 1, 1] and len(set(tiling.first.tolist())) == 4
    assert tiling.first[1] + 4 <= tiling.first[2] and len(tiling.parts) == tiling.first[3] + 1 and tiling.parts[tiling.first[1]] == 4


def test_few_and_no_vectors(spark, rows):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, e array<float>")
    assert rows(neighbours.similar_vectors(df, "id", "e", 2)) == [("a", "b", 0.0), ("b", "a", 0.0)]
    assert neighbours.similar_vectors(df.limit(1), "id", "e", 2).count() == 0
    assert neighbours.similar_vectors(df.limit(0), "id", "e", 2).count() == 0


def test_tile_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    q, d = neighbours.unit(rng.normal(size=(50, 32))), neighbours.unit(rng.normal(size=(400, 32)))
    d[7] = d[8] = q[3]
    r, c, s, _ = neighbours.tile_pairs(q, d, np.full(50, -1), 5)
    exact = q @ d.T
    for i in range(50):
        assert set(np.argsort(-exact[i], kind="stable")[:5]) <= set(c[r == i])
        assert np.allclose(s[r == i], exact[i][c[r == i]])


def test_nearly_equal_vectors_are_not_all_pairs(spark):
    """A hot group within the int8 error: few pairs are listed, and the answer stays exact."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=16)
    hot = (middle + 1e-3 * rng.normal(size=(5000, 16))).astype(np.float32)
    x = neighbours.unit(hot)
    same = np.arange(len(x))[:1100]
    r, c, s, listed = neighbours.tile_pairs(x[:1100], x, same, 5)
    assert listed <= 1100 * 2 * 8
    exact = x[:1100] @ x.T
    exact[same, same] = -4
    assert all(set(np.argsort(-exact[i], kind="stable")[:5]) <= set(c[r == i]) for i in range(0, 1100, 50))
    vectors = {f"{i:04d}": v.tolist() for i, v in enumerate(np.concatenate([hot[:900], rng.normal(size=(300, 16)).astype(np.float32)]))}
    df = spark.createDataFrame(list(vectors.items()), "id string, e array<float>")
    assert {(n.id, n.neighbour) for n in neighbours.similar_vectors(df, "id", "e", 16, 5, probes=16, block_rows=100).collect()} == brute_neighbours(vectors, 5)


# -- p7 -------------------------------------------------------------------------------------------------------

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
SHARED = "Answer in complete code and be careful with every single input that may be given to you."


def passage(seed, n=40):
    return [random.Random(seed).choice(WORDS) for _ in range(n)]


def test_leaks(spark, rows):
    items = [(i, f"{SHARED} " + " ".join(passage(i)) + ".") for i in range(1, 6)] + [(6, "too short"), (7, None), (None, "x"), (8, "")]
    p = passage(1)
    changed = [*p[:9], "other", *p[10:29], "thing", *p[30:]]
    dense = [w if i % 5 else "zz" for i, w in enumerate(p)]
    docs = [
        (1, "Intro here. " + " ".join(p) + " outro"), (2, "\n".join("// " + " ".join(p[i : i + 4]).upper() for i in range(0, 40, 4))), (3, "pre " + " ".join(p[5:25])), (4, "pre " + " ".join(p[5:24])), (12, "pre " + " ".join(p[5:23])), (5, " ".join(changed)), (6, " ".join(dense)),
        (7, SHARED + " and nothing else"), (8, None), (9, ""), (10, "<b>" + "</b> *".join(passage(2)[10:36]) + "* and " + " ".join(passage(3)[:30])), (None, " ".join(p)), (11, "\n".join(f"{n} | {' '.join(p[i : i + 8])}" for n, i in enumerate(range(0, 40, 8), 11))),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, item string")
    found = leaks.leaks(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(found.where("kind = 'literal'").select("doc_id", "item_id")) == sorted([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (10, 2), (10, 3), (11, 1)], key=repr)
    assert leaks.leaks(df.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert leaks.leaks(df, spark.createDataFrame(items, "item_id bigint, text string").limit(0)).count() == 0


def test_other_parameters(spark):
    text = "Suppose that {a} receives {n} sorted rows and hands every one of them to {b} within {n} seconds unless {a} was closed before the end"
    items = spark.createDataFrame([(1, text.format(a="readRows", b="nextStep", n=12))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text.format(a="fooBar", b="bazQux", n=99)), (2, text.format(a="fooBar", b="bazQux", n=99).replace("99 seconds", "98 seconds"))], "doc_id bigint, text string")
    assert [(r.doc_id, r.kind) for r in leaks.leaks(docs, items).collect()] == [(1, "reparameterised")]


def test_literal_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(15, 40))]
        doc = [w if rng.random() > 0.06 else "x" for w in item]
        got = any(k == "literal" for k, _ in leaks.stretches((doc, doc), (item, item), 0, 20))
        want = any(sum(a != b for a, b in zip(item[i : i + 20], doc[i : i + 20])) <= 1 for i in range(len(item) - 19))
        assert got == want


def test_leaks_without_letter_case(spark, rows):
    p = passage(11, 20)
    named = [*p[:10], "retryQueue", *p[11:]]
    timed = [*p[:9], "12", "seconds", *p[11:]]
    items = spark.createDataFrame([(1, " ".join(named)), (2, " ".join(timed)), (3, " ".join([*named[:5], "12", *named[6:], *passage(12, 10)]))], "item_id bigint, text string")
    texts = [" ".join(named).lower(), " ".join(named).upper(), " ".join(timed).replace("12", "several"), " ".join([*named[:5], "99", *named[6:10], "RETRYQUEUE", *p[11:], *passage(12, 10)]).lower()]
    found = leaks.leaks(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string"), items)
    got = rows(found.where("kind = 'literal'").select("doc_id", "item_id"))
    assert {(1, 1), (2, 1), (3, 2), (4, 3)} <= set(got)
    assert not [r for r in got if r[0] == 3 and r[1] == 1]


def test_windows_find_every_literal_stretch():
    """Whatever word of twenty is replaced and however letter case is changed, a window of ten is shared."""
    rng = random.Random(5)
    pool = [*WORDS[:30], "retryQueue", "sha256", "12", "7", "seconds", "ms", "Straße", "a_b"]
    for _ in range(200):
        item = [rng.choice(pool) for _ in range(20)]
        doc = [rng.choice([str.lower, str.upper, str])(w) for w in item]
        doc[rng.randrange(20)] = rng.choice(pool)
        (ia, ih), (da, dh) = (leaks.Coder().windows(leaks.raw_words(" ".join(x))) for x in (item, doc))
        assert set(zip(ia.tolist(), ih.tolist())) & set(zip(da.tolist(), dh.tolist()))


def test_other_parameters_in_lower_case(spark):
    text = "move retryQueue from {} to {} and {} rows within {} seconds but " + " ".join(WORDS[:12])
    items = spark.createDataFrame([(1, text.format(11, 12, 13, 14))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text.format(91, 92, 93, 94).lower()), (2, text.format(91, 91, 93, 94).lower().replace(WORDS[8], "zz"))], "doc_id bigint, text string")
    assert [(r.doc_id, r.kind, r.words) for r in leaks.leaks(docs, items).collect()] == [(1, "reparameterised", 25)]


# -- p8 -------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["word"] * rng.randint(1, 60)), rng.choice(["A ", "a", "b", "b", "b", "C", None, " ", "z"])) for i in range(1200)] + [(5000, "", "a"), (5001, None, "b")]
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.3, 1), ("c", 0.15, 4), ("talk", 0.05, 4)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    mixture, report = mixing.mix(df, targets)
    rows, shares = mixture.collect(), {r.source: r for r in report.collect()}
    copies: dict = {}
    for r in rows:
        copies.setdefault((r.source, r.id), []).append(r.copy)
    caps = {"a": 3, "b": 1, "c": 4}
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= caps[s] for (s, _), c in copies.items())
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(shares[s].actual_share - want / 0.95) < 0.02
    assert shares["talk"].tokens == 0 and shares[None].target_share == 0 and shares["z"].tokens == 0 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    used = {s: {i for (t, i) in copies if t == s} for s in caps}
    for s in caps:  # floor or ceil of the expectation
        counts = {len(copies[s, i]) for i in used[s]}
        assert max(counts) - min(counts) <= 1
    assert sorted(map(tuple, mixing.mix(df, targets)[0].collect())) == sorted(map(tuple, rows))
    empty, _ = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0


def test_feasible_totals():
    tokens, targets = {"a": 100, "b": 10, "c": 0}, {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 5)}
    got = mixing.feasible(tokens, targets, None)
    assert got["b"] == pytest.approx(20) and got["a"] == pytest.approx(25)
    short = mixing.feasible(tokens, targets, 100)
    assert short == {"b": 20, "a": pytest.approx(80)}
    assert mixing.feasible({}, targets, None) == {} and mixing.feasible(tokens, {"a": (0.0, 1)}, 5) == {}


# -- p9 -------------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": ["The parser waits until the index has finished writing.", "Larger batches did not help because the disk was slow.", "Nobody should call this function directly any more."],
    "fr": ["Le lecteur attend que l'index ait terminé son écriture.", "Les plus gros lots n'ont pas aidé car le disque était lent.", "Personne ne devrait plus appeler cette fonction directement."],
    "de": ["Der Leser wartet, bis das Verzeichnis fertig geschrieben ist.", "Größere Mengen halfen nicht, weil die Platte langsam war.", "Niemand sollte diese Funktion noch direkt aufrufen."],
    "es": ["El lector espera hasta que el índice haya terminado de escribir.", "Los lotes más grandes no ayudaron porque el disco era lento.", "Nadie debería llamar a esta función directamente."],
    "pt": ["O leitor espera até que o índice tenha terminado de escrever.", "Os lotes maiores não ajudaram porque o disco era lento.", "Ninguém deveria mais chamar esta função diretamente."],
    "it": ["Il lettore aspetta finché l'indice non ha finito di scrivere.", "I lotti più grandi non hanno aiutato perché il disco era lento.", "Nessuno dovrebbe più chiamare questa funzione direttamente."],
}


@pytest.fixture(scope="module")
def weights():
    texts = [s for ss in SENTENCES.values() for s in ss]
    return languages.train(texts, [languages.LANGUAGES.index(k) for k, ss in SENTENCES.items() for _ in ss], steps=160)


def test_gradients():
    rng = np.random.default_rng(0)
    n, steps, batch = 3, 5, 2
    w = {"Tf": rng.normal(size=(256, 3 * n)), "Tb": rng.normal(size=(256, 3 * n)), "Uf": rng.normal(size=(n, 3 * n)), "Ub": rng.normal(size=(n, 3 * n)), "cf": rng.normal(size=n), "cb": rng.normal(size=n)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    x, mask = rng.integers(0, 4, (steps, batch)).astype(np.uint8), np.ones((steps, batch), np.float32)
    mask[4, 1] = 0
    g = rng.normal(size=(steps, 2, batch, n)).astype(np.float32)
    loss = lambda: float((languages.run(x, mask, w)[0].astype(np.float64) * g).sum())
    d = languages.back(x, g, languages.run(x, mask, w, True)[1], w)
    for name, at in (("Tf", (1, 2)), ("Tb", (2, 7)), ("Uf", (1, 4)), ("Ub", (0, 8)), ("cf", (1,)), ("cb", (2,)), ("Tb", (0, 1))):
        e = 1e-2
        w[name][at] += e
        up = loss()
        w[name][at] -= 2 * e
        down = loss()
        w[name][at] += e
        assert d[name][at] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=2e-3)


def test_weights_are_kept(spark, monkeypatch):
    docs = [(n, " ".join(ss), k) for n, (k, ss) in enumerate(SENTENCES.items())]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    calls = []
    monkeypatch.setattr(languages, "train", lambda texts, labels: calls.append(len(texts)) or languages.new_weights(np.random.default_rng(1), 6))
    first, again = languages.fit(df), languages.fit(df.union(df).repartition(3))
    assert len(calls) == 1 and all((first[k] == again[k]).all() for k in first)
    languages.fit(df.where("doc_id > 0"))
    assert len(calls) == 2


def test_held_out(spark):
    """Trained on every other document of the test data, measured on the rest; some of their labels are wrong."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    rows = spark.read.parquet(str(path)).select("doc_id", "text", languages.label_code(F.col("lang")).alias("code")).where("code IS NOT NULL").collect()
    split = [[(s, languages.LANGUAGES.index(r.code)) for s in languages.sentences(r.text)] for r in rows]
    seen = [x for own in split[::2] for x in own]
    weights = languages.train([s for s, _ in seen], [k for _, k in seen], steps=250)
    right = [np.bincount(languages.pooled(weights, [s for s, _ in own]).argmax(1)).argmax() == own[0][1] for own in split[1::2] if own]
    assert np.mean(right) >= 0.9


def test_pooling(weights):
    assert languages.pooled(weights, ["", "x" * 3000]).shape == (2, 6)
    p = languages.pooled(weights, [s for ss in SENTENCES.values() for s in ss])
    assert (p.argmax(1) == np.repeat(np.arange(6), 3)).mean() >= 0.9


def test_faults(spark, rows, weights):
    join = lambda k: " ".join(SENTENCES[k])
    docs = [
        (1, join("en"), "English"), (2, join("fr"), "en"), (3, join("de"), None), (4, join("en") + "\n\n" + join("es"), "en"), (5, "```\nconst a = 1;\n```\n[11:34:27] INFO x y z w at a.ts:1", ""), (6, None, "xx"), (7, "", None), (8, join("it"), "it-CH"),
        (9, "# Titre de la page\n\n" + join("en") + ' He wrote "mais non" there.', "en_GB"), (10, join("pt"), "español"), (11, join("de"), "deu"),
    ]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id bigint, text string, lang string, confidence double")
    got = rows(languages.language_faults(df, weights).select("doc_id", "lang"))
    assert got == [(10, "pt"), (2, "fr"), (3, "de"), (4, "en"), (4, "es")]
    segments = languages.document_languages(df, weights).where("doc_id = 4").orderBy("segment").collect()
    assert [(r.lang, r.sentences) for r in segments] == [("en", 3), ("es", 3)] and all(0 < r.confidence <= 1 for r in segments)
    assert languages.language_faults(df.limit(0), weights).count() == 0
    assert set(languages.fit(df.limit(0), most=1)) == set(weights)
