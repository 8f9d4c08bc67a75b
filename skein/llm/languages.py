"""The language of each document and of each stretch of a mixed one.

A bidirectional gated recurrent network reads the UTF-8 bytes of running text and labels every position. It is
trained in numpy by backpropagation through time on a bounded sample of labelled documents (TRAIN_DOCUMENTS for
each language); labels that are wrong are outvoted, and half of the training texts lose their accents. Position
probabilities are pooled over sentences, and sentences over documents.

Not running text: fenced and indented code, log lines, headings, code names, quotations of a few words, and
lines with little besides names and signs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import shared_dir

LANGUAGES = ("en", "fr", "de", "es", "pt", "it")
#: Documents of each language that the network is trained on, at most.
TRAIN_DOCUMENTS = 300
HIDDEN, WINDOW, BATCH, STEPS = 24, 48, 256, 450
PRUNE = 0.4
#: Part of the newest weights in their running mean, which is what counts: a late step that fails does no harm.
KEPT = 0.03
#: Letters of a sentence below which it is no full sentence.
LEAST_LETTERS = 20
#: Bytes read at once; longer sentences are read in stretches of this size and pooled.
STRETCH = 400
#: Sentences whose probabilities a task keeps.
MOST_SEEN = 100_000

#: How the languages are called in labels, besides their two-letter codes.
NAMES = {
    "en": "eng english englisch anglais inglés ingles inglês inglese", "fr": "fra fre french français francais französisch franzoesisch francés frances francês francese",
    "de": "deu ger german deutsch allemand alemán aleman alemão alemao tedesco", "es": "spa esp spanish español espanol spanisch espagnol espanhol spagnolo castellano",
    "pt": "por portuguese português portugues portugiesisch portugais portugués portoghese", "it": "ita italian italiano italienisch italien",
}

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_LOG = re.compile(r"^\s*(?:\[?\d{1,4}[-:/.]\d\d[-:/.]\d\d[^\n]*|\[[A-Z]+\][^\n]*|(?:INFO|WARN|ERROR|DEBUG|TRACE)\b[^\n]*|at \S+ ?\([^\n]*|(?:Refs|Fixes|Closes|See|Signed-off-by|Co-authored-by|Reviewed-by)\b:?[^\n]*[#<@][^\n]*)$", re.M)
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s+(?![^\n]*[.!?]\s*$)[^\n]*$|^[^\n]*\n(?:={3,}|-{3,})\s*$", re.M)
_CODE_LINE = re.compile(r"^(?: {4,}|\t)(?=[^\n]*[{}();=<>])[^\n]*$|^[^\n]*[{};]\s*$|^\s*(?:const|let|var|function|return|import|export|if|for|while|class)\b[^\n]*[({=;][^\n]*$", re.M)
_PREFIX = re.compile(r"^[ \t]*(?:(?://+|#+|>+|\*+|-+|\+|\||\d{1,3}[.)])[ \t]+)+", re.M)
_INLINE = re.compile(r"`[^`\n]*`|https?://\S+|<[^<>\n]{1,80}>|\"[^\"\n]{1,60}\"|«[^»\n]{1,60}»|“[^”\n]{1,60}”|\b\w*(?:[a-z][A-Z]|_|\d)\w*\b|\S+[/\\]\S+|\b\w+\.\w+\b")
_SENTENCE = re.compile(r"(?<=[.!?])[)\"'»”]*\s+(?=[\W\d]*[A-ZÀ-Þ¿¡])|(?<=[.!?])\s*$")


def label_code(label: Column) -> Column:
    """The two-letter code of a label in any notation; null if it names none of LANGUAGES."""
    plain = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    head = F.split_part(F.regexp_replace(plain, "[-_ (].*$", "-"), F.lit("-"), F.lit(1))
    known = F.create_map(*[F.lit(x) for code in LANGUAGES for n in [code, *NAMES[code].split()] for x in (n, code)])
    return F.coalesce(F.try_element_at(known, head), F.try_element_at(known, plain))


def sentences(text: str) -> list[str]:
    """The sentences of running text, in order; what is no language is blanked first."""
    text = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = _FENCE.sub("\n\n", text)
    for pattern in (_LOG, _HEADING, _CODE_LINE):
        text = pattern.sub("\n", text)
    out = []
    for paragraph in re.split(r"\n\s*\n|\n(?=[ \t]*(?:[*\-+•>]|\d{1,3}[.)])[ \t])", text):
        paragraph = " ".join(_PREFIX.sub("", paragraph).split())
        for sentence in _SENTENCE.split(paragraph):
            plain = " ".join(_INLINE.sub(" ", sentence).split()) if sentence else ""
            if sum(map(str.isalpha, plain)) >= LEAST_LETTERS and plain.count(" ") >= 3:
                out.append(plain)
    return out


def encoded(text: str) -> bytes:
    return text.lower().encode()


def without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


# -- the network ----------------------------------------------------------------------------------------------


def new_weights(rng: np.random.Generator, classes: int, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Of both directions: T input table by byte (update, reset, candidate), U recurrent, c bias inside the reset; V, b output."""
    w = {}
    for d in "fb":
        w["T" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
        w["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w["c" + d] = np.zeros(hidden)
    w["V"], w["b"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, classes)), np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in w.items()}


def both(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input tables (one below the other), recurrent weights and biases of the two directions as one array each."""
    return np.concatenate([w["Tf"], w["Tb"]]), np.stack([w["Uf"], w["Ub"]]), np.stack([w["cf"], w["cb"]])[:, None]


def run(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], keep: bool = False):
    """States (time, direction, batch, hidden) over bytes x (time, batch), in the order each direction reads them;
    padding leaves the state as it is. Both directions go through time together."""
    T, U, c = both(w)
    steps, batch = x.shape
    n = U.shape[1]
    read = np.stack([x.astype(np.intp), x[::-1].astype(np.intp) + 256], 1)
    masks = np.stack([mask, mask[::-1]], 1)[..., None]
    h, out, kept = np.zeros((2, batch, n), np.float32), np.empty((steps, 2, batch, n), np.float32), []
    full = masks.min(axis=(1, 2, 3)) > 0
    a, b = np.empty((2, batch, 3 * n), np.float32), np.empty((2, batch, 3 * n), np.float32)
    for t in range(steps):
        np.take(T, read[t], axis=0, out=a, mode="clip")
        np.matmul(h, U, out=b)
        gates = a[..., : 2 * n] + b[..., : 2 * n]
        np.negative(gates, out=gates)
        with np.errstate(over="ignore"):
            np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)  # the logistic function
        z, r = gates[..., :n], gates[..., n:]
        inner = b[..., 2 * n :] + c
        g = r * inner
        g += a[..., 2 * n :]
        np.tanh(g, out=g)
        if keep:
            kept.append((h, z, r, inner, g, masks[t]))
        move = g - h
        move *= 1 - z
        if not full[t]:
            move *= masks[t]
        h = h + move
        out[t] = h
    return out, kept


def back(x: np.ndarray, grad: np.ndarray, kept: list, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Gradients of the recurrent weights from those of the states (time, direction, batch, hidden), through time."""
    T, U, c = both(w)
    turned = U.transpose(0, 2, 1)
    dU, dc, dh, inputs = np.zeros_like(U), np.zeros_like(c), np.zeros_like(grad[0]), [None] * len(kept)
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, inner, g, m = kept[t]
        dh = dh + grad[t]
        move = m * dh
        dz = -move * (g - h) * z * (1 - z)
        dg = move * (1 - z) * (1 - g * g)
        dr = dg * inner * r * (1 - r)
        di = dg * r
        inputs[t] = np.concatenate([dz, dr, dg], 2)
        db = np.concatenate([dz, dr, di], 2)
        dU += h.transpose(0, 2, 1) @ db
        dc += di.sum(1, keepdims=True)
        dh = dh * (1 - m) + move * z + db @ turned
    read = np.stack([x.astype(np.intp), x[::-1].astype(np.intp) + 256], 1)
    order = np.argsort(read, axis=None, kind="stable")
    found, first = np.unique(read.reshape(-1)[order], return_index=True)
    dT = np.zeros_like(T)
    dT[found] = np.add.reduceat(np.stack(inputs).reshape(-1, T.shape[1])[order], first, axis=0)
    return {"Tf": dT[:256], "Tb": dT[256:], "Uf": dU[0], "Ub": dU[1], "cf": dc[0, 0], "cb": dc[1, 0]}


def states(out: np.ndarray) -> np.ndarray:
    """Both directions' states side by side, by position."""
    return np.concatenate([out[:, 0], out[::-1, 1]], 2)


def log_probabilities(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    s = states(run(x, mask, w)[0]) @ w["V"] + w["b"]
    s -= s.max(2, keepdims=True)
    return s - np.log(np.exp(s).sum(2, keepdims=True))


def train(texts: list[str], labels: list[int], classes: int = len(LANGUAGES), steps: int = STEPS, seed: int = 11) -> dict[str, np.ndarray]:
    """Adam on windows of bytes, every language as often as every other.

    After PRUNE of the steps, texts that the network takes for another language are left out: their label was
    that of a document with several languages, or wrong.
    """
    rng = np.random.default_rng(seed)
    w = new_weights(rng, classes)
    data = [[encoded(v) for t, lab in zip(texts, labels) if lab == k for v in (t, without_accents(t))] for k in range(classes)]
    there = [k for k in range(classes) if data[k]]
    if not there:
        return w
    mean = {k: v.copy() for k, v in w.items()}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    for step in range(1, steps + 1):
        if step == int(PRUNE * steps):
            for k in there:
                kept = [raw for raw, p in zip(data[k], pooled(mean, [raw.decode() for raw in data[k]])) if p.argmax() == k]
                data[k] = kept or data[k]
        y = rng.choice(there, BATCH)
        x, mask = np.full((WINDOW, BATCH), 32, np.uint8), np.zeros((WINDOW, BATCH), np.float32)
        for j, k in enumerate(y):
            raw = data[k][rng.integers(len(data[k]))]
            at = rng.integers(max(1, len(raw) - WINDOW + 1))
            part = np.frombuffer(raw[at : at + WINDOW], np.uint8)
            x[: len(part), j], mask[: len(part), j] = part, 1
        out, kept_states = run(x, mask, w, True)
        h = states(out)
        s = h @ w["V"] + w["b"]
        p = np.exp(s - s.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        d = p
        d[:, np.arange(BATCH), y] -= 1
        d *= (mask / mask.sum())[:, :, None]
        dh = d @ w["V"].T
        g = {"V": np.einsum("tbh,tbc->hc", h, d), "b": d.sum((0, 1))}
        g |= back(x, np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]], 1), kept_states, w)
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        rate = 0.02 * min(1, 1.25 * (1 - step / (steps + 1)))
        for k, q in g.items():
            q *= min(1, 1 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.99 * v[k] + 0.01 * q * q
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            mean[k] += min(1, max(KEPT, 10 / (step + 10))) * (w[k] - mean[k])
    return mean


def pooled(w: dict[str, np.ndarray], texts: list[str], batch: int = 768) -> np.ndarray:
    """Probabilities (text, language): those of the positions, averaged."""
    parts = [(i, raw[a : a + STRETCH]) for i, t in enumerate(texts) for raw in [encoded(t)] for a in range(0, max(1, len(raw)), STRETCH)]
    order = sorted(range(len(parts)), key=lambda k: len(parts[k][1]))
    sums, weight = np.zeros((len(texts), w["b"].size)), np.zeros(len(texts))
    for a in range(0, len(order), batch):
        rows = [parts[k] for k in order[a : a + batch]]
        x, mask = np.full((max(1, max(len(r) for _, r in rows)), len(rows)), 32, np.uint8), np.zeros((max(1, max(len(r) for _, r in rows)), len(rows)), np.float32)
        for j, (_, raw) in enumerate(rows):
            x[: len(raw), j], mask[: len(raw), j] = np.frombuffer(raw, np.uint8), 1
        p = (np.exp(log_probabilities(w, x, mask)) * mask[:, :, None]).sum(0)
        np.add.at(sums, [i for i, _ in rows], p)
        np.add.at(weight, [i for i, _ in rows], mask.sum(0))
    return sums / np.maximum(weight, 1)[:, None]


# -- operators ------------------------------------------------------------------------------------------------


def fit(documents: DataFrame, identity: str = "doc_id", text: str = "text", label: str = "lang", most: int = TRAIN_DOCUMENTS) -> dict[str, np.ndarray]:
    """The network's weights, from at most ``most`` labelled documents of each language (of their first 20 sentences).

    The sample is drawn by a hash of the identity, so it is the same for the same table; without labelled
    documents the weights are random and every confidence is low. Identities are chosen first, then only their
    texts are read. The weights are kept in the shared folder under the sample's hash: the same sample is
    never trained on twice.
    """
    rows = documents.where(F.col(identity).isNotNull()).select(F.col(identity).cast("string").alias("id"), F.length(text).alias("size"), label_code(F.col(label)).alias("code")).where("code IS NOT NULL AND size >= 60")
    chosen = rows.select("id", "code").distinct().withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("id"), "id"))).where(F.col("place") <= most).drop("place")
    texts = documents.select(F.col(identity).cast("string").alias("id"), F.col(text).alias("t"), label_code(F.col(label)).alias("code"))
    sample = texts.join(F.broadcast(chosen), ["id", "code"]).select("code", "id", "t").distinct().collect()  # most for each language
    sample = sorted(sample, key=lambda r: (r.code, r.id, r.t))
    spark = documents.sparkSession
    settings = (HIDDEN, WINDOW, BATCH, STEPS, PRUNE, KEPT, *LANGUAGES)
    key = xxhash.xxh64_hexdigest(repr(settings) + "".join(f"{r.code}\0{r.id}\0{r.t}\0" for r in sample))
    path = f"{shared_dir(spark)}/languages-{key}"
    try:
        return {r.name: np.frombuffer(r.data, np.float32).reshape(r.shape) for r in spark.read.parquet(path).collect()}
    except AnalysisException:  # not trained yet
        pass
    found, labels = [], []
    for r in sample:
        for s in sentences(r.t)[:20]:
            found.append(s)
            labels.append(LANGUAGES.index(r.code))
    weights = train(found, labels)
    rows = [(k, list(v.shape), v.astype(np.float32).tobytes()) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return weights


def document_languages(documents: DataFrame, weights: dict[str, np.ndarray], identity: str = "doc_id", text: str = "text", sure: float = 0.5) -> DataFrame:
    """``doc_id`` and a row for each stretch: ``segment`` (from 1), ``lang``, ``confidence``, ``sentences``, ``words``.

    A stretch is a run of sentences of one language. Sentences whose best probability is below ``sure`` go with
    the stretch they lie in. Texts without a full sentence have no rows, nor have null and empty ones; each text is read whole.
    """
    known = documents.sparkSession.sparkContext.broadcast(weights)  # 256 x 72 numbers for each direction

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, seen = known.value, {}  # sentences that occur again are read once
        for pdf in batches:
            rows = []
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                split = [sentences(t) if t else [] for t in part["t"]]
                if len(seen) > MOST_SEEN:
                    seen.clear()
                fresh = list(dict.fromkeys(s for x in split for s in x if s not in seen))
                seen.update(zip(fresh, pooled(w, fresh)))
                p = [seen[s] for x in split for s in x]
                at = 0
                for i, own in zip(part["id"], split):
                    run: list = []
                    for s, q in zip(own, p[at : at + len(own)]):
                        best = int(q.argmax())
                        if run and (run[-1][0] == best or q[best] < sure):
                            run[-1][1].append(q[run[-1][0]])
                            run[-1][2] += s.count(" ") + 1
                        else:
                            run.append([best, [q[best]], s.count(" ") + 1])
                    at += len(own)
                    rows += [(i, n, LANGUAGES[k], float(np.mean(c)), len(c), n_words) for n, (k, c, n_words) in enumerate(run, 1)]
            yield pd.DataFrame(rows, columns=["id", "segment", "lang", "confidence", "sentences", "words"])

    rows = documents.select(F.col(identity).alias("id"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(label, f"id {kind}, segment int, lang string, confidence double, sentences int, words int").withColumnRenamed("id", identity)


def language_faults(documents: DataFrame, weights: dict[str, np.ndarray], identity: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``doc_id``, ``lang``, ``confidence``: for each document whose label is empty, no language or not the text's, and each mixed one, its languages.

    The language with the most words counts always, another one from two sentences on. A label in another
    notation of the text's language is right.
    """
    stretches = document_languages(documents, weights, identity, text)
    found = stretches.groupBy(identity, "lang").agg(F.sum("sentences").alias("n"), F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"))
    main = F.row_number().over(Window.partitionBy(identity).orderBy(F.desc("words"), "lang")) == 1  # six rows at most
    found = found.withColumn("main", main).where("main OR n >= 2")
    found = found.withColumn("many", F.count("*").over(Window.partitionBy(identity)))
    labels = documents.select(identity, label_code(F.col(label)).alias("code"))
    rows = found.join(labels, identity)
    return rows.where("many > 1 OR code IS NULL OR code <> lang").select(identity, "lang", "confidence")
