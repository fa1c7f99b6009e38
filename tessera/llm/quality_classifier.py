"""Quality classifier: gated-attention multiple-instance learning.

A text is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded
(letter, symbol and white-space shares, capitals, word lengths, repeated
neighbours), a learnt layer turns the encoding into h = tanh(W x), and gated
attention weighs the passages: a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))).
The weighted passage representation z = sum_k a_k h_k is scored by a logistic
unit. All weights are learnt from document labels alone.

Training: at most ``max_docs`` labelled documents, those with the least hash of
their id, of at most ``max_doc_bytes`` bytes each; both bounds are parameters, and
an id's text is the one with the least hash that is not longer. The sample is
encoded on the executors (276 bytes for each passage, and a passage has 127 bytes
at least, so max_docs * max_doc_bytes * 2.2 at the very most) and fitted on the
driver with Adam.
Scoring covers every whole text, however long, in one pass without a shuffle.
Labels, language, source and ids are never inputs of a score.

Defined results: null and empty texts are one passage of zeros and get its
score; rows are scored one by one, so repeated rows get equal scores; a label
that is null is not used; a document with several labels takes their majority,
0 on a tie; without any usable label, or with one class only, the model is the
share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import lower_bytes, map_arrow, span_hashes, steps, text_buffer, word_spans

PASSAGE_WORDS = 64


def _classes() -> np.ndarray:
    """A class for each byte: letters without case, digits together, each ASCII
    symbol on its own, space, other white space, UTF-8 lead and follow bytes."""
    out = np.zeros(256, np.int64)
    letters = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    symbols = {c: i + 30 for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")}
    for b in range(256):
        c = chr(b)
        if b >= 192:
            out[b] = 28
        elif b >= 128:
            out[b] = 29
        elif c.lower() in letters:
            out[b] = letters[c.lower()]
        elif c.isdigit():
            out[b] = 26
        elif c == " ":
            out[b] = 27
        else:
            out[b] = symbols.get(c, 62)
    return out


_CLASS = _classes()
N_CLASSES = 63
N_FEATURES = N_CLASSES + 6


def encode_passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages of each row, encodings) of texts given as bytes and offsets."""
    starts, ends, row = word_spans(raw, offsets)
    rows = len(offsets) - 1
    words = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(words)])
    of_row = np.maximum(-(-words // PASSAGE_WORDS), 1)
    passage_base = np.concatenate([[0], np.cumsum(of_row)])
    n = int(passage_base[-1])
    # white space before a passage's first word goes to the passage before it
    nth = np.arange(len(starts)) - first[row]
    word_passage = passage_base[row] + nth // PASSAGE_WORDS
    step = np.zeros(len(raw) + 1, np.int32)
    begin = nth % PASSAGE_WORDS == 0
    step[starts[begin & (nth > 0)]] += 1
    np.add.at(step, offsets[1:-1], 1)  # a row's first passage
    byte_passage = np.cumsum(step[:-1])
    counts = np.bincount(byte_passage * N_CLASSES + _CLASS[raw], minlength=n * N_CLASSES)[: n * N_CLASSES].reshape(n, N_CLASSES).astype(np.float32)
    size = np.maximum(counts.sum(1), 1)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = np.sqrt(counts / size[:, None])
    upper = (raw >= 65) & (raw <= 90)
    out[:, N_CLASSES] = np.sqrt(np.bincount(byte_passage, upper, n)[:n] / size)
    if len(starts):
        m = np.maximum(np.bincount(word_passage, minlength=n), 1)
        length = (ends - starts).astype(np.float64)
        mean = np.bincount(word_passage, length, n) / m
        out[:, N_CLASSES + 1] = np.log1p(mean) - 1.5
        out[:, N_CLASSES + 2] = np.sqrt(np.maximum(np.bincount(word_passage, length**2, n) / m - mean**2, 0)) / 5
        h = span_hashes(lower_bytes(raw), starts, ends)
        for k in (1, 2):
            same = np.zeros(len(h))
            same[k:] = (h[k:] == h[:-k]) & (word_passage[k:] == word_passage[:-k])
            out[:, N_CLASSES + 2 + k] = np.bincount(word_passage, same, n) / m
        out[:, N_CLASSES + 5] = np.minimum(m / PASSAGE_WORDS, 1) * (np.bincount(word_passage, minlength=n) > 0)
    return of_row, out


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the scoring unit."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, of_row: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(of_row), self.constant)
        return _forward(self.w, (x - self.mean) * self.scale, of_row)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(w: dict, x: np.ndarray, of_row: np.ndarray) -> dict:
    at = np.concatenate([[0], np.cumsum(of_row)[:-1]])
    bag = np.repeat(np.arange(len(of_row)), of_row)
    h = np.tanh(x @ w["W"] + w["Wb"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    a = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(h * a[:, None], at)
    return {"bag": bag, "h": h, "t": t, "g": g, "att": a, "z": z, "p": _sigmoid(z @ w["c"] + w["b"][0])}


def _gradients(w: dict, x: np.ndarray, of_row: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(w, x, of_row)
    at = np.concatenate([[0], np.cumsum(of_row)[:-1]])
    d = (f["p"] - y) / len(y)
    out = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
    dz = d[:, None] * w["c"]
    dzb = dz[f["bag"]]
    da = (dzb * f["h"]).sum(1)
    de = f["att"] * (da - np.add.reduceat(f["att"] * da, at)[f["bag"]])
    out["a"] = (f["t"] * f["g"]).T @ de
    dt, dg = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
    dh = (f["att"][:, None] * dzb + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
    out["W"], out["Wb"] = x.T @ dh, dh.sum(0)
    return out


def fit_bags(of_row: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit on bags (of_row passages each, stacked in x) and their labels."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), 1 / np.maximum(x.std(0), 0.02)
    x = ((x - mean) * scale).astype(np.float64)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {"W": draw(N_FEATURES, hidden), "Wb": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "a": draw(gate), "c": draw(hidden), "b": np.array([np.log(y.mean() / (1 - y.mean()))])}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    first, t = np.concatenate([[0], np.cumsum(of_row)]), 0
    steps_all = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            pick = order[k : k + batch]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            g, t = _gradients(w, x[rows], of_row[pick], y[pick]), t + 1
            lr = rate * (1 - t / (steps_all + 1))
            for name in w:
                m1[name] += 0.1 * (g[name] - m1[name])
                m2[name] += 0.001 * (g[name] ** 2 - m2[name])
                w[name] = w[name] - lr * (m1[name] / (1 - 0.9**t) / (np.sqrt(m2[name] / (1 - 0.999**t)) + 1e-8) + decay * w[name])
    return Model(mean.astype(np.float32), scale.astype(np.float32), {k: v.astype(np.float32) for k, v in w.items()})


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4000, max_doc_bytes: int = 1 << 16) -> Model:
    """Fit on the labelled documents of ``labels`` (id_col, label_col)."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull())
    known = known.groupBy("id").agg((F.avg("y") > 0.5).cast("int").alias("y"))
    # bounded: the hash order makes the sample the same for every run
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                of_row, x = encode_passages(*text_buffer(part.column(1)))
                ends = np.concatenate([[0], np.cumsum(of_row)])
                blobs = [x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary()), part.column(2)], names=["id", "x", "y"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= max_doc_bytes)
    # one text an id, folded before the shuffle: max_docs rows at most
    one = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "y")).alias("r"))
    rows = map_arrow(one.select("id", "r.text", "r.y"), run, f"id {kind}, x binary, y int").orderBy("id").collect()
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    if not bags:
        return fit_bags(np.zeros(0, np.int64), np.zeros((0, N_FEATURES), np.float32), np.zeros(0))
    return fit_bags(np.array([len(b) for b in bags]), np.concatenate(bags), np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """(id_col, carry.., score, predicted) of every row; no shuffle."""
    names = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                p = model.score(*encode_passages(*text_buffer(part.column(0)))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p, pa.float64())], names=[*(f"c{i}" for i in range(len(names))), "score"])

    kinds = ", ".join(f"c{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(names))
    rows = map_arrow(docs.select(F.col(text_col).cast("string").alias("t"), *[F.col(n).alias(f"c{i}") for i, n in enumerate(names)]), run, f"{kinds}, score double")
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
