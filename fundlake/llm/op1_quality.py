"""Operator 1, quality classifier: a linear-chain conditional random field over a document's lines.

Each line has shape features (letters, capitals, digits, symbols, word length, repetition, ...) of its
own and of the lines before and after it.  The field's two states are good and bad; forward-backward
gives every line's marginal, and the marginals weighted by line length give the document's share of
good text, which a one-dimensional logistic fit turns into the score.  A document's label counts as the
label of all its lines in training.  The fit uses a bounded sample of labelled rows (``MAX_DOCS``
documents of at most ``MAX_BYTES``, lowest id hash first); every whole text is scored.

Defined results: a text without lines (null, empty, only line ends) scores the share of label 1 in the
sample; without labelled rows every score is 0.5, with one kind of label only its share; repeated label
rows count once, the highest label holding; a null doc_id keeps its row and is not held out; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, spare, texts, tidy, utf8
from .shingles import words

MAX_DOCS, MAX_BYTES = 4000, 65_536
THRESHOLD = 0.3
_LINE_END = np.zeros(256, bool)
_LINE_END[[10, 13]] = True
_KIND = np.full(256, 6, np.uint8)  # 6: any other sign
_KIND[97:123] = _KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9]] = 3
for _c in b".,;:'\"-?()":
    _KIND[_c] = 4
_KIND[ord("!")] = 5
_KIND[ord("|")] = 7
FEATURES = 14
LAGS = 4  # a word counts as repeated if it stands so many words before at most


def line_features(data: np.ndarray, at: np.ndarray):
    """Features (lines x FEATURES), byte lengths of all lines, and each text's first line."""
    h, start, end, first = words(data, at, _LINE_END)
    n = (end - start).astype(np.float64)
    kind = _KIND[data]
    count = []
    for k in range(8):
        s = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == k, out=s[1:])
        count.append(s[end] - s[start])
    lower, upper, digit, space, stop, bang, sign, pipe = count
    letters = lower + upper
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.zeros(len(h))
    if len(h):
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        again[order[1:]] = same
        again[order[:-1]] = np.maximum(again[order[:-1]], same)
    w, at_word, _, _ = words(data, at)
    line = np.searchsorted(start, at_word, "right") - 1
    repeated = np.zeros(len(w), bool)
    for lag in range(1, LAGS + 1):
        repeated[lag:] |= (w[lag:] == w[:-lag]) & (line[lag:] == line[:-lag])
    stutter = np.bincount(line, repeated, len(h)) / np.maximum(1, np.bincount(line, minlength=len(h)))
    last, begin = kind[end - 1] if len(h) else np.zeros(0), kind[start] if len(h) else np.zeros(0)
    x = np.stack([np.log1p(n) / 6, upper / (letters + 1), digit / n, space / n, stop / n, bang / n, sign / n, pipe / n,
                  n / (space + 1) / 10, again, last == 4, begin == 0, (sign + pipe + bang) / (space + 1),
                  stutter], 1) if len(h) else np.zeros((0, FEATURES))
    return x, n, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bias, own features, and the previous and the next line's (zeros beyond a text's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    begins = first[:-1][np.diff(first) > 0]
    ends = first[1:][np.diff(first) > 0] - 1
    before[begins] = after[ends] = 0
    edge = np.zeros((len(x), 2))
    edge[begins, 0] = edge[ends, 1] = 1
    return np.concatenate([np.ones((len(x), 1)), x, before, after, edge], 1)


def forward_backward(emit: np.ndarray, first: np.ndarray, init: np.ndarray, trans: np.ndarray):
    """Log alpha and beta (lines x 2) of all texts at once, position by position; emit is the score
    of state 1 (state 0 scores 0)."""
    e = np.stack([np.zeros_like(emit), emit], 1)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than t
    for t in range(steps):
        i = begin[:active[t]] + t
        alpha[i] = e[i] + (init if t == 0 else np.logaddexp(alpha[i - 1, :1] + trans[0], alpha[i - 1, 1:] + trans[1]))
    for t in range(steps - 2, -1, -1):
        i = begin[:active[t + 1]] + t
        ahead = e[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
    return e, alpha, beta


def marginals(emit, first, init, trans) -> np.ndarray:
    _, alpha, beta = forward_backward(emit, first, init, trans)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def weighted(p: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals for each text; nan without lines."""
    s = np.concatenate([[0], np.cumsum(p * n)])
    m = np.concatenate([[0], np.cumsum(n)])
    with np.errstate(invalid="ignore"):
        return (s[first[1:]] - s[first[:-1]]) / (m[first[1:]] - m[first[:-1]])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(lines: list[np.ndarray], sizes: list[np.ndarray], y: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> dict:
    """The field's weights from the lines' features of each document and the documents' labels."""
    rate = float(y.mean()) if len(y) else 0.5
    full = [k for k, x in enumerate(lines) if len(x)]
    if len(set(y[full].tolist())) < 2:
        return {"rate": rate}
    first = np.concatenate([[0], np.cumsum([len(lines[k]) for k in full])]).astype(np.int64)
    x = np.concatenate([lines[k] for k in full])
    mean, sd = x.mean(0), x.std(0) + 1e-6
    x = with_neighbours((x - mean) / sd, first)
    label = y[full].astype(int)
    per = np.repeat(label, np.diff(first))
    weight = np.repeat(1 / np.diff(first), np.diff(first)) / len(full)  # documents weigh alike
    theta = np.zeros(x.shape[1] + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.setdiff1d(np.arange(len(x)), first[1:] - 1)  # lines with a next line
    for r in range(1, rounds + 1):
        w, init, trans = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        e, alpha, beta = forward_backward(x @ w, first, init, trans)
        z = np.logaddexp.reduce(alpha + beta, 1)
        p = np.exp(alpha + beta - z[:, None])
        pair = np.exp(alpha[inner][:, :, None] + trans + (e + beta)[inner + 1][:, None, :] - z[inner][:, None, None])
        grad = np.zeros_like(theta)
        grad[:-6] = x.T @ (weight * (p[:, 1] - per))
        grad[-6:-4] = [(weight[first[:-1]] * (p[first[:-1], s] - (label == s))).sum() for s in (0, 1)]
        seen = np.zeros_like(pair)
        seen[np.arange(len(inner)), per[inner], per[inner + 1]] = 1
        grad[-4:] = (weight[inner][:, None, None] * (pair - seen)).sum(0).ravel()
        grad += l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.999 ** r)) + 1e-8)
    model = {"rate": rate, "mean": mean, "sd": sd, "w": theta[:-6], "init": theta[-6:-4], "trans": theta[-4:].reshape(2, 2)}
    share = weighted(marginals(x @ model["w"], first, model["init"], model["trans"]), np.concatenate([sizes[k] for k in full]), first)
    a, b, t = 1.0, 0.0, _logit(share)
    for _ in range(300):  # score = logistic(a logit(share) + b)
        q = 1 / (1 + np.exp(-(a * t + b)))
        g = np.array([((q - label) * t).mean() + 1e-3 * (a - 1), (q - label).mean()])
        hess = np.array([[(q * (1 - q) * t * t).mean() + 1e-3, (q * (1 - q) * t).mean()], [(q * (1 - q) * t).mean(), (q * (1 - q)).mean() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return model | {"a": max(a, 0.05), "b": b}


def score(model: dict, x: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    if "w" not in model:
        return np.full(len(first) - 1, model["rate"])
    z = with_neighbours((x - model["mean"]) / model["sd"], first) @ model["w"]
    share = weighted(marginals(z, first, model["init"], model["trans"]), n, first)
    out = 1 / (1 + np.exp(-(model["a"] * _logit(np.nan_to_num(share, nan=0.5)) + model["b"])))
    return np.where(np.isnan(share), model["rate"], out)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> dict:
    """Fit on labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")) \
        .where("y in (0, 1) and id is not null").where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    few = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    rows = texts(docs).join(F.broadcast(few), F.col("doc_id") == F.col("id")).where(F.octet_length("text") <= max_bytes) \
        .select("doc_id", "y", "text")

    def measured(batches):
        for batch in batches:
            x, n, first = line_features(*utf8(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"),
                                   pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                                   pa.array([n[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                                  ["doc_id", "y", "x", "n"])
    got = rows.mapInArrow(tidy(measured), "doc_id long, y int, x binary, n binary").orderBy("doc_id", "x").limit(2 * max_docs).collect()
    return fit([np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(np.float64) for r in got],
               [np.frombuffer(r.n, "<f4").astype(np.float64) for r in got], np.array([r.y for r in got]))


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                s = score(model, *line_features(*utf8(part.column("text"))))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(s),
                                       pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return texts(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    def run(batches):
        for batch in batches:
            for a, b in slices(batch, name):
                part = batch.slice(a, b - a)
                s = score(model, *line_features(*utf8(part.column(name))))
                yield part.filter(pa.array(s >= threshold)).drop_columns([name])
    name = spare(docs, "text")
    return small_batches(docs).withColumn(name, F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(tidy(run), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
