"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line is good or bad. A line's score depends on its own features and those of the lines before and after it; a
2 x 2 table scores neighbouring labels. Forward-backward gives each line's probability of being good, and their mean,
weighted by line length, is the text's quality.

Only documents are labelled, so line labels are latent. A document's label says how much of its text is good: MOSTLY_GOOD
or more under label 1, MOSTLY_BAD or less under label 0. Training is expectation maximisation under these constraints
(posterior regularisation): the expected labels are those of the model's own chain, tilted by one multiplier a document
until the constraint holds, and not at all where it holds already. So lines of a bad document that look like those of good
documents come out good. Likelihood and gradient are exact, over a bounded sample on the driver: at most SAMPLE_DOCS
labelled documents, whole, of at most SAMPLE_LINES lines together.

Scoring is a map over whole texts: rows of a batch run through forward-backward together, ordered by their number of lines;
long texts by a scan of 2 x 2 products instead, whose steps are the logarithm of their lines.

Features see the text alone: never labels, language, source or id.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Labelled documents that a model is fit on at most, and lines of all of them; their features are all that reaches the driver.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 400_000
#: Share of a text that is good: at least so much under label 1, at most so much under label 0.
MOSTLY_GOOD, MOSTLY_BAD = 0.9, 0.4
#: Texts of more lines are scanned by doubling steps.
LONG = 2000
GOOD = 0.7
N_BASE = 16
STEPS, RATE, RIDGE, TILT = 150, 0.1, 1e-3, 2.0
_SYMBOLS, _DIGITS, _UPPER, _PAUSES = b"#*$%&|<>", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?"
_HIGH = bytes(range(128, 256))


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Own features of every line, and line lengths (at least 1): a text has one line or more."""
    raw = text.encode("utf-8", "replace").split(b"\n")
    worded = [line.split() for line in raw]
    seen = Counter(line for line in raw if line.strip())
    flat = [w for ws in worded for w in ws]
    grams = [hash(g) for g in zip(flat, flat[1:], flat[2:], flat[3:])]
    again = Counter(grams)
    repeated = np.cumsum([0] + [again[g] > 1 for g in grams])
    out, at = np.zeros((len(raw), N_BASE)), 0
    for i, (line, words) in enumerate(zip(raw, worded)):
        n, size = len(words), len(line) or 1
        share = lambda chars: 1 - len(line.translate(None, chars)) / size
        if not line.strip():
            out[i, 0] = 1
            continue
        lo, hi = min(at, len(repeated) - 1), min(at + n, len(repeated) - 1)
        out[i, 1:] = (
            np.log1p(size), np.log1p(n), min(40, size / n), share(_SYMBOLS), share(_DIGITS), share(_UPPER), share(_HIGH), share(_PAUSES),
            line.rstrip()[-1:] in b".!?", line.lstrip()[:1].isupper(), len(set(words)) / n, seen[line] > 1, (repeated[hi] - repeated[lo]) / max(1, hi - lo),
            b"|" in line, sum(map(len, words)) / n > 12,
        )
        at += n
    return out, np.array([len(line) or 1 for line in raw], float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before, those of the line after, and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.hstack([own, before, after, np.ones((len(own), 1))])


@dataclass
class LineCrf:
    """weights: of the good label, bad is 0; moves: scores of (label, next label); mean and scale of the own features."""

    weights: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def _x(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.vstack([with_neighbours((own - self.mean) / self.scale) for own in texts])

    def marginals(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of good for every line of every text, from own features."""
        if not texts:
            return []
        sizes = np.array([len(t) for t in texts])
        scores = np.split(self._x(texts) @ self.weights, np.cumsum(sizes)[:-1])
        out = [scan_chain(s, self.moves) if len(s) > LONG else None for s in scores]
        short = [i for i, found in enumerate(out) if found is None]
        if short:
            good = forward_backward(np.concatenate([scores[i] for i in short]), self.moves, sizes[short])[0]
            for i, part in zip(short, np.split(good, np.cumsum(sizes[short])[:-1])):
                out[i] = part
        return out


def forward_backward(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for every line, and expected counts of (label, next label); scores: of good, text after text."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]))]  # texts longer than t
    emit, table = _factors(scores, moves)
    ahead = np.zeros_like(emit)
    for t, n in enumerate(active):
        at = starts[:n] + t
        a = emit[at] if t == 0 else emit[at] * (ahead[at - 1] @ table)
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    back, pairs = np.ones_like(emit), np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        into = emit[at] * back[at]
        b = into @ table.T
        joint = ahead[at - 1][:, :, None] * table[None] * into[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[at - 1] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), pairs


def _factors(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(np.stack([np.minimum(0, -scores), np.minimum(0, scores)], axis=1)), np.exp(moves - moves.max())


def scan_chain(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of good for every line of one text: products of the lines' 2 x 2 steps over 1, 2, 4, ... lines."""
    emit, table = _factors(scores, moves)
    step = table[None] * emit[:, None, :]
    step[0] = emit[0]  # the first line has none before it: both rows alike
    ahead, back, shift = step.copy(), step.copy(), 1
    while shift < len(scores):
        joined = ahead[:-shift] @ ahead[shift:]
        ahead[shift:] = joined / joined.max(axis=(1, 2), keepdims=True)
        joined = back[:-shift] @ back[shift:]
        back[:-shift] = joined / joined.max(axis=(1, 2), keepdims=True)
        shift *= 2
    after = np.ones_like(emit)
    after[:-1] = back[1:].sum(axis=2)
    both = ahead[:, 0, :] * after
    return both[:, 1] / both.sum(axis=1)


def fit(texts: list[np.ndarray], labels: list[int], lengths: list[np.ndarray] | None = None) -> LineCrf:
    """Latent line labels by constrained expectation maximisation (see the module), with a ridge, by Adam.

    lengths: of the lines, which weigh a document's share of good text; all alike by default.
    """
    own = np.vstack(texts)
    mean, scale = own.mean(axis=0), own.std(axis=0)
    scale[scale < 1e-8] = 1
    model = LineCrf(np.zeros(3 * N_BASE + 1), np.zeros((2, 2)), mean, scale)
    x, sizes = model._x(texts), np.array([len(t) for t in texts])
    starts, y = np.cumsum(sizes) - sizes, np.array(labels, float)
    weights = np.concatenate([np.ones(n) for n in sizes] if lengths is None else lengths)
    weights = weights / np.repeat(np.add.reduceat(weights, starts), sizes)
    bound, sign = np.where(y > 0, MOSTLY_GOOD, MOSTLY_BAD), np.where(y > 0, 1.0, -1.0)
    # a line's tilt is its document's multiplier times its share of the text, in lines of average length
    line_weight, tilt = weights * np.repeat(sizes, sizes), np.full(len(texts), 1.0)
    params = np.zeros(len(model.weights) + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, moves = params[:-4], params[-4:].reshape(2, 2)
        scores = x @ w
        good, pairs = forward_backward(scores, moves, sizes)
        held, seen = forward_backward(scores + np.repeat(tilt * sign, sizes) * line_weight, moves, sizes)
        # a multiplier grows while its constraint is broken and shrinks to nothing while it holds
        tilt = np.clip(tilt + TILT * sign * (bound - np.add.reduceat(held * weights, starts)), 0, 20)
        gradient = np.concatenate([x.T @ (held - good), (seen - pairs).ravel()]) / len(texts) - RIDGE * params
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        params = params + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.moves = params[:-4], params[-4:].reshape(2, 2)
    return model


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES
) -> LineCrf | float:
    """A model from the labelled rows of docs, at most sample of them (those with the smallest key hashes).

    Of rows that share a key one is used, the one with the smallest text hash; of labels that do, the smallest. Texts are
    used whole, in the order of their keys' hashes as long as they have no more than ``lines`` lines together; one that goes
    beyond is left out, and the next that fits is used. Where labels are missing or all alike there is nothing to tell apart: the
    share of label 1 is returned, 0.5 for none.
    """
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.col(label).cast("int")).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__key"), "__key").limit(sample)  # so many rows at most: small enough to broadcast
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key")
    rows = rows.groupBy("__key", "__label").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"))
    # numbers of lines alone come here first, at most sample of them
    n_lines = F.size(F.split(F.coalesce("__text", F.lit("")), "\n", -1))
    fitting, total = [], 0
    for r in rows.select("__key", n_lines.alias("n")).orderBy(F.xxhash64("__key"), "__key").collect():
        if total + r["n"] <= lines:
            fitting.append((r["__key"],))
            total += r["n"]
    used = docs.sparkSession.createDataFrame(fitting, f"__key {dict(docs.dtypes)[key]}")
    rows = rows.join(F.broadcast(used), "__key")

    def body(keys, texts, ys):
        for k, t, y in zip(keys, texts, ys):
            own, sizes = line_features(t or "")
            yield k, y, own.astype("<f4").tobytes(), sizes.astype("<f4").tobytes()

    got = map_rows(rows, ["__key", "__text", "__label"], f"key {dict(docs.dtypes)[key]}, label int, own binary, sizes binary", body).collect()
    got.sort(key=lambda r: (r["key"], r["label"], bytes(r["own"])))
    ys = [r["label"] for r in got]
    if len(set(ys)) < 2:
        return float(np.mean(ys)) if ys else 0.5
    floats = lambda raw: np.frombuffer(bytes(raw), "<f4").astype(float)
    return fit([floats(r["own"]).reshape(-1, N_BASE) for r in got], ys, [floats(r["sizes"]) for r in got])


def score_texts(docs: DataFrame, model: LineCrf | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (length-weighted probability of good lines) and line_good (of each line) for every row.

    A null text counts as empty: one empty line. Repeated rows stay repeated; other columns are dropped; an empty table
    gives none. A constant instead of a model is every line's probability.
    """

    def body(keys, texts):
        found = [line_features(t or "") for t in texts]
        good = [np.full(len(f), model) for f, _ in found] if isinstance(model, float) else model.marginals([f for f, _ in found])
        return [(k, float(np.clip((g * w).sum() / w.sum(), 0, 1)), g.tolist()) for k, g, (_, w) in zip(keys, good, found)]

    schema = f"{key} {dict(docs.dtypes)[key]}, score double, line_good array<double>"
    return map_rows(docs.withColumns({"__key": F.col(key), "__text": F.col(text)}), ["__key", "__text"], schema, body)


def held_out(key: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_quality_score(spark, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of the labelled rows that are not held out; null texts are one empty line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
