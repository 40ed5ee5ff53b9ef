"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are hashed byte pairs and the form it has: shares of symbols, digits
and capitals, of words, word pairs and lines that repeat, and its and its words'
lengths, each laid over a logarithmic scale whose marks are the terms.  No mark means
good or bad by itself; what it tells is learned with the latent space.  Term
frequencies are damped and weighted by rarity.  The latent space is the truncated
singular value decomposition of a bounded sample of labelled texts.  Their unit
vectors and labels are broadcast (SAMPLE rows of DIMENSIONS numbers, whatever the
size of the corpus), and every text is compared with all of them by exact blocked
products; the nearest vote, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairn.llm.training import held_out, labelled

#: Labelled texts that are fitted and broadcast at most.
SAMPLE = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Similarities count by this power.
SHARPNESS = 12
PAIRS = 512
#: Marks of the scale of each measure of form, and the weight of all of them against that of byte pairs.
MARKS, FORM_WEIGHT = 12, 1.0
THRESHOLD = 0.3
BLOCK = 512

_SYMBOLS = b"#*$%&|<>@^~=+_{}[]\\/!"
_CLASS = np.zeros(256, np.uint8)
for _c in _SYMBOLS:
    _CLASS[_c] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
MEASURES = 11
FORMS = MEASURES * MARKS


def measures(raw: bytes, buf: np.ndarray) -> list[float]:
    """The form of a text, each measure from 0 to 1 on a logarithmic scale."""
    words = raw.split()
    n = max(1, len(words))
    kind = np.bincount(_CLASS[buf], minlength=4) / max(1, len(buf))
    same = sum(map(bytes.__eq__, words[:-1], words[1:])) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / max(1, len(lines))
    pairs = max(1, len(words) - 1)
    twice = 1 - len(set(zip(words[:-1], words[1:], strict=True))) / pairs
    kinds = np.log1p(len(set(words))) / np.log1p(n)  # of a text of any length alike
    shares = [kind[1], kind[2], kind[3], same, again, twice, 1 - kinds]
    sizes = [n, len(buf) / n, max(map(len, words), default=0), len(lines)]
    return [np.log2(1 + 1023 * x) / 10 for x in shares] + [min(1.0, np.log2(1 + x) / 14) for x in sizes]


def terms(raw: bytes) -> np.ndarray:
    """Damped counts of a text's byte pairs, and the marks of its form, each measure dealt to the two beside it."""
    out = np.zeros(PAIRS + FORMS, np.float32)
    buf = np.frombuffer(raw, np.uint8)
    if len(buf) > 1:
        for a in range(0, len(buf) - 1, 1 << 20):
            part = buf[a : a + (1 << 20) + 1].astype(np.uint32)
            code = (part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(23)
            out[:PAIRS] += np.bincount(code & (PAIRS - 1), minlength=PAIRS)
        out[:PAIRS] = np.log1p(out[:PAIRS] * (2000 / len(buf)))
    for k, x in enumerate(measures(raw, buf)):
        low, part = divmod(min(x, 1.0) * (MARKS - 1), 1)
        at = PAIRS + k * MARKS + int(low)
        out[at] = 1 - part
        if part:
            out[at + 1] = part
    return out


def features(texts: list[bytes]) -> np.ndarray:
    return np.stack([terms(t) for t in texts]) if texts else np.zeros((0, PAIRS + FORMS), np.float32)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` greatest of each row, of equals the first ones."""
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, at, axis=1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((near >= least).sum(axis=1) > k):
        at[row] = np.argsort(-near[row], kind="stable")[:k]
    return at


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rate = float((y.sum() + 1) / (len(y) + 2))
        self.labels = y.astype(np.float32)
        seen = (x > 0).sum(axis=0)
        self.weight = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 0.1
        self.mean = np.zeros(x.shape[1], np.float32)
        if len(x):
            x = self._weighted(x)
            self.mean = x.mean(axis=0)
            _, values, basis = np.linalg.svd((x - self.mean).T @ (x - self.mean))
            self.basis = basis[: min(DIMENSIONS, len(x))].T.astype(np.float32)
            self.vectors = self._units(x)

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        x = x * self.weight
        for part, weight in ((x[:, :PAIRS], 1.0), (x[:, PAIRS:], FORM_WEIGHT)):
            part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return x

    def _units(self, x: np.ndarray) -> np.ndarray:
        v = (x - self.mean) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.rate)
        out = np.empty(len(texts))
        for a in range(0, len(texts), BLOCK):
            v = self._units(self._weighted(features(texts[a : a + BLOCK])))
            near = v @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            at = nearest(near, k)
            w = np.maximum(np.take_along_axis(near, at, axis=1), 1e-6) ** SHARPNESS
            out[a : a + BLOCK] = ((w * self.labels[at]).sum(axis=1) + 1e-9 * self.rate) / (w.sum(axis=1) + 1e-9)
        return np.clip(out, 0, 1)


def learn(train: DataFrame) -> Model:
    """The model of at most SAMPLE rows of (text, label); their counts, not their texts, come to the driver."""
    def count(batches):
        for batch in batches:
            x = features([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "label"])

    # in the order of what is counted, so that equal neighbours vote alike whatever order the rows came in
    rows = train.mapInArrow(count, "x binary, label int").toArrow().sort_by([("x", "ascending"), ("label", "ascending")])
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, PAIRS + FORMS)
    return Model(x, rows["label"].to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: better), predicted.

    ``labels`` has the ids as doc_id.  Null and empty texts are scored as empty ones;
    without labelled rows every text gets one half.  Repeated rows each come back
    with equal scores; of neighbours equally near, those first in the order of what is counted of them vote; a
    null id is never held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(labelled(docs, labels, "quality", sample, id_col, text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores = np.concatenate([model.value.score([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)[a : a + BLOCK]]) for a in range(0, batch.num_rows, BLOCK)] or [np.array([])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
