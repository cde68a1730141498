"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows: one on windows of ordinary text, one on the passages of toxic texts whose
byte sequences are far more usual in toxic than in ordinary documents. The toxic dictionary is used together with the
ordinary one, so that ordinary text compresses alike with both; what a window saves by the toxic dictionary is its distance. A document is scored from the
distances of all windows of its whole text by a logistic curve whose weights are fitted on labelled rows that
the dictionaries have not seen, and shifted so that the threshold is where the F1 score of those rows is best.

Only labels of rows whose CRC-32 of the id modulo 4 is not 2 are used, and of those a sample bounded by ``TOXIC_ROWS`` and
``ORDINARY_ROWS`` (the first by a hash of the id) is brought to the driver; scoring covers every row and is narrow.

Edge cases: a null text is empty; an empty text has one empty window; labels without toxic or without ordinary rows give every document the
share of toxic labels (0 without labels); labelled ids that are missing or repeated in the documents are left out or used as often as they occur; repeated rows get equal
scores; columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOXIC_ROWS = 1_500
ORDINARY_ROWS = 5_000
THRESHOLD = 0.3
WINDOW = 64
GRAM = 5
LIFT = 4
SURPRISE = 5
ORDINARY_BYTES = 64_000
TOXIC_BYTES = 4_096


def held_out(row_id: Column) -> Column:
    return F.crc32(row_id.cast("string").cast("binary")) % 4 == 2


def _windows(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text)), WINDOW)]


def _grams(text: bytes) -> np.ndarray:
    """All sequences of ``GRAM`` bytes as numbers, A-Z lower-cased."""
    letters = np.frombuffer(text.lower(), np.uint8).astype(np.uint64)
    n = len(letters) - GRAM + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        out = (out << np.uint64(8)) | letters[k : k + n]
    return out


def _document_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    grams = [np.unique(_grams(t)) for t in texts]
    return np.unique(np.concatenate([*grams, np.zeros(0, np.uint64)]), return_counts=True)


def _marked_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The passages of toxic texts that consist of byte sequences with a high lift."""
    gram, n_toxic = _document_counts(toxic)
    often = n_toxic >= max(3, len(toxic) // 100)
    gram, n_toxic = gram[often], n_toxic[often]
    n_ordinary = np.zeros(len(gram))
    for t in ordinary if len(gram) else ():
        own = np.unique(_grams(t))
        at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
        n_ordinary[at[gram[at] == own]] += 1
    expected = len(toxic) * (n_ordinary + 0.5) / len(ordinary)
    marked = gram[(n_toxic >= LIFT * expected) & (n_toxic - expected >= SURPRISE * np.sqrt(expected + 1))]
    out = []
    for text in toxic:
        edge = np.diff(np.concatenate([[False], np.isin(_grams(text), marked), [False]]).astype(np.int8))
        out += [text[a : b + GRAM - 1] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return out


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; with too little text for the training the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=18, hash_log=16, chain_log=16, search_log=4,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)


class Distances:
    """Features of a text from the distances of its windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic + ordinary)

    def features(self, text: bytes) -> np.ndarray:
        ordinary, toxic = self.ordinary.compress, self.toxic.compress
        d = np.array([len(ordinary(w)) - len(toxic(w)) for w in _windows(text)], float)
        top = np.sort(d)[-3:]
        return np.array([d.max(), d.mean(), top.mean(), (d >= 2).mean(), (d >= 3).mean(), np.log1p((d >= 3).sum()), np.log1p(len(d))])


@dataclass(frozen=True)
class Model:
    """Dictionaries and the logistic curve; without dictionaries every score is ``share``."""

    share: float
    ordinary: bytes = b""
    toxic: bytes = b""
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        distances = Distances(self.ordinary, self.toxic)
        rows = np.array([distances.features(t) for t in texts]).reshape(len(texts), -1)
        return _curve(_design(rows, self.center, self.scale) @ self.weights)


def _curve(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _design(rows: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([(rows - center) / scale, np.ones(len(rows))])


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _curve(x @ w)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - w)
    return w


def fit(texts: list[bytes], toxic: np.ndarray, totals: tuple[int, int]) -> Model:
    """Model from labelled texts in random order; ``totals`` are the ordinary and toxic labels they stand for."""
    share = totals[1] / max(1, sum(totals))
    if toxic.sum() < 2 or (~toxic).sum() < 2:
        return Model(share)
    # Two of three rows train the dictionaries, the third ones the curve; each class is dealt by itself.
    place = np.zeros(len(texts), np.int64)
    for group in (toxic, ~toxic):
        place[group] = np.arange(group.sum())
    curve_rows = place % 3 == 1
    own = [[t for t, y, c in zip(texts, toxic, curve_rows) if y == kind and not c] for kind in (False, True)]
    passages = _marked_passages(own[1], own[0]) or [w for t in own[1] for w in _windows(t)]
    ordinary = _dictionary([w for t in own[0] for w in _windows(t)], ORDINARY_BYTES, WINDOW)
    model = Model(share, ordinary, _dictionary(passages * 3, TOXIC_BYTES, 16))
    distances = Distances(model.ordinary, model.toxic)
    rows = np.array([distances.features(t) for t, c in zip(texts, curve_rows) if c])
    y = toxic[curve_rows].astype(float)
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum())
    weight *= len(y) / weight.sum()
    center, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    design = _design(rows, center, scale)
    weights = _fit_curve(design, y, weight)
    score = design @ weights
    order = np.argsort(-score)
    hits, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hits / (all_ + (weight * y).sum())))
    cut = score[order[best : best + 2]].mean()
    weights[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return Model(share, model.ordinary, model.toxic, center, scale, weights)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Model from the labelled rows that are not held out; a bounded sample of them reaches the driver."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = [
        known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for kind, n in ((0, ordinary_rows), (1, toxic_rows))
    ]
    # Bounded by the two limits, hence the broadcast.
    wanted = F.broadcast(ids[0].unionByName(ids[1]).withColumnRenamed("doc_id", "labelled_id"))
    sample = (
        docs.select(F.col(row_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
        .join(wanted, F.col("id") == F.col("labelled_id")).orderBy(F.xxhash64("id"), "id", "text").limit(toxic_rows + ordinary_rows)
        .select("text", "toxic").collect()
    )
    return fit([bytes(r.text) for r in sample], np.array([r.toxic == 1 for r in sample], bool), (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted."""
    docs = docs.drop(*[c for c in ("score", "predicted") if c != text])
    names, index = docs.columns, docs.columns.index(text)
    # Plain values: a broadcast of an own class would need this package on the workers.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(parts):
        known = Model(*shared.value)
        for part in parts:
            for start in range(0, part.num_rows, 1000):
                own = part.slice(start, 1000)
                found = known.scores([(x or "").encode() for x in own.column(index).to_pylist()])
                added = [pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own.columns, *added], [*names, "score", "predicted"])

    schema = T.StructType(list(docs.schema.fields)).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.mapInArrow(run, schema)


def keep_ordinary(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns only."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("scored_text"))
    return score(rows, model, "scored_text").filter("predicted = 0").select("row.*")
