"""Quality classifier: Bradley-Terry ranking of documents.

Pairs of a document labelled 1 and one labelled 0 are preferences; the weights
minimise the logistic loss of the differences of their features (Newton steps on
the driver over a bounded sample of labelled rows).  The threshold is the exact
quantile of the raw scores of all labelled rows at their share of label 0, found
from counts over ever narrower ranges; scores are logistic in the raw score and
equal ``cut`` at the threshold.

Features are taken from whole texts, in numpy over a batch of texts: shares of
classes of bytes, repeated words, word and line lengths.

Defined cases: null and empty texts get the features of a text without words;
labels that are null, or other than 0 and 1, are ignored; an id that several rows of
the labels repeat counts as often in the threshold; without labels of both kinds every
score is 0.5; other columns are ignored or handed through, and ``with_quality`` raises
ValueError where one has the name of its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewire.llm.common import pieces, texts, written
from tidewire.llm.sampling import labelled_texts
from tidewire.llm.words import Hasher, Words

#: Labelled rows that are read into the fit, of each label.
SAMPLE_PER_LABEL = 8_000
PAIRS = 40_000
#: Bytes of text that are worked on at once.
PIECE_BYTES = 1 << 20
#: Bins of a range of scores, and scores that are sorted on the driver.
BINS, SORTED = 4_096, 10_000
_KINDS = ["lower", "upper", "digit", "space", "line", "stop", "bang", "bar", "mark", "quote", "other", "high"]


def _kind_table() -> np.ndarray:
    out = np.full(256, _KINDS.index("other"), dtype=np.int64)
    out[128:] = _KINDS.index("high")
    groups = {"lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:?", "bang": b"!", "bar": b"|<>{}[]\\/=_", "mark": b"$%&#*@^~+", "quote": b"'\"()-`"}
    for name, members in groups.items():
        out[list(members)] = _KINDS.index(name)
    return out


_KIND = _kind_table()
N_FEATURES = len(_KINDS) + 7


def features(batch: list[bytes], hasher: Hasher) -> np.ndarray:
    """One row of N_FEATURES numbers per text."""
    n = len(batch)
    sizes = np.fromiter(map(len, batch), np.int64, n)
    raw = np.frombuffer(b"".join(batch), dtype=np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(doc * len(_KINDS) + _KIND[raw], minlength=n * len(_KINDS)).reshape(n, -1)
    w = Words(batch, hasher)
    counts = np.diff(w.first)
    some = np.maximum(counts, 1)
    every = np.arange(len(w))
    h = w.hashes(every, 1) if len(w) else np.zeros(0, dtype=np.uint64)
    same = np.zeros(len(w), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((h, w.doc))
    new = np.ones(len(w), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=n)
    lengths = np.bincount(w.doc, weights=w.ends - w.starts, minlength=n)
    tail = w.data[np.maximum(w.ends - 1, 0)]
    marked = np.bincount(w.doc, weights=np.isin(_KIND[tail], [_KINDS.index(x) for x in ("bang", "mark", "bar")]), minlength=n)
    extra = np.stack(
        [
            np.bincount(w.doc, weights=same, minlength=n) / some,
            distinct / some / (1 + np.log1p(counts)) * 8,
            np.log1p(counts) / 10,
            np.minimum(lengths / some, 30) / 10,
            marked / some,
            kinds[:, _KINDS.index("upper")] / np.maximum(1, kinds[:, _KINDS.index("upper")] + kinds[:, _KINDS.index("lower")]),
            np.minimum(counts / (1.0 + kinds[:, _KINDS.index("line")]), 100) / 100,
        ],
        axis=1,
    )
    return np.hstack([np.sqrt(kinds / np.maximum(sizes, 1)[:, None]), extra])


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int, l2: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the Bradley-Terry model, and the threshold of the raw scores of these rows."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return weights, float("nan")
    rng = np.random.default_rng(seed)
    d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    scale = d.std(axis=0) + 1e-6
    d = d / scale
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -40, 40)))
        gradient = l2 * weights - d.T @ p / pairs
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(weights)), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    weights = weights / scale
    raw = x @ weights
    return weights, float(np.quantile(raw, len(bad) / len(y), method="median_unbiased"))


def _row_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES):
            x = features(texts(part.column("text")), hasher)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], ["label", "x"])


def fit_weights(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_label: int = SAMPLE_PER_LABEL) -> np.ndarray | None:
    """Weights of the features from a sample of the labelled rows; None without labels of both kinds."""
    got = labelled_texts(docs, labels, id_col, text_col, label_col, sample_per_label).mapInArrow(_row_features, "label int, x array<double>").toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES) if got.num_rows else np.zeros((0, N_FEATURES))
    y = np.asarray(got["label"])
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order in which tasks end
    weights, threshold = fit_pairs(x[order], y[order], PAIRS)
    return None if np.isnan(threshold) else weights


def raw_scores(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and raw of every row, written."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(own.mapInArrow(_raw_scores(weights), StructType([own.schema["doc_id"], StructField("raw", DoubleType())])), "scores")


def threshold_of(raw: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """The quantile of the raw scores of all labelled rows at their share of label 0.

    The sample of the fit holds labels in other shares than the corpus, so all labelled
    rows decide.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    return _threshold(written(raw.join(rows, "doc_id").select("raw", "label"), "labelled-scores"))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, float]:
    """Weights and threshold from the texts of ``docs`` whose ids are in ``labels``."""
    weights = fit_weights(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_per_label=sample_per_label)
    if weights is None:
        return np.zeros(N_FEATURES), float("nan")
    raw = raw_scores(docs.where(F.col(id_col).isNotNull()), weights, id_col=id_col, text_col=text_col)
    return weights, threshold_of(raw, labels, id_col=id_col, label_col=label_col)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """doc_id and score of every row; the texts are scored once, for the threshold and the result."""
    weights = fit_weights(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    if weights is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.5).alias("score"))
    raw = raw_scores(docs, weights, id_col=id_col, text_col=text_col)
    threshold = threshold_of(raw, labels, id_col=id_col, label_col=label_col)
    moved = F.least(F.greatest(F.col("raw") - F.lit(threshold) + F.lit(float(np.log(cut / (1 - cut)))), F.lit(-40.0)), F.lit(40.0))
    return raw.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-moved))).alias("score"))


def _raw_scores(weights: np.ndarray) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(features(texts(part.column("text")), hasher) @ weights)], ["doc_id", "raw"])

    return score


def _threshold(scores: DataFrame) -> float:
    """The median-unbiased quantile of ``raw`` at the share of label 0."""
    n, bad = scores.agg(F.count("*"), F.count_if(F.col("label") == 0)).first()
    place = min(max((n + 1 / 3) * bad / n + 1 / 3, 1), n)
    below = nth(scores, int(place))
    above = nth(scores, min(int(place) + 1, n))
    return below + (place - int(place)) * (above - below)


def nth(scores: DataFrame, rank: int) -> float:
    """The rank-th smallest (from 1) of the column ``raw``; a range is counted in bins until few values are left."""
    rest, x = scores.select("raw"), F.col("raw")
    while True:
        n, low, high = rest.agg(F.count("*"), F.min("raw"), F.max("raw")).first()
        if low == high:
            return low
        if n <= SORTED:
            return float(np.sort(rest.toArrow()["raw"].to_numpy())[rank - 1])
        place = F.least(F.floor((x - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1))
        seen = sorted(tuple(r) for r in rest.groupBy(place.alias("place")).agg(F.count("*")).collect())
        for b, many in seen:
            if rank <= many:
                rest = rest.where(place == b)
                break
            rank -= many


def _scorer(weights: np.ndarray, threshold: float, cut: float, text_col: str, out_col: str) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in pieces(batch, text_col, PIECE_BYTES):
                if np.isnan(threshold):
                    s = np.full(part.num_rows, 0.5)
                else:
                    raw = features(texts(part.column(text_col)), hasher) @ weights - threshold + np.log(cut / (1 - cut))
                    s = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
                yield part.append_column(pa.field(out_col, pa.float64()), pa.array(s))

    return score


def with_quality(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", out_col: str = "__tw_score", cut: float = 0.3) -> DataFrame:
    """``docs`` with the score as ``out_col``; a row passes if its score is at least ``cut``."""
    if out_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"{out_col} is a column of the input")
    schema = StructType([*docs.schema.fields, StructField(out_col, DoubleType())])
    return docs.mapInArrow(_scorer(*model, cut, text_col, out_col), schema)
