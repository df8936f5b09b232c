"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes.

Whether a hashed n-gram of characters occurs in a text is a binary feature, scaled by
the log of the ratio of its smoothed shares among toxic and other labelled texts; a
logistic regression over the scaled features (Newton with conjugate gradients, on a
bounded sample of labelled rows) gives the score.  How many texts of each label hold an
n-gram is a grouped count; only n-grams whose shares differ by ``CLEAR`` standard
errors are features, so that the model stays small and long texts gather no noise, and
only these reach the driver.  Whole texts are scored: every position is looked up in
the model's table.

Defined cases: null and empty texts have no n-grams and get the intercept's score;
letters count in lower case, and characters beyond ASCII as one each; labels that are
null, or other than 0 and 1, are ignored; without labels of both kinds every score is
0; other columns are ignored or handed through, and ``with_toxicity`` raises ValueError
where one has the name of its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewire.llm.common import pieces, written
from tidewire.llm.sampling import labelled_texts

#: Labelled rows that are read into the fit, of each label.
SAMPLE_PER_LABEL = 5_000
BUCKET_BITS = 22
SIZES = (4, 5, 6)
#: Standard errors between the shares of a feature, and texts that hold it, at least.
CLEAR, LEAST_TEXTS = 4.5, 3
#: Bytes of text that are worked on at once.
PIECE_BYTES = 1 << 20
#: Tasks that count the sample; each hands on one row per n-gram it has seen.
FIT_TASKS = 8
_SPACES = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def strings(column: pa.Array) -> list[str]:
    """Each row's text in lower case, separators as spaces; null counts as empty."""
    return [(x or "").lower().translate(_SPACES) for x in column.to_pylist()]


def grams(batch: list[str]) -> tuple[Iterator[np.ndarray], np.ndarray]:
    """For one size after the other, buckets of the n-grams at each position; and each text's first position.

    Texts have a space before and after; positions whose n-gram runs over a text's
    end hold -1.
    """
    joined = "".join(f" {t} " for t in batch)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 2 for t in batch), np.int64, len(batch)))])

    def sizes() -> Iterator[np.ndarray]:
        h = raw
        for n in range(2, max(SIZES) + 1):
            m = max(len(raw) - n + 1, 0)
            h = (h[:m] ^ (h[:m] >> np.uint64(29))) * _STEP + raw[n - 1 :]
            if n not in SIZES:
                continue
            bucket = ((h ^ (h >> np.uint64(32))) * _STEP >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
            for back in range(1, n):
                over = first[1:] - back
                bucket[over[(over >= 0) & (over < m)]] = -1
            yield bucket

    return sizes(), first


def sample_grams(own: list[str]) -> list[np.ndarray]:
    """The sorted distinct buckets of each text."""
    found, first = grams(own)
    codes = [np.zeros(0, dtype=np.int64)]
    for h in found:
        doc = np.repeat(np.arange(len(own)), np.diff(np.minimum(first, len(h))))
        codes.append((doc << BUCKET_BITS | h.astype(np.int64))[h >= 0])
    once = np.unique(np.concatenate(codes))
    ends = np.searchsorted(once, np.arange(len(own) + 1) << BUCKET_BITS)
    found = (once & (1 << BUCKET_BITS) - 1).astype("<i4")
    return [found[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, and the texts of label 1 and of label 0 that hold it."""
    seen = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int32)
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES):
            for label, row in zip(part.column("label").to_pylist(), sample_grams(strings(part.column("text"))), strict=True):
                seen[label, row] += 1
    some = np.flatnonzero(seen.any(axis=0))
    for a in range(0, len(some), 100_000):
        at = some[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(seen[k, at]) for k in (1, 0))], ["bucket", "c1", "c0"])


def _kept_only(kept: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                rows = [(f := place[g])[f >= 0].astype("<i4").tobytes() for g in sample_grams(strings(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(rows, pa.binary())], ["label", "features"])

    return run


def clear_features(counts: DataFrame, n1: int, n0: int, clear: float = CLEAR) -> DataFrame:
    """Of counts (bucket, c1, c0), those of features."""
    p, q, pooled = F.col("c1") / n1, F.col("c0") / n0, (F.col("c1") + F.col("c0")) / (n1 + n0)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    return counts.where((F.col("c1") + F.col("c0") >= LEAST_TEXTS) & (F.abs(p - q) > clear * error))


def log_ratios(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    return np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))


def fit_scaled(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of the features (log-count ratio times coefficient) and the intercept; rows hold places of features."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    cols = np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    w, b = np.zeros(len(ratio)), 0.0

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=(ratio * v)[cols], minlength=len(rows))

    def back(r: np.ndarray) -> np.ndarray:
        return ratio * np.bincount(cols, weights=r[at], minlength=len(ratio))

    for _ in range(12):
        s = 1 / (1 + np.exp(-np.clip(times(w) + b, -30, 30)))
        g, gb = back(balance * (s - y)) + l2 * w, float((balance * (s - y)).sum())
        curve = balance * np.maximum(s * (1 - s), 1e-4)
        d, r, db, rb = np.zeros_like(w), -g, 0.0, -gb
        pv, pb, size = r.copy(), rb, r @ r + rb * rb
        for _ in range(25):
            u = curve * (times(pv) + pb)
            hv, hb = back(u) + l2 * pv, float(u.sum())
            step = size / max(pv @ hv + pb * hb, 1e-12)
            d, db, r, rb = d + step * pv, db + step * pb, r - step * hv, rb - step * hb
            again = r @ r + rb * rb
            if again < 1e-8:
                break
            pv, pb, size = r + again / size * pv, rb + again / size * pb, again
        w, b = w + d, b + db
        if np.abs(d).max(initial=0) < 1e-3:
            break
    return ratio * w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_per_label: int = SAMPLE_PER_LABEL, clear: float = CLEAR) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets of the features, their weights and the intercept, from the texts of ``docs`` whose ids are in ``labels``."""
    sample = written(labelled_texts(docs, labels, id_col, text_col, label_col, sample_per_label).coalesce(FIT_TASKS), "labelled-texts")
    many = dict(sample.groupBy("label").agg(F.count("*")).collect())
    n1, n0 = many.get(1, 0), many.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, dtype=np.int64), np.zeros(0), float("-inf")
    counts = sample.mapInArrow(_partial_counts, "bucket int, c1 int, c0 int").groupBy("bucket").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    found = clear_features(counts, n1, n0, clear).toArrow().sort_by("bucket")
    kept = found["bucket"].to_numpy().astype(np.int64)
    got = sample.mapInArrow(_kept_only(kept), "label int, features binary").toArrow()
    order = sorted(zip(got["label"].to_pylist(), got["features"].to_pylist(), strict=True))  # the fit doesn't depend on the order in which tasks end
    weights, intercept = fit_scaled([np.frombuffer(g, "<i4") for _, g in order], np.array([y for y, _ in order]), log_ratios(found["c1"].to_numpy(), found["c0"].to_numpy(), n1, n0))
    return kept, weights, intercept


def _scores(own: list[str], place: np.ndarray, weights: np.ndarray, intercept: float) -> np.ndarray:
    """Of each text; ``place`` leads from a bucket to its feature."""
    if not np.isfinite(intercept):
        return np.zeros(len(own))
    hits = [np.zeros(0, dtype=np.int64)]
    found, first = grams(own)
    many = max(1, len(weights))
    for h in found:
        f = place[h]
        at = np.flatnonzero((f >= 0) & (h >= 0))
        hits.append((np.searchsorted(first, at, side="right") - 1) * many + f[at])
    once = np.unique(np.concatenate(hits))
    total = intercept + np.bincount(once // many, weights=weights[once % many] if len(once) else None, minlength=len(own))[: len(own)]
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _scorer(model: tuple[np.ndarray, np.ndarray, float], text_col: str, out_col: str, keep: str | None) -> Callable:
    kept, weights, intercept = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            for part in pieces(batch, text_col, PIECE_BYTES):
                s = pa.array(_scores(strings(part.column(text_col)), place, weights, intercept))
                yield part.append_column(pa.field(out_col, pa.float64()), s) if keep is None else pa.RecordBatch.from_arrays([part.column(keep), s], [keep, out_col])

    return score


def with_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text_col: str = "text", out_col: str = "__tw_score") -> DataFrame:
    """``docs`` with the score as ``out_col``."""
    if out_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"{out_col} is a column of the input")
    return docs.mapInArrow(_scorer(model, text_col, out_col, None), StructType([*docs.schema.fields, StructField(out_col, DoubleType())]))


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; no text comes back from the scoring."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_scorer(model, "text", "score", "doc_id"), StructType([own.schema["doc_id"], StructField("score", DoubleType())]))


def fold_losses(docs: DataFrame, labels: DataFrame, settings: list[tuple[int, float]], *, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[int, float, float, float]]:
    """(rows per label, standard errors, balanced log loss, balanced error) of each setting, over folds of the labelled rows given.

    Each fold is scored by a fit on the others, so no row outside ``labels`` is looked
    at; folds are dealt by a hash of the id.  Both figures are means over the labels, in
    which each label has the same weight; a fold whose others lack a label scores 0.
    """
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = known.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(folds)))
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id"), "toxic-folds")
    out = []
    for many, clear in settings:
        scored = None
        for k in range(folds):
            others = rows.where(F.col("fold") != k)
            model = fit_toxicity(others, others, id_col="id", label_col="label", sample_per_label=many, clear=clear)
            own = with_toxicity(rows.where(F.col("fold") == k), model).select("label", "__tw_score")
            scored = own if scored is None else scored.unionByName(own)
        right = F.when(F.col("label") == 1, F.col("__tw_score")).otherwise(1 - F.col("__tw_score"))
        sides = scored.groupBy("label").agg(F.avg(-F.log(F.greatest(right, F.lit(1e-12)))).alias("loss"), F.avg(((F.col("__tw_score") >= 0.5).cast("int") != F.col("label")).cast("int")).alias("error"))
        got = sides.agg(F.avg("loss"), F.avg("error")).first()
        out.append((many, clear, float(got[0]), float(got[1])) if got[0] is not None else (many, clear, float("nan"), float("nan")))
    return out
