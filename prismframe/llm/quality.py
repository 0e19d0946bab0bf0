"""Quality: a regularised quadratic discriminant over transformed statistics of whole texts.

Every text is read once and becomes the counts of COUNTS; their shares, square roots and logarithms are its point. Each class
is a normal density: its mean and its covariance over all labelled documents that may be learned from, the covariance shrunken
towards the diagonal of the pooled one. Sums and products are added up by Spark, so nothing is sampled and the driver gets one
row a sum. A score is the share of the good class in both densities, from the difference of the squared Mahalanobis distances, the
log determinants and the priors; the Cholesky factors are worked out once and travel with the model.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, scratch, slices

#: What is counted of a text. Short words have up to three letters; a decorated word ends with two marks; an echo is a word
#: like the one before it.
COUNTS = ("chars", "letters", "capitals", "digits", "marks", "lines", "words", "short", "wordless", "decorated", "shouted", "echoes", "distinct")
FEATURES = ("log words", "log word length", "capitals", "digits", "marks", "lines", "short", "wordless", "decorated", "shouted", "echoes", "distinct")
#: Weight of the pooled diagonal in each class's covariance, and the least variance of a feature.
SHRINK, LEAST = 0.1, 1e-4
#: Code points of a text that are looked at together; cuts are made at white space.
PIECE = 1_000_000
_SPACE, _LETTER, _CAPITAL, _DIGIT, _MARK, _LINE = range(6)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point of the basic plane; those beyond count as marks."""
    out = np.full(65_536, _MARK, np.uint8)
    for i in range(65_536):
        c = unicodedata.category(chr(i))
        if c[0] in "LM":
            out[i] = _CAPITAL if c in ("Lu", "Lt") else _LETTER
        elif c[0] == "N":
            out[i] = _DIGIT
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[0x0A] = _LINE
    return out


def pieces(text: str, most: int) -> Iterator[str]:
    """A text in runs of up to `most` code points, cut before white space where there is some in a run."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind(c, at + 1, at + most) for c in " \n")
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(COUNTS of each text but the last two, text of each word, hash of each word)."""
    lengths = np.array([len(t) + 1 for t in texts])
    code = np.frombuffer("".join(t + "\t" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(code < 65_536, _kinds()[np.minimum(code, 65_535)], _MARK)
    first = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros((len(texts), len(COUNTS)))

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.int64), first[:-1])

    letter = (kind == _LETTER) | (kind == _CAPITAL)
    space = (kind == _SPACE) | (kind == _LINE)
    for name, flag in (("letters", letter), ("capitals", kind == _CAPITAL), ("digits", kind == _DIGIT), ("marks", kind == _MARK), ("lines", kind == _LINE)):
        out[:, COUNTS.index(name)] = per_text(flag)
    out[:, 0] = lengths - 1
    begins = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
    if not len(begins):
        return out, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.nonzero(space & np.concatenate([[False], ~space[:-1]]))[0]  # every text ends with a tab
    owner = np.searchsorted(first, begins, side="right") - 1
    inside = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[np.stack([begins, ends])], axis=0)[0]
    letters, size = inside(letter), ends - begins
    mark = kind == _MARK
    decorated = (size > 1) & mark[ends - 1] & mark[np.maximum(ends - 2, 0)]
    shouted = (letters > 1) & (inside(kind == _CAPITAL) == letters)
    with np.errstate(over="ignore"):
        place = np.zeros(len(code), np.uint64)
        place[begins[0] :] = np.arange(begins[0], len(code)) - np.repeat(begins, np.diff(np.append(begins, len(code))))
        mixed = (code.astype(np.uint64) + np.uint64(1) + (place << np.uint64(32))) * _PRIME
        mixed ^= mixed >> np.uint64(29)
        mixed *= _PRIME
        mixed[space] = 0
        hashes = np.add.reduceat(mixed, begins)
    echo = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])])
    for name, flag in (("words", np.ones(len(begins))), ("short", (letters > 0) & (letters <= 3)), ("wordless", letters == 0), ("decorated", decorated), ("shouted", shouted), ("echoes", echo)):
        out[:, COUNTS.index(name)] = np.bincount(owner, weights=flag, minlength=len(texts))
    return out, owner, hashes


def statistics(texts: list[str | None]) -> np.ndarray:
    """COUNTS of each text; null counts as empty. Words are told apart by hashes of 64 bits.

    A text of more than PIECE code points is counted in pieces, so a word without white space for so long counts as several,
    and an echo across a cut is not seen.
    """
    parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t or "", PIECE)]
    owner = np.array([i for i, _ in parts], dtype=np.int64)
    out, seen, at = np.zeros((len(texts), len(COUNTS))), [], 0
    while at < len(parts):
        size, end = 0, at
        while end < len(parts) and (end == at or size + len(parts[end][1]) <= PIECE):
            size += len(parts[end][1])
            end += 1
        found, word_of, hashes = counts([p for _, p in parts[at:end]])
        np.add.at(out, owner[at:end], found)
        text_of = owner[at:end][word_of]
        with np.errstate(over="ignore"):
            key, first = np.unique(hashes + text_of.astype(np.uint64) * _PRIME, return_index=True)
        seen.append((key, text_of[first]))
        at = end
    if seen:
        key, first = np.unique(np.concatenate([k for k, _ in seen]), return_index=True)
        out[:, -1] = np.bincount(np.concatenate([t for _, t in seen])[first], minlength=len(texts))
    return out


#: A usual text's counts for so many words, which stand beside a text's own in its shares: those of short texts say little.
USUAL, USUAL_WORDS = dict(zip(COUNTS, (1000, 800, 20, 3, 25, 3, 180, 70, 1, 1, 1, 1, 180), strict=True)), 10


def features(found: np.ndarray) -> np.ndarray:
    """FEATURES from rows of COUNTS: square roots of shares and logarithms of sizes."""
    c = {k: x + USUAL[k] * USUAL_WORDS / USUAL["words"] for k, x in zip(COUNTS, found.T, strict=True)}
    share = lambda a, of: np.sqrt(c[a] / c[of])
    size = np.log((c["letters"] + c["digits"] + c["marks"]) / c["words"])
    columns = [np.log(c["words"]), size, share("capitals", "letters"), share("digits", "chars"), share("marks", "chars"), share("lines", "words")]
    return np.stack([*columns, *[share(k, "words") for k in ("short", "wordless", "decorated", "shouted", "echoes")], np.log(c["distinct"] / c["words"])], axis=1)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors (lower) and log weights of both classes; None: no document of one of them."""

    means: np.ndarray | None
    factors: np.ndarray | None
    weights: np.ndarray | None

    def score(self, x: np.ndarray) -> np.ndarray:
        """The share of class 1 for rows of features, 0.5 where there is nothing to learn from."""
        if self.means is None:
            return np.full(len(x), 0.5)
        log = [w - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, w in zip(self.means, self.factors, self.weights, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = SHRINK) -> Discriminant:
    """From the rows, sums and sums of products (about the origin) of class 0 and class 1."""
    if (n < 1).any():
        return Discriminant(None, None, None)
    means = sums / n[:, None]
    own = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.maximum(np.einsum("c,cii->i", n / n.sum(), own), LEAST)
    factors, weights = [], []
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - shrink) * own[k] + shrink * np.diag(pooled))
        factors.append(np.linalg.inv(lower))
        weights.append(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.stack(factors), np.array(weights))


#: The point of a text that is like the usual one; differences from it are multiplied, so that large sums keep their digits.
CENTRE = features(np.array([list(USUAL.values())], dtype=np.float64))[0]


def learned(points: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """fit() over all rows of points (doc_id, point) with a label 0 or 1 (the least, where there are several) that are not held out."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    marks = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_label"))
    rows, d = points.join(marks, F.col("doc_id") == F.col("_id")).select("_label", "point"), len(FEATURES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label, x = batch.column(0).to_numpy(), _matrix(batch.column(1)) - CENTRE
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

    total = np.zeros(2 * (1 + d + d * d))
    for r in rows.mapInArrow(work, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():  # one row a sum
        total[r["slot"]] = r["value"]
    total = total.reshape(2, -1)
    return fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def _matrix(points: pa.Array) -> np.ndarray:
    return points.flatten().to_numpy(zero_copy_only=False).reshape(len(points), len(FEATURES))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def point(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        batches = slices(iter([pa.RecordBatch.from_arrays([part], names=["t"])]), "t", PIECE)
        x = np.concatenate([np.zeros((0, len(FEATURES))), *[features(statistics(b.column(0).to_pylist())) for b in batches]])
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))


def score(points: DataFrame, model: Discriminant) -> DataFrame:
    """points with score, from 0 to 1, in place of point."""
    shared = points.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(part: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(_matrix(part) - CENTRE))

    return points.select(*[c for c in points.columns if c not in ("point", "score")], of(F.col("point")).alias("score"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of docs (doc_id, text), by densities learned from the labelled rows that are not held out.

    Labels join by doc_id, only to learn; rows with a null doc_id, without a label, or with another label than 0 and 1 are only
    scored. A null text is an empty one, which has a score like any other. Repeated rows score alike, and each counts in
    learning. Without documents of both labels every score is 0.5. Other columns take no part. An empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        points = keep(docs.select("doc_id", point(F.col("text")).alias("point")))
    return score(points, learned(points, labels))
