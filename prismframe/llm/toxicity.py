"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

Each word enters with a word input and character inputs. The word input is a learned vector of its hash and the shrunken log
odds of the lower-cased word in toxic against clean documents; the character inputs are the mean of the learned vectors of its
4-byte grams (with marks at both ends) and the highest and the mean log odds of these. In training, a document's own count is
left out of its log odds, and the vectors of some words are blanked at random, so that the network does not learn single
documents by heart. Windows of WINDOW words overlap by OVERLAP, so every word is read with context; a document's score is
that of its most toxic window.

Training uses a bounded sample: about MOST_TOXIC and MOST_CLEAN labelled documents. Each toxic document gives the
window with the strongest inputs, each clean one that window and a random one.
"""

from __future__ import annotations

import pickle
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, held_out, slices

WINDOW, OVERLAP = 48, 16
HIDDEN = 8
MOST_TOXIC, MOST_CLEAN = 1500, 3000
SAMPLE_TEXT = 64_000
EPOCHS, BATCH, RATE = 20, 256, 0.02
SHRINK = 3.0
TABLE_BITS = 18
#: Learned vectors: numbers in each, bits of their tables, share of words blanked in training, and the decay of unused ones.
VECTOR, VECTOR_BITS, BLANK, DECAY = 4, 12, 0.5, 0.01
INPUTS = 3 + 2 * VECTOR
CACHED_WORDS = 200_000
_MARKS = string.punctuation + string.digits
_MIX = np.uint32(0x9E3779B1)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot) of the 4-byte grams of each word between two marks; a short word is one gram."""
    marked = [b"<" + w + b">" + b"\0" * (2 - len(w)) for w in words]
    size = np.array([len(m) for m in marked])
    x = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    code = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
    inside = owner[:-3] == owner[3:]
    with np.errstate(over="ignore"):
        code = (code[inside] ^ (code[inside] >> np.uint32(15))) * _MIX
    return owner[:-3][inside], (code >> np.uint32(32 - TABLE_BITS)).astype(np.int64)


def word_slots(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(w) for w in words], dtype=np.int64) >> (32 - TABLE_BITS)


def normal(word: str) -> bytes:
    return word.lower().strip(_MARKS).encode()


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log odds of being in a toxic document, shrunk towards 0 where few documents have the slot."""
    seen = toxic + clean
    raw = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return (raw * seen / (seen + SHRINK)).astype(np.float32)


def inputs(words: list[bytes], word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """Rows (word, highest gram, mean gram) for words."""
    out = np.zeros((len(words), 3), np.float32)
    if not words:
        return out
    out[:, 0] = word_odds[word_slots(words)]
    owner, slot = grams(words)
    odds = gram_odds[slot]
    first = np.searchsorted(owner, np.arange(len(words)))
    out[:, 1] = np.maximum.reduceat(odds, first)
    out[:, 2] = np.add.reduceat(odds, first) / np.diff(np.append(first, len(odds)))
    return out


@dataclass
class Parts:
    """Rows of the vector tables that words use: of the word, and of its grams (owner says whose)."""

    word: np.ndarray
    owner: np.ndarray
    gram: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Parts:
        owner, slot = grams(words)
        shift = TABLE_BITS - VECTOR_BITS
        return cls(word_slots(words) >> shift, owner, slot >> shift)

    def take(self, some: np.ndarray) -> Parts:
        """The parts of a sorted selection of words."""
        first, last = np.searchsorted(self.owner, some), np.searchsorted(self.owner, some, side="right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return Parts(self.word[some], np.repeat(np.arange(len(some)), n), self.gram[at])

    def vectors(self, w: dict[str, np.ndarray]) -> np.ndarray:
        """Rows (vector of the word, mean vector of its grams)."""
        if not len(self.word):
            return np.zeros((0, 2 * VECTOR), np.float32)
        n = np.bincount(self.owner, minlength=len(self.word))
        sums = np.stack([np.bincount(self.owner, weights=w["eg"][self.gram, i], minlength=len(self.word)) for i in range(VECTOR)], axis=1)
        return np.hstack([w["ew"][self.word], sums / np.maximum(n, 1)[:, None]]).astype(np.float32)

    def gradients(self, d: np.ndarray) -> dict[str, np.ndarray]:
        """Of the tables, from those of the rows of vectors()."""
        n, rows = np.bincount(self.owner, minlength=len(self.word)), 1 << VECTOR_BITS
        each = (d[:, VECTOR:] / np.maximum(n, 1)[:, None])[self.owner]
        sums = lambda at, x: np.stack([np.bincount(at, weights=x[:, i], minlength=rows) for i in range(VECTOR)], axis=1)
        return {"ew": sums(self.word, d[:, :VECTOR]), "eg": sums(self.gram, each)}


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, position of the first word, words) of all windows of texts of so many words, laid end to end."""
    step = WINDOW - OVERLAP
    n = np.where(counts > 0, np.maximum(1, -(-(counts - OVERLAP) // step)), 0)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(counts) - counts, n) + nth * step
    return owner, start, np.minimum(WINDOW, counts[owner] - nth * step)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights by name; x is (time, windows, inputs), mask (time, windows)."""

    def __init__(self, seed: int = 3, size: int = 3, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {"att": r.normal(0, 0.3, (2 * hidden, 1)), "out": r.normal(0, 0.3, (2 * hidden, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.w |= {f"{d}w": r.normal(0, 0.5, (size, 3 * hidden)), f"{d}u": r.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"{d}b": np.zeros(3 * hidden)}
        self.w |= {k: r.normal(0, 0.1, (1 << VECTOR_BITS, VECTOR)) for k in ("ew", "eg")}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        k, w, u, b = self.hidden, self.w[f"{d}w"], self.w[f"{d}u"], self.w[f"{d}b"]
        t, n, _ = x.shape
        out, h = np.zeros((t, n, k), x.dtype), np.zeros((n, k), x.dtype)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, g = x[i] @ w + b, h @ u
            zr = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
            m = mask[i][:, None]
            if keep is not None:
                keep.append((i, h, z, r, c, g[:, 2 * k :], m))
            h = h + m * z * (c - h)
            out[i] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        tapes: dict = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        states = np.concatenate([self._run(d, x, mask, tapes[d]) for d in "fb"], axis=2)
        e = np.where(mask > 0, (states @ self.w["att"])[:, :, 0], -1e9)
        a = np.exp(e - e.max(axis=0)) * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = (a[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep.update(tapes=tapes, states=states, a=a, pooled=pooled)
        return (pooled @ self.w["out"])[:, 0] + self.w["bias"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray, d_x: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross entropy, by weight; those of the inputs are added to d_x."""
        keep: dict = {}
        k, n = self.hidden, x.shape[1]
        p = _sigmoid(self.forward(x, mask, keep))
        d_logit = ((p - label) / n)[:, None]
        g = {"bias": d_logit.sum(axis=0), "out": keep["pooled"].T @ d_logit}
        d_pooled, a, states = d_logit @ self.w["out"].T, keep["a"], keep["states"]
        d_a = (states * d_pooled).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["att"] = np.einsum("tnk,tn->k", states, d_e)[:, None]
        d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * self.w["att"][:, 0]
        for d, part in (("f", d_states[:, :, :k]), ("b", d_states[:, :, k:])):
            u, d_h = self.w[f"{d}u"], np.zeros((n, k), x.dtype)
            g |= {f"{d}{s}": np.zeros_like(self.w[f"{d}{s}"]) for s in "wub"}
            for i, h, z, r, c, hc, m in reversed(keep["tapes"][d]):
                d_h = d_h + part[i]
                d_c = d_h * m * z * (1 - c * c)
                d_z = d_h * m * (c - h) * z * (1 - z)
                d_r = d_c * hc * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_c], axis=1)
                d_rec = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g[f"{d}w"] += x[i].T @ d_in
                if d_x is not None:
                    d_x[i] += d_in @ self.w[f"{d}w"].T
                g[f"{d}b"] += d_in.sum(axis=0)
                g[f"{d}u"] += h.T @ d_rec
                d_h = d_h * (1 - m * z) + d_rec @ u.T
        return g

    def train(self, odds: np.ndarray, word: np.ndarray, parts: Parts, mask: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """odds (time, windows, 3) and word (time, windows), the number of each word in parts."""
        r, first, second, t = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(odds.shape[1])
            for at in range(0, len(order), BATCH):
                some, t = order[at : at + BATCH], t + 1
                seen, own = np.unique(word[:, some], return_inverse=True)
                own, used = own.reshape(word[:, some].shape), parts.take(seen)
                kept = (r.random(len(seen)) >= BLANK)[:, None] / (1 - BLANK)
                x = np.concatenate([odds[:, some], (used.vectors(self.w) * kept).astype(np.float32)[own]], axis=2)
                d_x = np.zeros_like(x)
                grads = self.gradients(x, mask[:, some], label[some], d_x)
                d = np.stack([np.bincount(own.ravel(), weights=d_x[:, :, 3 + i].ravel(), minlength=len(seen)) for i in range(2 * VECTOR)], axis=1)
                grads |= used.gradients(d * kept)
                for name in ("ew", "eg"):
                    grads[name] += DECAY / len(label) * self.w[name]
                for name, grad in grads.items():
                    grad = np.clip(grad, -1, 1)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * grad
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * grad**2
                    step = first[name] / (1 - 0.9**t) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-8)
                    self.w[name] = (self.w[name] - RATE * (1 - epoch / epochs) * step).astype(np.float32)


class _Ids(dict):
    """Numbers words in order of their first look-up."""

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        return out


class WordTable:
    """Inputs of the words seen so far, begun anew when it holds CACHED_WORDS."""

    def __init__(self) -> None:
        self.ids, self.rows = _Ids(), np.zeros((0, INPUTS), np.float32)

    def look_up(self, words: list[str], model: Model) -> np.ndarray:
        if len(self.ids) > CACHED_WORDS:
            self.__init__()
        ids = self.ids
        at = np.fromiter([ids[w] for w in words], np.int64, len(words))
        if len(ids) > len(self.rows):
            new = [normal(w) for w in list(ids)[len(self.rows) :]]
            self.rows = np.concatenate([self.rows, np.hstack([inputs(new, model.word_odds, model.gram_odds), Parts.of(new).vectors(model.network.w)])])
        return self.rows[at]


@dataclass
class Model:
    word_odds: np.ndarray
    gram_odds: np.ndarray
    network: Network | None  # None: no toxic or no clean document to learn from

    def score(self, texts: list[str | None], known: WordTable) -> np.ndarray:
        """The score of each text, 0 for one without words."""
        out = np.zeros(len(texts))
        if self.network is None:
            return out
        split = [t.split() if t else [] for t in texts]
        counts = np.array([len(s) for s in split], dtype=np.int64)
        if not counts.sum():
            return out
        x = known.look_up([w for words in split for w in words], self)
        owner, start, size = windows(counts)
        best = np.full(len(texts), -np.inf)
        for a in range(0, len(owner), 4096):
            o, s, n = owner[a : a + 4096], start[a : a + 4096], size[a : a + 4096]
            steps = np.arange(int(n.max()))[:, None]
            at = np.minimum(s + steps, len(x) - 1)
            np.maximum.at(best, o, self.network.forward(x[at], (steps < n).astype(np.float32)))
        return np.where(counts > 0, _sigmoid(best), 0.0)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """A model from whole texts and their 0/1 labels."""
    size, n_toxic, n_clean = 1 << TABLE_BITS, float(toxic.sum()), float((1 - toxic).sum())
    if not n_toxic or not n_clean:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), None)
    same: dict[bytes, bytes] = {}  # one object a word
    split = [[same.setdefault(w, w) for w in map(normal, t.split())] for t in texts]
    have: list[tuple[np.ndarray, np.ndarray]] = []
    counts = np.zeros((2, 2, size), np.float32)  # word or gram, clean or toxic
    for words, label in zip(split, toxic, strict=True):
        own = list(set(words))
        have.append((np.unique(word_slots(own)), np.unique(grams(own)[1])))
        for kind in (0, 1):
            counts[kind, label, have[-1][kind]] += 1
    r, xs, numbers, sizes, labels, vocabulary = np.random.default_rng(11), [], [], [], [], {}
    for words, own, label in zip(split, have, toxic, strict=True):
        if not words:
            continue
        odds = []
        for kind in (0, 1):  # the document's own count is left out
            table = np.zeros(size, np.float32)
            c = counts[kind][:, own[kind]].copy()
            c[label] -= 1
            table[own[kind]] = log_odds(c[1], c[0], n_toxic - label, n_clean - (1 - label))
            odds.append(table)
        own_words = sorted(set(words))
        at = np.searchsorted(np.array(own_words, dtype=object), np.array(words, dtype=object))
        x = inputs(own_words, *odds)[at]
        _, start, n = windows(np.array([len(words)]))
        strength = np.array([x[s : s + m].max(axis=0).sum() for s, m in zip(start, n, strict=True)])
        chosen = {int(strength.argmax())} | ({int(r.integers(len(start)))} if not label else set())
        for i in chosen:
            xs.append(np.pad(x[start[i] : start[i] + n[i]], ((0, WINDOW - n[i]), (0, 0))))
            numbers.append(np.pad([vocabulary.setdefault(w, len(vocabulary)) for w in words[start[i] : start[i] + n[i]]], (0, WINDOW - n[i])))
            sizes.append(n[i])
            labels.append(label)
    if not xs:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), None)
    network = Network(size=INPUTS)
    mask = (np.arange(WINDOW)[:, None] < np.array(sizes)).astype(np.float32)
    network.train(np.stack(xs, axis=1), np.stack(numbers, axis=1), Parts.of(list(vocabulary)), mask, np.array(labels, dtype=np.float32))
    return Model(*[log_odds(c[1], c[0], n_toxic, n_clean) for c in counts], network)


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """Rows (doc_id, toxic, text), about so many, that may be learned from, drawn by a seeded hash of doc_id; whole texts.

    Texts of more than SAMPLE_TEXT bytes are not learned from, so the sample has a bound in bytes. A doc_id with both labels
    counts as toxic, and of the texts with one doc_id the least is learned from.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, most_toxic / max(1, counts.get(1, 0))).otherwise(most_clean / max(1, counts.get(0, 0)))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_003)) < rate * 1_000_003)
    # the draw gives about most_toxic + most_clean rows; the limit is there for its bound and is not reached
    label = [(r["doc_id"], r["toxic"]) for r in drawn.limit(4 * (most_toxic + most_clean)).collect()]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(label, "_id long, toxic int"))
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_TEXT).join(wanted, F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one a label


def learned(rows: DataFrame) -> Model:
    """fit() on all rows of a sample, which one task gathers and learns from; only the model goes to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((r["doc_id"], r["toxic"], r["text"]) for batch in batches for r in batch.to_pylist())
        model = fit([t for _, _, t in own], np.array([x for _, x, _ in own], dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.select("doc_id", "toxic", "text").repartition(1).mapInArrow(work, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else fit([], np.zeros(0, np.int64))  # no rows: no task


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs (text among them) and score, from 0 to 1.

    Null texts and texts without words score 0, and so does every text if there was no toxic or no clean document to
    learn from. A column named score is replaced; other extra columns pass through. Repeated rows score alike.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = held(key, WordTable)
        for part in parts:
            batches = slices(iter([pa.RecordBatch.from_arrays([part], names=["t"])]), "t")
            yield pa.array(np.concatenate([np.zeros(0), *[shared.value.score(b.column(0).to_pylist(), known) for b in batches]]))

    rest = [c for c in docs.columns if c != "score"]
    return docs.select(*rest, of(F.col("text")).alias("score"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) with score, by a model learned from the labelled rows that are not held out."""
    return score(docs, learned(sample(docs, labels)))
