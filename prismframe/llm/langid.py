"""Language identification by prediction by partial matching.

Each language has a context tree over bytes (lower-cased text, other bytes than the most common share one symbol) of
up to ORDER bytes. A symbol not seen in a context escapes to the next shorter one with probability d / (n + d) (n
symbols seen, d of them distinct), without the symbols that the longer context has seen; below the empty context all
symbols are equally likely. The statistics are frozen after fitting, so the exact code length of each symbol after
each context is worked out once, and a text costs one look-up per byte. The shortest code wins.

The trees are fitted on a sample of at most about SAMPLE_DOCS documents a language and SAMPLE_BYTES bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices

ORDER = 3
SYMBOLS = 96
#: Expected number of sampled documents a language, and the most bytes kept of one language's sample.
SAMPLE_DOCS = 500
SAMPLE_BYTES = 3_000_000
#: Texts up to so many bytes are learned from, and so many languages at most.
SAMPLE_TEXT, MOST_LANGUAGES = 64_000, 64
UNKNOWN = "und"
_HAS_LETTER = r"\p{L}"


class ContextTrees:
    """Frozen code lengths: symbol of each byte, row of each context, bits[row, symbol, language]."""

    def __init__(self, symbol: np.ndarray, row: np.ndarray, bits: np.ndarray, langs: list[str], order: int):
        self.symbol, self.row, self.bits, self.langs, self.order = symbol, row, bits, langs, order

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language. Each text starts after `order` line ends."""
        pad = b"\n" * self.order
        joined = pad + pad.join(texts)
        x = self.symbol[np.frombuffer(joined, dtype=np.uint8)].astype(np.int32)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        first = self.order + np.concatenate([[0], np.cumsum(size + self.order)[:-1]]).astype(np.int64)
        n, context = int(self.symbol.max()) + 1, np.zeros(len(x) - self.order, np.int32)
        for i in range(self.order):
            context = context * n + x[i : len(x) - self.order + i]
        at = self.row[context] * n + x[self.order :]
        out = np.zeros((len(texts), len(self.langs)))
        flat = self.bits.reshape(-1, len(self.langs))
        for j in range(len(self.langs)):
            sums = np.concatenate([[0.0], np.cumsum(np.take(flat[:, j], at), dtype=np.float64)])
            start = first - self.order
            out[:, j] = sums[start + size] - sums[start]
        return out


def _code_lengths(x: np.ndarray, n: int, order: int, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Probabilities of each symbol in the contexts of rows[k] (codes of k symbols), for k = 0 to order, of one language."""
    below = np.full((1, n), 1.0 / n)
    out = []
    for k in range(order + 1):
        counts = np.zeros((len(rows[k]), n))
        if len(x) > k:
            code = np.zeros(len(x) - k, np.int64)
            for i in range(k):
                code = code * n + x[i : len(x) - k + i]
            at = np.searchsorted(rows[k], code)
            at[at == len(rows[k])] = 0
            known = rows[k][at] == code
            np.add.at(counts, (at[known], x[k:][known]), 1)
        if k:
            shorter = rows[k] % n ** (k - 1)  # the context without its first symbol
            below = out[-1][np.searchsorted(rows[k - 1], shorter)]
        else:
            below = np.broadcast_to(below, counts.shape)
        total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        free = np.where(counts > 0, 0, below)
        room = free.sum(axis=1, keepdims=True)
        every = (room <= 1e-12) & (total > 0)  # all symbols seen: nothing to escape to
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
        seen = counts / np.maximum(np.where(every, total, total + distinct), 1)
        out.append(np.where(total > 0, seen + np.where(every, 0, escape) * free / np.maximum(room, 1e-12), below))
    return out


def fit(samples: dict[str, list[bytes]], order: int = ORDER, symbols: int = SYMBOLS) -> ContextTrees:
    """Trees from texts by language. A context gets a row if any language has seen it; others use the next shorter."""
    langs = sorted(samples)
    joined = {lang: np.frombuffer((b"\n" * order) + (b"\n" * order).join(samples[lang]), dtype=np.uint8) for lang in langs}
    counts = sum((np.bincount(b, minlength=256) for b in joined.values()), np.zeros(256, np.int64))
    common = [int(b) for b in np.argsort(-counts, kind="stable")[: symbols - 1] if counts[b]]
    symbol = np.full(256, len(common), np.int32)
    symbol[common] = np.arange(len(common))
    n = len(common) + 1
    streams = {lang: symbol[b].astype(np.uint8) for lang, b in joined.items()}  # widened one language at a time
    rows = [np.zeros(1, np.int64)]
    for k in range(1, order + 1):
        codes = []
        for x in streams.values():
            code = np.zeros(max(0, len(x) - k), np.int32)  # below symbols ** order
            for i in range(k):
                code *= n
                code += x[i : len(x) - k + i]
            codes.append(np.unique(code).astype(np.int64))
        found = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        rows.append(found[np.isin(found % n ** (k - 1), rows[k - 1])])
    lengths = lambda lang: np.concatenate([-np.log2(np.maximum(t, 1e-300)).astype(np.float32) for t in _code_lengths(streams[lang].astype(np.int64), n, order, rows)])
    tables = [lengths(lang) for lang in langs]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    row = np.zeros(1, np.int32)
    for k in range(1, order + 1):  # from the rows of contexts one shorter, which stand for all symbols before them
        row = np.tile(row, n)
        row[rows[k]] = first[k] + np.arange(len(rows[k]))
    bits = np.stack(tables, axis=2) if langs else np.zeros((first[-1], n, 0), np.float32)
    return ContextTrees(symbol, row.astype(np.int32), bits, langs, order)


def sample(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Whole lower-cased texts by language from rows that may be learned from, in a seeded order, to the bound in bytes.

    Texts of more than SAMPLE_TEXT bytes are not learned from, so what is collected has a bound. More than MOST_LANGUAGES
    values of lang are an error, since the trees of all languages are broadcast; none is dropped.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    out: dict[str, list[bytes]] = {}
    if not counts:
        return out
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most_docs / n))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_003)) < rate * 1_000_003
    order = F.xxhash64(F.lit("order"), "doc_id").alias("order")
    rows = known.where(drawn & (F.octet_length("text") <= SAMPLE_TEXT)).select("lang", order, F.lower("text").alias("text"))
    size: dict[str, int] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["order"], r["text"])):
        text = r["text"].encode()
        if size.setdefault(r["lang"], 0) < most_bytes:
            size[r["lang"]] += len(text)
            out.setdefault(r["lang"], []).append(text)
    return out


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """All columns of docs plus lang_pred and score, the share of the best language in the sum of 2 ** -bits.

    A null text, one without a letter, or trees of no language give lang_pred "und" and score 0. Extra columns pass
    through, unless they are named lang_pred or score, which are replaced. Ties go to the first language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def best(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = model.value
        for part in parts:
            langs: list[str] = []
            scores: list[float] = []
            for batch in slices(iter([pa.RecordBatch.from_arrays([part], names=["t"])]), "t"):
                texts = [t.encode() if t else None for t in batch.column(0).to_pylist()]
                if not trees.langs:
                    texts = [None] * len(texts)
                bits = trees.lengths([t or b"" for t in texts]) if trees.langs else None
                for i, t in enumerate(texts):
                    if t is None:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    j = int(np.argmin(bits[i]))
                    langs.append(trees.langs[j])
                    scores.append(float(1 / np.exp2(np.maximum(bits[i, j] - bits[i], -1000)).sum()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    text = F.when(F.col("text").rlike(_HAS_LETTER), F.lower("text"))
    rest = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")], best(text).alias("_best"))
    return rest.select(*[c for c in rest.columns if c != "_best"], F.col("_best.lang_pred").alias("lang_pred"), F.col("_best.score").alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with lang_pred and score, by trees learned from the rows that are not held out."""
    return predict(docs, fit(sample(docs)))
