"""Improbable-feature digest: rare byte windows in chained Bloom filters, compared by normalised bit overlap.

Each window of WINDOW bytes has an entropy. How often each entropy occurs is counted over the windows of all texts, before any
text is fingerprinted; the less often, the rarer is a window. Near-constant windows (under LEAST_BITS) are never features. A
window is a feature if it is the rarest (the first, in a tie) in at least POPULAR of the runs of WINDOW neighbouring windows. Features enter a filter of FILTER_BITS bits
by HASHES bits each, in text order; after FILTER_FEATURES features a new filter begins. Ranks are whole numbers that
depend on the window and the frozen counts alone, so equal texts have equal digests.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 32
LEAST_BITS = 1.0
POPULAR = 8
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 128, 5
#: Share of the possible overlap above chance that is taken as chance, too.
CUT = 0.1
MOST_BUCKETS = 4096
_UNIT = 1 << 16
_NEVER = np.int64(1) << 40
_COST = np.rint(np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1)) * _UNIT).astype(np.int64)
#: Costs this far apart count as one entropy: 1 / 1024 of what a bit adds.
_GRAIN = 6
_KINDS = int(_COST[WINDOW] >> _GRAIN) + 1
_STEP = np.diff(_COST)  # what a further byte of a kind adds, by the number there


def window_costs(x: np.ndarray) -> np.ndarray:
    """Sum of c * log2(c) over the byte counts c of each window, times _UNIT; the entropy falls as it grows."""
    n = len(x) - WINDOW + 1
    order = np.argsort(x, kind="stable")
    key = x[order].astype(np.int64) * len(x) * 2 + order
    place = np.arange(len(x))
    ahead, behind = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    ahead[order] = np.searchsorted(key, key + WINDOW) - place  # equal bytes among the next WINDOW, itself included
    behind[order] = place - np.searchsorted(key, key - WINDOW, side="right") + 1
    first = int(_COST[np.bincount(x[:WINDOW], minlength=256)].sum())
    change = _STEP[behind[WINDOW : WINDOW + n - 1] - 1] - _STEP[ahead[: n - 1] - 1]
    # the entering byte is counted after the leaving one has gone: equal bytes leave and enter at no change
    return first + np.concatenate([[0], np.cumsum(change)])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n = len(x) - width + 1
    padded = np.append(x, np.full(-len(x) % width, np.iinfo(np.int64).max)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts end to end with gaps, size and start of each, whether a window lies inside a text)."""
    gap = b"\0" * WINDOW  # no run of neighbours reaches two texts
    joined = np.frombuffer(gap + gap.join(texts) + gap + gap, np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = WINDOW + np.cumsum(size + WINDOW) - (size + WINDOW)
    valid = np.zeros(len(joined) - WINDOW + 2, np.int64)
    full = size >= WINDOW
    np.add.at(valid, start[full], 1)
    np.add.at(valid, (start + size - WINDOW + 1)[full], -1)
    return joined, size, start, np.cumsum(valid[:-1]) > 0


def entropy_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each entropy, by cost >> _GRAIN."""
    joined, _, _, valid = laid_out(texts)
    return np.bincount(window_costs(joined)[valid] >> _GRAIN, minlength=_KINDS)


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy, the rarest first; entropies that were not seen come before all others."""
    out = np.empty(len(counts), np.int64)
    out[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    return out


def measured_rarity(texts: DataFrame) -> np.ndarray:
    """rarity() of the windows of all rows of texts (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_KINDS, np.int64)
        for part in slices(batches, "text"):
            total += entropy_counts([t or b"" for t in part.column("text").to_pylist()])
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["kind", "n"])

    counts = np.zeros(_KINDS, np.int64)
    for r in texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect():  # at most _KINDS rows
        counts[r["kind"]] = r["n"]
    return rarity(counts)


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the features of each text in order. A text of 1 to WINDOW - 1 bytes is one feature."""
    joined, size, start, valid = laid_out(texts)
    cost, full = window_costs(joined), size >= WINDOW
    dull = cost > WINDOW * (int(np.log2(WINDOW) * _UNIT) - int(LEAST_BITS * _UNIT))
    rank = np.where(valid & ~dull, ranks[cost >> _GRAIN], _NEVER)
    least = sliding_least((rank << np.int64(20)) | (np.arange(len(rank)) & ((1 << 20) - 1)), WINDOW) if len(rank) < 1 << 20 else _least_wide(rank)
    change = np.append(np.nonzero(np.diff(least))[0], len(least) - 1)
    times = np.diff(np.append(-1, change))
    best = least[change]
    kept = (times >= POPULAR) & (best >> np.int64(20) < _NEVER)
    at = _positions(best[kept], change[kept])
    owner = np.searchsorted(start, at, side="right") - 1
    words = np.lib.stride_tricks.sliding_window_view(joined, WINDOW)[at].copy().view(np.uint64)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words.shape[1]):
            h = (h ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    short = np.nonzero(~full & (size > 0))[0]
    if len(short):
        extra = np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in short], dtype=np.uint64)
        owner, h = np.append(owner, short), np.append(h, extra)
        order = np.argsort(owner, kind="stable")
        owner, h = owner[order], h[order]
    return owner, h


def _least_wide(rank: np.ndarray) -> np.ndarray:
    """As sliding_least over ranks with positions modulo 2**20, for inputs of any length: neighbours are far closer."""
    part, out = (1 << 20) - WINDOW, []
    for a in range(0, len(rank) - WINDOW + 1, part):
        own = rank[a : a + part + WINDOW - 1]
        least = sliding_least((own << np.int64(20)) | np.arange(len(own)), WINDOW)
        # within a part positions count from its start; they are made whole modulo 2**20 with no carry into the rank
        out.append((least >> np.int64(20) << np.int64(20)) | ((least + a) & ((1 << 20) - 1)))
    return np.concatenate(out)


def _positions(best: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places from their low 20 bits and the last run (starting at `last`) that holds them: last <= place < last + WINDOW."""
    return last + ((best & ((1 << 20) - 1)) - last) % (1 << 20)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, as rows of FILTER_BITS / 8 bytes; an empty text has none."""
    if not texts:
        return []
    owner, h = features(texts, ranks)
    count = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    filters = -(-count // FILTER_FEATURES)
    first = np.cumsum(filters) - filters
    row = first[owner] + nth // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    for i in range(HASHES):
        bits[row, (h >> np.uint64(11 * i)).astype(np.int64) % FILTER_BITS] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + n] for a, n in zip(first, filters, strict=True)]


def written(filters: np.ndarray) -> str:
    """A digest as text: the number of filters and their bits."""
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter digest the best overlap with the other's, beyond chance, by filled bits.

    Two digests without filters are alike (1); one without is unlike any other (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    in_a, in_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64)[:, None] for x in (a, b))
    best, weight = 0.0, 0.0
    for x, n in zip(a, in_a[:, 0], strict=True):
        both = np.bitwise_count(x & b).sum(axis=1, dtype=np.int64)
        most = np.minimum(n, in_b[:, 0])
        chance = n * in_b[:, 0] / FILTER_BITS
        chance = chance + CUT * (most - chance)
        best += float(n) * max(0.0, float(((both - chance) / np.maximum(most - chance, 1e-9)).max()))
        weight += float(n)
    return min(1.0, best / weight)


def with_neighbour(docs: DataFrame) -> DataFrame:
    """Rows (bucket, extra, doc_id, text) such that, in this order inside a partition, each row that is not extra is
    followed by the next document in descending order of doc_id; after the last comes the first.

    doc_ids are cut into buckets at quantiles; each bucket ends with a copy of the first document of the next one. Documents
    with one doc_id are in order of text. Null doc_ids come last, in as many buckets again, in order of a hash of the text
    and then of the text. Only bounds, one per bucket, reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = rows.select("doc_id").where("doc_id is not null")
    bounds = sorted({int(x) for x in known.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    listed = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<long>")
    hashed = F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 1))  # from 0 to 2^63 - 1
    nulls = len(bounds) + 1 + F.floor(F.col("hash") / (2.0**63 / n)).cast("int")
    place = F.when(F.col("doc_id").isNull(), F.least(nulls, F.lit(len(bounds) + n))).otherwise(F.size(F.filter(listed, lambda x: x > F.col("doc_id"))))
    rows = rows.withColumn("hash", hashed).withColumn("bucket", place)
    firsts = sorted((r["bucket"], r["first"], r["hash"]) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("first"), F.min("hash").alias("hash")).collect())  # at most 2 n rows
    columns = ["bucket", "extra", "doc_id", "hash", "text"]
    if not firsts:
        return rows.withColumn("extra", F.lit(0)).select(*columns)
    nexts = [(firsts[i][0], *firsts[(i + 1) % len(firsts)][1:]) for i in range(len(firsts))]
    ends = F.broadcast(spark.createDataFrame(nexts, "_bucket int, _first long, _hash long"))  # a row per bucket, 2 MOST_BUCKETS at most
    extra = rows.join(ends, F.col("doc_id").eqNullSafe(F.col("_first")) & F.col("hash").eqNullSafe(F.col("_hash"))).select(F.col("_bucket").alias("bucket"), F.lit(1).alias("extra"), "doc_id", "hash", "text")
    both = rows.withColumn("extra", F.lit(0)).select(*columns).union(extra)
    return both.repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("doc_id").desc_nulls_last(), "hash", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """text with its last half of code points replaced by as many, or all, of the first of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Digests of each row of docs (doc_id, text), of its edited text, and how like the edited and the next text are.

    A null text counts as empty: no filters, "0:". Repeated rows follow each other; a single document follows itself.
    An empty table gives an empty result. Other columns are not read.
    """

    ranks = docs.sparkSession.sparkContext.broadcast(measured_rarity(docs.select("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, str]] = []
        size = 0

        def out() -> pa.RecordBatch:
            texts = [t for _, _, t in held]
            own = digests([t.encode() for t in texts], ranks.value)
            todo = [i for i in range(len(held) - 1) if not held[i][0]]
            changed = [edited(texts[i], texts[i + 1]).encode() for i in todo]
            theirs = digests(changed, ranks.value)
            columns = (
                pa.array([held[i][1] for i in todo], pa.int64()), pa.array([len(texts[i]) for i in todo], pa.int64()),
                [hashlib.sha256(t).hexdigest() for t in changed], [written(own[i]) for i in todo], [written(d) for d in theirs],
                [likeness(own[i], d) for i, d in zip(todo, theirs, strict=True)], [likeness(own[i], own[i + 1]) for i in todo],
            )
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("extra", "doc_id", "text")], strict=True):
                held.append(row)
                size += len(row[2])
                if size >= chunk and len(held) > 1:
                    yield out()
                    held, size = held[-1:], len(held[-1][2])
        if len(held) > 1:
            yield out()

    return with_neighbour(docs).select("extra", "doc_id", "text").mapInArrow(work, SCHEMA)
