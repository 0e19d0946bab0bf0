"""Similarity join of documents on word 5-shingles by the chosen-path method, Jaccard similarity 0.8 or more.

1. Each text becomes a set of shingle hashes. Equal sets are one class; its least row stands for it.
2. In each run a set goes to a bucket for each of its shingles that a hash shared by all sets picks with probability
   FAN / size. A bucket of more than SPLIT_ABOVE sets is split again, by shingles picked anew for that bucket with
   probability DEEP_FAN / size, to DEPTH levels. The number of runs follows from the target recall at the threshold.
3. In a bucket all pairs are compared by sketches (signed counts of hashed shingles, whose inner product estimates the
   size of the intersection, MARGIN deviations below the threshold). What passes joins sets to families.
4. In a family all pairs are compared exactly. A pair is compared once, so links are counted without listing pairs.
   The components of links are the classes.

A bucket or family of more than BLOCK sets is cut into blocks, and pairs of blocks go to different tasks, so no group
meets in one task and nothing is capped. Shingles are told apart by hashes, of 44 bits in buckets and of 32 in families.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, join_skewed, marked, scratch, settle, slices
from .components import components

SHINGLE = 5
#: The threshold as a fraction, so that sizes are compared as integers.
NUMERATOR, DENOMINATOR = 4, 5
TARGET_RECALL = 0.999
FAN, DEEP_FAN = 4, 8
DEPTH = 3
SPLIT_ABOVE = 4096
BLOCK = 1024
#: A family gets up to this many blocks of at least FAMILY_BLOCK sets before its blocks grow.
FAMILY_BLOCKS, FAMILY_BLOCK, MOST_FAMILY_BLOCK = 8, 64, 1024
DIMENSIONS = 256
MARGIN = 4.0
CACHED_WORDS = 200_000
_TOKEN_BITS = 44
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float = TARGET_RECALL, fan: int = FAN, deep_fan: int = DEEP_FAN, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a bucket, of the last level if need be, with probability recall.

    A pair shares at least threshold * fan picked shingles of a level in expectation, so it misses one with exp of minus that.
    """
    share = NUMERATOR / DENOMINATOR
    missed = 1 - (1 - math.exp(-share * fan)) * (1 - math.exp(-share * deep_fan)) ** (depth - 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit mix of unsigned integers, alike in every process."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * _PRIME
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, token) of the distinct shingles of each text, sorted. A text of under five words is one shingle."""
    of, hashes, counts = held("shingles", _Words), [], []
    for text in texts:
        words = text.split() if text else []  # bytes.split() splits at 0x20 and 0x09 to 0x0D
        hashes += [of[w] for w in words]
        if 0 < len(words) < SHINGLE:
            hashes += [0] * (SHINGLE - len(words))
        counts.append(max(len(words), SHINGLE) if words else 0)
    size = np.array(counts, dtype=np.int64)
    h = np.array(hashes, dtype=np.uint64)
    windows = len(h) - SHINGLE + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(windows, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            total = total * _PRIME + h[i : i + windows]
    owner = np.repeat(np.arange(len(texts)), size)
    inside = owner[:windows] == owner[SHINGLE - 1 :]
    key = (owner[:windows][inside].astype(np.uint64) << np.uint64(_TOKEN_BITS)) | (mixed(total[inside]) >> np.uint64(64 - _TOKEN_BITS))
    key = np.unique(key)
    return (key >> np.uint64(_TOKEN_BITS)).astype(np.int64), key & np.uint64((1 << _TOKEN_BITS) - 1)


def picked(token: np.ndarray, path: np.ndarray | int, size: np.ndarray, fan: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are picked below a path, and the paths they lead to."""
    with np.errstate(over="ignore"):
        seed = mixed(token * np.uint64(0xD6E8FEB86659FD93) + np.asarray(path).astype(np.uint64), salt)
    at = np.nonzero(seed < np.minimum(fan / np.maximum(size, 1), 1.0) * 18446744073709549568.0)[0]
    return at, mixed(seed[at], 7919).astype(np.int64)


def _split(values: pa.Array, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _narrow(row: np.ndarray) -> bytes:
    """Signed counts in the least of 1, 2 or 4 bytes each that holds them all; the width follows from the length."""
    most = max(int(row.max()), -int(row.min()))
    return row.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32).tobytes()


def _counts(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, dtype=f"i{len(sketch) // DIMENSIONS}").astype(np.float64)


#: paths: buckets of the first level, with their runs.
SET_SCHEMA = "uid long, doc_id long, tie long, n int, k1 long, k2 long, paths array<long>, runs array<int>, sketch binary, tokens binary"


def shingled(docs: DataFrame, runs: int, fan: float = FAN, key: str | None = None, tie: str | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): the set, two hashes of it, a sketch and the buckets of the first level."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = batch.num_rows
            owner, token = shingle_sets(batch.column("text").to_pylist())
            n = np.bincount(owner, minlength=m)
            first = np.concatenate([[0], np.cumsum(n)])
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(token, s))]) for s in (101, 202)]
                keys = [(s[first[1:]] - s[first[:-1]]).astype(np.int64) for s in sums]
            found = [picked(token, run, n[owner], fan, run + 1) for run in range(runs)]
            whose = np.concatenate([owner[at] for at, _ in found])
            order = np.argsort(whose, kind="stable")
            code, values = np.repeat(np.arange(runs), [len(at) for at, _ in found])[order], np.concatenate([x for _, x in found])[order]
            per = np.bincount(whose, minlength=m)
            sign = np.where(mixed(token, 303) >> np.uint64(63), 1.0, -1.0)
            at = owner * DIMENSIONS + (mixed(token, 404) >> np.uint64(56)).astype(np.int64) % DIMENSIONS
            sketch = np.bincount(at, weights=sign, minlength=m * DIMENSIONS).reshape(m, DIMENSIONS)
            small = token.astype(np.uint32)
            columns = [
                batch.column("uid"), batch.column("doc_id"), batch.column("tie"), pa.array(n, pa.int32()), *[pa.array(k, pa.int64()) for k in keys], _split(values, per, pa.int64()), _split(code, per, pa.int32()),
                pa.array([_narrow(r) for r in sketch], pa.binary()), pa.array([small[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SET_SCHEMA.split(", ")])

    own = (F.monotonically_increasing_id() if key is None else F.col(key)).alias("uid"), (F.lit(0) if tie is None else F.col(tie)).cast("long").alias("tie")
    rows = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return settle(rows.mapInArrow(work, SET_SCHEMA))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (integers) in a partition that is sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.nonzero(change)[0].tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1])
    if rest is not None:
        yield rest


def in_blocks(rows: DataFrame, key: str, size: Column, blocks: Column) -> DataFrame:
    """Rows (key, uid, ...) dealt to pairs of blocks of their group, with columns a, b (a <= b) and block."""
    own = F.pmod(F.xxhash64("uid"), F.col("_blocks")).cast("int")
    rows = rows.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(blocks)).cast("int")).withColumn("block", own)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("a", F.least("block", "_other")).withColumn("b", F.greatest("block", "_other")).drop("_blocks", "_other")
    return rows.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b")


def _linked(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row of its component."""
    label = np.full(len(close), -1)
    for i in range(len(close)):
        if label[i] < 0:
            front = np.zeros(len(close), bool)
            front[i] = True
            while front.any():
                label[front] = i
                front = close[front].any(axis=0) & (label < 0)
    return label


def compare_blocks(t: pa.Table, similar: Callable[[pa.Table], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a pair of blocks: uid, the matrix of similar pairs, and the least uid each is joined to.

    Pairs within a block are compared where both blocks are that block, other pairs where they are two blocks.
    """
    uid = t.column("uid").to_numpy()
    order = np.argsort(uid, kind="stable")
    t, uid = t.take(pa.array(order)), uid[order]
    close = similar(t)
    if t.column("a")[0].as_py() != t.column("b")[0].as_py():
        block = t.column("block").to_numpy()
        close &= block[:, None] != block[None, :]
    np.fill_diagonal(close, False)
    return uid, close, uid[_linked(close)]


def sketch_similar(t: pa.Table) -> np.ndarray:
    sketches = t.column("sketch").to_pylist()
    if all(len(s) == DIMENSIONS for s in sketches):  # sums of products of bytes are exact in single precision
        x = np.frombuffer(b"".join(sketches), dtype=np.int8).reshape(t.num_rows, DIMENSIONS).astype(np.float32)
    else:
        x = np.stack([_counts(s) for s in sketches])
    n, out = t.column("n").to_numpy().astype(np.float64), np.empty((len(x), len(x)), bool)
    for a in range(0, len(x), 256):  # a stripe at a time, to bound the memory
        own = n[a : a + 256, None]
        least = NUMERATOR / (NUMERATOR + DENOMINATOR) * (own + n)
        out[a : a + 256] = x[a : a + 256] @ x.T >= least - MARGIN * np.sqrt((own * n + least**2) / DIMENSIONS)
    return out


def exact_similar(t: pa.Table, step: int = 1024) -> np.ndarray:
    sets = [np.unique(np.frombuffer(s, dtype=np.uint32)) for s in t.column("tokens").to_pylist()]
    m = len(sets)
    n = np.array([len(s) for s in sets])
    owner, token = np.repeat(np.arange(m), n), np.concatenate(sets)
    _, code, count = np.unique(token, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    rank = np.cumsum(count > 1) - 1
    code = rank[code]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((m, m), np.float32)
    for at in range(0, int((count > 1).sum()), step):
        lo, hi = np.searchsorted(code, [at, at + step])
        x = np.zeros((m, step), np.float32)
        x[owner[lo:hi], code[lo:hi] - at] = 1
        common += x @ x.T
    out = np.empty((m, m), bool)
    for a in range(0, m, 256):
        out[a : a + 256] = (NUMERATOR + DENOMINATOR) * np.rint(common[a : a + 256]).astype(np.int64) >= NUMERATOR * (n[a : a + 256, None] + n)
    return out


def _edges(keys: list[str], similar: Callable[[pa.Table], np.ndarray], counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row of a pair of blocks with a similar row: uid, the least uid joined to, and the copies of similar rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for t in groups(batches, keys):
            if t.num_rows < 2:
                continue
            uid, close, least = compare_blocks(t, similar)
            some = close.any(axis=1)
            if not some.any():
                continue
            copies = dict(zip(t.column("uid").to_pylist(), t.column("copies").to_pylist(), strict=True)) if counted else {}
            weight = np.array([copies[u] for u in uid.tolist()], dtype=np.float64) if counted else np.zeros(len(uid))
            for o, x in zip(out, (uid[some], least[some], (close[some] @ weight).astype(np.int64)), strict=True):
                o.append(x)
            if len(out[0]) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["u", "v", "links"])
                out = ([], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["u", "v", "links"])

    return work


def deeper(large: DataFrame, sets: DataFrame, fan: float = DEEP_FAN) -> DataFrame:
    """Rows (path, run, uid) of the buckets below large (path, run, uid); a set's shingles are picked anew for each path."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, paths, runs, tokens in zip(*(batch.column(c).to_pylist() for c in ("uid", "paths", "runs", "tokens")), strict=True):
                token = np.unique(np.frombuffer(tokens, np.uint32)).astype(np.uint64)
                found = [picked(token, np.int64(p), np.array(len(token)), fan, run + 101)[1] for p, run in zip(paths, runs, strict=True)]
                per = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(np.repeat(runs, per), pa.int32()), pa.array(np.full(sum(per), uid), pa.int64())], names=["path", "run", "uid"])

    # a set is in at most (FAN * runs) * DEEP_FAN buckets of a level in expectation, so the lists are short
    own = large.groupBy("uid").agg(F.collect_list(F.struct("path", "run")).alias("p")).select(F.col("uid").alias("_uid"), F.col("p.path").alias("paths"), F.col("p.run").alias("runs"))
    met = marked(sets.select("uid", "tokens"), "uid", large.select("uid").distinct()).join(own, F.col("uid") == F.col("_uid"))
    return met.select("uid", "paths", "runs", "tokens").mapInArrow(work, "path long, run int, uid long")


def buckets(sets: DataFrame, depth: int = DEPTH, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Rows (path, size, uid) of the buckets to compare; sets has uid, paths, runs, tokens."""
    rows, done = sets.select(F.explode(F.arrays_zip("paths", "runs")).alias("p"), "uid").select("p.paths", "p.runs", "uid").toDF("path", "run", "uid"), []
    for level in range(depth):
        rows = settle(rows)
        sizes = settle(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("path", "_path"))
        total, largest = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
        rows = join_skewed(rows, sizes, {"path": "_path"}, "size", total).select("path", "run", "size", "uid")
        if level == depth - 1 or largest <= split_above:
            done.append(rows.select("path", "size", "uid"))
            break
        rows = settle(rows)
        done.append(rows.where(F.col("size") <= split_above).select("path", "size", "uid"))
        rows = deeper(rows.where(F.col("size") > split_above).select("path", "run", "uid"), sets)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return settle(out)


def _families(reps: DataFrame) -> DataFrame:
    """Rows (node, root): sets joined by links that their sketches allow."""
    rows = buckets(reps.select("uid", "paths", "runs", "tokens"))
    sketches = marked(reps.select("uid", "n", "sketch"), "uid", rows.select("uid").distinct())
    dealt = in_blocks(rows.join(sketches, "uid"), "path", F.col("size"), F.col("size") / BLOCK)
    near = dealt.select("path", "a", "b", "block", "uid", "n", "sketch").mapInArrow(_edges(["path", "a", "b"], sketch_similar, False), "u long, v long, links long")
    return components(near.select("u", "v"))


def _links(reps: DataFrame, classes: DataFrame, families: DataFrame) -> DataFrame:
    """Rows (u, v, links): exact comparisons within families, with how many rows a pair of blocks links u to."""
    sizes = settle(families.groupBy("root").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("root", "_root"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    members = join_skewed(families, sizes, {"root": "_root"}, "size", total).select("node", "root", "size")
    tokens = marked(reps.select("uid", "tokens"), "uid", families.select("node"))
    copies = marked(classes.select(F.col("uid").alias("_class"), "copies"), "_class", families.select("node"))
    members = members.join(copies, F.col("node") == F.col("_class")).join(tokens, F.col("node") == F.col("uid"))
    size = F.col("size")
    blocks = F.greatest(F.ceil(size / MOST_FAMILY_BLOCK), F.least(F.lit(FAMILY_BLOCKS), F.ceil(size / FAMILY_BLOCK)))
    dealt = in_blocks(members, "root", size, blocks)
    return dealt.select("root", "a", "b", "block", "uid", "copies", "tokens").mapInArrow(_edges(["root", "a", "b"], exact_similar, True), "u long, v long, links long")


def join_documents(docs: DataFrame, recall: float = TARGET_RECALL, key: str | None = None, tie: str | None = None) -> DataFrame:
    """doc_id, class_id, links and kept for each row of docs (doc_id, text).

    links: how many other rows have a similarity of 0.8 or more to it, exact copies included. class_id: the least
    doc_id of the rows joined to it by links. kept: one row of each class, the one with the least doc_id (a null doc_id
    comes last). Null and empty texts, and texts of white space, have no shingle and no link, and are classes of their own
    (class_id is their doc_id). Texts of one to four words are one shingle, so they link to texts of the same words only.
    Repeated rows link to each other; an empty table gives an empty result. Only doc_id and text are read.

    key: a column of distinct longs in a written table, which the result carries; without it rows have no name but doc_id.
    tie: a column of longs whose least is kept among rows of a class with one doc_id.
    """
    spark = docs.sparkSession
    sets = shingled(docs, runs_for(recall), key=key, tie=tie)
    # min of structs takes nulls first, so whether doc_id is null is compared before it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "uid")).alias("first")
    filled, own = sets.where("n > 0"), sets.select("uid", "doc_id", "k1", "k2", "n")
    classes = settle(filled.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("copies")).withColumn("uid", F.col("first.uid")))
    reps = marked(filled.select("uid", "n", "paths", "runs", "sketch", "tokens"), "uid", classes.select("uid"))
    with scratch(spark) as keep:
        families = keep(_families(reps))
    with scratch(spark) as keep:
        exact = keep(_links(reps, classes, families))
    with scratch(spark) as keep:
        degree = exact.groupBy("u").agg(F.sum("links").alias("near")).withColumnRenamed("u", "_node")
        roots = components(exact.select("u", "v"))
        found = classes.join(degree, F.col("uid") == F.col("_node"), "left").join(roots, F.col("uid") == F.col("node"), "left")
        found = settle(found.select("k1", "k2", "first", "copies", F.coalesce("root", "uid").alias("root"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")))
        tops = found.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("texts"))
        n_texts, n_rows = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
        named = join_skewed(found, tops, {"root": "_root"}, "texts", n_texts)
        named = keep(named.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "copies", "links", F.col("top.doc_id").alias("class_id"), F.col("top.uid").alias("_kept")))
    out = join_skewed(own.where("n > 0"), named, {"k1": "_k1", "k2": "_k2"}, "copies", n_rows)
    out = out.select("uid", "doc_id", "class_id", "links", (F.col("uid") == F.col("_kept")).alias("kept"))
    alone = own.where("n = 0").select("uid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("kept"))
    name = [] if key is None else [F.col("uid").alias(key)]
    return out.union(alone).select(*name, "doc_id", "class_id", F.col("links").cast("long").alias("links"), "kept")
