"""Best-fit packing by minimum bin slack, on the histogram of piece lengths.

Documents become token ids plus an end id and are cut into pieces of at most `capacity` ids. Only the number of
pieces of each length, a table of at most `capacity` rows, goes to the driver. There each bin is seeded with the
longest piece left, and a subset-sum dynamic program over bitsets finds the fullest combination of the lengths left
for the rest of the bin. The combination is removed as often as the counts allow, so the number of bins to solve
follows the number of lengths, not the number of pieces. The plan has at most a few rows per length; the pieces find
their bins by their number among the pieces of their length, which is counted within and then across seeded buckets.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, settle, slices

TOKENIZER = "byte_bpe_50k"
END_ID = 0
CAPACITY = 2048
#: Encoded words kept in a worker; the table starts anew when it is full.
CACHED_WORDS = 200_000
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]")


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, with a table of words already seen.

    The tokenizer's pattern never joins a letter, digit or sign to a space after it. So a text whose white space is
    single spaces and line ends is the sequence of its words, each with the space before it; other texts are
    encoded in one go. Ids are those of the tokenizers library's file; a text with one of its special tokens
    is encoded by that library.
    """

    def __init__(self, name: str = TOKENIZER):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.library = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        out = self.words[word] = self._pack(self.encode(" " + word))
        return out

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._pack(self.library.encode(text, add_special_tokens=False).ids)
        if _ODD_SPACE.search(text):
            return self._pack(self.encode(text))
        first, *rest = text.split(" ")
        known, word = self.words.get, self._word
        return self._pack(self.encode(first)) + b"".join([known(w) or word(w) for w in rest])


def encoder(name: str = TOKENIZER) -> WordEncoder:
    """One encoder a worker process."""
    return held(("encoder", name), lambda: WordEncoder(name))


PIECE_SCHEMA = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of docs (doc_id, text). The first piece takes what is left over of a long document."""
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for batch in slices(batches, "text"):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for uid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text")), strict=True):
                ids = encode(text or "") + end
                start, stop, n = 0, (len(ids) // 4 - 1) % capacity + 1, 0
                while start < len(ids) // 4:
                    for out, x in zip(rows, (uid, doc_id, n, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        out.append(x)
                    start, stop, n = stop, stop + capacity, n + 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE_SCHEMA)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats as far as counts allow, whose sum is the largest that is at most room."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n, size = min(counts[length], room // length), 1
        while n > 0:  # parts of 1, 2, 4 ... copies give every number up to n
            part = min(size, n)
            steps.append((reach, length, part))
            reach |= (reach << (length * part)) & mask
            n, size = n - part, size * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            out += [length] * part
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, number of such bins) that use up counts."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        seed = max(left)
        rest = {k: v - (k == seed) for k, v in left.items() if v > (k == seed)}
        lengths = [seed, *fullest(rest, capacity - seed)]
        need = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((lengths, times))
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first numbers of runs of pieces, the bin of each run's first piece, and the offset in the bin."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((used.get(x, 0), first_bin, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        first_bin += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def numbered(rows: DataFrame, key: str, order: list[str], counts: dict[int, int], bucket_rows: int = 20_000) -> DataFrame:
    """Adds n, the number from 0 of a row among those of its key. A key is dealt to buckets, whose sizes add up.

    counts: the rows of each key, which are few. A key has as many buckets as keep each at about bucket_rows rows.
    """
    parts = rows.sparkSession.createDataFrame([(k, max(1, -(-n // bucket_rows))) for k, n in counts.items()], "_length int, _parts long")
    salted = rows.join(F.broadcast(parts), F.col(key) == F.col("_length")).withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_parts")))
    sizes = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_salt").alias("_bucket"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    with_own = salted.withColumn("_own", own)
    return with_own.join(sizes, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_bucket"))).withColumn("n", F.col("_own") + F.col("_before"))


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text).

    A null or empty text is the end id alone. Repeated rows are packed each for itself; a null doc_id stays null. An
    empty table gives an empty result. Other columns are not read. No text passes through the driver.
    """
    cut = settle(pieces(docs, capacity, name, end_id))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = cut.sparkSession.sparkContext.broadcast(places(minimum_bin_slack(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, n = (batch.column(c).to_numpy() for c in ("length", "n"))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for x in np.unique(length):
                at = np.nonzero(length == x)[0]
                first, bins, offsets = plan.value[int(x)]
                run = np.searchsorted(first, n[at], side="right") - 1
                sequence[at], offset[at] = bins[run] + n[at] - first[run], offsets[run]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            kept[3] = kept[3].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # the row's own number parts repeated rows, which would else share a bucket; the written table gives it in each run alike
    ranked = numbered(cut, "length", ["uid", "piece"], counts)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("n").cast("long").alias("n"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
