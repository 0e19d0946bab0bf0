"""Conversation structure repair: the cheapest edits that make each conversation a legal one, solved once a signature.

Rows become codes (role initial, fault), and runs of SEGMENT codes of a conversation become compact strings, its
signatures. Each distinct signature is solved once, by memoised recursion: for each state before it and after it, the least
cost and, of equally cheap edits, the ASCII-least. Solutions join back by signature, a conversation's segments are chained, and
its rows are replayed against the edits.

Edits of two ways through a segment from one state to one other never begin with each other (a way ends with its last row's
edit, and both have an edit for each row), so whatever comes after, the lesser string stays the lesser: chaining is exact.

Rows are numbered by ranges and segments hold SEGMENT rows, so no task gathers a conversation until the last step. There the
conversation, whose digest is of one sequence of bytes, passes through one task as a sorted stream: held are its edits (one
letter a row, which the result has in one cell anyway) and one batch of rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, scratch, settle
from .merkle import numbered

#: Rows of a signature.
SEGMENT = 128
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing written yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of a row that is made to fit
_KEPT = {(START, "s"): SYSTEM} | {(s, "a" if to == ASSISTANT else "u"): to for s, to in _NEXT.items()}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_SHOWN, _CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
LEGAL = ("su", "ua", "au")

Way = tuple[int, str]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of rows, damaged by crc32 of `conv_id:turn` modulo 20; see repair()."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return own.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


def group_of(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def coded(rows: DataFrame) -> DataFrame:
    """Rows (group, _idx, turn, fault, code) of damaged rows (group, turn, role, text, mark), in their conversation's order.

    fault: blank, duplicate, truncated or "". code: the role's initial (s, u, a, or o for others) and `x` for a row that has to
    go, `t` for a truncated one, else `.`.
    """
    fault = F.when(~F.col("text").rlike(_SHOWN), "blank").when(~F.col("text").rlike(_CLOSED), "truncated").otherwise("")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    narrow = settle(numbered(rows.select("group", "turn", "role", "mark", initial.alias("initial"), fault.alias("fault")), "group", ["turn", "role", "mark"]))
    firsts = narrow.groupBy(F.col("group").alias("_g"), "role", "mark").agg(F.min("_idx").alias("_first")).select("_g", "_first")
    met = narrow.join(firsts, (F.col("group") == F.col("_g")) & (F.col("_idx") == F.col("_first")), "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("_first").isNull(), "duplicate").otherwise(F.col("fault"))
    found = met.select("group", "_idx", "turn", "initial", fault.alias("fault"))
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise(".")
    return found.select("group", "_idx", "turn", "fault", F.concat("initial", mark).alias("code"))


def inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _NEXT[state]
    return state


def solve(signature: str) -> dict[tuple[int, int], Way]:
    """(cost, edits) of the best way from a state before the rows of a signature to one after them, where there is one.

    Up to two turns are inserted before a row; a third would lead to a state that was there before.
    """
    codes = [signature[i : i + 2] for i in range(0, len(signature), 2)]

    @functools.cache
    def best(i: int, state: int, last: int) -> Way | None:
        if i == len(codes):
            return (0, "") if state == last else None
        (initial, mark), ways = codes[i], []
        for n in range(3):
            at = inserted(state, n)
            steps = [(DELETE, "D", at)]
            if mark != "x":
                more = TRUNCATED if mark == "t" else 0
                steps.append((REROLE + more, "R", _NEXT[at]))
                if (at, initial) in _KEPT:
                    steps.append((more, "K", _KEPT[at, initial]))
            for cost, edit, to in steps:
                if rest := best(i + 1, to, last):
                    ways.append((INSERT * n + cost + rest[0], "I" * n + edit + rest[1]))
        return min(ways, default=None)

    return {(s, e): way for s in range(STATES) for e in range(STATES) if (way := best(0, s, e))}


#: What ends a conversation from each state: nothing is legal, and so is what ends with an assistant's turn.
ENDS: dict[int, Way] = {s: min((INSERT * n, "I" * n) for n in range(3) if inserted(s, n) in (START, ASSISTANT)) for s in range(STATES)}


def chain(segments: list[tuple[list[int | None], list[str]]]) -> Way:
    """(cost, edits) of a conversation from the solutions of its segments: costs and edits by state before and after."""
    after, choices = {s: ENDS[s][0] for s in range(STATES)}, []
    for costs, edits in reversed(segments):
        options = [min((costs[s * STATES + e] + after[e], edits[s * STATES + e], e) for e in range(STATES) if costs[s * STATES + e] is not None) for s in range(STATES)]
        after = {s: options[s][0] for s in range(STATES)}
        choices.append([o[2] for o in options])
    state, out = START, []
    for (_, edits), choice in zip(segments, reversed(choices), strict=True):
        out.append(edits[state * STATES + choice[state]])
        state = choice[state]
    return after[START], "".join(out) + ENDS[state][1]


SOLVED = "_signature string, _count long, costs array<long>, edits array<string>"


def solved(signatures: DataFrame) -> DataFrame:
    """Rows of SOLVED from distinct signatures (_signature, _count)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(s) for s in batch.column(0).to_pylist()]
            slots = [(s, e) for s in range(STATES) for e in range(STATES)]
            costs = pa.array([[f[k][0] if k in f else None for k in slots] for f in found], pa.list_(pa.int64()))
            edits = pa.array([[f[k][1] if k in f else "" for k in slots] for f in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), costs, edits], names=["_signature", "_count", "costs", "edits"])

    return signatures.select("_signature", "_count").mapInArrow(work, SOLVED)


class Replay:
    """One conversation: its head, its segments and then its rows, in order."""

    def __init__(self, head: dict):
        self.head, self.segments, self.illegal, self.before = head, [], 0, ""
        self.digest, self.written, self.state, self.audit, self.at = hashlib.sha256(), False, START, None, 0

    def segment(self, signature: str, costs: list[int | None], edits: list[str]) -> None:
        initials = self.before + signature[::2]
        self.illegal += sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        self.before = initials[-1:]
        self.segments.append((costs, edits))

    def _write(self, role: str, text: str, state: int) -> None:
        self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written, self.state = True, state

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(_ROLE[_NEXT[self.state]], "", _NEXT[self.state])
            self.at += 1

    def plan(self) -> None:
        if self.audit is None:
            self.cost, self.audit = chain(self.segments) if self.segments else (0, "")
            self.segments = []

    def row(self, role: str, text: str) -> None:
        self.plan()
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._write(role, text, _KEPT[self.state, role[:1]])
        elif edit == "R":
            to = _NEXT[self.state]
            self._write(_ROLE[to], text, to)

    def done(self) -> dict:
        self.plan()
        self._insert()
        if self.at != len(self.audit):
            raise ValueError("edits without rows")
        return self.head | {"illegal": self.illegal, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.digest.hexdigest()}


COUNTS = ("gaps", "blank", "duplicate", "truncated")
REPAIRED = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows, after damage.

    rows has conv_id, turn, role and text; other columns take no part, whatever their names. A null role or text is one
    space, a null conv_id is a conversation of its own, and null turns come first. Rows of one turn are in order of role, then of
    the text's digest; equal rows stand side by side and all but the first are duplicates. Texts are read whole. A conversation
    that the damage empties has zeros, an empty audit and the digest of nothing. An empty table gives no rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    with scratch(rows.sparkSession) as keep:
        own = keep(damaged(rows).select(group_of(F.col("conv_id")).alias("group"), "turn", "role", "text", F.sha2("text", 256).alias("mark")))
        codes = settle(coded(own))
        one = lambda k: F.count_if(F.col("fault") == k).alias(k)
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
        counts = codes.groupBy(F.col("group").alias("_g")).agg(gaps, *[one(k) for k in COUNTS[1:]])
        every = rows.select("conv_id").distinct().withColumn("group", group_of(F.col("conv_id")))
        heads = every.join(counts, F.col("group") == F.col("_g"), "left").select("group", "conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
        number = F.floor(F.col("_idx") / SEGMENT).alias("number")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("_idx", "code"))), lambda x: x["code"])
        segments = settle(codes.groupBy("group", number).agg(F.concat_ws("", ordered).alias("signature")))
        found = settle(solved(settle(segments.groupBy(F.col("signature").alias("_signature")).agg(F.count(F.lit(1)).alias("_count")))))
        ways = keep(join_skewed(segments, found, {"signature": "_signature"}, "_count", segments.count()).select("group", "number", "signature", "costs", "edits"))
        heads = keep(heads)
    none = lambda t: F.lit(None).cast(t)
    a = heads.select("group", F.lit(0).alias("step"), none("long").alias("number"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("mark"), none("string").alias("text"), none("array<long>").alias("costs"), none("array<string>").alias("edits"), "conv_id", *COUNTS)
    empty = [none(kind).alias("conv_id"), *[none("long").alias(c) for c in COUNTS]]
    b = ways.select("group", F.lit(1), "number", none("long"), none("string"), none("string"), "signature", "costs", "edits", *empty)
    c = own.select("group", F.lit(2), none("long"), F.col("turn").cast("long"), "role", "mark", "text", none("array<long>"), none("array<string>"), *empty)
    keys = ("group", "step", "number", "turn", "role", "mark")
    dealt = a.union(b).union(c).repartition("group").sortWithinPartitions(*keys)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Replay | None = None
        for batch in batches:
            out, heads = [], {k: batch.column(k) for k in ("conv_id", *COUNTS)}
            columns = [batch.column(k).to_pylist() for k in ("step", "role", "text", "costs", "edits")]
            for i, (step, role, text, costs, edits) in enumerate(zip(*columns, strict=True)):
                if step == 2:
                    now.row(role, text)
                elif step == 1:
                    now.segment(text, costs, edits)
                else:
                    if now is not None:
                        out.append(now.done())
                    now = Replay({k: x[i].as_py() for k, x in heads.items()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.done()], schema=schema)

    shape = REPAIRED.format(kind=kind)
    schema = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in rows.sparkSession.createDataFrame([], shape).schema])
    return dealt.mapInArrow(replay, shape)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
