"""Repair of conversations whose roles must read ``(s?(ua)+)?``, at least cost and with the least audit string.

The repair of a conversation is a walk over four states of its output (nothing yet, after a system turn, after a user
turn, after an assistant turn). Audits of equal cost are compared as strings, so a dynamic program keeps the best audit
per state. Audits share their beginnings: an edit is a node that links to the edit before it, with ancestors at
distances of powers of two and a rolling hash of the whole audit, and two audits are compared by a search for their
longest common prefix over these hashes; what the hashes claim to be equal is verified.

Audits of equal cost over the same rows never are prefixes of each other, as their lengths differ by inserts alone, which
cost. So best audits of consecutive stretches of rows combine, as a product of (min, then least) matrices: a conversation
of any length is cut into segments, which are solved apart for every state they can begin in.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import stored
from lorespan.llm.turns import in_order

#: Rows that are solved at a time are at most two to this power.
SEGMENT_BITS = 12
SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the output: nothing, s, ..u, ..a; what a user or assistant turn leads to, and where a turn may be kept.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
TURN = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
NONE, BLANK, DUPLICATE, CUT = range(4)
HASH_BASE, HASH_PRIME = 1_000_003, (1 << 61) - 1


class Edit:
    """The last edit of an audit, linked to the edits before it."""

    __slots__ = ("before", "char", "depth", "hash", "twin")

    def __init__(self, parent: Edit | None = None, char: str = ""):
        self.char, self.twin = char, None
        if parent is None:
            self.before, self.depth, self.hash = (), 0, 0
            return
        before, step = [parent], 0
        while len(before[step].before) > step:
            before.append(before[step].before[step])
            step += 1
        self.before, self.depth = before, parent.depth + 1
        self.hash = (parent.hash * HASH_BASE + ord(char)) % HASH_PRIME

    def __str__(self) -> str:
        chars, node = [], self
        while node.before:
            chars.append(node.char)
            node = node.before[0]
        return "".join(reversed(chars))


def _lifted(node: Edit, depth: int) -> Edit:
    while node.depth > depth:
        node = node.before[min(len(node.before), (node.depth - depth).bit_length()) - 1]
    return node


def _equal(a: Edit, b: Edit) -> bool:
    """Equal hashes verified edit by edit, down to where the audits are one or have been compared before."""
    walked = []
    while True:
        while a.twin is not None:
            a = a.twin
        while b.twin is not None:
            b = b.twin
        if a is b:
            break
        if a.char != b.char or a.depth != b.depth:
            return False
        walked.append((a, b))
        a, b = a.before[0], b.before[0]
    for a, b in walked:
        b.twin = a
    return True


def less(a: Edit, b: Edit) -> bool:
    """Whether the audit of ``a`` comes first."""
    x, y = _lifted(a, b.depth), _lifted(b, a.depth)
    if x.hash == y.hash:
        return a.depth < b.depth if _equal(x, y) else str(a) < str(b)
    for step in range(len(x.before) - 1, -1, -1):
        if len(x.before) > step and x.before[step].hash != y.before[step].hash:
            x, y = x.before[step], y.before[step]
    return x.char < y.char if _equal(x.before[0], y.before[0]) else str(a) < str(b)


Live = dict[int, tuple[int, Edit]]


def _offer(live: Live, state: int, cost: int, edit: Edit, char: str) -> None:
    best = live.get(state)
    if best is None or cost < best[0]:
        live[state] = cost, Edit(edit, char)
    elif cost == best[0] and less(node := Edit(edit, char), best[1]):
        live[state] = cost, node


def _with_inserts(live: Live) -> Live:
    out = dict(live)
    for _ in range(2):  # a third insert would come back to a state at a higher cost
        for state, (cost, edit) in list(out.items()):
            _offer(out, TURN[state], cost + INSERT, edit, "I")
    return out


def best_paths(rows: list[tuple[str, int]], start: int) -> Live:
    """Best cost and audit per final state of ``(initial, fault)`` rows, inserts before rows only."""
    live: Live = {start: (0, Edit())}
    for initial, fault in rows:
        after: Live = {}
        for state, (cost, edit) in _with_inserts(live).items():
            _offer(after, state, cost + DELETE, edit, "D")
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                if (state, initial) in KEPT:
                    _offer(after, KEPT[state, initial], cost + KEEP + more, edit, "K")
                _offer(after, TURN[state], cost + REROLE + more, edit, "R")
        live = after
    return live


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text)`` after the damage that the checksum of conversation and turn picks; nulls but those of
    ``turn`` are one space, and ``conv`` is ``conv_id`` as a string."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    rows = conversations.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy")).drop("copy")


def _faults(turns: DataFrame) -> DataFrame:
    """``(place, conv, initial, fault)`` of every row: its first fault."""
    again = turns.groupBy("conv", "key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    said = F.rtrim("text", F.lit(SPACE))
    own: Column = F.when(said == "", BLANK).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(NONE)
    rows = turns.select("place", "conv", "key", F.left("role", F.lit(1)).alias("initial"), own.alias("own")).join(again, ["conv", "key"], "left")
    repeated = (F.col("place") > F.col("first")) & (F.col("own") != BLANK)
    return rows.select("place", "conv", "initial", F.when(repeated, DUPLICATE).otherwise(F.col("own")).alias("fault"))


RUN = "conv string, place long, first string, last string, blank long, duplicate long, truncated long, illegal long, paths array<struct<start: int, end: int, cost: long, edits: string>>"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))


def _segment(group: pa.Table) -> pa.Table:
    """A row per conversation of a segment. One that begins inside the segment begins there as a whole."""
    rows, out = sorted(zip(*(group.column(c).to_pylist() for c in ("place", "conv", "initial", "fault")), strict=True)), []
    for conv, run in itertools.groupby(rows, key=lambda r: r[1]):
        run = list(run)
        initials, faults = [r[2] for r in run], [r[3] for r in run]
        starts = range(4) if run[0] is rows[0] else (EMPTY,)
        paths = [{"start": s, "end": e, "cost": cost, "edits": str(edit)} for s in starts for e, (cost, edit) in best_paths([r[2:] for r in run], s).items()]
        out.append({"conv": conv, "place": run[0][0], "first": initials[0], "last": initials[-1], "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": _illegal(initials), "paths": paths})
    path = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    kinds = {"conv": pa.string(), "place": pa.int64(), "first": pa.string(), "last": pa.string()} | {c: pa.int64() for c in COUNTS} | {"paths": pa.list_(path)}
    return pa.Table.from_pylist(out, schema=pa.schema(kinds))


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
#: The edits of a conversation's rows from a place on; the totals stand on the conversation's last stretch.
PLAN = f"conv string, place long, start int, edits string, audit string, cost long, {', '.join(f'{c} long' for c in COUNTS)}"


class _Chain:
    """Edits of consecutive stretches, linked to those before."""

    __slots__ = ("before", "edits", "place", "start")

    def __init__(self, before: _Chain | None, place: int | None, start: int, edits: str):
        self.before, self.place, self.start, self.edits = before, place, start, edits

    def less(self, other: _Chain) -> bool:
        own, others, a, b = [], [], self, other
        while a is not b:  # chains of one conversation have one link per stretch
            own.append(a.edits)
            others.append(b.edits)
            a, b = a.before, b.before
        return "".join(reversed(own)) < "".join(reversed(others))


def _join(runs: Iterator[dict]) -> list[dict]:
    """The best edits of one conversation from its stretches in order; holds four chains of edits."""
    live: dict[int, tuple[int, _Chain | None]] = {EMPTY: (0, None)}
    totals, last = dict.fromkeys(COUNTS, 0), None

    def offer(best: dict, state: int, cost: int, chain: _Chain) -> None:
        if state not in best or cost < best[state][0] or cost == best[state][0] and chain.less(best[state][1]):
            best[state] = cost, chain

    for run in runs:
        after: dict[int, tuple[int, _Chain | None]] = {}
        for path in run["paths"]:
            if path["start"] in live:
                cost, chain = live[path["start"]]
                offer(after, path["end"], cost + path["cost"], _Chain(chain, run["place"], path["start"], path["edits"]))
        live = after
        for c in COUNTS:
            totals[c] += run[c]
        totals["illegal"] += last is not None and last + run["first"] not in LEGAL
        last = run["last"]
    ends = {state: (cost, _Chain(chain, None, state, "")) for state, (cost, chain) in live.items()}
    best: dict[int, tuple[int, _Chain]] = {}
    for state, (cost, end) in ends.items():
        while True:
            if state in (EMPTY, ASSISTANT):
                offer(best, 0, cost, end)
                break
            state, cost, end = TURN[state], cost + INSERT, _Chain(end.before, None, end.start, end.edits + "I")
    cost, chain = best[0]
    out = []
    tail, chain = chain.edits, chain.before
    while chain is not None:
        out.append({"place": chain.place, "start": chain.start, "edits": chain.edits + tail})
        tail, chain = "", chain.before
    out.reverse()
    out[-1] |= totals | {"cost": cost, "audit": "".join(r["edits"] for r in out)}
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("start", pa.int32()), ("edits", pa.string()), ("audit", pa.string()), ("cost", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
    for conv, runs in itertools.groupby(_rows(batches), key=lambda r: r["conv"]):
        yield pa.RecordBatch.from_pylist([{"conv": conv} | r for r in _join(runs)], schema=kinds)


class _Output:
    """Digest of a repaired conversation, fed row by row."""

    def __init__(self):
        self.sha, self.any, self.state, self.edits = hashlib.sha256(), False, EMPTY, iter("")

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def turn(self, text: str) -> None:
        self.state = TURN[self.state]
        self.put(ROLE[self.state], text)

    def row(self, role: str, text: str) -> None:
        for edit in self.edits:
            if edit == "I":
                self.turn("")
                continue
            if edit == "R":
                self.turn(text)
            elif edit == "K":
                self.state = KEPT[self.state, role[:1]]
                self.put(role, text)
            return

    def end(self) -> str:
        for _ in self.edits:  # only inserts are left
            self.turn("")
        return self.sha.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = []
    for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r["conv"]):
        out = _Output()
        for r in rows:
            if r["edits"] is None:
                out.row(r["role"], r["text"])
            else:
                out.edits = iter(r["edits"])
        done.append((conv, out.end()))
        if len(done) == 1024:
            yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["conv", "repaired_sha256"])
            done = []
    if done:
        yield pa.record_batch([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["conv", "repaired_sha256"])


def plans(turns: DataFrame) -> DataFrame:
    """Edits of every stretch of rows, with counts, cost and audit on each conversation's last one (``PLAN``)."""
    faults = _faults(turns).withColumn("segment", F.shiftright("place", SEGMENT_BITS))
    solved = faults.groupBy("segment").applyInArrow(_segment, RUN)
    return solved.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_plans, PLAN)


def digests(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)``: rows stream behind the edits of their stretch. SHA-256 reads one after the other, so
    a conversation's texts pass through one task, which holds one batch of them."""
    nothing = F.lit(None).cast("string")
    rows = turns.select("conv", "place", F.lit(1).alias("kind"), nothing.alias("edits"), "role", "text")
    both = planned.select("conv", "place", F.lit(0).alias("kind"), "edits", nothing.alias("role"), nothing.alias("text")).unionByName(rows)
    return both.repartition("conv").sortWithinPartitions("conv", "place", "kind").select("conv", "edits", "role", "text").mapInArrow(_repaired, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """A row per ``conv_id`` (null is one as well): faults, cost, audit and digest of the repaired conversation.

    Null roles and texts are one space, so such texts are blank and such roles are of no kind. Rows of equal turns are
    ordered as ``turns`` says; repeated rows are duplicates. Role and text are equal if their SHA-256 is. Other columns
    are not read. An empty table gives no row. ``damage=False`` repairs the rows as they are.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    rows = damaged(conversations) if damage else conversations.select(conv, F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    turns = in_order(rows, "conv", "repair_turns")
    planned = stored(plans(turns), "repair_plans")
    gaps = turns.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    totals = planned.filter("audit IS NOT NULL").select("conv", *COUNTS, "cost", "audit")
    all_convs = conversations.select("conv_id", conv).distinct()
    told = all_convs.join(totals, "conv", "left").join(gaps, "conv", "left").join(digests(turns, planned), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    return told.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
