"""Conversation structure repair: the cheapest edits that make a conversation's role initials ``(s?(ua)+)?``.

*Lattice.* A node is (rows consumed, what was emitted last: nothing, s, u or a). Keep emits a row as it is (0), Rerole as user or
assistant (1), Delete drops it (2; the only choice for blank and duplicate rows), Insert emits an empty turn without consuming a row (5);
a truncated row that stays adds 5. *Bidirectional Dijkstra:* a forward heap grows from the start and a reverse heap from the end, one
whole cost at a time, until their next costs exceed the best meeting found; so every crossing of that cost is finished. The least
audit (initials of the edits) is then read off: from the start, all nodes on a cheapest path that share the audit so far move
together along the least next initial, through the crossings into the reverse side. The audit determines the emitted roles. Time and
memory grow with ``n log n`` and ``n`` of a conversation's rows; no audits are kept in the heaps.

*Spark.* The faults of a row are found by built-in functions in windows over fixed-width columns (digest of role and text, last
character); the search reads one byte per row. Texts are shuffled once, to be written out behind their conversation's
audit, as a stream: no task holds a conversation's texts. A conversation is one task's stream, as its audit is one string.

Defined results: ``rows`` has ``conv_id, turn, role, text`` (further columns are ignored); null role or text is one space; rows are taken by
turn (null first), equal turns by role, then by SHA-256 of role and text; rows with a null ``conv_id`` form one conversation. A row's first
fault counts: blank (no character but white space), duplicate (role and text occurred in an earlier row), truncated (last such character
is none of ``.!?``). A role whose first character isn't s, u or a (or that is empty) can't be kept. Repeated rows are duplicates; a
conversation without rows isn't in ``rows`` and so has no result here; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua"
#: State after emitting the initial (0 s, 1 u, 2 a) in each state (0 nothing yet, 1 s, 2 u, 3 a); -1: not legal.
STEP = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
#: State after a turn of the only role that an inserted or rewritten turn can have in each state.
TURN = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 1, 2, 5, 5
FAR = 1 << 60
#: Answers that a worker remembers by the rows' codes, for conversations of up to so many rows.
REMEMBERED, SHORT = 50_000, 32


class Lattice:
    """The edit lattice of rows given as codes ``4 * initial + fault`` (initial 3: none that is legal)."""

    def __init__(self, codes: bytes):
        self.codes, self.end = codes, 4 * (len(codes) + 1)

    def after(self, node: int) -> list[tuple[int, int, str]]:
        """Edges out of a node: target, cost, initial of the edit; the last one of each path leads to ``end``."""
        if node == self.end:
            return []
        row, state = node >> 2, node & 3
        out = [(4 * row + TURN[state], INSERT, "I")]
        if row == len(self.codes):
            return out + [(self.end, 0, "")] if state in (0, 3) else out
        initial, fault = self.codes[row] >> 2, self.codes[row] & 3
        out.append((node + 4, DELETE, "D"))
        if fault <= TRUNCATED:
            more = TRUNCATED_COST * fault
            out.append((4 * row + 4 + TURN[state], REROLE + more, "R"))
            if initial < 3 and STEP[state][initial] >= 0:
                out.append((4 * row + 4 + STEP[state][initial], KEEP + more, "K"))
        return out

    def before(self, node: int) -> list[tuple[int, int]]:
        """Edges into a node: origin and cost."""
        if node == self.end:
            return [(node - 4, 0), (node - 1, 0)]
        row, state = node >> 2, node & 3
        out = [(4 * row + q, INSERT) for q in range(4) if TURN[q] == state]
        if row:
            initial, fault = self.codes[row - 1] >> 2, self.codes[row - 1] & 3
            out.append((node - 4, DELETE))
            if fault <= TRUNCATED:
                more = TRUNCATED_COST * fault
                out += [(4 * row - 4 + q, REROLE + more) for q in range(4) if TURN[q] == state]
                if initial < 3:
                    out += [(4 * row - 4 + q, KEEP + more) for q in range(4) if STEP[q][initial] == state]
        return out


class Front:
    """One side of the search: tentative costs, a heap, and the nodes settled so far (all up to some cost)."""

    def __init__(self, start: int, size: int, edges):
        self.cost, self.settled, self.heap, self.edges = [FAR] * size, bytearray(size), [(0, start)], edges
        self.cost[start] = 0

    def next(self) -> int:
        while self.heap and self.settled[self.heap[0][1]]:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else FAR

    def settle(self, other: list[int], best: int) -> int:
        """Settle every node of the next cost; returns the best meeting with the other side's costs."""
        level = self.next()
        while self.next() == level < FAR:
            _, node = heapq.heappop(self.heap)
            self.settled[node] = 1
            best = min(best, level + other[node])
            for edge in self.edges(node):
                if (cost := level + edge[1]) < self.cost[edge[0]]:
                    self.cost[edge[0]] = cost
                    heapq.heappush(self.heap, (cost, edge[0]))
        return best


def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost, and the least audit among the edits of that cost."""
    lattice = Lattice(codes)
    ahead, back = Front(0, lattice.end + 1, lattice.after), Front(lattice.end, lattice.end + 1, lattice.before)
    best = back.settle(ahead.cost, ahead.settle(back.cost, FAR))
    while ahead.next() + back.next() <= best:
        best = (ahead.settle(back.cost, best) if len(ahead.heap) <= len(back.heap) else back.settle(ahead.cost, best))
    # crossings: edges from a settled node of one side to one of the other at the best cost; then what leads to them
    leads, found = bytearray(lattice.end + 1), []
    for node in range(lattice.end):
        if ahead.settled[node] and any(back.settled[to] and ahead.cost[node] + cost + back.cost[to] == best for to, cost, _ in lattice.after(node)):
            leads[node] = 1
            found.append(node)
    while found:
        node = found.pop()
        for origin, cost in lattice.before(node):
            if ahead.settled[origin] and not leads[origin] and ahead.cost[origin] + cost == ahead.cost[node]:
                leads[origin] = 1
                found.append(origin)
    audit, now, spent = [], {0}, 0
    while True:
        moves: dict[str, set[int]] = {}
        price = {}
        for node in now:
            for to, cost, edit in lattice.after(node):
                if (back.settled[to] and spent + cost + back.cost[to] == best) or (leads[to] and ahead.cost[to] == spent + cost):
                    moves.setdefault(edit, set()).add(to)
                    price[edit] = cost
        least = min(moves)
        if not least:
            return best, "".join(audit)
        audit.append(least)
        now, spent = moves[least], spent + price[least]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by ``crc32("conv_id:turn") % 20`` (nulls: one space): 0 drops the row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 sets role user. A dropped row stays with ``alive`` false, so that its conversation isn't forgotten."""
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), draw.alias("draw"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("draw") != 0).alias("alive"), F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def _keyed(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    alive = F.col("alive") if "alive" in rows.columns else F.lit(True).alias("alive")
    return rows.select("conv_id", "turn", role, text, alive).withColumn(
        "digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


ORDER = ("turn", "role", "digest")


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. An optional column ``alive``
    marks rows that only name their conversation."""
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    lean = _keyed(rows).select(
        "conv_id", "turn", "role", "digest", "alive", initial.alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    ordered = Window.partitionBy("conv_id").orderBy(F.col("alive").desc(), *ORDER)
    placed = lean.withColumn("place", F.row_number().over(ordered))
    same = Window.partitionBy("conv_id", "role", "digest", "alive").orderBy("place")
    fault = (F.when(F.col("blank"), BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(NONE))
    coded = placed.select("conv_id", "place", "turn", F.when(F.col("alive"), 4 * F.col("initial") + fault).otherwise(-1).cast("int").alias("code"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, str]] = {}

        def judged(codes: bytes) -> tuple:
            if (found := known.get(codes)) is None:
                found = cheapest(codes)
                if len(codes) <= SHORT and len(known) < REMEMBERED:
                    known[codes] = found
            faults, initials = np.frombuffer(codes, np.uint8) & 3, np.frombuffer(codes, np.uint8) >> 2
            legal = np.isin(4 * initials[:-1] + initials[1:], (1, 6, 9))  # su, ua, au
            return *(int((faults == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), int((~legal).sum()), *found

        def told(done: list[tuple]) -> pa.RecordBatch:
            kinds = [key_type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names=NAMES)

        key_type, done, codes, started, key = None, [], bytearray(), False, None
        turns = [None, None, 0]  # least, greatest, distinct
        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for conv, turn, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code"))):
                if not started or conv != key:
                    if started:
                        done.append((key, _gaps(turns), *judged(bytes(codes))))
                    started, key, codes, turns = True, conv, bytearray(), [None, None, 0]
                if code >= 0:
                    codes.append(code)
                    if turn is not None and turn != turns[1]:
                        turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            if len(done) > 2_000:
                yield told(done)
                done = []
        if started:
            done.append((key, _gaps(turns), *judged(bytes(codes))))
        if done:
            yield told(done)

    kind = rows.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    return coded.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "turn", "code").mapInArrow(run, shape)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _gaps(turns: list) -> int:
    return 0 if turns[0] is None else turns[1] - turns[0] + 1 - turns[2]


class Replay:
    """Follows an audit: the turns to emit before, for and after the rows that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, TURN[self.state]
            yield ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = STEP[self.state][INITIALS.index(role[0])]
            yield role, text
        elif edit == "R":
            self.state = TURN[self.state]
            yield ROLE[self.state], text

    def rest(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, role, text`` of the repaired conversations; ``found`` is ``audits(rows)``. Each conversation's rows come
    together and in order, within one partition."""
    nothing = [F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("digest", "binary")))]
    both = found.select("conv_id", *nothing, "audit").unionByName(
        _keyed(rows).filter("alive").select("conv_id", "turn", "role", "text", "digest", F.lit(None).cast("string").alias("audit")))
    streams = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER).select("conv_id", "role", "text", "audit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, play, place = None, None, 0
        for batch in batches:
            out = []
            for conv, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    if play:
                        for turn in play.rest():
                            place += 1
                            out.append((key, place, *turn))
                    key, play, place = conv, Replay(audit), 0
                    continue
                for turn in play.row(role, text):
                    place += 1
                    out.append((key, place, *turn))
            yield _rows(out, batch.schema.field("conv_id").type)
            kind = batch.schema.field("conv_id").type
        if play:
            yield _rows([(key, place + k, *turn) for k, turn in enumerate(play.rest(), 1)], kind)

    return streams.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place bigint, role string, text string")


def _rows(out: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    kinds = (key_type, pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["conv_id", "place", "role", "text"])


def sealed(fixed: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the rows of ``repaired``, hashed as they stream by; conversations without a row have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, kind = None, None, None
        for batch in batches:
            out, kind = [], batch.schema.field("conv_id").type
            for conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 1:
                    if digest:
                        out.append((key, digest.hexdigest()))
                    key, digest = conv, hashlib.sha256()
                digest.update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode())
            yield _seals(out, kind)
        if digest:
            yield _seals([(key, digest.hexdigest())], kind)

    return fixed.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {fixed.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def _seals(out: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((key_type, pa.string()))], names=["conv_id", "repaired_sha256"])
