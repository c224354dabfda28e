"""Repair of conversations: the cheapest edits to legal turns, by bidirectional Dijkstra.

Rows of a conversation, in order of their turn, are kept (cost 0), given the role ``user`` or
``assistant`` (1), deleted (2), or empty rows of these roles are inserted (5), until the initials
of the roles read ``(s?(ua)+)?``.  Blank and duplicate rows must go; a truncated row that stays
costs 5 more.  The lattice has a node for every number of rows consumed and every state of that
grammar.  One heap runs forward from its start, one backward from its ends; when their least
costs together pass the best meeting found, all crossings of that cost are known, and the least
of their joined audits (the initials of the edits) is the answer.  The audit says which edit meets
which row and, by the grammar, which role it gives, so equal audits are equal repairs.

What the lattice needs of a row is one character for its role's initial and one for its fault, so
the search sees strings and not texts.  Rows are numbered across all conversations by a
range-partitioned sort, and a piece is a run of one conversation between two multiples of
``PIECE``: a conversation of any length is cut into pieces.  A piece that touches a cut is solved
from every state to every state, pieces are joined in order, cost by cost and audit by audit.
Texts move once, in the end, to be hashed row by row: a conversation's SHA-256 is one stream by
nature, whose memory does not follow its length (beyond its audit, which is a value of one row).

Null roles and texts are one space; a null turn comes first; a null conv_id is a conversation.
Rows of one turn stand by role, then by the MD5 of their text.  A repeated row is a duplicate.  A
conversation without rows has zeros, an empty audit and the hash of an empty string.  An empty
table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polybag.operators.skew import sorted_rank
from polybag.session import map_arrow, saved, ship_package

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
PIECE = 1024
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"

# Grammar of initials: nothing yet, after s, after u, after a; it may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT},
         ASSISTANT: {"u": USER}}
# The role that an edit may give in each state.
_GIVEN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}

Node = tuple[int, int]
Route = tuple[int, str]


def _edits(initials: str, faults: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    """The edits that lead on from a node: (node, cost, initial)."""
    at, state = node
    given = _NEXT[state][_GIVEN[state]]
    yield (at, given), INSERT, "I"
    if at == len(initials):
        return
    yield (at + 1, state), DELETE, "D"
    if faults[at] in "bd":
        return
    more = TRUNCATED if faults[at] == "t" else 0
    yield (at + 1, given), REROLE + more, "R"
    kept = _NEXT[state].get(initials[at])
    if kept is not None:
        yield (at + 1, kept), KEEP + more, "K"


def _edits_into(initials: str, faults: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    """The edits that lead to a node: (node before, cost, initial)."""
    at, state = node
    for before in STATES:
        for origin in ((at, before), (at - 1, before)):
            if origin[0] >= 0:
                for target, cost, edit in _edits(initials, faults, origin):
                    if target == node:
                        yield origin, cost, edit


class _Side:
    """One of the two searches: the least (cost, audit) of every node it has settled.

    Heaps order by cost, then by rows consumed in the direction of travel: edits of cost 0 consume
    a row, so a node leaves the heap after everything that can improve its audit.  Audits of equal
    cost to one node never begin one another (they would differ in inserts alone), so the least
    audit stays least whatever follows.
    """

    def __init__(self, roots: list[Node], forward: bool) -> None:
        self.forward, self.settled = forward, {}
        self.heap = [(0, self._progress(n), "", n) for n in roots]
        heapq.heapify(self.heap)

    def _progress(self, node: Node) -> int:
        return node[0] if self.forward else -node[0]

    def least(self) -> float:
        while self.heap and self.heap[0][3] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, edits) -> Node:
        cost, _, audit, node = heapq.heappop(self.heap)
        self.settled[node] = cost, audit
        for other, more, edit in edits(node):
            if other not in self.settled:
                heapq.heappush(self.heap, (
                    cost + more, self._progress(other),
                    audit + edit if self.forward else edit + audit, other))
        return node


def cheapest(initials: str, faults: str, start: int = START, ends: tuple[int, ...] = ENDS) -> Route | None:
    """Least (cost, audit) from ``start`` before the first row to one of ``ends`` after the last."""
    n = len(initials)
    ahead, back = _Side([(0, start)], True), _Side([(n, e) for e in ends], False)

    def onward(node):
        return _edits(initials, faults, node)

    def inward(node):
        return _edits_into(initials, faults, node)

    best = float("inf")
    while ahead.least() + back.least() <= best and min(len(ahead.heap), len(back.heap)):
        if ahead.least() <= back.least():
            node = ahead.settle(onward)
            met = [(node, 0)] + [(other, more) for other, more, _ in onward(node)]
            here = ahead.settled[node][0]
            best = min([best, *(here + more + back.settled[o][0] for o, more in met if o in back.settled)])
        else:
            node = back.settle(inward)
            met = [(node, 0)] + [(other, more) for other, more, _ in inward(node)]
            here = back.settled[node][0]
            best = min([best, *(here + more + ahead.settled[o][0] for o, more in met if o in ahead.settled)])
    audits = []
    for node, (cost, audit) in ahead.settled.items():
        if node in back.settled and cost + back.settled[node][0] == best:
            audits.append(audit + back.settled[node][1])
        for other, more, edit in onward(node):
            if other in back.settled and cost + more + back.settled[other][0] == best:
                audits.append(audit + edit + back.settled[other][1])
    return (best, min(audits)) if audits else None


@lru_cache(maxsize=20_000)
def _whole(initials: str, faults: str) -> Route:
    return cheapest(initials, faults)


def routes(initials: str, faults: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) between all states."""
    found = ((a, b, cheapest(initials, faults, a, (b,))) for a in STATES for b in STATES)
    return [(a, b, *route) for a, b, route in found if route]


def joined(pieces: list[list[tuple[int, int, int, str]]]) -> Route:
    """Least (cost, audit) through pieces in order."""
    at: dict[int, Route] = {START: (0, "")}
    for piece in pieces:
        after: dict[int, Route] = {}
        for a, b, cost, audit in piece:
            if a in at:
                route = at[a][0] + cost, at[a][1] + audit
                if b not in after or route < after[b]:
                    after[b] = route
        at = after
    return min(at[e] for e in ENDS if e in at)


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rows): every row as it is after damage, ``rows`` times (0 to 2)."""
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20
    role, text = filled("role"), filled("text")
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("rows"))


def intact(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    return rows.select("conv_id", "turn", *(
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        F.lit(1).alias("rows"))


def _marked(rows: DataFrame) -> DataFrame:
    """One light row per row: its place in the order, role's initial and fault, but no text."""
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    light = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "rows",
                        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    # A dropped row stays as one row without role, so that its conversation is never lost.
    light = light.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("rows", F.lit(1)))))
    seen = Window.partitionBy("conv_id", "role", "digest", F.col("rows") == 0).orderBy("turn", "copy")
    return light.select(
        "conv_id", "turn", "role", "digest", F.row_number().over(seen).alias("nth"),
        (F.col("rows") == 0).alias("dropped"), _initial(F.col("role")).alias("initial"), "blank", "open")


def _pieces(rows: DataFrame, piece: int) -> DataFrame:
    """(conv_id, piece, initials, faults, touches), one row per piece of a conversation."""
    order = ("conv_id", "turn", "role", "digest", "dropped", "nth")
    placed = sorted_rank(_marked(rows), *order, rank="at")
    fault = (F.when(F.col("blank"), "b").when(F.col("nth") > 1, "d").when(F.col("open"), "t").otherwise("k"))
    there = ~F.col("dropped")

    def string(character: Column) -> Column:
        # At most ``piece`` entries.
        found = F.sort_array(F.collect_list(F.when(there, F.struct("at", character.alias("c")))))
        return F.array_join(F.transform(found, lambda e: e.c), "")

    return placed.groupBy("conv_id", F.floor(F.col("at") / piece).alias("piece")).agg(
        string(F.col("initial")).alias("initials"), string(fault).alias("faults"),
        ((F.min("at") % piece == 0) | (F.max("at") % piece == piece - 1)).alias("touches"))


def _solved(pieces: DataFrame) -> DataFrame:
    """Adds the ``routes`` of each piece; one that is a whole conversation has the final one only."""
    ship_package(pieces.sparkSession)

    @F.pandas_udf("array<struct<origin:int,target:int,cost:bigint,audit:string>>")
    def solve(initials: pd.Series, faults: pd.Series, touches: pd.Series) -> pd.Series:
        found = []
        for i, f, cut in zip(initials, faults, touches):
            if cut:
                solved = routes(i, f)
            else:
                # The ends of the grammar are one end.
                solved = [(START, START, *_whole(i, f))]
            found.append([dict(zip(("origin", "target", "cost", "audit"), r)) for r in solved])
        return pd.Series(found)

    return pieces.withColumn("routes", solve("initials", "faults", "touches"))


def _conversations(pieces: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit)."""
    ship_package(pieces.sparkSession)

    @F.pandas_udf("cost bigint, audit string")
    def join(routes: pd.Series) -> pd.DataFrame:
        found = [joined([[(r["origin"], r["target"], r["cost"], r["audit"]) for r in piece["routes"]]
                         for piece in conversation]) for conversation in routes]
        return pd.DataFrame(found, columns=["cost", "audit"])

    # A lookahead finds every legal pair, those that share a row too.
    initials = F.col("initials")
    pairs = F.greatest(F.length(initials) - 1, F.lit(0))
    illegal = pairs - F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    faults = F.col("faults")
    count = {name: F.regexp_count(faults, F.lit(mark)).cast("bigint").alias(name)
             for name, mark in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))}
    whole = F.sort_array(F.collect_list(F.struct("piece", "initials", "faults", "routes")))
    joined_rows = pieces.groupBy("conv_id").agg(whole.alias("p")).select(
        "conv_id", F.array_join("p.initials", "").alias("initials"),
        F.array_join("p.faults", "").alias("faults"),
        join(F.transform("p", lambda e: F.struct(e.routes.alias("routes")))).alias("best"))
    return joined_rows.select("conv_id", *count.values(), illegal.cast("bigint").alias("illegal"),
                              "best.cost", "best.audit")


RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "cost bigint, audit string, repaired_sha256 string")


def _gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps) of the rows that are there."""
    turn = F.when(F.col("rows") > 0, F.col("turn"))
    turns = rows.select("conv_id", turn.alias("turn")).distinct()
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"))


class Repair:
    """Follows an audit along the rows of a conversation and yields the repaired rows."""

    def __init__(self, audit: str) -> None:
        self.edits, self.state = iter(audit), START

    def _give(self) -> str:
        initial = _GIVEN[self.state]
        self.state = _NEXT[self.state][initial]
        return ROLES[initial]

    def row(self, role: str | None, text: str = "") -> Iterator[tuple[str, str]]:
        """The repaired rows up to and including the next row's; after the last with role None."""
        for edit in self.edits:
            if edit == "I":
                yield self._give(), ""
                continue
            if edit == "R":
                yield self._give(), text
            elif edit == "K":
                self.state = _NEXT[self.state][role[:1]]
                yield role, text
            return


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations as streams: first the row with the audit, then the rows in order."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    head = sha = repair = None
    first = True

    def put(rows) -> None:
        nonlocal first
        for role, text in rows:
            sha.update((b"" if first else b"\n") + f"{role}:{text}".encode())
            first = False

    def closed() -> dict:
        put(repair.row(None))
        return head | {"repaired_sha256": sha.hexdigest()}

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["head"]:
                if head is not None:
                    done.append(closed())
                head = {n: row[n] for n in names[:-1]}
                sha, repair, first = hashlib.sha256(), Repair(row["audit"]), True
            else:
                for _ in range(row["rows"]):
                    put(repair.row(row["role"], row["text"]))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if head is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def repaired(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Faults, cheapest audit and hash of the repaired rows, for rows of ``damaged`` or ``intact``."""
    found = _conversations(saved(_solved(_pieces(rows, piece)), "pieces"))
    gaps = _gaps(rows).withColumnRenamed("conv_id", "_id")
    heads = found.join(gaps, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = F.lit(None)
    streams = heads.select(
        "conv_id", F.lit(True).alias("head"), *numbers, "audit", nothing.cast("bigint").alias("turn"),
        nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), F.lit(0).alias("rows"),
    ).unionByName(rows.where("rows > 0").select(
        "conv_id", F.lit(False).alias("head"), *(nothing.cast("bigint").alias(c) for c in numbers),
        nothing.cast("string").alias("audit"), F.col("turn").cast("bigint").alias("turn"), "role", "text", "rows"))
    ordered = streams.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.desc("head"), "turn", "role", F.md5("text"))
    return map_arrow(ordered, _hashed, RESULT)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The repair of the conversations after the contract's damage."""
    return repaired(damaged(conversations))
