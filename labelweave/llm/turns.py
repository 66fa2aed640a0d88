"""Repair the turn structure of conversations at the least cost.

The rows of a conversation are read once, in order.  A Viterbi search over the places a legal
conversation can be in (nothing yet, after system, after user, after assistant) keeps one survivor
per place.  Survivors are leaves of a tree of edits whose nodes count what hangs on them; as soon as
all survivors descend from one node, the edits up to it are settled, handed out and forgotten.  What
is kept is the unresolved part only.  Equal costs are decided by the whole unresolved parts of both
candidates, back to where they meet.
"""

from __future__ import annotations

import hashlib
import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Staging
from .shipping import map_arrow

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What an edit costs, and what a truncated row that is not deleted adds.
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
LEFT_TRUNCATED = 5

_BEGIN, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Where the initial of a role leads.
_NEXT = (
    {"s": _SYSTEM, "u": _USER},
    {"u": _USER},
    {"a": _ASSISTANT},
    {"u": _USER},
)
#: What may be missing after each place; a conversation is never mended by two in a row, because
#: leaving both out, and deleting a system row before them, is cheaper.
_MISSING = ("user", "user", "assistant", "user")
_LEGAL_PAIRS = {"su", "ua", "au"}
#: ``(a, b, c)``: what can follow ``a`` can follow ``b`` for at most ``c`` more.
_REPLACED = (
    (_BEGIN, _ASSISTANT, COST[DELETE]),
    (_SYSTEM, _ASSISTANT, 0),
    (_SYSTEM, _BEGIN, 0),
    (_USER, _ASSISTANT, COST[INSERT]),
    (_USER, _BEGIN, COST[INSERT]),
    (_ASSISTANT, _USER, COST[INSERT]),
    (_ASSISTANT, _BEGIN, 0),
)
#: Bytes of unresolved texts held in memory; more go to a temporary file of the task.
_SPOOL_BYTES = 8 << 20

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
_SPACE = " \t\n\x0b\x0c\r"


def fault_of(text: str, seen: bool) -> str | None:
    """The first fault of a row: blank, then seen before, then not ended by ``.``, ``!`` or ``?``."""
    body = text.rstrip(_SPACE)
    if not body:
        return BLANK
    if seen:
        return DUPLICATE
    return TRUNCATED if body[-1] not in ".!?" else None


class _Node:
    """One edit of a path; ``holders`` counts the edits and survivors right behind it."""

    __slots__ = ("before", "depth", "edit", "holders", "role", "text")

    def __init__(self, before, edit, role=None, text=None):
        self.before, self.edit, self.role, self.text = before, edit, role, text
        self.depth = before.depth + 1 if before else 0
        self.holders = 0
        if before:
            before.holders += 1


def _release(node: _Node | None) -> None:
    """Forget a path back to the first edit something else still hangs on."""
    while node is not None and not node.holders:
        node, gone = node.before, node
        gone.before = None
        if node is not None:
            node.holders -= 1


def _since_meeting(a: _Node, b: _Node) -> tuple[str, str]:
    """The edits of both paths behind the last one they share."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.before
        else:
            right.append(b.edit)
            b = b.before
    return "".join(reversed(left)), "".join(reversed(right))


@dataclass
class _Candidate:
    cost: int
    node: _Node
    steps: tuple  # (edit, role, text) behind the node

    def beats(self, other: _Candidate | None) -> bool:
        if other is None or self.cost != other.cost:
            return other is None or self.cost < other.cost
        mine, its = _since_meeting(self.node, other.node)
        mine += "".join(step[0] for step in self.steps)
        return mine < its + "".join(step[0] for step in other.steps)


class Repair:
    """The cheapest edits of one conversation, handed out as soon as they are settled."""

    def __init__(self) -> None:
        self.root = _Node(None, "")
        self.alive = {_BEGIN: (0, self.root)}
        self.root.holders = 1
        self.cost = 0
        # Texts of unresolved rows, from byte ``base`` of the conversation on.
        self.spool = tempfile.SpooledTemporaryFile(_SPOOL_BYTES)
        self.base = 0

    def _store(self, text: str) -> tuple[int, int]:
        at = self.base + self.spool.seek(0, 2)
        return at, self.spool.write(text.encode())

    def _load(self, place: tuple[int, int] | None) -> str:
        if place is None:
            return ""
        self.spool.seek(place[0] - self.base)
        return self.spool.read(place[1]).decode()

    def _forget_before(self, place: tuple[int, int]) -> None:
        """Drop the texts up to a settled one, once they are most of what is stored."""
        passed = sum(place) - self.base
        size = self.spool.seek(0, 2)
        if passed < _SPOOL_BYTES // 2 or 2 * passed < size:
            return
        rest = tempfile.SpooledTemporaryFile(_SPOOL_BYTES)
        self.spool.seek(passed)
        shutil.copyfileobj(self.spool, rest)
        self.spool.close()
        self.spool, self.base = rest, self.base + passed

    def _starts(self) -> Iterator[tuple[int, _Candidate]]:
        """Every survivor as it is, and with the row it misses put in."""
        for place, (cost, node) in self.alive.items():
            yield place, _Candidate(cost, node, ())
            missing = _MISSING[place]
            step = ((INSERT, missing, None),)
            yield _NEXT[place][missing[0]], _Candidate(cost + COST[INSERT], node, step)

    def _settle(self, best: dict[int, _Candidate]) -> None:
        for place, instead, more in _REPLACED:
            if place in best and instead in best and best[instead].cost + more < best[place].cost:
                del best[place]
        alive = {}
        for place, found in best.items():
            node = found.node
            for step in found.steps:
                node = _Node(node, *step)
            node.holders += 1
            alive[place] = found.cost, node
        for _, node in self.alive.values():
            node.holders -= 1
            _release(node)
        self.alive = alive

    def _settled(self) -> Iterator[tuple[str, str | None, str]]:
        """The edits all survivors share, from the oldest."""
        if self.root.holders > 1:
            return
        paths = list({id(node): node for _, node in self.alive.values()}.values())
        while len(paths) > 1:  # climb from the deepest until all have met
            deepest = max(paths, key=lambda n: n.depth)
            paths.remove(deepest)
            if all(n is not deepest.before for n in paths):
                paths.append(deepest.before)
        edits, node = [], paths[0]
        while node is not self.root:
            edits.append(node)
            node = node.before
        last = None
        for node in reversed(edits):
            last = node.text or last
            yield node.edit, node.role, self._load(node.text)
        self.root = paths[0]
        self.root.before = None
        if last is not None:
            self._forget_before(last)

    def add(self, role: str, text: str, fault: str | None) -> Iterator[tuple[str, str | None, str]]:
        """Take the next row; gives settled edits with the role and text they leave."""
        best: dict[int, _Candidate] = {}
        gone = fault in (BLANK, DUPLICATE)
        held = None if gone else self._store(text)
        extra = LEFT_TRUNCATED if fault == TRUNCATED else 0

        def offer(place: int, start: _Candidate, edit: str, new_role: str | None, more: int) -> None:
            step = (edit, new_role, None if new_role is None else held)
            found = _Candidate(start.cost + COST[edit] + more, start.node, (*start.steps, step))
            if found.beats(best.get(place)):
                best[place] = found

        for place, start in self._starts():
            offer(place, start, DELETE, None, 0)
            if gone:
                continue
            for initial, after in _NEXT[place].items():
                if role[:1] == initial:
                    offer(after, start, KEEP, role, extra)
                elif initial != "s":
                    offer(after, start, REROLE, "user" if initial == "u" else "assistant", extra)
        self._settle(best)
        yield from self._settled()

    def finish(self) -> Iterator[tuple[str, str | None, str]]:
        """The edits that were still open, after the last row."""
        best = None
        for place, start in self._starts():
            if place in (_BEGIN, _ASSISTANT) and start.beats(best):
                best = start
        self._settle({_BEGIN: best})
        self.cost = best.cost
        yield from self._settled()
        self.spool.close()


@dataclass
class _Faults:
    """What is counted of the rows of a conversation as they pass."""

    gaps: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    before: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> str | None:
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in _LEGAL_PAIRS
            seen = seen or self.before == (turn, role, text)
        self.before = turn, role, text
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
            self.gaps = (turn - self.first_turn + 1 - self.turns + 2**63) % 2**64 - 2**63
        fault = fault_of(text, seen)
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        return fault


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conversation, faults, repair, edit)`` in order; the edit is None at a conversation's end."""
    found = None
    for conversation, turn, role, text, seen in _rows(batches):
        if found is None or found[0] != conversation:
            if found is not None:
                yield from ((*found, edit) for edit in found[2].finish())
                yield (*found, None)
            found = conversation, _Faults(), Repair()
        fault = found[1].add(turn, role, text, seen)
        yield from ((*found, edit) for edit in found[2].add(role, text, fault))
    if found is not None:
        yield from ((*found, edit) for edit in found[2].finish())
        yield (*found, None)


def _in_order(rows: DataFrame, id_column: str, staging: Staging) -> DataFrame:
    """Rows of a conversation together and in order, with a mark on repeats of earlier turns.

    Rows of one turn are put in the order of role and text.  Only the keys of repeated rows are
    joined back; equal rows of one turn become neighbours and are told apart as they pass.
    """
    clean = rows.select(
        F.col(id_column).alias("id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    clean = clean.withColumn(
        "said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    )
    repeats = clean.groupBy(F.col("id").alias("of"), F.col("said").alias("again")).agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    repeats = staging.write(repeats.filter("n > 1").drop("n"), "repeats")
    marked = clean.join(
        repeats, F.col("id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("again")), "left"
    )
    earlier = F.col("again").isNotNull() & F.coalesce(
        F.col("first.turn") < F.col("turn"),
        F.col("first.turn").isNull() & F.col("turn").isNotNull(),
    )
    together = marked.select("id", "turn", "role", "text", earlier.alias("seen")).repartition("id")
    return together.sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")


_BATCH = 4096


def repair(rows: DataFrame, id_column: str = "conv_id", staging: Staging | None = None) -> DataFrame:
    """The edits that make every conversation ``(system? (user assistant)+)?``, in order.

    ``<id>, place, edit, role, text``: one row per edit with its place in the conversation from 0;
    role and text are what is left there, null after a deletion.  Blank and repeated rows are always
    deleted.  Null roles and texts count as one space, rows without a turn come first, rows of one
    turn are ordered by role and text, and rows without an id are one conversation.  An empty role
    has no initial, so it is never kept.  Other columns are not read.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    names = ["id", "place", "edit", "role", "text"]

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, types = None, [pa.int64(), pa.string(), pa.string(), pa.string()]
        out, place = [], 0

        def kept(batches):
            nonlocal schema
            for batch in batches:
                schema = pa.schema(
                    [("id", batch.schema.field(0).type), *zip(names[1:], types, strict=True)]
                )
                yield batch

        def made():
            columns = zip(*out, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for conversation, _, _, edit in _walk(kept(batches)):
            if edit is None:
                place = 0
                continue
            letter, role, text = edit
            out.append((conversation, place, letter, role, None if role is None else text))
            place += 1
            if len(out) == _BATCH:
                yield made()
                out = []
        if out:
            yield made()

    ordered = _in_order(rows, id_column, staging or Staging(rows.sparkSession))
    found = map_arrow(ordered, edits, f"id {kind}, place long, edit string, role string, text string")
    return found.withColumnRenamed("id", id_column)


def repair_digests(
    rows: DataFrame, id_column: str = "conv_id", staging: Staging | None = None
) -> DataFrame:
    """One row per conversation of ``rows``: its faults, its cheapest edits and a hash of the repair.

    ``<id>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of the rows and
    edits of :func:`repair`, under the same rules.  Edits are hashed as they are settled, so a
    conversation's texts are never in memory together.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def kept(batches):
            nonlocal schema
            for batch in batches:
                schema = pa.schema(
                    [("id", batch.schema.field(0).type)]
                    + [(name, pa.int64()) for name in [*counts, "cost"]]
                    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
                )
                yield batch

        def made():
            columns = zip(*out, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        out, audit, digest, lines = [], bytearray(), hashlib.sha256(), 0
        for conversation, faults, search, edit in _walk(kept(batches)):
            if edit is not None:
                audit += edit[0].encode()
                if edit[1] is not None:
                    line = f"{edit[1]}:{edit[2]}".encode("utf-8", "surrogatepass")
                    digest.update(b"\n" + line if lines else line)
                    lines += 1
                continue
            found = [getattr(faults, name) for name in counts]
            out.append((conversation, *found, search.cost, audit.decode(), digest.hexdigest()))
            audit, digest, lines = bytearray(), hashlib.sha256(), 0
            if len(out) == _BATCH:
                yield made()
                out = []
        if out:
            yield made()

    ordered = _in_order(rows, id_column, staging or Staging(rows.sparkSession))
    schema = f"id {kind}, {', '.join(f'{c} long' for c in [*counts, 'cost'])}, audit string"
    found = map_arrow(ordered, digests, f"{schema}, repaired_sha256 string")
    return found.withColumnRenamed("id", id_column)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with known faults, chosen by a checksum of conversation and turn.

    Of twenty remainders 0 drops a row, 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3
    repeats the row and 4 makes its role ``user``.  Nulls count as one space in the checksum, roles
    and texts.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    chance = F.crc32(F.encode(F.concat_ws(":", *name), "UTF-8")) % 20
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        chance.alias("chance"),
    )
    text = F.when(F.col("chance") == 1, "").when(
        F.col("chance") == 2, F.regexp_replace("text", "[.!?]", "")
    )
    times = F.when(F.col("chance") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("chance <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.coalesce(text, "text").alias("text"),
        F.explode(times).alias("copy"),
    )


#: SHA-256 of nothing.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def repaired_conversations(conversations: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Digest of the repair of every conversation after :func:`damaged`, also of those left empty."""
    found = repair_digests(damaged(conversations), staging=staging)
    every = conversations.select(F.col("conv_id").alias("known")).distinct()
    joined = every.join(found, F.col("known").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("known").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
    )
