"""Repair of a conversation's structure at least cost.

The repaired roles' initials are `(s?(ua)+)?`. A turn is kept, given the role user or
assistant (REROLE), or deleted (DELETE; blank and repeated turns must be); turns of
empty text may be inserted (INSERT); a truncated turn costs TRUNCATED more where it
stays. The programme runs over the retained turns only: a turn retained in a role costs
the least, over the role retained before it, of the cost so far, the deletions between
(a difference of prefix sums, so that one running minimum for each last role will do)
and the inserts that the pair of roles asks for. Of equal costs the audit that is least
in ASCII holds; in a gap the deletions therefore come before the inserts, and no audit
of the same turns begins another, so that the order of two audits never changes later.

Rows are sorted over the whole table by conversation, turn (nulls first), role and text;
equal rows are one row with a count. Each stretch of at most CHUNK rows of a conversation
becomes a small matrix, from the role retained before it to the last one in it, of costs
and audits; matrices are folded by conversation. So the rows of one large conversation
are spread over tasks, and only its chunks meet: its audit and the hash of its text,
which have its length themselves, are made by reading the chunks one after the other.

Null roles and texts are one space, as is a null in the key of the damage; a null
conversation is a conversation, null turns come first. Rows of the same turn are taken
by role and text. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlake.llm.scratch import small_batches

REROLE, DELETE, INSERT, TRUNCATED, CHUNK, CHUNK_CHARS = 3, 4, 3, 3, 2048, 4 << 20
NONE, SYSTEM, USER, ASSISTANT = range(4)  # the role retained last
#: Inserts between two retained turns, by the roles' pair; and after the last one.
BETWEEN = {
    (NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1,
    (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1,
}
AFTER = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ROLE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SPACES = " \t\n\x0b\x0c\r"

Edits = tuple[int, str]  # cost and audit


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and how often the row is there, by a hash of conversation and turn."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Equal rows as one, `copies` summed, with `seen`: whether an earlier turn has the
    same role and text; sorted by ranges."""
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = keyed.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("at")).select("conv_id", F.col("at.turn").alias("turn"), "role", "digest")
    mine = firsts.select("*", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first"))
    both = keyed.select("conv_id", "turn", "role", "digest", "text", "copies", F.lit(False).alias("first")).unionByName(mine)
    one = both.groupBy("conv_id", "turn", "role", "digest").agg(F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("first").alias("first"))
    keys = ("conv_id", "turn", "role", "text")
    return one.select(*keys, "copies", (~F.col("first")).alias("seen")).repartitionByRange(*keys).sortWithinPartitions(*keys)


def faults(text: str, seen: bool) -> tuple[bool, bool, bool]:
    """blank, duplicate, truncated: the first that holds."""
    end = text.rstrip(SPACES)[-1:]
    return not end, bool(end) and seen, bool(end) and not seen and end not in ".!?"


def edits(rows: list[tuple[str, bool, bool, int]], entry: int) -> dict[int, Edits]:
    """From the role retained before the rows: by the role retained last, the least edits.
    A row is its role's initial, whether it must go, whether it is truncated, and its copies."""
    # role -> (cost less the deletions before, audit, deletions before)
    held, deleted = {entry: (0, "", 0)}, 0
    for initial, goes, truncated, copies in rows:
        if not copies:
            continue
        new: dict[int, Edits] = {}
        if not goes:
            own = ROLE.get(initial)
            for role in (own, USER, ASSISTANT) if own == SYSTEM else (USER, ASSISTANT):
                price, letter = (TRUNCATED if truncated else 0) + (0 if role == own else REROLE), "K" if role == own else "R"
                ways = [
                    (cost + DELETE * deleted + INSERT * BETWEEN[last, role] + price, audit + "D" * (deleted - since) + "I" * BETWEEN[last, role] + letter)
                    for last, (cost, audit, since) in held.items() if (last, role) in BETWEEN
                ]
                if ways:
                    new[role] = min(ways)
        rest = deleted + 1  # what follows this copy, if it is retained
        deleted += copies
        for role, (cost, audit) in new.items():
            way = (cost - DELETE * rest, audit, rest)
            if role not in held or _whole(way, deleted) < _whole(held[role], deleted):
                held[role] = way
    return {role: _whole(way, deleted) for role, way in held.items()}


def _whole(way: tuple[int, str, int], deleted: int) -> Edits:
    return way[0] + DELETE * deleted, way[1] + "D" * (deleted - way[2])


_CHUNK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64()),
    ("entries", pa.list_(pa.int32())), ("exits", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
    ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())),
])
_CHUNK_SQL = """conv_id long, part int, chunk long, entries array<int>, exits array<int>, costs array<long>, audits array<string>,
    counts array<long>, ends array<string>, turns array<long>, roles array<string>, texts array<string>, copies array<long>"""


def _legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def summary(conv: int | None, rows: list[dict], entries: tuple[int, ...], chunk: int) -> list[dict]:
    """The two rows of a chunk: its matrix and counts (part 0) and its turns (part 1)."""
    counts, judged, present = [0, 0, 0, 0], [], [r for r in rows if r["copies"]]
    for r in present:
        blank, duplicate, truncated = faults(r["text"], r["seen"])
        counts[0] += r["copies"] if blank else 0
        counts[1] += 0 if blank else r["copies"] - 1 + duplicate
        counts[2] += truncated
        counts[3] += r["copies"] - 1
        judged.append((r["role"][:1], blank or duplicate, truncated, r["copies"]))
    counts[3] += sum(not _legal(x[0], y[0]) for x, y in zip(judged, judged[1:], strict=False))
    found = [(e, x, *way) for e in entries for x, way in edits(judged, e).items()]
    turns = [r["turn"] for r in present if r["turn"] is not None]
    matrix = dict(zip(("entries", "exits", "costs", "audits"), map(list, zip(*found, strict=True)), strict=True))
    head = {"conv_id": conv, "chunk": chunk}
    return [
        {**head, "part": 0, **matrix, "counts": counts, "ends": [judged[0][0], judged[-1][0]] if judged else [], "turns": [turns[0], turns[-1], len(set(turns))] if turns else []},
        {**head, "part": 1, "roles": [r["role"] for r in present], "texts": [r["text"] for r in present], "copies": [r["copies"] for r in present]},
    ]


def _chunks(rows: DataFrame) -> DataFrame:
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        size, conv, sure, begun = 0, None, False, False

        def flush(entries: tuple[int, ...]) -> pa.RecordBatch:
            nonlocal held, size, number
            out = pa.RecordBatch.from_pylist(summary(conv, held, entries, number), schema=_CHUNK)
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            for r in batch.to_pylist():
                other = begun and r["conv_id"] != conv
                if held and (other or len(held) >= most or size > CHUNK_CHARS):
                    yield flush((NONE,) if sure else tuple(range(4)))
                    sure = False
                if other:  # it begins here, whatever the task before holds
                    sure = True
                conv, begun = r["conv_id"], True
                held.append(r)
                size += len(r["text"])
        if held:
            yield flush((NONE,) if sure else tuple(range(4)))

    return rows.mapInArrow(run, _CHUNK_SQL)


def fold(chunks: list[dict]) -> tuple[int, list[str]]:
    """The least cost of a conversation, and its audit piece by piece."""
    # role -> (cost, place of its audit among the others, chain of pieces)
    held: dict[int, tuple[int, int, tuple | None]] = {NONE: (0, 0, None)}
    for c in chunks:
        ways: dict[int, tuple[int, int, str, tuple | None]] = {}
        for entry, last, cost, piece in zip(c["entries"], c["exits"], c["costs"], c["audits"], strict=True):
            if entry in held:
                before = held[entry]
                way = (before[0] + cost, before[1], piece, before[2])
                if last not in ways or way[:3] < ways[last][:3]:
                    ways[last] = way
        order = sorted(ways, key=lambda x: ways[x][1:3])
        held = {x: (ways[x][0], order.index(x), (ways[x][3], ways[x][2])) for x in ways}
    cost, _, last = min((cost + INSERT * AFTER[x], place, x) for x, (cost, place, _) in held.items())
    pieces, chain = [], held[last][2]
    while chain is not None:
        chain, piece = chain
        pieces.append(piece)
    return cost, [*pieces[::-1], "I" * AFTER[last]]


class Writer:
    """The repaired turns that an audit makes of the rows."""

    def __init__(self) -> None:
        self.last = NONE

    def turns(self, piece: str, roles: list[str], texts: list[str], copies: list[int]) -> Iterator[tuple[str, str, str]]:
        """edit, role and text of each turn that stays or is added."""
        at = left = -1
        for letter in piece:
            if letter == "I":
                self.last = NEXT[self.last]
                yield letter, "user" if self.last == USER else "assistant", ""
                continue
            if left <= 0:
                at += 1
                left = copies[at]
            left -= 1
            if letter == "R":
                self.last = NEXT[self.last]
                yield letter, "user" if self.last == USER else "assistant", texts[at]
            elif letter == "K":
                self.last = ROLE[roles[at][:1]]
                yield letter, roles[at], texts[at]


_SUMMARY = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class Conversation:
    def __init__(self, conv: int | None):
        self.conv, self.chunks, self.pieces, self.place = conv, [], None, 0
        self.writer, self.hash = Writer(), hashlib.sha256()

    def take(self, row: dict) -> Iterator[dict]:
        """A chunk's matrix, or its turns once all matrices are here; yields repaired turns."""
        if row["part"] == 0:
            self.chunks.append(row)
            return
        if self.pieces is None:
            self.cost, self.pieces = fold(self.chunks)
            self.next = iter(self.pieces)
        yield from self._write(next(self.next), row["roles"], row["texts"], row["copies"])

    def _write(self, piece: str, roles: list[str], texts: list[str], copies: list[int]) -> Iterator[dict]:
        for edit, role, text in self.writer.turns(piece, roles, texts, copies):
            self.hash.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
            yield {"conv_id": self.conv, "place": self.place, "edit": edit, "role": role, "text": text}
            self.place += 1

    def end(self) -> Iterator[dict]:
        yield from self._write(next(self.next), [], [], [])

    def summary(self) -> dict:
        sums = [sum(x) for x in zip(*(c["counts"] for c in self.chunks), strict=True)]
        ends = [c["ends"] for c in self.chunks if c["ends"]]
        turns = [c["turns"] for c in self.chunks if c["turns"]]
        gaps = turns[-1][1] - turns[0][0] + 1 - sum(t[2] for t in turns) + sum(x[1] == y[0] for x, y in zip(turns, turns[1:], strict=False)) if turns else 0
        illegal = sums[3] + sum(not _legal(x[1], y[0]) for x, y in zip(ends, ends[1:], strict=False))
        return {
            "conv_id": self.conv, "gaps": gaps, "blank": sums[0], "duplicate": sums[1], "truncated": sums[2], "illegal": illegal,
            "cost": self.cost, "audit": "".join(self.pieces), "repaired_sha256": self.hash.hexdigest(),
        }


def _folded(chunks: DataFrame, turns: bool) -> DataFrame:
    schema = _TURNS if turns else _SUMMARY

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now: Conversation | None = None

        def close() -> Iterator[dict]:
            last = list(now.end())
            yield from last if turns else [now.summary()]

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.conv:
                    if now is not None:
                        yield from close()
                    now = Conversation(r["conv_id"])
                for turn in now.take(r):
                    if turns:
                        yield turn
        if now is not None:
            yield from close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for r in rows(batches):
            held.append(r)
            size += 100 + len(r["text"] if turns else r["audit"])
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    by_conversation = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return by_conversation.mapInArrow(run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema))


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A row for each conversation of conv_id, turn, role, text, copies: gaps, faults, cost, audit, hash of the repaired text."""
    small_batches(spark)
    return _folded(_chunks(ordered(rows)), turns=False)


def repaired_turns(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place, edit (K, R or I), role, text."""
    small_batches(spark)
    return _folded(_chunks(ordered(rows)), turns=True)
