"""Conversation structure repair: the cheapest edits that make roles alternate, by dynamic programming over a trie.

A conversation's *signature* has a symbol a row: the role's initial, and whether the row must go (blank, or a repeat of
an earlier one) or is cut off at its end. Conversations with one signature have the same cheapest edits, and signatures
that begin alike have the same layers of the DP up to where they part. So the distinct signatures are sorted and
inserted into a prefix trie; a layer belongs to a node and is computed when the node is made, once for all signatures
below it, and answers are read off at terminal nodes. Sorted insertion closes a branch before the next one opens: the
nodes held at a time are those of one path.

A layer has, for each state of the output (empty; after the system turn; a user's turn open; complete), the least cost,
and the rank of the least audit of that cost. Up to two insertions stand before a row's own edit. Two least audits
of different states differ before either ends, as each ends with a row's own letter, so ranks order all that follow.

Edits: K keeps a row (0), R gives it the role that fits (3), D deletes it (4), I inserts an empty turn (3); a row that
is cut off and stays costs 3 more. The result has role initials ``(s?(ua)+)?`` read as system, then user and assistant
in turns.

A conversation's rows are sorted and read as a stream in its task, twice: once without texts (a digest stands for
them), once for the hash of the repaired text, which is made in the order of turns and so can't be dealt out. Memory
holds a letter a row of the longest conversation, not its texts, whatever share of all rows it has.

Defined cases: null roles and texts are one space, null conversations are one of their own, null turns come first;
rows of one turn stand by role, then by the MD5 of the text, repeats beside the original; equal rows are repeats of
the first; a role without characters has no initial; a conversation without rows after damage has zeros, an empty audit
and the hash of the empty text; an empty table gives no rows; columns beyond conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, lean, utf8

ENDS = ".!?"
RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
LETTERS = "DIKR"
#: States of the output: empty, after a system turn, a user's turn open, complete; and where each role leads.
EMPTY, SYSTEM, OPEN, WHOLE = range(4)
STEP = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: OPEN, SYSTEM: OPEN, WHOLE: OPEN}, "a": {OPEN: WHOLE}}
NEXT = (OPEN, OPEN, WHOLE, OPEN)
INF = 1 << 60
#: A state so much dearer than another never leads to the least cost: from any state two insertions (6) reach a whole
#: conversation, and what another state can do from there costs at most one deletion (4) more.
FAR = 2 * INSERT + DELETE
HELD = 4096


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): rows with nulls as one space; turns are numbers, nulls stay."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), F.lit(0).alias("copy"))


def damage(conversations: DataFrame) -> DataFrame:
    """rows_of with faults made by a hash of conversation and turn; a dropped row has copy -1, a repeat copy 1."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = rows_of(conversations).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).when(F.col("kind") == 0, "").otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).when(F.col("kind") == 0, F.array(F.lit(-1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("copy")]


class Trie:
    """The open path of a prefix trie of signatures, with a DP layer a node.

    Layers with the same differences of cost and the same ranks are one *shape*; what a symbol makes of a shape is
    remembered, as there are few (states that can't lead to the least cost any more are left out). A node holds its shape, its least cost and the way back.
    """

    def __init__(self):
        first = ((0, INF, INF, INF), (0, 0, 0, 0))
        self.shapes, self.known = {first: 0}, [first]
        self.after: dict[tuple[int, str], tuple[int, int, tuple]] = {}
        self.path, self.shape, self.cost, self.back = "", [0], [0], [()]
        self.layers = 0

    def layer(self, shape: int, symbol: str) -> tuple[int, int, tuple]:
        """(shape, least cost, way back: state, insertions and letter of each state) after a symbol."""
        if (shape, symbol) in self.after:
            return self.after[shape, symbol]
        costs, ranks = self.known[shape]
        best: list[tuple | None] = [None] * 4
        role, more = symbol.lower(), CUT_OFF * symbol.isupper()
        for came, cost in enumerate(costs):
            if cost == INF:
                continue
            at = came
            for n in range(3):
                edits = [(DELETE, "D", at)]
                if role != "d":
                    if at in STEP.get(role, ()):
                        edits.append((more, "K", STEP[role][at]))
                    edits.append((RETYPE + more, "R", NEXT[at]))
                for price, letter, to in edits:
                    found = (cost + INSERT * n + price, ranks[came], "I" * n + letter, came, n)
                    if best[to] is None or found < best[to]:
                        best[to] = found
                at = NEXT[at]
        least = min(b[0] for b in best if b)
        best = [b if b and b[0] <= least + FAR else None for b in best]
        place = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
        new = (tuple(b[0] - least if b else INF for b in best), tuple(place[b[1:3]] if b else 0 for b in best))
        if new not in self.shapes:
            self.shapes[new] = len(self.known)
            self.known.append(new)
        out = self.shapes[new], least, tuple((b[3], b[4], b[2][-1]) if b else None for b in best)
        self.after[shape, symbol] = out
        return out

    def insert(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature; signatures come sorted, the nodes of the shared prefix stay."""
        shared = 0
        for a, b in zip(self.path, signature):
            if a != b:
                break
            shared += 1
        for held in (self.shape, self.cost, self.back):
            del held[shared + 1 :]
        for symbol in signature[shared:]:
            shape, least, back = self.layer(self.shape[-1], symbol)
            self.shape.append(shape)
            self.cost.append(self.cost[-1] + least)
            self.back.append(back)
            self.layers += 1
        self.path = signature
        return self.answer()

    def answer(self) -> tuple[int, str]:
        costs, ranks = self.known[self.shape[-1]]
        ends = []
        for state, cost in enumerate(costs):
            at = state
            for n in range(3):
                if cost < INF and at in (EMPTY, WHOLE):
                    ends.append((cost + INSERT * n, ranks[state], n, state))
                at = NEXT[at]
        cost, _, n, state = min(ends)
        letters = ["I" * n]
        for back in reversed(self.back[1:]):
            state, n, letter = back[state]
            letters += [letter, "I" * n]
        return self.cost[-1] + cost, "".join(reversed(letters))


def solve(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, cost, audit) of sorted signatures."""
    trie = Trie()
    for batch in it:
        for i in range(0, batch.num_rows, HELD):
            signatures = batch.column(0).slice(i, HELD).to_pylist()
            found = [trie.insert(s) for s in signatures]
            yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


def survey(kind: pa.DataType):
    """A task's function: (conv_id, gaps, blank, duplicate, truncated, illegal, signature) of rows sorted by conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
    types = [kind, *[pa.int64()] * 5, pa.string()]

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, begun = None, False
        turns, tally, last, signature = [None, None, 0], [0, 0, 0, 0], None, []

        def closed() -> tuple:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            return (conv, gaps, *tally, "".join(signature))

        for batch in it:
            for who, turn, copy, initial, blank, repeat, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or who != conv:
                    if begun:
                        out.append(closed())
                        if len(out) >= HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                            out = []
                    conv, begun = who, True
                    turns, tally, last, signature = [None, None, 0], [0, 0, 0, 0], None, []
                if copy < 0:
                    continue
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                fault = 0 if blank else 1 if repeat else 2 if cut else 3
                if fault < 3:
                    tally[fault] += 1
                tally[3] += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                symbol = initial if initial in ("s", "u", "a") else "x"
                signature.append("d" if fault < 2 else symbol.upper() if fault == 2 else symbol)
        if begun:
            out.append(closed())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return read


def mend(kind: pa.DataType):
    """A task's function: a row a conversation from its head (the facts and the audit) and its sorted rows."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    class Repair:
        def __init__(self, conv, facts: dict, audit: str):
            self.conv, self.facts, self.audit, self.at = conv, facts, audit, 0
            self.state, self.hash, self.first = EMPTY, hashlib.sha256(), True

        def emit(self, role: bytes, text: bytes) -> None:
            self.hash.update((b"" if self.first else b"\n") + role + b":")
            self.hash.update(text)
            self.first = False

        def fitting(self) -> bytes:
            role = b"assistant" if self.state == OPEN else b"user"
            self.state = NEXT[self.state]
            return role

        def inserts(self) -> None:
            while self.at < len(self.audit) and self.audit[self.at] == "I":
                self.emit(self.fitting(), b"")
                self.at += 1

        def row(self, role: str, text: bytes) -> None:
            self.inserts()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.emit(role.encode(), text)
                self.state = STEP[role[0]][self.state]
            elif letter == "R":
                self.emit(self.fitting(), text)

        def closed(self) -> tuple:
            self.inserts()
            return (self.conv, *self.facts.values(), self.audit, self.hash.hexdigest())

    def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: Repair | None = None
        for batch in it:
            for i in range(0, batch.num_rows, 256):
                for who, facts, role, text in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    if facts is None:
                        now.row(role, text)
                        continue
                    if now:
                        out.append(now.closed())
                    now = Repair(who, facts, text.decode())
                if len(out) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if now:
            out.append(now.closed())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return read


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """A row a conversation of rows as :func:`rows_of` or :func:`damage` gives them: its faults, the cost and letters of
    the cheapest edits, and the hash of the repaired conversation."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(rows.schema["conv_id"].dataType)
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    bare = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv_id", "turn", "role", "digest", "copy", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"))
    # Dealt out once; both orders are sorts inside the partitions, which spill.
    seen = Window.partitionBy("conv_id", "role", "digest", F.col("copy") < 0).orderBy(F.asc_nulls_first("turn"), "copy")
    told = narrow.repartition("conv_id").withColumn("repeat", F.row_number().over(seen) > 1).sortWithinPartitions("conv_id", *order())
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long"
    with lean(spark):
        facts = scratch.table(told.select("conv_id", "turn", "copy", "initial", "blank", "repeat", "cut").mapInArrow(survey(arrow), f"conv_id {kind}, {counts}, signature string"), "facts")
        signatures = facts.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
        answers = scratch.table(signatures.mapInArrow(solve, "signature string, cost long, audit string"), "answers")
    head = facts.join(answers, "signature").select("conv_id", F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("facts"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("copy", "int"))], utf8("audit").alias("payload"))
    body = rows.where("copy >= 0").select("conv_id", F.lit(None).cast(f"struct<{counts.replace(' long', ':long')},cost:long>").alias("facts"), "turn", "role", "digest", "copy", utf8("text").alias("payload"))
    both = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("facts").isNull(), *order())
    return both.select("conv_id", "facts", "role", "payload").mapInArrow(mend(arrow), f"conv_id {kind}, {counts}, cost long, audit string, repaired_sha256 string")
