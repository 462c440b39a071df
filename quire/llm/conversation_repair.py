"""Repair of damaged conversations with the cheapest audited list of edits.

A conversation's rows, by turn, are kept, given another role, deleted, or
preceded by inserted empty turns so that its roles read: nothing, or an optional
system turn and then user and assistant in turn.  Of the cheapest edit lists the
one whose initials (D, I, K, R) come first in ASCII order is the audit.

Persistent audit DP: four states (nothing yet, after system, after user, after
assistant) hold the best edit list so far.  Lists share their prefixes: an edit
is a node linked to its parent, with a rolling hash of the whole list and
binary-lifting ancestors that are filled in when first asked for.  Lists of
equal cost are compared at the first edit after their longest common prefix,
found by lifting both over ancestors of unequal hash; the prefixes taken to be
equal are verified link by link, and on a collision the lists are compared whole.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length
spans as many tasks as it needs.  Each task sums up at most ``BLOCK_ROWS`` rows
of one conversation as a block: the best edit list from every state it may be
entered in to every state it may be left in, texts not needed.  Blocks are then
composed in order per conversation by the same DP over block lists; that step and
the audit itself hold a byte or so per row, the texts never meet in one task.
Equal rows are counted before they are dealt, and which row is the first of
equal ones comes from an aggregate, so no frequent text is one group.

Cases: null roles and texts are one space; null turns come first; a null
conversation id is a conversation; rows of one turn are ordered by role, then by
the digest of the text; repeated rows are duplicates; rows whose role is none of
system, user, assistant (by first letter) cannot be kept; an empty table gives no
conversation; texts of any length are read in place; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.llm.common import materialise
from quire.operators.rank import join_on_keys
from quire.session import checkpoint_dir, shuffle_partitions

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: rows of one conversation that a block holds
BLOCK_ROWS = 8192
#: states: nothing yet, after system, after user, after assistant; what may be kept where
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT_TO = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER,
           (USER, "a"): ASSISTANT}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Trail:
    """An edit list: its last label and a link to the list without it."""

    __slots__ = ("parent", "label", "depth", "size", "hash", "ups")

    def __init__(self, parent: "Trail | None" = None, label: str = ""):
        self.parent, self.label = parent, label
        self.depth, self.size, value = (parent.depth + 1, parent.size + len(label), parent.hash) if parent else (0, 0, 0)
        for ch in label:
            value = (value * _BASE + ord(ch)) % _MOD
        self.hash = value
        self.ups = [parent]

    def up(self, k: int) -> "Trail | None":
        """The ancestor 2 ** k links above."""
        while len(self.ups) <= k:
            mid = self.ups[-1]
            self.ups.append(mid.up(len(self.ups) - 1) if mid else None)
        return self.ups[k]

    def above(self, links: int) -> "Trail":
        node, k = self, 0
        while links:
            if links & 1:
                node = node.up(k)
            links >>= 1
            k += 1
        return node

    def text(self, top: "Trail | None" = None) -> str:
        """The labels below ``top`` (all without it)."""
        out, node = [], self
        while node is not None and node is not top:
            out.append(node.label)
            node = node.parent
        return "".join(reversed(out))


def _same(a: Trail, b: Trail) -> bool:
    return a.size == b.size and a.hash == b.hash


def _verified(a: Trail, b: Trail) -> bool:
    """Whether two lists of equal size and hash are equal, link by link."""
    while a is not b:
        if a is None or b is None or a.label != b.label:
            return a is not None and b is not None and a.text() == b.text()
        a, b = a.parent, b.parent
    return True


def before(a: Trail, b: Trail) -> bool:
    """Whether list ``a`` comes before ``b`` in ASCII order."""
    if a is b:
        return False
    x, y = a.above(max(0, a.depth - b.depth)), b.above(max(0, b.depth - a.depth))
    if _same(x, y):
        return a.size < b.size if _verified(x, y) else a.text() < b.text()
    for k in range(x.depth.bit_length() - 1, -1, -1):
        p, q = x.up(k), y.up(k)
        if p is not None and q is not None and not _same(p, q):
            x, y = p, q
    if not _verified(x.parent, y.parent):
        return a.text() < b.text()
    s, t = x.label, y.label
    if s.startswith(t) or t.startswith(s):
        return a.text(x.parent) < b.text(y.parent)
    return s < t


Best = list["tuple[int, Trail] | None"]


def _offer(best: Best, state: int, cost: int, parent: Trail, label: str) -> bool:
    """Take the list (parent, label) for ``state`` if it is better."""
    old = best[state]
    if old is not None and old[0] < cost:
        return False
    node = Trail(parent, label)
    if old is not None and old[0] == cost and not before(node, old[1]):
        return False
    best[state] = (cost, node)
    return True


def insertions(best: Best) -> Best:
    """Best lists after any inserted turns."""
    best, changed = list(best), True
    while changed:
        changed = False
        for state, to in ((START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            if best[state] is not None:
                changed |= _offer(best, to, best[state][0] + INSERT, best[state][1], "I")
    return best


def step(best: Best, initial: str, must_go: bool, truncated: bool) -> Best:
    """Best lists after one more row."""
    out: Best = [None] * 4
    if must_go:  # an insertion may as well follow the deletion: D comes before I
        return [None if x is None else (x[0] + DELETE, Trail(x[1], "D")) for x in best]
    more = TRUNCATED if truncated else 0
    for state, found in enumerate(insertions(best)):
        if found is None:
            continue
        cost, trail = found
        _offer(out, state, cost + DELETE, trail, "D")
        kept = KEPT_TO.get((state, initial))
        if kept is not None:
            _offer(out, kept, cost + KEEP + more, trail, "K")
        _offer(out, ASSISTANT if state == USER else USER, cost + REROLE + more, trail, "R")
    return out


def ended(best: Best) -> tuple[int, Trail]:
    """The best list that leaves an allowed conversation."""
    last = insertions(best)
    empty, turns = last[START], last[ASSISTANT]
    if empty is None or (turns is not None and turns[0] < empty[0]):
        return turns
    if turns is None or empty[0] < turns[0]:
        return empty
    return turns if before(turns[1], empty[1]) else empty


def moved_on(state: int, turns: int = 1) -> int:
    """The state after so many more turns of an allowed conversation."""
    for mark, to in ((START, SYSTEM), (SYSTEM, USER)):
        if turns and state == mark:
            state, turns = to, turns - 1
    return USER + ASSISTANT - state if turns % 2 else state


class Block:
    """Summary of consecutive rows of one conversation."""

    def __init__(self, conv, part: int, no: int, at: int, entries: int):
        self.conv, self.part, self.no, self.at, self.rows = conv, part, no, at, 0
        self.best = [[(0, Trail()) if s == e else None for s in range(4)] for e in range(entries)]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = None

    def add(self, turn, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.rows:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.rows += 1
        self.best = [step(b, initial, blank or duplicate, truncated) for b in self.best]

    def row(self) -> dict:
        cells = [x for b in self.best for x in b]
        return {"conv": self.conv, "part": self.part, "no": self.no, "at": self.at, "blank": self.blank,
                "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "turns": self.turns, "first_turn": self.first_turn, "last_turn": self.last_turn,
                "first_initial": self.first_initial, "last_initial": self.last_initial,
                "costs": [None if x is None else x[0] for x in cells],
                "lists": [None if x is None else x[1].text() for x in cells]}


def _table(rows: list[dict], schema: pa.Schema) -> list[pa.RecordBatch]:
    return pa.Table.from_pylist(rows, schema).to_batches() if rows else []


def _summed_up(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done = None, []
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in
                       ("conv", "turn", "initial", "blank", "cut", "first", "n", "part", "at"))
            for conv, turn, initial, blank, cut, first, n, part, at in zip(*columns):
                for copy in range(n):
                    if block is None or block.conv != conv:
                        if block is not None:
                            done.append(block.row())
                        # the first conversation of a task may have begun in another one
                        block = Block(conv, part, 0, at + copy, 1 if block is not None else 4)
                    elif block.rows >= BLOCK_ROWS:
                        done.append(block.row())
                        block = Block(conv, part, block.no + 1, at + copy, 4)
                    again = not blank and (copy > 0 or not first)
                    block.add(turn, initial, blank, again, cut and not blank and not again)
                    if len(done) >= 1000:
                        yield from _table(done, schema)
                        done = []
        if block is not None:
            done.append(block.row())
        yield from _table(done, schema)

    return run


def _composed(schema: pa.Schema):
    """Blocks, sorted by conversation and place, to one row per conversation."""

    def finish(conv, blocks: list[dict]) -> dict:
        best: Best = [(0, Trail()), None, None, None]
        illegal, turns, last = 0, 0, None
        for x in blocks:
            out: Best = [None] * 4
            for state, found in enumerate(best):
                if found is None:
                    continue
                for to in range(4):
                    cost = x["costs"][4 * state + to]
                    if cost is not None:
                        _offer(out, to, found[0] + cost, found[1], x["lists"][4 * state + to])
            best = out
            illegal += x["illegal"] + (last is not None and last["last_initial"] + x["first_initial"] not in LEGAL)
            turns += x["turns"] - (last is not None and last["last_turn"] is not None
                                   and last["last_turn"] == x["first_turn"])
            last = x
        cost, trail = ended(best)
        audit, labels = trail.text(), []
        while trail is not None and trail.depth:
            labels.append(trail.label)
            trail = trail.parent
        labels.reverse()
        labels = labels[:len(blocks) - 1] + ["".join(labels[len(blocks) - 1:])]  # turns inserted at the very end
        firsts = [x["first_turn"] for x in blocks if x["first_turn"] is not None]
        lasts = [x["last_turn"] for x in blocks if x["last_turn"] is not None]
        # user and assistant come in pairs: an odd number of turns begins with a system turn
        state = START if (len(audit) - audit.count("D")) % 2 else ASSISTANT
        pieces, out_no = [], 0
        for x, label in zip(blocks, labels):
            pieces.append({"part": x["part"], "at": x["at"], "state": state, "out": out_no, "edits": label})
            stays = len(label) - label.count("D")
            state, out_no = moved_on(state, stays), out_no + stays
        return {"conv": conv, "gaps": lasts[-1] - firsts[0] + 1 - turns if firsts else 0,
                "blank": sum(x["blank"] for x in blocks), "duplicate": sum(x["duplicate"] for x in blocks),
                "truncated": sum(x["truncated"] for x in blocks), "illegal": illegal, "cost": cost, "audit": audit,
                "pieces": pieces}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, done = [], []
        for batch in batches:
            for x in batch.to_pylist():
                if blocks and blocks[0]["conv"] != x["conv"]:
                    done.append(finish(blocks[0]["conv"], blocks))
                    blocks = []
                    if len(done) >= 1000:
                        yield from _table(done, schema)
                        done = []
                blocks.append(x)
        if blocks:
            done.append(finish(blocks[0]["conv"], blocks))
        yield from _table(done, schema)

    return run


def _expanded(schema: pa.Schema):
    """Pieces of edit lists to one row per turn that stays or is inserted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[dict] = []
            for x in batch.to_pylist():
                state, at, out = x["state"], x["at"], x["out"]
                for edit in x["edits"]:
                    if edit != "D":
                        state, out = moved_on(state), out + 1
                        done.append({"conv": x["conv"], "position": out, "edit": edit,
                                     "part": x["part"], "at": None if edit == "I" else at,
                                     "new_role": None if edit == "K" else ROLE_OF[state]})
                    at += edit != "I"
                    if len(done) >= 10_000:
                        yield from _table(done, schema)
                        done = []
            yield from _table(done, schema)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range partition and the number of rows before each (counting equal ones)."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = at + n.cumsum()
        at = int(ends[-1]) if len(ends) else at
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(ends - n)],
                                         [*batch.schema.names, "part", "at"])


class Repair:
    """The steps of one repair: ``audits`` and ``turns`` read tables written once."""

    def __init__(self, df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text"):
        self.spark, self.conv_col = df.sparkSession, conv_col
        checkpoint_dir(self.spark)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
        rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                         F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
                         F.unhex(F.sha2(text, 256)).alias("digest"))
        self.kind = dict(rows.dtypes)["conv"]
        self.texts = rows.groupBy("conv", "role", "digest").agg(F.first("text").alias("text"))
        counted = rows.select(
            "conv", "turn", "role", "digest", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
        counted = materialise(counted.groupBy(*counted.columns).agg(F.count(F.lit(1)).alias("n")), "turns")
        firsts = counted.groupBy("conv", "role", "digest").agg(
            F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"))
        first = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
        flagged = join_on_keys(counted, firsts, ["conv", "role", "digest"]).select(
            "conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "blank", "cut",
            F.coalesce(first, F.lit(False)).alias("first"), "n")
        order = ["conv", "turn", "role", "digest"]
        dealt = flagged.repartitionByRange(shuffle_partitions(self.spark), *order).sortWithinPartitions(*order)
        schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes) + ", part int, at long"
        self.rows = dealt.mapInArrow(_numbered, schema).checkpoint()
        self.audited = materialise(self._compose(), "audits")

    def _run(self, df: DataFrame, step, spark_schema: str) -> DataFrame:
        return df.mapInArrow(step(to_arrow_schema(StructType.fromDDL(spark_schema))), spark_schema)

    def _compose(self) -> DataFrame:
        blocks = self._run(self.rows, _summed_up, (
            f"conv {self.kind}, part int, no int, at long, blank long, duplicate long, truncated long, illegal long, "
            "turns long, first_turn long, last_turn long, first_initial string, last_initial string, "
            "costs array<long>, lists array<string>"))
        together = blocks.repartition("conv").sortWithinPartitions("conv", "part", "no")
        return self._run(together, _composed, (
            f"conv {self.kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, pieces array<struct<part: int, at: long, state: int, out: long, edits: string>>"))

    def audits(self) -> DataFrame:
        """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation."""
        return self.audited.drop("pieces").withColumnRenamed("conv", self.conv_col)

    def turns(self) -> DataFrame:
        """(conv_col, position, edit, role, text) of every repaired turn; positions count from 1."""
        pieces = self.audited.select("conv", F.explode("pieces").alias("x")).select("conv", "x.*")
        edits = self._run(pieces, _expanded, f"conv {self.kind}, position long, edit string, part int, at long, new_role string")
        kept = edits.where("edit <> 'I'").drop("conv").join(
            self.rows.select("conv", "role", "digest", "part", "at"), ["part", "at"])
        whole = join_on_keys(kept, self.texts, ["conv", "role", "digest"]).select(
            "conv", "position", "edit", F.coalesce("new_role", "role").alias("role"), "text")
        added = edits.where("edit = 'I'").select("conv", "position", "edit", F.col("new_role").alias("role"),
                                                 F.lit("").alias("text"))
        return whole.unionByName(added).withColumnRenamed("conv", self.conv_col)


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", among: int = 20) -> DataFrame:
    """(conv_col, turn_col, role_col, text_col) of rows damaged by a hash of their
    conversation and turn: of ``among`` values 0 drops the row, 1 empties its text, 2
    removes full stops and the like, 3 repeats it, 4 makes it the user's."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col(conv_col).cast("string"), blank), F.lit(":"),
                     F.coalesce(F.col(turn_col).cast("string"), blank))
    rows = df.select(conv_col, turn_col, F.coalesce(F.col(role_col), blank).alias(role_col),
                     F.coalesce(F.col(text_col), blank).alias(text_col),
                     (F.crc32(named.cast("binary")) % among).alias("_case"))
    case = F.col("_case")
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    return rows.where(case != 0).select(
        conv_col, turn_col, F.when(case == 4, "user").otherwise(F.col(role_col)).alias(role_col), text.alias(text_col),
        F.explode(F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def digests(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, repaired_sha256) of repaired turns, ``role:text`` joined by newlines.
    A hash over a whole conversation is sequential: its turns stream through one
    task in order, sorted outside Python, with nothing but the hash held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, value, any_yet, done = None, None, False, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not any_yet or c != conv:
                    if any_yet:
                        done.append((conv, value.hexdigest()))
                    conv, value, any_yet = c, hashlib.sha256(), True
                else:
                    value.update(b"\n")
                value.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], batch.schema.field(0).type),
                                                  pa.array([x[1] for x in done])], ["conv", "repaired_sha256"])
                done = []
        if any_yet:
            yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field(0).type),
                                              pa.array([value.hexdigest()])], ["conv", "repaired_sha256"])

    rows = turns.select(F.col(conv_col).alias("conv"), "role", "text", "position").repartition("conv")
    rows = rows.sortWithinPartitions("conv", "position")
    kind = dict(rows.dtypes)["conv"]
    return rows.mapInArrow(run, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", conv_col)
