"""Cheapest repair of the order of a conversation's turns, by a Viterbi search whose survivors coalesce.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. Rows are
kept (cost 0), given the role user or assistant (3), deleted (4, required of blank and repeated rows), and user or
assistant turns with an empty text are inserted anywhere (3); a truncated row that stays costs 3 more. Of the cheapest
sequences of edits the one whose initials (D, I, K, R) come first in ASCII order is taken; it fixes the roles.

For each state of the grammar the search holds one survivor, a leaf of a tree of back pointers. Nodes count their
references: what no survivor descends from is freed, and once all survivors share an ancestor the edits down to it are
final and leave the tree. Survivors of one cost are compared by their whole unresolved suffixes. A survivor goes as soon
as another one could do whatever it may still do for less (``COVER``), so survivors meet within a few rows, except in
a run of rows that all must change their role: its first edit depends on its length, and the run is held to its end.

Rows of a conversation come to one task in order and run through it: memory is the set of unresolved rows, not the
conversation. Repeated rows are found beforehand, by a window over conversation, role and digest of the text.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.words import CONTROLS

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"
#: States: nothing written, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
KEEPS = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: ASKED, SYSTEM: ASKED, ANSWERED: ASKED},
    "a": {ASKED: ANSWERED},
}
#: (state, other state): what the other one pays at most beyond whatever the state may still pay. From the costs of
#: deleting a system turn and of inserting what is missing.
COVER = {
    (NOTHING, SYSTEM): max(2 * INSERT, DELETE),
    (NOTHING, ASKED): INSERT + DELETE,
    (NOTHING, ANSWERED): DELETE,
    (SYSTEM, NOTHING): 0,
    (SYSTEM, ASKED): INSERT,
    (SYSTEM, ANSWERED): 0,
    (ASKED, NOTHING): INSERT,
    (ASKED, SYSTEM): INSERT,
    (ASKED, ANSWERED): INSERT,
    (ANSWERED, NOTHING): 0,
    (ANSWERED, SYSTEM): 2 * INSERT,
    (ANSWERED, ASKED): INSERT,
}
FINE, BLANK, DUPLICATE, CUT = "", "blank", "duplicate", "truncated"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Node:
    """One edit of the tree of back pointers."""

    __slots__ = ("edit", "parent", "children", "depth", "held")

    def __init__(self, edit: str, parent: Node | None):
        self.edit, self.parent = edit, parent
        self.children: dict[str, Node] = {}
        self.depth = 0 if parent is None else parent.depth + 1
        self.held = False

    def grown(self, edit: str) -> Node:
        """The child for one more edit; an edit leads from a survivor to one state only, so it names the child."""
        found = self.children.get(edit)
        if found is None:
            found = self.children[edit] = Node(edit, self)
        return found


def before(x: Node, y: Node) -> bool:
    """Whether the edits of ``x`` come first in ASCII order; survivors of one cost are never one the start of the other."""
    while x.depth > y.depth:
        x = x.parent
    while y.depth > x.depth:
        y = y.parent
    while x.parent is not y.parent:
        x, y = x.parent, y.parent
    return x.edit < y.edit


Survivors = dict[int, tuple[int, Node]]


class Repair:
    """The search over one conversation; ``add`` and ``end`` give the edits that became final, as a string."""

    def __init__(self) -> None:
        self.root = Node("", None)
        self.survivors: Survivors = {}
        self._settle({NOTHING: (0, self.root)})

    @staticmethod
    def _offer(to: Survivors, state: int, cost: int, node: Node, edit: str) -> None:
        have = to.get(state)
        if have is None or cost < have[0]:
            to[state] = cost, node.grown(edit)
        elif cost == have[0]:
            new = node.grown(edit)
            if new is not have[1] and before(new, have[1]):
                to[state] = cost, new

    def _settle(self, found: Survivors) -> None:
        """Adds what insertions reach, drops survivors that others cover, and frees what nobody descends from."""
        old = [node for _, node in self.survivors.values()]
        for state, to in ((ANSWERED, ASKED), (NOTHING, ASKED), (SYSTEM, ASKED), (ASKED, ANSWERED)):
            if state in found:
                self._offer(found, to, found[state][0] + INSERT, found[state][1], "I")
        self.survivors = {
            state: (cost, node)
            for state, (cost, node) in found.items()
            if not any(other != state and cost > found[other][0] + COVER[state, other] for other in found)
        }
        for node in old:
            node.held = False
        for _, node in self.survivors.values():
            node.held = True
        # Leaves that nobody holds lie at most a row's edits below the survivors before.
        for node in [n for start in (*old, self.root) for n in self._leaves(start)]:
            while not node.children and not node.held and node.parent is not None:
                parent = node.parent
                if parent.children.get(node.edit) is node:
                    del parent.children[node.edit]
                node = parent

    @staticmethod
    def _leaves(start: Node) -> list[Node]:
        """Leaves among the node, its children and theirs down to three edits (a row's edit and two insertions)."""
        level, leaves = [start], []
        for _ in range(4):
            leaves += [n for n in level if not n.children]
            level = [c for n in level for c in n.children.values()]
        return leaves

    def _final(self) -> str:
        """Edits above the lowest ancestor that all survivors share; they leave the tree."""
        out = []
        while len(self.root.children) == 1 and not self.root.held:
            (child,) = self.root.children.values()
            out.append(child.edit)
            child.parent = None
            self.root = child
        return "".join(out)

    def add(self, initial: str, fault: str) -> str:
        found: Survivors = {}
        stays = fault not in (BLANK, DUPLICATE)
        extra = TRUNCATED if fault == CUT else 0
        for state, (cost, node) in self.survivors.items():
            self._offer(found, state, cost + DELETE, node, "D")
            if stays:
                kept = KEEPS.get(initial, {}).get(state)
                if kept is not None:
                    self._offer(found, kept, cost + extra, node, "K")
                self._offer(found, ANSWERED if state == ASKED else ASKED, cost + extra + REROLE, node, "R")
        self._settle(found)
        return self._final()

    def end(self) -> tuple[str, int]:
        """The edits left and the cost of all."""
        best: tuple[int, Node] | None = None
        for state in (NOTHING, ANSWERED):
            mine = self.survivors.get(state)
            if mine and (best is None or mine[0] < best[0] or (mine[0] == best[0] and before(mine[1], best[1]))):
                best = mine
        cost, node = best
        out = []
        while node is not self.root:
            out.append(node.edit)
            node = node.parent
        return "".join(reversed(out)), cost

    def size(self) -> int:
        """Nodes of the tree."""
        todo, seen = [self.root], 0
        while todo:
            node = todo.pop()
            seen += 1
            todo += node.children.values()
        return seen


class Writer:
    """Turns edits into rows, holding those rows of the conversation that no edit is final for yet."""

    def __init__(self) -> None:
        self.search, self.waiting, self.state, self.step = Repair(), deque(), NOTHING, 0

    def _role(self) -> str:
        return ASSISTANT if self.state == ASKED else USER

    def rows(self, edits: str) -> Iterator[tuple]:
        """(step, edit, turn, role, new_role, text, fault); inserted rows have no turn, role or fault."""
        for edit in edits:
            turn, role, text, fault = (None, None, "", None) if edit == "I" else self.waiting.popleft()
            new = None
            if edit == "K":
                new, self.state = role, KEEPS[role[0]][self.state]
            elif edit != "D":
                new = self._role()
                self.state = ANSWERED if self.state == ASKED else ASKED
            yield self.step, edit, turn, role, new, text, fault
            self.step += 1

    def add(self, turn: int | None, role: str, text: str, fault: str) -> Iterator[tuple]:
        self.waiting.append((turn, role, text, fault))
        return self.rows(self.search.add(role[:1], fault))

    def end(self) -> Iterator[tuple]:
        return self.rows(self.search.end()[0])


EDITS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("step", pa.int64()),
        ("edit", pa.string()),
        ("turn", pa.int64()),
        ("role", pa.string()),
        ("new_role", pa.string()),
        ("text", pa.string()),
        ("fault", pa.string()),
    ]
)
EDITS_TYPE = "conv_id long, step long, edit string, turn long, role string, new_role string, text string, fault string"
OUT_ROWS, OUT_CHARS = 4096, 4 << 20


def edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place -> edits in order."""
    conversation: object = ()
    writer: Writer | None = None
    out: list[tuple] = []
    chars = 0

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), EDITS, strict=True)], schema=EDITS)

    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault"))
        for conv_id, turn, role, text, fault in zip(*columns, strict=True):
            if writer is None or conv_id != conversation:
                if writer is not None:
                    out += [(conversation, *row) for row in writer.end()]
                conversation, writer = conv_id, Writer()
            out += [(conv_id, *row) for row in writer.add(turn, role, text, fault)]
            chars += len(text)
            if len(out) >= OUT_ROWS or (chars >= OUT_CHARS and out):
                yield batch_of()
                out, chars = [], 0
    if writer is not None:
        out += [(conversation, *row) for row in writer.end()]
    if out:
        yield batch_of()


def visible(text: Column) -> Column:
    """The text without white space at its end (blank and the controls 9 to 13)."""
    return F.rtrim(text, F.lit(" " + CONTROLS))


def faulty(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault), the first fault of each row, sorted by conversation and place in each task."""
    place = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    shown = visible(F.col("text"))
    fault = (
        F.when(shown == "", BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), CUT)
        .otherwise(FINE)
    )
    # One shuffle: the window's groups lie inside those of the conversation.
    whole = turns.repartition("conv_id").select("conv_id", "turn", "role", "text", fault.alias("fault"))
    return whole.sortWithinPartitions(F.asc_nulls_first("conv_id"), *place)


def repair(turns: DataFrame) -> DataFrame:
    """Edits that repair each conversation of ``turns`` (conv_id, turn, role, text), in order within each task.

    (conv_id, step, edit, turn, role, new_role, text, fault): the rows whose ``new_role`` is not null, by ``step``, are
    the repaired conversation. Defined results: rows go by turn, null turns first, rows of one turn by role and text; null
    roles and texts count as one space; the rows of a null conv_id are one conversation; a role that begins with none of
    s, u, a (or is empty) is never kept; repeated rows are duplicates; texts of any length are whole; an empty table
    gives no rows; other columns are never read. A conversation with very many rows is one task's work, since its edits
    depend on all rows before, but only its unresolved rows are held.
    """
    filled = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled)
    return faulty(rows).mapInArrow(edit_rows, EDITS_TYPE)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with a fault planted by the remainder of a checksum of its key by 20."""
    told = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(told["conv_id"], F.lit(":"), told["turn"])) % 20
    rows = turns.select("conv_id", "turn", told["role"].alias("role"), told["text"].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, USER).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


class Digest:
    """Counts and the hash of one conversation, from its edits in order."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys((BLANK, DUPLICATE, CUT), 0)
        self.illegal = self.cost = self.turns = 0
        self.first = self.last = self.initial = None
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.written = False

    def add(self, edit: str, turn: int | None, role: str | None, new_role: str | None, text: str, fault: str | None) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            if fault:
                self.faults[fault] += 1
            if edit != "D" and fault == CUT:
                self.cost += TRUNCATED
            if turn is not None:
                self.first = turn if self.first is None else self.first
                self.turns += turn != self.last
                self.last = turn
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]
        if new_role is not None:
            self.hash.update((("\n" if self.written else "") + f"{new_role}:{text}").encode())
            self.written = True

    def row(self, conv_id: int | None) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


DIGESTS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
DIGEST_NAMES = [part.split()[0] for part in DIGESTS.split(", ")]


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order -> one row per conversation."""
    conversation: object = ()
    digest: Digest | None = None
    for batch in batches:
        out = []
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "edit", "turn", "role", "new_role", "text", "fault"))
        for conv_id, *edit in zip(*columns, strict=True):
            if digest is None or conv_id != conversation:
                if digest is not None:
                    out.append(digest.row(conversation))
                conversation, digest = conv_id, Digest()
            digest.add(*edit)
        if out:
            yield digest_batch(out)
    if digest is not None:
        yield digest_batch([digest.row(conversation)])


def digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=DIGEST_NAMES)


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``, damaged and repaired: faults, cost, edits and a hash of what came out.

    Conversations that the damage leaves without rows have zeros, no edits and the hash of the empty text.
    """
    found = repair(damage(turns)).mapInArrow(digest_rows, DIGESTS).withColumnRenamed("conv_id", "of")
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = {"audit": "", "repaired_sha256": EMPTY_SHA}
    filled = (F.coalesce(F.col(c), F.lit(none.get(c, 0)) if c in none else F.lit(0).cast("long")).alias(c) for c in DIGEST_NAMES[1:])
    return known.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *filled)
