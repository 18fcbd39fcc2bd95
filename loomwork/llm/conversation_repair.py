"""Repair of conversations' structure by Viterbi decoding whose survivors coalesce.

A repaired conversation is empty or reads ``system? (user assistant)+``.  Rows may be kept (0), given the role user or assistant
(1), deleted (2; blank rows and repeats must be) and rows without text inserted (5); a row whose text breaks off costs 5 unless it is
deleted.  Of the cheapest edits those are taken whose initials (D, I, K, R) come first in ASCII order.

Spark finds the faults, deals the conversations out by id and sorts each by turn; a task then reads its rows as a stream.  The decoder
keeps, for each of four states (nothing yet, after system, user, assistant), the best path so far as a leaf of a tree of backpointers.
Nodes count what refers to them; a node that nothing refers to goes.  As soon as all survivors descend from one node, what leads to
it is decided and emitted, so a task holds only the undecided ends of one conversation's paths, never a conversation.  Equal costs are
told apart by the complete undecided ends of the two paths.  Runs of deletions take one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.plans.shipping import ship

BLANKS = r"\x20\x09-\x0D"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Initials of neighbouring rows that may follow one another.
LEGAL = ("su", "ua", "au")
#: Rows of a batch that a task hands on.
BATCH = 4096


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Node:
    """An edit of a path, or a run of deletions; ``refs`` counts its children and the survivors that end in it."""

    __slots__ = ("parent", "edit", "times", "said", "depth", "refs", "children")

    def __init__(self, parent: Node | None, edit: str, said: tuple[str, str] | None):
        self.parent, self.edit, self.said, self.times, self.refs = parent, edit, said, 1, 0
        self.depth = parent.depth + 1 if parent else 0
        self.children: set[Node] = set()


@dataclass
class Path:
    """A way into a state: a survivor's leaf and the edits that follow it."""

    cost: int
    leaf: Node
    after: tuple[tuple[str, tuple[str, str] | None], ...] = ()

    def then(self, cost: int, edit: str, said: tuple[str, str] | None = None) -> Path:
        return Path(self.cost + cost, self.leaf, (*self.after, (edit, said)))


def _runs(leaf: Node, above: Node) -> list[list]:
    out = []
    while leaf is not above:
        out.append([leaf.edit, leaf.times])
        leaf = leaf.parent
    return out[::-1]


def _sooner(x: Path, y: Path) -> bool:
    """Whether the initials of ``x`` come before those of ``y``: both paths' ends after their last common node are compared."""
    a, b = x.leaf, y.leaf
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    ends = []
    for path in (x, y):
        runs = _runs(path.leaf, a)
        for edit, _ in path.after:
            if runs and runs[-1][0] == edit:
                runs[-1][1] += 1
            else:
                runs.append([edit, 1])
        ends.append(runs)
    left, right = ends
    i = j = used_i = used_j = 0
    while i < len(left) and j < len(right):
        if left[i][0] != right[j][0]:
            return left[i][0] < right[j][0]
        step = min(left[i][1] - used_i, right[j][1] - used_j)
        used_i, used_j = used_i + step, used_j + step
        if used_i == left[i][1]:
            i, used_i = i + 1, 0
        if used_j == right[j][1]:
            j, used_j = j + 1, 0
    return i == len(left) and j < len(right)


def _better(x: Path | None, y: Path | None) -> Path | None:
    if x is None or y is None:
        return x or y
    if x.cost != y.cost:
        return x if x.cost < y.cost else y
    return x if _sooner(x, y) else y


class Repairer:
    """The decoder of one conversation: feed its rows in order, then finish; both hand on the edits that are decided."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.best: list[Path | None] = [Path(0, self.root), None, None, None]
        #: Nodes of the tree, the root included, and how many there were at most.
        self.nodes = self.most_nodes = 1

    def _with_inserts(self) -> list[Path | None]:
        nothing, system, user, assistant = self.best
        price = self.costs.insert
        for before in (nothing, system, self.best[ASSISTANT]):
            if before:
                user = _better(user, before.then(price, "I", (NAMES[USER], "")))
        if user:
            assistant = _better(assistant, user.then(price, "I", (NAMES[ASSISTANT], "")))
        return [nothing, system, user, assistant]

    def feed(self, role: str, text: str, must_go: bool, truncated: bool) -> list[tuple[str, tuple[str, str] | None]]:
        """One row; returns the edits that it decides, each with the (role, text) that it leaves."""
        ways = self._with_inserts()
        kind = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1])
        extra = self.costs.truncated if truncated else 0
        after: list[Path | None] = [None] * 4
        for state, way in enumerate(ways):
            if way is None:
                continue
            if not way.after:  # an insertion before a deletion comes after it as cheaply, and sooner in the order
                after[state] = _better(after[state], way.then(self.costs.delete, "D"))
            if must_go:
                continue
            to = ASSISTANT if state == USER else USER
            after[to] = _better(after[to], way.then(self.costs.rerole + extra, "R", (NAMES[to], text)))
            if kind == to or (kind == SYSTEM and state == NOTHING):
                after[kind] = _better(after[kind], way.then(extra, "K", (role, text)))
        self._settle(self._pruned(after))
        return self._decided()

    def _pruned(self, after: list[Path | None]) -> list[Path | None]:
        """Without paths that can't win any more.

        What goes on from after a system row goes on from after an assistant row for the same cost; what goes on from nothing does so
        for two more at most, the deletion of the one system row that only nothing may be followed by.
        """
        nothing, system, user, assistant = after
        if system and assistant and _better(system, assistant) is assistant:
            after[SYSTEM] = None
        complete = min([p.cost for p in (assistant, user and user.then(self.costs.insert, "I")) if p], default=None)
        if nothing and complete is not None and complete + self.costs.delete < nothing.cost:
            after[NOTHING] = None
        return after

    def _settle(self, after: list[Path | None]) -> None:
        """Make the chosen ways the survivors: their edits become nodes, and what no survivor needs goes."""
        users = [p.leaf for p in after if p]
        old = [p.leaf for p in self.best if p]
        heads: list[Path | None] = []
        for path in after:
            if path is None:
                heads.append(None)
                continue
            leaf = path.leaf
            alone = leaf is not self.root and sum(x is leaf for x in users) == 1 and leaf.refs == sum(x is leaf for x in old)
            if alone and leaf.edit == "D" and [e for e, _ in path.after] == ["D"]:
                leaf.times += 1
            else:
                for edit, said in path.after:
                    child = Node(leaf, edit, said)
                    leaf.children.add(child)
                    leaf.refs += 1
                    self.nodes += 1
                    leaf = child
            leaf.refs += 1
            heads.append(Path(path.cost, leaf))
        self.most_nodes = max(self.most_nodes, self.nodes)
        for leaf in old:
            leaf.refs -= 1
            while leaf.refs == 0 and leaf is not self.root:
                parent = leaf.parent
                parent.children.discard(leaf)
                parent.refs -= 1
                self.nodes -= 1
                leaf = parent
        self.best = heads

    def _decided(self) -> list[tuple[str, tuple[str, str] | None]]:
        out = []
        while self.root.refs == 1 and len(self.root.children) == 1:
            (child,) = self.root.children
            if child.refs == 1 and not child.children and child.edit == "D":
                break  # a run of deletions may still grow
            self.root.children.clear()
            child.parent, self.root = None, child
            self.nodes -= 1
            out += [(child.edit, child.said)] * child.times
        return out

    def finish(self) -> tuple[int, list[tuple[str, tuple[str, str] | None]]]:
        """(cost of all edits, the edits not handed on yet)."""
        ways = self._with_inserts()
        end = _better(ways[NOTHING], ways[ASSISTANT])
        out, leaf = [], end.leaf
        while leaf is not self.root:
            out += [(leaf.edit, leaf.said)] * leaf.times
            leaf = leaf.parent
        return end.cost, out[::-1] + list(end.after)


# Faults ------------------------------------------------------------------------------------------


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{BLANKS}]")


def breaks_off(text: Column) -> Column:
    """Whether the last character that is no white space is not a sentence's end; blank texts have none."""
    return ~text.rlike(rf"[.!?][{BLANKS}]*\z")


def marked(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, seen, blank, broken)``; nulls of role and text are one space.

    ``seen`` tells that the same role and text stand at an earlier turn of the conversation; of equal rows at one turn the
    reader of the sorted rows counts all but the first as seen too.  Turns that are null come first.
    """
    rows = convs.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _spaced(role_col).alias("role"), _spaced(text_col).alias("text"))
    rows = rows.withColumns({"digest": F.unhex(F.md5(F.col("text").cast("binary"))), "at": F.struct(F.col("turn").isNotNull().alias("given"), "turn")})
    # The earliest turn of each role and text: combined before the shuffle, however often a text is repeated.
    first = rows.groupBy(F.col("conv_id").alias("of"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("at").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = rows.join(first, same, "left")
    return seen.select("conv_id", "turn", "role", "text", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("seen"), is_blank(F.col("text")).alias("blank"), breaks_off(F.col("text")).alias("broken"))


@dataclass
class Tally:
    """What is counted of one conversation while its rows pass."""

    conv_id: object
    repairer: Repairer
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    least: int | None = None
    most: int | None = None
    before: tuple | None = None
    digest: object = field(default_factory=hashlib.sha256)
    audit: list[str] = field(default_factory=list)
    rows: int = 0

    def take(self, turn: int | None, role: str, text: str, seen: bool, blank: bool, broken: bool) -> list:
        row = (turn, role, text)
        seen = seen or row == self.before
        if turn is not None and (self.before is None or turn != self.before[0]):
            self.turns, self.least, self.most = self.turns + 1, turn if self.least is None else self.least, turn
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = row
        self.blank += blank
        self.duplicate += seen and not blank
        truncated = broken and not seen and not blank
        self.truncated += truncated
        return self.repairer.feed(role, text, blank or seen, truncated)

    def left(self, edits: list) -> list[tuple[int, str, str, str]]:
        """The rows (place, edit, role, text) that ``edits`` leave; their initials and texts are taken down."""
        out = []
        for edit, said in edits:
            self.audit.append(edit)
            if said:
                self.digest.update(("\n" * (self.rows > 0) + f"{said[0]}:{said[1]}").encode())
                out.append((self.rows, edit, *said))
                self.rows += 1
        return out

    def summary(self, cost: int) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


_SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_ROWS = ("conv_id", "place", "edit", "role", "text")


def _decoded(convs: DataFrame, costs: Costs, whole_rows: bool, names: tuple[str, ...]) -> DataFrame:
    rows = marked(convs, *names)
    kind = rows.schema["conv_id"].dataType.simpleString()
    columns = _ROWS if whole_rows else _SUMMARY
    schema = f"conv_id {kind}, place long, edit string, role string, text string" if whole_rows else f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Tally | None = None
        out: list[tuple] = []
        made = pa.schema([])

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                fields = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(fields, made, strict=True)], names=list(columns))
                out.clear()

        def ended(t: Tally) -> None:
            cost, edits = t.repairer.finish()
            left = t.left(edits)
            out.extend([(t.conv_id, *r) for r in left] if whole_rows else [t.summary(cost)])

        for batch in batches:
            made = [batch.schema.field(0).type, *([pa.int64(), pa.string(), pa.string(), pa.string()] if whole_rows else [*[pa.int64()] * 6, pa.string(), pa.string()])]
            for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        ended(now)
                    now = Tally(conv_id, Repairer(costs))
                left = now.left(now.take(*row))
                if whole_rows:
                    out.extend((conv_id, *r) for r in left)
                if len(out) >= BATCH:
                    yield from flush()
        if now is not None:
            ended(now)
        yield from flush()

    ship(convs.sparkSession)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv_id", "turn", "role", "text", "seen", "blank", "broken").mapInArrow(run, schema)


def audited(convs: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for each conversation.

    ``gaps`` counts the turns missing between the smallest and the largest; ``blank``, ``duplicate`` and ``truncated`` count rows by their
    first fault; ``illegal`` counts neighbours whose roles may not follow one another; ``audit`` has the initials of the cheapest edits;
    the digest is of the repaired ``role:text`` lines.  Rows of one turn are taken by role and text.  Null roles and texts are one
    space; null ids are one conversation; null turns come first and don't count for ``gaps``.  An empty table gives an empty result;
    other columns are ignored.  A conversation is read by one task, as its digest has to be, row by row in bounded memory.
    """
    return _decoded(convs, costs, False, (conv_col, turn_col, role_col, text_col))


def repaired(convs: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the rows of each repaired conversation, in order of ``place``; see ``audited``."""
    return _decoded(convs, costs, True, (conv_col, turn_col, role_col, text_col))
