"""Conversation structure repair: generalised LR parsing with edits.

A conversation's roles should derive from a small grammar.  Rows may be kept,
given another role or deleted, and empty turns may be inserted, each at a
price; the cheapest edits that make the roles derivable are found by a
generalised LR parse.  Its graph-structured stack holds every parse that the
edits so far allow on shared nodes, and for each top the cheapest (cost,
audit) that leads there.  Equal tops merge, the smaller (cost, audit) stays.
As the price of a letter depends on its row alone, audits of equal price over
the same rows are never prefixes of each other, so merging loses no least
one.

On Spark:

1. equal rows of a turn become one row with a count, before any shuffle;
   rows get their position in their conversation through range slices
   (a long conversation spans many);
2. repeated (role, text) of a conversation are found by an aggregate over
   digests; each row becomes a two-letter symbol (role class, fault);
3. symbols are gathered in blocks of ``BLOCK`` positions and a conversation's
   blocks stream in order through one task, which folds them.  It holds the
   live stack and two letters a row, never texts: the audit, one value of the
   result, has a letter a row itself;
4. each block's edits join back to its rows by (conversation, block).

Defined results.  Null ids are one conversation, null turns come first, null
roles and texts are one space.  Rows of equal turn follow by role and text.
Columns other than the four are ignored.  An empty table gives empty results;
a conversation without rows (all dropped by damage) has zeros and an empty
audit.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.base import materialise
from riskframe.operators.prefix import row_positions

#: Positions of a block: bounds what one group of symbols holds.
BLOCK = 4096
#: The grammar of role initials: an optional s, then pairs of u and a, or nothing.
ROLES = (("S", ""), ("S", "T"), ("S", "sT"), ("T", "ua"), ("T", "Tua"))
#: What a rerole or an insert may give.
GIVEN = {"u": "user", "a": "assistant"}
#: Two initials that may follow each other.
FOLLOWS = ("su", "ua", "au")


@dataclass(frozen=True)
class Prices:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3      # for a truncated row that stays


@dataclass(frozen=True)
class Table:
    """An LR(0) automaton; conflicts are left to the stack."""
    moves: list[dict[str, int]]
    reduces: list[list[tuple[str, int]]]
    accept: int


def lr_table(grammar=ROLES) -> Table:
    """States are sets of (production, dot); upper case is a nonterminal."""
    rules = [("^", grammar[0][0]), *grammar]

    def closed(items: frozenset) -> frozenset:
        out, todo = set(items), list(items)
        while todo:
            r, dot = todo.pop()
            for k, (left, _) in enumerate(rules):
                if dot < len(rules[r][1]) and rules[r][1][dot] == left and (k, 0) not in out:
                    out.add((k, 0))
                    todo.append((k, 0))
        return frozenset(out)
    states, moves = [closed(frozenset([(0, 0)]))], []
    for items in states:
        after: dict[str, set] = {}
        for r, dot in items:
            if dot < len(rules[r][1]):
                after.setdefault(rules[r][1][dot], set()).add((r, dot + 1))
        moves.append({})
        for x, to in sorted(after.items()):
            to = closed(frozenset(to))
            if to not in states:
                states.append(to)
            moves[-1][x] = states.index(to)
    reduces = [sorted((rules[r][0], dot) for r, dot in items if r and dot == len(rules[r][1])) for items in states]
    return Table(moves, reduces, moves[0][grammar[0][0]])


class Path:
    """A cost and an audit: the audit's beginning is shared, its end not."""
    __slots__ = ("cost", "head", "tail")

    def __init__(self, cost: int, head: tuple | None, tail: str):
        self.cost, self.head, self.tail = cost, head, tail

    def plus(self, cost: int, letter: str) -> Path:
        return Path(self.cost + cost, self.head, self.tail + letter)

    def audit(self) -> str:
        parts, at = [self.tail], self.head
        while at is not None:
            at, part = at
            parts.append(part)
        return "".join(reversed(parts))

    def beats(self, other: Path | None) -> bool:
        if other is None or self.cost != other.cost:
            return other is None or self.cost < other.cost
        return self.tail < other.tail if self.head is other.head else self.audit() < other.audit()


class Node:
    """An LR state on top of a stack; equal stacks are one node."""
    __slots__ = ("state", "below", "above")

    def __init__(self, state: int, below: Node | None):
        self.state, self.below, self.above = state, below, {}

    def over(self, state: int) -> Node:
        if state not in self.above:
            self.above[state] = Node(state, self)
        return self.above[state]


class Stack:
    """The graph-structured stack of one conversation: its live tops, each
    with the best path to it, on shared nodes."""

    def __init__(self, table: Table, prices: Prices = Prices(), given: str = "".join(GIVEN)):
        self.table, self.prices, self.given, self.since = table, prices, given, 0
        self.root = Node(0, None)
        self.tops: dict[Node, Path] = {}
        self._push(self.tops, self.root, Path(0, None, ""))
        self._insert()

    def _push(self, tops: dict[Node, Path], node: Node, path: Path) -> bool:
        """Merge a top, and all that reductions make of it; False if an equal
        one is as good."""
        if not path.beats(tops.get(node)):
            return False
        tops[node] = path
        for left, n in self.table.reduces[node.state]:
            at = node
            for _ in range(n):
                at = at.below
            to = self.table.moves[at.state].get(left)
            if to is not None:
                self._push(tops, at.over(to), path)
        return True

    def _shift(self, role: str, cost: int, letter: str, into: dict[Node, Path]) -> bool:
        """Shift a role from every top; True if a better top came of it."""
        better = False
        for node, path in list(self.tops.items()):
            to = self.table.moves[node.state].get(role)
            if to is not None:
                better |= self._push(into, node.over(to), path.plus(cost, letter))
        return better

    def _insert(self) -> None:
        """All tops that inserts reach."""
        while any([self._shift(r, self.prices.insert, "I", self.tops) for r in self.given]):
            pass

    def read(self, role: str, fault: str, copies: int = 1) -> None:
        """One row (``fault``: b, d, t or -), then its copies, all deleted."""
        late = self.prices.truncated if fault == "t" else 0
        into: dict[Node, Path] = {}
        for node, path in self.tops.items():
            self._push(into, node, path.plus(self.prices.delete, "D"))
        if fault not in "bd":
            self._shift(role, late, "K", into)
            for r in self.given:
                self._shift(r, self.prices.rerole + late, "R", into)
        if copies > 1:      # deletes come before inserts in the least audit
            gone = self.prices.delete * (copies - 1)
            into = {node: path.plus(gone, "D" * (copies - 1)) for node, path in into.items()}
        self.tops = into
        self._insert()
        self.since += copies
        if self.since >= 64:
            self._share()

    def _share(self) -> None:
        """Move the beginnings that audits have in common out of them."""
        groups: dict = {}
        for path in self.tops.values():
            groups.setdefault((id(path.head), path.tail[:1]), {})[id(path)] = path
        for paths in (list(g.values()) for g in groups.values()):
            common = os.path.commonprefix([p.tail for p in paths])
            if common:
                head = paths[0].head, common
                for p in paths:
                    p.head, p.tail = head, p.tail[len(common):]
        self.since = 0

    def best(self) -> tuple[int, str]:
        path = self.tops[self.root.over(self.table.accept)]
        return path.cost, path.audit()


def edits(symbols: list[tuple[str, int]], audit: str) -> tuple[list[str], list[str]]:
    """Per row its own action and the roles inserted before it, as one string
    (``uaK``: two inserts, then keep; ``R`` is followed by its role), and the
    roles inserted at the end.  The grammar leaves one choice for each."""
    out, before, last, at = [], "", "", 0
    for letter in audit:
        role = "a" if last == "u" else "u"
        if letter == "I":
            before, last = before + role, role
            continue
        if at < len(symbols) and (not out or left == 0):
            left = symbols[at][1]
            at += 1
            out.append(before + letter + (role if letter == "R" else ""))
            before = ""
            last = {"K": symbols[at - 1][0][0], "R": role}.get(letter, last)
        left -= 1           # a copy: deleted with its row's others
    return out, list(before)


# ---- rows -------------------------------------------------------------------

def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with every row's fault, by CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops it, 1 empties its text, 2 takes its
    ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
                      text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_copies"), kind.alias("_kind"))
    return (out.where("_kind != 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
            .select("conv_id", "turn", "role", "text"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = None
    for k in keys:
        one = a[k].eqNullSafe(b[k])
        cond = one if cond is None else cond & one
    return cond


def place(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n, pos)``: distinct rows, their number
    and their position in the conversation; written once."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    one = rows.select("conv_id", "turn", said("role"), said("text")).groupBy("conv_id", "turn", "role", "text")
    return row_positions(one.agg(F.count(F.lit(1)).alias("n")), ["turn", "role", "text"], ["conv_id"], "pos")


def symbols(placed: DataFrame) -> DataFrame:
    """``(conv_id, pos, sym, n)``; ``sym``: s, u, a or o, then the first fault
    of b(lank), d(uplicate), t(runcated) or -."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    first = F.substring("role", 1, 1)
    narrow = placed.select("conv_id", "pos", "n", F.sha2(F.concat(F.sha2("role", 256), "text"), 256).alias("said"),
                           F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("r"),
                           F.when(blank, "b").when(cut, "t").otherwise("-").alias("f"))
    again = (narrow.where("f != 'b'").groupBy("conv_id", "said").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("k"))
             .where("k > 1").drop("k"))
    again = materialise(again, "repeated-turns")
    is_again = F.col("first").isNotNull() & (F.col("pos") > F.col("first"))
    out = narrow.join(again, _same(narrow, again, ["conv_id", "said"]), "left")
    return out.select(narrow["conv_id"], "pos", F.concat("r", F.when(is_again, "d").otherwise(F.col("f"))).alias("sym"), "n")


_FOLDED = ("conv_id {kind}, block long, acts array<string>, tail array<string>, "
           "report struct<blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>")


def _report(symbols: list[tuple[str, int]], cost: int, audit: str) -> dict:
    n = {f: sum(m for s, m in symbols if s[1] == f) for f in "bd"}
    copies = sum(m - 1 for s, m in symbols if s[1] not in "bd")
    pairs = sum(a[0][0] + b[0][0] not in FOLLOWS for a, b in zip(symbols, symbols[1:]))
    return {"blank": n["b"], "duplicate": n["d"] + copies, "truncated": sum(s[1] == "t" for s, _ in symbols),
            "illegal": pairs + sum(m - 1 for _, m in symbols), "cost": cost, "audit": audit}


def fold(batches: Iterator[pa.RecordBatch], table: Table, prices: Prices, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by conversation and block, in; their edits out.  The
    report is on a conversation's first block."""
    def done(conv, parts: list[tuple[int, int]], syms, stack):
        cost, audit = stack.best()
        acts, tail = edits(syms, audit)
        rows, at = [], 0
        for k, (block, n) in enumerate(parts):
            last = k == len(parts) - 1
            rows.append({"conv_id": conv, "block": block, "acts": acts[at:at + n], "tail": tail if last else [],
                         "report": None if k else _report(syms, cost, audit)})
            at += n
        return pa.RecordBatch.from_pylist(rows, schema)
    conv, stack, syms, parts = None, None, [], []
    for b in batches:
        for c, block, cells in zip(*(col.to_pylist() for col in b.columns)):
            if stack is not None and c != conv:
                yield done(conv, parts, syms, stack)
                stack = None
            if stack is None:
                conv, stack, syms, parts = c, Stack(table, prices), [], []
            for cell in cells:
                stack.read(cell["sym"][0], cell["sym"][1], cell["n"])
                syms.append((cell["sym"], cell["n"]))
            parts.append((block, len(cells)))
    if stack is not None:
        yield done(conv, parts, syms, stack)


def repair(rows: DataFrame, prices: Prices = Prices(), grammar=ROLES) -> tuple[DataFrame, DataFrame]:
    """``(repaired, report)``.

    ``repaired``: ``(conv_id, pos, sub, turn, role, text, action)``, the rows
    that stay and the inserted ones (no turn, empty text) in the order of
    ``(pos, sub)``; action keep, rerole or insert.  ``report``, a row a
    conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit``.  ``grammar`` may give other rules over s, u and a, as long as it
    leaves one choice for what an insert or a rerole gives."""
    placed = place(rows)
    block = F.floor(F.col("pos") / BLOCK)
    cells = (symbols(placed).groupBy("conv_id", block.alias("block"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "sym", "n"))).alias("cells")))
    kind = placed.schema["conv_id"].dataType.simpleString()
    table = lr_table(grammar)
    # a number of tasks of its own: the blocks are few bytes, and Spark would fold them all in one
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cells.select("conv_id", "block", "cells").repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "block")
    shape = _FOLDED.format(kind=kind)
    spark_schema = placed.sparkSession.createDataFrame([], shape).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(spark_schema)
    folded = materialise(out.mapInArrow(lambda b: fold(b, table, prices, arrow), spark_schema), "turn-edits")

    turns = placed.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("k"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("k"), F.lit(0)).cast("long")
    reports = folded.where("report IS NOT NULL").select("conv_id", "report.*")
    report = (reports.join(turns, _same(reports, turns, ["conv_id"]))
              .select(reports["conv_id"], gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"))

    at = placed.withColumn("block", block)
    same = _same(at, folded, ["conv_id", "block"])
    given = F.create_map(*[F.lit(x) for kv in GIVEN.items() for x in kv])
    joined = at.join(folded.select("conv_id", "block", "acts"), same).select(
        at["conv_id"], "pos", "turn", "role", "text", F.get("acts", (F.col("pos") % BLOCK).cast("int")).alias("act"))
    # an act is the inserted roles, the letter, and for R its role
    lead = F.regexp_extract("act", "^([a-z]*)", 1)
    letter = F.regexp_extract("act", "([A-Z])", 1)
    new = F.regexp_extract("act", "([a-z])$", 1)
    none = F.lit(None).cast(placed.schema["turn"].dataType)
    item = lambda turn, role, text, action: F.struct(turn.alias("turn"), role.alias("role"), text.alias("text"), F.lit(action).alias("action"))
    inserted = lambda roles: F.transform(roles, lambda r: item(none, given[r], F.lit(""), "insert"))
    own = F.when(letter == "K", F.array(item(F.col("turn"), F.col("role"), F.col("text"), "keep"))) \
        .when(letter == "R", F.array(item(F.col("turn"), given[new], F.col("text"), "rerole"))).otherwise(F.array())
    leading = F.when(F.length(lead) > 0, inserted(F.split(lead, ""))).otherwise(F.array())
    kept = joined.select("conv_id", "pos", F.posexplode(F.concat(leading, own)).alias("sub", "x"))
    tails = folded.where(F.size("tail") > 0).select(
        "conv_id", F.lit(2 ** 62).cast("long").alias("pos"), F.posexplode(inserted(F.col("tail"))).alias("sub", "x"))
    return kept.unionByName(tails).select("conv_id", "pos", "sub", "x.*"), report


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the ``role:text`` of each
    conversation, newline-joined.  SHA-256 reads a conversation in order, so
    its rows stream through one task; none of them is held."""
    kind = repaired.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h = None, None
        names = ["conv_id", "repaired_sha256"]
        for b in batches:
            ids, out = b.column(0), []
            for c, line in zip(ids.to_pylist(), b.column(1).to_pylist()):
                if h is not None and c != conv:
                    out.append((conv, h.hexdigest()))
                    h = None
                if h is None:
                    conv, h = c, hashlib.sha256(line)
                else:
                    h.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], ids.type), pa.array([x[1] for x in out], pa.string())], names=names)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], ids.type), pa.array([h.hexdigest()], pa.string())], names=names)
    lines = repaired.select("conv_id", F.concat_ws(":", "role", "text").cast("binary").alias("line"), "pos", "sub")
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select("conv_id", "line")
    return lines.mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def repair_report(rows: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """The report and the digest for every conversation of ``rows``, of which
    ``damaged`` (by default ``rows``) is repaired."""
    repaired, report = repair(rows if damaged is None else damaged)
    report, sums = materialise(report, "repair-report"), materialise(digests(repaired), "repair-digests")
    ids = rows.select("conv_id").distinct()
    out = ids.join(report, _same(ids, report, ["conv_id"]), "left").join(sums, _same(ids, sums, ["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(ids["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
