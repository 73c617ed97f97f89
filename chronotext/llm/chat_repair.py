"""Repair of conversation structure by a generalised LR parser.

The role grammar has a conversation as nothing, or an optional system turn before pairs of a user
and an assistant turn. Its LR tables are built here from the productions (item sets, reductions
on one following symbol). A conversation's rows are read in order; the stacks of all repairs
still possible form a graph-structured stack: each entry of the frontier is a top state with its
stack of states below. An entry may be extended by

* keeping a row (nothing), giving it the other role (`rerole`), or deleting it (`delete`),
* inserting an empty turn of a role (`insert`) anywhere,

and entries of equal top state are merged: the one of the smallest (cost, audit) stays. Equal
tops accept the same continuations in this grammar, so no repair is lost. Entries too dear to
catch up with the cheapest one go as well. Audits (the initials
K, R, D, I of the edits in order) are compared by the rank of the entry they extend and the
letters added; entries are compared only just behind a row, where no audit begins another one.
What a frontier does on a row depends only on its tops, their costs less the smallest, and the
row's role initial and fault, so it is worked out once for each such combination.

A row's first fault counts: blank (no character but `[\\x20\\x09-\\x0D]`), duplicate (role and text
of an earlier row of its conversation), truncated (its last such character is not one of
`[.!?]`). Blank and duplicate rows must be deleted; a truncated row that is not adds
`truncated` to the cost.

Rows are taken by turn (nulls first), then role and text. Null roles and texts are one space. A role
is known by its first character; an empty role has none and fits no place. Repeated rows are
duplicates. A null id is a conversation of its own. Other columns are dropped, whatever
their names. An empty table gives no rows.

Conversations are shuffled once and sorted within their partitions (Spark spills what does
not fit); a task streams its rows. It holds the frontier and the rows on whose edit the frontier
does not yet agree, mostly below a hundred. Only a conversation with rows of one role throughout
stays open to its end, and then its rows are held. One with a very large share of all rows costs
time in one task; a digest over its text is a sequence in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAMMAR = (("C", ()), ("C", ("B",)), ("C", ("s", "B")), ("B", ("P",)), ("B", ("B", "P")), ("P", ("u", "a")))
START, END = "C", "$"
ROLES = {"u": "user", "a": "assistant"}
SPACE = r"[\x20\x09-\x0D]"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


class Costs:
    """What each edit costs; `truncated` is for a truncated row that is not deleted."""

    def __init__(self, rerole: int = 1, delete: int = 2, insert: int = 5, truncated: int = 5):
        self.rerole, self.delete, self.insert, self.truncated = rerole, delete, insert, truncated

    def key(self) -> tuple:
        return self.rerole, self.delete, self.insert, self.truncated


class Parser:
    """SLR tables of a small grammar, and what one symbol does to a stack of states."""

    def __init__(self, grammar=GRAMMAR, start: str = START):
        self.grammar, self.start = grammar, start
        self.names = {left for left, _ in grammar}
        self.follow = self._follow()
        self.states: list[frozenset] = [self._closure({(i, 0) for i, (left, _) in enumerate(grammar) if left == start})]
        self.moves: dict[tuple[int, str], int] = {}
        for state in self.states:  # grows
            at = self.states.index(state)
            for symbol in sorted({grammar[i][1][dot] for i, dot in state if dot < len(grammar[i][1])}):
                after = self._closure({(i, dot + 1) for i, dot in state if grammar[i][1][dot: dot + 1] == (symbol,)})
                if after not in self.states:
                    self.states.append(after)
                self.moves[at, symbol] = self.states.index(after)

    def _closure(self, items: set) -> frozenset:
        found = set(items)
        while True:
            more = {(j, 0) for i, dot in found if dot < len(self.grammar[i][1])
                    for j, (left, _) in enumerate(self.grammar) if left == self.grammar[i][1][dot]} - found
            if not more:
                return frozenset(found)
            found |= more

    def _follow(self) -> dict[str, set]:
        empty = {left for left, right in self.grammar if not right}
        first: dict[str, set] = {left: set() for left in self.names}
        follow: dict[str, set] = {left: set() for left in self.names}
        follow[self.start].add(END)
        changed = True
        while changed:
            before = sum(map(len, (*first.values(), *follow.values())))
            for left, right in self.grammar:
                for symbol in right:
                    first[left] |= first.get(symbol, {symbol})
                    if symbol not in empty:
                        break
                for i, symbol in enumerate(right):
                    if symbol in self.names:
                        rest = right[i + 1:]
                        follow[symbol] |= first.get(rest[0], {rest[0]}) if rest else follow[left]
            changed = sum(map(len, (*first.values(), *follow.values()))) != before
        return follow

    @lru_cache(maxsize=None)
    def shift(self, stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
        """The stack behind the symbol after the reductions it calls for, or None."""
        stack = self._reduced(stack, symbol)
        to = self.moves.get((stack[-1], symbol))
        return None if to is None else (*stack, to)

    def accepts(self, stack: tuple[int, ...]) -> bool:
        stack = self._reduced(stack, END, whole=True)
        return stack == ()

    def _reduced(self, stack: tuple[int, ...], symbol: str, whole: bool = False) -> tuple[int, ...]:
        while stack:
            done = [i for i, dot in self.states[stack[-1]] if dot == len(self.grammar[i][1]) and symbol in self.follow[self.grammar[i][0]]]
            if not done:
                return stack
            left, right = self.grammar[done[0]]
            stack = stack[: len(stack) - len(right)]
            if left == self.start:
                return () if whole else stack
            stack = (*stack, self.moves[stack[-1], left])
        return stack


PARSER = Parser()


@lru_cache(maxsize=100_000)
def _inserted(tops: tuple, costs: tuple) -> tuple:
    """A frontier (stack, cost) in the order of its audits, with all insertions made: (entry it
    extends, letters, roles inserted, stack, cost)."""
    best = {stack[-1]: (cost, i, "", (), stack) for i, (stack, cost) in enumerate(tops)}
    work = list(best.values())
    while work:
        cost, i, letters, roles, stack = work.pop()
        if best[stack[-1]][:3] != (cost, i, letters):
            continue
        for symbol in ROLES:
            after = PARSER.shift(stack, symbol)
            if after is not None:
                new = (cost + costs[2], i, letters + "I", (*roles, symbol), after)
                if after[-1] not in best or new[:3] < best[after[-1]][:3]:
                    best[after[-1]] = new
                    work.append(new)
    return tuple((i, letters, roles, stack, cost) for cost, i, letters, roles, stack in best.values())


@lru_cache(maxsize=100_000)
def _step(tops: tuple, initial: str, fault: str | None, costs: tuple) -> tuple[int, tuple]:
    """The frontier behind one row: (smallest cost, entries (entry extended, roles inserted, edit,
    role given, stack, cost less the smallest)), in the order of the audits."""
    rerole, delete, insert, truncated = costs
    best: dict[int, tuple] = {}

    def offer(cost, i, letters, roles, edit, given, stack):
        new = (cost, i, letters + edit, roles, edit, given, stack)
        if stack[-1] not in best or new[:3] < best[stack[-1]][:3]:
            best[stack[-1]] = new

    for i, letters, roles, stack, cost in _inserted(tops, costs):
        offer(cost + delete, i, letters, roles, "D", "", stack)
        if fault in (BLANK, DUPLICATE):
            continue
        extra = truncated if fault == TRUNCATED else 0
        after = PARSER.shift(stack, initial) if initial else None
        if after is not None:
            offer(cost + extra, i, letters, roles, "K", initial, after)
        for symbol in ROLES:
            after = PARSER.shift(stack, symbol) if symbol != initial else None
            if after is not None:
                offer(cost + extra + rerole, i, letters, roles, "R", symbol, after)
    least = min(e[0] for e in best.values())
    # Whatever an entry leads to, the cheapest one reaches too with at most two insertions and one
    # deletion more, so a dearer entry can win no longer. Costs thus stay few, and entries agree soon.
    bound = least + 2 * insert + delete
    ranked = sorted((e for e in best.values() if e[0] <= bound), key=lambda e: e[1:3])
    return least, tuple((i, roles, edit, given, stack, cost - least) for cost, i, _, roles, edit, given, stack in ranked)


@lru_cache(maxsize=100_000)
def _end(tops: tuple, costs: tuple) -> tuple:
    """The cheapest entry that the grammar accepts: (entry it extends, roles inserted, cost)."""
    done = [(cost, i, letters, roles) for i, letters, roles, stack, cost in _inserted(tops, costs) if PARSER.accepts(stack)]
    cost, i, _, roles = min(done)
    return i, roles, cost


class Repair:
    """One conversation: rows in, edits out as soon as all stacks agree on them."""

    WAIT = 64

    def __init__(self, costs: tuple):
        self.costs, self.tops, self.base = costs, (((0,), 0),), 0
        self.chains: list = [None]  # per entry: (chain before, roles inserted, edit, role given)
        self.rows: list = []
        self.wait = self.WAIT

    def row(self, initial: str, fault: str | None, row) -> Iterator[tuple]:
        least, entries = _step(self.tops, initial, fault, self.costs)
        self.base += least
        self.tops = tuple((stack, cost) for *_, stack, cost in entries)
        self.chains = [(self.chains[i], roles, edit, given) for i, roles, edit, given, _, _ in entries]
        self.rows.append(row)
        if len(self.rows) >= self.wait:
            yield from self._settle()

    def _unrolled(self, chain) -> list[tuple]:
        out = []
        while chain is not None:
            out.append(chain)
            chain = chain[0]
        return out[::-1]

    def _settle(self) -> Iterator[tuple]:
        """Emit the edits all entries share, and keep only the links behind them."""
        lists = [self._unrolled(c) for c in self.chains]
        same = 0
        while same < len(self.rows) and all(x[same] is lists[0][same] for x in lists):
            same += 1
        yield from self._emit(lists[0][:same])
        made: dict[tuple, tuple] = {}  # links that entries share stay shared
        self.chains = []
        for links in lists:
            chain = None
            for link in links[same:]:
                chain = made.setdefault((id(chain), id(link)), (chain, *link[1:]))
            self.chains.append(chain)
        self.wait = self.WAIT + len(self.rows) if same else 2 * self.wait

    def _emit(self, links: list[tuple]) -> Iterator[tuple]:
        for (_, roles, edit, given), row in zip(links, self.rows):
            for symbol in roles:
                yield "I", symbol, None
            yield edit, given, row
        del self.rows[: len(links)]

    def close(self) -> Iterator[tuple]:
        i, roles, cost = _end(self.tops, self.costs)
        yield from self._emit(self._unrolled(self.chains[i]))
        for symbol in roles:
            yield "I", symbol, None
        self.cost = self.base + cost


def faults(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text and fault, each conversation in one partition, in order."""
    plain = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    ).repartition("conv")
    earlier = Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    body = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = (
        F.when(body == "", BLANK).when(F.col("nth") > 1, DUPLICATE)
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED)
    )
    return plain.withColumn("nth", F.row_number().over(earlier)).withColumn("fault", fault).drop("nth").sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "text")


EDITS = pa.schema([("step", pa.int64()), ("turn", pa.int64()), ("was", pa.string()), ("fault", pa.string()),
                   ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64())])


def repair(rows: DataFrame, costs: Costs | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", batch_rows: int = 1000, batch_chars: int = 1 << 20) -> DataFrame:
    """The edits of every conversation in order: conv, step (from 0), turn, was (the row's role; null
    for insertions), fault, edit (K, R, D or I), role (null for deletions), text (null for
    deletions) and cost. The repaired conversation is the rows with a role."""
    kind = rows.schema[conv].dataType.simpleString()
    key = (costs or Costs()).key()

    def batches_of(batches):
        held: dict[str, list] = {name: [] for name in ("conv", *EDITS.names)}
        size, started, now, state, step = 0, False, None, None, 0

        def put(edits):
            nonlocal size, step
            for edit, given, row in edits:
                at, was, own, fault = row or (None, None, "", None)
                cost = {"K": 0, "R": key[0], "D": key[1], "I": key[2]}[edit]
                if fault == TRUNCATED and edit != "D":
                    cost += key[3]
                name = None if edit == "D" else was if edit == "K" else ROLES[given]
                line = (now, step, at, was, fault, edit, name, None if edit == "D" else own, cost)
                for column, value in zip(held.values(), line):
                    column.append(value)
                size += len(own)
                step += 1

        def flush():
            nonlocal size
            arrays = [pa.array(held["conv"], type=conv_type), *(pa.array(held[f.name], type=f.type) for f in EDITS)]
            for column in held.values():
                column.clear()
            size = 0
            return pa.RecordBatch.from_arrays(arrays, names=list(held))

        conv_type = None
        for batch in batches:
            conv_type = batch.column("conv").type
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for own, at, was, said, fault in zip(*(part.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault"))):
                    if not started or own != now:
                        if started:
                            put(state.close())
                        started, now, state, step = True, own, Repair(key), 0
                    put(state.row(was[:1], fault, (at, was, said, fault)))
                    if len(held["step"]) >= batch_rows or size >= batch_chars:
                        yield flush()
        if started:
            put(state.close())
            yield flush()

    fields = "step bigint, turn bigint, was string, fault string, edit string, role string, text string, cost bigint"
    return faults(rows, conv, turn, role, text).withColumn("turn", F.col("turn").cast("long")).mapInArrow(
        batches_of, f"conv {kind}, {fields}")


def report(edits: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each
    conversation, from the edits as `repair` returns them (in order, not shuffled since)."""
    import hashlib

    kind = edits.schema["conv"].dataType.simpleString()
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    longs = ["gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]

    def summed(batches):
        rows, started, now, conv_type, state = [], False, None, None, None

        def close():
            first, last, distinct = state["turns"]
            gaps = last - first + 1 - distinct if distinct else 0
            rows.append((now, gaps, *(state[c] for c in longs[1:]), "".join(state["audit"]), state["sha"].hexdigest()))

        def flush():
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], type=conv_type), *(pa.array(c, pa.int64()) for c in columns[1:7]),
                      pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv", *longs, "audit", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.column("conv").type
            names = ("conv", "turn", "was", "fault", "edit", "role", "text", "cost")
            for own, turn, was, fault, edit, role, text, cost in zip(*(batch.column(c).to_pylist() for c in names)):
                if not started or own != now:
                    if started:
                        close()
                    started, now = True, own
                    state = {**{c: 0 for c in longs}, "turns": (None, None, 0), "audit": [], "sha": hashlib.sha256(),
                             "before": None, "empty": True}
                state["audit"].append(edit)
                state["cost"] += cost
                if fault:
                    state[fault] += 1
                if was is not None:
                    if state["before"] is not None and (state["before"], was[:1]) not in legal:
                        state["illegal"] += 1
                    state["before"] = was[:1]
                    first, last, distinct = state["turns"]
                    if turn is not None and turn != last:
                        state["turns"] = (turn if first is None else first, turn, distinct + 1)
                if role is not None:
                    state["sha"].update(("" if state["empty"] else "\n").encode() + f"{role}:{text}".encode())
                    state["empty"] = False
                if len(rows) >= 1000:
                    yield flush()
        if started:
            close()
            yield flush()

    fields = ", ".join(f"{c} bigint" for c in longs)
    out = edits.mapInArrow(summed, f"conv {kind}, {fields}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", conv)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text of rows damaged by the checksum of `conv:turn` modulo 20: 0 drops a row, 1
    empties its text, 2 takes its `[.!?]` out, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(name(conv), F.lit(":"), name(turn))) % 20
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    said = F.when(kind == 1, "").when(kind == 2, F.translate(name(text), ".!?", "")).otherwise(name(text))
    whose = F.when(kind == 4, "user").otherwise(name(role))
    return rows.filter(kind != 0).select(
        F.col(conv).alias(conv), F.col(turn).alias(turn), whose.alias(role), said.alias(text), F.explode(copies).alias("copy")
    ).drop("copy")
