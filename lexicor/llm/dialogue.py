"""Conversation structure repair by bidirectional Dijkstra.

The edit lattice of a conversation has a node for every number of rows read
and every state of ``(s?(ua)+)?`` (nothing yet, after s, after u, after a).
Keeping a row costs nothing (3 if truncated), giving it the user's or the
assistant's role 3 (and 3 if truncated), deleting it 4, inserting an empty
turn 3; blank and repeated rows can only be deleted. A forward heap grows from
the start, a reverse heap from the accepting nodes; once their smallest keys
add up to more than the cheapest meeting, every crossing of that cost is known.
The edges on cheapest paths are those that both searches agree on, and the
least audit is read off them letter by letter.

In Spark, all rows are sorted by conversation and turn over range partitions
and numbered, so that a conversation of any size lies in numbered segments of
at most ``1 << SEGMENT_BITS`` rows. Nearly all conversations are one segment.
Those of several are chained: every segment's costs between its entry and exit
states, then the cheapest cost at every border, then which states the least
audit can be in, each a small row a segment. Rows meet again once, in order,
to hash the repaired text, which is streamed.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SEGMENT_BITS = 12
#: Solved segments of up to so many rows that a task remembers.
KEPT_ROWS, KEPT_SEGMENTS = 64, 50_000
WHITE = " \t\n\x0b\x0c\r"

#: Codes of rows: the role (s, u, a, or 0), and whether truncated or to be deleted.
ROLES = {"s": 1, "u": 2, "a": 3}
TRUNCATED, FAULTY = 4, 8
DELETE, OTHER_ROLE, INSERT, CUT = 4, 3, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after a turn of the next role in order, and after a kept role.
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U, AFTER_U: AFTER_A}
KEPT = {(START, 1): AFTER_S, **{(q, 2): AFTER_U for q in (START, AFTER_S, AFTER_A)}, (AFTER_U, 3): AFTER_A}
FAR = 1 << 60
#: Costs of entering and leaving a whole conversation in each state.
ENTRY, ACCEPT = (0, FAR, FAR, FAR), (0, FAR, FAR, 0)


class Lattice:
    """Edges of one segment; a node is ``4 * rows read + state``. Turns are
    inserted before any row, and behind the last one if the segment is
    its conversation's last."""

    def __init__(self, codes: bytes, last: bool):
        self.codes, self.n, self.last = codes, len(codes), last

    def out(self, node: int):
        """``(letter, node, cost)`` of the edges from a node, by letter."""
        i, q = divmod(node, 4)
        follow = NEXT[q]
        if i == self.n:
            return [("I", 4 * i + follow, INSERT)] if self.last else []
        code, edges = self.codes[i], [("D", node + 4, DELETE), ("I", 4 * i + follow, INSERT)]
        if code < FAULTY:
            more = CUT if code & TRUNCATED else 0
            kept = KEPT.get((q, code & 3))
            if kept is not None:
                edges.append(("K", 4 * i + 4 + kept, more))
            edges.append(("R", 4 * i + 4 + follow, OTHER_ROLE + more))
        return edges

    def into(self, node: int):
        """``(node, cost)`` of the edges into a node."""
        i, p = divmod(node, 4)
        before = [q for q in NEXT if NEXT[q] == p]
        edges = [(4 * i + q, INSERT) for q in before] if i < self.n or self.last else []
        if i:
            code, row = self.codes[i - 1], 4 * i - 4
            edges.append((row + p, DELETE))
            if code < FAULTY:
                more = CUT if code & TRUNCATED else 0
                edges += [(row + q, OTHER_ROLE + more) for q in before]
                edges += [(row + q, more) for (q, role), to in KEPT.items() if to == p and role == code & 3]
        return edges

    def costs(self, entry) -> list[int]:
        """The cheapest cost of leaving in each state, by one search."""
        label, heap = _begin(entry, 0)
        while heap:
            cost, node = heappop(heap)
            if cost == label[node]:
                _relax(label, heap, cost, ((v, w) for _, v, w in self.out(node)))
        return [label.get(4 * self.n + q, FAR) for q in range(4)]

    def cheapest(self, entry, leave) -> tuple[int, dict[int, int]]:
        """The cost of the cheapest paths, given what entering and leaving in
        each state costs, and every node on one of them with the cost up to it."""
        ahead, front = _begin(entry, 0)
        back, rear = _begin(leave, self.n)
        best = min((ahead[v] + back[v] for v in ahead if v in back), default=FAR)
        # Up to and with keys that add up to the best: all crossings of that cost.
        while front and rear and front[0][0] + rear[0][0] <= best:
            forward = front[0][0] <= rear[0][0]
            own, other, heap = (ahead, back, front) if forward else (back, ahead, rear)
            cost, node = heappop(heap)
            if cost == own[node]:
                edges = [(v, w) for _, v, w in self.out(node)] if forward else self.into(node)
                _relax(own, heap, cost, edges)
                best = min(best, min((own[v] + other[v] for v, _ in edges if v in other), default=FAR))
        upto, stack = {}, []
        for node, cost in ahead.items():
            if node in back and cost + back[node] == best:
                upto[node] = cost
            for _, v, w in self.out(node):
                if v in back and cost + w + back[v] == best:
                    upto[node], upto[v] = cost, cost + w
        stack = list(upto)
        while stack:
            node = stack.pop()
            cost = upto[node]
            if ahead.get(node) == cost:
                for v, w in self.into(node):
                    if v not in upto and ahead.get(v) == cost - w:
                        upto[v] = cost - w
                        stack.append(v)
            if back.get(node) == best - cost:
                for _, v, w in self.out(node):
                    if v not in upto and back.get(v) == best - cost - w:
                        upto[v] = cost + w
                        stack.append(v)
        return best, upto

    def least(self, best: int, upto: dict[int, int], states) -> tuple[str, list]:
        """The least audit among cheapest paths that enter in one of ``states``,
        and for every letter ``{node: node before it}``."""
        here = {q: None for q in states if q in upto}
        letters, steps = [], [here]
        while here:
            node = next(iter(here))
            if node // 4 == self.n and (not self.last or upto[node] == best):
                break
            moves: dict[str, dict[int, int]] = {}
            for node in sorted(here):
                for letter, v, w in self.out(node):
                    if upto.get(v) == upto[node] + w:
                        moves.setdefault(letter, {}).setdefault(v, node)
            letter = min(moves)
            here = moves[letter]
            letters.append(letter)
            steps.append(here)
        return "".join(letters), steps


def _begin(costs, at: int):
    label = {4 * at + q: c for q, c in enumerate(costs) if c < FAR}
    heap: list = []
    for node, cost in label.items():
        heappush(heap, (cost, node))
    return label, heap


def _relax(label, heap, cost, edges):
    for v, w in edges:
        if cost + w < label.get(v, FAR):
            label[v] = cost + w
            heappush(heap, (cost + w, v))


def plan(codes: bytes, last: bool, entry, leave, states, leave_in: int | None = None) -> tuple[int, str, str]:
    """The cost of the cheapest paths, the least audit, and for every letter
    the role it gives (u or a; a blank where the row's own or none)."""
    lattice = Lattice(codes, last)
    best, upto = lattice.cheapest(entry, leave)
    audit, steps = lattice.least(best, upto, states)
    node = next(iter(steps[-1])) if leave_in is None else 4 * len(codes) + leave_in
    roles = []
    for letter, step in zip(reversed(audit), reversed(steps)):
        roles.append(" " if letter in "DK" else "u" if node % 4 == AFTER_U else "a")
        node = step[node]
    return best, audit, "".join(reversed(roles))


def _moves(codes: bytes, last: bool, entry, leave) -> list[int]:
    """For every set of entry states (a bit each) ``-1`` or the set of exit
    states, and in two further bits for each of these the entry state that
    leads to it."""
    lattice = Lattice(codes, last)
    best, upto = lattice.cheapest(entry, leave)
    out = [-1] * 16
    for mask in range(1, 16):
        states = [q for q in range(4) if mask >> q & 1]
        if any(q not in upto for q in states) or len({upto[q] for q in states}) > 1:
            continue
        _, steps = lattice.least(best, upto, states)
        value = 0
        for node in steps[-1]:
            at = node
            for step in reversed(steps[1:]):
                at = step[at]
            value |= 1 << node % 4 | at << 4 + 2 * (node % 4)
        out[mask] = value
    return out


def _segments(rows: DataFrame, segment_bits: int) -> DataFrame:
    """``conv, at, codes, blank, duplicate, truncated`` of every segment: the
    number of its first row, a byte a row, and the faults counted."""
    role = F.substring("role", 1, 1)
    code = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), role), F.lit(0))
    bare = F.rtrim("text", F.lit(WHITE))
    light = rows.select("conv", "at", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
                        code.alias("code"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("print"))
    first = light.where(~F.col("blank")).groupBy("conv", "print").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)).alias("fault")
    known = light.join(first, "at", "left").select("conv", "at", "code", fault)
    code = F.col("code") + F.when(F.col("fault").isin(1, 2), FAULTY).when(F.col("fault") == 3, TRUNCATED).otherwise(0)
    tally = [F.count(F.when(F.col("fault") == i + 1, 1)).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated"))]
    return known.groupBy("conv", F.shiftright("at", segment_bits).alias("segment")).agg(
        F.min("at").alias("at"), F.array_sort(F.collect_list(F.shiftleft("at", 4) + code)).alias("codes"), *tally).drop("segment")


def _codes(values) -> bytes:
    return (np.asarray(values, np.int64) & 15).astype(np.uint8).tobytes()


def _chain_costs(table: pa.Table) -> pa.Table:
    """Of the segments of one conversation what entering and leaving each in
    each state costs along cheapest paths."""
    table = table.sort_by("at")
    costs = [np.array(c).reshape(4, 4) for c in table["costs"].to_pylist()]
    entry, leave = [np.array(ENTRY)], [np.array(ACCEPT)]
    for c in costs[:-1]:
        entry.append(np.minimum(FAR, (entry[-1][:, None] + c).min(0)))
    for c in reversed(costs[1:]):
        leave.append(np.minimum(FAR, (c + leave[-1][None, :]).min(1)))
    kind = pa.list_(pa.int64())
    return pa.table({"at": table["at"], "entry": pa.array([e.tolist() for e in entry], kind),
                     "leave": pa.array([x.tolist() for x in reversed(leave)], kind)})


def _chain_states(table: pa.Table) -> pa.Table:
    """Of the segments of one conversation the states the least audit may enter
    it in and the one in which it leaves."""
    table = table.sort_by("at")
    masks, moves = [1], table["moves"].to_pylist()
    for m in moves:
        masks.append(m[masks[-1]] & 15)
    state = next(q for q in range(4) if masks[-1] >> q & 1)
    leave = []
    for m, mask in zip(reversed(moves), reversed(masks[:-1])):
        leave.append(state)
        state = m[mask] >> 4 + 2 * state & 3
    return pa.table({"at": table["at"], "mask": pa.array(masks[:-1], pa.int64()), "leave_in": pa.array(leave[::-1], pa.int64())})


def _each(rows: DataFrame, columns: list[str], names: list[str], kinds: list, fn) -> DataFrame:
    """``rows`` with the columns ``names`` that ``fn`` gives for ``columns``."""
    kept = rows.columns

    def run(batches):
        for batch in batches:
            got = [fn(*v) for v in zip(*(batch.column(kept.index(c)).to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([g[i] for g in got], k) for i, (_, k) in enumerate(kinds))], [*kept, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + "".join(f", {n} {t}" for n, (t, _) in zip(names, kinds)))


def _plans(segments: DataFrame) -> DataFrame:
    """``segments`` with ``cost`` (of the conversation), ``audit`` and ``roles``."""
    longs, text = ("array<long>", pa.list_(pa.int64())), ("string", pa.string())
    several = segments.groupBy("conv").agg(F.count("*").alias("n"), F.max("at").alias("end")).where("n > 1")
    ends = cut_lineage(segments.select("conv", "at").join(
        several.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).select("at", (F.col("at") == F.col("end")).alias("last")), "ends")

    def whole():
        known: dict[bytes, tuple] = {}

        def solve(values):
            codes = _codes(values)
            got = known.get(codes) or plan(codes, True, ENTRY, ACCEPT, [START])
            if len(codes) <= KEPT_ROWS and len(known) < KEPT_SEGMENTS:
                known[codes] = got
            return got

        return solve

    planned = [("long", pa.int64()), text, text]
    names = ["cost", "audit", "roles"]
    out = _each(segments.join(ends, "at", "left_anti").select(*segments.columns), ["codes"], names, planned, whole())
    if ends.isEmpty():
        return out
    parts = cut_lineage(segments.join(ends, "at"), "parts")
    table = _each(parts.select("conv", "at", "codes", "last"), ["codes", "last"], ["costs"], [longs], lambda codes, last: (
        [c for q in range(4) for c in Lattice(_codes(codes), last).costs([0 if p == q else FAR for p in range(4)])],))
    borders = table.select("conv", "at", "costs").groupBy("conv").applyInArrow(_chain_costs, "at long, entry array<long>, leave array<long>")
    parts = cut_lineage(parts.join(borders, "at"), "parts")
    moves = _each(parts.select("conv", "at", "codes", "last", "entry", "leave"), ["codes", "last", "entry", "leave"], ["moves"], [longs],
                  lambda codes, *how: (_moves(_codes(codes), *how),))
    states = moves.select("conv", "at", "moves").groupBy("conv").applyInArrow(_chain_states, "at long, mask long, leave_in long")
    parts = _each(parts.join(states, "at"), ["codes", "last", "entry", "leave", "mask", "leave_in"], names, planned,
                  lambda codes, last, entry, leave, mask, leave_in: plan(
                      _codes(codes), last, entry, leave, [q for q in range(4) if mask >> q & 1], leave_in))
    return out.unionByName(parts.select(*out.columns))


_LEGAL = {"su", "ua", "au"}


class _Tally:
    """One conversation as its plans and rows stream by."""

    def __init__(self):
        self.hash, self.empty, self.audit = hashlib.sha256(), True, []
        self.counts, self.cost, self.illegal, self.turns = [0, 0, 0], 0, 0, 0
        self.first = self.top = self.role = None
        self.todo = iter(())

    def line(self, role: str, text: str):
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.empty = False

    def inserted(self):
        """Goes to the next letter that takes a row; turns before it are written."""
        for letter, role in self.todo:
            if letter != "I":
                return letter, role
            self.line("user" if role == "u" else "assistant", "")
        return None, None

    def segment(self, audit, roles, cost, counts):
        self.inserted()
        self.audit.append(audit)
        self.cost = cost
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.todo = iter(zip(audit, roles))

    def row(self, turn, role, text):
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.top
            self.top = turn
        self.illegal += self.role is not None and self.role + role[:1] not in _LEGAL
        self.role = role[:1]
        letter, to = self.inserted()
        if letter == "K":
            self.line(role, text)
        elif letter == "R":
            self.line("user" if to == "u" else "assistant", text)

    def result(self):
        self.inserted()
        gaps = 0 if self.first is None else self.top - self.first + 1 - self.turns
        return [gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _stream(batches):
    """Conversations of a partition sorted by conversation and row: a plan,
    its rows, the next plan. A conversation's hash can only be taken in order;
    what is held is one batch and the audit."""
    now, tally, started = None, None, False
    for batch in batches:
        convs, results = [], []
        for conv, _, plan, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or conv != now:
                if started:
                    convs.append(now)
                    results.append(tally.result())
                now, tally, started = conv, _Tally(), True
            if plan is not None:
                tally.segment(plan["audit"], plan["roles"], plan["cost"], (plan["blank"], plan["duplicate"], plan["truncated"]))
            else:
                tally.row(turn, role, text)
        yield _result(convs, results, batch.schema.field(0).type)
        kind = batch.schema.field(0).type
    if started:
        yield _result([now], [tally.result()], kind)


def _result(convs, results, kind):
    columns = [pa.array([r[i] for r in results], pa.int64() if i < 6 else pa.string()) for i in range(len(RESULT))]
    return pa.RecordBatch.from_arrays([pa.array(convs, kind), *columns], ["conv", *RESULT])


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", conversations: DataFrame | None = None, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` of every conversation of ``rows`` and of ``conversations``
    (a table with ``conv_col``; those without rows give zeros, an empty audit and
    the hash of nothing).

    Rows are taken by turn (null first), those of one turn by role, then text.
    A null role or text is one blank; a null conversation is one like others.
    Roles count by their first character; one that is not s, u or a (an empty
    role too) cannot be kept. ``gaps`` leaves null turns out. A row is blank
    without other than ASCII white space, else a duplicate if its role and text
    came before, else truncated if its last such character is not ``.``, ``!`` or
    ``?``. Empty tables give none; other columns are not read."""
    conv = F.col(conv_col)
    turns = cut_lineage(rows.select(
        conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text")).orderBy("conv", "turn", "role", "text")
        .withColumn("at", F.monotonically_increasing_id()), "turns")
    plans = _plans(cut_lineage(_segments(turns, segment_bits), "segments"))
    plan = F.struct("audit", "roles", "cost", "blank", "duplicate", "truncated")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    heads = plans.select("conv", "at", plan.alias("plan"), *none)
    body = turns.select("conv", "at", F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"), "turn", "role", "text")
    order = ["conv", "at", F.col("plan").isNull()]
    kind = rows.schema[conv_col].dataType.simpleString()
    done = heads.unionByName(body).repartition("conv").sortWithinPartitions(*order).mapInArrow(
        _stream, f"conv {kind}, " + ", ".join(f"{n} {'long' if i < 6 else 'string'}" for i, n in enumerate(RESULT)))
    if conversations is not None:
        every = conversations.select(conv.alias("c")).distinct()
        done = every.join(done, F.col("c").eqNullSafe(F.col("conv")), "left").select(
            F.col("c").alias("conv"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in RESULT[:6]),
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return done.withColumnRenamed("conv", conv_col)


def damage(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Damaged ``conv_col, turn_col, role_col, text_col`` of ``rows``, nulls as one
    blank in role, text and key: by crc32 of ``conv:turn`` modulo 20 a row is
    dropped (0), emptied (1), loses its full stops, exclamation and question
    marks (2), comes twice (3) or is the user's (4)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)))
    how = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    return rows.where(how != 0).select(
        conv_col, turn_col, F.when(how == 4, F.lit("user")).otherwise(role).alias(role_col),
        F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.explode(F.array_repeat(F.lit(0), F.when(how == 3, 2).otherwise(1))).alias("again")).drop("again")
