"""Conversation structure repair by iterative-deepening A* (op 12).

Rows of a conversation, in the order of their turns, are edited so that the roles' initials read
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1), Delete (2, required for blank and duplicate
rows), Insert an empty user or assistant text (5); a truncated row that stays costs 5 more.  The audit is the
string of the edits' initials; of the cheapest ones the ASCII-least is taken.

``search`` is a depth-first search in ASCII order of the edits (D, I, K, R) under a bound on the cost that grows by
one until a path is accepted.  A lower bound on what the remaining rows cost prunes, and a
transposition table holds, for each (row, state) from which no path was found, the largest remaining budget that failed.
The first accepting path is the answer: none is cheaper, and the order makes it the least.

The grammar is an automaton of four states (nothing, after s, after u, after a), so an edit's role follows from the state.
A conversation of more than ``PIECE`` rows is searched piece by piece, from each state to each state, and the
pieces' paths are chained by least cost, then least audit.  (Inserted rows belong to the piece of the row after
them, so no piece's audit begins another's and the least of the whole is made of least pieces.)  So the time
grows with the rows of a conversation, not with their square.

On Spark: faults are flagged by DataFrame functions (duplicates by a window over equal role and text, which spreads a
huge conversation); narrow rows are sorted by conversation and read as a stream, 20 bytes held per row of one conversation;
the texts are then streamed past the audits, one row at a time, into the hash.  That hash is sequential by its
contract, so one conversation's rows end in one task, but no task holds them.

Cases: null role or text is one space; null conv_id is a conversation, shown as a space in the damage key as is a null turn;
null turns come first; rows of one turn go by role, then by their text's hash; an empty role has no initial and cannot
stay; a conversation without rows after the damage has zeros, an empty audit and the hash of the empty string; an empty
table gives no rows; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECE = 64
_BLANKS = " \t\n\x0b\f\r"
#: Per row: what must or may happen to it.
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, INSERT, REROLE, KEEP_TRUNCATED = 2, 5, 1, 5
LEGAL = {"su", "ua", "au"}
#: state -> initials that may follow, with the state they lead to; and the initial that Insert and Rerole give.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ("u", "u", "a", "u")
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}


def least_costs(initials: str, faults: Sequence[int]) -> list[int]:
    """For each row a bound from below on the cost of it and all after it.

    A faulty row costs 2 at least.  Of two neighbouring clean rows that may not follow each other, one must be changed or
    a row put between; a change costs 1 at least and mends two such pairs at most.
    """
    out, faulty, pairs = [0], 0, 0
    for i in range(len(initials) - 1, -1, -1):
        if faults[i] != CLEAN:
            faulty += 1
        elif i + 1 < len(initials) and faults[i + 1] == CLEAN and initials[i:i + 2] not in LEGAL:
            pairs += 1
        out.append(DELETE * faulty + (pairs + 1) // 2)
    return out[::-1]


def search(initials: str, faults: Sequence[int], start: int, ends: Sequence[int], insert_after: bool) -> tuple[int, str]:
    """(cost, audit) of the cheapest, then ASCII-least path from state ``start`` to one of ``ends``, which some path must reach.

    ``insert_after``: rows may be inserted after the last one too.
    """
    n, below = len(initials), least_costs(initials, faults)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def down(i: int, state: int, budget: int) -> bool:
        if budget < below[i] or budget <= failed.get((i, state), -1):
            return False
        if i == n and state in ends:
            return True
        for edit in "DIKR":
            at, to, cost = i + 1, state, DELETE
            if edit == "I":
                at, to, cost = i, FOLLOW[state][GIVEN[state]], INSERT
                if i == n and not insert_after:
                    continue
            elif i == n:
                continue
            elif edit != "D":
                if faults[i] in (BLANK, DUPLICATE):
                    continue
                to = FOLLOW[state].get(initials[i] if edit == "K" else GIVEN[state])
                if to is None:
                    continue
                cost = (REROLE if edit == "R" else 0) + (KEEP_TRUNCATED if faults[i] == TRUNCATED else 0)
            if cost > budget:
                continue
            path.append(edit)
            if down(at, to, budget - cost):
                return True
            path.pop()
        failed[i, state] = budget
        return False

    bound = below[0]
    while not down(0, start, bound):
        bound += 1
    return bound, "".join(path)


def _reachable(initials: str, faults: Sequence[int], start: int, end: int) -> bool:
    """Whether some path over these rows leads from one state to the other."""
    if end == 0:
        return start == 0
    if end == 1:  # only a system row that may stay leads there
        return start == 1 or start == 0 and any(x == "s" and f in (CLEAN, TRUNCATED) for x, f in zip(initials, faults))
    return True


@functools.lru_cache(maxsize=4096)  # short conversations repeat each other's shapes
def _search(initials: str, faults: tuple[int, ...], start: int, ends: tuple[int, ...], insert_after: bool) -> tuple[int, str]:
    return search(initials, faults, start, ends, insert_after)


def cheapest(initials: str, faults: Sequence[int], piece: int = PIECE) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    n = len(initials)
    cuts = list(range(0, n, piece)) or [0]
    paths: list[dict] = []
    for a in cuts:
        chunk, bad, last = initials[a:a + piece], tuple(faults[a:a + piece]), a == cuts[-1]
        goals = [ACCEPTING] if last else [(s,) for s in range(4)]
        starts = [0] if a == 0 else range(4)
        paths.append({(s, g): _search(chunk, bad, s, g, last) for s in starts for g in goals
                      if last or _reachable(chunk, bad, s, g[0])})
    # What the pieces from each one on cost, by the state they start in; then the least path through them.
    costs = [{}]
    for table in reversed(paths):
        after = costs[-1]
        best: dict[int, int] = {}
        for (s, g), (cost, _) in table.items():
            total = cost + (0 if len(g) > 1 else after.get(g[0], 1 << 62))
            best[s] = min(total, best.get(s, total))
        costs.append(best)
    costs.reverse()
    state, audit = 0, []
    for k, table in enumerate(paths):
        options = [(text, g[0]) for (s, g), (cost, text) in table.items()
                   if s == state and cost + (0 if len(g) > 1 else costs[k + 1].get(g[0], 1 << 62)) == costs[k][state]]
        text, state = min(options)
        audit.append(text)
    return costs[0][0], "".join(audit)


# --- rows -----------------------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the CRC-32 of ``conv_id:turn`` decides."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *shown)) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" ")))
    return (rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                         F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _sorted(df: DataFrame, *first: str) -> DataFrame:
    """Rows dealt by conversation and sorted by it, ``first``, turn, role and text hash."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in ("conv_id", *first)] + [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]
    return df.repartition(tasks, "conv_id").sortWithinPartitions(*keys)


def _groups(batches) -> Iterator[tuple]:
    """(conv_id, iterator of its rows) of rows sorted by their first column."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
    return groupby(rows, key=lambda row: row[0])


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): its faults, the cost of the repair and its audit."""
    text = F.rtrim(F.col("text"), F.lit(_BLANKS))
    last = F.substr(text, F.length(text), F.lit(1))
    h = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2")]
    rows = rows.select("conv_id", "turn", "role", *h, F.when(text == "", BLANK).when(last.isin(".", "!", "?"), CLEAN)
                       .otherwise(TRUNCATED).alias("fault"))
    same = Window.partitionBy("conv_id", "role", "h1", "h2").orderBy(F.col("turn").asc_nulls_first())
    again = (F.row_number().over(same) > 1) & (F.col("fault") != BLANK)
    rows = rows.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault")))

    def audit(batches):
        for conv, group in _groups(batches):
            initials, faults, illegal, gaps, low, before, role_before = [], bytearray(), 0, 0, None, None, None
            for _, turn, role, _, _, fault in group:
                initials.append(role[:1] or "\0")
                faults.append(fault)
                if role_before is not None and role_before[:1] + role[:1] not in LEGAL:
                    illegal += 1
                if turn is not None and before is not None:
                    gaps += max(0, turn - before - 1)
                before, role_before = (turn if turn is not None else before), role
            cost, text = cheapest("".join(initials), faults)
            counts = [faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)]
            yield conv, gaps, *counts, illegal, cost, text

    schema = _arrow(_AUDIT)
    narrow = _sorted(rows).select("conv_id", "turn", "role", "h1", "h2", "fault")
    return narrow.mapInArrow(lambda batches: _batches(audit(batches), schema), _AUDIT)


def _arrow(ddl: str):
    import pyarrow as pa

    return pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in ddl.split(", ")])


def _batches(rows: Iterator[tuple], schema) -> Iterator:
    import itertools

    import pyarrow as pa

    while some := list(itertools.islice(rows, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) rows that the edits of ``audit`` make of ``rows``."""
    state = 0
    for edit in audit:
        if edit == "I":
            role, text = ROLES[GIVEN[state]], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[GIVEN[state]]
        state = FOLLOW[state][role[:1]]
        yield role, text


def _repair_stream(rows: DataFrame, found: DataFrame, convs: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(conversation's audit row or its zeros, iterator of repaired rows)`` for every conversation, in one stream.

    Each conversation starts with a row of its own (kind 0), then its audit row (kind 1), then its texts (kind 2).
    """
    facts = [c.split()[0] for c in _AUDIT.split(", ")][1:]
    none = lambda kind, *cols: [F.lit(None).cast(kind).alias(c) for c in cols]
    fact_types = dict(c.split() for c in _AUDIT.split(", "))
    no_facts = [x for c in facts for x in none(fact_types[c], c)]
    no_row = [*none("long", "turn"), *none("string", "role", "text"), *none("long", "h1", "h2")]
    start = convs.select("conv_id", F.lit(0).alias("kind"), *no_row, *no_facts)
    audit = found.select("conv_id", F.lit(1).alias("kind"), *no_row, *facts)
    texts = rows.select("conv_id", F.lit(2).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", F.xxhash64("text").alias("h1"),
                        F.xxhash64("text", F.lit(7)).alias("h2"), *no_facts)
    stream = _sorted(start.union(audit).union(texts), "kind").select("conv_id", "kind", "role", "text", *facts)

    def read(batches):
        import itertools

        for conv, group in _groups(batches):
            next(group)
            row = next(group, None)
            known = [0] * (len(facts) - 1) + [""] if row is None else list(row[4:])
            texts = ((r[2], r[3]) for r in itertools.chain([] if row is None or row[1] == 1 else [row], group))
            yield from emit((conv, *known), repaired(known[-1], texts))

    out = _arrow(schema)
    return stream.mapInArrow(lambda batches: _batches(read(batches), out), schema)


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text of every conversation after its cheapest repair."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    schema = "conv_id long, turn long, role string, text string"

    def emit(facts, texts):
        for i, (role, text) in enumerate(texts):
            yield facts[0], i, role, text

    return _repair_stream(rows, audits(rows), rows.select("conv_id").distinct(), emit, schema)


def op12_conversation_repair(conversations: DataFrame) -> DataFrame:
    convs = conversations.select("conv_id", "turn", "role", "text")
    rows = damaged(convs)
    schema = f"{_AUDIT}, repaired_sha256 string"

    def emit(facts, texts):
        h = hashlib.sha256()
        for i, (role, text) in enumerate(texts):
            h.update((("\n" if i else "") + role + ":" + text).encode())
        yield *facts, h.hexdigest()

    return _repair_stream(rows, audits(rows), convs.select("conv_id").distinct(), emit, schema)
