"""Repair of conversations by iterative-deepening A*.

A conversation is well formed if its role initials are `(s?(ua)+)?`: perhaps a system turn, then user and assistant in
turn, or nothing. Edits: Keep (K) costs 0, Rerole (R) to user or assistant 2, Delete (D) 3, Insert (I) of an empty user
or assistant turn 2; a truncated row that stays adds 1; a blank or duplicate row must go. The search goes depth first,
in ASCII order of edits, under a cost bound that starts at a lower bound (what each row costs by itself) and rises to the
least cost that was still missed. States (row, automaton state) that failed keep what they need at least, so none is
searched twice with the same budget. The first accepting path is the cheapest, and the ASCII-least of these.

A long conversation is cut inside of runs of 16 faultless rows in which user and assistant alternate. Leaving such a run
costs more than any way into step with it, so each cheapest path keeps the row before the cut, and the pieces are searched
one by one. This holds searches to the stretches between such runs; the result is that of one search.

Order: turn (null first), then role and text, so rows that share a turn have a defined place; repeated rows are
duplicates. A row's first fault counts: blank (no character but ASCII white space), duplicate (role and text seen
earlier), truncated (last such character none of `.!?`). A role without a first character (null, empty) fits nowhere:
such a row is given a role or deleted. A null text is empty. A null conv_id is a conversation like any other. Other
columns are not read, whatever their names. A conversation without rows has zeros, an empty audit and no turns; an empty
table gives an empty result. Rows go to their conversation by one shuffle and stream through the task in order; a task
holds one conversation at a time, as the repaired conversation is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Costs, and the automaton: states are start, after s, after u, after a.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("user", "user", "assistant", "user")
ACCEPTING = frozenset({0, 3})
LEGAL = {"su", "ua", "au"}
_SPACE, _STOPS = b"\x20\x09\x0a\x0b\x0c\x0d", b".!?"
#: Faults of a row; the last two must be deleted.
NONE, TRUNCATED_ROW, DUPLICATE, BLANK = range(4)
#: Faultless alternating rows on either side of a cut.
HALF = 8
#: Rows of results in a record batch, and bytes of their texts, at most.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

Move = tuple[str, int, int, int]  # edit, cost, rows used, next state


def _moves(initial: str, fault: int, state: int) -> tuple[Move, ...]:
    """The edits in one state before a row, in ASCII order; without a row for the initial '$'."""
    here, wanted = STEP[state], STEP[state][WANTED[state][0]]
    insert = ("I", INSERT, 0, wanted)
    if initial == "$":
        return (insert,)
    extra = TRUNCATED if fault == TRUNCATED_ROW else 0
    found: list[Move] = [("D", DELETE, 1, state), insert]
    if fault < DUPLICATE:
        found += [("K", extra, 1, here[initial])] if initial in here else []
        found.append(("R", REROLE + extra, 1, wanted))
    return tuple(found)


#: For each kind of row (initial, fault): the moves by state, and the least that a row of the kind costs.
MOVES = {(c, f): tuple(_moves(c, f, q) for q in range(4)) for c in "sua-$" for f in range(4)}
LEAST = {(c, f): min(m[1] for q in range(4) for m in MOVES[c, f][q] if m[2]) for c in "sua-" for f in range(4)}
END = MOVES["$", NONE]


def cheapest_edits(rows: list[tuple[str, int]], start: int = 0, goals: frozenset[int] = ACCEPTING) -> str:
    """The initials of the cheapest edits, the ASCII-least of them, that lead rows (initial, fault) from a state to a goal."""
    n = len(rows)
    moves = [MOVES[r] for r in rows] + [END]
    # what each state (4 * row + automaton state) needs at least
    need = [0] * (4 * n) + [0 if q in goals else INSERT for q in range(4)]
    floor = 0
    for i in reversed(range(n)):
        floor += LEAST[rows[i]]
        need[4 * i : 4 * i + 4] = [floor] * 4
    while True:
        edits: list[str] = []
        stack = [(start, need[start], iter(moves[0][start]))]
        while stack:
            node, left, open_moves = stack[-1]
            i, q = divmod(node, 4)
            if i == n and q in goals:
                return "".join(edits)
            for edit, cost, used, to in open_moves:
                child = 4 * (i + used) + to
                if cost + need[child] <= left:
                    edits.append(edit)
                    stack.append((child, left - cost, iter(moves[i + used][to])))
                    break
            else:
                need[node] = max(need[node], min(cost + need[4 * (i + used) + to] for _, cost, used, to in moves[i][q]))
                stack.pop()
                if edits:
                    edits.pop()


def pieces(rows: list[tuple[str, int]]) -> Iterator[tuple[int, int, int]]:
    """(first row, end, state reached, or -1 for any accepting one) of the stretches that are searched one by one."""
    first, run = 0, 0
    for i in range(len(rows) + 1):
        clean = i < len(rows) and rows[i][1] == NONE and rows[i][0] in "ua"
        if clean and run and rows[i][0] != rows[i - 1][0]:
            run += 1
            continue
        if run >= 2 * HALF:
            cut = i - run // 2
            yield first, cut, STEP[3 if rows[cut - 1][0] == "u" else 2][rows[cut - 1][0]]
            first = cut
        run = int(clean)
    yield first, len(rows), -1


def audit(rows: list[tuple[str, int]]) -> str:
    """The whole conversation's cheapest_edits, piece by piece."""
    out, state = [], 0
    for first, end, to in pieces(rows):
        out.append(cheapest_edits(rows[first:end], state, ACCEPTING if to < 0 else frozenset({to})))
        state = to
    return "".join(out)


def initial_of(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "-"


def faults(turns: list[tuple[str, bytes]]) -> list[int]:
    """The first fault of each (role, text)."""
    seen: set[tuple[str, bytes]] = set()
    found = []
    for turn in turns:
        last = turn[1].rstrip(_SPACE)[-1:]
        found.append(BLANK if not last else DUPLICATE if turn in seen else NONE if last in _STOPS else TRUNCATED_ROW)
        seen.add(turn)
    return found


def apply_edits(edits: str, turns: list[tuple[str, bytes]]) -> tuple[list[tuple[str, bytes]], int]:
    """The repaired turns and what the edits cost, a stop's cost for truncated rows that stay included."""
    out: list[tuple[str, bytes]] = []
    state = i = 0
    cost = {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}
    for e in edits:
        role, text = turns[i] if e != "I" else ("", b"")
        i += e != "I"
        if e != "D":
            out.append((role if e == "K" else WANTED[state], text))
            state = STEP[state][out[-1][0][0]]
    return out, sum(map(cost.__getitem__, edits))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = "array<struct<role:string,text:string>>"


def repaired_row(turns: list[tuple[int | None, str, bytes]]) -> tuple:
    """COUNTS, audit and repaired turns of one conversation's rows (turn, role, text) in order."""
    spoken = [(role, text) for _, role, text in turns]
    found = faults(spoken)
    numbers = {t for t, *_ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(spoken, spoken[1:]))
    edits = audit([(initial_of(role), f) for (role, _), f in zip(spoken, found)])
    fixed, cost = apply_edits(edits, spoken)
    stay = [e for e in edits if e != "I"]
    cost += sum(TRUNCATED for e, f in zip(stay, found, strict=True) if f == TRUNCATED_ROW and e != "D")
    return gaps, found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED_ROW), illegal, cost, edits, fixed


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """conv_id, COUNTS, audit and `repaired`, the turns after repair, of every conversation.

    gone: a boolean column; rows where it is true only name their conversation.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    lost = F.col(gone) if gone else F.lit(False)
    body = lambda c: F.when(~lost, F.coalesce(F.col(c).cast("string"), F.lit("")))
    source = rows.select(F.col(conv_id).alias("conv_id"), F.when(~lost, F.col(turn).cast("long")).alias("turn"), body(role).alias("role"), body(text).alias("text"), lost.alias("gone"))
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    schema = T.StructType([source.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired", T._parse_datatype_string(REPAIRED))])
    arrow = to_arrow_schema(schema)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """conv_id and repaired_row of each run of rows of one conversation."""
        held, own, begun = [], None, False
        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            for key, number, who, said, lost in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, batch.column(4).to_pylist(), strict=True):
                if begun and key != own:
                    yield own, repaired_row(held)
                    held = []
                own, begun = key, True
                if not lost:
                    held.append((number, who, said))
        if begun:
            yield own, repaired_row(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            keys = pa.array([key for key, _ in out], arrow.field(0).type)
            columns = [pa.array([r[i] for _, r in out], pa.int64()) for i in range(len(COUNTS))]
            turns = [[{"role": who, "text": said.decode("utf-8", "replace")} for who, said in r[7]] for _, r in out]
            return pa.RecordBatch.from_arrays([keys, *columns, pa.array([r[6] for _, r in out], arrow.field("audit").type), pa.array(turns, arrow.field("repaired").type)], names=arrow.names)

        for key, result in results(batches):
            out.append((key, result))
            size += sum(len(said) for _, said in result[7])
            if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """Conversation rows with the faults of the contract, by the crc32 of `conv_id:turn` modulo 20; `gone` marks dropped ones."""
    blank = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))), F.lit(20))
    text = F.coalesce(F.col("text"), blank)
    hurt = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the damaged table: counts of faults, the cheapest edits and a digest of the repaired turns."""
    repaired = repair_conversations(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.select("conv_id", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
