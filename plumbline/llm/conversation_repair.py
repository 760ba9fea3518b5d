"""Conversation structure repair by Hirschberg's divide and conquer over four-state cost vectors.

Roles must read ``(s?(ua)+)?`` by their initials: four states (nothing yet, after the system row, after a user, after an assistant).  Keeping a
row is free, giving it another role costs 3, deleting it 4 and inserting a turn 3; a truncated row that stays costs 3 more, and blank and
duplicate rows must go.  Of the cheapest edits those whose initials (D, I, K, R) are least in ASCII order are taken.

*One element for each span.*  A span of rows is known by its cheapest cost from each state to each, and by the order of the exits reached from one
state by their least edit strings.  Two spans compose: the costs by a minimum over the state in the middle, ties going to the
crossing whose left string is least (the strings of one span that start in one state differ, and none is the beginning of another, because
inserts stand before the row that they precede).  Composition is associative, so elements of any spans, rows or whole blocks, meet in a balanced way.

*Reconstruction.*  From the outside in, each span's entry and exit states are known, its forward costs to the middle and its backward costs
from the middle meet there, and the audit-least of the cheapest crossings is its halves' exit and entry.  All spans of one size are halved at once; space
is linear in the rows.

*On Spark.*  Rows are dealt out in ranges of (conversation, turn, role, beginning of text), so that one conversation may spread over any number of tasks.  A
task repairs the conversations that lie within its range at once.  Its first and last ones may go on elsewhere: they are written as chunks of bounded size
with their element; elements are composed for each conversation, every chunk gets its entry and exit state, is repaired by
itself, and the pieces are put together in order, the hash being fed chunk by chunk.

Cases: nulls in role, text and (for the damage) keys count as one space; rows with a null conv_id are one conversation; rows of one turn go by role, then
text; an empty role is no initial and cannot be kept; a conversation whose rows are all dropped has zeros, an empty audit and the hash of the empty
string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Rows and bytes of text of one chunk.
CHUNK_ROWS, CHUNK_BYTES = 1 << 14, 4 << 20
#: Rows of a conversation up to which a task remembers the repair of equal ones.
SHORT = 64
#: edits' costs, and what counts as white space and as an end of a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK_PATTERN = r"\A[\x20\x09-\x0D]*\z"
WHOLE_PATTERN = r"[.!?][\x20\x09-\x0D]*\z"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: What a state may be followed by: the initial and the state it leads to.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Above any cost; sums of two stay far from overflow.
NEVER = 1 << 40
FINE, MUST_GO, CUT = range(3)

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ANSWER = [f.split()[0] for f in SCHEMA.split(", ")]
_NUMBERS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "at_first", "at_last"]
_FOUND = f"done boolean, {SCHEMA}, task int, chunk int, rows long, turns long, at_first long, at_last long, first string, last string, codes binary, roles array<string>, texts array<string>"

# --- spans -------------------------------------------------------------------------------------


def _moves(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest cost and least edit string of one row from state to state, inserts before it included."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(STATES):
        state, spent, done = start, 0, ""
        for _ in range(STATES):
            extra = TRUNCATED if fault == CUT else 0
            options = [(state, DELETE, "D")]
            if fault != MUST_GO:
                options += [(to, REROLE + extra, "R") for c, to in FOLLOWS[state].items() if to in NAMES]
                if initial in FOLLOWS[state]:
                    options.append((FOLLOWS[state][initial], extra, "K"))
            for to, cost, edit in options:
                best[start, to] = min(best.get((start, to), (NEVER, "")), (spent + cost, done + edit))
            state, spent, done = next(to for c, to in FOLLOWS[state].items() if c != "s"), spent + INSERT, done + "I"
    return best


INITIALS = "sua"
#: Row kinds: four initials (of which one is "any other") with three faults.
KINDS = [_moves(i, f) for i in (*INITIALS, "-") for f in (FINE, MUST_GO, CUT)]


def _ranks(strings: list[str | None]) -> list[int]:
    order = sorted({s for s in strings if s is not None})
    return [order.index(s) if s is not None else STATES for s in strings]


KIND_COST = np.array([[[k.get((s, t), (NEVER, ""))[0] for t in range(STATES)] for s in range(STATES)] for k in KINDS])
KIND_RANK = np.array([[_ranks([k[s, t][1] if (s, t) in k else None for t in range(STATES)]) for s in range(STATES)] for k in KINDS])
#: The span of no rows.
NONE_COST = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
NONE_RANK = np.where(np.eye(STATES, dtype=bool), 0, STATES)
#: Inserts after the last row, by state.
TAIL = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
TAIL_COST = np.array([INSERT * len(TAIL[s]) for s in range(STATES)])


def code_of(initial: str, fault: int) -> int:
    return (INITIALS.find(initial) if initial and initial in INITIALS else len(INITIALS)) * 3 + fault


def crossing(cost_a: np.ndarray, rank_a: np.ndarray, cost_b: np.ndarray) -> np.ndarray:
    """For spans side by side, the middle state by entry and exit: cheapest, then least edit string."""
    total = cost_a[:, :, :, None] + cost_b[:, None, :, :]
    return (total * (STATES + 1) + rank_a[:, :, :, None]).argmin(2)


def composed(cost_a: np.ndarray, rank_a: np.ndarray, cost_b: np.ndarray, rank_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of the spans that consist of a left and a right one, for many pairs."""
    middle = crossing(cost_a, rank_a, cost_b)
    n = np.arange(len(cost_a))[:, None, None]
    s, t = np.arange(STATES)[None, :, None], np.arange(STATES)[None, None, :]
    cost = np.minimum(cost_a[n, s, middle] + cost_b[n, middle, t], NEVER)
    key = rank_a[n, s, middle] * (STATES + 1) + rank_b[n, middle, t]
    key = np.where(cost < NEVER, key, 1 << 20)
    rank = (key[:, :, None, :] < key[:, :, :, None]).sum(3)
    return cost, np.where(cost < NEVER, rank, STATES)


def _tree(cost: np.ndarray, rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Elements of all spans of 1, 2, 4, ... parts; an odd one out meets the span of no rows."""
    levels = [(cost, rank)]
    while len(levels[-1][0]) > 1:
        cost, rank = levels[-1]
        if len(cost) % 2:
            cost, rank = np.concatenate([cost, NONE_COST[None]]), np.concatenate([rank, NONE_RANK[None]])
            levels[-1] = cost, rank
        levels.append(composed(cost[::2], rank[::2], cost[1::2], rank[1::2]))
    return levels


def _halved(levels: list[tuple[np.ndarray, np.ndarray]], start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each part, all spans of one size being halved at once."""
    before, after = np.array([start]), np.array([end])
    for cost, rank in reversed(levels[:-1]):
        before, after = before[: len(cost) // 2], after[: len(cost) // 2]
        middle = crossing(cost[::2], rank[::2], cost[1::2])[np.arange(len(before)), before, after]
        before, after = np.stack([before, middle], 1).ravel(), np.stack([middle, after], 1).ravel()
    return before, after


def element(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost and rank of a whole run of rows."""
    if not len(codes):
        return NONE_COST, NONE_RANK
    cost, rank = _tree(KIND_COST[codes], KIND_RANK[codes])[-1]
    return cost[0], rank[0]


def edits(codes: np.ndarray, start: int, end: int) -> tuple[list[str], list[int]]:
    """The edits of each row (its inserts first) and the state before it, from state ``start`` to ``end``."""
    if not len(codes):
        return [], []
    before, after = _halved(_tree(KIND_COST[codes], KIND_RANK[codes]), start, end)
    before, after = before[: len(codes)].tolist(), after[: len(codes)].tolist()
    return [KINDS[c][s, t][1] for c, s, t in zip(codes.tolist(), before, after, strict=True)], before


def ending(cost: np.ndarray, rank: np.ndarray) -> tuple[int, int]:
    """Cheapest total of a conversation with this element, and the state after its last row."""
    key = (cost[START] + TAIL_COST) * (STATES + 1) + rank[START]
    end = int(key.argmin())
    return int(cost[START, end] + TAIL_COST[end]), end


@lru_cache(1 << 15)
def _short(codes: bytes, start: int, end: int) -> tuple[list[str], list[int]]:
    return edits(np.frombuffer(codes, np.uint8), start, end)


@lru_cache(1 << 15)
def _solved(codes: bytes) -> tuple[int, int]:
    return ending(*element(np.frombuffer(codes, np.uint8)))


def rewritten(codes: bytes, start: int, end: int, roles: list[str], texts: list[str], last: bool) -> tuple[str, list[str]]:
    """Edit string and repaired ``role:text`` rows of a chunk; the last chunk of a conversation gets what is missing at its end."""
    audit, states = _short(codes, start, end) if len(codes) <= SHORT else edits(np.frombuffer(codes, np.uint8), start, end)
    out: list[str] = []

    def insert(state: int) -> int:
        to = ASSISTANT if state == USER else USER
        out.append(f"{NAMES[to]}:")
        return to

    for steps, state, role, text in zip(audit, states, roles, texts, strict=True):
        for _ in steps[:-1]:
            state = insert(state)
        if steps[-1] == "K":
            out.append(f"{role}:{text}")
        elif steps[-1] == "R":
            out.append(f"{NAMES[ASSISTANT if state == USER else USER]}:{text}")
    tail = TAIL[end] if last else ""
    for _ in tail:
        end = insert(end)
    return "".join(audit) + tail, out


# --- rows --------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by a hash of ``conv_id:turn``.  Dropped rows stay, marked ``gone``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 0, "").otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``seen``: whether an earlier turn of the conversation has the same role and text.  Equal rows of one turn are told apart later.

    First turns are a minimum that combines map-side, so a row that fills a conversation is one key of one row.
    """
    mark = F.sha2("text", 256)
    kept = rows.where("not gone")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = kept.groupBy("conv_id", "role", mark.alias("mark")).agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), "mark", "least")
    found = rows.withColumn("_m", mark).join(first.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_m") == F.col("mark")), "left")
    return found.select("conv_id", "turn", "role", "text", "gone", F.coalesce(order > F.col("least"), F.lit(False)).alias("seen"))


def _arrow() -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in _FOUND.split(", "))])


_FOUND_ARROW = _arrow()


class _Chunk:
    """Rows of one conversation as they come, and what their order says of them."""

    def __init__(self) -> None:
        self.codes, self.roles, self.texts = bytearray(), [], []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.at_first: int | None = None
        self.at_last: int | None = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool, blank: bool, whole: bool) -> None:
        self.blank += blank
        self.duplicate += repeated and not blank
        cut = not blank and not repeated and not whole
        self.truncated += cut
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None:
            if self.at_last != turn:
                self.turns += 1
            self.at_first = turn if self.at_first is None else self.at_first
            self.at_last = turn
        self.codes.append(code_of(initial, MUST_GO if blank or repeated else CUT if cut else FINE))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)

    def full(self) -> bool:
        return len(self.codes) >= CHUNK_ROWS or self.size >= CHUNK_BYTES

    def numbers(self) -> dict:
        return {"rows": len(self.codes)} | {c: getattr(self, c) for c in _NUMBERS[1:]} | {"first": self.first, "last": self.last}


def _whole(conv_id: int | None, chunk: _Chunk) -> dict:
    codes = bytes(chunk.codes)
    cost, end = _solved(codes) if len(codes) <= SHORT else ending(*element(np.frombuffer(codes, np.uint8)))
    audit, lines = rewritten(codes, START, end, chunk.roles, chunk.texts, True)
    gaps = chunk.at_last - chunk.at_first + 1 - chunk.turns if chunk.turns else 0
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return chunk.numbers() | {"done": True, "conv_id": conv_id, "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of the conversations within a task's range, chunks of its first and last ones."""
    task = TaskContext.get().partitionId()
    out: list[dict] = []

    def part(conv_id: int | None, number: int, c: _Chunk) -> dict:
        return c.numbers() | {"done": False, "conv_id": conv_id, "task": task, "chunk": number, "codes": bytes(c.codes), "roles": c.roles, "texts": c.texts}

    def given() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_pylist(out, _FOUND_ARROW)
            out.clear()

    chunk: _Chunk | None = None
    now: object = None
    row_before: tuple | None = None
    number = 0
    split = True  # the task's first conversation may have begun elsewhere
    for batch in batches:
        text = batch.column("text").to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "gone", "seen", "is_blank", "is_whole")]
        for conv_id, turn, role, gone, seen, is_blank, is_whole, body in zip(*columns, text, strict=True):
            if chunk is None or conv_id != now:
                if chunk is not None:
                    out.append(part(now, number, chunk) if split else _whole(now, chunk))
                    split = False
                chunk, now, number, row_before = _Chunk(), conv_id, 0, None
            if chunk.full():
                out.append(part(now, number, chunk))
                yield from given()
                chunk, number, split = _Chunk(), number + 1, True
            if not gone:
                row = turn, role, body
                chunk.add(turn, role, body, seen or row == row_before, is_blank, is_whole)
                row_before = row
        if len(out) > 500:
            yield from given()
    if chunk is not None:
        out.append(part(now, number, chunk))
    yield from given()


def _chain(parts: pd.DataFrame) -> pd.DataFrame:
    """One conversation's chunks, as elements: the entry and exit state of each, and on the last the answer's numbers."""
    parts = parts.sort_values(["task", "chunk"], ignore_index=True)
    cost, rank = (np.stack([np.frombuffer(x, np.int64).reshape(STATES, STATES) for x in parts[c]]) for c in ("element_cost", "element_rank"))
    levels = _tree(cost, rank)
    total, end = ending(levels[-1][0][0], levels[-1][1][0])
    before, after = _halved(levels, START, end)
    out = parts[["conv_id", "task", "chunk"]].copy()
    out["entry"], out["leave"] = before[: len(parts)], after[: len(parts)]
    filled = parts[parts["rows"] > 0]
    border = sum(a + b not in ("su", "ua", "au") for a, b in zip(filled["last"][:-1], filled["first"][1:], strict=True))
    turned = parts[parts["turns"] > 0]
    shared = int((turned["at_last"].to_numpy()[:-1] == turned["at_first"].to_numpy()[1:]).sum())
    out["gaps"] = int(turned["at_last"].iloc[-1] - turned["at_first"].iloc[0]) + 1 - int(turned["turns"].sum()) + shared if len(turned) else 0
    for c in ("blank", "duplicate", "truncated"):
        out[c] = int(parts[c].sum())
    out["illegal"] = int(parts["illegal"].sum()) + border
    out["cost"] = total
    out["is_last"] = np.arange(len(parts)) == len(parts) - 1
    return out


_CHAIN = "conv_id long, task int, chunk int, entry int, leave int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, is_last boolean"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks' elements in place of their codes."""
    for batch in batches:
        spans = [element(np.frombuffer(c, np.uint8)) for c in batch.column("codes").to_pylist()]
        kept = batch.drop_columns(["codes"])
        for name, k in (("element_cost", 0), ("element_rank", 1)):
            kept = kept.append_column(name, pa.array([np.ascontiguousarray(s[k], np.int64).tobytes() for s in spans], pa.binary()))
        yield kept


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's edit string and repaired rows."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("codes", "entry", "leave", "roles", "texts", "is_last")]
        made = [rewritten(*x) for x in zip(*columns, strict=True)]
        kept = batch.drop_columns(["codes", "entry", "leave", "roles", "texts"])
        kept = kept.append_column("audit", pa.array([a for a, _ in made], pa.string()))
        yield kept.append_column("repaired", pa.array(["\n".join(x) if x else None for _, x in made], pa.string()))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its pieces in order: the hash takes them one by one, the edit strings are kept."""
    digest, audit, begun = hashlib.sha256(), [], False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["repaired"] is not None:
                digest.update((("\n" if begun else "") + row["repaired"]).encode())
                begun = True
            audit.append(row["audit"])
            if row["is_last"]:
                out.append(row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                digest, audit, begun = hashlib.sha256(), [], False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.string() if n in _ANSWER[-2:] else pa.int64()) for n in _ANSWER], _ANSWER)


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and hash of the repaired rows for each conversation of ``conv_id, turn, role, text, gone``."""
    blank, whole = F.col("text").rlike(BLANK_PATTERN), F.col("text").rlike(WHOLE_PATTERN)
    ranged = _with_faults(rows).select("*", blank.alias("is_blank"), whole.alias("is_whole"), F.substring("text", 1, 16).alias("_begin"))
    ranged = ranged.repartitionByRange("conv_id", "turn", "role", "_begin").sortWithinPartitions("conv_id", "turn", "role", "text", F.col("gone").desc())
    found = written(ranged.select("conv_id", "turn", "role", "text", "gone", "seen", "is_blank", "is_whole").mapInArrow(_scan, _FOUND))
    edges = found.where("not done")
    at = ["conv_id", "task", "chunk"]
    spans = edges.select(*at, *_NUMBERS, "first", "last")
    summed = edges.select(*spans.columns, "codes").mapInArrow(_summed, spans.schema.add("element_cost", "binary").add("element_rank", "binary"))
    chain = written(summed.groupBy("conv_id").applyInPandas(_chain, _CHAIN))
    known = chain.withColumnsRenamed({c: f"_{c}" for c in at})
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("task") == F.col("_task")) & (F.col("chunk") == F.col("_chunk"))
    both = edges.select(*at, "codes", "roles", "texts").join(known.hint("merge"), same).drop(*(f"_{c}" for c in at))
    kept = both.drop("codes", "entry", "leave", "roles", "texts").schema
    pieces = both.mapInArrow(_pieces, kept.add("audit", "string").add("repaired", "string"))
    pieces = pieces.repartition(F.col("conv_id")).sortWithinPartitions(*at)
    return found.where("done").select(*_ANSWER).unionByName(pieces.mapInArrow(_joined, SCHEMA))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
