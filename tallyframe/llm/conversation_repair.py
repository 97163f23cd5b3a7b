"""Repair of a conversation's structure by the cheapest edits, for many conversations at once.

A conversation is right if its roles are an optional system turn and then pairs of user and assistant turns, or if
it has no turn. Turns are kept (free), get another role (``REROLE``), are deleted (``DELETE``, which blank and
repeated ones have to be), or empty ones are put in (``INSERT``); a truncated turn that isn't deleted adds ``CUT``.
Of the cheapest edits those come out whose initials (D, I, K, R) are the least in ASCII order.

Conversations are sorted into buckets of similar length. A bucket is a tensor with the turns as its first axis:
per turn, from the last to the first, the costs of all conversations and states are found in one go and stored,
and the edits are then traced forward, one edit of all conversations at a time.

Conversations with over ``LONG`` turns are cut into blocks of turns, dealt to tasks by ranges of the order. A block's
costs from each state to each are a small matrix; these are put together from the last block to the first, then
the states from the first to the last (a row a block, in one task), and each block traces its own edits.

Turns are taken in the order of (turn, role, text), null turns first. A null role or text counts as one space; a
null conversation is one. ``other`` roles can't be kept; a role is told by its first letter. Extra columns aren't
read. A text of any length passes as it is. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Turns, and characters, from which a conversation is cut into blocks; the logarithm of a block's turns; turns that a task gathers.
LONG, LONG_CHARS, BLOCK_BITS, GATHER = 8192, 1 << 24, 13, 32_768
SPACES = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")
#: States: no turn yet, after system, after user, after assistant; the state after one more user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
FAR = 1 << 40
DONE = np.array([0, FAR, FAR, 0])
ROLES = np.array(["", "system", "user", "assistant"], object)
KEPT = np.full((4, 4), -1)  # the state after keeping a turn with each initial (other, s, u, a) in each state
KEPT[START, 1], KEPT[[START, SYSTEM, ASSISTANT], 2], KEPT[USER, 3] = SYSTEM, USER, ASSISTANT

ROW = "conv_id long, n long, edit string, turn long, was string, role string, text string, fault string, cost long"


def relax(v: np.ndarray) -> np.ndarray:
    """Costs of the states, turns put in before what follows included."""
    out = v.copy()
    out[..., USER] = np.minimum(v[..., USER], INSERT + v[..., ASSISTANT])
    out[..., ASSISTANT] = np.minimum(v[..., ASSISTANT], INSERT + v[..., USER])
    for s in (START, SYSTEM):
        out[..., s] = np.minimum(v[..., s], INSERT + out[..., USER])
    return out


def costs(initial: np.ndarray, fault: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Cost of the rest from each turn and state on, by (turn, conversation, state).

    ``initial`` and ``fault`` are (turn, conversation), ``end`` holds the costs of what comes after the last turn.
    """
    turns, n = initial.shape
    out = np.empty((turns + 1, n, 4), np.int64)
    out[turns] = end
    for t in range(turns - 1, -1, -1):
        after = out[t + 1]
        gone = DELETE + after
        add = np.where(fault[t] == 3, CUT, 0)[:, None]
        kept = np.full((n, 4), FAR)
        for s in range(4):
            to = KEPT[s][initial[t]]
            kept[:, s] = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0)[:, None], 1)[:, 0], FAR)
        stay = np.minimum(kept, REROLE + after[:, NEXT]) + add
        v = relax(np.minimum(gone, np.where(((fault[t] == 1) | (fault[t] == 2))[:, None], FAR, stay)))
        out[t] = np.where((t < length)[:, None], v, after)
    return out


def trace(cost: np.ndarray, initial: np.ndarray, fault: np.ndarray, length: np.ndarray, state: np.ndarray, finish: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(conversation, edit, turn, state after it) of all edits, a conversation's in order, and the last states.

    Turns are put in after the last one only with ``finish``; else the next block does that.
    """
    n = len(length)
    at, state, found = np.zeros(n, np.int64), state.copy(), []
    open_ = np.arange(n)
    while True:
        over = at[open_] >= length[open_]
        stop = over & (DONE[state[open_]] == 0) if finish else over
        open_ = open_[~stop]
        if not len(open_):
            break
        i, s = at[open_], state[open_]
        inside = i < length[open_]
        row = np.minimum(i, len(initial) - 1) if len(initial) else np.zeros(len(i), np.int64)
        now, below = cost[i, open_, s], np.minimum(i + 1, len(cost) - 1)
        kind, to = (fault[row, open_], KEPT[s, initial[row, open_]]) if len(initial) else (np.zeros(len(i), np.int64), np.full(len(i), -1))
        alive = inside & (kind != 1) & (kind != 2)
        add = np.where(kind == 3, CUT, 0)
        drop = inside & (DELETE + cost[below, open_, s] == now)
        put = INSERT + cost[i, open_, NEXT[s]] == now
        put |= ~inside
        keep = alive & (to >= 0) & (cost[below, open_, np.maximum(to, 0)] + add == now)
        edit = np.where(drop, "D", np.where(put, "I", np.where(keep, "K", "R")))
        state[open_] = np.where(drop, s, np.where(edit == "K", to, NEXT[s]))
        found.append((open_, edit, np.where(edit == "I", -1, i), state[open_]))
        at[open_] = i + (edit != "I")
    if not found:
        return *[np.zeros(0, np.int64)] * 4, state
    conv, edit, turn, after = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(conv, kind="stable")
    return conv[order], edit[order], turn[order], after[order], state


def tensors(first: np.ndarray, length: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(conversations, initials, faults) of each bucket of lengths, turns first."""
    bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        t = np.arange(length[own].max())[:, None]
        rows = first[own] + np.minimum(t, length[own] - 1)
        yield own, initial[rows], fault[rows]


def _edits(turns: pa.Table, conv: np.ndarray, edit: np.ndarray, row: np.ndarray, after: np.ndarray, n: np.ndarray, fault: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """Rows of ``ROW``; ``row`` is the turn's place in ``turns``, -1 for one put in."""
    put, gone = row < 0, edit == "D"
    of = pa.array(np.maximum(row, 0), mask=put)
    text, was = turns.column("text").take(of), turns.column("role").take(of)
    own = np.where(put, 0, fault[np.maximum(row, 0)]) if len(fault) else np.zeros(len(row), np.int64)
    new = pa.array(np.where((edit == "I") | (edit == "R"), ROLES[after], None), pa.string())
    role = pa.compute.if_else(pa.array((edit == "K")), was.combine_chunks() if isinstance(was, pa.ChunkedArray) else was, new)
    text = pa.compute.if_else(pa.array(put), pa.scalar(""), text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)
    text = pa.compute.if_else(pa.array(gone), pa.scalar(None, pa.string()), text)
    cost = np.select([gone, put], [DELETE, INSERT], np.where(edit == "R", REROLE, 0) + np.where(own == 3, CUT, 0))
    turn, was = turns.column("turn").take(of), was
    flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (turn, was)]
    columns = [ids.take(pa.array(conv)), pa.array(n), pa.array(edit.astype(object), pa.string()), flat[0], flat[1], role, text, pa.array(np.array(FAULTS, object)[own], pa.string()), pa.array(cost.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "n", "edit", "turn", "was", "role", "text", "fault", "cost"])


def _codes(turns: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return turns.column("initial").to_numpy().astype(np.int64), turns.column("fault").to_numpy().astype(np.int64)


def _whole(turns: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edits of whole conversations, one after the other in ``turns``."""
    key, none = turns.column("conv_id").fill_null(0).to_numpy(), turns.column("conv_id").is_null().to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (none[1:] != none[:-1])
    conv, first = np.cumsum(new) - 1, np.flatnonzero(new)
    length = np.diff(np.append(first, len(key)))
    initial, fault = _codes(turns)
    again = pd.DataFrame({"conv": conv, "role": turns.column("role").to_pandas(), "text": turns.column("text").to_pandas()}).duplicated().to_numpy()
    fault = np.where(fault == 1, 1, np.where(again, 2, fault))
    found = []
    for own, i, f in tensors(first, length, initial, fault):
        cost = costs(i, f, length[own], relax(DONE))
        c, e, t, after, _ = trace(cost, i, f, length[own], np.zeros(len(own), np.int64), True)
        found.append((own[c], e, np.where(t < 0, -1, t + first[own[c]]), after))
    conv, edit, row, after = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(conv, kind="stable")
    conv, edit, row, after = conv[order], edit[order], row[order], after[order]
    start = np.searchsorted(conv, conv)
    ids = turns.column("conv_id").take(pa.array(first)).combine_chunks()
    yield _edits(turns, conv, edit, row, after, np.arange(len(conv)) - start, fault, ids)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < GATHER:
            continue
        turns = pa.Table.from_batches(held).combine_chunks()
        key, none = turns.column("conv_id").fill_null(0).to_numpy(), turns.column("conv_id").is_null().to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]) | (none[1:] != none[:-1]))
        if len(edge):
            yield from _whole(turns.slice(0, edge[-1] + 1))
            held = turns.slice(edge[-1] + 1).to_batches()
    if sum(b.num_rows for b in held):
        yield from _whole(pa.Table.from_batches(held).combine_chunks())


def _long(turns: DataFrame, bits: int) -> DataFrame:
    """Edits of long conversations, by blocks of turns."""
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "copy").sortWithinPartitions(*order, "copy").drop("copy")
    placed = cut(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("same", F.sha2("text", 256)))
    first = placed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("same").alias("s")).agg(F.min("at").alias("first"))
    one = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("same") == F.col("s"))
    fault = F.when(F.col("fault") == 1, 1).when(F.col("at") > F.col("first"), 2).otherwise(F.col("fault"))
    placed = cut(placed.join(first, one).withColumn("fault", fault.cast("int")).withColumn("block", F.shiftright("at", bits)).drop("c", "r", "s", "first", "same"))
    tall = placed.select("conv_id", "block", "at", "initial", "fault")

    def one_block(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        rows = rows.sort_by("at")
        initial, fault = _codes(rows)
        return rows, initial[:, None], fault[:, None], np.array([len(initial)])

    def matrix(rows: pa.Table) -> pa.Table:
        """Costs from each state to each through a block."""
        _, initial, fault, length = one_block(rows)
        ends = np.where(np.eye(4, dtype=bool), 0, FAR)
        through = costs(np.repeat(initial, 4, 1), np.repeat(fault, 4, 1), np.repeat(length, 4), ends)[0].T
        return pa.table({"conv_id": rows.column("conv_id").slice(0, 1), "block": rows.column("block").slice(0, 1), "through": pa.array([through.ravel().tolist()], pa.list_(pa.int64()))})

    def ends(rows: pa.Table) -> pa.Table:
        """Costs of what comes after each block."""
        rows = rows.sort_by([("block", "descending")])
        now, out = relax(DONE), []
        for r in rows.column("through").to_pylist():
            out.append(now.tolist())
            now = relax(np.minimum(FAR, (np.array(r).reshape(4, 4) + now).min(1)))
        last = np.arange(rows.num_rows) == 0
        return pa.table({"conv_id": rows.column("conv_id"), "block": rows.column("block"), "after": pa.array(out, pa.list_(pa.int64())), "last": pa.array(last)})

    def solved(left: pa.Table, right: pa.Table, state: list[int]):
        rows, initial, fault, length = one_block(left)
        end, k = right.to_pylist()[0], len(state)
        cost = costs(initial, fault, length, np.array(end["after"])[None, :])
        wide = [np.repeat(x, k, 1) for x in (cost, initial, fault)]
        return rows, fault, trace(*wide, np.repeat(length, k), np.array(state), end["last"])

    def passage(left: pa.Table, right: pa.Table) -> pa.Table:
        """The state after a block, for each state before it."""
        rows, _, found = solved(left, right, [0, 1, 2, 3])
        return pa.table({"conv_id": rows.column("conv_id").slice(0, 1), "block": rows.column("block").slice(0, 1), "to": pa.array([found[4].tolist()], pa.list_(pa.int64()))})

    def states(rows: pa.Table) -> pa.Table:
        rows, now, out = rows.sort_by("block"), 0, []
        for to in rows.column("to").to_pylist():
            out.append(now)
            now = to[now]
        return pa.table({"conv_id": rows.column("conv_id"), "block": rows.column("block"), "before": pa.array(out, pa.int64())})

    def edits(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, fault, (conv, edit, turn, after, _) = solved(left, right, [right.column("before")[0].as_py()])
        n = (rows.column("block")[0].as_py() << (bits + 2)) + np.arange(len(conv))
        return pa.Table.from_batches([_edits(rows, conv, edit, turn, after, n, fault[:, 0], rows.column("conv_id").slice(0, 1).combine_chunks())])

    key = ["conv_id", "block"]
    through = tall.groupBy(*key).applyInArrow(matrix, "conv_id long, block long, through array<long>")
    after = cut(through.groupBy("conv_id").applyInArrow(ends, "conv_id long, block long, after array<long>, last boolean"))
    to = tall.groupBy(*key).cogroup(after.groupBy(*key)).applyInArrow(passage, "conv_id long, block long, to array<long>")
    before = to.groupBy("conv_id").applyInArrow(states, "conv_id long, block long, before long")
    renamed = before.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before")
    told = cut(after.join(renamed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b"))
    out = placed.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(edits, ROW)
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "n")


def repair(turns: DataFrame, long: int = LONG, long_chars: int = LONG_CHARS, bits: int = BLOCK_BITS) -> DataFrame:
    """The edits of conversations (conv_id, turn, role, text): a row for each, ``n`` giving their order.

    ``was`` is the turn's role and null for one put in, ``role`` and ``text`` are what it is after the repair and
    null for one deleted. All rows of a conversation are in one partition, in order.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    bare = F.rtrim(text, F.lit(SPACES))
    first = F.substring(role, 1, 1)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0).alias("initial"),
        F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
    )
    sizes = rows.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).alias("chars"))
    large = cut(sizes.filter((F.col("turns") > long) | (F.col("chars") > long_chars)).select("c"))
    if not large.limit(1).count():
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_gathered, ROW)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    short = rows.join(large, same, "left_anti").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_gathered, ROW)
    return short.unionByName(_long(rows.join(large, same, "left_semi"), bits))


def damage(conversations: DataFrame) -> DataFrame:
    """Drops, empties, cuts, repeats and reroles turns, as the checksum of ``conv_id:turn`` says; nulls count as one space."""
    space = F.lit(" ")
    what = F.crc32(F.encode(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)), "UTF-8")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), what.alias("what")).filter("what != 0")
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of ``DIGEST`` for each conversation of ``repair``'s rows, which are taken one after the other."""
    out: list[tuple] = []
    open_, conv = None, None

    def closed() -> tuple:
        gaps = open_["high"] - open_["low"] + 1 - open_["turns"] if open_["turns"] else 0
        return (conv, gaps, *[open_["faults"].get(f, 0) for f in FAULTS[1:]], open_["illegal"], open_["cost"], "".join(open_["audit"]), open_["hash"].hexdigest())

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "was", "role", "text", "fault", "cost")]
        for c, edit, turn, was, role, text, fault, cost in zip(*columns, strict=True):
            if open_ is None or c != conv:
                if open_ is not None:
                    out.append(closed())
                conv, open_ = c, {"low": 0, "high": 0, "turns": 0, "last": None, "faults": {}, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "some": False, "before": None}
            o = open_
            o["audit"].append(edit)
            o["cost"] += cost
            if edit != "I":
                if turn is not None and turn != o["last"]:  # in order, so equal turns are neighbours
                    o["low"], o["high"], o["turns"], o["last"] = (turn if not o["turns"] else o["low"]), turn, o["turns"] + 1, turn
                o["faults"][fault] = o["faults"].get(fault, 0) + 1
                if o["before"] is not None:
                    o["illegal"] += o["before"] + was[:1] not in ("su", "ua", "au")
                o["before"] = was[:1]
            if edit != "D":
                o["hash"].update(b"\n" * o["some"] + f"{role}:{text}".encode())
                o["some"] = True
        if len(out) >= 1000:
            yield batch()
            out = []
    if open_ is not None:
        out.append(closed())
    if out:
        yield batch()


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    found = repair(damage(conversations)).mapInArrow(digest, DIGEST).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", *[F.coalesce(c, v).alias(c) for c, v in nothing.items()])


def _least(*values: str) -> str:
    return f"list_min([{', '.join(values)}])"


def _edit(value: str, cost: object, edit: str, out: str = "''") -> str:
    """``value`` (cost, audit, text) after one more edit."""
    return f"{{'c': {value}.c + {cost}, 'a': {value}.a || '{edit}', 'o': {value}.o || {out}}}"


def _when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE far END"


_USER, _ASSISTANT, _SAME, _AS_USER, _AS_ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
_PUT_USER = _least("vu", *[_edit(v, 2, "I", _USER) for v in ("v0", "vs", "va")])
_PUT_ASSISTANT = _least("va", _edit("pu", 2, "I", _ASSISTANT))


def _stay(initial: str, states: tuple[str, ...], out: str) -> list[str]:
    """The turn kept or with another role, from each of the states."""
    return [_when(f"alive AND initial = '{initial}'", _edit(v, "cut", "K", _SAME)) for v in states] + [_when("alive", _edit(v, "2 + cut", "R", out)) for v in states]


_NEW_SYSTEM = _least(_edit("vs", 3, "D"), _when("alive AND initial = 's'", _edit("v0", "cut", "K", _SAME)))
_NEW_USER = _least(_edit("pu", 3, "D"), *_stay("u", ("v0", "vs", "pa"), _AS_USER))
_NEW_ASSISTANT = _least(_edit("pa", 3, "D"), *_stay("a", ("pu",), _AS_ASSISTANT))

#: The same costs from the first turn to the last, with the least audit and the text so far of each state.
OP11_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(n))
), src AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(k)), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS what FROM src, crc
), damaged AS (
  SELECT conv, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE what <> 0
), numbered AS (
  SELECT conv, turn, role, text, substr(role, 1, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare,
         row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged
), again AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM numbered
), told AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM again
), figures AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM told GROUP BY conv
), best AS (
  SELECT DISTINCT conv, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS v0, {{'c': 1000000000, 'a': '', 'o': ''}} AS vs, {{'c': 1000000000, 'a': '', 'o': ''}} AS vu, {{'c': 1000000000, 'a': '', 'o': ''}} AS va FROM told
  UNION ALL
  SELECT conv, i, {_edit("v0", 3, "D")}, {_NEW_SYSTEM}, {_NEW_USER}, {_NEW_ASSISTANT}
  FROM (
    SELECT *, {_PUT_ASSISTANT} AS pa FROM (
      SELECT best.conv, told.i, v0, vs, vu, va, {_PUT_USER} AS pu, role, text, initial, fault NOT IN ('blank', 'duplicate') AS alive, (fault = 'truncated')::INT AS cut, {{'c': 1000000000, 'a': '', 'o': ''}} AS far
      FROM best JOIN told ON told.conv = best.conv AND told.i = best.i + 1
    )
  )
), ended AS (
  SELECT conv, gaps, blank, duplicate, truncated, illegal, {_least("v0", _PUT_ASSISTANT)} AS v FROM (SELECT *, {_PUT_USER} AS pu FROM best JOIN figures USING (conv) WHERE i = n)
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(substr(v.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM src) LEFT JOIN ended USING (conv)
"""
