"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

from tallyframe.llm import conversation_repair as cr
from tallyframe.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if r is None else r), (" " if x is None else x)
        if what == 0:
            continue
        x = "" if what == 1 else re.sub("[.!?]", "", x) if what == 2 else x
        out += [(c, t, "user" if what == 4 else r, x)] * (2 if what == 3 else 1)
    return out


def repaired(turns):
    """Cost, audit, repaired turns and faults of one conversation in order, by Dijkstra's search on (cost, audit)."""
    faults, seen = [], set()
    for _, role, text in turns:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ("", "a"):
            return cost, audit, out, faults
        for x in "ua":
            if (state, x) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", i, x, (*out, (full[x], ""))))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                add = faults[i] == "truncated"
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + add, audit + "K", i + 1, step[state, role[:1]], (*out, (role, text))))
                for x in "ua":
                    if (state, x) in step:
                        heapq.heappush(heap, (cost + 2 + add, audit + "R", i + 1, x, (*out, (full[x], text))))
    raise AssertionError


def expected(rows):
    out, after = [], damaged(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        cost, audit, fixed, faults = repaired(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        text = "\n".join(f"{r}:{x}" for r, x in fixed)
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rnd, n, most):
    rows = []
    for c in range(n):
        texts = [rnd.choice(["Yes.", "No!", "what", "so. ", " ", "", "é?\n", "a\x0b", "Text number %d." % rnd.randint(0, 9)]) for _ in range(5)]
        roles = rnd.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "tool", "", None, "System", "ux"]])
        start = rnd.randint(-3, 3)
        for t in range(rnd.randint(1, most)):
            role = roles[t % 2] if rnd.random() < 0.7 else rnd.choice(roles)
            turn = None if rnd.random() < 0.05 else start + t + (rnd.random() < 0.1) * rnd.randint(-2, 40)
            rows.append((c if c else None, turn, role, None if rnd.random() < 0.03 else rnd.choice(texts) if rnd.random() < 0.5 else f"t{t}."))
    return rows + rows[:7]


def columns(df):
    return sorted((tuple(r[c.split()[0]] for c in cr.DIGEST.split(", ")) for r in df.collect()), key=repr)


def test_query(spark, tmp_path):
    rows = conversations(random.Random(5), 300, 14) + [(5000, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(700)] + [(5001, 1, "user", "x" * 300_000 + ".")]
    # of each checksum that drops a turn, a conversation with that turn only
    rows += [(c, 0, "user", "Gone.") for c in range(6000, 6200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", copy int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = columns(queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)))
    assert got == expected(rows)


def test_long_conversations_in_blocks(spark):
    rows = conversations(random.Random(6), 60, 40)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = columns(cr.repair(cr.damage(df), long=12, bits=2).mapInArrow(cr.digest, cr.DIGEST))
    assert got == [r for r in expected(rows) if r[-2] or r[0] in {x[0] for x in damaged(rows)}]


def test_edits_and_empty(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello."), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes")]
    got = [tuple(r) for r in cr.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("n").select("edit", "role", "text", "fault", "cost").collect()]
    assert got == [("K", "system", "Be brief.", "", 0), ("K", "user", "Hello.", "", 0), ("I", "assistant", "", "", 2), ("K", "user", "Are you there?", "", 0), ("K", "assistant", "Yes", "truncated", 1)]
    assert cr.repair(spark.createDataFrame([], SCHEMA)).collect() == []
