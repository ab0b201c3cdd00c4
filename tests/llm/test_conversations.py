import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelayer.llm import conversations
from tidelayer.llm.conversations import FINE, ROLES, audits, edits, plan_repair, repaired_turns
from tidelayer.llm.suite import op12_conversations

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def cheapest(rows):
    """Rows of (initial, must go, cost of staying): cheapest edits, the ASCII-least of them, and what is left, by uniform search."""
    queue, done = [(0, "", "", (), 0)], set()
    while queue:
        cost, audit, initials, left, k = heapq.heappop(queue)
        state = (k, {"": 0, "s": 1}.get(initials, 2 if initials.endswith("u") else 3))
        if state in done:
            continue
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, left
        done.add(state)
        nexts = [(cost + 5, audit + "I", initials + r, left + ((None, r),)) + (k,) for r in "ua"]
        if k < len(rows):
            initial, gone, extra = rows[k]
            nexts.append((cost + 2, audit + "D", initials, left, k + 1))
            if not gone:
                nexts.append((cost + extra, audit + "K", initials + initial, left + ((k, None),), k + 1))
                nexts += [(cost + 1 + extra, audit + "R", initials + r, left + ((k, r),), k + 1) for r in "ua"]
        for n in nexts:
            if re.fullmatch("s?(ua)*u?", n[2]):
                heapq.heappush(queue, n)


def every_way(rows):
    """All edits with at most two insertions at a place, for very short conversations."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            options = [[]]
            cost, audit = 0, ""
            for k in range(len(rows) + 1):
                cost, audit = cost + 5 * inserts[k], audit + "I" * inserts[k]
                options = [o + list(r) for o in options for r in itertools.product("ua", repeat=inserts[k])]
                if k < len(rows):
                    initial, gone, extra = rows[k]
                    audit += letters[k]
                    cost += {"D": 2, "K": extra, "R": 1 + extra}[letters[k]] + (1000 if gone and letters[k] != "D" else 0)
                    options = [o + list(x) for o in options for x in {"D": [""], "K": [initial], "R": ["u", "a"]}[letters[k]]]
            if cost < 1000 and any(re.fullmatch("(s?(ua)+)?", "".join(o)) for o in options):
                best = min(best or (cost, audit), (cost, audit))
    return best


def as_rows(symbols):
    return [(ROLES[s & 3], s >> 2 in (1, 2), 5 if s >> 2 == 3 else 0) for s in symbols]


def test_search_against_every_way():
    pick = random.Random(3)
    for _ in range(40):
        symbols = bytes(pick.choice([0, 4, 12]) + pick.randrange(4) for _ in range(pick.randrange(4)))
        assert cheapest(as_rows(symbols))[:2] == every_way(as_rows(symbols))


def test_edits_against_uniform_search():
    pick = random.Random(4)
    for n in [0, 1, 2, 3, 5, 8, 9, 16, 17, 40, 90] * 6:
        symbols = bytes(pick.choice([FINE, FINE, FINE, 1, 2, 3]) * 4 + pick.choice([0, 1, 1, 2, 2, 3]) for _ in range(n))
        steps = edits(symbols)
        cost = next(steps)
        audit, left = "", []
        for k, s in enumerate(steps):
            audit += "I" * len(s.inserted) + s.letter
            left += [(None, r[0]) for r in s.inserted]
            if s.stays:
                left.append((k, s.role and s.role[0]))
        assert (cost, audit, tuple(left)) == cheapest(as_rows(symbols))


def brute(originals):
    """Result rows of the query, by plain loops."""
    by_conv = {}
    for conv, turn, role, text in originals:
        kept = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        cost, audit, left = cheapest([(r[1][:1] or "x", f in ("b", "d"), 5 if f == "t" else 0) for r, f in zip(rows, faults)])
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[new] if new else rows[k][1]}:{'' if k is None else rows[k][2]}" for k, new in left]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=str)


def random_rows(seed, size):
    pick = random.Random(seed)
    texts = ["Hi.", "Why?", "open end", "Yes!  \n", "", " \t", "No.", "Ähm.", None, "a:b."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "", "unit"]
    rows = [(pick.randrange(size // 9), pick.choice([None, *range(12)]) if pick.random() < 0.3 else k % 10, pick.choice(roles), pick.choice(texts)) for k in range(size)]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (10**6, 3, "assistant", None)]
    return rows + rows[:40]


def query_rows(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).withColumn("place", F.lit(1)).repartition(3).write.parquet(str(folder / "conversations.parquet"))
    return sorted(map(tuple, op12_conversations(spark, str(folder)).collect()), key=str)


@pytest.mark.parametrize("segment", [4096, 8])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = random_rows(segment, 900)
    assert query_rows(spark, tmp_path, rows) == brute(rows)


def test_hot_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", 64)
    pick = random.Random(8)
    rows = [(1, t, ["user", "assistant"][t % 2] if pick.random() < 0.9 else "tool", pick.choice(["Hi.", f"Turn {t}.", f"open {t}"])) for t in range(1500)]
    rows += [(t, 0, "user", "Hi.") for t in range(2, 400)] + [(1, 700, "user", "again.")] * 300
    assert query_rows(spark, tmp_path, rows) == brute(rows)


def test_general_interface(spark):
    rows = [("a", 0, "system", "Be kind."), ("a", 1, "user", "Hi."), ("a", 3, "assistant", "Hello!"), ("b", 5, "assistant", "Hm.")]
    repair = plan_repair(spark.createDataFrame(rows, "conversation STRING, n INT, who STRING, said STRING"), "conversation", "n", "who", "said")
    assert Counter((r.conv_id, r.audit, r.cost, r.gaps) for r in audits(repair).collect()) == Counter([("a", "KKK", 0, 1), ("b", "D", 2, 0)])
    left = repaired_turns(repair).orderBy("conv_id", "piece", "position").collect()
    assert [(r.conv_id, r.role, r.text) for r in left] == [("a", r, t) for _, _, r, t in rows[:3]]


def test_empty(spark, tmp_path):
    assert query_rows(spark, tmp_path, []) == []
