"""Conversation repair against a plain search of all edits."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from codestrata.llm import conversation_repair

STEP = {"": "ua", "s": "ua", "u": "ua", "a": "ua"}


def after(state, letter):
    """The dialogue after a turn, told by its last letter; None where it is not one."""
    if letter == "s":
        return "s" if state == "" else None
    if letter == "u":
        return "u" if state in ("", "s", "a") else None
    return "a" if letter == "a" and state == "u" else None


def plain(rows):
    """Every conversation by uniform-cost search over (cost, audit)."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kept = groups[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = set()
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[1][:1] for r in kept]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:]))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, said = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(kept) and state in ("", "a"):
                break
            for letter, role in (("u", "user"), ("a", "assistant")):
                if after(state, letter):
                    heapq.heappush(heap, (cost + 2, audit + "I", i, letter, (*said, f"{role}:")))
            if i < len(kept):
                _, role, text = kept[i]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, said))
                if faults[i] not in ("blank", "duplicate"):
                    more = faults[i] == "truncated"
                    if after(state, role[:1]):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, after(state, role[:1]), (*said, f"{role}:{text}")))
                    for letter, name in (("u", "user"), ("a", "assistant")):
                        if after(state, letter):
                            heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, letter, (*said, f"{name}:{text}")))
        sha = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.add((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


def conversations(seed=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ärzte", "s", "u"]
    said = ["Yes.", "Why?", "no", "  ", None, "", "Long text without an end", "Fin!\n", "é.", "ok…", " "]
    rows = []
    for conv in [*range(120), None, 1 << 60]:
        n = rng.randrange(1, 9)
        if conv is not None and conv % 3 == 0:
            rows += [(conv, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(n)]
        else:
            rows += [(conv, rng.choice([None, *range(6), 1 << 55]) if rng.random() < 0.3 else t, rng.choice(roles), rng.choice(said)) for t in range(n)]
    rows += [(7, 1, "user", "Same.")] * 4 + [(None, None, None, None)]
    rows += [(500, t, rng.choice(roles[:6]), rng.choice(["Yes.", "no", f"Line {t}.", f"Line {t}", ""])) for t in range(300)]
    rows += [(501, t // 3, ("user", "assistant")[t % 2], f"{t}." + " x" * 2000 + ".") for t in range(60)]
    return rows


NAMES = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block_rows", [conversation_repair.BLOCK_ROWS, 7, 1])
def test_against_all_edits(spark, block_rows):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], NAMES + ", audit string, n long").repartition(5)
    found = conversation_repair.repair(table, block_rows=block_rows)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in found.collect()]
    wanted = plain(rows)
    assert len(got) == len(wanted) and set(got) == wanted


def test_empty_table_and_dropped_rows(spark):
    assert conversation_repair.repair(spark.createDataFrame([], NAMES)).collect() == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    [row] = conversation_repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], NAMES)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_of_one_row_repeated(spark):
    rows = [(1, 1, "user", "Again.")] * 4000 + [(2, t, ("user", "assistant")[t % 2], f"T {t}.") for t in range(3000)]
    got = {tuple(r) for r in conversation_repair.repair(spark.createDataFrame(rows, NAMES), block_rows=256).collect()}
    assert got == plain(rows)
