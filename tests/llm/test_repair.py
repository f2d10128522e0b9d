"""Conversation repair against search over all edits and against a pass from left to right."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidewire.llm import repair

WHITE = re.compile(r"[^\x20\x09-\x0D]")
GOOD = re.compile(r"(s?(ua)+)?")


def marks(rows):
    """(initial, faulty, cut) and the counts of rows [(role, text)] in order."""
    seen, out, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        shown = WHITE.findall(text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        out.append((role[:1], fault in ("blank", "duplicate"), bool(shown) and shown[-1] not in ".!?"))
    return out, n


def straight(marked):
    """(cost, audit) by one pass over the rows, the best of each state kept."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(3):
            for p, (c, a) in list(best.items()):
                for r in "ua":
                    q = step.get((p, r))
                    if q and (q not in best or (c + 3, a + "I") < best[q]):
                        best[q] = (c + 3, a + "I")
        return best

    best = inserted({"": (0, "")})
    for initial, faulty, cut in marked:
        new = {}
        for p, (c, a) in best.items():
            ways = [(p, 4, "D")]
            if not faulty:
                ways += [(step[p, initial], 3 * cut, "K")] if (p, initial) in step else []
                ways += [(step[p, r], 3 + 3 * cut, "R") for r in "ua" if (p, r) in step]
            for q, more, op in ways:
                new[q] = min(new.get(q, (10**9, "")), (c + more, a + op))
        best = inserted(new)
    return min(best[q] for q in ("", "a") if q in best)


def exhaustive(marked, most=3):
    """(cost, audit) over all edits with at most `most` insertions between rows."""
    gaps = ["".join(g) for k in range(most + 1) for g in itertools.product("ua", repeat=k)]
    best = None
    for choice in itertools.product(*[[("D", "")] + ([] if f else [("K", i or "?"), ("R", "u"), ("R", "a")]) for i, f, _ in marked]):
        base = sum({"D": 4, "K": 0, "R": 3}[op] + (3 if op != "D" and m[2] else 0) for (op, _), m in zip(choice, marked))
        for ins in itertools.product(gaps, repeat=len(marked) + 1):
            roles = ins[0] + "".join(r + g for (_, r), g in zip(choice, ins[1:]))
            cost = base + 3 * sum(map(len, ins))
            if (best is None or cost <= best[0]) and GOOD.fullmatch(roles):
                got = (cost, "I" * len(ins[0]) + "".join(op + "I" * len(g) for (op, _), g in zip(choice, ins[1:])))
                best = got if best is None else min(best, got)
    return best


def cyk(marked):
    cell = repair.together([repair.EMPTY, *[repair.row_cell(*m) for m in marked]])
    return min(c for (p, q), c in zip(repair.PAIRS, cell) if p == 0 and q in repair.FINAL and c is not None)


def test_cells_against_search():
    rng = random.Random(3)
    kinds = [(i, f, c) for i in ("s", "u", "a", "t", "") for f in (False, True) for c in (False, True)]
    for n in (0, 1, 2):
        for marked in itertools.product(kinds, repeat=n):
            assert cyk(marked) == straight(marked) == exhaustive(marked, 2)
    for _ in range(400):
        marked = [rng.choice(kinds) for _ in range(rng.randrange(3, 60))]
        assert cyk(marked) == straight(marked)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """conv_id -> what op13 returns, of conversations' rows."""
    hurt, out = damage(rows), {}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in hurt if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marked, n = marks([(r[2], r[3]) for r in mine])
        cost, audit = straight(marked)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        lines, left, last = [], iter(mine), ""
        for op in audit:
            row = next(left) if op != "I" else None
            if op == "D":
                continue
            role = row[2] if op == "K" else "assistant" if last[:1] == "u" else "user"
            lines.append(f"{role}:{row[3] if row else ''}")
            last = role
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_query(spark, tmp_path, block):
    rng = random.Random(block)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 40])):
            text = rng.choice(["Yes.", "No", "", " \t", "Why? ", "é!\n", "So it is. And", None, f"T{turn}.", f"T{turn}"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), text))
    rows += rows[:5] + [(99, 1, "user", "long " * 300_000 + "end."), (99, 2, "assistant", "x" * 10**6)]
    rows += [(c, 1, "user", "gone") for c in range(1000, 1100) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in repair.op13_repair(spark, str(tmp_path), block).collect()}
    want = plain(rows)
    assert set(got) == set(want) and not [(k, got[k], want[k]) for k in want if got[k] != want[k]]


def test_long_conversation_and_repeats(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"t{t}." if t % 7 else "t") for t in range(3000)] + [(2, 5, "user", "Same.")] * 2000
    summary, repaired = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 64)
    got = {r.conv_id: r for r in summary.collect()}
    for conv in (1, 2):
        marked, n = marks([(r[2], r[3]) for r in rows if r[0] == conv])
        assert (got[conv].cost, got[conv].audit) == straight(marked) and got[conv].duplicate == n["duplicate"]
    out = [r for r in repaired.collect() if r.conv == "=1"]
    assert GOOD.fullmatch("".join(r.role[0] for r in out)) and [r.place for r in out] == list(range(len(out)))


def test_empty(spark):
    summary, repaired = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert summary.collect() == [] and repaired.collect() == []
