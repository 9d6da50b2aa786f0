"""Conversation repair against a plain program that keeps the least (cost, letters) of each state, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomsift.llm import queries, repair

SF = "/root/testdata/sf0.001"
CONV = "conv_id bigint, turn bigint, role string, text string, copies int, fault string"


def cheapest(symbols):
    """``(cost, letters)`` from the start on; symbols are None (must go) or (role initial, truncated)."""
    keep = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def least(found):
        out = {}
        for cost, letters, state in found:
            if state not in out or (cost, letters) < out[state]:
                out[state] = (cost, letters)
        return out

    def inserted(best):
        found = [(c, w, s) for s, (c, w) in best.items()]
        for n in (1, 2, 3):
            for s, (c, w) in best.items():
                for _ in range(n):
                    s = after[s]
                found.append((c + 5 * n, w + "I" * n, s))
        return least(found)

    best = {"": (0, "")}
    for symbol in symbols:
        found = []
        for s, (c, w) in inserted(best).items():
            found.append((c + 2, w + "D", s))
            if symbol is not None:
                initial, cut = symbol
                if (s, initial) in keep:
                    found.append((c + 5 * cut, w + "K", keep[s, initial]))
                found.append((c + 1 + 5 * cut, w + "R", after[s]))
        best = least(found)
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def plain(rows):
    out = {}
    for conv, *_ in rows:
        out[conv] = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    result = {}
    for conv, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in own if t is not None]
        seen, symbols, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols.append(None if fault in ("blank", "duplicate") else (role[:1], fault == "truncated"))
        cost, letters = cheapest(symbols)
        left, state, at = [], "", 0
        for x in letters:
            state_next = "a" if state == "u" else "u"
            if x == "I":
                left.append(f"{'assistant' if state_next == 'a' else 'user'}:")
                state = state_next
                continue
            _, role, text = own[at]
            at += 1
            if x == "K":
                left.append(f"{role}:{text}")
                state = role[0]
            elif x == "R":
                left.append(f"{'assistant' if state_next == 'a' else 'user'}:{text}")
                state = state_next
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(left).encode()).hexdigest()
        result[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, digest)
    return result


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], CONV)


def answers(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_letters_of_runs_equal_a_plain_program():
    rng = random.Random(3)
    names = [None, *itertools.product("suax", (False, True))]
    for n in range(1500):
        symbols = [rng.choice([0, 1, 3, 3, 4, 5, 5, 6, 7, 8, 2]) for _ in range(rng.randrange(10))]
        if n % 5 == 0:
            symbols = [s for s in symbols for _ in range(rng.randrange(1, 300))]
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        assert repair.solve(runs) == cheapest([names[s] for s in symbols])
    assert repair.before([(3, 10**12)], repair.END)[repair.START] == 10**12 // 2  # every second one gets another role


def test_matrices_of_parts_make_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        runs = [(rng.randrange(9), rng.randrange(1, 30)) for _ in range(8)]
        after = repair.before(runs[4:], repair.END)
        m = repair.matrix(runs[:4])
        joined = tuple(min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4))
        assert joined == repair.before(runs, repair.END)


@pytest.mark.parametrize("block", [repair.BLOCK, 150])
def test_conversations_equal_a_plain_program(spark, block):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert answers(repair.repair(frame(spark, rows), block)) == plain(rows)


@pytest.mark.parametrize("block", [repair.BLOCK, 60])
def test_odd_conversations(spark, block):
    rng = random.Random(8)
    texts = [None, "", " ", "\x0b\n", "Yes.", "Yes", "No!", "a. ", "é?", "x" * 3000, "y" * 5000 + ".", ". b"]
    roles = ["user", "assistant", "system", None, "", "User", "tool", "sys"]
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), rng.choice([None, *range(40)]), rng.choice(roles[: rng.choice([2, 8])]), rng.choice(texts)) for _ in range(400)]
    rows += rows[:60]  # repeated rows
    rows += [(100 + k, 0, "user", "Hm.") for k in range(60)]  # some lose their only row
    rows += [(7, k, "user", "Again.") for k in range(900)] + [(7, None, "user", "Again.")] * 50  # one long run of duplicates
    rows += [(8, k, "user" if k % 2 else "assistant", f"Turn {k}" + "." * (k % 3 > 0)) for k in range(700)]
    want = plain(rows)
    assert answers(repair.repair(frame(spark, rows), block)) == want
    empty = [k for k, v in want.items() if v[6] == "" and v[5] == 0]
    assert empty and want[empty[0]][7] == hashlib.sha256(b"").hexdigest()


def test_no_conversations(spark):
    assert repair.repair(frame(spark, [])).count() == 0


def test_query(spark):
    assert queries.op13_conversation_repair(spark, SF).columns == [f.split()[0] for f in repair.RESULT.split(",")]
