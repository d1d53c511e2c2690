"""Conversation repair against a plain dynamic programme."""
import hashlib
import random
import zlib

import pytest

from lexicor.llm import dialogue
from lexicor.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else text.translate({ord(c): None for c in ".!?"}) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def plain_repair(rows):
    """Expected tuple of one conversation's rows, by all cheapest prefixes."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    seen, tally = set(), [0, 0, 0]
    best = {"": (0, "", ())}

    def better(into, q, value):
        if q not in into or value[:2] < into[q][:2]:
            into[q] = value

    def with_inserts(states):
        for _ in range(3):
            new = dict(states)
            for q, (c, audit, lines) in states.items():
                better(new, follow[q], (c + 3, audit + "I", (*lines, ("user" if follow[q] == "u" else "assistant") + ":")))
            states = new
        return states

    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            tally[fault - 1] += 1
        new = {}
        for q, (c, audit, lines) in with_inserts(best).items():
            better(new, q, (c + 4, audit + "D", lines))
            if fault in (1, 2):
                continue
            more = 3 if fault == 3 else 0
            if role[:1] in ("s", "u", "a") and (role[0] == "s" and q == "" or role[0] == follow[q]):
                better(new, role[0], (c + more, audit + "K", (*lines, f"{role}:{text}")))
            better(new, follow[q], (c + 3 + more, audit + "R", (*lines, ("user" if follow[q] == "u" else "assistant") + f":{text}")))
        best = new
    last = with_inserts(best)
    cost, audit, lines = min(last[q] for q in ("", "a") if q in last)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *tally, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows, every):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return sorted([(c, *(plain_repair(by[c]) if c in by else empty)) for c in {r[0] for r in every}], key=str)


def conversation(rng, conv, n):
    rows = []
    for t in range(n):
        role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]) if rng.random() < 0.5 else (
            "user" if t % 2 == 0 else "assistant")
        text = rng.choice(["Yes.", "No!", "Why?", "cut off", " \t", "", None, f"row {t}.", f"row {t}", "done. \n", "é\n."])
        rows.append((conv, rng.choice([t, t, t, t + 5, None]) if rng.random() < 0.3 else t, role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, plan string")


@pytest.mark.parametrize("seed,bits", [(1, 12), (2, 2), (3, 1), (4, 0)])
def test_repair_equals_brute_force(spark, seed, bits):
    rng = random.Random(seed)
    rows = [r for c in range(70) for r in conversation(rng, c if c else None, rng.randint(1, 14))]
    rows += conversation(rng, 900, 260)
    got = dialogue.repair(frame(spark, rows), segment_bits=bits)
    assert got.columns == ["conv_id", *dialogue.RESULT]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, QUERIES["op11_conversation_repair"](spark, sf).collect()), key=str)
    assert got == brute(plain_damage(rows), rows)


def test_damage_of_odd_rows(spark):
    rng = random.Random(8)
    rows = [r for c in range(60) for r in conversation(rng, c if c else None, 9)]
    got = dialogue.damage(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_damage(rows), key=str)


def test_empty_and_lost_conversations(spark):
    docs = frame(spark, [(1, 0, "user", "Hi."), (2, 0, "user", "Hi.")])
    every = frame(spark, [(3, 0, "user", "x"), (None, 0, "user", "x")])
    got = sorted(map(tuple, dialogue.repair(docs.where("conv_id = 1"), conversations=docs.unionByName(every)).collect()), key=str)
    assert got == brute([(1, 0, "user", "Hi.")], [(1,), (2,), (3,), (None,)])
    assert dialogue.repair(docs.limit(0)).count() == 0 and dialogue.repair(docs.limit(0), conversations=docs.limit(0)).count() == 0


def test_searches_meet_on_every_cheapest_path():
    rng = random.Random(5)
    for _ in range(400):
        codes = bytes(rng.choice([1, 2, 3, 2, 3, 5, 6, 7, 0, 9, 10, 11]) for _ in range(rng.randint(1, 12)))
        lattice = dialogue.Lattice(codes, True)
        best, upto = lattice.cheapest(dialogue.ENTRY, dialogue.ACCEPT)
        costs = lattice.costs(dialogue.ENTRY)
        assert best == min(costs[0], costs[3])
        cost, audit, roles = dialogue.plan(codes, True, dialogue.ENTRY, dialogue.ACCEPT, [0])
        assert cost == best and len(audit) == len(roles) and sum(c != "I" for c in audit) == len(codes)
