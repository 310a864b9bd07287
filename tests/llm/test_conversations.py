import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from belegwerk.llm import conversations as c
from belegwerk.llm.queries_conversations import op12_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies int, step int, digest string, chunk string"
BLANK = re.compile("[^\x20\x09-\x0d]")
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """rows of (initial, fault) -> cost and audit, by keeping the least (cost, audit) per state, row after row."""
    def inserts(best):
        best = dict(best)
        for _ in range(4):
            for s, (cost, audit) in list(best.items()):
                for r in "ua":
                    if (to := STEPS.get((s, r))) is not None:
                        best[to] = min(best.get(to, (1 << 40, "")), (cost + 3, audit + "I"))
        return best

    best = {0: (0, "")}
    for initial, fault in rows:
        new: dict = {}
        for s, (cost, audit) in inserts(best).items():
            options = [(s, cost + 4, "D")]
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if (s, initial) in STEPS:
                    options.append((STEPS[s, initial], cost + more, "K"))
                options += [(STEPS[s, r], cost + 3 + more, "R") for r in "ua" if (s, r) in STEPS]
            for to, total, letter in options:
                new[to] = min(new.get(to, (1 << 40, "")), (total, audit + letter))
        best = new
    return min(v for s, v in inserts(best).items() if s in (0, 3))


def brute(given: list[tuple], ids) -> list[tuple]:
    out = []
    for conv in ids:
        rows = [(turn, " " if role is None else role, " " if text is None else text)
                for i, turn, role, text, copies in given if i == conv for _ in range(copies)]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest(list(zip(initials, faults, strict=True)))
        left, state, at = [], 0, 0
        for letter in audit:
            if letter == "I":
                left.append("assistant:" if state == 2 else "user:")
            else:
                _, role, text = rows[at]
                at += 1
                if letter == "D":
                    continue
                left.append(f"{role if letter == 'K' else 'assistant' if state == 2 else 'user'}:{text}")
            state = STEPS[state, left[-1][0]]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left)) and at == len(rows)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, given):
    return spark.createDataFrame([(*g, 7, "x", "y") for g in given], SCHEMA).repartition(5)


def same(spark, given, ids=None):
    known = None if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id bigint")
    got = sorted((tuple(r) for r in c.repair(frame(spark, given), known).collect()), key=repr)
    assert got == brute(given, {g[0] for g in given} if ids is None else set(ids))
    return got


def made(seed: int, conversations: int, longest: int):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "uncle", None, "", "User"]
    texts = ["One.", "Two!", "Three? \n", "cut off", "", " \t\r\n\x0b\x0c", None, "été.", "Four. x", "Five. ", "Six"]
    out = []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 2])
            role = rng.choices(roles, [10, 10, 4, 1, 1, 1, 1, 1])[0]
            text = rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}{rng.choice(['.', '', '!'])}"
            out.append((conv if conv else None, rng.choice([turn, turn, turn, None]) if rng.random() < 0.1 else turn, role, text, rng.choice([1, 1, 1, 1, 2, 5])))
    return out


def test_powers_equal_repeated_products():
    for symbol in range(9):
        m, step = c._power(symbol, 0), c._power(symbol, 0)
        for n in range(2, 9):
            m = c._product(m, step)
            assert all(c._advance(symbol, n, v) == c._times(m, v) for v in ((0, 6, 3, 0), (5, 1, 9, 2)))
    assert c._matrix([(4, 3), (6, 2), (8, 5)]) == c._product(c._product(c._product(c._product(c._power(4, 1), c._power(4, 0)), c._power(6, 1)),
                                                                       c._power(8, 2)), c._power(8, 0))


def test_every_short_conversation_is_repaired_as_cheaply_as_can_be():
    codes = {("s", ""): 2, ("u", ""): 4, ("a", ""): 6, ("a", "truncated"): 7, ("t", ""): 0, ("u", "blank"): 8}
    for n in range(5):
        for rows in product(codes, repeat=n):
            runs: list = []
            for r in rows:
                if runs and runs[-1][0] == codes[r]:
                    runs[-1][1] += 1
                else:
                    runs.append([codes[r], 1])
            _, audit = c._unroll(runs, c._FINAL, 0, True)
            ahead = c._FINAL
            for symbol, length in reversed(runs):
                ahead = c._advance(symbol, length, ahead)
            assert (ahead[0], audit) == cheapest(list(rows)), rows


def test_same_as_brute_force(spark):
    same(spark, made(1, 60, 12))


@pytest.mark.parametrize("chunk", [1, 7])
def test_long_conversations_in_many_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    got = same(spark, made(2, 12, 120))
    assert max(len(r[7]) for r in got) > 100


def test_one_conversation_with_most_rows_and_one_row_repeated_without_end(spark):
    given = made(3, 6, 8) + [(9, k, "user" if k % 3 else "assistant", f"{k}.", 1) for k in range(400)]
    given += [(8, 1, "user", "Again.", 70_000), (8, 2, "assistant", "", 50_000), (8, 3, "assistant", "Yes.", 1)]
    got = {r[0]: r for r in same(spark, given)}
    assert got[8][7] == "K" + "D" * 119_999 + "K" and got[8][2:5] == (50_000, 69_999, 0)


def test_conversations_without_rows_and_empty_tables(spark):
    given = made(4, 3, 4)
    got = {r[0]: r for r in same(spark, given, [None, 1, 2, 77])}
    assert got[77] == (77, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert c.repair(frame(spark, [])).collect() == [] and c.repaired(frame(spark, [])).collect() == []


def test_repaired_turns_give_the_digest(spark):
    given = made(5, 30, 10)
    rows = frame(spark, given)
    digests = {r.conv_id: r.repaired_sha256 for r in c.repair(rows).collect()}
    texts: dict = {k: [] for k in digests}
    for r in sorted(c.repaired(rows).collect(), key=lambda r: r.place):
        assert r.edit in "KRI" and (r.edit != "I" or (r.turn is None and r.text == ""))
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in texts.items()} == digests


def test_damage_and_the_query_on_the_smallest_table(spark):
    folder = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = []
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            hurt.append((conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, 1 + (kind == 3)))
    got = sorted((tuple(r) for r in op12_conversation_repair(spark, folder).collect()), key=repr)
    assert got == brute(hurt, {r[0] for r in table})
    odd = spark.createDataFrame([(None, None, None, None), (1, None, None, "a.b!"), (None, 2, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    assert all(r.role in (" ", "user") and r.text is not None for r in c.damaged(odd).collect())
