"""Conversation repair against a plain search of the cheapest, least audits."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from cohortlens.llm import conversation_repair as repair, queries
from helpers import SF, rows_of, tuples, with_clashes

DDL = "conv_id LONG, turn LONG, role STRING, text STRING"
CLASHES = ("conv", "kind", "fault", "code", "same", "head", "role_head", "low", "high", "nulls", "audit", "cost")
PATTERN = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out, convs = [], []
    for conv, turn, role, text in rows:
        convs.append(conv)
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out, list(dict.fromkeys(convs))


def cheapest(initials, faults):
    """(cost, audit) by trying every edit from each row and state, from the end."""
    go = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    new = {"": "u", "s": "u", "u": "a", "a": "u"}
    tail = {"": (0, ""), "s": (4, "II"), "u": (2, "I"), "a": (0, "")}
    best = tail
    for initial, fault in zip(reversed(initials), reversed(faults)):
        here = {}
        for state in go:
            options = []
            for inserts in range(4):
                at = state
                for _ in range(inserts):
                    at = new[at]
                late = fault == "truncated"
                moves = [(3, "D", at)]
                if fault not in ("blank", "duplicate"):
                    moves.append((2 + late, "R", new[at]))
                    if initial in go[at]:
                        moves.append((0 + late, "K", go[at][initial]))
                options += [(2 * inserts + price + best[to][0], "I" * inserts + letter + best[to][1]) for price, letter, to in moves]
            here[state] = min(options)
        best = here
    return best[""]


def brute(rows):
    damaged, convs = damage(rows)
    out = []
    for conv in convs:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(initials, faults)
        lines, state, left = [], "", iter(own)
        for letter in audit:
            if letter == "I":
                lines.append(("user" if state in ("", "s", "a") else "assistant") + ":")
            else:
                row = next(left)
                if letter == "D":
                    continue
                lines.append((row[2] if letter == "K" else "user" if state in ("", "s", "a") else "assistant") + ":" + row[3])
            state = lines[-1][:1]
        assert PATTERN.fullmatch("".join(x[:1] for x in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def made(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "unknown"]
    texts = ["Yes.", "No", " ", "", None, "Why?  \n", "x", "été!", "Yes.\x0b", ".", "a "]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            t = rng.choice([turn, turn, turn, turn + 2, None, 0, -3])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, t, role, rng.choice(texts) if rng.random() < 0.5 else f"text {conv} {turn}."))
    return rows


COLUMNS = [f.split()[0] for f in repair.RESULT.split(", ")]


def check(spark, rows, parts=3):
    df = with_clashes(spark.createDataFrame(rows, DDL), skip=("text",)).repartition(parts)
    df = df.withColumns({c: df["text"] for c in CLASHES})
    assert tuples(repair.damage_and_repair(df), *COLUMNS) == brute(rows)


def test_odd_conversations(spark):
    rows = made(1, 150, 9)
    rows += [(None, 0, "user", "a."), (None, None, "assistant", "b."), (None, 1, "user", "a.")]
    rows += [(900, i, None, None) for i in range(4)] + [(901, None, "user", "same.")] * 5 + [(902, 3, "user", "same.")] * 5
    rows += [(903, 10**12, "user", "x" * 300_000 + "."), (903, -5, "assistant", "y. " * 5000)]
    rows += [(904 + i, 7, "system", "only.") for i in range(60)]  # some lose their only row
    rows += rows[:40]
    check(spark, rows)


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_long_conversations_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    rows = made(2, 12, 60) + [(77, i, ("user", "assistant", "assistant")[i % 3], f"t{i % 40}" + ".!"[: i % 3]) for i in range(700)]
    rows += [(78, None, "user", "same.")] * 300 + [(79, i % 2, "user", f"{i}.") for i in range(300)]
    check(spark, rows)


def test_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_BYTES", 200)
    check(spark, made(3, 40, 12))


def test_empty(spark):
    assert tuples(repair.damage_and_repair(spark.createDataFrame([], DDL))) == []


def test_whole_table(spark):
    rows = rows_of("conversations", "conv_id, turn, role, text")
    assert tuples(queries.op13_conversation_repair(spark, SF), *COLUMNS) == brute(rows)


def test_audits_of_all_short_patterns():
    """Every sequence of up to four rows of every initial and fault, solved together."""
    kinds = [(c, f) for c in range(4) for f in (repair.FINE, repair.BLANK, repair.TRUNCATED)]
    cases = [case for n in range(4) for case in itertools.product(kinds, repeat=n)]
    cls = np.array([c for case in cases for c, _ in case])
    fault = np.array([f for case in cases for _, f in case])
    sizes = np.array([len(case) for case in cases])
    start = np.full((len(cases), 1), repair.START)
    cost, audit, state = repair.audits(cls, fault, sizes, np.tile(repair.AT_END, (len(cases), 1)), start)
    names = {repair.FINE: "", repair.BLANK: "blank", repair.TRUNCATED: "truncated"}
    for i, case in enumerate(cases):
        expected = cheapest(["sua."[c] for c, _ in case], [names[f] for _, f in case])
        assert (int(cost[i, repair.START]), audit[i][0] + repair.TAIL[state[i, 0]]) == expected


def test_ranks_order_nodes_by_whole_audits():
    rng = np.random.default_rng(4)
    sizes = np.array([9, 0, 4, 17])
    n = int(sizes.sum())
    cls, fault = rng.integers(0, 4, n), rng.integers(0, 4, n)
    cost = repair.cost_to_go(cls, fault, sizes, np.tile(repair.AT_END, (4, 1)))
    place, optimal, end = repair.optimal_arcs(cls, fault, sizes, cost)
    letter, first = repair.least_arcs(optimal, end, np.zeros(cost.size, np.int64))
    rank = repair.ranks(place, letter, first, cost.size)
    row_of = {p: i for i, p in enumerate(place.tolist())}

    def audit(node):
        out = ""
        while node // 4 in row_of:
            i = row_of[node // 4]
            out += repair.LETTERS[letter[i, node % 4]]
            node = int(first[i, node % 4])
        return out

    audits = [audit(node) for node in range(cost.size)]
    assert all((audits[a] < audits[b]) == (rank[a] < rank[b]) for a in range(cost.size) for b in range(cost.size))
