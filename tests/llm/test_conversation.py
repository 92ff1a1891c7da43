"""Conversation repair against brute force: all repairs of short conversations, shortest paths for long ones, pieces, ties, nulls."""

import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from simplexspark.llm import conversation
from simplexspark.llm.conversation import DELETE, INSERT, REROLE, TRUNCATED, joined_items, piece_items, repair, repair_conversations
from simplexspark.llm.queries import op11_conversations

SHAPE = re.compile("(s?(ua)+)?")


def tried(faults, initials):
    """Cost and audit of the best repair among all of them with up to len + 2 inserted turns."""
    n, best = len(faults), None
    for inserts in product(range(3), repeat=n + 1):
        if sum(inserts) > 3:
            continue
        for edits in product("KRD", repeat=n):
            if any(f in "bd" and e != "D" or c not in "sua" and e == "K" for f, c, e in zip(faults, initials, edits)):
                continue
            audit, cost, kept = "I" * inserts[0], INSERT * sum(inserts), ["?"] * inserts[0]
            for f, c, e, more in zip(faults, initials, edits, inserts[1:]):
                audit += e + "I" * more
                cost += {"K": 0, "R": REROLE, "D": DELETE}[e] + TRUNCATED * (f == "t" and e != "D")
                kept += ([c] if e == "K" else ["?"] if e == "R" else []) + ["?"] * more
            shape = "s" * (len(kept) % 2) + "ua" * (len(kept) // 2)
            if all(k == s or k == "?" and s in "ua" for k, s in zip(kept, shape)) and SHAPE.fullmatch(shape):
                best = min(best or (cost, audit), (cost, audit))
    return best


def walked(faults, initials):
    """The same for any length, from the end on: best (cost, audit) of what is left in each state."""
    ends = {"": (0, ""), "a": (0, "")}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {q: ends.get(q, (1 << 40, "")) for q in ("", "s", "u", "a")}

    def inserted(table):
        for _ in range(4):
            for q in table:
                r = "a" if q == "u" else "u"
                table[q] = min(table[q], (table[r][0] + INSERT, "I" + table[r][1]))
        return table
    best = inserted(best)
    for f, c in zip(reversed(faults), reversed(initials)):
        now = {}
        for q in best:
            options = [(best[q][0] + DELETE, "D" + best[q][1])]
            if f not in "bd":
                more, r = TRUNCATED * (f == "t"), "a" if q == "u" else "u"
                options.append((best[r][0] + REROLE + more, "R" + best[r][1]))
                if (q, c) in step:
                    options.append((best[step[q, c]][0] + more, "K" + best[step[q, c]][1]))
            now[q] = min(options)
        best = inserted(now)
    return best[""]


def test_all_short_repairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(0, 5))
        faults, initials = "".join(rng.choice(list("---bdt"), n)), list(rng.choice(["s", "u", "a", "", "x"], n, p=[.2, .3, .3, .1, .1]))
        assert repair(faults, initials) == tried(faults, initials) == walked(faults, initials)


def test_pieces_give_the_whole():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        faults, initials = "".join(rng.choice(list("----bdt"), n)), list(rng.choice(["s", "u", "a", "x"], n))
        cuts = [0, *sorted(rng.integers(0, n + 1, 3).tolist()), n]
        items = joined_items([piece_items(faults[a:b], initials[a:b]) for a, b in zip(cuts, cuts[1:])])
        assert min(items[p, q] for p, q in items if p == 0 and q in (0, 3)) == repair(faults, initials) == walked(faults, initials)


def expected(rows):
    """Report and repaired turns of one conversation after damage, from (turn, role, text) in order."""
    seen, faults = set(), ""
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults += "b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t"
        if body:
            seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = walked(faults, initials)
    turns = [t for t, _, _ in rows if t is not None]
    left, at, odd = [], 0, (len(audit) - audit.count("D")) % 2
    for e in audit:
        role = "user" if (len(left) - odd) % 2 == 0 else "assistant"
        if e == "I":
            left.append((role, ""))
        else:
            _, own, text = rows[at]
            at += 1
            if e != "D":
                left.append((own if e == "K" else role, text))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        say = lambda v: " " if v is None else str(v)
        role, text, h = say(role), say(text), zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        if h:
            mine += [(turn, "user" if h == 4 else role, text)] * (1 + (h == 3))
    return {c: sorted(r, key=lambda t: (t[0] is not None, t[0] or 0)) for c, r in out.items()}


@pytest.mark.parametrize("limit", [512, 3])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(conversation, "PIECE_ROWS", limit)
    monkeypatch.setattr(conversation, "FAN", 4)
    rng = np.random.default_rng(5)
    texts = ["Yes.", "No!", "Why? ", "it stops", "", " \n", None, "Yes.", "x" * 3000 + "."]
    rows = []
    for conv in [*range(120), None]:
        n = 400 if conv == 7 else int(rng.integers(1, 9))
        for turn in rng.permutation(n * 2)[:n].tolist() + ([None] if conv == 9 else []):
            rows.append((conv, turn, str(rng.choice(["user", "assistant", "system", "tool", ""], p=[.4, .4, .1, .05, .05])) if rng.random() > .03 else None,
                         (texts[rng.integers(0, len(texts))] if rng.random() < .4 else f"Turn {conv} {turn}.")))
    rows += [(500, turn, "user", "Yes.") for turn in (2**62, -(2**62) - 2)] + [(501, None, "user", "a.")]
    d = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    d.repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversations(spark, f"file://{tmp_path}").collect()}
    want = {c: expected(r) for c, r in damaged(rows).items()}
    assert got == {c: (min(w[0], 2**63 - 1), *w[1:]) for c, w in want.items()}


def test_operator_edge_cases(spark):
    d = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 1, "user", "Hi."), (None, None, None, None), ("b", 0, "system", "s.")] + [("same", 1, "user", "Hi.")] * 3000, "id string, t int, r string, x string")
    out = repair_conversations(d, "id", "t", "r", "x").collect()
    first = {r.conv_id: r for r in out if r.piece == 0}
    assert {c: r.audit for c, r in first.items()} == {"a": "KDI", None: "D", "b": "D", "same": "K" + "D" * 2999 + "I"}
    assert first["same"].duplicate == 2999 and first["b"].cost == 4
    turns = [t for r in sorted((r for r in out if r.conv_id == "same"), key=lambda r: r.piece) for t in r.turns]
    assert len(turns) == 3001 and [(t.role, t.text) for t in turns if t.edit != "D"] == [("user", "Hi."), ("assistant", "")]
    assert repair_conversations(d.limit(0), "id", "t", "r", "x").count() == 0
