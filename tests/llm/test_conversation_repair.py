import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from sparkloom.llm import conversation_repair as r

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        conv = out.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        if k:
            conv += [(turn, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        full = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)
        out.append("blank" if not full else "duplicate" if (role, text) in seen else "" if full[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows, bad):
    """All edits with at most two insertions in a place, by trying them: least (cost, audit) and its lines."""
    best = None
    chosen = ["user", "assistant"]
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(e != "D" and b in ("blank", "duplicate") for e, b in zip(edits, bad)):
            continue
        for ins in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * k + e for k, e in zip(ins, [*edits, ""]))
            cost = 5 * sum(ins) + sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and b == "truncated") for e, b in zip(edits, bad))
            if best and (cost, audit) >= best[:2]:
                continue
            slots = [x for k, e, row in zip(ins, [*edits, ""], [*rows, None]) for x in [("I", None)] * k + ([(e, row)] if e and e != "D" else [])]
            for roles in itertools.product(chosen, repeat=sum(e != "K" for e, _ in slots)):
                pick = iter(roles)
                lines = [(row[1] if e == "K" else next(pick), row[2] if row else "") for e, row in slots]
                if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in lines)):
                    best = (cost, audit, "\n".join(f"{a}:{b}" for a, b in lines))
    return best


def by_rows(rows, bad):
    """The same without a limit on length: costs and whole audits from the last row up, states relaxed until nothing changes."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {"u": "user", "a": "assistant"}
    later = {0: (0, "", ()), 3: (0, "", ())}
    for k in range(len(rows), -1, -1):
        now = {}
        for q in range(4):
            ways = [later[q]] if k == len(rows) and q in later else []
            if k < len(rows):
                _, role, text = rows[k]
                ways.append((2 + later[q][0], "D" + later[q][1], later[q][2]))
                if bad[k] in ("", "truncated"):
                    add = 5 * (bad[k] == "truncated")
                    for c, to in step[q].items():
                        if c in name:
                            ways.append((1 + add + later[to][0], "R" + later[to][1], ((name[c], text), later[to][2])))
                        if role[:1] == c:
                            ways.append((add + later[to][0], "K" + later[to][1], ((role, text), later[to][2])))
            if ways:
                now[q] = min(ways, key=lambda x: x[:2])
        changed = True
        while changed:
            changed = False
            for q in range(4):
                for c, to in step[q].items():
                    if c in name and to in now and (q not in now or (5 + now[to][0], "I" + now[to][1]) < now[q][:2]):
                        now[q], changed = (5 + now[to][0], "I" + now[to][1], ((name[c], ""), now[to][2])), True
        later = now
    cost, audit, lines = later[0]
    out = []
    while lines:
        out.append(":".join(lines[0]))
        lines = lines[1]
    return cost, audit, "\n".join(out)


def want(rows, solve=by_rows):
    out = {}
    for c, own in damage(rows).items():
        bad, turns = faults(own), [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, text = solve(own, bad)
        out[c] = (c, gaps, *(bad.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randrange(1, longest + 1)):
            turn = rng.choice([k, k, k, k, k * 2, None])
            rows.append((c, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "Why?", "cut off", "É. ", " \t", "", None, "Well.\n", f"own {k}."])))
    rng.shuffle(rows)
    return rows


def test_every_edit():
    """The search finds what trying all edits finds."""
    for own in damage(conversations(1, 120, 3)).values():
        if len(own) <= 3:
            bad = faults(own)
            assert by_rows(own, bad) == (every_repair(own, bad) or (0, "", ""))


@pytest.mark.parametrize("seed", [2, 3])
def test_query(spark, seed, monkeypatch):
    monkeypatch.setattr(r, "BLOCK", 7)  # blocks of a conversation meet
    rows = conversations(seed, 150, 9)
    rows += [(500, k, "user" if k % 2 else "assistant", f"t{k % 40}" + "." * (k % 3)) for k in range(700)]
    rows += [(501, 0, "user", "x" * 500_000 + ".")] + [(None, k, "user", "nobody's.") for k in range(4)] + [(c, k, "user", "y.") for c in range(600, 640) for k in range(1)]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], SCHEMA + ", n string")
    got = r.structure_repair(frame).collect()
    assert len(got) == len({x[0] for x in rows}) and {x.conv_id: tuple(x) for x in got} == want(rows)
    assert any(not x.audit for x in got)
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame([x for x in rows if x[0] != 500], SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert {x[0]: x for x in con.execute(r.SQL).fetchall()} == want([x for x in rows if x[0] != 500])


def test_empty(spark):
    got = r.structure_repair(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
