import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from loomveil.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, chunk string"
FORM = re.compile("(s?(ua)+)?")


def brute_edits(codes):
    """(cost, audit) by trying all edits, fewest first: states are kept by position and row kinds put out."""
    @lru_cache(None)
    def from_(i, state):
        """All (cost, audit) that are not plainly worse, from row i on."""
        out = {}
        if i == len(codes) and state in ("-", "a"):
            out[""] = 0

        def put(cost, edit, rest):
            for audit, more in rest.items():
                key = edit + audit
                out[key] = min(out.get(key, 1e9), cost + more)

        nexts = {"-": "u", "s": "u", "u": "a", "a": "u"}
        if i < len(codes):
            c = codes[i]
            put(2, "D", from_(i + 1, state))
            if c != "d":
                extra = 5 if c.isupper() else 0
                kind = c.lower()
                if kind == nexts[state] or (kind == "s" and state == "-"):
                    put(extra, "K", from_(i + 1, kind))
                put(1 + extra, "R", from_(i + 1, nexts[state]))
        if depth[0] < 3:
            depth[0] += 1
            put(5, "I", from_.__wrapped__(i, nexts[state]))
            depth[0] -= 1
        low = min(out.values(), default=0)
        return {a: c for a, c in out.items() if c <= low + 12}

    depth = [0]
    found = from_(0, "-")
    return min((c, a) for a, c in found.items())


def reference(rows, every):
    out = {}
    for conv in every:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        faults, seen, codes = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, _, role, text in own:
            rest = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes.append("d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
        cost, audit = brute_edits("".join(codes))
        state, lines, queue = "-", [], list(own)
        for edit in audit:
            role, text = queue.pop(0)[2:] if edit != "I" else ("", "")
            if edit == "D":
                continue
            kind = role[:1] if edit == "K" else "a" if state == "u" else "u"
            lines.append(f"{role if edit == 'K' else repair.ROLES[kind]}:{text}")
            state = kind
        assert FORM.fullmatch("".join(line[0] for line in lines))
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        spoken = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{spoken(conv)}:{spoken(turn)}".encode()) % 20, spoken(role), spoken(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def conversations(seed, n):
    rnd, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rnd.randint(1, 7)):
            role = rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            rows.append((conv, rnd.choice([turn, turn, None, turn + 2]), role, rnd.choice(["A b.", "c", "", " \n", None, f"Hi {turn}!", "Hi there?\n", "é."]), "x"))
    return rows


def test_cheapest_against_all_edits():
    rnd = random.Random(5)
    for _ in range(150):
        codes = "".join(rnd.choice("suaxSUAXd") for _ in range(rnd.randint(0, 7)))
        assert repair.cheapest(codes, "-", "-a") == brute_edits(codes), codes


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_give_what_the_whole_gives(block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    rnd = random.Random(block)
    for _ in range(200):
        codes = "".join(rnd.choice("suaxSUAd") for _ in range(rnd.randint(0, 24)))
        solver = repair.Solver()
        sure = "".join(solver.add(c) for c in codes)
        cost, rest = solver.end()
        assert (cost, sure + rest) == repair.cheapest(codes, "-", "-a"), codes


def test_report_against_brute_force(spark):
    rows = conversations(1, 60) + [(None, 0, "user", "Hi.", "x"), (None, None, "assistant", "Yes.", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(repair.damage(df), df).collect()}
    assert got == reference(damaged(rows), {r[0] for r in rows})
    assert repair.repair_report(repair.damage(df.limit(0)), df.limit(0)).count() == 0


def test_long_conversations_and_rows(spark):
    rows = [(7, i, ["user", "assistant"][i % 2], f"Turn {i}.", "x") for i in range(900)]
    rows[500:500] = rows[499:500] * 3
    rows[700] = (7, rows[700][1], "user", "x" * 500_000, "x")
    df = spark.createDataFrame(rows, SCHEMA)
    got = repair.repair_report(df).collect()[0]
    codes = []
    seen = set()
    for r in rows:
        codes.append("d" if r[2:4] in seen else r[2][0] if r[3][-1] == "." else r[2][0].upper())
        seen.add(r[2:4])
    assert (got.cost, got.audit) == repair.cheapest("".join(codes), "-", "-a")
    assert got.duplicate == 3 and got.truncated == 1 and got.gaps == 0
    out = sorted(repair.repair(df).collect(), key=lambda r: r.position)
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in out).encode()).hexdigest() == got.repaired_sha256
    assert FORM.fullmatch("".join(r.role[0] for r in out))
