import hashlib
import itertools
import random
import re
import zlib

from fillsight.llm import conversation as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying all edits of every row and up to two inserts in every gap."""
    marks, best = faults(rows), None
    inserts = [i for k in range(3) for i in itertools.product(("user", "assistant"), repeat=k)]
    for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
        if any(m in ("blank", "duplicate") and e != "D" for m, e in zip(marks, edits)):
            continue
        base = sum({"K": 0, "D": 2}.get(e, 1) + (5 if e != "D" and m == "truncated" else 0) for m, e in zip(marks, edits))
        names = [r[1] if e == "K" else {"Ru": "user", "Ra": "assistant", "D": None}[e] for r, e in zip(rows, edits)]
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, lines, initials = "", [], ""
            for i, gap in enumerate(gaps):
                audit += "I" * len(gap)
                lines += [f"{g}:" for g in gap]
                initials += "".join(g[0] for g in gap)
                if i < len(rows):
                    audit += edits[i][0]
                    if names[i] is not None:
                        lines.append(f"{names[i]}:{rows[i][2]}")
                        initials += names[i][:1] or "?"
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def linear(rows):
    """Cost, audit and lines by whole strings per state, no pruning: for longer conversations."""
    names, follows = {2: "user", 3: "assistant"}, {0: 2, 1: 2, 2: 3, 3: 2}
    alive = {0: (0, "", [])}

    def widen(states):
        for _ in range(3):
            for s, (c, a, lines) in list(states.items()):
                t = follows[s]
                way = (c + 5, a + "I", [*lines, f"{names[t]}:"])
                if t not in states or way[:2] < states[t][:2]:
                    states[t] = way
        return states

    for (_, role, text), mark in zip(rows, faults(rows)):
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for s, (c, a, lines) in widen(alive).items():
            offer(s, (c + 2, a + "D", lines))
            if mark in ("blank", "duplicate"):
                continue
            extra = 5 if mark == "truncated" else 0
            to = {"s": 1, "u": 2, "a": 3}.get(role[:1])
            if to == follows[s] or (s == 0 and to == 1):
                offer(to, (c + extra, a + "K", [*lines, f"{role}:{text}"]))
            offer(follows[s], (c + 1 + extra, a + "R", [*lines, f"{names[follows[s]]}:{text}"]))
        alive = new
    return min(way for s, way in widen(alive).items() if s in (0, 3))


def expected(rows, solve):
    out = {}
    for conv, kept in damage(rows).items():
        marks = faults(kept)
        turns = [t for t, *_ in kept if t is not None]
        cost, audit, lines = solve(kept)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(frame):
    found = C.repair(C.damaged(frame)).collect()
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: tuple(r[1:]) for r in found}


def random_rows(rng, conversations, most):
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?", "a b", "End. \t", "x"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ursula"]
    rows = []
    for conv in range(conversations):
        rows += [(conv, rng.choice([t, t, t + 3, None]), rng.choice(roles), rng.choice([*texts, f"t{t}.", f"t{t}.", None]))
                 for t in range(rng.randrange(most + 1))]
    return rows


def test_short_conversations_match_all_edits(spark):
    rows = random_rows(random.Random(5), 250, 3)
    want = expected(rows, cheapest)
    assert len(want) > 150 and want == expected(rows, linear)
    assert report(spark.createDataFrame(rows, SCHEMA)) == want


def test_long_conversations_match_whole_strings(spark):
    rng = random.Random(11)
    rows = random_rows(rng, 40, 150)
    rows += [(1_000, t, "user", f"only users {t}.") for t in range(500)]  # two phases stay alive to the end
    rows += [(1_001, t, "user" if t % 2 else "assistant", f"turn {t}." if t > 200 else "") for t in range(600)]
    rows += [(1_002, t, "tool", f"{t}") for t in range(300)]
    rows += [(1_003, 7, "user", "The same row.")] * 900
    assert report(spark.createDataFrame(rows, SCHEMA)) == expected(rows, linear)


def test_edges(spark):
    dropped = next(t for t in range(1_000) if zlib.crc32(f"77:{t}".encode()) % 20 == 0)
    kept = next(t for t in range(1_000) if zlib.crc32(f"78:{t}".encode()) % 20 == 7)
    rows = [
        (77, dropped, "user", "gone"), (78, kept, "user", "x" * 300_000 + "."), (None, None, None, None), (None, 3, "user", "Hi."),
        (79, None, "system", "S."), (79, None, "user", "Q?"), (80, 1, "", ""), (81, -5, "user", "ä"), (81, 9, "assistant", " ."),
    ]
    frame = spark.createDataFrame([(*r, 1, "x", "y", True) for r in rows], SCHEMA + ", cost int, audit string, copies string, seen boolean")
    want = expected(rows, linear)
    assert report(frame) == want
    assert want[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair(C.damaged(frame.limit(0))).collect() == []


def test_messages_have_the_digest_of_the_report(spark):
    rows = random_rows(random.Random(3), 120, 12)
    damaged = C.damaged(spark.createDataFrame(rows, SCHEMA))
    reports = C.repair(damaged)
    lines = {}
    for r in sorted(C.messages(damaged, reports).collect(), key=lambda r: (r.conv_id, r.position)):
        kept = lines.setdefault(r.conv_id, [])
        assert r.position == len(kept)
        kept.append(f"{r.role}:{r.text}")
    for r in reports.collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_resolved_edits_leave_memory():
    repair, most = C.Repair(), 0
    for t in range(20_000):
        repair.row("user" if t % 2 == 0 else "assistant", f"turn {t}.", t % 50 == 3, t % 70 == 9)
        nodes, todo = set(), [x[2] for x in repair.alive.values()]
        if t % 500 == 0:
            while todo:
                node = todo.pop()
                while node is not None and id(node) not in nodes:
                    nodes.add(id(node))
                    node = node.parent
            most = max(most, len(nodes))
    assert most < 1_000
    assert len(repair.close()[1]) >= 20_000


def test_no_rest_costs_more_than_the_pruning_allows():
    """AHEAD against the cheapest rests of random conversations from every state."""
    rng = random.Random(9)
    for _ in range(300):
        rows = [(rng.choice("sua?"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(7))]
        rest = {0: 0, 1: 10, 2: 5, 3: 0}
        for initial, must_go, cut in reversed(rows):
            rest = {s: min(w[1] + rest[w[0]] for w in C.STEPS[s, initial if initial != "?" else "", must_go, cut and not must_go]) for s in range(4)}
        for y, bounds in C.AHEAD.items():
            for x, most in bounds.items():
                assert rest[y] <= rest[x] + most
