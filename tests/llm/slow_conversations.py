"""Conversation repair by plain dynamic programming over (cost, audit) pairs, one conversation at a time."""

import hashlib
import re
import zlib
from collections import defaultdict

STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    for r in rows:
        plain = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{plain(r.conv_id)}:{plain(r.turn)}".encode()) % 20
        role, text = plain(r.role), plain(r.text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        yield from [(r.conv_id, r.turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def repaired(turns):
    """(cost, audit, lines) of turns (role, text, delete, truncated)."""

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit, lines) in list(best.items()):
                for r, to in STEP[q].items():
                    if r != "s":
                        new = (cost + 5, audit + "I", lines + (f"{NAME[r]}:",))
                        if to not in best or new < best[to]:
                            best[to] = new
        return best

    best = inserted({0: (0, "", ())})
    for role, text, delete, truncated in turns:
        new = {}

        def put(q, value):
            if q not in new or value < new[q]:  # noqa: B023
                new[q] = value  # noqa: B023

        for q, (cost, audit, lines) in best.items():
            put(q, (cost + 2, audit + "D", lines))
            if not delete:
                extra = 5 if truncated else 0
                if role[:1] in STEP[q]:
                    put(STEP[q][role[0]], (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
                for r, to in STEP[q].items():
                    if r != "s":
                        put(to, (cost + extra + 1, audit + "R", lines + (f"{NAME[r]}:{text}",)))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def results(rows):
    groups = {r.conv_id: [] for r in rows}
    for c, *rest in damage(rows):
        groups[c].append(tuple(rest))
    for c, g in groups.items():
        g.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).digest()))
        turns = [t for t, _, _ in g if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        blank = dup = cut = 0
        seen, faults = set(), []
        for _, role, text in g:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            kind = "blank" if not shown else "dup" if (role, text) in seen else "cut" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, dup, cut = blank + (kind == "blank"), dup + (kind == "dup"), cut + (kind == "cut")
            faults.append((role, text, kind in ("blank", "dup"), kind == "cut"))
        initials = [role[:1] for _, role, _ in g]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = repaired(faults)
        yield c, gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
