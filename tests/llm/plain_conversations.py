"""Repair of one conversation by trying all edits of every row, without prices."""

import hashlib
import zlib

NEXT_ROLE = {"": "user", "s": "user", "u": "assistant", "a": "user"}
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv, turn, role, text) with the contract's damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = text.translate(dict.fromkeys(map(ord, ".!?")))
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "fine" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def may_follow(before, initial):
    """Whether `(s?(ua)+)?` can go on with this initial after one."""
    return (before, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def best(rows, kinds):
    """(cost, audit, lines), least first; from the back, over the initial that stands before."""
    ways = {"": (0, "", ()), "a": (0, "", ())}

    def with_insertions(ways):
        while True:
            more = dict(ways)
            for before, role in NEXT_ROLE.items():
                if role[0] in ways:
                    cost, audit, lines = ways[role[0]]
                    way = (cost + 5, "I" + audit, (f"{role}:", *lines))
                    more[before] = min(way, more.get(before, way))
            if more == ways:
                return ways
            ways = more

    ways = with_insertions(ways)
    for (_, _, role, text), kind in reversed(list(zip(rows, kinds))):
        new = {}
        more = 5 if kind == "truncated" else 0
        for before in NEXT_ROLE:
            found = []
            if before in ways:
                cost, audit, lines = ways[before]
                found.append((cost + 2, "D" + audit, lines))
            if kind in ("fine", "truncated"):
                if role[:1] in ways and may_follow(before, role[:1]):
                    cost, audit, lines = ways[role[:1]]
                    found.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                given = NEXT_ROLE[before]
                if given[0] in ways:
                    cost, audit, lines = ways[given[0]]
                    found.append((cost + more + 1, "R" + audit, (f"{given}:{text}", *lines)))
            if found:
                new[before] = min(found)
        ways = with_insertions(new)
    return ways[""]


def results(rows, every):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)}"""
    by = {conv: [] for conv in every}
    for row in in_order(rows):
        by.setdefault(row[0], []).append(row)
    out = {}
    for conv, own in by.items():
        kinds = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = zip(own, own[1:])
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, lines = best(own, kinds)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = (kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out
