"""Conversation repair row by row: a shortest path over whole audits, with a heap."""

import hashlib
import heapq
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """(blank, duplicate, truncated, cost, audit, hash) of one conversation's rows (turn, role, text) in order."""
    faults, seen = "", set()
    for _, role, text in rows:
        words = WORD.findall(text)
        faults += "b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "-"
        seen.add((role, text))
    done, heap = set(), [(0, "", 0, "", ())]
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            lines = "\n".join(f"{role}:{text}" for role, text in out)
            return faults.count("b"), faults.count("d"), faults.count("t"), cost, audit, hashlib.sha256(lines.encode()).hexdigest()
        nxt = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[nxt]
        heapq.heappush(heap, (cost + 3, audit + "I", i, nxt, (*out, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] in "t-":
                more = cost + 3 * (faults[i] == "t")
                heapq.heappush(heap, (more + 3, audit + "R", i + 1, nxt, (*out, (name, text))))
                if role[:1] == nxt:
                    heapq.heappush(heap, (more, audit + "K", i + 1, nxt, (*out, (role, text))))
                if not state and role[:1] == "s":
                    heapq.heappush(heap, (more, audit + "K", i + 1, "s", (*out, (role, text))))


def report(rows, damaged=True):
    by = {row[0]: [] for row in rows}
    for conv, turn, role, text in damage(rows) if damaged else rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        known = [x[0] for x in turns if x[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        blank, duplicate, truncated, cost, audit, digest = repair(turns)
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return out
