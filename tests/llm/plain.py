"""Plain versions of op11, op12 and op13, one row after the other."""

import hashlib
import math
import re
import zlib
from collections import Counter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BLANK = " \t\n\x0b\x0c\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def search(docs, items, best=10):
    """(item, rank, doc, score) of ``docs`` and ``items``, lists of (id, text)."""
    terms = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    sizes = [c.total() for _, c in terms]
    many, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(low(text)))
        weight = {w: math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) for w in asked}
        scored = []
        for (d, c), n in zip(terms, sizes, strict=True):
            m = 25 + (75 * n * many) // total if n else 0
            score = sum(k * weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, k in asked.items() if w in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


def leaks(text, items, window=10):
    """(words, hit words, items) of a text."""
    sets = {}
    for name, said in items:
        w = TERM.findall(low(said))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            sets.setdefault(tuple(w[k : k + window]), set()).add("" if name is None else str(name))
    words = TERM.findall(low(text))
    hit, found = [False] * len(words), set()
    for n in {len(x) for x in sets}:
        for k in range(len(words) - n + 1):
            if names := sets.get(tuple(words[k : k + n])):
                found |= names
                hit[k : k + n] = [True] * n
    return words, hit, sorted(found)


def damaged(rows):
    """Rows (conversation, turn, role, text) after the query's damage, as conversation: [(turn, role, text)]."""
    out = {}
    blank = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = blank(role), blank(text)
        draw = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        kept += [(turn, role, text)] * (2 if draw == 3 else 1)
    return out


def repaired(rows):
    """The contract's columns but conv_id for a conversation's rows in order, by trying all edits row by row."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(BLANK)
        faults.append("b" if not said else "d" if (role, text) in seen else "" if said[-1] in ".!?" else "t")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def put(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    ways = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for state, (cost, audit, turns) in list(ways.items()):
                for x in after[state].keys() & name:
                    put(ways, after[state][x], (cost + 5, audit + "I", (*turns, f"{name[x]}:")))
        if i < len(rows):
            (_, role, text), fault, to = rows[i], faults[i], {}
            for state, (cost, audit, turns) in ways.items():
                put(to, state, (cost + 2, audit + "D", turns))
                if fault not in ("b", "d"):
                    more = 5 if fault == "t" else 0
                    if role[:1] in after[state]:
                        put(to, after[state][role[:1]], (cost + more, audit + "K", (*turns, f"{role}:{text}")))
                    for x in after[state].keys() & name:
                        put(to, after[state][x], (cost + more + 1, audit + "R", (*turns, f"{name[x]}:{text}")))
            ways = to
    cost, audit, turns = min(ways[s] for s in ("", "a") if s in ways)
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(x) for x in "bdt"), illegal, cost, audit, sha("\n".join(turns)))
