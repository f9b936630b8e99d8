"""The contracts again, plainly, over rows in memory."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_copies(rows):
    """doc_id, size of the set, least doc_id reached, and other rows linked with."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, holders = [0] * len(sets), defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders[g].append(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        if 100 * len(a & b) >= 75 * len(a | b):
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    low = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)].append(d)
    return sorted((str(d), len(s), str(min(low[find(i)], default=None)), links[i]) for i, (d, s) in enumerate(sets))


def repeats(rows, length=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, 1 << 62), 1 << 62 if d is None else d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (1 << 62 if d is None else d):
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rules(text):
    w = words(text)
    text = text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    rep = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def license_sentences(text, known):
    """Identifiers of known sentences in a text: from one possible end of a sentence to another, the longest first, left to right."""
    def plain(x):
        return " ".join(re.sub(r"[^\w.+]|_", " ", x.lower()).split())

    of = {}
    for i, s in known.items():
        of.setdefault(plain(s).strip(" ."), i)
    of.pop("", None)
    out = []
    for part in re.split(r"\n\s*\n|;", text or ""):
        part = re.sub(r"(SPDX-License-Identifier:[^\n]{1,40})\n", "\\1\x01\n", part)
        pieces = [plain(x) for x in re.split(r"\x01\n|(?<=[.!?:])[ \t\r]*\n|\n(?=[A-Z][a-z])|(?<=[.!?])[ \t]+(?=[A-Z])", part)]
        pieces = [x for x in pieces if x]
        at = 0
        while at < len(pieces):
            ends = [j for j in range(len(pieces), at, -1) if " ".join(pieces[at:j]).strip(" .") in of]
            if ends:
                out.append(of[" ".join(pieces[at : ends[0]]).strip(" .")])
            at = ends[0] if ends else at + 1
    return out


def licenses(found, rules, hides):
    out = []
    for name, ids in rules:
        it = iter(found)
        if all(i in it for i in ids) and name not in out:
            out.append(name)
    for name, hidden in hides.items():
        if name in out:
            out = [x for x in out if x not in hidden]
    return out
