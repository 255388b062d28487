"""Brute-force forms that several tests share."""

import re


def word_sets(rows, words):
    out = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def near_duplicates(rows, words, percent):
    """(doc_id, n_shingles, component_id, kept) by holding all pairs that share a shingle against each other."""
    sets = word_sets(rows, words)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for own in by.values():
        for x in range(len(own)):
            for y in range(x):
                a, b = own[x], own[y]
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        up[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), low.get(find(i)), doc == low.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)
