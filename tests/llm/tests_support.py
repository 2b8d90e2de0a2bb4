"""Brute-force helpers of the pipeline's tests."""

import re


def brute_groups(rows, like):
    """Groups of ids that link by shingles of ``like.words`` words, by comparing all pairs."""
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        n = like.words
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {i: i for i in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and like.den * len(sets[a] & sets[b]) >= like.num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())
