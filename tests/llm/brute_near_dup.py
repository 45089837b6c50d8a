"""All pairs of a small table, for tests."""
import re


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    """``{doc_id: (n_shingles, component)}`` of ``(doc_id, text)`` rows."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    byitem = {}
    for i, s in sets.items():
        for x in s:
            byitem.setdefault(x, []).append(i)
    seen = set()
    for group in byitem.values():
        for n, a in enumerate(group):
            for b in group[n + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}
