import random
import re
from collections import Counter

import numpy as np
from odd_rows import documents, nothing

from quillcell.llm.divergence import SIDE, Tree, divergences, walk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    docs, counts, sources = Counter(), Counter(), {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        sources.setdefault(lang, set()).add(source)
        docs.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
    out = []
    for lang, names in sources.items():
        kept = [t for (one, t), d in docs.items() if one == lang and d >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        of = {s: {t: counts[lang, s, t] for t in kept} for s in names}
        p = {s: share(of[s]) for s in names}
        q = share({t: sum(of[s][t] for s in names) for t in kept})
        for s in names:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", own, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def _rows(sources, seed=2):
    draw = random.Random(seed)
    rows = []
    for i in range(400):
        lang = draw.choice(["en", "fr", None, "none"])
        source = draw.choice([None, *(f"s{k}" for k in range(sources))])
        words = [draw.choice(["the", "The", "été", "日本", "x", f"w{draw.choice('abcdefgh')}{draw.choice('abcdefgh')}", f"{source}only".replace("1", "q")])
                 for _ in range(draw.randint(0, 12) if lang != "none" else 0)]
        rows.append((lang, source, draw.choice([" ", "-", "7"]).join(words) or None))
    return rows


def test_matches_brute_force(spark):
    for sources, least, top in ((5, 5, 3), (90, 2, 50)):  # within one block of rows, and over two
        rows = _rows(sources)
        docs = spark.createDataFrame(rows, "lang string, source string, text string")
        assert found(divergences(docs, least, top)) == brute(rows, least, top)


def test_joint_walk_reads_only_columns_that_are_not_zero_in_both():
    draw = np.random.default_rng(4)
    def square(share):
        dense = np.where(draw.random((SIDE, SIDE)) < share, draw.integers(10, 1000, (SIDE, SIDE)), 0)
        row, col = np.nonzero(dense)
        return dense, Tree(row, col, dense[row, col])

    for shares in ((0.02, 0.3), (0.0, 0.1), (1.0, 0.0), (0.0, 0.0)):
        (a, ta), (b, tb) = square(shares[0]), square(shares[1])
        zero_a, zero_b = draw.integers(1, 9, SIDE), draw.integers(1, 9, SIDE)
        i, j = (x.ravel() for x in np.indices((SIDE, SIDE)))
        total, width = walk(ta, tb, i, j, zero_a, zero_b)
        used = (a[i] > 0) | (b[j] > 0)
        mine, other = np.where(a > 0, a, zero_a[:, None])[i], np.where(b > 0, b, zero_b[:, None])[j]
        assert (width == used.sum(axis=1)).all() and (total == np.where(used, np.abs(mine - other), 0).sum(axis=1)).all()


def test_odd_rows(spark):
    docs = documents(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert found(divergences(docs, 1, 50)) == brute(rows, 1, 50)
    assert found(divergences(docs)) == brute(rows, 30, 50)
    assert divergences(nothing(spark)).count() == 0
