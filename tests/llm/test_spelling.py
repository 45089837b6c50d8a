import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from odd_rows import documents, nothing

from quillcell.llm import spelling
from quillcell.llm.spelling import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = None if i is None else crc32(f"{i}:{run}".encode())
            if h is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    out, form = set(), {}
    for w, n in words.items():
        near = [v for v in words if apart(v, w)]
        best = min(near, key=lambda v: (-words[v], v)) if near else None
        form[w] = (best if best and words[best] >= 10 * n else None, len(near))
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.add((w, f, root, n, form[w][1], words[f] if f else None))
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def _rows(seed=5):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abéÿ") for _ in range(draw.randint(6, 10))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab"]
    rows = []
    for i in range(150):
        text = []
        for _ in range(draw.randint(0, 40)):
            w = draw.choice(stems[: draw.choice([3, len(stems)])])
            if draw.random() < 0.2:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abcÀ") + w[at:], w[:at] + draw.choice("abcÀ") + w[at + 1 :]])
            text.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i, draw.choice([" ", "-", "1", "Ā"]).join(text)))
    return rows + rows[:3] + [(None, rows[0][1]), (200, None), (201, ""), (202, "qqqqqqqx " * 3 + "qqqqqqqy " * 40 + "qqqqqqyy " * 500)]


def test_matches_brute_force(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert any(r[1] and r[1] != r[2] for r in want), "some chain of forms has two steps"
    for block in (2048, 7):  # groups as one tile, and cut into pairs of blocks
        monkeypatch.setattr(spelling, "BLOCK", block)
        assert found(variants(docs)) == want


def test_dense_tiles_find_single_edits():
    draw = random.Random(1)
    for longest in (7, 8, 11):
        words = sorted({"".join(draw.choice("ab") for _ in range(draw.choice([longest, longest - 1]))) for _ in range(200)})
        import pyarrow as pa

        m = spelling.matrices(pa.array(words), longest)
        pairs = [spelling.near(m, m, longest, tail) for tail in (False, True)]
        got = Counter((words[i], words[j]) for p in pairs for i, j in zip(*map(np.ndarray.tolist, p)) if i != j)
        want = {(a, b) for a in words for b in words if apart(a, b) and max(len(a), len(b)) == longest}
        assert set(got) == want and set(got.values()) <= {1}


def test_odd_rows(spark):
    docs = documents(spark, [(11, "Straßenbahn " * 40 + "strassenbahn Strasenbahn strasenbahn", None, None, None, None, None, None, None)])
    assert found(variants(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert variants(nothing(spark)).count() == 0
