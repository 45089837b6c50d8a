import random
from collections import Counter

from odd_rows import documents, nothing

from quillcell.llm import line_dedup
from quillcell.llm.line_dedup import WHITE, without_repeated_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, documents=2):
    holders = {}
    key = lambda line: line.strip(WHITE).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    last = float("inf")
    first = {k: min(v, key=lambda i: last if i is None else i) for k, v in holders.items() if len(k) >= least and len(v) >= documents}
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        stay = [x for x in every if first.get(key(x), i) == i]
        out.append((i, "\n".join(stay), len(every), len(every) - len(stay)))
    return Counter(out)


def found(df):
    return Counter((r.row.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in df.collect())


def _rows():
    draw = random.Random(3)
    pool = ["Common line ÄÖ of all", "  common line ÄÖ of ALL\t", "common line äö of all", "nine char", "ten  chars", "", " \r", "\x0bten  chars\x0c", "a\rb but ten"]
    rows = [(i, "\n".join(draw.choice(pool + [f"line only in {i}", f"line of pair {i // 2}"]) for _ in range(draw.randint(0, 9)))) for i in range(80)]
    return rows + rows[:3] + [(5, "Common line ÄÖ of all\nanother text of five"), (None, "ten  chars\nno id here at all"), (None, "no id here at all"), (-4, None), (81, "x\n" * 400 + "TEN  CHARS")]


def test_matches_brute_force(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1000, 1):  # with and without keys that are broadcast
        monkeypatch.setattr(line_dedup, "HOT_PARTS", parts)
        assert found(without_repeated_lines(docs)) == brute(rows)
    assert found(without_repeated_lines(docs, 3, 4)) == brute(rows, 3, 4)


def test_odd_rows(spark):
    docs = documents(spark)
    out = without_repeated_lines(docs)
    assert out.columns == ["row", "kept_text", "n_lines", "n_dropped"] and out.schema["row"].dataType.names == docs.columns
    assert found(out) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert without_repeated_lines(nothing(spark)).count() == 0
