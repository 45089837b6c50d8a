import random

from brute_near_dup import brute
from odd_rows import documents, nothing

from quillcell.llm.near_dup import NearDup, near_duplicates, without_copies


def _texts(seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(4))
    rows, base = [], [word() for _ in range(120)]
    for _ in range(60):  # a chain and a star of near copies
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
        if draw.random() < 0.3:
            base = copy
    rows += [" ".join(word() for _ in range(draw.randint(0, 30))) for _ in range(40)] + rows[:20]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_matches_all_pairs(spark):
    rows = _texts()
    for how in (NearDup(shingle=3, percent=85), NearDup()):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()}
        assert got == brute(rows, how.shingle, how.percent)


def test_odd_rows(spark):
    docs = documents(spark)
    got = near_duplicates(docs, NearDup(shingle=3, percent=85)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == 0 and not by[1].kept and by[6].component_id == 5
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[4].component_id == 4
    assert by[None].component_id is None and by[None].kept and [r.kept for r in got if r.doc_id == 7] == [True, True]
    kept = without_copies(docs, NearDup(shingle=3, percent=85))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 2, 3, 4, 5, 7, 7, 8, 9, 10]
    assert near_duplicates(nothing(spark)).count() == 0
