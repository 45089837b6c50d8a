"""Personal data and URL filter next to plain Python."""
import hashlib
import random
import re

from odd_rows import documents, nothing
from pyspark.sql import functions as F

from quillcell.llm.catalog import RULES, op4_weak_supervision
from quillcell.llm.pii import classifier, listed, personal_data, redacted, reliabilities
from quillcell.llm.url_filter import Boost, address, boosted, judged, margin

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_weak_supervision(spark, sf).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_odd_texts(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab.@-+ ()0123456789%_é\n:") for _ in range(draw.randint(0, 60))) for _ in range(400)]
    texts += ["a" * 40000 + "@b." + "c" * 20000 + ".d", "1" * 2000, "1 " * 2000 + "4242424242424242", "1.2." * 2000, "a.b@" * 2000, "a@b.co " * 1000,
              None, "", "😀 a@b.co 4242 4242 4242 4242", "a@b.c_d@e.f", "joe (at) foo (dot) org tel 555-123-4567"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data(docs).select("row.doc_id", listed(F.filter("spans", lambda x: x["base"])).alias("b")).collect():
        assert r.b == base(texts[r.doc_id])
    docs = documents(spark)
    out = redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[3] is None and by[2] == "" and "a@b.co" not in by[5] and "<EMAIL>" in by[5] and "<PHONE>" in by[10] and "<IP>" in by[10]
    assert personal_data(nothing(spark)).count() == 0


def test_reliabilities_find_the_good_labelers():
    # the first and the third labeler agree, the second is often wrong
    counts = {(1, 1, 1): 400, (1, 1, -1): 100, (-1, -1, -1): 400, (-1, -1, 1): 100, (1, -1, 1): 50, (-1, 1, -1): 50}
    belief = reliabilities([(0, v, n) for v, n in counts.items()])
    assert belief[0, (1, -1, 1)] > 0.5 > belief[0, (-1, 1, -1)]
    w = classifier([((0, 1), 90.0, 100), ((0, 2), 10.0, 100)])
    assert w[0, 0, 0] + w[0, 1, 1] > 0 > w[0, 0, 0] + w[0, 1, 2]


URLS = ["http://a.ORG/x", "http://example.org/es/1", "http://www.example.org/es", "https://example.org/en/12?a=b", "http://x.com/fr/9", "http://com/fr/",
        "http://y.com/de/4", "http://y.net/de/4", "nothing", "", None, "a://b://c/d", "http://notexample.org", "http://org?x", "ftp://u.com#/de/", "http://É.com/de/",
        "http://" + "a" * 5000 + ".net/" + "b/" * 3000]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y", 1)],
                                  "page_id long, url string, rule string, _host string, f int")
    got = judged(pages, RULES, Boost(trees=2)).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
        assert verdict or (r.verdict == "block") == (r.score > 0.5)
    assert judged(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in judged(pages, ()).collect()} == {"allow"}
    h, p = address(F.lit("X://A.b/c?d"))
    assert tuple(spark.range(1).select(h, p).first()) == ("a.b", "/c")


def test_boosting_like_brute_force(spark):
    """Two trees of depth two next to a plain search over all splits."""
    draw = random.Random(5)
    rows = [([draw.randint(0, 5) for _ in range(3)],) for _ in range(200)]
    rows = [(int(f[0] > 2 and f[1] < 3 or draw.random() < 0.1), f) for (f,) in rows]
    how = Boost(trees=2, depth=2)
    trees, start = boosted(spark.createDataFrame(rows, "y int, f array<int>"), how)
    import math

    y, x = [r[0] for r in rows], [r[1] for r in rows]
    score = [math.log((sum(y) + 1) / (len(y) - sum(y) + 1))] * len(y)
    assert start == score[0]

    def grow(idx, g, h, depth):
        total, weight = sum(g[i] for i in idx), sum(h[i] for i in idx)
        worth = lambda a, b: a * a / (b + how.ridge)
        best, gain = None, 1e-6
        for f in range(3):
            for cut in sorted({x[i][f] for i in idx})[:-1]:
                left = [i for i in idx if x[i][f] <= cut]
                a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                won = worth(a, b) + worth(total - a, weight - b) - worth(total, weight)
                if won > gain + 1e-9:
                    best, gain = (f, cut), won
        if best is None or depth == how.depth:
            for i in idx:
                score[i] -= how.rate * total / (weight + how.ridge)
            return
        grow([i for i in idx if x[i][best[0]] <= best[1]], g, h, depth + 1)
        grow([i for i in idx if x[i][best[0]] > best[1]], g, h, depth + 1)

    for _ in range(2):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grow(range(len(y)), [round((a - b) * 1e6) / 1e6 for a, b in zip(p, y)], [round(a * (1 - a) * 1e6) / 1e6 for a in p], 0)
    got = [r.m for r in spark.createDataFrame([(i, f) for i, f in enumerate(x)], "i int, f array<int>").select("i", margin(trees, start, F.col("f")).alias("m")).orderBy("i").collect()]
    assert max(abs(a - b) for a, b in zip(got, score)) < 1e-6
