"""Personal data in texts, by weak supervision; DataFrame functions only.

Strict patterns give the base spans, which always stay. Looser patterns propose more spans
of the same kinds. Labelers vote on every span: the strict pattern with its checks, a
gazetteer (domain endings, card prefixes, calling codes, address ranges), the words before
the span, its shape, and signs of something else (quoted keys, longer numbers). Votes are
yes, no or abstain.

Expectation-maximisation estimates how reliable each labeler is from the counts of vote
patterns, at most ``4 * 3**5`` rows, and gives each pattern a probability. A logistic
classifier of span features is then trained on these probabilities, again from counts per
feature combination, of which there are a fixed number. Spans that it accepts are added.

Text is scanned once; positions are code points, the end exclusive. They come from the
lengths of the matches and of the pieces between them. The patterns are possessive and begin
at run starts only, so they neither recurse nor rescan on long runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: ``\\G`` lets a match begin inside a run whose first part the match before has taken.
STRICT = {
    "email": (("@",), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ((), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ((), r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (("+",), r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": (("(at)", "[at]", "(AT)", "[AT]"), rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{{1,63}}){{1,8}}"),
    "ip": ((":",), r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": ((), r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])"),
    "phone": ((), r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
ENDINGS = ("com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at")
CALLING = ("+1", "+33", "+34", "+39", "+44", "+49")
BEFORE = {
    "email": "(?i)mail|contact|write to|kontakt|correo|courriel",
    "ip": "(?i)\\bip\\b|host|server|addr|login|from",
    "card": "(?i)card|visa|master|credit|pay|konto|tarjeta|carte",
    "phone": "(?i)phone|tel|call|fax|mobile|ruf|tél",
}
AGAINST = "(?i)(token|key|secret|hash|sha|id|isbn|version|order|ref)[\\x20]*[:=#]?[\\x20]*[\"']?$"


def _matches(text: Column, rule: tuple[tuple[str, ...], str]) -> Column:
    """All matches, without scanning texts that lack what every match holds: one of the signs, or a digit."""
    signs, pattern = rule
    guard = F.col("_digit")
    if signs:
        guard = text.contains(signs[0])
        for sign in signs[1:]:
            guard = guard | text.contains(sign)
    return F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _starts(text: Column, found: Column, rule: tuple[tuple[str, ...], str]) -> Column:
    """Where each match begins, from the pieces between matches; scanned only if there are any."""
    gaps = F.when(F.size(found) > 0, F.transform(F.split(text, rule[1], -1), F.length)).otherwise(F.array().cast("array<int>"))
    return F.struct(found.alias("m"), gaps.alias("g"))


def _place(pair: Column) -> Column:
    """``array<struct<s, m>>`` of the matches, zipped so that no start is computed twice."""
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        start = acc["pos"] + F.get(pair["g"], i)
        return F.struct((start + F.length(F.get(pair["m"], i))).alias("pos"), F.concat(acc["out"], F.array(start)).alias("out"))

    at = F.when(F.size(pair["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(pair["m"]) - 1), zero, step, lambda a: a["out"])).otherwise(
        F.array().cast("array<int>"))
    return F.arrays_zip(at.alias("s"), pair["m"].alias("m"))


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """The checks that a strict match must pass."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, "\\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        size = F.length(_digits(m))
        return F.when((size >= 16) & (size <= 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        size = F.length(_digits(m))
        return (size >= 8) & (size <= 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, F.lit(1))
    return (v.when(no, F.lit(-1)) if no is not None else v).otherwise(F.lit(0)).cast("byte")


def _judged(kind: str, text: Column, span: Column, strict: bool) -> Column:
    """The span with its votes ``v`` and features ``f``; both arrays of small numbers."""
    m, s = span["m"], span["s"]
    e = s + F.length(m)
    left = F.substring(text, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24)))
    after = F.substring(text, e + 1, F.lit(1))
    digits = _digits(m)
    if kind == "email":
        ending = F.lower(F.substring_index(m, ".", -1))
        gazetteer = _vote(ending.isin(*ENDINGS), ~ending.isin(*ENDINGS))
        shape = _vote(m.rlike("[A-Za-z]"), F.length(m) > 120)
    elif kind == "ip":
        head = F.regexp_extract(m, "^0*([0-9]{1,3})\\.", 1)
        odd = head.isin("", "0", "10", "127") | (F.length(m) > 39)
        gazetteer = _vote(~odd, odd)
        shape = _vote(F.length(m) >= 10, ~m.rlike("[0-9]{2}"))
    elif kind == "card":
        gazetteer = _vote(F.substring(digits, 1, 1).isin("3", "4", "5", "6"), F.substring(digits, 1, 1).isin("0", "1", "7", "8", "9"))
        shape = _vote(m.rlike("^[0-9]{16}$") | m.rlike("^[0-9]{4}([ .-])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$"), F.length(digits) < 15)
    else:
        prefix = F.lit(False)
        for c in CALLING:
            prefix = prefix | m.startswith(c)
        gazetteer = _vote(prefix)
        shape = _vote(m.rlike("[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), ~m.rlike("[ .-]"))
    other = after.rlike("[0-9A-Za-z_]") | left.rlike(AGAINST)
    pattern = F.lit(1 if strict else -1).cast("byte")
    votes = F.array(pattern, gazetteer, _vote(left.rlike(BEFORE[kind])), shape, _vote(F.lit(False), other))
    size = F.least(F.floor(F.length(digits) / 4), F.lit(5)).cast("byte")
    parts = F.least(F.size(F.split(m, "[ ().-]+")), F.lit(5)).cast("byte")
    begins = F.when(F.substring(m, 1, 1).rlike("[0-9]"), F.lit(0)).when(F.substring(m, 1, 1).rlike("[A-Za-z]"), F.lit(1)).otherwise(F.lit(2))
    edge = F.when(s == 0, F.lit(0)).when(left.rlike("\\s$"), F.lit(1)).otherwise(F.lit(2))
    features = F.array(F.lit(KINDS.index(kind)).cast("byte"), size, parts, begins.cast("byte"), edge.cast("byte"),
                       F.lit(int(strict)).cast("byte"))
    return F.struct(F.lit(KINDS.index(kind)).cast("byte").alias("k"), s.alias("s"), e.alias("e"), F.lit(strict).alias("base"),
                    votes.alias("v"), features.alias("f"))


def candidates(docs: DataFrame) -> DataFrame:
    """``row, spans``: the struct of all columns of ``docs`` and its spans with votes and features."""
    t = F.col("_text")
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    found = found.withColumn("_digit", t.rlike("[0-9]"))
    found = found.select("row", "_text", *(_matches(t, STRICT[k]).alias(f"m_{k}") for k in KINDS), *(_matches(t, LOOSE[k]).alias(f"l_{k}") for k in KINDS))
    found = found.select(
        "row", "_text", *(_starts(t, F.col(f"m_{k}"), STRICT[k]).alias(f"m_{k}") for k in KINDS),
        *(_starts(t, F.col(f"l_{k}"), LOOSE[k]).alias(f"l_{k}") for k in KINDS))
    found = found.select("row", "_text", *(_place(F.col(f"m_{k}")).alias(f"m_{k}") for k in KINDS), *(_place(F.col(f"l_{k}")).alias(f"l_{k}") for k in KINDS))
    checked = lambda k: lambda x: valid(k, x["m"])
    # a looser span may touch no strict one of any kind
    apart = lambda x: ~F.exists("_strict", lambda y: (x["s"] < y["s"] + F.length(y["m"])) & (y["s"] < x["s"] + F.length(x["m"])))
    judge = lambda k, strict: lambda x: _judged(k, t, x, strict)
    found = found.select("row", "_text", *(F.filter(f"m_{k}", checked(k)).alias(f"m_{k}") for k in KINDS), *(f"l_{k}" for k in KINDS))
    found = found.withColumn("_strict", F.concat(*(F.col(f"m_{k}") for k in KINDS)))
    judged = [F.transform(f"m_{k}", judge(k, True)) for k in KINDS]
    judged += [F.transform(F.filter(f"l_{k}", apart), judge(k, False)) for k in KINDS]
    return found.select("row", F.concat(*judged).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, tuple[int, ...]], float]:
    """Probability of each ``(kind, votes)`` by expectation-maximisation over counts.

    Per kind: a share of true spans, and for each labeler the chance of each vote on true
    and on false spans. The first guess is the majority vote.
    """
    out: dict[tuple[int, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        rows = sorted((v, n) for k, v, n in patterns if k == kind)
        belief = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows]
        for _ in range(rounds):
            true = sum(b * n for b, (_, n) in zip(belief, rows))
            total = sum(n for _, n in rows)
            prior = (true + 1) / (total + 2)
            chance = []
            for j in range(len(rows[0][0])):
                per = {}
                for vote in (-1, 0, 1):
                    t = sum(b * n for b, (v, n) in zip(belief, rows) if v[j] == vote)
                    f = sum((1 - b) * n for b, (v, n) in zip(belief, rows) if v[j] == vote)
                    per[vote] = ((t + 1 + (vote > 0)) / (true + 4), (f + 1 + (vote < 0)) / (total - true + 4))
                chance.append(per)
            new = []
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j][x][0] / chance[j][x][1]) for j, x in enumerate(v))
                new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            moved = max(abs(a - b) for a, b in zip(belief, new))
            belief = new
            if moved < 1e-9:
                break
        out.update({(kind, v): b for b, (v, _) in zip(belief, rows)})
    return out


def classifier(rows: list[tuple[tuple[int, ...], float, int]], rounds: int = 300, rate: float = 1.0) -> dict[tuple[int, int, int], float]:
    """Weights ``(kind, feature, value)`` of a logistic model, from soft labels summed per combination."""
    weights: dict[tuple[int, int, int], float] = {}
    for kind in sorted({f[0] for f, _, _ in rows}):
        here = sorted((f, y, n) for f, y, n in rows if f[0] == kind)
        total = sum(n for _, _, n in here)
        names = sorted({(kind, j, x) for f, _, _ in here for j, x in enumerate(f)})
        w = dict.fromkeys(names, 0.0)
        for _ in range(rounds):
            slope = dict.fromkeys(names, 0.0)
            for f, y, n in here:
                score = sum(w[kind, j, x] for j, x in enumerate(f))
                off = n / (1 + math.exp(-max(-30.0, min(30.0, score)))) - y
                for j, x in enumerate(f):
                    slope[kind, j, x] += off
            for name in names:
                w[name] -= rate * (slope[name] / total + 1e-4 * w[name])
        weights.update(w)
    return weights


def personal_data(docs: DataFrame) -> DataFrame:
    """``row, spans``: every row's struct and its spans ``k, s, e, base``, by kind and start.

    ``k`` indexes :data:`KINDS`. A null or empty text has no span. Nulls elsewhere, repeated
    rows and further columns pass through. No rows, no result.
    """
    table = cut_lineage(candidates(docs))
    each = table.select(F.explode("spans").alias("x")).groupBy("x.k", "x.v", "x.f").agg(F.count("*").alias("n"))
    counts: dict[tuple[int, tuple[int, ...]], int] = {}
    combos: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
    for r in each.collect():  # at most 4 * 3**5 patterns times 864 feature combinations
        v, f = tuple(r.v), tuple(r.f)
        counts[r.k, v] = counts.get((r.k, v), 0) + r.n
        combos[f, v] = combos.get((f, v), 0) + r.n
    belief = reliabilities([(k, v, n) for (k, v), n in counts.items()])
    soft: dict[tuple[int, ...], tuple[float, int]] = {}
    for (f, v), n in sorted(combos.items()):
        y, m = soft.get(f, (0.0, 0))
        soft[f] = (y + n * belief[f[0], v], m + n)
    weights = classifier([(f, y, n) for f, (y, n) in soft.items()])
    accepted = sorted(f for f in soft if sum(weights[f[0], j, x] for j, x in enumerate(f)) > 0)
    allowed = F.array(*(F.lit(",".join(map(str, f))) for f in accepted)) if accepted else F.array().cast("array<string>")
    chosen = F.filter("spans", lambda x: x["base"] | F.array_contains(allowed, F.array_join(x["f"].cast("array<string>"), ",")))
    slim = F.transform(chosen, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base")))
    return table.select("row", F.sort_array(slim).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(
        F.get(name, x["k"].cast("int")), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``.

    Where spans overlap, the one that begins first stands for both.
    """
    mark = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, x["s"] - acc["pos"]), F.get(mark, x["k"].cast("int")))
        free = x["s"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(free, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_start, zero, step)
    found = personal_data(docs).withColumn("_done", F.when(F.size("spans") > 0, done))
    rest = F.substring(text, F.col("_done.pos") + 1, F.length(text))
    new = F.when(F.size("spans") > 0, F.concat(F.col("_done.out"), rest)).otherwise(F.col("row.text"))
    return found.select(*((new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
