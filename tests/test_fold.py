import itertools
import random
from datetime import date

from ledgerloom.operators import overlap

ROWS = "source string, id string, row_idx int, date date, direction string, amount long, document string, format string, original_description string"
EMPTY = set(overlap.EMPTY_WORDS)


def words(t):
    return [w for w in t.split(" ") if len(w) > 2 and w not in EMPTY]


def evidence(a, b):
    if a["document"] and a["document"] == b["document"]:
        return 2
    x, y = words(a["text"]), words(b["text"])
    common = set(x) & set(y)
    if a["text"] == b["text"] or x and y and len(common) >= 2 and len(common) / min(len(set(x)), len(set(y))) >= 0.75:
        return 1
    return int(bool(x and y) and min(len(a["text"]), len(b["text"])) >= 12 and (a["text"] in b["text"] or b["text"] in a["text"]))


def folded(rows):
    """Source after source, every row compared with every row of its key before it."""
    out = []
    key = lambda r: (r["date"], r["direction"], r["amount"])
    for source, group in itertools.groupby(sorted(rows, key=lambda r: (r["source"], r["row_idx"])), key=lambda r: r["source"]):
        group, before = list(group), list(out)
        of = lambda rows, k: [r for r in rows if key(r) == k]
        keys = list(dict.fromkeys(key(r) for r in group))
        crossing = lambda r, c: not r["formats"] <= c["formats"]
        anchors = sum(len(of(group, k)) == 1 == len(of(before, k)) and crossing(of(group, k)[0], of(before, k)[0]) for k in keys)
        met = []
        for k in keys:
            new, known = of(group, k), of(before, k)
            if len(new) == 1 == len(known) and (crossing(new[0], known[0]) or evidence(known[0], new[0])):
                met.append((new[0], known[0]))
                continue
            best = {}
            for i, r in enumerate(new):
                scores = [evidence(c, r) for c in known]
                top = [j for j, s in enumerate(scores) if s and s == max(scores)]
                if len(top) == 1:
                    best[i] = top[0]
            sure = [(i, j) for i, j in best.items() if list(best.values()).count(j) == 1]
            met += [(new[i], known[j]) for i, j in sure]
            if anchors >= 0.9 * len(group) and any(crossing(r, c) for r in new for c in known) and len(new) == len(known):
                left = [i for i in range(len(new)) if i not in dict(sure)]
                rest = [j for j in range(len(known)) if j not in dict(sure).values()]
                met += [(new[i], known[j]) for i, j in zip(left, rest, strict=True)]
        for r, c in met:
            c["ids"] |= {source}
            c["formats"] |= r["formats"]
            weight = lambda t: len(words(t)) * 100 + len(t.strip())
            c["text"] = r["text"] if weight(r["text"]) > weight(c["text"]) else c["text"]
        taken = [id(r) for r, _ in met]
        out += [r for r in group if id(r) not in taken]
    return sorted((r["source"], r["row_idx"], r["text"], sorted(r["ids"]), sorted(r["formats"])) for r in out)


def test_fold_equals_source_after_source(spark):
    texts = ("padaria central", "padaria central sul", "mercado", "farmacia popular ltda", "posto")
    for seed, dense in ((2, 9),):
        draw = random.Random(seed)
        rows, plain = [], []
        for source in "abcd":
            days = draw.sample(range(1, 5), 3)
            kind = draw.choice(("CSV", "OFX"))
            for n in range(12):
                # Within a key of a source texts differ, as do documents: what ties is left apart by both, by other means.
                row = (source, f"{source}{n}", n, date(2026, 1, draw.choice(days)), "DEBIT", draw.randrange(dense), draw.choice(("", "", f"d{draw.randrange(60)}")), kind, draw.choice(texts))
                if any(r[0] == source and r[3:6] == row[3:6] and (r[8].split()[0] == row[8].split()[0] or r[6] and r[6] == row[6]) for r in rows):
                    continue
                rows.append(row)
                plain.append({"source": source, "row_idx": n, "date": row[3], "direction": "DEBIT", "amount": row[5], "document": row[6], "text": row[8], "formats": {kind}, "ids": {source}})
        got = sorted((r.source, r.row_idx, r.original_description, r.source_ids, r.formats) for r in overlap.fold(spark.createDataFrame(rows, ROWS)).collect())
        assert got == folded(plain), seed


def test_rounds_follow_overlapping_sources(spark):
    from ledgerloom.plans.shared import Scratch

    day = lambda n: date(2026, 1, n)
    rows = [("a", day(1)), ("b", day(1)), ("b", day(2)), ("c", day(2)), ("d", day(9)), ("e", day(1))]
    keys = spark.createDataFrame([(s, d, "DEBIT", 1) for s, d in rows], "source string, date date, direction string, amount long")
    assert sorted(map(tuple, overlap._levels(keys, Scratch(spark)).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", 2)]
    assert overlap.fold(spark.createDataFrame([], ROWS)).count() == 0
