import hashlib
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import pii, queries, vector_codes
from ledgerloom.llm.hard_negatives import hard_negatives

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, label int, embedding array<float>, place int, score string"


def vectors(n, seed, values=(-0.5, -0.25, 0.0, 0.25, 0.3), dims=6):
    """Few values, so that scores and distances tie often."""
    draw = random.Random(seed)
    rows = [(i, draw.choice((0, 0, 0, 1, 2)), [draw.choice(values) for _ in range(dims)], 1, "x") for i in range(n)]
    odd = [(5000, None, [0.1] * dims, 1, "x"), (5050, 1, None, 1, "x"), (5100, 1, [None] * dims, 1, "x"), (5150, 1, [float("nan")] * dims, 1, "x"), (5200, 0, [float("-inf")] * dims, 1, "x"), (None, 1, [0.3] * dims, 1, "x"), (3, 1, [0.3] * dims, 1, "x"), (3, 1, [0.3] * dims, 1, "x"), (10, 2, [0.25] * (dims - 3), None, None)]
    return rows + odd


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def mined_plainly(rows, every, positives, negatives, low, high):
    kept = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v, *_ in rows if label is not None and usable(v)]
    out = []
    for a, al, av in kept:
        if a is None or a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v, strict=False)), b is None, b or 0, b, bl) for b, bl, v in kept if b != a)
        for s, _, _, p, _ in [x for x in scored if x[4] == al][:positives]:
            fit = [x for x in scored if x[4] != al and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, p, r + 1, x[3], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"row_block": 16, "anchor_block": 3, "chunk": 2}])
def test_hard_negatives_against_plain_search(spark, sizes):
    rows = vectors(130, 4)
    df = spark.createDataFrame(rows, VECTORS)
    for args in ((5, 3, 2, 50, 95), (7, 2, 4, -200, 100)):
        got = sorted(map(tuple, hard_negatives(df, *args, **sizes).collect()), key=str)
        want = mined_plainly(rows, *args)
        assert want and got == want


def test_copies_of_blocks_are_never_gathered_in_the_driver(spark, monkeypatch):
    from ledgerloom.llm import hard_negatives as module

    plans, keep = [], module.Scratch.keep
    monkeypatch.setattr(module.Scratch, "keep", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(self, df))
    module.hard_negatives(spark.createDataFrame(vectors(60, 3), VECTORS), 5)
    joins = [line for plan in plans for line in plan.splitlines() if re.search(r"Join \[i#\d+L, j#\d+L, chunk#", line)]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)


def test_hard_negatives_odd_cases(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives(empty).count() == 0
    alone = spark.createDataFrame([(50, 1, [1.0], 0, "x"), (51, 1, [2.0], 0, "x"), (52, 2, [], 0, "x")], VECTORS)
    assert hard_negatives(alone).count() == 0  # no row of another label within the window
    assert hard_negatives(alone.filter("vec_id > 50")).count() == 0  # no anchor


def coded_plainly(rows, parts, entries, rounds):
    kept = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, label, v, *_ in rows if usable(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(order[0][2])
    w = -(-d // parts)
    cut = lambda v: [(v + [0] * (parts * w - d))[p * w : (p + 1) * w] for p in range(parts)]
    fit = [r for r in order if len(r[2]) == d]
    books = [[cut(r[2])[p] for r in fit[:entries]] for p in range(parts)]
    nearest = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for r in fit:
                x = cut(r[2])[p]
                held[nearest(x, p)[1]].append(x)
            books[p] = [[sum(c) // len(h) for c in zip(*h, strict=True)] if h else e for h, e in zip(held, books[p], strict=True)]
    out, sums = [], {}
    for i, label, v in kept:
        each = [nearest(x, p) for p, x in enumerate(cut(v))] if len(v) == d else None
        error = sum(e for e, _ in each) if each else None
        out.append((i, label, "".join(f"{n:02x}" for _, n in each) if each else None, error))
        sums[label] = sums.get(label, 0) + (error or 0)
    flat = [str(c) for p in range(parts) for e in books[p] for c in e[: max(0, min(w, d - p * w))]]
    return sorted(((i, c, e, sums[label]) for i, label, c, e in out), key=str), hashlib.sha256(",".join(flat).encode()).hexdigest()


@pytest.mark.parametrize(("parts", "entries", "rounds", "dims"), [(3, 8, 2, 6), (4, 5, 6, 6), (2, 64, 0, 5)])
def test_codes_against_plain_rounds(spark, parts, entries, rounds, dims):
    rows = vectors(150, 9, values=(-0.5, -0.25, 0.0, 0.25, 0.3, 0.9, 1.5), dims=dims)
    got = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS), parts, entries, rounds).collect()
    want, sha = coded_plainly(rows, parts, entries, rounds)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == want and {r.codebooks_sha256 for r in got} == {sha}


def test_bounds_spare_comparisons(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(8, 4)) * 4
    rows = [(i, 0, [float(x) for x in centres[i % 8] + draw.normal(size=4) * 0.05], 1, "x") for i in range(400)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS), 1, 8, 2).collect()
    assert sum(r.scanned for r in got) < 40  # of 400 parts, in the last assignment
    assert len({r.code for r in got}) == 8


def test_codes_odd_cases(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.vector_codes(empty).count() == 0
    few = spark.createDataFrame([(2, None, [0.1, 0.2], 0, "x"), (1, None, [0.1, 0.2], 0, "x"), (9, 4, None, 0, "x")], VECTORS)
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.vector_codes(few).orderBy("vec_id").collect()] == [(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_plainly(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m.group() if c in "0123456789"]
            ok = kind == "email"
            ok |= kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
            ok |= kind == "card" and 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0
            ok |= kind == "phone" and 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), n, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_base_spans_of_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base_plainly(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(f"{k}:") for w in want) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",")) | {""}


def test_base_spans_of_random_texts():
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choice("a@.-+ 0123(1)25%é") for _ in range(draw.randint(0, 60)))
        text += draw.choice(("", " 4111 1111 1111 1111", " 4785-3805-9239-1139 1", "+1 (743) 555-38245", "300.1.1.1.1.1.1.1"))
        got = [f"{k}:{s}:{e}" for s, e, k, ok in sorted(pii.found(text), key=lambda c: (c[0], pii.KINDS.index(c[2]))) if ok]
        assert got == base_plainly(text)


TAUGHT = [
    "please write to mail: john.smith [at] example [dot] com or contact peter (at) mail.example.org today", "call our phone (743) 555-3824 or mobile 212-555-0199 for help", "the account iban DE89 3704 0044 0532 0130 00 at the bank",
    "her ssn 123-45-6780 on the identity card", "My name is Anna Keller and I live here", "address 221 Baker Street London", "reach me at x.y@mail3.example.com or 152.143.123.131 from the server",
]
OTHERS = ["version 12 345 6789 of the build", "order #555-123-9999 total", "see section 123 456 7890 of the page", "part no 100-200-3000 price", "plain words without anything at all", "token = 1eb9c654e721b4f812088970e66a6345cee33dd6"]


def test_labelers_and_added_spans(spark):
    rows = [(i, (TAUGHT + OTHERS)[i % 13]) for i in range(260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = {}
    for r in pii.personal_data(docs).filter("doc_id < 13").collect():
        text = rows[r.doc_id][1]
        added[r.doc_id] = {(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k not in pii.BASE}
    assert added[1] == {("local_phone", "(743) 555-3824"), ("local_phone", "212-555-0199")} and added[2] == {("iban", "DE89 3704 0044 0532 0130 00")}
    assert added[0] == {("written_email", "john.smith [at] example [dot] com"), ("written_email", "peter (at) mail.example.org")}
    assert not any(added[i] for i in range(6, 13))


def test_reliabilities_from_votes():
    """A labeler that contradicts the others on most candidates is found out."""
    draw, patterns = random.Random(3), {}
    for _ in range(4000):
        truth = draw.random() < 0.5
        vote = [0] * pii.LABELERS
        for j in range(3):
            vote[j] = (1 if truth else -1) * (1 if draw.random() < 0.9 else -1)
        vote[3] = 1 if draw.random() < 0.5 else 0  # says the same of both
        patterns[tuple(vote)] = patterns.get(tuple(vote), 0) + 1
    fitted = pii.Labelers([("person", v, n) for v, n in sorted(patterns.items())])
    assert all(fitted.rates[j, 0, 2] > 0.8 and fitted.rates[j, 1, 0] > 0.8 for j in range(3)) and abs(fitted.rates[3, 0, 2] - fitted.rates[3, 1, 2]) < 0.1
    assert fitted.posterior("person", (1, 1, 1, 0, 0, 0, 0)) > 0.9 > 0.1 > fitted.posterior("person", (-1, -1, -1, 1, 0, 0, 0))


def test_pii_odd_cases(spark):
    schema = "doc_id long, text string, id string, votes int, spans string"
    rows = [(1, None, "a", 1, "x"), (2, "", "a", 1, "x"), (None, "a.b@c.de", "a", 1, "x"), (3, "a.b@c.de", "a", 1, "x"), (3, "a.b@c.de", "a", 1, "x"), (4, "9" * 200000, "a", 1, "x"), (5, "a" * 200000 + "@", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.n_email, r.spans) for r in pii.personal_data(docs).collect()), key=str)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (None, 1, "email:0:8"), (3, 1, "email:0:8"), (3, 1, "email:0:8"), (4, 0, ""), (5, 0, "")], key=str)
    assert pii.personal_data(docs.limit(0)).count() == 0
    hidden = {r.doc_id: r.text for r in pii.redact(docs).filter("doc_id < 4").collect()}
    assert hidden == {1: None, 2: "", 3: "[email]"} and pii.redact(docs).columns == docs.columns


def test_words_that_polynomial_hashes_confuse(spark):
    from ledgerloom.llm.common import WordHasher
    from ledgerloom.llm.near_dedup import near_duplicates

    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in near_duplicates(docs).orderBy("doc_id").collect()] == [(1, 1), (2, 2), (3, 1)]
    draw = random.Random(2)
    words = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 90))) for _ in range(20000)}
    raw = np.frombuffer(" ".join(sorted(words)).encode(), np.uint8)
    for seed in (0, 1000):
        hashes, at = WordHasher(seed).words(raw, np.array([0, len(raw)]))
        assert len(np.unique(hashes)) == len(hashes) == len(words) and at.tolist() == [0, len(words)]
    text = b"Ab abcdefgh abcdefghi  X\tx"
    hashes, _ = WordHasher().words(np.frombuffer(text, np.uint8), np.array([0, 2, 2, len(text)]))
    again, _ = WordHasher().words(np.frombuffer(b"aB", np.uint8), np.array([0, 2]))
    assert hashes[0] == again[0] and hashes[-1] == hashes[-2] and len(np.unique(hashes)) == 4


def test_path_ratios_against_plain_loops():
    """Means per path, smoothing by distance, fusion and threshold, node by node, over the nodes of whole pages."""
    import duckdb

    from ledgerloom.llm import html_extract as h

    def plainly(lengths, marks, paths, prior):
        n = len(paths)
        of = lambda x, i: sum(x[j] for j in range(n) if paths[j] == paths[i]) / paths.count(paths[i])
        mean = [of(lengths, i) for i in range(n)]
        text = [min(m, h.PROSE[0]) ** 0.5 for m in mean]
        points = [min(of(marks, i), h.PROSE[1]) ** 0.5 for i in range(n)]

        def smooth(x, i):
            weights = {j: (3 - abs(i - j)) * (1 if i == j or paths[i] == paths[j] else 0.25) for j in range(max(0, i - 2), min(n, i + 3))}
            return sum(w * x[j] for j, w in weights.items()) / sum(weights.values())

        fused = [(text[i] * smooth(text, i)) ** 0.5 * (0.25 + (points[i] * smooth(points, i)) ** 0.5) * prior[i] for i in range(n)]
        limit = h.SHARE * min(max(fused), h.PROSE[0] ** 0.5 * (0.25 + h.PROSE[1] ** 0.5))
        return [f >= limit - 1e-12 or m * p >= h.PROSE[0] for f, m, p in zip(fused, mean, prior, strict=True)]

    pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    seen = 0
    for (source,) in pages:
        page = h._Page(source or "")
        if not page.blocks:
            continue
        number = {}
        paths = [number.setdefault(page.path[e], len(number)) for _, e, _ in page.blocks]
        lengths = [float(len(t) - linked) for t, _, linked in page.blocks]
        marks = [float(sum(t.count(c) for c in h.PUNCTUATION)) for t, _, _ in page.blocks]
        prior = [1.0 if page.inside[e] else h.OUTSIDE for _, e, _ in page.blocks]
        got = h.content_nodes(np.array(lengths), np.array(marks), np.array(paths), np.array(prior))
        assert got.tolist() == plainly(lengths, marks, paths, prior)
        seen += len(paths)
    assert seen > 1000


COMMENTS = [
    "<article>{}<div class='discussion'><p>comment, of a reader.</p><p>another one, here.</p></div></article>",
    "<div class='story'>{}</div><div class='discussion'><div class='post'><p>comment, of a reader. It is long, too.</p></div><div class='post'><p>another one.</p></div></div>",
    "<article>{}<div class='u1'><div class='k'><p>Anna, 12:30</p><p>I like that, a lot. Really, yes.</p><p>Reply</p></div><div class='k'><p>Bob, 13:30</p><p>Not me, at all. No.</p><p>Reply</p></div></div></article>",
    "<main>{}<section class='disclaimer-box'><p>No warranty, of any kind.</p></section></main>",
]


@pytest.mark.parametrize("page", COMMENTS)
def test_comments_and_notices_go_by_name_or_shape(page):
    from ledgerloom.llm.html_extract import main_text

    parts = ["Long text, of the article. It goes on, and on, with many words.", "Second part, of the text. With more words, and a full stop."]
    assert main_text(page.format("".join(f"<p>{p}</p>" for p in parts))) == "\n".join(parts)


def test_dated_posts_are_content_where_they_are_the_page():
    from ledgerloom.llm.html_extract import main_text

    posts = "".join(f"<div class='post'><p>2026-01-0{n}, 12:30</p><p>The text of post number {n}, which is long. It goes on.</p><p>Reply</p></div>" for n in range(1, 4))
    assert "post number 2" in main_text(f"<body>{posts}</body>")


@pytest.mark.parametrize("page", ["<a href=\"" * 80000, "<div><p>a</p></x>" * 30000, "<script x=\"" * 80000, "<b>" * 50000 + "</i>" * 50000, "<svg>" * 80000, "<ul><li>x" * 20000, "<!--" * 100000, "<a '\">" * 60000])
def test_broken_markup_takes_linear_time(page):
    import time

    from ledgerloom.llm.html_extract import main_text

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 8


def test_pipeline_stages_with_a_column_of_the_key_s_name(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "one text here", "a"), (2, "one text here", "b"), (None, "one text here", "c"), (3, "another text", "d"), (None, None, "e"), (None, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key string")
    docs.write.parquet(str(tmp_path / "docs"))
    for given in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        out = corpus_pipeline.drop_exact_copies(spark, given, "")
        got = sorted((tuple(r) for r in out.collect()), key=str)
        assert out.columns == given.columns and got[:2] == [(2, "one text here", "b"), (3, "another text", "d")] and len(got) == 3 and got[2][2] in "ef"
