import random
import string

import numpy as np

from pagequarry.llm import leakage, shared_spans as ss


def plain_leaks(docs, items, words=12):
    found = {}
    for i, item in items:
        w = leakage.words_of(item or "")
        n = min(words, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            t = leakage.words_of(text or "")
            hit = windows & {tuple(t[k : k + n]) for k in range(len(t) - n + 1)} if n else set()
            if hit:
                found[d, i] = max(found.get((d, i), 0), len(hit) / len(windows))
    return found


def test_leaks_against_plain_loop(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "naïve"]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, sentence(rng.choice([1, 2, 4, 5, 7, 11, 12, 13, 20, 30]))) for i in range(60)] + [(900, ""), (901, None), (902, "…!"), (3, "again another text of this item")]
    docs = [(d, sentence(rng.choice([0, 3, 40, 200]))) for d in range(80)]
    docs += [(100 + k, f"{sentence(20)}, {text.upper()}! {sentence(9)}") for k, (_, text) in enumerate(items[:20])] + [(500, None), (501, ""), (502, sentence(50000)), (100, docs[3][1])]
    d = spark.createDataFrame([(*x, "x") for x in docs], "n long, t string, item_id string")
    i = spark.createDataFrame([(*x, "x") for x in items], "k int, s string, doc_id string")
    for size in (1 << 20, 200):  # one block, several blocks
        got = {(r.doc_id, r.item_id): r.containment for r in leakage.leaks(d, i, "n", "t", "k", "s", block_keys=size).collect()}
        expected = plain_leaks(docs, [x for x in items if x[0] != 3])
        assert {k: round(v, 9) for k, v in got.items() if k[1] != 3} == {k: round(v, 9) for k, v in expected.items()}
    assert leakage.leaks(d.limit(0), i, "n", "t", "k", "s").count() == 0 and leakage.leaks(d, i.limit(0), "n", "t", "k", "s").count() == 0


def plain_pairs(docs, least):
    where = {}
    for d, t in docs:
        for k in range(len(t or "") - least + 1):
            where.setdefault(t[k : k + least], set()).add(d)
    return {(a, b) for s in where.values() for a in s for b in s if a < b}


def corpus(rng, least):
    letters = string.ascii_lowercase[:5] + " é語😀"
    text = lambda n: "".join(rng.choices(letters, k=n))
    shared = [text(n) for n in (least - 1, least, least + 1, 3 * least)]
    docs = [(i, text(rng.randrange(0, 4 * least))) for i in range(30)]
    for i in range(30, 60):
        docs.append((i, text(rng.randrange(2 * least)) + rng.choice(shared) + text(rng.randrange(2 * least)) + rng.choice(shared)[rng.randrange(3) :]))
    period = "ab" * (2 * least)
    once = text(2 * least)
    gram = text(least // 3)  # the same gram twice within a span, and a third time outside it in one text only
    twice = text(3) + gram + text(5) + gram + text(least - 2 * len(gram) - 8)
    docs += [(60, once[:40] + twice + once[40:90]), (61, gram + text(2) + twice + text(70)), (62, text(90) + twice[: least - 1] + text(9))]
    docs += [(70, period), (71, "x" + period), (72, "a" * 3 * least), (73, text(50) + "a" * (least + 5)), (74, docs[40][1]), (75, docs[40][1]), (80, None), (81, ""), (70, period)]
    return docs


def test_spans_against_plain_loop(spark):
    for seed, least in ((1, 60), (2, 31)):
        docs = corpus(random.Random(seed), least)
        df = spark.createDataFrame([(*d, "x") for d in docs], "n long, t string, start string")
        got = ss.shared_spans(df, "n", "t", least=least, shard_chars=2500, stream_chars=3000).collect()
        by = dict(docs)
        assert {(r.doc_a, r.doc_b) for r in got} == plain_pairs(docs, least)
        for r in got:
            a, b = by[r.doc_a][r.start_a : r.start_a + r.length], by[r.doc_b][r.start_b : r.start_b + r.length]
            assert a == b and len(a) == r.length >= least
        if seed == 2:
            shares = {r.doc_id: r.shared_chars for r in ss.shared_shares(df.sparkSession.createDataFrame(got), df, "n", "t").collect()}
            for d, t in by.items():
                covered = np.zeros(len(t or ""), dtype=bool)
                for r in got:
                    for i, s in ((r.doc_a, r.start_a), (r.doc_b, r.start_b)):
                        if i == d:
                            covered[s : s + r.length] = True
                assert shares.get(d, 0) == covered.sum()


def test_no_spans(spark):
    df = spark.createDataFrame([(1, "a" * 500), (1, "a" * 500), (2, None), (3, "b" * 299)], "n long, t string")
    assert ss.shared_spans(df, "n", "t").count() == 0 and ss.shared_spans(df.limit(0), "n", "t").count() == 0


def test_shares_of_documents_without_spans(spark):
    docs = spark.createDataFrame([(1, "a" * 500), (2, "xx" + "a" * 400), (3, "b" * 400), (4, "short"), (5, ""), (6, None), (3, "b" * 400)], "n long, t string")
    spans = spark.createDataFrame([(1, 2, 0, 2, 400)], "doc_a long, doc_b long, start_a int, start_b int, length int")
    expected = [(1, 500, 400, 0.8), (2, 402, 400, 0.995025), (3, 400, 0, 0.0), (4, 5, 0, 0.0), (5, 0, 0, 0.0), (6, None, 0, 0.0)]
    assert sorted(tuple(r) for r in ss.shared_shares(spans, docs, "n", "t").collect()) == expected
    assert sorted(tuple(r)[2:] for r in ss.shared_shares(spans.limit(0), docs, "n", "t").collect()) == [(0, 0.0)] * 6


def test_marks_cover_every_window():
    rng = random.Random(3)
    for text in ("".join(rng.choices("abc", k=3000)), "a" * 900, "abc" * 400):
        codes = ss._codes(text)
        at = ss.marks(ss._gram_hashes(codes, 64), 300, 64)
        ends = at + 64
        if len(set(text)) == 3 and "abcabc" * 10 not in text:
            assert all(((at >= s) & (ends <= s + 300)).any() for s in range(len(text) - 299))
        assert at.size


def test_index_against_plain_search():
    rng = random.Random(9)
    texts = ["".join(rng.choices("abé", k=n)) for n in (1, 40, 700, 333)] + ["ab" * 100]
    index = ss.FMIndex([ss._codes(t) for t in texts], 12)
    patterns = [t[i : i + 12] for t in texts for i in range(0, max(1, len(t) - 12), 7) if len(t) >= 12] + ["zzzzzzzzzzzz", "ababababaabb"]
    codes = np.concatenate([ss._codes(p) for p in patterns])
    lane, low, high = index.search(codes, np.arange(len(patterns)) * 12, 12, np.ones(len(patterns), dtype=int))
    got = {patterns[i]: {tuple(map(int, p)) for p in zip(*index.places(np.arange(a, b)))} for i, a, b in zip(lane, low, high)}
    expected = {p: {(j, k) for j, t in enumerate(texts) for k in range(len(t)) if t.startswith(p, k)} for p in patterns}
    assert got == {p: s for p, s in expected.items() if s}
