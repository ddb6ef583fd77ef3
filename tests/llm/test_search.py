"""Near-duplicates, history, leaks and mixing against brute force on small fixtures."""

import random

import numpy as np
import pytest

from cairn.llm import history, leak, mixing, neardup, queries

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed, n, edits):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            t = list(r.choice(out))
            for _ in range(r.randrange(edits)):
                t[r.randrange(len(t))] = r.choice(WORDS)
        else:
            t = r.choices(WORDS, k=r.randrange(3, 60))
        out.append(t)
    return [" ".join(t) for t in out]


def shingles(t, k):
    x = (t or "").split()
    return {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}


def alike(a, b):
    return len(a & b) / len(a | b) if a and b else 0


@pytest.mark.parametrize("threshold,width", [(0.5, 3), (0.8, 5)])
def test_near_duplicates(spark, threshold, width):
    texts = [*corpus(3, 250, 6), None, "", "a b", "same text here please", "same text here please"]
    sh = [shingles(t, width) for t in texts]
    want = {(f"{i:03d}", f"{j:03d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if alike(sh[i], sh[j]) >= threshold}
    d = spark.createDataFrame([(0, f"{i:03d}", t) for i, t in enumerate(texts)] + [(0, "000", texts[0]), (1, "x", texts[0])], "space int, id string, text string")
    members, links = neardup.near_duplicates(d, threshold, width)
    got = {(r["id_a"], r["id_b"]) for r in neardup.expanded(members, links).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    exact = neardup.near_duplicates(d, threshold, width, exact=True)
    assert {(r["id_a"], r["id_b"]) for r in neardup.expanded(*exact).collect()} == want
    assert neardup.with_links(members, links).where("space = 1").first()["copies"] == 1


def test_all_pairs_of_a_large_class(spark):
    rows = [(0, f"{i:04d}", "one and the same text of some more words") for i in range(1101)] + [(0, "x", "one and the same text of some more words here")]
    pairs = neardup.expanded(*neardup.near_duplicates(spark.createDataFrame(rows, "space int, id string, text string"), 0.5, 3))
    assert pairs.count() == 1101 * 1100 // 2 + 1101 == pairs.where("id_a < id_b").select("id_a", "id_b").distinct().count()


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    texts = [f"{WORDS[i % 7]} one and the same text with some more words {WORDS[i]}" for i in range(60)]
    d = spark.createDataFrame([(0, f"{i:03d}", t) for i, t in enumerate(texts)], "space int, id string, text string")
    pairs = lambda: sorted((r["id_a"], r["id_b"]) for r in neardup.expanded(*neardup.near_duplicates(d, 0.5, 3)).collect())
    whole = pairs()
    monkeypatch.setattr(neardup, "LIST", 7)
    assert pairs() == whole and len(whole) == len(set(whole)) > 1000


def test_near_duplicates_of_nothing(spark):
    d = spark.createDataFrame([], "space int, id string, text string")
    assert neardup.expanded(*neardup.near_duplicates(d)).count() == 0


def test_history(spark):
    texts = corpus(5, 300, 8)
    batch = [0] * 100 + [1 + i % 4 for i in range(200)]
    sh = [shingles(t, 3) for t in texts]
    want = {f"{i}" for i in range(300) if batch[i] and any(batch[j] < batch[i] and alike(sh[i], sh[j]) >= 0.5 for j in range(300))}
    past = spark.createDataFrame([(str(i), texts[i]) for i in range(100)] + [("n", None)], "id string, text string")
    new = spark.createDataFrame([(str(i), batch[i], texts[i]) for i in range(100, 300)] + [("e", 2, ""), ("z", 2, None)], "id string, batch int, text string")
    got = {r["id"] for r in history.already_present(past, new, 0.5, 3).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_history_in_crowded_ranges(spark):
    # items are alike (52/101) only to near-copies of one boilerplate; their other words are in texts that are not alike enough
    base = [f"b{i}" for i in range(54)]
    tails = [[f"t{i}x{j}" for j in range(48)] for i in range(300)]
    past = [(f"m{i}", " ".join([*base, f"m{i}"])) for i in range(2000)] + [(f"d{i}-{k}", " ".join(t)) for i, t in enumerate(tails) for k in range(2)]
    new = [(f"{i}", 1, " ".join([*base, *t])) for i, t in enumerate(tails)]
    assert 0.5 <= alike(shingles(new[0][2], 3), shingles(past[0][1], 3)) < 0.53 and alike(shingles(new[0][2], 3), shingles(past[2000][1], 3)) < 0.5
    got = history.already_present(spark.createDataFrame(past, "id string, text string"), spark.createDataFrame(new, "id string, batch int, text string"), 0.5, 3)
    assert {r["id"] for r in got.collect()} == {x[0] for x in new}


def batches(spark, texts, size, first=0):
    return [spark.createDataFrame([(f"{b}-{i}", b, t) for i, t in enumerate(texts[b * size : b * size + size])], "id string, batch int, text string") for b in range(first, len(texts) // size)]


def test_forest_goes_on_where_it_was(spark):
    texts = corpus(7, 60, 4)
    sh = [shingles(t, 3) for t in texts]
    want = [{f"{b}-{i}" for i in range(20) if any(alike(sh[20 * b + i], sh[j]) >= 0.5 for j in range(20 * b))} for b in range(3)]
    path = None
    for b, d in enumerate(batches(spark, texts, 20)):
        f = history.HashForest(spark, path, threshold=0.5, width=3)  # opened again for each batch
        path = f.path
        assert {r["id"] for r in f.accept(d).collect()} == want[b]
        assert len(f.runs) == b + 1
    stored = lambda f: spark.read.parquet(*(f"{r}/classes/data" for r in f.runs)).select("fp").distinct().count()
    before = stored(f)
    assert before == len({frozenset(x) for x in sh if x})
    f.merge(blocks=2)
    assert len(f.runs) == 1 and stored(f) == before
    keys = history.HashForest(spark, path, threshold=0.5, width=3)
    again = keys.accept(spark.createDataFrame([("x", 9, texts[3]), ("y", 9, texts[44]), ("z", 9, "nothing like it at all")], "id string, batch int, text string"))
    assert {r["id"] for r in again.collect()} == {"x", "y"} and len(keys.runs) == 2
    with pytest.raises(ValueError):
        history.HashForest(spark, path, threshold=0.8, width=3)


def test_blocks_read_follow_the_batch_not_the_history(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK_BYTES", 4096)
    f = history.HashForest(spark, threshold=0.8, width=3)
    r = random.Random(3)
    new = lambda n: [" ".join(r.choices(WORDS, k=30)) for _ in range(n)]

    def touched():
        batch = f.add(spark.createDataFrame([("q", 9, "a text of its own that nothing in this history is like")], "id string, batch int, text string"))
        where = history.fences(spark, [f"{p}/trees" for p in f.runs[:-1]])
        keys = history.tree_keys(batch.select("sig").toArrow().to_batches()[0]).ravel()
        lo = keys >> history.SECOND << history.SECOND
        return sum(len(b) for _, b in where.blocks(lo, lo + (1 << history.SECOND) - 1)), len(where.file)

    f.add(spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(new(2000))], "id string, batch int, text string"))
    few, small = touched()
    f = history.HashForest(spark, threshold=0.8, width=3)
    f.add(spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(new(16000))], "id string, batch int, text string"))
    again, large = touched()
    assert large > 4 * small and again <= few + 2 * f.trees


def test_merge_of_a_key_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK_BYTES", 4096)
    f = history.HashForest(spark, threshold=0.8, width=3)
    rows = lambda b: spark.createDataFrame([(f"{b}-{i}", b, " ".join([*WORDS[:200], f"x{b}-{i}"])) for i in range(3000)], "id string, batch int, text string")
    for b in range(2):
        f.add(rows(b))
    count = lambda: spark.read.parquet(*(f"{r}/trees/data" for r in f.runs)).select("key", "fp").distinct().count()
    before = count()
    f.merge(blocks=2)
    got = spark.read.parquet(f"{f.runs[0]}/trees/data")
    assert got.count() == count() == before
    where = history.fences(spark, [f"{f.runs[0]}/trees"])
    assert (where.low[1:] >= where.high[:-1]).all() and len(where.low) > 8


def test_leaks(spark):
    r = random.Random(9)
    passages = [r.choices(WORDS, k=40) for _ in range(6)] + [r.choices(WORDS, k=8)]
    docs = []
    for i in range(120):
        t = r.choices(WORDS, k=r.randrange(0, 80))
        if i % 3 == 0:
            p = r.choice(passages)
            n = r.randrange(10, len(p) + 1) if len(p) > 10 else len(p)
            a = r.randrange(len(p) - n + 1)
            t[5:5] = [x.upper() for x in p[a : a + n]]
        docs.append(t)
    want = set()
    for i, t in enumerate(docs):
        low = " ".join(t).lower().split()
        runs = {tuple(low[k : k + 16]) for k in range(len(low) - 15)}
        want |= {(i, j) for j, p in enumerate(passages) if runs & {tuple(p[k : k + 16]) for k in range(len(p) - 15)}}
    d = spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(docs)] + [(900, None), (901, "")], "doc_id long, text string")
    it = spark.createDataFrame([(j, " ".join(p)) for j, p in enumerate(passages)] + [(90, None)], "item_id long, passage string")
    got = {(r["doc_id"], r["item_id"]) for r in leak.leaks(d, it).where("run_words >= 16").collect()}
    assert got == want
    assert leak.leaks(d.limit(0), it).count() == 0 and leak.leaks(d, it.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.05, 0.1, 0.2])
def test_edited_copies_are_found(spark, share):
    r = random.Random(int(share * 100))
    passages = [r.choices(WORDS, k=r.randrange(30, 70)) for _ in range(10)]
    docs = []
    for i in range(150):
        t = r.choices(WORDS, k=r.randrange(20, 60))
        if i % 2:
            p = list(r.choice(passages))
            for k in range(len(p) - 1, -1, -1):
                if r.random() < share:
                    p[k : k + 1] = r.choice([[r.choice(WORDS)], [], [p[k], r.choice(WORDS)]])
            t[7:7] = p
        docs.append(t)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    it = spark.createDataFrame([(j, " ".join(p)) for j, p in enumerate(passages)], "item_id long, passage string")
    got = {(x["doc_id"], x["item_id"]) for x in leak.leaks(d, it).collect()}
    code = lambda t: np.array([int(x[1:]) for x in t])
    want = {(i, j) for i, t in enumerate(docs) for j, p in enumerate(passages) if leak.align(code(t), code(p))[1] >= 0.5 * leak.MATCH * len(p)}
    assert len(want) >= 50 and got <= want and len(got) >= (0.9 if share > 0.1 else 0.95) * len(want)


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 6, 25), rng.integers(0, 6, 15)
        h = np.zeros((16, 26))
        for i in range(1, 16):
            for j in range(1, 26):
                h[i, j] = max(0, h[i - 1, j - 1] + (leak.MATCH if a[j - 1] == b[i - 1] else leak.MISMATCH), h[i - 1, j] + leak.GAP, h[i, j - 1] + leak.GAP)
        assert leak.align(a, b)[1] == h.max()


def test_permutation():
    for n in (1, 2, 5, 100, 1000):
        for key in (1, 99):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))


def test_allocation():
    assert mixing.allocate(np.array([50.0, 50.0]), np.array([10.0, 200.0])).tolist() == [10.0, 90.0]
    assert mixing.allocate(np.array([50.0, 50.0]), np.array([10.0, 20.0])).tolist() == [10.0, 20.0]


def test_hypergeometric():
    from math import comb

    u = (np.arange(20000) + 0.5) / 20000
    got = np.bincount([mixing.hypergeometric(x, 7, 12, 9) for x in u], minlength=8) / len(u)
    want = [comb(7, k) * comb(12, 9 - k) / comb(19, 9) for k in range(8)]
    assert np.abs(got - want).max() < 1e-3
    big = [mixing.hypergeometric(x, 3 * 10**9, 10**10, 10**9) for x in u[::2000]]
    assert big == sorted(big) and abs(np.mean(big) - 10**9 * 3 / 13) < 10**5
    assert mixing.hypergeometric(0.5, 0, 5, 3) == 0 and mixing.hypergeometric(0.5, 5, 0, 3) == 3


def test_shards_share_out_the_totals(monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 10)
    totals = (33, 0, 514, 7)
    got = [mixing.shard_counts(totals, k, (1, 2)) for k in range(mixing.shards_of(sum(totals)))]
    assert len(got) == 56 and all(sum(c) == 10 for _, c in got[:-1]) and sum(got[-1][1]) == 4
    for j, n in enumerate(totals):
        at = 0
        for first, count in got:
            assert first[j] == at or not count[j]
            at += count[j]
        assert at == n


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, s, " ".join(r.choices(WORDS, k=n))) for i, (s, n) in enumerate([("big", 300)] * 60 + [("small", 100)] * 6)] + [(900, None, "x"), (901, "big", None), (902, "big", "")]
    d = spark.createDataFrame(docs + [docs[0]], "doc_id long, source string, text string")
    plans = spark.createDataFrame([("m", "big", 1.0, 2, 0.5), ("m", "small", 1.0, 3, 0.5), ("m", "none", 1.0, 3, 0.5)], "mix_name string, source string, target_weight double, max_repeats int, budget_share double")
    m = mixing.Mix(d, plans, queries.TOKENIZER, length=64)
    pieces = m.pieces()
    rows = pieces.collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, pieces.collect()))
    uses = {}
    for p in rows:
        uses.setdefault(p["doc_id"], set()).add(p["pass"])
    assert all(len(v) <= (2 if k < 60 else 3) for k, v in uses.items())
    shares = {r["source"]: r for r in m.shares(pieces).collect()}
    assert shares["none"]["actual_tokens"] == 0 and shares["small"]["most_uses"] == 3
    assert abs(shares["small"]["actual_tokens"] - 3 * shares["small"]["tokens"]) <= 64 * 3
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    assert mixing.Mix(d.limit(0), plans, queries.TOKENIZER).pieces().count() == 0
