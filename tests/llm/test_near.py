import random

import corpus_pipeline
import numpy as np

from quire.llm import near


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def components(texts):
    """Least key of each component, by comparing all pairs."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_stage_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    expected = components({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, small).collect())
    assert kept == sorted(set(expected.values()))
    assert {1, 6} <= set(kept) and not {177, 145} & set(kept)


def test_copies_of_one_original_and_chains(make_docs, spark, small):
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    base = [word() for _ in range(300)]
    for _ in range(40):  # near the original, mostly not near each other
        some = list(base)
        for at in draw.sample(range(300), 5):
            some[at] = word()
        rows.append(some)
    rows.append(base)
    now = [word() for _ in range(200)]
    for _ in range(12):  # each near the one before only
        now = now[12:] + [word() for _ in range(12)]
        rows.append(now)
    rows += [[word() for _ in range(100)] for _ in range(10)]
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    kept = near.keep_one(make_docs([(i, t, "en") for i, t in texts.items()])).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(components(texts).values()))


def test_blocks_of_any_size_find_the_same(make_docs, monkeypatch):
    """Clusters whose texts are near some others, but not the central one, in blocks of a few texts each."""
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for _ in range(4):
        now = [word() for _ in range(150)]
        for _ in range(25):
            some = list(now)
            for at in draw.sample(range(150), draw.randrange(1, 5)):
                some[at] = word()
            rows.append(some)
            if draw.random() < 0.7:
                now = some
    draw.shuffle(rows)
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    expected = sorted(set(components(texts).values()))
    for room in (400_000, 600):
        monkeypatch.setattr(near, "ROOM", room)
        kept = near.keep_one(make_docs([(i, t, "en") for i, t in texts.items()])).collect()
        assert sorted(r["doc_id"] for r in kept) == expected


def test_texts_that_share_a_key_both_stay(make_docs):
    rows = [(5, "one two three four five six", "en"), (5, "quite another text with other words", "en"), (5, "one two three four five six", "en"), (6, "one two three  four five six", "en")]
    kept = near.keep_one(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted({(5, rows[0][1]), (5, rows[1][1])})


def test_odd_rows(odd, none):
    kept = near.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 7, 8, 9, 10]
    assert kept.where("doc_id IS NULL").count() == 1 and near.keep_one(none).count() == 0


def sets_at_the_edge(draw, n, shared):
    """Pairs of sets of hashes of similarity 0.8, each of its own hashes."""
    for _ in range(n):
        own = np.array([draw.getrandbits(64) for _ in range(shared * 5 // 4)], dtype=np.uint64)
        cut = draw.randrange(shared, len(own) + 1)
        yield own[:cut], np.concatenate([own[:shared], own[cut:]])


def test_fingerprints_at_the_edge_meet_in_the_grid():
    draw = random.Random(3)
    picks = near.tables(50_000)
    assert len(set(map(tuple, picks.tolist()))) == len(picks) > 1 and all(len(set(p)) == len(p) for p in picks.tolist())
    for shared in (12, 40, 400):
        for pair in sets_at_the_edge(draw, 60, shared):
            bits = [np.frombuffer(near.fingerprint(s), dtype=np.uint64) for s in pair]
            apart = np.bitwise_count(bits[0] ^ bits[1])
            assert (np.bitwise_count(near.grid_points(bits[0]) ^ near.grid_points(bits[1])) <= apart).all()
            assert apart[: near.FIRST].sum() <= near.RADIUS
            counts = [np.unpackbits(b.view(np.uint8), bitorder="little").reshape(-1, 2).sum(axis=1) for b in bits]
            assert (counts[0][picks] == counts[1][picks]).all(axis=1).any()


def test_candidates_of_a_cell_are_pairs_or_in_one_group():
    draw = np.random.default_rng(8)
    bits = draw.integers(0, 1 << 63, (near.FIRST, 90), dtype=np.uint64)
    for at, members in ((0, 30), (40, 5), (50, 20)):  # near copies of one, some also near each other
        for k in range(at + 1, at + members):
            bits[:, k] = bits[:, at]
            for b in draw.choice(64 * near.FIRST, draw.integers(1, 40), replace=False).tolist():
                bits[b // 64, k] ^= np.uint64(1 << b % 64)
    nodes = draw.permutation(10_000)[:90]
    near_ones = {(int(nodes[i]), int(nodes[j])) for i in range(90) for j in range(90) if i != j and int(np.bitwise_count(bits[:, i] ^ bits[:, j]).sum()) <= near.RADIUS}
    for few in (0, 8, 90):
        pairs, groups = near.meet(nodes, bits, few)
        pairs, of = {tuple(p) for p in pairs}, {k: g for g, k in groups}
        assert pairs <= near_ones and (few < 90 or not groups) and (few or not pairs)
        assert all((a, b) in pairs or (b, a) in pairs or of.get(a, -1) == of.get(b, -2) for a, b in near_ones)


def test_groups_and_crowds_find_the_same(make_docs, monkeypatch):
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for _ in range(20):
            some = list(base)
            for at in draw.sample(range(150), draw.randrange(1, 5)):
                some[at] = word()
            rows.append(some)
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    expected = sorted(set(components(texts).values()))
    for meet, few, crowd in ((500, 0, 20_000), (0.5, 8, 3)):
        monkeypatch.setattr(near, "MEET", meet)
        monkeypatch.setattr(near, "FEW", few)
        monkeypatch.setattr(near, "CROWD", crowd)
        kept = near.keep_one(make_docs([(i, t, "en") for i, t in texts.items()])).collect()
        assert sorted(r["doc_id"] for r in kept) == expected


def test_a_text_is_dealt_as_often_for_any_number_of_texts(spark, monkeypatch):
    draw, dealt, grid = np.random.default_rng(4), [], near.grid_cells
    prints = spark.createDataFrame([(i, draw.bytes(8 * near.WORDS)) for i in range(5)], "node long, print binary")
    monkeypatch.setattr(near, "grid_cells", lambda *of: dealt.append(grid(*of)) or dealt[-1])
    for texts in (100, 236_000, 15_000_000):
        near.candidates(prints, texts)
    assert {d.count() for d in dealt} == {dealt[0].count()} and dealt[0].count() <= 5 * 40


def test_a_text_of_a_large_group_is_compared_in_one_group(make_docs, monkeypatch):
    draw, given, join = random.Random(13), [], near.linked
    word = lambda: f"w{draw.randrange(10**6)}"
    base = [word() for _ in range(150)]
    texts = {0: " ".join(base)}
    for i in range(1, 60):
        some = list(base)
        some[draw.randrange(150)] = word()
        texts[i] = " ".join(some)
    texts |= {i: " ".join(word() for _ in range(80)) for i in range(60, 70)}

    def seen(listed, cells, sets):
        given.append((cells.count(), cells.select("node").distinct().count()))
        return join(listed, cells, sets)

    monkeypatch.setattr(near, "linked", seen)
    kept = near.keep_one(make_docs([(i, t, "en") for i, t in texts.items()])).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, *range(60, 70)]
    assert given == [(60, 60)]


def test_parts_agree_in_their_segments_and_together_lose_no_candidate():
    draw = np.random.default_rng(6)
    bits = draw.integers(0, 1 << 63, (near.FIRST, 300), dtype=np.uint64)
    for k in range(200):  # two large families and single texts
        bits[:, k] = bits[:, 200 + k % 2]
        for b in draw.choice(64 * near.FIRST, draw.integers(1, 45), replace=False).tolist():
            bits[b // 64, k] ^= np.uint64(1 << b % 64)
    nodes = draw.permutation(10_000)[:300]
    counts = np.unpackbits(bits.T.copy().view(np.uint8), axis=1, bitorder="little").reshape(300, -1, 2).sum(axis=2)
    parts = []
    for pick in near.tables(236_000)[:6, near.WIDE :]:
        expected, own = {}, pick % (32 * near.FIRST)
        for k in range(300):
            expected.setdefault(tuple(counts[k, own]), []).append(k)
        found = near.parts_of(near.grid_points(bits), pick)
        assert sorted(p.tolist() for p in found) == sorted(p for p in expected.values() if len(p) > 1)
        parts += found
    met = {(int(i), int(j)) for p in parts for i in p for j in p if i != j and int(np.bitwise_count(bits[:, i] ^ bits[:, j]).sum()) <= near.RADIUS}
    for few in (0, 8, 300):
        pairs, groups = near.meet(nodes, bits, few, parts)
        of, listed = {k: g for g, k in groups}, {p for a, b in pairs for p in ((a, b), (b, a))}
        assert len(of) == len(groups) and all(g == min(k for k in of if of[k] == g) for g in of.values())
        assert all((nodes[i], nodes[j]) in listed or of.get(nodes[i], -1) == of.get(nodes[j], -2) for i, j in met)
