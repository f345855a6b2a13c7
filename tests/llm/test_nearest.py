import numpy as np

from quire.llm import ann, queries


def test_recall_and_scores_by_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows if r["embedding"] is not None and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    found = {}
    for r in queries.op8_nearest(spark, small).collect():
        assert abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-9
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hit = 0
    for q, got in found.items():
        best = sorted(((-(vectors[q] @ v), i) for i, v in vectors.items() if i != q))[:20]
        assert sorted(got) == list(range(1, 21))
        order = [(-got[k][1], got[k][0]) for k in sorted(got)]
        assert order == sorted(order)
        hit += len({i for _, i in best} & {i for i, _ in got.values()})
    assert hit / (20 * len(found)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0, None]), (9, []), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, id int, v string")
    out = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    of = lambda q: [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(0) == [(1, 1.0), (2, 1.0), (3, 0.5), (20, 0.0), (20, 0.0)]
    assert of(20)[0] == (3, 2.0) and of(40) == []
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0


def recall(ids, vectors, blocks=1, k=20):
    """Share of the true k best that are found for every 20th row, asked of all blocks."""
    asked = np.flatnonzero(ids % 20 == 0)[:100]
    got = [[] for _ in asked]
    for p in range(blocks):
        block = ann.Block(ids[p::blocks], vectors[p::blocks])
        for some, (at, score) in zip(got, block.search(vectors[asked], ids[asked], k)):
            some += zip(-score, block.ids[at])
    hit = 0
    for q, some in zip(asked, got):
        products = vectors @ vectors[q]
        products[ids == ids[q]] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -products))[:k]]) & {i for _, i in sorted(some)[:k]})
    return hit / (k * len(asked))


def test_recall_on_the_larger_table(spark):
    rows = ann.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding").collect()
    assert len(rows) == 2000
    assert recall(np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows])) >= 0.9


def test_recall_on_full_blocks():
    draw = np.random.default_rng(0)
    for size in (64, 128):
        unit = draw.standard_normal((ann.ROWS, size))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        assert recall(np.arange(ann.ROWS), unit) >= 0.9
        assert recall(np.arange(ann.ROWS), unit * draw.uniform(0.2, 1.0, (ann.ROWS, 1))) >= 0.9


def test_fewer_rows_than_asked_for():
    draw = np.random.default_rng(1)
    assert recall(np.arange(15), draw.standard_normal((15, 8)), k=14) == 1.0
    found = [len(at) for at, _ in ann.Block(np.arange(15), draw.standard_normal((15, 8))).search(draw.standard_normal((3, 8)), np.array([0, 1, 99]), 20)]
    assert found == [14, 14, 15]


def collisions(monkeypatch, block, vectors, **more):
    """Collisions counted for a row and query."""
    sizes, real = [], np.bincount
    with monkeypatch.context() as m:
        m.setattr(np, "bincount", lambda x, *a, **b: sizes.append(len(x)) or real(x, *a, **b))
        list(block.search(vectors[:50], np.arange(50), 20, **more))
    return sum(sizes) / (50 * len(vectors))


def test_windows_hold_few_rows(monkeypatch):
    unit = np.random.default_rng(2).standard_normal((ann.ROWS, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    block = ann.Block(np.arange(ann.ROWS), unit)
    alone = collisions(monkeypatch, block, unit)
    assert alone < 6
    assert collisions(monkeypatch, block, unit, parts=100) < collisions(monkeypatch, block, unit, parts=7) < alone


def test_blocks_of_a_large_table_look_for_their_share():
    draw, parts = np.random.default_rng(4), 4
    unit = draw.standard_normal((parts * ann.ROWS, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    part, asked, hit = draw.integers(0, parts, len(unit)), np.arange(0, 1000, 20), 0
    got = [[] for _ in asked]
    for p in range(parts):
        ids = np.flatnonzero(part == p)
        for some, (at, score) in zip(got, ann.Block(ids, unit[ids]).search(unit[asked], asked, 20, parts)):
            some += zip(-score, ids[at])
    for q, some in zip(asked, got):
        products = unit @ unit[q]
        products[q] = -np.inf
        hit += len(set(np.argsort(-products)[:20]) & {i for _, i in sorted(some)[:20]})
    assert hit / (20 * len(asked)) >= 0.9


def test_few_rows_in_one_of_many_blocks():
    draw = np.random.default_rng(5)
    found = [len(at) for at, _ in ann.Block(np.arange(30), draw.standard_normal((30, 8))).search(draw.standard_normal((2, 8)), np.array([0, 99]), 40, 1000)]
    assert found == [29, 30]
