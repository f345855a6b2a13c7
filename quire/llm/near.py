"""Near copies by segment-popcount embedding and shingle similarity, for the corpus pipeline.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more.  Candidates come by the method of ``simhash``, at the
radius that this similarity asks for: at 0.8 two fingerprints differ in 0.15 of
their bits (0.16 for some sets of few shingles), so they have 1,024 bits here.
Each is mapped to the bit counts of its 2-bit segments.  Texts whose points
agree in all of a table's segments meet in a cell of the grid.  There the
Manhattan distance of the points' segments in three words, a lower bound of the
Hamming distance, and then the bits themselves must be within the radius.
The last check is exact: similarities of the sets of shingles.

A text is dealt by three segments in each of 40 wide tables, for any number of
texts, so the shuffle grows with the rows.  The cells, which do grow, are parted
in their task by more segments, in several ways: as many segments as leave some
thousand texts that meet by chance, as many ways as miss a pair at similarity 0.8
with a probability below 0.00001; 58 of 192 bits miss fewer.  Both are by
calculation.  Sets of four and of five shingles that share four differ in 0.19 of
the bits; of those pairs 0.0001 (47,000 texts) to 0.0007 (15 million) are missed
by the tables and in each group of words 0.00007 by the radius.

Candidates of a text that has few in a part are listed as pairs.  Texts with
many stay together, by the candidates that connect them; groups of several tables
that share a text are one.  All texts of a part beyond ``CROWD`` stay together too.
In such a group every text is compared with the group's
most central one, in a join.  Where that leaves a group with texts of more than
one component, those outside the central text's component are compared with all
of the group, in blocks of bounded size; a group of any size so is split over
many tasks, and no link between candidates is lost.  Texts that repeat are one.

Defined results: words are as in ``simhash``; a null text or one without words
is a copy of any other such; a text of fewer words is one shingle; rows without
a key take no part and stay; of rows with the same key and text one stays, of
a group the one with the least key (of texts that share a key, a tie, the one
with the least hash); an empty table gives an empty table.  A very long text is
read as blocks of shingles.  Other columns are kept as they are, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut, drop, map_text
from quire.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint; those that a cell's texts are compared by, and their bits that may differ
WORDS, FIRST, RADIUS = 16, 3, 58
SEGMENTS = WORDS * 32
#: the most bits that differ at the similarity, as a share; a pair is missed by all tables with less than this probability
FLIP, MISS = 0.1612, 0.00001
#: segments that a text is dealt by, tables of them (its rows in the shuffle, for any number of texts), and groups of FIRST words that these deal in turn
WIDE, TABLES, DEALS = 3, 40, 5
#: texts that meet in a part of a cell by chance, about
MEET = 1_000
#: candidates of a text in a part of a cell that are listed as pairs
FEW = 8
#: texts of a part of a cell that are compared in one task, at least
CROWD = 20_000
#: shingles of one side of a comparison in one task
ROOM = 400_000
#: shingles that are counted at a time, and of a text in its blocks' comparisons
VOTES, BLOCK = 255, 2_048
_STREAM = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def node_of(words: list[bytes]) -> int:
    """A signed 64-bit name of the sequence of words."""
    import xxhash

    n = xxhash.xxh64_intdigest(b" ".join(words))
    return n - (1 << 64) if n >> 63 else n


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words))] if words else [], dtype=np.uint64)
    return np.array(list({digest(s) for s in map(b" ".join, zip(*(words[i:] for i in range(size))))}), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> bytes | None:
    """The bits that are set in over half of the hashes, each drawn out to all words (SplitMix64); none for no hashes."""
    if not len(hashes):
        return None
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), VOTES):  # as many as a byte can count
        x = hashes[at : at + VOTES, None] + _STREAM
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()


def grid_points(bits: np.ndarray) -> np.ndarray:
    """The counts of set bits in each pair of bits as 00, 01 and 11, so that the bits in which two points differ are their Manhattan distance."""
    odd, one = np.uint64(0x5555555555555555), np.uint64(1)
    low, high = bits & odd, (bits >> one) & odd
    return low | high | ((low & high) << one)


def tables(texts: int) -> np.ndarray:
    """The segments of each table of the grid, one row a table, for so many texts: ``WIDE`` that texts are dealt by, then those of their parts; tables with the same wide ones follow each other."""
    same = (1 - FLIP) ** 2 + FLIP**2 / 2  # a segment's count stays, or both bits change and it stays
    near = 32 * FIRST  # segments of the words that are dealt
    size = round(math.log(max(1, texts * 0.375**WIDE / MEET), 8 / 3))  # of chance pairs 3 of 8 agree in a segment
    agree = range(near + 1)
    weight = np.array([math.comb(near, k) * same**k * (1 - same) ** (near - k) for k in agree])
    apart = 1 - np.array([math.comb(k, size) for k in agree]) / math.comb(near, size)
    n = 1
    while (weight * (1 - same**WIDE * (1 - apart**n)) ** (TABLES // DEALS)).sum() ** DEALS > MISS:
        n += 1
    draw = np.random.default_rng(11)
    each = near // max(1, size)  # parts without a common segment
    free, out = draw.permutation(SEGMENTS).tolist(), []
    for t in range(TABLES):
        own = near * (t % DEALS)
        wide = [s for s in free if not own <= s < own + near][:WIDE]
        free = [s for s in free if s not in wide]
        parts = [own + draw.permutation(near)[: each * size].reshape(each, size) for _ in range(-(-n // each))]
        out.append(np.concatenate([np.tile(wide, (n, 1)), np.concatenate(parts)[:n]], axis=1))
    return np.concatenate(out).astype(np.int64)


def grid_cells(prints: DataFrame, wide: np.ndarray) -> DataFrame:
    """cell and node with the words to compare by, of (node, print): a row for each wide table."""
    words = [f"w{w}" for w in range(FIRST)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 8 * WORDS)
            dealt = [pa.array(raw.view("<i8")[:, w]) for w in range(FIRST * DEALS)]
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            counts = bits[:, ::2] + bits[:, 1::2]
            for t, pick in enumerate(wide):
                cell = counts[:, pick] @ 3 ** np.arange(WIDE, dtype=np.int64) + t * 3**WIDE
                at = FIRST * (t % DEALS)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), *dealt[at : at + FIRST]], names=["cell", "node", *words])

    return prints.select("node", "print").mapInArrow(run, ", ".join(f"{c} long" for c in ["cell", "node", *words]))


def parts_of(points: np.ndarray, pick: np.ndarray) -> list[np.ndarray]:
    """The places of those points that agree in all of the segments, for each two or more; the points are of the words that hold these."""
    key = np.zeros(points.shape[1], dtype=np.uint64)
    for s in (pick % (32 * FIRST)).tolist():
        key = key << np.uint64(2) | points[s // 32] >> np.uint64(2 * (s % 32)) & np.uint64(3)
    order = np.argsort(key, kind="stable")
    ends = np.flatnonzero(np.diff(key[order])) + 1
    return [p for p in np.split(order, ends) if len(p) > 1]


def _top(root: np.ndarray, who: np.ndarray) -> np.ndarray:
    found = root[who]
    while ((up := root[found]) != found).any():
        found = up
    root[who] = found
    return found


def meet(nodes: np.ndarray, bits: np.ndarray, few: int, parts: list[np.ndarray] | None = None) -> tuple[list, list]:
    """Candidates of one cell, or of parts of it: those of texts with few as pairs (node, node), other texts as (least node of theirs, node).

    Every pair within the radius is among the pairs, or both are with the same
    least node.  Texts that are together already are not compared with each other.
    """
    n, points = len(nodes), grid_points(bits)
    root, dense, pairs = np.arange(n), np.zeros(n, dtype=bool), []
    for left in [np.arange(n)] if parts is None else parts:
        joined, step = True, max(1, min((1 << 16) // len(left), -(-len(left) // 3)))  # a few blocks, as each pair is met once
        while len(left) > 1:
            if joined:
                _, group, sizes = np.unique(_top(root, left), return_inverse=True, return_counts=True)
                asks = group != sizes.argmax() if sizes.max() > 1 else np.ones(len(left), dtype=bool)
                left, open_ = np.concatenate([left[asks], left[~asks]]), int(asks.sum())
                mine, own = points[:, left], bits[:, left]
            m = min(step, open_)
            if not m:
                break
            far = np.zeros((m, len(left)), dtype=np.uint8)
            for w in range(FIRST):
                far += np.bitwise_count(mine[w, :m, None] ^ mine[w])
            i, j = np.divmod(np.flatnonzero(far <= RADIUS), len(left))
            keep = i < j
            i, j = i[keep], j[keep]
            keep = sum(np.bitwise_count(own[w, i] ^ own[w, j]) for w in range(FIRST)) <= RADIUS
            i, j = i[keep], j[keep]
            degree = np.bincount(i, minlength=m)
            listed = degree[i] <= few
            pairs.append(left[i[listed]] * n + left[j[listed]])
            many = np.flatnonzero(degree > few).tolist()
            ends = np.searchsorted(i, np.arange(m + 1)) if many else None
            for q in many:
                who = left[np.append(j[ends[q] : ends[q + 1]], q)]
                dense[who] = True
                tops = _top(root, who)
                root[tops] = root[who] = tops.min()
            joined, open_ = bool(many), open_ - m
            left, mine, own = left[m:], mine[:, m:], own[:, m:]
    crowd = np.flatnonzero(dense)
    tops = _top(root, np.arange(n))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, tops[crowd], nodes[crowd])
    i, j = np.divmod(np.unique(np.concatenate([np.array([], dtype=np.int64), *pairs])), n)
    apart = tops[i] != tops[j]
    return list(zip(nodes[i[apart]].tolist(), nodes[j[apart]].tolist())), list(zip(least[tops[crowd]].tolist(), nodes[crowd].tolist()))


def candidates(prints: DataFrame, texts: int) -> DataFrame:
    """cell, node, other of (node, print), so many texts: pairs of nodes without a cell; nodes of a group with its least one, in both others; all nodes of a part that is too large, without other."""
    import xxhash

    picks = tables(texts).reshape(TABLES, -1, len(tables(texts)[0]))
    # an outermost cell of the grid holds one in 2 ** segments of unrelated points
    few, crowd = FEW, max(CROWD, texts * 4 >> picks.shape[2])
    schema = pa.schema([("cell", pa.int64()), ("node", pa.int64()), ("other", pa.int64())])

    def rows_of(cell: int, blocks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(blocks, axis=1)
        blocks.clear()
        nodes, bits = rows[0], rows[1:].view(np.uint64)
        if len(nodes) < 2:
            return
        large = []

        def parts() -> Iterator[np.ndarray]:
            points = grid_points(bits)
            for t, pick in enumerate(picks[cell // 3**WIDE, :, WIDE:]):
                for k, part in enumerate(parts_of(points, pick)):
                    if len(part) <= crowd:
                        yield part
                    else:
                        name = np.uint64(xxhash.xxh64_intdigest(np.array([cell, t, k]).tobytes())).astype(np.int64)
                        large.extend((int(name), node, None) for node in nodes[part].tolist())

        pairs, groups = meet(nodes, bits, few, parts())
        found = [(None, a, b) for a, b in pairs] + [(g, k, g) for g, k in groups] + large
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[at : at + 10_000])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            rows = np.stack([batch.column(c).to_numpy() for c in range(1, 2 + FIRST)])
            starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1)).tolist()
            for a, b in zip(starts, starts[1:] + [len(cells)]):
                if cells[a] != now:
                    if blocks:
                        yield from rows_of(now, blocks)
                    now, blocks = int(cells[a]), []
                blocks.append(rows[:, a:b])
        if blocks:
            yield from rows_of(now, blocks)

    dealt = grid_cells(prints, picks[:, 0, :WIDE]).repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "cell long, node long, other long")


def together(met: DataFrame) -> DataFrame:
    """cell, node, central of what ``candidates`` gives: groups of several tables that share a text are one, so a text is in one; parts that are too large stay apart."""
    spans = met.where("cell IS NOT NULL")
    central = spans.groupBy("node").agg(F.count("*").alias("central"))
    least = spans.where("other IS NOT NULL").groupBy("node").agg(F.collect_set("other").alias("least"))  # one a table at most
    one = components(least.select(F.explode(F.concat(F.array("node"), "least")).alias("a"), F.array_min("least").alias("b")))
    cells = one.select(F.col("root").alias("cell"), "node").unionByName(spans.where("other IS NULL").select("cell", "node"))
    out = cut(cells.join(central, "node").select("cell", "node", "central"))
    drop(one)
    return out


def close(shared, left, right, similarity: float = SIMILARITY):
    """Whether sets of these sizes with so many common elements are similar enough; in whole numbers, so exact at the edge."""
    return shared * 1000 >= round(similarity * 1000) * (left + right - shared)


def links(nodes: list[int], labels: list[int], asks: list[bool], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets of different labels, one of each with ``asks``: enough to join all labels that any such pair joins."""
    sizes = np.array([len(s) for s in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    having, ends = owner[order], np.searchsorted(flat[order], np.arange(len(ids) + 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, of = np.unique(np.array(labels), return_inverse=True)
    out = []
    for q in np.flatnonzero(asks).tolist():
        counts = np.zeros(len(sets), dtype=np.int64)
        own = flat[starts[q] : starts[q + 1]]
        for at in range(0, len(own), BLOCK):
            counts += np.bincount(np.concatenate([having[ends[i] : ends[i + 1]] for i in own[at : at + BLOCK]]), minlength=len(sets))
        for other in np.flatnonzero(close(counts, sizes, sizes[q]) & (of != of[q])).tolist():
            if of[other] != of[q]:
                out.append((nodes[q], nodes[other]))
                of[of == of[other]] = of[q]
        if (of == of[q]).all():
            break
    return out


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, size, shingles of (node, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingles(words_of(t or ""))).view(np.int64) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], dtype=np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.array([], dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists], names=["node", "size", "shingles"])

    return texts.select("node", "t").mapInArrow(run, "node long, size int, shingles array<long>")


def _blocks(cells: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: links that the comparison with central texts left open, from cells whose texts lie in several components.

    ``cells`` is (cell, node, hub).  The texts outside the hub's component ask
    all of their cell; both sides are dealt to as many blocks as their shingles
    need, and each two blocks meet in a task.
    """
    label = labels.select("node", F.col("root").alias("label"))
    hubs = labels.select(F.col("node").alias("hub"), F.col("root").alias("hub_label"))
    known = cells.join(sets.select("node", "size"), "node").join(label, "node", "left").join(hubs, "hub", "left")
    known = known.select("cell", "node", "size", F.coalesce("label", "node").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label")).withColumn("asks", F.col("label") != F.col("hub_label"))
    parts = lambda n: F.ceil(n / ROOM).cast("int")
    mixed = known.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("open"), parts(F.sum("size")).alias("all"), parts(F.sum(F.when(F.col("asks"), F.col("size")))).alias("asking"))
    mixed = mixed.where("n > 2 AND open > 0").drop("n", "open")  # of two, both have been compared
    met = known.join(mixed, "cell")
    number = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = met.where("asks").select("cell", "node", "label", "asks", number("asking", 1).alias("i"), every("all").alias("j"))
    asked = met.select("cell", "node", "label", F.lit(False).alias("asks"), every("asking").alias("i"), number("all", 2).alias("j"))
    both = asking.unionByName(asked).groupBy("cell", "i", "j", "node").agg(F.first("label").alias("label"), F.max("asks").alias("asks"))

    def compare(rows):
        import pandas as pd

        found = links(rows["node"].tolist(), rows["label"].tolist(), rows["asks"].tolist(), [np.asarray(x) for x in rows["shingles"]])
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64")

    return both.join(sets, "node").groupBy("cell", "i", "j").applyInPandas(compare, "a long, b long")


def linked(listed: DataFrame, cells: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root over links of similar texts; ``listed`` is (node, other), ``cells`` (cell, node, central) of cells with several nodes, ``texts`` (node, t)."""
    sets = cut(shingle_sets(texts))
    hubs = cells.groupBy("cell").agg(F.max(F.struct("central", F.col("node").alias("hub"))).alias("top"))
    placed = cut(cells.join(hubs, "cell").select("cell", "node", F.col("top.hub").alias("hub")))
    pairs = placed.where("node <> hub").select("node", "hub").unionByName(listed.withColumnRenamed("other", "hub"))
    pairs = pairs.select(F.least("node", "hub").alias("node"), F.greatest("node", "hub").alias("hub")).distinct()
    mine, other = sets.toDF("node", "size", "own"), sets.toDF("hub", "hub_size", "theirs")
    # sizes alone rule out most texts of different length
    near = pairs.join(mine.select("node", "size"), "node").join(other.select("hub", "hub_size"), "hub").where(close(F.least("size", "hub_size"), F.col("size"), F.col("hub_size"))).select("node", "hub")
    shared = F.size(F.array_intersect("own", "theirs"))
    star = cut(near.join(mine, "node").join(other, "hub").where(close(shared, F.col("size"), F.col("hub_size"))).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    first = components(star)
    more = cut(_blocks(placed, sets, first))
    out = first
    if not more.isEmpty():
        out = components(star.unionByName(more))
        drop(first)
    drop(sets, placed, star, more)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies stays, with all its columns."""
    name = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    keyed = docs.where(F.col(key).isNotNull()).select(name.alias("id"), F.col(text).alias("t"))

    def one(t: str) -> tuple:
        words = words_of(t)
        return node_of(words), fingerprint(shingles(words))

    marked = map_text(keyed, "id", "t", one, [("node", "long"), ("print", "binary")])
    distinct = cut(marked.groupBy("node").agg(F.min("id").alias("id"), F.min("print").alias("print")))
    prints = distinct.where("print IS NOT NULL")
    met = cut(candidates(prints, prints.count()))
    listed, cells = met.where("cell IS NULL").select("node", "other"), together(met)
    some = met.select(F.explode(F.array("node", "other")).alias("node")).where("node IS NOT NULL").distinct()
    asked = distinct.select("node", "id").join(some, "node")
    texts = keyed.join(asked, "id").groupBy("node").agg(F.first("t").alias("t"))
    roots = linked(listed, cells, texts)
    least = distinct.select("node", "id").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("id").alias("id"))
    stay = cut(least.select(F.col("id.key").alias("_stay"), F.col("id.hash").alias("_hash")))
    drop(distinct, met, cells, roots)
    mark = "_hash"
    while mark in docs.columns:
        mark += "_"
    hashed = docs.withColumn(mark, F.xxhash64(text))
    kept = hashed.join(stay, (hashed[key] == stay["_stay"]) & (hashed[mark] == stay["_hash"]), "left_semi").dropDuplicates([key, mark])
    return kept.drop(mark).unionByName(docs.where(F.col(key).isNull()))
