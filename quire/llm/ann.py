"""Approximate nearest neighbours by collision counting.

Rows are projected on many random lines.  A query takes the lines on which it
lies furthest out itself and opens a window on each, from the line's end
inwards; virtual rehashing moves all inner ends further in.  Rows near the query
lie far out on these lines too, most others do not, so windows hold few rows and
a row is verified by its exact inner product once it has collided OFTEN times.
Given the query's place on a line, that of a row follows from their angle alone,
whatever the other rows are.  Windows stop growing when a vector as near as the
k-th best verified one has collided so often with probability SURE; nearer ones
have with a greater one.

Queries meet all rows in blocks of about ROWS, and each block gives a query
its best k, so neither a group of equal vectors nor a common id makes a task
large.  Rows are dealt to blocks at random, so a block holds few of the best k of
all: its windows stop at as many as it holds at most with probability 0.999, and
the more blocks there are, the fewer rows each counts for a query.  Every query
still meets every block: the cost is queries times rows, times a share that falls.
Inner products become angles by one added coordinate that brings all of a
block's vectors to one length.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id; vectors of different
lengths are not compared; a query id that repeats is asked once; a candidate
row that repeats counts each time; ties go to the smaller id; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: lines, and how many of them a query takes
LINES, OUTER = 1024, 48
#: collisions after which a row is verified
OFTEN = 6
#: least probability with which each of the best k is verified
SURE = 0.95
#: first inner end of the windows, in deviations of a line's projections, and by how much it moves inwards
START, STEP = 1.8, 0.2
ROWS, QUERIES = 8192, 4096
#: a normal variable's distribution function at steps of 1/256
GRID = np.linspace(-9.0, 9.0, 4609)
BELOW = np.array([NormalDist().cdf(x) for x in GRID])


def at_least(times: int, of: int, p: float) -> float:
    """Probability of that many successes or more."""
    return 1.0 - sum(math.comb(of, i) * p**i * (1 - p) ** (of - i) for i in range(times))


@cache
def enough(lines: int = OUTER, often: int = OFTEN, sure: float = SURE) -> float:
    """Mean probability of a collision on one of a query's lines at which a row collides on ``often`` of them with probability ``sure``.

    It is that of equal probabilities; unequal ones of one mean, above ``often``, spread less.
    """
    low, high = 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        low, high = (p, high) if at_least(often, lines, p) < sure else (low, p)
    return high


@cache
def share(k: int, parts: int, sure: float = 0.999) -> int:
    """How many of the best k one of ``parts`` blocks holds at most, with probability ``sure``, if rows are dealt at random."""
    return next(i for i in range(1, k + 1) if i == k or at_least(i + 1, k, 1 / parts) <= 1 - sure)


class Block:
    """One block's vectors with their projections, by lines."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        largest = np.abs(vectors).max()
        unit = vectors / largest
        squares = (unit * unit).sum(axis=1)
        unit = np.column_stack([unit, np.sqrt(squares.max() - squares)]) / np.sqrt(squares.max())
        self.length = float(largest * np.sqrt(squares.max()))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, lines))
        self.flat = self.axes.T.astype(np.float32) @ unit.T.astype(np.float32)
        self.last = float(np.abs(self.flat).max())
        self.rings: list = []

    def _ring(self, level: int) -> tuple[np.ndarray, list]:
        """What windows of this level add to those of the one before: the rows, line by line, and where each line's begin.

        Lines come twice: as they are and reversed.  A ring is made when a query first needs it.
        """
        while level >= len(self.rings):
            ends = self.ends(len(self.rings))
            found = [np.divmod(np.flatnonzero((flat > ends[0]) & (flat <= ends[1])), len(self.ids)) for flat in (self.flat, -self.flat)]
            line = np.concatenate([found[0][0], found[1][0] + len(self.flat)])
            self.rings.append((np.concatenate([found[0][1], found[1][1]]), np.searchsorted(line, np.arange(2 * len(self.flat) + 1)).tolist()))
        return self.rings[level]

    def ends(self, level: int) -> tuple[float, float]:
        """A level's inner end and that of the level before; the last level takes in all rows."""
        low = START - STEP * level
        return (low if low > -self.last else -np.inf), (START - STEP * (level - 1) if level else np.inf)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, parts: int = 1):
        """For each query the positions and products of its k best rows: best first, ties to the smaller id.

        With ``parts`` blocks, to which rows are dealt at random, windows grow for this block's share of the k; a small block looks for all k.
        """
        wanted = share(k, parts) if len(self.ids) >= 16 * k else k
        for i in range(0, len(queries), 256):
            yield from self._search(queries[i : i + 256], own[i : i + 256], k, wanted)

    def _search(self, queries: np.ndarray, own: np.ndarray, k: int, wanted: int):
        n, lines = len(self.ids), len(self.flat)
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        norms = np.sqrt((queries * queries).sum(axis=1))
        centres = unit @ self.axes[:-1]
        outer = np.argpartition(np.abs(centres), lines - OUTER, axis=1)[:, lines - OUTER :]
        centres = np.take_along_axis(centres, outer, axis=1)
        sides = outer + lines * (centres < 0)
        for q, centre in enumerate(np.abs(centres)):
            counts, new = np.zeros(n, dtype=np.int64), self.ids != own[q]
            near, rough = np.empty(0, dtype=np.int64), np.empty(0)  # the verified rows and their fast products
            low, level = np.inf, 0
            while low > -np.inf:
                low = self.ends(level)[0]
                rows, starts = self._ring(level)
                counts += np.bincount(np.concatenate([rows[starts[s] : starts[s + 1]] for s in sides[q].tolist()]), minlength=n)
                level += 1
                more = np.flatnonzero(new & (counts >= OFTEN))
                if len(more):
                    new[more] = False
                    near, rough = np.concatenate([near, more]), np.concatenate([rough, self.vectors.take(more, axis=0) @ queries[q]])
                if len(near) >= wanted:
                    cosine = np.partition(rough, -wanted)[-wanted] / (norms[q] * self.length)
                    reached = (cosine * centre - low) / math.sqrt(max(1e-12, 1.0 - cosine * cosine))
                    if np.interp(reached, GRID, BELOW).mean() >= enough():
                        break
            if len(near) > k:  # what may be among the best; a fast product's rounding is far below the margin
                near = near[rough >= np.partition(rough, -k)[-k] - 1e-9 * norms[q] * self.length]
            products = (self.vectors[near] * queries[q]).sum(axis=1)
            best = np.lexsort((self.ids[near], -products))[:k]
            yield near[best], products[best]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (doubles) of the rows that take part."""
    out = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``df`` with the largest inner product found for each query."""
    rows = usable(df, key, vector)
    asked = usable(queries, key, vector).dropDuplicates(["id"])
    n, m = rows.count(), asked.count()
    parts, turns = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    number = F.monotonically_increasing_id()
    left = rows.withColumn("part", F.pmod(F.xxhash64(number), F.lit(parts)).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(turns)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(a, b):
        import pandas as pd

        asked, found_ids, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(a) and len(b):
            sizes, wants = a["v"].map(len), b["v"].map(len)
            for size in sorted(set(sizes) & set(wants)):
                own, ask = a[sizes == size], b[wants == size]
                block = Block(own["id"].to_numpy(np.int64), np.stack(own["v"].to_numpy()).astype(np.float64))
                ids = ask["id"].to_numpy(np.int64)
                for q, (at, score) in zip(ids, block.search(np.stack(ask["v"].to_numpy()).astype(np.float64), ids, k, parts)):
                    asked.append(np.full(len(at), q))
                    found_ids.append(block.ids[at])
                    scores.append(score)
        return pd.DataFrame({"query_id": np.concatenate(asked), "vec_id": np.concatenate(found_ids), "score": np.concatenate(scores)})

    found = left.groupBy("part", "turn").cogroup(right.groupBy("part", "turn")).applyInPandas(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
