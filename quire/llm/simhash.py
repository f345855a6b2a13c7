"""SimHash near-duplicates by segment-popcount embedding.

Each distinct 64-bit fingerprint is mapped to the bit counts of its 32 segments
of 2 bits.  The Manhattan distance of two such points is a lower bound of the
Hamming distance, so linked fingerprints meet in the grid: points at distance
2 or less share a grid point that is at distance 1 or less from both.  Only
fingerprints that meet another one there go on to the exact check, which asks
the same of the bits themselves: at 2 or fewer differing bits there is a
common value at one bit or less from both.  At most 65 fingerprints can lie
that near to one value, so no group is large and no pairs are listed, yet
every link is kept in the components.

Defined results: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; repeated rows each give their row and share
a component; an empty table gives an empty table; a null key is never the name
of a component unless no row of it has another.  A bit set in exactly half of
the hashes (a tie) is 0.  A very long text is counted BLOCK shingles at a time.
Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._common import cut, map_text
from quire.llm.components import components

SHINGLE = 3
SEED = 42
#: shingles whose bits are counted at a time
BLOCK = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import numpy as np
    import xxhash

    # on bytes, lower() changes A-Z only and split() takes the blank and 9 to 13 only
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        block = np.array(hashes[at : at + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp: the fingerprint's 64 bits as a long."""

    def one(t: str) -> tuple:
        fp = fingerprint(t)
        return (fp - (1 << 64) if fp >> 63 else fp,)

    return map_text(docs, key, text, one, [("fp", "long")])


def _signed(bits: int):
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def grid_point(fp):
    """Counts of set bits, 0 to 2, in each pair of bits, in that pair's place."""
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(_signed(0x5555555555555555))
    low = fp.bitwiseAND(_signed(0x5555555555555555))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def links(distinct: DataFrame) -> DataFrame:
    """a, b: enough links between fingerprints at 2 or fewer differing bits to connect all that are linked."""
    own = F.col("own")
    pairs = F.array(*[_signed(1 << 2 * i) for i in range(32)])
    full = lambda s: s.bitwiseOR(F.shiftleft(s, 1))
    # 0 and 1 change into each other by the low bit, 1 and 2 by both bits
    low = F.transform(F.filter(pairs, lambda s: own.bitwiseAND(F.shiftleft(s, 1)) == 0), lambda s: own.bitwiseXOR(s))
    high = F.transform(F.filter(pairs, lambda s: own.bitwiseAND(full(s)) != 0), lambda s: own.bitwiseXOR(full(s)))
    near = distinct.select("fp", grid_point(F.col("fp")).alias("own")).select("fp", F.explode(F.concat(F.array(own), low, high)).alias("cell")).repartition("cell")  # made once, counted and joined where it lies
    shared = near.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    met = near.join(shared, "cell", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[_signed(1 << i) for i in range(64)])
    values = met.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("value"))
    group = values.groupBy("value").agg(F.collect_set("fp").alias("near")).where("size(near) > 1")  # 65 at most
    return group.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (the least key reachable over links)."""
    marked = cut(fingerprints(docs, key, text))
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays: the one that names it, and one row of that where rows repeat.

    A row without a key cannot be named and stays.
    """
    found = near_duplicates(docs, key, text)
    stay = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_stay")).distinct()
    kept = docs.join(stay, docs[key] == stay["_stay"], "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))
