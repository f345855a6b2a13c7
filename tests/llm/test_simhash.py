import random
import re

import xxhash

from quire.llm import queries, simhash
from quire.llm._common import LOWER, UPPER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Least key of each component, by comparing all fingerprints."""
    values = sorted(set(fps.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for key, v in fps.items():
        least[find(v)] = min(key, least.get(find(v), key))
    return {key: least[find(v)] for key, v in fps.items()}


def test_query_by_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fps = {i: plain(t) for i, t in texts.items()}
    expected = classes(fps)
    rows = queries.op6_simhash(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", expected[r["doc_id"]])
    assert len(set(expected.values())) < len(expected)


def test_links_of_planted_fingerprints(spark):
    draw = random.Random(4)
    values = []
    for _ in range(40):
        v = draw.getrandbits(64)
        values.append(v)
        for flips in (1, 2, 2, 3):
            w = v
            for b in draw.sample(range(64), flips):
                w ^= 1 << b
            values.append(w)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = sorted(set(map(signed, values)))
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in found:
        root[find(r["a"])] = find(r["b"])
    expected = classes({v: v & (1 << 64) - 1 for v in values})
    groups, wanted = {}, {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
        wanted.setdefault(expected[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[5] == by[6] == by[None]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 7, 8, 9, 10]
    assert simhash.keep_one(none).count() == 0
