"""Byte-level BPE by DuckDB recursive queries, one database per partition.

A text is cut by the pre-tokenisation pattern.  The distinct pieces of a batch
that are not yet known become token-position rows; a recursive query joins
neighbouring positions with the merge table and contracts each piece's
leftmost pair of least rank until none is left.  Decoding joins ids with the
vocabulary and aggregates the bytes in order.

Pieces beyond SHORT bytes are first cut where no token of the vocabulary can
reach across, which changes nothing.  What is still longer goes through a
second recursive query with the same rule: it contracts all places of a word's
least rank in one round, from left to right, unless a merge there would open a
pair of lesser rank, which then comes next.  A query holds the rows of all its
rounds, so words share one only up to ROOM rows, and rounds beyond that are
taken up by a further query from where the last one stopped.  So a worker's
memory is bounded, whatever the length of a piece.

Defined results: a null or empty text has no ids and decodes to no bytes;
repeated rows each give their row; an empty table gives an empty table; of
pairs with the same rank (a tie) the leftmost goes first.  A text of any length
is held as one value.  Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame


#: pieces of up to this many bytes go through the plain contraction
SHORT = 64
#: pieces in one recursive query, at most
CHUNK = 25_000
#: rows that the rounds of one recursive query may hold, about
ROOM = 2_000_000
#: pieces that a worker remembers; more clear its memory
MEMO = 600_000

_CONTRACT = """
WITH RECURSIVE step(it, w, pos, id, npos, nid) AS (
  SELECT 0::INTEGER, w, pos, id, npos, nid FROM base
  UNION ALL
  SELECT s.it + 1, s.w, s.pos,
    CASE WHEN s.pos = b.pos THEN b.merged ELSE s.id END,
    CASE WHEN s.pos = b.pos THEN r.npos ELSE s.npos END,
    CASE WHEN s.pos = b.pos THEN r.nid WHEN s.npos = b.pos THEN b.merged ELSE s.nid END
  FROM step s
  JOIN (
    SELECT w, (least_ & 4095)::INTEGER AS npos, ((least_ >> 12) & 4095)::INTEGER AS pos, (least_ >> 24)::INTEGER AS merged
    FROM (
      SELECT c.w, min((m.merged::BIGINT << 24) | (c.pos << 12) | c.npos) AS least_
      FROM step c JOIN merges m ON m.pair = (c.id::BIGINT << 20 | c.nid) GROUP BY c.w
    )
  ) b ON s.w = b.w
  JOIN step r ON r.w = b.w AND r.pos = b.npos
  WHERE s.pos <> b.npos
), last AS (SELECT w, max(it) AS it FROM step GROUP BY w)
SELECT s.w, s.pos, s.id FROM step s JOIN last USING (w, it) ORDER BY s.w, s.pos
"""
#: as _CONTRACT for words of any length: all places of the least rank in one round, for a limited number of rounds
_CONTRACT_LONG = """
WITH RECURSIVE step(it, w, pos, id, npos, nid, pid, nnid) AS (
  SELECT 0::INTEGER, w, pos, id, lead(pos) OVER o, lead(id) OVER o, lag(id) OVER o, lead(id, 2) OVER o FROM base WINDOW o AS (PARTITION BY w ORDER BY pos)
  UNION ALL
  SELECT it + 1, w, pos, id, lead(pos) OVER o, lead(id) OVER o, lag(id) OVER o, lead(id, 2) OVER o
  FROM (
    SELECT s.it, s.w, s.pos, coalesce(b.merged, s.id) AS id
    FROM step s
    JOIN (SELECT DISTINCT c.w FROM step c JOIN merges m ON m.pair = (c.id::BIGINT << 20 | c.nid)) live ON live.w = s.w
    LEFT JOIN (
      SELECT w, unnest([pos, npos]) AS pos, unnest([merged, -1]) AS merged
      FROM (
        SELECT *, coalesce(sum(opens) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened
        FROM (
          SELECT l.w, l.pos, l.npos, l.merged,
            CASE WHEN l.hazard AND (least(coalesce(x.merged, l.merged), coalesce(y.merged, l.merged), coalesce(z.merged, l.merged)) < l.merged) THEN 1 ELSE 0 END AS opens
          FROM (
            SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY pos) AS k
            FROM (
              SELECT *, sum(CASE WHEN pos = before THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY pos) AS run
              FROM (
                SELECT *, lag(npos) OVER (PARTITION BY w ORDER BY pos) AS before
                FROM (
                  SELECT c.w, c.pos, c.npos, c.pid, c.nnid, m.merged, m.hazard, min(m.merged) OVER (PARTITION BY c.w) AS lowest
                  FROM step c JOIN merges m ON m.pair = (c.id::BIGINT << 20 | c.nid)
                )
                WHERE merged = lowest
              )
            )
          ) l
          LEFT JOIN merges x ON l.hazard AND x.pair = (l.pid::BIGINT << 20 | l.merged)
          LEFT JOIN merges y ON l.hazard AND y.pair = (l.merged::BIGINT << 20 | l.nnid)
          LEFT JOIN merges z ON l.hazard AND z.pair = (l.merged::BIGINT << 20 | l.merged)
          WHERE l.k % 2 = 1
        )
      )
      WHERE opened = 0
    ) b ON b.w = s.w AND b.pos = s.pos
    WHERE s.it < {rounds} AND coalesce(b.merged, 0) >= 0
  ) WINDOW o AS (PARTITION BY w ORDER BY pos)
), last AS (SELECT w, max(it) AS it FROM step GROUP BY w)
SELECT s.w, s.pos, s.id, s.it FROM step s JOIN last USING (w, it) ORDER BY s.w, s.pos
"""
_DECODE = "SELECT t.w, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocabulary v USING (id) GROUP BY t.w ORDER BY t.w"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes and a number on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _classes(test) -> str:
    """A character class for the code points below U+0250 that pass ``test``."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if test(chr(i)))


_SPACE = "\\t-\\r \\x85\\xa0"
_LETTER = _classes(lambda c: unicodedata.category(c)[0] == "L")
_NUMBER = _classes(lambda c: unicodedata.category(c)[0] == "N")
#: the public pattern for texts below U+0250, for the faster engine
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\0-ɏ]")


class Pieces:
    """Cuts texts by a pattern; the given public pattern has a faster form for Latin text."""

    def __init__(self, pattern: str, fast: bool):
        import regex

        # white space as the Unicode property has it
        self.full = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.fast = fast

    def __call__(self, text: str) -> list[str]:
        if self.fast and not _BEYOND.search(text):
            return _LATIN.findall(text)
        return [m[0] for m in self.full.finditer(text)]


def merge_table(ranks: dict[bytes, int]) -> tuple:
    """(left << 20 | right, merged, hazard) for every split of a token into two tokens, as arrays.

    A merged token is a hazard if some pair that holds it has a lesser rank than it.
    """
    import numpy as np

    pairs, merged = array("q"), array("i")
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs.append(a << 20 | b)
                merged.append(rank)
    pair, to = np.frombuffer(pairs, np.int64), np.frombuffer(merged, np.int32)
    left, right = pair >> 20, pair & ((1 << 20) - 1)
    return pair, to, np.isin(to, np.concatenate([left[to < left], right[to < right]]))


def bounded(words: list[bytes], room: int, most: int) -> Iterator[list[bytes]]:
    """Groups of words whose squared lengths come to ``room`` at most, or of one word."""
    ends = list(accumulate(len(w) ** 2 for w in words))
    at = 0
    while at < len(words):
        stop = bisect_right(ends, (ends[at - 1] if at else 0) + room)
        stop = max(at + 1, min(stop, at + most))
        yield words[at:stop]
        at = stop


class Codec:
    """One partition's database with the merge table and the vocabulary, and what it has encoded so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, fast: bool = False, merges: tuple | None = None):
        import duckdb
        import numpy as np

        self.ranks, self.cut = ranks, Pieces(pattern, fast)
        self.known: dict[str, tuple[bytes, bytes]] = {}  # piece: ids, decoded bytes
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        pairs, merged, hazard = merges or merge_table(ranks)
        self.starts: set[bytes] = set()  # of tokens; filled when a long piece is met
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._load("merges", pair=pairs, merged=merged, hazard=hazard)
        self._load("vocabulary", id=np.fromiter(ranks.values(), np.int32), hex=[t.hex() for t in ranks])

    def close(self) -> None:
        """Ends the database and hands memory back to the system, since Spark keeps the worker for other tasks."""
        import ctypes

        self.con.close()
        self.known.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    def _load(self, name: str, **columns) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces and decodes their ids again, by queries."""
        ranks, found, cuts = self.ranks, {}, {}
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = [raw for raw in raws if raw in ranks]
        found.update(zip(whole, map(struct.Struct("<I").pack, map(ranks.__getitem__, whole))))
        short = [raw for raw in raws if raw not in found and len(raw) <= SHORT]
        long = []
        for raw in raws:
            if len(raw) > SHORT and raw not in found:
                cuts[raw] = self.segments(raw)
        for raw in dict.fromkeys(x for cut in cuts.values() for x in cut):
            if (rank := ranks.get(raw)) is not None:
                found[raw] = struct.pack("<I", rank)
            else:
                (short if len(raw) <= SHORT else long).append(raw)
        for group in bounded(list(dict.fromkeys(short)), 2 * ROOM, CHUNK):
            self._contract(group, found, _CONTRACT, None)
        for group in bounded(long, 2 * ROOM, CHUNK):
            rounds = max(2, ROOM // sum(map(len, group)))
            self._contract(group, found, _CONTRACT_LONG.format(rounds=rounds), rounds)
        for raw, cut in cuts.items():
            found[raw] = b"".join(map(found.__getitem__, cut))
        ids = list(map(found.__getitem__, raws))
        self.known.update(zip(pieces, zip(ids, self.decode(ids))))

    def segments(self, raw: bytes) -> list[bytes]:
        """The piece, cut wherever no token of the vocabulary that occurs in it reaches across: no merge can either."""
        if not self.starts:
            self.starts = {token[:i] for token in self.ranks for i in range(2, len(token) + 1)}
        starts, ranks = self.starts, self.ranks
        out, begin, reach = [], 0, 0
        for at in range(len(raw)):
            if reach <= at and at > begin:
                out.append(raw[begin:at])
                begin = at
            end = at + 2
            while (part := raw[at:end]) in starts and len(part) == end - at:
                if end > reach and part in ranks:
                    reach = end
                end += 1
        out.append(raw[begin:])
        return out

    def _contract(self, words: list[bytes], found: dict[bytes, bytes], query: str, rounds: int | None) -> None:
        """Adds the ids of each word; what a limited query leaves open is taken up again."""
        import numpy as np

        sizes = np.fromiter(map(len, words), np.int32, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        while len(w):
            last = np.append(w[1:] != w[:-1], True)  # of its word; the others have a right neighbour
            self._load("base", w=w, pos=pos, id=ids, npos=pa.array(np.roll(pos, -1), mask=last), nid=pa.array(np.roll(ids, -1), mask=last))
            got = self.con.execute(query).fetchnumpy()
            w, pos, ids = (np.asarray(got[c]).astype(np.int32) for c in ("w", "pos", "id"))
            if rounds is None:
                done = np.ones(len(w), dtype=bool)
            else:
                done = np.asarray(got["it"]) < rounds
            own, data = w[done], ids[done].astype("<u4").tobytes()
            first = np.flatnonzero(np.diff(own, prepend=-1))
            for i, a, b in zip(own[first].tolist(), (first * 4).tolist(), (np.append(first[1:], len(own)) * 4).tolist()):
                found[words[i]] = data[a:b]
            w, pos, ids = w[~done], pos[~done], ids[~done]

    def decode(self, many: list[bytes]) -> list[bytes]:
        """Bytes of many id lists (little-endian unsigned 32-bit), by ordered aggregation."""
        import numpy as np

        sizes = np.fromiter((len(x) // 4 for x in many), np.int64, len(many))
        ids = np.frombuffer(b"".join(many), "<u4").astype(np.int32)
        w = np.repeat(np.arange(len(many), dtype=np.int32), sizes)
        pos = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self._load("tokens", w=w, pos=pos, id=ids)
        out = [b""] * len(many)
        got = self.con.execute(_DECODE).fetchnumpy()
        for i, text in zip(np.asarray(got["w"]).tolist(), got["hex"]):
            out[i] = bytes.fromhex(text)
        return out

    def forget(self) -> None:
        """Keeps the pieces of up to three ids, which are the frequent ones, unless they fill half the room themselves."""
        kept = {p: x for p, x in self.known.items() if len(x[0]) <= 12}
        self.known = kept if len(kept) <= MEMO // 2 else {}

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text; ids as little-endian unsigned 32-bit."""
        at = 0
        while at < len(texts):
            cuts, fresh = [], set()
            while at < len(texts) and len(fresh) < CHUNK:
                cuts.append(self.cut(texts[at]))
                fresh.update(set(cuts[-1]).difference(self.known))
                at += 1
            if fresh:
                if len(self.known) + len(fresh) > MEMO:
                    self.forget()
                    fresh = set().union(*cuts).difference(self.known)  # what follows must be known together
                fresh = list(fresh)
                for i in range(0, len(fresh), CHUNK):
                    self.learn(fresh[i : i + CHUNK])
            look = self.known.__getitem__
            for c in cuts:
                ids, plain = zip(*map(look, c)) if c else ((), ())
                yield b"".join(ids), b"".join(plain)


def _share(spark, path: str):
    """The vocabulary and its merge table, of a fixed size, as a broadcast variable; the executors need not see the file."""
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((data, merge_table(load_ranks(data))))


def _codec(shared, pattern: str, fast: bool) -> Codec:
    data, merges = shared.value
    return Codec(load_ranks(data), pattern, fast, merges)


def _run(docs: DataFrame, path: str, pattern: str, key: str, text: str, fields, make) -> DataFrame:
    import public_tokenizers

    fast = pattern == public_tokenizers.PATTERN
    shared = _share(docs.sparkSession, path)
    source = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kinds = [_parse_datatype_string(k) for _, k in fields]
    schema = StructType([StructField(key, source.schema["k"].dataType)] + [StructField(n, k) for (n, _), k in zip(fields, kinds)])

    def run(batches):
        codec = _codec(shared, pattern, fast)
        try:
            for batch in batches:
                rows = [make(*pair) for pair in codec.encode([t or "" for t in batch.column(1).to_pylist()])]
                columns = list(zip(*rows)) if rows else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, to_arrow_type(k)) for c, k in zip(columns, kinds)], names=[key] + [n for n, _ in fields])
        finally:
            codec.close()

    return source.mapInArrow(run, schema)


def _list(ids: bytes) -> array:
    out = array("i", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of every whole text."""
    return _run(docs, path, pattern, key, text, [("ids", "array<int>")], lambda ids, _: (_list(ids).tolist(),))


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, bytes binary: the bytes of each list of ids; null for a null list."""
    shared = _share(tokens.sparkSession, path)
    source = tokens.select(tokens[key].alias("k"), tokens[ids].cast("array<int>").alias("i"))
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches):
        codec = _codec(shared, "", False)
        try:
            for batch in batches:
                lists = batch.column(1).to_pylist()
                done = codec.decode([struct.pack(f"<{len(x or [])}I", *(x or [])) for x in lists])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else y for x, y in zip(lists, done)], pa.binary())], names=[key, "bytes"])
        finally:
            codec.close()

    return source.mapInArrow(run, StructType([StructField(key, source.schema["k"].dataType), StructField("bytes", BinaryType())]))


def digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256."""

    def make(ids: bytes, plain: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest()

    return _run(docs, path, pattern, key, text, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], make)
