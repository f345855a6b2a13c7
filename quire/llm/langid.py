"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time.  Texts
are cut into segments of SEGMENT bytes; two gated recurrent units read each in
both directions, every position gets label probabilities, and a document's
probabilities are the mean over all its positions.

Only text and its known label are learned from, on at most PER_LABEL documents
of a label, which a hash of the key picks and of which windows go to the
driver; predictions read whole texts and nothing else.

Defined results: ``und`` with score 0 if the text is null, has no letters, or
nothing could be learned; a label with few documents is learned from those;
repeated rows each give their row; an empty table gives an empty table; of
equally probable labels the first in sorted order is said.  A very long text is
read as its segments, ABREAST at a time.  Only the named columns are read, so
others cannot clash.  The labels themselves, one output of the network each,
are held by the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 96
#: documents of one label that are learned from, at most about
PER_LABEL = 1500
WINDOWS = 2
HIDDEN = 8
STEPS, BATCH, RATE = 240, 96, 0.02
#: segments that are read side by side
ABREAST = 4096
UNKNOWN = "und"
_LETTER = re.compile("[A-Za-z]")


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of one unit for each direction (tables by byte for the input, matrices for the state) and the output layer."""

    GATES = ("z", "r", "n")

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.w: dict[str, np.ndarray] = {}
        for way in "fb":
            for gate in self.GATES:
                self.w[f"{way}w{gate}"] = draw.normal(0, 0.3, (256, hidden)).astype(np.float32)
                self.w[f"{way}u{gate}"] = draw.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32)
        self.w["out"] = draw.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32)
        self.w["bias"] = np.zeros(len(labels), dtype=np.float32)

    def _read(self, way: str, columns: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States at each position, (length, segments, hidden); columns is (length, segments)."""
        w, length = self.w, len(columns)
        wz, wr, wn, uz, ur, un = (w[way + x] for x in ("wz", "wr", "wn", "uz", "ur", "un"))
        if keep is None:  # tanh gives the sigmoids; their halves go into the weights
            wz, wr, uz, ur = wz * 0.5, wr * 0.5, uz * 0.5, ur * 0.5
        states = np.empty((length, columns.shape[1], self.hidden), dtype=np.float32)
        h = np.zeros(states.shape[1:], dtype=np.float32)
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            b = columns[t]
            if keep is None:
                z = h @ uz
                z += wz.take(b, axis=0)
                np.tanh(z, out=z)
                r = h @ ur
                r += wr.take(b, axis=0)
                np.tanh(r, out=r)
                n = h @ un
                r += 1.0
                r *= n
                r *= 0.5
                np.add(r, wn.take(b, axis=0), out=n)
                np.tanh(n, out=n)
                h -= n
                z += 1.0
                h *= z
                h *= 0.5
                h += n
                states[t] = h
            else:
                z, r, a = _sigmoid(wz[b] + h @ uz), _sigmoid(wr[b] + h @ ur), h @ un
                n = np.tanh(wn[b] + r * a)
                keep.append((t, h, z, r, a, n))
                h = n + z * (h - n)
                states[t] = h
        return states

    def positions(self, segments: np.ndarray) -> np.ndarray:
        """Label probabilities at each position, (length, segments, labels)."""
        columns = np.ascontiguousarray(segments.T)
        shape = (*columns.shape, len(self.labels))
        k = self.hidden
        x = self._read("f", columns).reshape(-1, k) @ self.w["out"][:k]
        x += self._read("b", columns).reshape(-1, k) @ self.w["out"][k:]
        x += self.w["bias"]
        if self.steepest() > 60:  # else no exponential can leave the range
            x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x @ np.ones((x.shape[1], 1), dtype=np.float32)
        return x.reshape(shape)

    def steepest(self) -> float:
        """No label's logit is farther from zero, as states lie between -1 and 1."""
        return float((np.abs(self.w["out"]).sum(axis=0) + np.abs(self.w["bias"])).max())

    def gradients(self, segments: np.ndarray, lengths: np.ndarray, of: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss over all positions and its gradients, by backpropagation through time in both directions."""
        w, k = self.w, self.hidden
        columns = np.ascontiguousarray(segments.T)
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._read(way, columns, kept[way]) for way in "fb"], axis=2)
        logits = both @ w["out"] + w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        counts = (np.arange(len(columns))[:, None] < lengths) * (weight / lengths)
        truth = np.arange(len(of))
        loss = -float((np.log(np.maximum(p[:, truth, of], 1e-9)) * counts).sum() / weight.sum())
        p[:, truth, of] -= 1
        p *= (counts / weight.sum())[:, :, None]
        p = p.astype(np.float32)
        grads = {name: np.zeros_like(x) for name, x in w.items()}
        grads["out"] = both.reshape(-1, 2 * k).T @ p.reshape(-1, p.shape[2])
        grads["bias"] = p.sum(axis=(0, 1))
        back = p @ w["out"].T
        for way in "fb":
            above = back[:, :, :k] if way == "f" else back[:, :, k:]
            dh = np.zeros((columns.shape[1], k), dtype=np.float32)
            for t, h, z, r, a, n in reversed(kept[way]):
                dh = dh + above[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * a * r * (1 - r)
                da = dn * r
                for gate, d, du in (("z", dz, dz), ("r", dr, dr), ("n", dn, da)):
                    np.add.at(grads[f"{way}w{gate}"], columns[t], d)
                    grads[f"{way}u{gate}"] += h.T @ du
                dh = dh * z + dz @ w[way + "uz"].T + dr @ w[way + "ur"].T + da @ w[way + "un"].T
        return loss, grads

    def fit(self, segments: np.ndarray, lengths: np.ndarray, of: np.ndarray, steps: int = STEPS, seed: int = 7) -> float:
        """Adam over class-balanced batches; some windows are shortened, so that short texts are learned as well."""
        draw = np.random.default_rng(seed)
        m = {name: np.zeros_like(x) for name, x in self.w.items()}
        v = {name: np.zeros_like(x) for name, x in self.w.items()}
        groups = [np.flatnonzero(of == i) for i in range(len(self.labels))]
        loss = 0.0
        for step in range(1, steps + 1):
            pick = np.array([draw.choice(groups[i % len(groups)]) for i in range(BATCH)])
            x, n = segments[pick].copy(), lengths[pick].copy()
            short = draw.random(BATCH) < 0.3
            n[short] = np.maximum(1, np.minimum(n[short], draw.integers(8, SEGMENT, short.sum())))
            x[np.arange(SEGMENT) >= n[:, None]] = 0
            loss, grads = self.gradients(x, n, of[pick], np.ones(BATCH))
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for name, g in grads.items():
                g = g / max(1.0, norm)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                self.w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return loss


def cut_segments(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segments, segment count of each text): texts in turn, each filled up with zero bytes."""
    parts, counts = [], np.empty(len(raw), dtype=np.int64)
    for i, b in enumerate(raw):
        counts[i] = n = -(-len(b) // SEGMENT)
        parts += [b, bytes(n * SEGMENT - len(b))]
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SEGMENT), counts


def pooled(model: Network, texts: list[str]) -> np.ndarray:
    """Mean label probabilities over all positions of each whole text; zeros for an empty one."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), len(model.labels)))
    segments, counts = cut_segments(raw)
    owner = np.repeat(np.arange(len(raw)), counts)
    first = np.cumsum(counts) - counts
    sizes = np.array([len(b) for b in raw], dtype=np.int64)
    filled = np.minimum(SEGMENT, sizes[owner] - (np.arange(len(segments)) - first[owner]) * SEGMENT)
    for at in range(0, len(segments), ABREAST):
        block = slice(at, at + ABREAST)
        p = model.positions(segments[block])
        n = filled[block]
        if (part := np.flatnonzero(n < SEGMENT)).size:
            p[:, part] *= (np.arange(SEGMENT)[:, None] < n[part])[:, :, None]
        np.add.at(out, owner[block], p.sum(axis=0))
    return out / np.maximum(sizes, 1)[:, None]


def has_letters(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = PER_LABEL) -> Network | None:
    """Fits a network on windows of a hash-picked share of each label's documents that are not held out."""
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")).where("k IS NOT NULL AND l IS NOT NULL").where(F.pmod(F.crc32(F.col("k").cast("string")), F.lit(4)) != 2)
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    if not counts:
        return None
    dice = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1_000_003))
    share = F.create_map([x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1_000_003, 1 + 1_000_003 * per_label // n)))])
    picked = known.where(F.col("t").isNotNull() & (dice < share[F.col("l")]))
    room = F.greatest(F.lit(1), F.length("t") - SEGMENT + 1)
    windows = [F.substring(F.col("t"), (F.pmod(F.xxhash64("k", F.lit(i)), room) + 1).cast("int"), F.lit(SEGMENT)) for i in range(WINDOWS)]
    rows = sorted({(r["l"], x) for r in picked.select("l", F.array(*windows).alias("x")).collect() for x in r["x"] if has_letters(x)})
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    raw = [x.encode("utf-8", "surrogatepass")[:SEGMENT] for _, x in rows]
    segments, _ = cut_segments(raw)
    model = Network(labels)
    if len(labels) > 1:
        model.fit(segments, np.array([len(b) for b in raw]), np.array([labels.index(r[0]) for r in rows]))
    return model


def predict(docs: DataFrame, model: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 50 KB
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False)).alias("h"), F.col(text).alias("t"))
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t if t is not None and has_letters(t) else "" for t in part.column(2).to_pylist()]
                if net is None:
                    said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                else:
                    p = pooled(net, texts)
                    best = p.argmax(axis=1)
                    said = [net.labels[i] if t else UNKNOWN for t, i in zip(texts, best.tolist())]
                    score = np.clip(p[np.arange(len(best)), best], 0, 1).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, StructType([StructField(key, source.schema["k"].dataType), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Trains on the documents that are not held out and predicts all of them."""
    return predict(docs, train(docs, key, text, label), key, text)


def keep_known(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", floor: float = 0.35) -> DataFrame:
    """The documents, with all columns, whose language is found with a score of ``floor`` or more.

    If nothing could be learned, every document with a letter stays.
    """
    model = train(docs, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        net, out = shared.value, []
        values = [t if t is not None and has_letters(t) else "" for t in texts]
        for at in range(0, len(values), 1000):
            part = values[at : at + 1000]
            out.append(pooled(net, part).max(axis=1) if net is not None else np.array([float(bool(t)) for t in part]))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.where(score(F.col(text)) >= floor)
