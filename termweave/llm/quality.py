"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network in numpy.

Words are runs of letters, digits or signs, and every word has a vector of unit length.  That of the
VOCABULARY most frequent ones of the corpus (counted over all texts) is the sum of the sparse random
index vectors of their neighbours in all texts (one pass, one partial matrix a task, added in a tree of
two levels by block); a rarer word, whose few neighbours would tell little, has its own index vector, a
function of its hash.  A document is pooled from all its words' vectors alone: their mean, their root mean
square, and the mean product of each with the one a few words later, which tells running text from
lists and repetitions.  The network is fitted on at most SAMPLE labelled rows,
those with the least hash of their id; a fifth of them only sets the temperature of the probabilities.

Cases: null and empty texts have a zero vector and get the network's score for it; null ids are kept and not held out; repeated rows are scored each; labels that are null
or not 0/1 are left out, several labels of one id count as their minimum; with labels of one kind only
the score is their smoothed share, with none 0.5; empty tables give an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, save, scratch
from .kernels import U64, class_runs, mix, slices, text_bytes

#: Words with a vector of their neighbours, at most, and words that a task gathers before it sends partial counts.
VOCABULARY, FLUSH = 1 << 15, 1_000_000
DIM, NONZERO, WINDOW, BLOCKS = 48, 4, 2, 16
#: Distances at which a word's vector is multiplied with a later one's, and numbers that describe a document.
LAGS = (1, 2, 3, 4, 6)
WIDTH = 2 * DIM + len(LAGS)
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 12_000
#: Classes of bytes: 0 separates, 1 capitals, 2 other letters, 3 digits, 4 other signs.
CLASSES = np.full(256, 4, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
CLASSES[65:91] = 1
CLASSES[97:123] = CLASSES[128:] = 2
CLASSES[48:58] = 3


def _words(col):
    """Hashes of the words of each slice of a column of texts, and where each text's words start."""
    raw, offs = text_bytes(col)
    for i, j in slices(offs):
        yield class_runs(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], CLASSES)


def _rows_of(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each word among the known ones (ascending hashes), else their number."""
    code, own = pd.factorize(hashes)
    at = np.searchsorted(known, own)
    if len(known):
        at[known[np.minimum(at, len(known) - 1)] != own] = len(known)
    return at[code]


def vocabulary(texts: DataFrame, most: int = VOCABULARY) -> np.ndarray:
    """Ascending hashes of the most frequent words of all texts (rows of one column); ties fall to the hash."""

    def partial(batches):
        held, n = [], 0

        def flush():
            code, own = pd.factorize(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(code, minlength=len(own)))], ["word", "n"])

        for b in batches:
            for h, _ in _words(b.column(0)):
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    per = texts.mapInArrow(lean(partial), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # what is asked of each partition in order must not grow with their number: only words of the top
    # counts, told by a histogram of few rows, are ordered
    per = save(per.withColumn("b", F.floor(F.log2("n") * 16).cast("int")), "words")
    held, least = 0, None
    for r in sorted(per.groupBy("b").count().collect(), reverse=True):
        held, least = held + r["count"], r["b"]
        if held >= most:
            break
    some = per.where(F.col("b") >= least) if least is not None else per
    top = some.orderBy(F.col("n").desc(), "word").limit(most).select("word").collect()  # at most `most` numbers
    return np.sort(np.array([r["word"] for r in top], np.int64).view(U64))


def index_vectors(hashes: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few nonzero entries of each word's random index vector."""
    draws = np.stack([mix(hashes + U64(seed * 1000 + k)) for k in range(NONZERO)], 1)
    return (draws >> U64(32)).astype(np.int64) % DIM, (draws & U64(1)).astype(np.float32) * 2 - 1


def own_vectors(hashes: np.ndarray) -> np.ndarray:
    """The index vectors of words, scaled to unit length."""
    place, sign = index_vectors(hashes)
    v = np.zeros((len(hashes), DIM), np.float32)
    np.add.at(v, (np.arange(len(hashes))[:, None], place), sign)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def word_vectors(docs: DataFrame, known: np.ndarray, text_col: str = "text") -> np.ndarray:
    """A unit vector for each known word from all its neighbours in all texts, and a zero one at the end.

    Tasks' matrices are added in as many tasks as a shuffle has partitions, then their sums by block.
    """
    size = -(-max(1, len(known)) // BLOCKS) * BLOCKS
    fan = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BLOCKS)

    def gather(batches):
        whole, any_rows = np.zeros(size * DIM, np.float32), False
        for b in batches:
            for h, at in _words(b.column(0)):
                any_rows = True
                row = _rows_of(h, known)
                place, sign = index_vectors(h)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for far in range(1, WINDOW + 1):
                    near = text[far:] == text[:-far]
                    for own, other in ((row[:-far], slice(far, None)), (row[far:], slice(None, -far))):
                        ok = near & (own < len(known))
                        to = own[ok] * DIM
                        for k in range(NONZERO):
                            np.add.at(whole, to + place[other, k][ok], sign[other, k][ok])
        if any_rows:
            slot = TaskContext.get().partitionId() % fan
            parts = whole.astype("<f8").reshape(BLOCKS, -1)
            for k in range(BLOCKS):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([slot], pa.int32()), pa.array([parts[k].tobytes()], pa.binary())], ["block", "slot", "part"])

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}  # whole numbers, whose sums are exact in any order
        for b in batches:
            for k, slot, p in zip(*(c.to_pylist() for c in b.columns)):
                part = np.frombuffer(p, "<f8")
                total[k, slot] = total[k, slot] + part if (k, slot) in total else part
        for (k, slot), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([slot], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["block", "slot", "part"])

    schema = "block int, slot int, part binary"
    parts = docs.select(text_col).mapInArrow(lean(gather), schema)
    if fan > 1:
        parts = parts.repartition(BLOCKS * fan, "block", "slot").mapInArrow(lean(add), schema)
    summed = parts.withColumn("slot", F.lit(0)).repartition(BLOCKS, "block").mapInArrow(lean(add), schema)
    m = np.zeros((BLOCKS, size * DIM // BLOCKS))
    for r in summed.collect():  # BLOCKS rows, whatever the corpus
        m[r["block"]] = np.frombuffer(r["part"], "<f8")
    m = m.reshape(size, DIM)[: len(known)]
    m = np.sign(m) * np.log1p(np.abs(m))
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return np.concatenate([m, np.zeros((1, DIM))]).astype(np.float32)


def _pooled(col, known: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of each text's words: mean and root mean square of the vectors, and mean products with those at LAGS."""
    out = []
    for h, at in _words(col):
        row = _rows_of(h, known)
        n = np.diff(at)
        text = np.repeat(np.arange(len(n)), n)
        sums = np.zeros((len(n), WIDTH), np.float32)
        for i in range(0, len(row), 1 << 16):  # few vectors in memory at a time, whatever a text's length
            j = min(len(row), i + (1 << 16))
            part = vectors[row[i : j + max(LAGS)]]
            rare = np.flatnonzero(row[i : j + max(LAGS)] == len(known))
            part[rare] = own_vectors(h[i : j + max(LAGS)][rare])
            own = part[: j - i]
            cut = np.clip(at - i, 0, j - i)
            some = np.flatnonzero(np.diff(cut))
            sums[some, :DIM] += np.add.reduceat(own, cut[some], axis=0)
            sums[some, DIM : 2 * DIM] += np.add.reduceat(own * own, cut[some], axis=0)
            for k, lag in enumerate(LAGS):
                m = min(j - i, len(part) - lag)
                if m > 0:
                    dots = np.einsum("ij,ij->i", own[:m], part[lag : lag + m])
                    inside = text[i : i + m] == text[i + lag : i + lag + m]
                    sums[:, 2 * DIM + k] += np.bincount(text[i : i + m][inside], dots[inside], len(n)).astype(np.float32)
        sums /= np.maximum(n, 1)[:, None]
        sums[:, DIM : 2 * DIM] = np.sqrt(sums[:, DIM : 2 * DIM])
        out.append(sums)
    return np.concatenate(out) if out else np.zeros((0, WIDTH), np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """Input, a tanh layer, one logit over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        self.fixed = (y.sum() + 1) / (len(y) + 2) if len(set(y.tolist())) < 2 else None
        self.temperature = 1.0
        if self.fixed is not None:
            return
        held = np.arange(len(y)) % 5 == 4
        held &= len(y) >= 50
        xs, ys = (x - self.mean) / self.scale, y.astype(float)
        p = self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        fit = np.flatnonzero(~held)
        for _ in range(epochs):
            rng.shuffle(fit)
            for i in range(0, len(fit), 128):
                k = fit[i : i + 128]
                h = np.tanh(xs[k] @ p[0] + p[1])
                d = (_sigmoid(h @ p[2] + p[3]) - ys[k]) / len(k)
                dh = np.outer(d, p[2]) * (1 - h * h)
                t += 1
                for j, g in enumerate((xs[k].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum(keepdims=True))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        if held.any():
            z, target = self.logits(x[held]), ys[held]
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [-np.mean(target * np.log(_sigmoid(z / s) + 1e-12) + (1 - target) * np.log(1 - _sigmoid(z / s) + 1e-12)) for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), float(self.fixed))
        return _sigmoid(self.logits(x) / self.temperature)


def held_out(id_col: str = "doc_id", mod: int = 3, fold: int = 1) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == fold, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """_id, _y, _text of at most `sample` labelled ids outside the held-out fold, those of least hash."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    marked = save(marked.orderBy(F.xxhash64("_id"), "_id").limit(sample), "sample")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(marked), "_id")  # at most `sample` rows are sent
    return save(rows.select("_id", "_y", "_text"), "labelled")


def fit(rows: DataFrame, known: np.ndarray, vectors: np.ndarray) -> Network:
    """The network of labelled texts (_id, _y, _text)."""
    kind = rows.schema["_id"].dataType.simpleString()

    def vector(batches):
        for b in batches:
            x = _pooled(b.column(2), known, vectors)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "_y", "x"])

    got = rows.select("_id", "_y", "_text").mapInArrow(lean(vector), f"_id {kind}, _y int, x binary")
    # repeated ids: one of equal vectors, else the least; in an order of the id, so that reruns agree
    got = got.groupBy("_id", "_y").agg(F.min("x").alias("x")).orderBy(F.xxhash64("_id"), "_id").collect()  # at most `sample` rows
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float32).reshape(len(got), WIDTH)
    return Network(x, np.array([r["_y"] for r in got], int))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; with keep_row, its columns too, in a struct `row`."""
    with scratch(docs.sparkSession):
        labelled = sampled(docs, labels, sample, id_col, text_col, label_col)
        known = vocabulary(docs.select(text_col))
        vectors = word_vectors(docs, known, text_col)
        net = fit(labelled, known, vectors)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), *([F.struct(*docs.columns).alias("row")] if keep_row else []))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int" + (f", row {rows.schema['row'].dataType.simpleString()}" if keep_row else "")

    def judge(batches):
        for b in batches:
            s = net.scores(_pooled(b.column(2), known, vectors)).astype(float)
            cols = [b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *([b.column(3)] if keep_row else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "row"][: len(cols)])

    return rows.mapInArrow(lean(judge), schema)
