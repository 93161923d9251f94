"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds every training token's 64-bit hash (Elias-Fano) and exact count; its ids are the ranks
of the hashes.  Level 2 and 3 hold, for every node above, a range of successors (monotone pointers,
Elias-Fano), the successors in ascending order (packed; in level 3 a successor is its rank among those
of the last word, so few bits do), and smoothed log10 probabilities and back-off weights in 16 bits.
An n-gram is found by a search of its successor within its context's range.

The training texts are read twice: for the words, and for two and three tokens together, whose partial
counts (contexts with their successors, in compressed blocks) Spark adds up by shard, a range of first
words.  A shard's level 2 is written with the counts of its level 3; these become level 3, shard by
shard, when all of level 2 can be looked up.  The files are in the shared folder; tasks map them.

All n-grams of the training texts are kept.  p(w | context) = (c + PRIOR * p(w | shorter)) / (S + PRIOR),
with S the count of the context; for words not seen there the factor PRIOR / (S + PRIOR) is the back-off
weight.  So the probabilities of a context add up to one, but for rounding to 16 bits.

Cases: null and empty texts have the end token only; a null id is trained on and not held out;
repeated rows count and are scored each; texts of any length are scored whole; without any training
text N and V are 0 and every token has the unknown word's probability; an empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, lean, shared_path
from .compact import EliasFano, bits_for, ef_encode, pack, read_arrays, unpack, write_arrays
from .kernels import U64, slices, text_bytes, words

ORDER, PRIOR, ADD = 3, 4.0, 0.1
END = U64(0x5EED0FE0D0F7E875)
#: Keys that a task gathers before it sends partial counts, and bytes of text for a shard of a level.
FLUSH, SHARD_BYTES = 3_000_000, 8 << 20
#: Bytes of text handled at a time, and the range of 16-bit logarithms.
SLICE, DEEPEST = 3 << 20, 32.0


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.round(np.clip(-log10, 0, DEEPEST) * (65535 / DEEPEST)).astype("<u2")


def restored(code: np.ndarray) -> np.ndarray:
    return code.astype(float) * (-DEEPEST / 65535)


def tokens(col):
    """Token hashes (words, then an end) of slices of texts: hashes, where each text's start, rows."""
    raw, offs = text_bytes(col)
    for i, j in slices(offs, SLICE):
        w, at = words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        at = at + np.arange(len(at))
        out = np.empty(len(w) + j - i, U64)
        ends = at[1:] - 1
        is_end = np.zeros(len(out), bool)
        is_end[ends] = True
        out[is_end], out[~is_end] = END, w
        yield out, at, slice(i, j)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, int)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and each key's place among them."""
    code, own = pd.factorize(keys)
    order = np.argsort(own)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    return own[order], rank[code]


def _bytes(a: np.ndarray, width: int) -> bytes:
    """Unsigned integers as bytes by significance, so that they compress."""
    return a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _numbers(raw: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel()


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys.astype(U64), prepend=U64(0))


def _bundle(keys: np.ndarray, counts: np.ndarray, fan: np.ndarray | None = None, succ: np.ndarray | None = None, more: np.ndarray | None = None) -> bytes:
    """Ascending keys and counts as compressed bytes; with them the number of successors of each, the successors and their counts."""
    none = np.zeros(0, np.int64)
    fan, succ, more = (none if x is None else x for x in (fan, succ, more))
    head = np.array([len(keys), len(fan), len(succ)], "<i8").tobytes()
    return zstandard.ZstdCompressor(1).compress(head + _bytes(_gaps(keys), 8) + _bytes(counts, 8) + _bytes(fan, 4) + _bytes(succ, 8) + _bytes(more, 8))


def _unbundle(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, m, k = map(int, raw[:24].view("<i8"))
    at, out = 24, []
    for size, width in ((n, 8), (n, 8), (m, 4), (k, 8), (k, 8)):
        out.append(_numbers(raw[at : at + size * width], width))
        at += size * width
    return np.cumsum(out[0]), *(x.astype(np.int64) for x in out[1:])


class Shards:
    """A level's files, opened as they are asked for; nodes are numbered through all of them."""

    def __init__(self, uri: str, sizes: list[int]):
        self.uri, self.first = uri, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.open: dict[int, dict] = {}

    def arrays(self, s: int) -> dict:
        if s not in self.open:
            self.open[s] = read_arrays(f"{self.uri}/{s}")
        return self.open[s]

    def parts(self, bounds: np.ndarray, ids: np.ndarray):
        """Ranges of ascending ids that fall into one shard each."""
        cut = np.searchsorted(ids, bounds)
        for s in np.flatnonzero(np.diff(cut)):
            yield int(s), slice(cut[s], cut[s + 1])


class Vocabulary(Shards):
    """Level 1."""

    def __init__(self, uri: str, sizes: list[int], total: int):
        super().__init__(uri, sizes)
        self.total, self.size = total, int(self.first[-1])
        self.bits = (len(sizes) - 1).bit_length()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of ascending hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for s, part in self.parts(np.arange(len(self.first)), shard):
            if self.first[s] == self.first[s + 1]:  # no training token there, and no file
                continue
            a = self.arrays(s)
            at = EliasFano(a, "hash").find(hashes[part])
            ok = at >= 0
            ids[part] = np.where(ok, at + self.first[s], -1)
            counts[part] = np.where(ok, unpack(a["count"], int(a["width"][0]), np.maximum(at, 0)).astype(np.int64), 0)
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending ids."""
        out = np.zeros(len(ids), np.int64)
        for s, part in self.parts(self.first, ids):
            a = self.arrays(s)
            out[part] = unpack(a["count"], int(a["width"][0]), ids[part] - self.first[s])
        return out

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.total + ADD * (self.size + 1)))


class Level(Shards):
    """Level 2 or 3: shards are ranges of parents."""

    def __init__(self, uri: str, sizes: list[int], bounds: np.ndarray):
        super().__init__(uri, sizes)
        self.bounds = bounds

    def ranges(self, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First child, end of children, and back-off weight (log10) of ascending distinct parents."""
        lo, hi, weight = np.zeros(len(parents), np.int64), np.zeros(len(parents), np.int64), np.zeros(len(parents))
        for s, part in self.parts(self.bounds, parents):
            a, own = self.arrays(s), parents[part] - self.bounds[s]
            ptr = EliasFano(a, "ptr")
            lo[part] = ptr.get(own).astype(np.int64) + self.first[s]
            hi[part] = ptr.get(own + 1).astype(np.int64) + self.first[s]
            weight[part] = restored(a["weight"][own])
        return lo, hi, weight

    def values(self, nodes: np.ndarray, name: str) -> np.ndarray:
        """Successors or probabilities of ascending nodes."""
        out = np.zeros(len(nodes), np.int64 if name == "succ" else float)
        for s, part in self.parts(self.first, nodes):
            a, own = self.arrays(s), nodes[part] - self.first[s]
            out[part] = unpack(a["succ"], int(a["width"][0]), own) if name == "succ" else restored(a["prob"][own])
        return out

    def find(self, parents: np.ndarray, succ: np.ndarray, base: int):
        """For pairs in any order: node (-1: none), probability, back-off weight of the parent, rank in its range."""
        key, back = distinct(parents.astype(U64) * U64(base) + succ.astype(U64))
        p = (key // U64(base)).astype(np.int64)
        want = (key - p.astype(U64) * U64(base)).astype(np.int64)
        first = _runs(p)
        lo, hi, weight = self.ranges(p[first])
        each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))
        start = lo[each]
        left, right = start.copy(), hi[each]
        end = right.copy()
        node, prob = np.full(len(key), -1, np.int64), np.zeros(len(key))
        for s, part in self.parts(self.bounds, p):
            a, off = self.arrays(s), self.first[s]
            width, l, r, w = int(a["width"][0]), left[part] - off, right[part] - off, want[part]
            live = np.flatnonzero(l < r)
            while len(live):  # successor search within the context's range
                mid = (l[live] + r[live]) >> 1
                less = unpack(a["succ"], width, mid).astype(np.int64) < w[live]
                l[live[less]], r[live[~less]] = mid[less] + 1, mid[~less]
                live = live[l[live] < r[live]]
            at = np.flatnonzero(l < end[part] - off)
            hit = at[unpack(a["succ"], width, l[at]).astype(np.int64) == w[at]]
            own = np.arange(part.start, part.stop)[hit]
            node[own] = l[hit] + off
            prob[own] = restored(a["prob"][l[hit]])
        return node[back], prob[back], weight[each][back], (node - start)[back]


class Trie:
    """The levels built so far, as tasks see them."""

    def __init__(self, vocabulary, levels=()):
        self.vocabulary, self.levels = vocabulary, list(levels)

    def __getstate__(self):  # open files stay with their process
        return {"v": (self.vocabulary.uri, np.diff(self.vocabulary.first).tolist(), self.vocabulary.total), "l": [(x.uri, np.diff(x.first).tolist(), x.bounds) for x in self.levels]}

    def __setstate__(self, state):
        self.vocabulary, self.levels = Vocabulary(*state["v"]), [Level(*x) for x in state["l"]]

    def look(self, hashes: np.ndarray, at: np.ndarray):
        """Ids and counts of all tokens, and for each level its (node, probability, weight, rank), -1 and 0 where absent."""
        own, back = distinct(hashes)
        ids, counts = self.vocabulary.find(own)
        ids, counts = ids[back], counts[back]
        inner = np.ones(len(ids), bool)
        inner[at[:-1][at[:-1] < len(ids)]] = False
        found = []
        before, succ, base = ids, ids, max(1, self.vocabulary.size)
        for level in self.levels:
            ok = inner.copy()
            ok[1:] &= before[:-1] >= 0
            want = ok & (succ >= 0)
            node, rank = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
            prob, weight = np.zeros(len(ids)), np.zeros(len(ids))
            q = np.flatnonzero(want)
            if len(q):
                node[q], prob[q], weight[q], r = level.find(before[q - 1], succ[q], base)
                rank[q] = np.where(node[q] >= 0, r, -1)
            q = np.flatnonzero(ok & ~want)
            if len(q):
                parents, b = distinct(before[q - 1])
                weight[q] = level.ranges(parents)[2][b]
            found.append((node, prob, weight, rank))
            before, succ = node, rank
        return ids, counts, found

    def scores(self, counts: np.ndarray, found) -> np.ndarray:
        """log10 probability of every token."""
        p = self.vocabulary.log10(counts)
        for node, prob, weight, _ in found:
            p = np.where(node >= 0, prob, weight + p)
        return p


def _partial(arrays_of, bundles):
    """A function over (text, training) rows: compressed partial counts by shard.

    arrays_of gives tuples of equally long arrays for slices of texts; bundles makes (shards, blobs) of FLUSH of them.
    """

    def run(batches):
        held, n = [], 0

        def flush():
            shards, blobs = bundles(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(shards, np.int32)), pa.array(blobs, pa.binary())], ["shard", "part"])

        for b in batches:
            for arrays in arrays_of(b.column(0).filter(b.column(1))):
                if len(arrays[0]):
                    held.append(arrays)
                    n += len(arrays[0])
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _added(parts: list[tuple[np.ndarray, ...]], base: int) -> tuple[np.ndarray, ...]:
    """Parts of one shard as one: keys, counts, and the successors of each key with their counts."""
    keys, counts, fan, succ, more = (np.concatenate(x) for x in zip(*parts))
    own, at = distinct(keys)
    total = np.bincount(at, counts, len(own)).astype(np.int64)
    if not len(fan):
        return own, total, fan, succ, more
    pair = np.repeat(at, fan).astype(U64) * U64(base) + succ.astype(U64)
    order = np.argsort(pair, kind="stable")
    pair, more = pair[order], more[order]
    first = _runs(pair)
    more = np.add.reduceat(more, first) if len(first) else more
    pair = pair[first]
    at = (pair // U64(base)).astype(np.int64)
    return own, total, np.bincount(at, minlength=len(own)), (pair - at.astype(U64) * U64(base)).astype(np.int64), more


def _assemble(finish, base: int):
    """A function over rows sorted by shard: adds a shard's parts up, writes its files, tells its size."""

    def run(batches):
        shard, parts, n = None, [], 0

        def close():
            size, total = finish(shard, *_added(parts, base))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([total], pa.int64())], ["shard", "size", "total"])

        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != shard:
                    if parts:
                        yield close()
                    shard, parts, n = s, [], 0
                parts.append(_unbundle(blob))
                n += len(parts[-1][0]) + len(parts[-1][3])
                if n > 2 * FLUSH:
                    parts = [_added(parts, base)]
                    n = max(0, len(parts[0][0]) + len(parts[0][3]) - FLUSH)
        if parts:
            yield close()

    return run


TOLD = "shard int, size long, total long"


def _count(rows: DataFrame, shards: int, arrays_of, bundles, finish, base: int) -> dict[int, tuple[int, int]]:
    parts = rows.mapInArrow(lean(_partial(arrays_of, bundles)), "shard int, part binary")
    told = parts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(_assemble(finish, base)), TOLD)
    return {r["shard"]: (r["size"], r["total"]) for r in told.collect()}  # three numbers a shard


def _level(own: np.ndarray, width: int, succ: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> dict[str, np.ndarray]:
    """A shard's arrays: own is each successor's parent, from 0 to width, ascending."""
    sums = np.bincount(own, counts, width)
    prob = np.log10((counts + PRIOR * 10**lower) / (sums[own] + PRIOR))
    wide = bits_for(int(succ.max()) if len(succ) else 0)
    pointers = np.searchsorted(own, np.arange(width + 1))
    return ef_encode(pointers, "ptr") | {"succ": pack(succ, wide), "width": np.array([wide]), "prob": quantised(prob), "weight": quantised(np.log10(PRIOR / (sums + PRIOR)))}


def build(docs: DataFrame, training, order: int = ORDER, text_col: str = "text") -> Trie:
    """The trie of the texts whose rows satisfy `training` (a Column), of order 1 to 3."""
    if order not in (1, 2, 3):
        raise ValueError("order is 1, 2 or 3")
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(training, F.lit(True)).alias("training"))
    size = rows.where("training").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    root = shared_path(spark, "trie")
    shards = int(max(1, size // SHARD_BYTES))
    bits = max(0, (shards // 8).bit_length())

    def hashes(col):
        for h, _, _ in tokens(col):
            yield (h,)

    def words_by_shard(keys):
        keys = np.sort(keys)
        start = _runs(keys)
        counts, keys = np.diff(np.append(start, len(keys))), keys[start]
        shard = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cut = _runs(shard)
        edges = np.append(cut, len(keys))
        return shard[cut], [_bundle(keys[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:])]

    def vocabulary(s, keys, counts, *_):
        width = bits_for(int(counts.max()))
        write_arrays(f"{root}/1/{s}", ef_encode(keys, "hash") | {"count": pack(counts, width), "width": np.array([width])})
        return len(keys), int(counts.sum())

    told = _count(rows, 1 << bits, hashes, words_by_shard, vocabulary, 1)
    v = Vocabulary(f"{root}/1", [told.get(s, (0, 0))[0] for s in range(1 << bits)], sum(t for _, t in told.values()))
    if order == 1 or not v.size:
        return Trie(v)
    base, words_only = v.size, Trie(v)
    # shards are ranges of first words of equal number, in the order of their hashes
    width = -(-base // shards)
    bounds = np.minimum(np.arange(shards + 1, dtype=np.int64) * width, base)

    def pairs(col):
        """Of every token that another follows: its pair, and the token after that (-1: none)."""
        for h, at, _ in tokens(col):
            ids, _, _ = words_only.look(h, at)
            last = at[1:] - 1
            pair = np.ones(len(ids), bool)
            pair[last] = False
            q = np.flatnonzero(pair)
            pair[last[last > 0] - 1] = False  # a text's last pair has no third token
            third = np.where(pair[q], ids[np.minimum(q + 2, len(ids) - 1)], -1)
            yield ids[q].astype(U64) * U64(base) + ids[q + 1].astype(U64), third

    def pairs_by_shard(keys, third):
        own, at = distinct(keys)
        counts = np.bincount(at, minlength=len(own))
        if order > 2:
            some = third >= 0
            triple = np.sort(at[some].astype(U64) * U64(base) + third[some].astype(U64))
            start = _runs(triple)
            more, triple = np.diff(np.append(start, len(triple))), triple[start]
            up = (triple // U64(base)).astype(np.int64)
            succ = (triple - up.astype(U64) * U64(base)).astype(np.int64)
            fan = np.bincount(up, minlength=len(own))
        else:
            fan, succ, more = (np.zeros(0, np.int64) for _ in range(3))
        shard = (own // U64(base) // U64(width)).astype(np.int64)
        cut = _runs(shard)
        edges = np.append(cut, len(own))
        to = np.concatenate([[0], np.cumsum(fan)])[edges] if len(fan) else np.zeros(len(edges), np.int64)
        return shard[cut], [_bundle(own[a:b], counts[a:b], fan[a:b], succ[x:y], more[x:y]) for a, b, x, y in zip(edges[:-1], edges[1:], to[:-1], to[1:])]

    def second(s, keys, counts, fan, succ, more):
        parent = (keys // U64(base)).astype(np.int64)
        word = (keys - parent.astype(U64) * U64(base)).astype(np.int64)
        known, back = distinct(word)
        lower = v.log10(v.counts(known))[back]
        write_arrays(f"{root}/2/{s}", _level(parent - bounds[s], int(bounds[s + 1] - bounds[s]), word, counts, lower))
        if order > 2:
            write_arrays(f"{root}/counts/{s}", {"part": np.frombuffer(_bundle(keys, counts, fan, succ, more), np.uint8)})
        return len(keys), int(counts.sum())

    told = _count(rows, shards, pairs, pairs_by_shard, second, base)
    for s in (s for s in range(shards) if s not in told):  # ranges without any pair have files too
        none = np.zeros(0, np.int64)
        write_arrays(f"{root}/2/{s}", _level(none, int(bounds[s + 1] - bounds[s]), none, none, none.astype(float)))
    two = Level(f"{root}/2", [told.get(s, (0, 0))[0] for s in range(shards)], bounds)
    trie = Trie(v, [two])
    if order == 2 or not told:
        return trie

    def third(batches):
        up = trie.levels[0]
        for b in batches:
            for s in b.column(0).to_pylist():
                n = int(up.first[s + 1] - up.first[s])
                keys, _, fan, succ, more = _unbundle(read_arrays(f"{root}/counts/{s}")["part"].tobytes()) if n else [np.zeros(0, np.int64)] * 5
                own = np.repeat(np.arange(n), fan)
                word = (keys.astype(U64) % U64(base)).astype(np.int64)
                _, lower, _, rank = up.find(word[own], succ, base)
                write_arrays(f"{root}/3/{s}", _level(own, n, rank, more.astype(float), lower))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([int(more.sum())], pa.int64())], ["shard", "size", "total"])

    # a shard a task; its counts stay until all are done, so a lost task starts again
    sizes = {r["shard"]: r["size"] for r in spark.range(0, shards, 1, shards).mapInArrow(lean(third), TOLD).collect()}
    drop(spark, f"{root}/counts")
    return Trie(v, [two, Level(f"{root}/3", [sizes[s] for s in range(shards)], two.first)])


def held_out(id_col: str = "doc_id", mod: int = 10) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == 0, F.lit(False))


def score(docs: DataFrame, trie: Trie | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; a written table."""
    if trie is not None:
        return _score(docs, trie, id_col, text_col)
    trie = build(docs, ~held_out(id_col), order, text_col)
    out = keep(_score(docs, trie, id_col, text_col), "scores")
    drop(docs.sparkSession, trie.vocabulary.uri.rpartition("/")[0])
    return out


def _score(docs: DataFrame, trie: Trie, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for h, at, _ in tokens(b.column(2)):
                _, counts, found = trie.look(h, at)
                first = at[:-1]
                cols[0].append(np.diff(at))
                cols[1].append(np.add.reduceat((counts > 0).astype(np.int64), first))
                cols[2].append(np.add.reduceat(trie.vocabulary.log10(counts), first))
                cols[3].append(np.add.reduceat(trie.scores(counts, found), first))
            n, known, base, full = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            total = np.full(b.num_rows, trie.vocabulary.total, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(total), pa.array(base.astype(float)), pa.array(full.astype(float))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
