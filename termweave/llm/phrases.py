"""Phrase collocations by vertical partitioning of the suffixes at each word, as ERA builds suffix trees.

A suffix is the five words from a position on, cut where its piece ends or a word comes that is too
rare for any phrase.  Word prefixes are grouped so that the suffixes of a group fit a memory budget: a
prefix with more suffixes than the budget is extended by a word, in one reading of the texts for each
length, and takes no part itself; its count is known then.  All other suffixes go to the group of their
prefix, in compressed blocks of equal ones added up, and each group's subtree, cut at five words, is
built on its own: sorted suffixes, their common prefixes, and counts from totals of the leaves.

Words are 64-bit hashes of language and word; no two words of the corpus share one (else another seed
is taken), so counts are exact.  Tasks tell rare words by a bitmap of fixed size, which may let a rare
word pass but never drops another; in blocks the CODES most frequent words have short codes.

Cases: null and empty texts have no words; a null language is `und`; repeated rows count each; long
texts are read whole; an empty table gives an empty result; equal scores and counts are ordered by
phrase.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep, lean, save, scratch
from .kernels import LOWER, U64, cut_out, mix, run_hashes, slices, text_bytes, word_spans

#: Words of a phrase at most, and suffixes of a group at most unless SPLITS groups are too few.
DEPTH, BUDGET, SPLITS = 5, 1 << 20, 1 << 17
#: Bits of the map of frequent words, words with a short code at most, bytes of text whose suffixes are added up
#: before they leave a task, and distinct words that a task counts before it sends them.
MAP_BITS, CODES, SLICE, FLUSH = 1 << 26, 1 << 20, 1 << 21, 1_000_000
#: Space and tab end a word; the others end a piece too.
BORDER = np.zeros(256, bool)
BORDER[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BORDER.copy()
GAP[[0x20, 0x09]] = True


def _by_language(batches):
    """(language, bytes, text starts) of slices of columns (text, lang), each of one language."""
    for b in batches:
        codes = b.column(1).dictionary_encode()
        at = codes.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(codes.dictionary.to_pylist()):
            raw, offs = text_bytes(b.column(0).take(pa.array(np.flatnonzero(at == k))))
            for i, j in slices(offs, SLICE):
                yield lang, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def _ids(lang: str, raw: np.ndarray, offs: np.ndarray, seed: int):
    """Ids of the words of a slice, where they start and end, and whether each is in the piece of the one before."""
    starts, ends = word_spans(raw, offs, GAP)
    own = int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little")
    ids = mix(run_hashes(LOWER[raw], starts, ends) ^ U64(own))
    piece = np.cumsum(BORDER[raw])[starts] + np.searchsorted(offs, starts, "right") if len(starts) else starts
    same = np.zeros(len(ids), bool)
    same[1:] = piece[1:] == piece[:-1]
    return ids, starts, ends, same


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """id, lang, word, f; and clash: whether another word has the id."""

    def added(lang: str, parts: list) -> pa.RecordBatch:
        ids, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        own, at, code = np.unique(ids, return_index=True, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, code, n)
        word = pa.concat_arrays([p[2] for p in parts]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), word, pa.array(total)], ["lang", "id", "word", "f"])

    def run(batches):
        held, size = {}, 0
        for lang, raw, offs in _by_language(batches):
            ids, starts, ends, _ = _ids(lang, raw, offs, seed)
            own, at, n = np.unique(ids, return_index=True, return_counts=True)
            word = cut_out(LOWER[raw], starts[at], ends[at], pa.large_string()).cast(pa.string())
            held.setdefault(lang, []).append((own, n, word))
            size += len(own)
            if size >= FLUSH:
                yield from (added(*x) for x in held.items())
                held, size = {}, 0
        yield from (added(*x) for x in held.items())

    return by_id(texts.mapInArrow(lean(run), "lang string, id long, word string, f long"))


def by_id(per: DataFrame) -> DataFrame:
    """Counts (lang, id, word, f) added up, and whether words share an id."""
    both = F.struct("lang", "word")
    found = per.groupBy("id").agg(F.sum("f").alias("f"), F.min(both).alias("w"), F.max(both).alias("last"))
    return found.select("id", "w.*", "f", (F.col("w") != F.col("last")).alias("clash"))


def bitmap(words: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """The map of the words' ids: bits / 64 numbers at most come to the driver, whatever the corpus."""
    at = F.col("id").bitwiseAND(bits - 1)
    got = words.groupBy(F.shiftright(at, 6).alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("v")).toArrow()
    out = np.zeros(bits // 64, U64)
    out[got.column("k").to_numpy()] = got.column("v").to_numpy().view(U64)
    return out


def most_frequent(words: DataFrame, most: int = CODES) -> np.ndarray:
    """The ids of at most `most` words, the most frequent first: whole classes of counts, as many as fit."""
    classed = words.withColumn("c", F.floor(F.log2("f") * 8).cast("int"))
    held, least = 0, None
    for r in sorted(classed.groupBy("c").count().collect(), reverse=True):  # a few hundred classes
        held += r["count"]
        if held > most:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, U64)
    got = classed.where(F.col("c") >= least).select("id", "f").toArrow()
    ids, f = (got.column(i).to_numpy() for i in (0, 1))
    return ids[np.lexsort((ids, -f))].view(U64)


class Suffixes:
    """What tasks know: the map of frequent words, the most frequent ones in order and, by length, hashes of the
    prefixes above the budget."""

    def __init__(self, seed: int, common: np.ndarray, top: np.ndarray, groups: int, subs: int):
        self.seed, self.common, self.top, self.groups, self.subs = seed, common, top, groups, subs
        self.heavy: list[np.ndarray] = []
        self.rank = np.argsort(top)
        self.sorted = top[self.rank]

    def codes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Small numbers for ids: 0 for none, places among the most frequent words, then among the others, which are given too."""
        own, back = np.unique(ids, return_inverse=True)
        at = np.searchsorted(self.sorted, own)
        known = at < len(self.top)
        known[known] = self.sorted[at[known]] == own[known]
        code = np.zeros(len(own), np.int64)
        code[known] = self.rank[at[known]] + 1
        other = ~known & (own > 0)
        code[other] = len(self.top) + 1 + np.arange(other.sum())
        return code[back].reshape(ids.shape), own[other]

    def words(self, codes: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, U64), self.top, other])[codes]

    def extend(self, keys: list[bytes]) -> None:
        """The prefixes above the budget that are one word longer than the last ones."""
        h = np.zeros(len(keys), U64)
        if keys:
            for column in np.frombuffer(b"".join(keys), ">u8").reshape(len(keys), -1).T:
                h = _longer(h, column.astype(U64))
        self.heavy.append(np.sort(h))

    def of(self, lang: str, raw: np.ndarray, offs: np.ndarray):
        """Columns of word ids of all suffixes (0 beyond their end), hashes of their prefixes by length, and the
        number of leading words after which the prefix is within the budget."""
        ids, _, _, same = _ids(lang, raw, offs, self.seed)
        at = ids & U64(len(self.common) * 64 - 1)
        often = (self.common[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)
        follows = same & often
        follows[1:] &= often[:-1]
        first = np.flatnonzero(often)
        columns, alive = [ids[first]], np.ones(len(first), bool)
        for k in range(1, DEPTH):
            to = first + k
            alive = alive & (to < len(ids))
            alive[alive] = follows[to[alive]]
            columns.append(np.where(alive, ids[np.minimum(to, len(ids) - 1)], U64(0)))
        hashes, h, depth, over = [], np.zeros(len(first), U64), np.ones(len(first), np.int64), np.ones(len(first), bool)
        for k, column in enumerate(columns):
            h = _longer(h, column)
            hashes.append(h)
            over = over & np.isin(h, self.heavy[k]) if k < len(self.heavy) else np.zeros(len(h), bool)
            depth += over
        return np.stack(columns, 1), hashes, depth


def _longer(h: np.ndarray, column: np.ndarray) -> np.ndarray:
    return mix((h ^ column) * U64(0x9E3779B97F4A7C15) + U64(1))


def _keys(rows: np.ndarray) -> pa.Array:
    """Rows of ids as bytes, the first word's first."""
    width = rows.shape[1] * 8
    data = pa.py_buffer(np.ascontiguousarray(rows, ">u8").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), data])


def added_up(rows: np.ndarray, n: np.ndarray, *more: np.ndarray):
    """Equal rows once, in ascending order, with the sum of their n and their first value of `more`."""
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    at = np.flatnonzero(new)
    return (rows[at], np.add.reduceat(n, at) if len(at) else n, *(m[order][at] for m in more))


def prefix_counts(texts: DataFrame, seen, size: int) -> DataFrame:
    """lang, key, a of all prefixes of `size` words whose first size - 1 words are above the budget."""

    def run(batches):
        known = seen.value
        for lang, raw, offs in _by_language(batches):
            columns, _, depth = known.of(lang, raw, offs)
            rows = columns[(depth >= size) & (columns[:, size - 1] > 0), :size]
            rows, n = added_up(rows, np.ones(len(rows), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), _keys(rows), pa.array(n)], ["lang", "key", "a"])

    return texts.mapInArrow(lean(run), "lang string, key binary, a long").groupBy("lang", "key").agg(F.sum("a").alias("a"))


def _bundle(rows: np.ndarray, n: np.ndarray, depth: np.ndarray, known: Suffixes) -> bytes:
    """Suffixes as compressed bytes: words without a short code, then numbers for words, counts and depths, byte by byte."""
    codes, other = known.codes(rows)
    parts = [p.astype(np.min_scalar_type(int(p.max(initial=0)))) for p in (*codes.T, n, depth)]
    head = np.array([len(rows), len(other), *(p.itemsize for p in parts)], "<i8").tobytes()
    planes = [np.ascontiguousarray(p).view(np.uint8).reshape(len(rows), -1).T.tobytes() for p in parts]
    return zstandard.ZstdCompressor(1).compress(head + other.tobytes() + b"".join(planes))


def _unbundle(blob: bytes, known: Suffixes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count, size, *widths = map(int, np.frombuffer(raw, "<i8", 2 + DEPTH + 2))
    at = 8 * (2 + DEPTH + 2)
    other = np.frombuffer(raw, "<u8", size, at)
    at, out = at + 8 * size, []
    for w in widths:
        plane = np.frombuffer(raw, np.uint8, w * count, at).reshape(w, count)
        out.append(np.ascontiguousarray(plane.T).view(f"<u{w}").ravel().astype(np.int64))
        at += w * count
    return known.words(np.stack(out[:DEPTH], 1), other), out[DEPTH], out[DEPTH + 1]


def suffix_blocks(texts: DataFrame, seen) -> DataFrame:
    """g, sub, lang, block: the suffixes of each group that go on beyond its prefix, equal ones of a slice added up."""

    def run(batches):
        known = seen.value
        for lang, raw, offs in _by_language(batches):
            columns, hashes, depth = known.of(lang, raw, offs)
            goes_on = np.flatnonzero(depth < DEPTH)
            goes_on = goes_on[columns[goes_on, depth[goes_on]] > 0]
            columns, depth = columns[goes_on], depth[goes_on]
            hashes = np.stack(hashes, 1)[goes_on]
            row = np.arange(len(columns))
            g = hashes[row, depth - 1] % U64(known.groups)
            sub = (hashes[row, depth] >> U64(32)) % U64(known.subs)
            keyed = np.concatenate([g[:, None], sub[:, None], columns], 1)
            keyed, n, depth = added_up(keyed, np.ones(len(keyed), np.int64), depth)
            cut = np.flatnonzero(np.concatenate([[True], (keyed[1:, :2] != keyed[:-1, :2]).any(1)])) if len(keyed) else np.zeros(0, np.int64)
            ends = [*cut[1:].tolist(), len(keyed)]
            blocks = [_bundle(keyed[i:j, 2:], n[i:j], depth[i:j], known) for i, j in zip(cut.tolist(), ends)]
            at = keyed[cut].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array([lang] * len(cut), pa.string()), pa.array(blocks, pa.binary())], ["g", "sub", "lang", "block"])

    return texts.mapInArrow(lean(run), "g long, sub long, lang string, block binary")


def _subtree(least: int, seen):
    """A function from the blocks of one group to its phrases beyond the group's prefixes with `least` leaves or more."""

    def run(group: pa.Table) -> pa.Table:
        held, size, limit = [], 0, BUDGET
        for blob in group.column("block"):
            held.append(_unbundle(blob.as_py(), seen.value))
            size += len(held[-1][0])
            if size > limit:  # equal suffixes of many blocks become one
                rows, n, depth = (np.concatenate(x) for x in zip(*held))
                held = [added_up(rows, n, depth)]
                size = len(held[0][0])
                limit = max(BUDGET, 2 * size)
        rows, n, depth = added_up(*(np.concatenate(x) for x in zip(*held)))
        new, keys, counts = np.zeros(len(rows), bool), [], []
        new[:1] = True
        for k in range(DEPTH):  # nodes of k + 1 words: runs of suffixes that share as many
            new[1:] |= rows[1:, k] != rows[:-1, k]
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at) if len(at) else n
            ok = (total >= least) & (rows[at, k] > 0)
            out = ok & (depth[at] <= k)
            keys.append(_keys(rows[at[out], : k + 1]))
            counts.append(total[out])
            rest = np.repeat(ok, np.diff([*at, len(rows)]))  # only these are followed further
            rows, n, depth, new = rows[rest], n[rest], depth[rest], new[rest]
        lang = group.column("lang")[0].as_py()
        key, a = pa.concat_arrays(keys), np.concatenate(counts)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "key": key, "a": pa.array(a, pa.int64())})

    return run


def _first(k) -> Column:
    return F.expr(f"substring(key, 1, 8 * ({k}))")


def _rest(k) -> Column:
    return F.expr(f"substring(key, 8 * ({k}) + 1)")


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases (lang, key, a) with l, r, n and score of their lowest-scoring cut."""
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.expr("cast(length(key) / 8 as int) - 1"))))
    cuts = cuts.select("*", _first("k").alias("head"), _rest("k").alias("tail"))
    cuts = cuts.join(counts.select(F.col("key").alias("head"), F.col("a").alias("l")), "head")
    cuts = cuts.join(counts.select(F.col("key").alias("tail"), F.col("a").alias("r")), "tail")
    cuts = cuts.join(totals, "lang")
    d = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    value = F.call_function("div", d["a"] * d["n"] * F.lit(1000).cast("decimal(4,0)"), d["l"] * d["r"])
    best = cuts.groupBy("lang", "key", "a", "n").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("m"))
    return best.select("lang", "key", "a", "m.l", "m.r", "n", "m.score")


def maximal(phrases: DataFrame) -> DataFrame:
    """Without those inside a longer phrase that is as frequent.

    A phrase is at least as frequent as what it is inside of; so if it is inside one two words longer
    and as frequent, it is inside one that is one word longer and as frequent: only these are asked.
    """
    longer = phrases.where("length(key) > 16")
    inside = longer.select(F.explode(F.array(F.expr("substring(key, 1, length(key) - 8)"), _rest(1))).alias("key"), "a")
    return phrases.join(inside.distinct(), ["key", "a"], "left_anti")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, budget: int = BUDGET, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to five words.

    a: occurrences; l, r: those of its two parts at the lowest-scoring cut; n: all words of the
    language; score: floor(1000 * a * n / (l * r)).
    """
    with scratch(docs.sparkSession):
        return keep(_collocations(docs, least, top, budget, text_col, lang_col), "phrases")


def _collocations(docs: DataFrame, least: int, top: int, budget: int, text_col: str, lang_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    seed = 0
    while not (words := save(count_words(texts, seed), "words")).where("clash").isEmpty():
        seed += 1
    totals = save(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = save(words.where(F.col("f") >= least).drop("clash"), "frequent")
    suffixes = often.agg(F.coalesce(F.sum("f"), F.lit(0))).head()[0]
    share = max(budget, suffixes // SPLITS)  # so prefixes above it, which tasks hold, are SPLITS of a length at most
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-suffixes // share))
    known = Suffixes(seed, bitmap(often), most_frequent(often), groups, -(-share // budget))
    single = often.select("lang", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("key"), F.col("f").alias("a"))
    level, phrases = single, []
    for size in range(2, DEPTH + 2):
        above = [bytes(r["key"]) for r in level.where(F.col("a") > share).select("key").collect()]
        known.extend(above)
        if not above or size > DEPTH:
            break
        level = save(prefix_counts(texts, spark.sparkContext.broadcast(known), size), "prefixes")
        phrases.append(level.where(F.col("a") >= least))
    told = spark.sparkContext.broadcast(known)
    blocks = suffix_blocks(texts, told)
    phrases.append(blocks.groupBy("g", "sub", "lang").applyInArrow(_subtree(least, told), "lang string, key binary, a long"))
    found = phrases[0]
    for p in phrases[1:]:
        found = found.unionByName(p)
    found = save(found, "candidates")
    ranked = scored(maximal(found), single.unionByName(found).select("key", "a"), totals)
    by = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    ranked = save(ranked.withColumn("rank", F.rank().over(by)).where(F.col("rank") <= top), "ranked")  # with all ties
    spelt = ranked.select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.expr("length(key)"), F.lit(8)), lambda i: F.substring("key", i, F.lit(8)))).alias("pos", "w"))
    spelt = spelt.join(often.select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("w"), "word"), "w").groupBy("key")
    spelt = spelt.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    last = ranked.drop("rank").join(spelt, "key").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")).cast("long"))
    return last.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]')) AS piece FROM t
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), h AS (
  SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, k FROM g CROSS JOIN range(1, 6) AS ks(k) WHERE i + k - 1 <= len(ws)
), f AS (
  SELECT lang, phrase, k, count(*) AS a FROM h GROUP BY ALL
), n AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100
), inside AS (
  SELECT DISTINCT lang, a, array_to_string(ws[i : i + m - 1], ' ') AS phrase
  FROM c CROSS JOIN range(1, 5) AS x(i) CROSS JOIN range(2, 5) AS y(m) WHERE m < k AND i + m - 1 <= k
), cut AS (
  SELECT c.lang, c.phrase, c.a, n.n, j, x.a AS l, y.a AS r, CAST(1000 * CAST(c.a AS HUGEINT) * n.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c ANTI JOIN inside USING (lang, phrase, a) CROSS JOIN range(1, 5) AS js(j)
  JOIN n ON n.lang = c.lang
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1 : j], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(ws[j + 1 :], ' ')
  WHERE j < c.k
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM r WHERE rank <= 2000
"""
