"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a public vocabulary of byte strings, never trained here.  Each language has a
probability for every piece; a word's probability is the sum over all ways to cut it into pieces, which
a forward pass over its bytes adds up, and a text's is the product over its words.  Words are runs of
letters and marks in small letters, with a space before them as the vocabulary has it; longer ones than
LONGEST bytes are cut there.  Probabilities are fitted by expectation maximisation on the word counts
of all training texts: each round a forward and a backward pass give expected counts of the pieces,
which Spark adds up by language and piece as whole numbers, so runs agree.  A share FLOOR of a
language's probability is spread over the whole vocabulary, whose single bytes cut any word.

The languages are all values that the training rows hold; what a task keeps of the model is one number
for each of them and each piece of the vocabulary.  The score is the posterior probability of the
predicted language, all languages being equally likely before.

Cases: null texts and texts without a letter are `und` with score 0, as is every text when nothing is
learned; a null id is trained on and not held out; a null language is not trained on; repeated rows
count and are predicted each; texts of any length are read whole; equal probabilities go to the first
language by code point; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lean, save, scratch
from .kernels import U64, cut_out, run_hashes, running, slices, text_bytes

LONGEST, FLOOR, ROUNDS = 32, 1e-3, 3
#: Expected counts are whole numbers of this unit.
UNIT = 1 << 10
#: Words times languages that forward() takes at once, about.
BLOCK = 1 << 18
#: Bits of the table that tells most strings outside the vocabulary.
SIEVE = 22
NOT_SPACE = np.arange(256) != 0x20


def read_pieces(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file of lines `base64 rank`, and every single byte."""
    own = {base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()}
    return sorted({p for p in own if len(p) <= LONGEST} | {bytes([i]) for i in range(256)})


class Pieces:
    """The vocabulary, looked up by hash."""

    def __init__(self, pieces: list[bytes]):
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        h = run_hashes(raw, starts, ends)
        self.order = np.argsort(h)
        self.hashes, self.size = h[self.order], len(pieces)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces share a hash")
        self.lengths = sorted({len(p) for p in pieces})
        self.maybe = np.zeros(1 << SIEVE, bool)
        self.maybe[(h >> U64(64 - SIEVE)).astype(np.int64)] = True

    def inside(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None):
        """(from, to, words, pieces) for all pieces in words, which are sorted by falling length; from ascends.  sums: running(raw)."""
        size = ends - starts
        sums = running(raw) if sums is None else sums
        for i in range(int(size.max(initial=0))):
            for m in self.lengths:
                n = int(np.searchsorted(-size, -(i + m), "right"))  # the words that reach so far
                if not n:
                    break
                h = run_hashes(raw, starts[:n] + i, starts[:n] + i + m, sums)
                at = np.flatnonzero(self.maybe[(h >> U64(64 - SIEVE)).astype(np.int64)])
                place = np.searchsorted(self.hashes, h[at])
                ok = place < self.size
                ok[ok] = self.hashes[place[ok]] == h[at[ok]]
                if ok.any():
                    yield i, i + m, at[ok], self.order[place[ok]]


def spaced(col: str) -> Column:
    """The words of a text, each with a space before it; null: none."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}\p{M}]+", " "))


def _parts(raw: np.ndarray, offs: np.ndarray):
    """Where the words of spaced texts start and end, with their space and cut at LONGEST bytes, and their texts."""
    letter = NOT_SPACE[raw]
    first = np.flatnonzero(~letter & np.append(letter[1:], False))
    border = np.append(np.flatnonzero(~letter), len(raw))
    ends = border[np.searchsorted(border, first, "right")]
    ends = np.minimum(ends, offs[np.searchsorted(offs, first, "right")])  # texts touch
    count = -(-(ends - first) // LONGEST)
    starts = np.repeat(first, count)
    starts += LONGEST * (np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count))
    ends = np.minimum(np.repeat(ends, count), starts + LONGEST)
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def _distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """First places of distinct parts, longest first, and which of them each part is."""
    h = run_hashes(raw, starts, ends)
    _, at, code = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(starts[at] - ends[at], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return at[order], rank[code]


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n of columns (text, lang), spaced texts."""

    def run(batches):
        for b in batches:
            codes = b.column(1).dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            for k, lang in enumerate(codes.dictionary.to_pylist()):
                raw, offs = text_bytes(b.column(0).take(pa.array(np.flatnonzero(which == k))))
                for i, j in slices(offs, 1 << 23):
                    part = raw[offs[i] : offs[j]]
                    starts, ends, _ = _parts(part, offs[i : j + 1] - offs[i])
                    at, code = _distinct(part, starts, ends)
                    word = cut_out(part, starts[at], ends[at]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), word, pa.array(np.bincount(code, minlength=len(at)))], ["lang", "word", "n"])

    return docs.mapInArrow(lean(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def forward(found: list, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """sums[word, language, bytes from the start], of the probabilities of all segmentations; p has a row for each piece."""
    sums = np.zeros((int(size.max(initial=0)) + 1, len(size), p.shape[1]))
    sums[0] = 1
    for i, j, words, piece in found:
        sums[j, words] += sums[i, words] * p[piece]
    return sums


def expected(found: list, size: np.ndarray, n: np.ndarray, lang: np.ndarray, p: np.ndarray):
    """Languages, pieces and expected counts, in units, of words that occur n times in a language each."""
    before, after = np.zeros((2, int(size.max(initial=0)) + 1, len(size)))
    before[0] = 1
    after[size, np.arange(len(size))] = 1
    chance = [p[piece, lang[words]] for _, _, words, piece in found]
    for (i, j, words, _), c in zip(found, chance):
        before[j, words] += before[i, words] * c
    for (i, j, words, _), c in zip(reversed(found), reversed(chance)):
        after[i, words] += after[j, words] * c
    whole = n / after[0]
    for (i, j, words, piece), c in zip(found, chance):
        got = np.rint(before[i, words] * c * after[j, words] * whole[words] * UNIT).astype(np.int64)
        some = np.flatnonzero(got)
        yield lang[words[some]], piece[some], got[some]


def fit(words: DataFrame, langs: list[str], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of pieces (rows) in languages (columns) from a written table (lang, word, n)."""
    code = {lang: k for k, lang in enumerate(langs)}
    p = np.full((pieces.size, len(langs)), 1 / pieces.size)
    spark = words.sparkSession
    for _ in range(rounds if langs else 0):
        told = spark.sparkContext.broadcast((pieces, p))

        def run(batches, told=told):
            known, chances = told.value
            for b in batches:
                raw, offs = text_bytes(b.column(1))
                order = np.argsort(-np.diff(offs), kind="stable")
                starts, ends = offs[:-1][order], offs[1:][order]
                lang = np.array([code[x] for x in b.column(0).to_pylist()], np.int64)[order]
                found = list(known.inside(raw, starts, ends))
                parts = list(expected(found, ends - starts, b.column(2).to_numpy()[order], lang, chances))
                if parts:
                    where, what, n = (np.concatenate(x) for x in zip(*parts))
                    both, at = np.unique(where * known.size + what, return_inverse=True)
                    total = np.zeros(len(both), np.int64)
                    np.add.at(total, at, n)
                    yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(total)], ["k", "n"])

        got = words.select("lang", "word", "n").mapInArrow(lean(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(p.size)  # a number for each language and piece, whatever the corpus
        counts[got.column("k").to_numpy()] = got.column("n").to_numpy()
        counts = counts.reshape(len(langs), pieces.size).T
        p = (1 - FLOOR) * counts / np.maximum(counts.sum(0), 1) + FLOOR / pieces.size
    return p


def identify(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; vocabulary is the path of a file of byte strings.

    Rows whose crc32 of the id leaves 0 modulo `folds` are held out: nothing is learned from them.
    """
    with scratch(docs.sparkSession):
        return keep(_identify(docs, vocabulary, id_col, text_col, lang_col, folds), "languages")


def _identify(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, lang_col: str, folds: int) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    learn = rows.where(~F.col("held_out") & F.col("lang").isNotNull()).select(spaced("text").alias("text"), "lang")
    words = save(count_words(learn), "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    pieces = Pieces(read_pieces(vocabulary))
    told = docs.sparkSession.sparkContext.broadcast((pieces, fit(words, langs, pieces)))

    def run(batches):
        known, p = told.value
        most = max(1, BLOCK // max(1, len(langs)))
        for b in batches:
            raw, offs = text_bytes(b.column(3))
            total = np.zeros((b.num_rows, len(langs)))
            for i, j in slices(offs, 1 << 22):
                part = raw[offs[i] : offs[j]]
                starts, ends, text = _parts(part, offs[i : j + 1] - offs[i])
                at, code = _distinct(part, starts, ends)
                log, hashed = np.empty((len(at), len(langs))), running(part)
                for k in range(0, len(at), most):
                    few = at[k : k + most]
                    size = ends[few] - starts[few]
                    sums = forward(list(known.inside(part, starts[few], ends[few], hashed)), size, p)
                    log[k : k + most] = np.log(sums[size, np.arange(len(size))])
                for k in range(len(langs)):
                    total[i:j, k] = np.bincount(text, log[code, k], minlength=j - i)
            best = total.argmax(1) if langs else np.zeros(b.num_rows, np.int64)
            odds = 1 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(1) if langs else np.zeros(b.num_rows)
            seen = np.array(b.column(2).to_pylist(), bool) & (len(langs) > 0)
            name = [langs[k] if s else "und" for k, s in zip(best.tolist(), seen.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name, pa.string()), pa.array(np.where(seen, odds, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("doc_id", "held_out", lettered.alias("lettered"), spaced("text").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
