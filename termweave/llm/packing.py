"""Best-fit packing of token pieces into sequences under several capacities at once.

Documents become token ids and an end id; only those above the capacity are cut.  Pieces are dealt at
random into groups of bounded size and packed there, largest first: among the open bins that can take
a piece under every capacity (tokens, documents, attention cost) the one whose weighted residual norm
after it is least, or whose weighted dot product with it is largest, is chosen.  Pieces of bins that
stay open meet those of other groups in the next round, in as many groups as their number asks for,
until one group is left or a round saves less than one open bin in SAVED.  A bin whose rest is
shorter than every piece of an open bin is closed, so pieces that leave no usable rest do not go on.

Cases: null text is empty and gives a piece of the end id alone; texts of any length are tokenised
whole; repeated rows are packed each; a null id is kept; an empty table gives an empty result; ties go
to the oldest bin.  Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lean, save, scratch

#: Pieces of a group, and the least share of open bins that a round must save for another to follow.
GROUP, SAVED = 8192, 100
#: Runs of letters or signs whose ids a task keeps at most, and the longest kept.
KEPT_RUNS, KEPT_LENGTH = 400_000, 40


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] == kind)


def byte_signs() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if visible, else 256 and up."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


#: The steps before the model of vocabularies whose words WordIds knows how to split.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLITS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Kept(dict):
    """What a function gives for short strings: those asked for lately, KEPT_RUNS of them at most."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if 2 * len(self) >= KEPT_RUNS:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds:
    """The ids of a text as bytes (unsigned 32-bit, little-endian), run by run.

    The vocabulary splits a normalised text into runs whose ids don't depend on their neighbours, so a run
    is encoded once and then looked up.  Whole words are not kept: too many occur once, as signs cling to them.  Texts with characters
    outside the Latin blocks, other spaces, or a special token's opening go to the tokenizer whole, and
    so does every text if the file's steps before the model are not STEPS.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        signs = byte_signs()
        self.signs = {c: "".join(signs[b] for b in chr(c).encode()) for c in range(0x250)}
        letter, digit = _latin("L"), _latin("N")
        self.split = re.compile(f"[{letter}]+|[{digit}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\t-\\r {letter}{digit}]+").findall
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        known = all(own.get(k) == v for k, v in STEPS.items())
        self.plain = re.compile("[\t-\r -\x7e\xa1-\u012f\u0131-\u017f]*").fullmatch if known else lambda text: None
        self.runs = Kept(self._run)

    def _run(self, run: str) -> bytes:
        # the vocabulary's own model on the run's byte signs, without the steps for whole texts
        return b"".join([t.id.to_bytes(4, "little") for t in self.tok.model.tokenize(run.translate(self.signs))])

    def encode(self, text: str) -> bytes:
        text_n = text if text.isascii() else unicodedata.normalize("NFC", text)
        if self.plain(text_n) and "<|" not in text:
            return b"".join(map(self.runs.__getitem__, self.split(text_n.lower())))
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """A process's encoder of a vocabulary: the tasks that a worker runs one after another keep its words."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = PIECES.format(id=kind) + (", ids array<int>" if with_ids else "")
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        enc = encoder(tokenizer)
        for b in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                raw = enc.encode(text.as_py() or "") + end
                for k in range(0, len(raw), step):
                    part = raw[k : k + step]
                    rows.append(i)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), schema)


def best_fit(items: np.ndarray, caps: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bins of items (rows: demands, in the order they come), and what is left of each bin."""
    n, scale = len(items), weights / caps.astype(float) ** 2
    left, name = np.empty((n, items.shape[1])), np.empty(n, np.int64)
    bins, rest, live, made = np.empty(n, np.int64), np.empty((n, items.shape[1])), 0, 0
    for i, x in enumerate(items):
        at = -1
        if live:
            after = left[:live] - x
            fits = (after >= 0).all(1)
            if fits.any():
                score = (after * after) @ scale if rule == "norm" else -(left[:live] * x) @ scale
                score[~fits] = np.inf
                at = int(score.argmin())
        if at < 0:
            at, live = live, live + 1
            left[at], name[at] = caps, made
            made += 1
        left[at] -= x
        bins[i] = name[at]
        rest[name[at]] = left[at]
        if (left[at] <= 0).any():  # full in one respect: nothing fits any more; the rest keep their age
            left[at : live - 1], name[at : live - 1] = left[at + 1 : live].copy(), name[at + 1 : live].copy()
            live -= 1
    return bins, rest[:made]


def packer(caps: np.ndarray, weights: np.ndarray, rule: str, slack: float, level: int, last: bool):
    """A function that packs one group's rows and says which bins are closed."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size = rows["length"].to_numpy(float)
        bins, rest = best_fit(np.stack([size, np.ones(len(size)), size * size], 1), caps, weights, rule)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(size[order])
        first = np.searchsorted(bins[order], bins[order])
        offset = np.empty(len(size), np.int64)
        offset[order] = ends - size[order] - np.where(first > 0, ends[first - 1], 0)
        rows["sequence_id"] = (level << 50) + rows["g"] * (1 << 20) + bins
        rows["offset"] = offset
        rows["rest"] = rest[bins, 0].astype(np.int64)
        rows["closed"] = True if last else (rest[bins, 0] <= slack * caps[0])
        return rows

    return run


def pack(pieces: DataFrame, capacity: int = 4096, max_docs: int = 4096, max_attention: int | None = None, weights=(1.0, 1.0, 1.0), rule: str = "norm", slack: float = 0.01, seed: int = 29) -> DataFrame:
    """pieces with sequence_id and offset.  A bin with less than slack of its tokens left is closed.

    All three residuals weigh alike, each as a share of its capacity, so where bins leave equal tokens
    the one with fewer documents and less attention cost to spare is chosen.
    """
    with scratch(pieces.sparkSession):
        return keep(_pack(pieces, np.array([capacity, max_docs, max_attention or capacity * capacity], float), np.array(weights, float), rule, slack, seed), "sequences")


def _pack(pieces: DataFrame, caps: np.ndarray, w: np.ndarray, rule: str, slack: float, seed: int) -> DataFrame:
    fields = list(pieces.columns)
    pieces = save(pieces, "pieces")
    n, level, done, kept = pieces.count(), 0, [], [*fields, "sequence_id", "offset"]
    todo, before, held = pieces, None, None
    while True:
        groups = max(1, -(-n // GROUP))
        last = groups == 1
        dealt = todo.withColumn("g", F.least(F.floor(F.rand(seed + level) * groups), F.lit(groups - 1)).cast("long"))

        out = dealt.groupBy("g").applyInPandas(packer(caps, w, rule, slack, level, last), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", sequence_id long, offset long, rest long, closed boolean")
        out = save(out, "packed")
        bins = out.where("offset = 0").count()  # a bin's first piece
        if before is not None and bins > before:  # worse than what it was dealt from
            done.append(held.select(*kept))
            break
        done.append(out.where("closed").select(*kept))
        if last:
            break
        held = out.where("not closed")
        least = held.agg(F.min("length")).first()[0]
        if least is not None:
            done.append(held.where(F.col("rest") < least).select(*kept))
            held = held.where(F.col("rest") >= least)
        n, left = held.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if not n:
            break
        if before is not None and (before - bins) * SAVED < before:
            done.append(held.select(*kept))
            break
        todo, before, level = held.select(*fields), left, level + 1
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    return whole
