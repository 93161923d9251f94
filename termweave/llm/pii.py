"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions in numpy.

The base patterns find e-mail and IP addresses, card and phone numbers in whole texts, in linear time.
The tagger finds what they miss: spans that run into other numbers, so that a pattern's longest match
fails, and disguised forms (see disguised).  It is trained on labelled spans of at most SAMPLE documents,
those with the least hash of their id: their base spans, digit groups of a card's length whatever their
check sum, and ROUNDS copies of each text with its spans disguised or set beside other numbers; half of at
most WINDOWS windows hold spans, half none.  It reads overlapping windows of every text that hold a digit
or an at sign, written or spelt (no span is without), decodes each with the CRF, and the spans of all
windows of a text are reconciled: strongest first, never over a base span or a stronger one, never cut
by a window's edge or out of a longer word or number, and only if the span, freed of its disguise, is
valid for its kind (digits, Luhn sum, parts).

Cases: null and empty texts have no spans; texts of any length are searched whole; a null id keeps its
row; repeated rows are searched each; without labelled spans no tagger is fitted and the base spans
stand alone; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, save

KINDS = ("email", "ip", "card", "phone")
#: Documents and windows that the tagger is fitted on, at most, and disguised copies of each document.
SAMPLE, WINDOWS, ROUNDS = 3000, 4000, 2
SPAN, STRIDE, EDGE = 128, 80, 2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def ip_parts(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind as a place in KINDS) of all base spans, by start, then kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and _LOCAL_END.match(text, first - 1):
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end(), 0))
            done = m.end()
        else:
            done = at + 1 if first < at else done
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if ip_parts(m[0]):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


_AT = r"[(\[{]\s*at\s*[)\]}]"
_SPELT = re.compile(rf"(?i){_AT}|\sat\s+[a-z0-9-]+\s+dot\s")
_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def plain_email(text: str) -> str:
    """An e-mail address freed of spaces, brackets and spelt signs."""
    text = re.sub(rf"(?i)\s*(?:{_AT}|\sat\s)\s*", "@", text)
    text = re.sub(r"(?i)\s*(?:[(\[{]\s*dot\s*[)\]}]|\sdot\s)\s*", ".", text)
    return re.sub(r"\s*([@.])\s*", r"\1", text)


def valid(kind: int, text: str) -> bool:
    """Whether a tagged text, freed of its disguise, is of its kind."""
    if kind == 0:
        return bool(_PLAIN_EMAIL.fullmatch(plain_email(text)))
    if kind == 1:
        bare = re.sub(r"[\s()\[\]]", "", text)
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", bare)) and ip_parts(bare)
    digits = re.sub(r"[ ().\-/_]", "", text)
    if kind == 2:
        return bool(re.fullmatch("[0-9]{12,19}", digits)) and luhn(digits)
    apart = bool(re.search(r"[0-9)][ .\-/]+[0-9(]", text))  # a number in one piece may count anything
    return bool(re.fullmatch(r"(\(?\+|00)[0-9 ().\-/]*[0-9]", text)) and (apart or "+" in text) and 9 <= len(re.sub("[^0-9]", "", text)) <= 15


def whole(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a span is no part of a longer word or number."""
    before, after = text[start - 1 : start], text[end : end + 1]
    part = "[A-Za-z0-9_%+-]" if kind == 0 else "[0-9]"
    return not (before and re.match(part, before)) and not (after and re.match("[A-Za-z0-9_]" if kind == 0 else "[0-9]", after))


# ------------------------------------------------------------------ labelled spans

_LIKE_A_CARD = re.compile(r"(?<![0-9+.-])[0-9]{12,19}(?![0-9])")


def formed_spans(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and digit groups of a card's length: a tagger of characters can't tell their check sums."""
    base = base_spans(text)
    more = [(m.start(), m.end(), 2) for m in _LIKE_A_CARD.finditer(text) if all(m.end() <= s or e <= m.start() for s, e, _ in base)]
    return sorted([*base, *more], key=lambda s: (s[0], s[2]))


def disguised(kind: int, text: str, r: np.random.Generator) -> list[tuple[str, int | None]]:
    """Parts (text, kind or None) that a span is replaced by: a disguise, or the span beside other numbers."""
    number = lambda n: "".join(map(str, r.integers(0, 10, n)))
    if r.random() < 0.4:
        other = [(number(int(r.integers(1, 9))), None), (number(16), 2), (".".join(str(x) for x in r.integers(0, 256, 4)), 1)][int(r.integers(0, 3))]
        return [(text, kind), (" ", None), other] if kind == 3 or r.random() < 0.5 else [other, (" ", None), (text, kind)]
    pick = lambda *forms: forms[int(r.integers(0, len(forms)))]
    if kind == 0:
        at, dot = pick((" @ ", " . "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), (" (at) ", "."))
        local, _, domain = text.partition("@")
        return [(local + at + domain.replace(".", dot), 0)]
    if kind == 1:
        return [(text.replace(".", pick("[.]", " . ", "(.)", ". ")), 1)]
    if kind == 2:
        digits = re.sub("[ -]", "", text)
        return [(pick(".", "/", "_", "  ", " - ").join(digits[i : i + 4] for i in range(0, len(digits), 4)), 2)]
    digits = re.sub("[^0-9]", "", text)
    cut = len(digits) - 10 if len(digits) > 10 else 1
    groups = [digits[:cut], digits[cut : cut + 3], digits[cut + 3 : cut + 6], digits[cut + 6 :]]
    return [(pick("00", "+", "(+") + pick(" ", "/", "-", ".").join(g for g in groups if g), 3)] if r.random() < 0.7 else [("00" + text[1:], 3)]


def disguised_text(text: str, r: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with its spans disguised, and where they are then."""
    out, spans, done, n = [], [], 0, 0
    for s, e, k in formed_spans(text):
        if s < done:
            continue
        for part, kind in [(text[done:s], None), *disguised(k, text[s:e], r)]:
            if kind is not None:
                spans.append((n, n + len(part), kind))
            out.append(part)
            n += len(part)
        done = e
    return "".join([*out, text[done:]]), spans


# ------------------------------------------------------------------ the tagger

#: Characters with a class of their own; others: digit, small, capital, other letter, space, rest, none.
SIGNS = "@.-+()_%:/,;\n[]"
TAGS = 1 + 2 * len(KINDS)  # none; begin and inside of each kind
_TABLE = np.full(0x110000, 20, np.uint8)
_TABLE[0x80:] = 18
_TABLE[48:58], _TABLE[97:123], _TABLE[65:91] = 15, 16, 17
_TABLE[[9, 11, 12, 13, 32]] = 19
for _i, _c in enumerate(SIGNS):
    _TABLE[ord(_c)] = _i
CLASSES, NONE = 22, 21


def classes(text: str) -> np.ndarray:
    return _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def cut_windows(cls: np.ndarray, text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign, written or spelt."""
    spelt = [m.start() for m in _SPELT.finditer(text)]
    marks = np.flatnonzero((cls == 15) | (cls == 0))
    if spelt:
        marks = np.unique(np.concatenate([marks, spelt]))
    if not len(marks):
        return []
    last = marks // STRIDE
    some = np.unique(np.concatenate([last, np.maximum(last - (marks % STRIDE < SPAN - STRIDE), 0)]))
    return (some * STRIDE).tolist()


def windowed(cls: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.full((len(starts), SPAN), NONE, np.uint8)
    for k, s in enumerate(starts):
        part = cls[s : s + SPAN]
        out[k, : len(part)] = part
    return out


def _sig(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, an LSTM in each direction, emissions, CRF transitions; 32-bit floats."""

    def __init__(self, hidden: int = 20, wide: int = 12, seed: int = 1):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"emb": r.normal(0, 0.5, (CLASSES, wide)), "out": r.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"x{d}": r.normal(0, 1 / np.sqrt(wide), (wide, 4 * hidden)), f"h{d}": r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)), f"c{d}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, d: str, x: np.ndarray):
        h, n, t = self.h, x.shape[1], x.shape[0]
        wx, wh, b = self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"]
        z = x @ wx + b
        hs, cs, gates = np.zeros((t + 1, n, h), np.float32), np.zeros((t + 1, n, h), np.float32), np.empty((t, n, 4 * h), np.float32)
        for k in range(t):
            a = z[k] + hs[k] @ wh
            g = gates[k]
            g[:, : 3 * h] = _sig(a[:, : 3 * h])
            g[:, 3 * h :] = np.tanh(a[:, 3 * h :])
            cs[k + 1] = g[:, h : 2 * h] * cs[k] + g[:, :h] * g[:, 3 * h :]
            hs[k + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[k + 1])
        return hs, cs, gates

    def emissions(self, w: np.ndarray):
        """(time, window, tag) scores of windows of classes, and what the way back needs."""
        x = self.p["emb"][w.T]
        f, b = self._lstm("f", x), self._lstm("b", x[::-1])
        both = np.concatenate([f[0][1:], b[0][1:][::-1]], 2)
        return both @ self.p["out"] + self.p["bias"], (x, f, b, both)

    def decode(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window (window, time), and each place's emission above none's."""
        e, _ = self.emissions(w)
        t, n, k = e.shape
        best, back = e[0], np.empty((t, n, k), np.int8)
        for i in range(1, t):
            s = best[:, :, None] + self.p["trans"]
            back[i] = s.argmax(1)
            best = s.max(1) + e[i]
        tags = np.empty((t, n), np.int8)
        tags[-1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[i - 1] = back[i, np.arange(n), tags[i]]
        return tags.T, (e.max(2) - e[:, :, 0]).T

    def gradients(self, w: np.ndarray, y: np.ndarray) -> dict:
        e, (x, f, b, both) = self.emissions(w)
        t, n, k = e.shape
        a = self.p["trans"]
        lse = lambda s, axis: (m := s.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(s - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for i in range(1, t):
            alpha[i] = e[i] + lse(alpha[i - 1][:, :, None] + a, 1)
        for i in range(t - 2, -1, -1):
            beta[i] = lse(a + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        ta = np.zeros_like(a)
        for i in range(1, t):
            ta += np.exp(alpha[i - 1][:, :, None] + a + (e[i] + beta[i] - z[:, None])[:, None, :]).sum(0)
        yt = y.T
        np.subtract.at(de, (np.arange(t)[:, None], np.arange(n), yt), 1)
        np.subtract.at(ta, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        de /= n
        g = {"trans": ta / n, "out": both.reshape(-1, 2 * self.h).T @ de.reshape(-1, k), "bias": de.sum((0, 1))}
        dboth, dx = de @ self.p["out"].T, np.zeros_like(x)
        for d, (hs, cs, gates), dh, flip in (("f", f, dboth[..., : self.h], 1), ("b", b, dboth[::-1, :, self.h :], -1)):
            h, wh = self.h, self.p[f"h{d}"]
            da_all, back_h, back_c = np.empty_like(gates), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for i in range(t - 1, -1, -1):
                gi, gf, go, gg = (gates[i][:, j * h : (j + 1) * h] for j in range(4))
                th = np.tanh(cs[i + 1])
                dhi = dh[i] + back_h
                dc = back_c + dhi * go * (1 - th * th)
                da = da_all[i]
                da[:, :h] = dc * gg * gi * (1 - gi)
                da[:, h : 2 * h] = dc * cs[i] * gf * (1 - gf)
                da[:, 2 * h : 3 * h] = dhi * th * go * (1 - go)
                da[:, 3 * h :] = dc * gi * (1 - gg * gg)
                back_h, back_c = da @ wh.T, dc * gf
            flat = da_all.reshape(-1, 4 * h)
            g[f"h{d}"], g[f"c{d}"] = hs[:-1].reshape(-1, h).T @ flat, flat.sum(0)
            g[f"x{d}"] = x[::flip].reshape(-1, x.shape[2]).T @ flat
            dx += (da_all @ self.p[f"x{d}"].T)[::flip]
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], w.T, dx)
        return g

    def fit(self, w: np.ndarray, y: np.ndarray, steps: int = 300, batch: int = 32, rate: float = 0.02, seed: int = 2) -> "Tagger":
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        while step < steps:
            order = r.permutation(len(w))
            for i in range(0, min(len(w), batch * (steps - step)), batch):
                k = order[i : i + batch]
                g = self.gradients(w[k], y[k])
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for name, a in g.items():
                    a = a * min(1.0, 5 / (norm + 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * a
                    v[name] = 0.999 * v[name] + 0.001 * a * a
                    self.p[name] -= (now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def tags_of(n: int, spans) -> np.ndarray:
    out = np.zeros(n, np.int8)
    for s, e, k in spans:
        if not out[s:e].any():
            out[s:e] = 2 + 2 * k
            out[s] = 1 + 2 * k
    return out


def tagged_spans(tags: np.ndarray, strength: np.ndarray, start: int, length: int):
    """(strength, start, end, kind) of a window's spans that its edges do not cut."""
    inner = min(SPAN, length - start)
    i = 0
    while i < inner:
        if tags[i] == 0:
            i += 1
            continue
        kind, j = (int(tags[i]) - 1) // 2, i + 1
        while j < inner and tags[j] == 2 + 2 * kind:
            j += 1
        if (i >= EDGE or start == 0) and (j <= SPAN - EDGE or start + j >= length):
            yield float(strength[i:j].mean()), start + i, start + j, kind
        i = j


def reconcile(text: str, base: list, found: list) -> list:
    """Base spans, and of the found ones, strongest first, what is valid and lies over no span taken before."""
    taken = [(s, e) for s, e, _ in base]
    more = []
    for _, s, e, k in sorted(set(found), key=lambda x: (-x[0], x[1:])):
        while s < e and text[e - 1].isspace():
            e -= 1
        if all(e <= a or b <= s for a, b in taken) and whole(k, text, s, e) and valid(k, text[s:e]):
            taken.append((s, e))
            more.append((s, e, k))
    return more


def fit(docs: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger of the base spans in a bounded sample of windows; None if there are none."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull())
    marked = rows.where(F.col("_text").rlike("[0-9]{3}|@")).select("_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    marked = F.broadcast(save(marked.distinct(), "sample"))  # at most `sample` ids

    def label(batches):
        for b in batches:
            w, y = [], []
            for text in b.column(0).to_pylist():
                r = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                for t, spans in [(text, formed_spans(text)), *(disguised_text(text, r) for _ in range(ROUNDS))]:
                    cls = classes(t)
                    tags = tags_of(len(cls), spans)
                    starts = cut_windows(cls, t)
                    w += [x.tobytes() for x in windowed(cls, starts)]
                    y += [np.pad(tags[s : s + SPAN], (0, max(0, SPAN - len(tags[s : s + SPAN])))).tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(y, pa.binary())], ["w", "y"])

    got = rows.where("_text is not null").join(marked, "_id").select("_text").mapInArrow(lean(label), "w binary, y binary").distinct()
    held = F.length(F.replace(F.hex("y"), F.lit("00"), F.lit(""))) > 0
    got = save(got.withColumn("held", held), "windows")
    order = [F.xxhash64("w"), "w", "y"]
    some = [r for h in (True, False) for r in got.where(F.col("held") == h).orderBy(*order).limit(windows // 2).collect()]  # at most `windows` rows
    w = np.array([np.frombuffer(r["w"], np.uint8) for r in some]).reshape(len(some), SPAN)
    y = np.array([np.frombuffer(r["y"], np.int8) for r in some]).reshape(len(some), SPAN)
    return Tagger().fit(w, y) if y.any() else None


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def all_spans(texts: list[str], tagger: Tagger | None) -> list[list]:
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    if tagger is not None:
        pending: list[tuple[int, int, int]] = []
        parts: list[np.ndarray] = []

        def flush():
            w = np.concatenate(parts)
            for lo in range(0, len(w), 512):
                tags, strength = tagger.decode(w[lo : lo + 512])
                for n in np.flatnonzero(tags.any(1)):
                    i, start, length = pending[lo + n]
                    found[i] += tagged_spans(tags[n], strength[n], start, length)
            pending.clear()
            parts.clear()

        for i, t in enumerate(texts):
            cls = classes(t)
            starts = cut_windows(cls, t)
            if starts:
                parts.append(windowed(cls, starts))
                pending += [(i, s, len(cls)) for s in starts]
            if len(pending) >= 4096:
                flush()
        if pending:
            flush()
    out = []
    for t, b, f in zip(texts, base, found):
        rows = [(s, e, k, True) for s, e, k in b] + [(s, e, k, False) for s, e, k in (reconcile(t, b, f) if f else [])]
        out.append(sorted(rows, key=lambda r: (r[0], r[2])))
    return out


def find(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, base) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                spans = all_spans([t or "" for t in part.column(1).to_pylist()], tagger)
                rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": x} for s, e, k, x in r] for r in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, struct)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in brackets; overlapping spans by the first's."""
    names = [f.name for f in docs.schema]
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = part.column(at).to_pylist()
                out = []
                for t, spans in zip(texts, all_spans([t or "" for t in texts], tagger)):
                    pieces, done = [], 0
                    for s, e, k, _ in spans:
                        if s >= done:
                            pieces += [t[done:s], f"[{KINDS[k].upper()}]"]
                        done = max(done, e)
                    out.append(t if not spans else "".join([*pieces, t[done:]]))
                cols = [pa.array(out, pa.string()) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(lean(run), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text, from find()."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"))
