"""Personal information in free text: a linear-chain conditional random field over word shapes, decoded by Viterbi in numpy batches.

Features of a token: its shape, its lower-case form if the training table has it often enough, its ending, its first digit, whether
it is a common given name, and what parts it from the token before; the same for three tokens to either side, and pairs and triples
of neighbouring shape classes. As all of these but the last depend on one token each, their weights are summed once for each distinct
token and looked up afterwards.

Whole texts are read: a batch of texts is cut into tokens by numpy over its code points, and every token is scored for every label.
A token is open if a label other than O can pay for itself there: its score over that of O, and the most that transitions into and out
of it can gain over those of O, are positive. An entity of the best path holds an open token, as else O in place of all its tokens
would score more. So Viterbi runs over open tokens and CONTEXT tokens to either side; nothing but the model's own scores decides what that is.
A last exact check trims punctuation, takes in the rest of an address's host or a number's country, and drops what lacks the least
its type needs.

Null and empty texts have no entities and stay as they are. Repeated rows are found once. Documents without an id are skipped.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_table

TYPES = ["email", "phone", "identity_number", "street_address", "person_name"]
LABELS = ["O", *(f"{b}-{t}" for t in TYPES for b in "BI")]
L = len(LABELS)
REACH = 3
CONTEXT = 8
SENTENCES = 5_000
#: Characters cut into tokens at a time.
CHUNK = 1_000_000
SPACE, BREAK, LETTER, DIGIT, OTHER, EDGE = range(6)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point; marks belong to the letters they stand on, and NUL parts texts."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x32000):
        c = chr(cp)
        if c.isspace():
            out[cp] = SPACE
        elif c.isdigit() or c.isdecimal():
            out[cp] = DIGIT
        elif c.isalnum() or unicodedata.category(c)[0] == "M":
            out[cp] = LETTER
    out[10], out[0] = BREAK, EDGE
    return out


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 16)}"
    if not token[0].isalpha():
        return token
    if len(token) == 1:
        return "X" if token.isupper() else "x"
    if token.isupper():
        return "XX"
    if token.islower():
        return "xx"
    if token[0].isupper() and (token[1:].islower() or re.fullmatch(r"(?:Mc|Mac|De|Di|Fitz)[^\W\d_a-z][^\W\d_A-Z]+", token)):
        return "Xx"
    return "xX" if token[0].isupper() or not token.isalpha() or token.lower() != token else "xx"


@dataclass
class Tokens:
    """Tokens of many texts, with REACH edge tokens after each: its text, first and last character there, and its number among the distinct (token, gap)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    number: np.ndarray
    distinct: list[tuple[str, int]]


def tokens(texts: list[str]) -> Tokens:
    """Runs of letters, runs of digits, and single other signs; gap: what parts a token from the one before (0 nothing, 1 space, 2 line end)."""
    joined = "\0\0\0" + "".join(t.replace("\0", "\1") + "\0\0\0" for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[code]
    run = (kind == LETTER) | (kind == DIGIT)
    first = np.empty(len(code), bool)
    first[0] = True
    first[1:] = (kind[1:] != kind[:-1]) | ~run[1:]
    first &= kind > BREAK
    start = np.flatnonzero(first)
    # a run ends where the kind changes
    last = np.empty(len(code), bool)
    last[-1] = True
    last[:-1] = (kind[1:] != kind[:-1]) | ~run[:-1]
    last &= kind > BREAK
    end = np.flatnonzero(last) + 1
    gap = np.zeros(len(start), np.uint64)
    gap[1:] = start[1:] > end[:-1]
    breaks = np.flatnonzero(kind == BREAK)
    after = np.searchsorted(start, breaks)
    gap[after[after < len(start)]] = 2
    # a hash of each token: sums of mixed (code point, place)
    owner = np.cumsum(first) - 1
    place = (np.arange(len(code)) - start[owner]).astype(np.uint64)
    h = (code.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h[kind <= BREAK] = 0
    token = np.add.reduceat(h, start) * np.uint64(4) + gap
    number, unique = pd.factorize(token)
    at = np.empty(len(unique), np.int64)
    at[number[::-1]] = np.arange(len(number))[::-1]
    distinct = [(joined[a:b], g) for a, b, g in zip(start[at].tolist(), end[at].tolist(), gap[at].tolist())]
    ends = np.cumsum([3] + [len(t) + 3 for t in texts])
    text = np.searchsorted(ends, start, "right") - 1
    base = np.concatenate((ends[:-1], [0]))[text]
    edge = kind[start] == EDGE
    return Tokens(np.where(edge, -1, text), start - base, end - base, number, distinct)


class Crf:
    """Weights of token features at each offset, of shape-class pairs and triples, and of label transitions."""

    def __init__(self) -> None:
        self.features: dict[str, int] = {}
        self.classes: dict[str, int] = {}
        self.known: set[str] = set()
        self.given = {g.lower() for g in pii_table.GIVEN}

    def token_features(self, token: str, gap: int) -> list[str]:
        if token == "\0":
            return ["edge"]
        s, low = shape(token), token.lower()
        out = [f"s{s}", f"g{gap}", f"sg{s}{gap}"]
        if s[0] == "d" and token.isdigit():
            out.append(f"d{token[0]}")
        elif token[0].isalpha():
            out.append(f"w{low}" if low in self.known else "w?")
            out.append(f"n{min(len(token), 12)}")
            if low in self.given:
                out.append(f"G{s}")
            for k in (2, 3, 4):
                if len(low) > k and (e := f"e{low[-k:]}") in self.known:
                    out.append(e)
            if s == "Xx":
                out.append(f"W{low}" if low in self.known else "W?")
        return out

    def _class(self, token: str, gap: int, grow: bool) -> int:
        if token == "\0":
            return 0
        key = f"{shape(token)}{gap}"
        if grow:
            return self.classes.setdefault(key, len(self.classes) + 1)
        return self.classes.get(key, 0)

    def fit(self, table: list, epochs: int = 8, batch: int = 64, rate: float = 0.25, penalty: float = 1e-5, seed: int = 3) -> Crf:
        rng = np.random.default_rng(seed)
        cut = tokens([t for t, _ in table])
        real = np.flatnonzero(cut.text >= 0)
        bounds = np.searchsorted(cut.text[real], np.arange(len(table) + 1))
        sents, count = [], Counter()
        for i, (_, spans) in enumerate(table):
            own = real[bounds[i] : bounds[i + 1]]
            w = [cut.distinct[k] for k in cut.number[own].tolist()]
            s, e = cut.start[own], cut.end[own]
            y = np.zeros(len(w), np.int64)
            for a, b, kind in spans:
                inside = np.flatnonzero((s >= a) & (e <= b))
                y[inside] = 2 + 2 * TYPES.index(kind)
                y[inside[:1]] -= 1
            # words and endings inside names, streets and mail are chance; only what surrounds them, or street words, may be remembered by form
            for (x, _), label in zip(w, y.tolist()):
                if x[0].isalpha() and (not label or LABELS[label].endswith("street_address") or (x.islower() and len(x) < 5)):
                    low = x.lower()
                    count[low] += 1
                    if not label or LABELS[label].endswith("street_address"):
                        count.update(f"e{low[-k:]}" for k in (2, 3, 4) if len(low) > k)
            sents.append((w, y))
        self.known = {x for x, c in count.items() if c >= 6}
        data, pad, made = [], 0, {}
        for w, y in sents:
            base = [made[t] if t in made else made.setdefault(t, self.token_features(*t)) for t in w]
            cls = np.array([self._class(t, k, True) for t, k in w], np.int64)
            rows = []
            for i in range(len(w)):
                ids = []
                for o in range(-REACH, REACH + 1):
                    at = base[i + o] if 0 <= i + o < len(w) else ["edge"]
                    ids += [self.features.setdefault(f"{o}:{f}", len(self.features) + 1) for f in at]
                rows.append(ids)
                pad = max(pad, len(ids))
            data.append((rows, cls, y))
        c = len(self.classes) + 1
        self.w = np.zeros((len(self.features) + 1, L))
        self.pair, self.triple = np.zeros((c, c, L)), np.zeros((c, c, c, L))
        self.trans = np.zeros((L, L))
        h = [np.full((x.size // L, L), 1e-3) for x in (self.w, self.pair, self.triple, self.trans)]

        def step(x: np.ndarray, acc: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
            g = g - penalty * x[rows]
            acc[rows] += g * g
            x[rows] += rate * g / np.sqrt(acc[rows])

        ids = [np.array([r + [0] * (pad - len(r)) for r in rows], np.int32).reshape(-1, pad) for rows, _, _ in data]
        order = np.arange(len(data))
        for _ in range(epochs):
            rng.shuffle(order)
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                t = max(len(data[i][2]) for i in pick)
                n = len(pick)
                mask = np.zeros((n, t), bool)
                fid, y = np.zeros((n, t, pad), np.int64), np.zeros((n, t), np.int64)
                cls = np.zeros((n, t + 2), np.int64)
                for k, i in enumerate(pick):
                    m = len(data[i][2])
                    mask[k, :m], fid[k, :m], y[k, :m], cls[k, 1 : m + 1] = True, ids[i], data[i][2], data[i][1]
                a, b, d = cls[:, :-2], cls[:, 1:-1], cls[:, 2:]
                em = self.w[fid].sum(2) + self.pair[a, b] + self.triple[a, b, d]
                gold = np.eye(L)[y] * mask[..., None]
                p, joint = self._expected(em, mask)
                flat = ((gold - p) * mask[..., None])[mask]
                at_w = fid[mask].ravel()
                g = np.stack([np.bincount(at_w, np.repeat(flat[:, k], pad), len(self.w)) for k in range(L)], axis=1)
                rows = np.flatnonzero(np.bincount(at_w, minlength=len(self.w)))
                step(self.w, h[0], rows, g[rows] / n)
                # of the large tables only the rows that the batch touches
                a, b, d = a[mask], b[mask], d[mask]
                for table_, acc, key in ((self.pair.reshape(-1, L), h[1], a * c + b), (self.triple.reshape(-1, L), h[2], (a * c + b) * c + d)):
                    by = np.argsort(key, kind="stable")
                    rows, first = np.unique(key[by], return_index=True)
                    step(table_, acc, rows, np.add.reduceat(flat[by], first) / n)
                both = mask[:, 1:]
                seen = np.zeros((L, L))
                np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
                np.add.at(seen[0], y[:, 0], 1)
                step(self.trans, h[3], np.arange(L), (seen - joint) / n)
                self.w[0] = 0
        self.bad = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])
        self.trans[self.bad] = -1e4
        # the most that transitions into and out of a label can gain over those of O in its place
        t, starts = self.trans, np.array([x.startswith("I-") for x in LABELS])
        into = np.where(starts, t.max(0) - t[0, 0], (t - t[:, :1]).max(0))
        out = np.array([(t[k] - t[0])[~starts].max() for k in range(L)])
        self.lift = (into + np.maximum(out, 0))[1:].astype(np.float32)
        # the tables go to every task; single precision is plenty for decoding
        self.pair, self.triple, self.trans = self.pair.astype(np.float32), self.triple.astype(np.float32), self.trans.astype(np.float32)
        return self

    def _expected(self, em: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals (n, t, L) and summed transition marginals, by scaled forward-backward from an O before the text."""
        n, t, _ = em.shape
        e = np.exp(em - em.max(2, keepdims=True))
        e[~mask] = 1
        m = np.exp(self.trans)
        alpha, scale = np.empty_like(e), np.empty((n, t, 1))
        x = e[:, 0] * m[0]
        for i in range(t):
            if i:
                x = np.where(mask[:, i, None], (alpha[:, i - 1] @ m) * e[:, i], alpha[:, i - 1])
            scale[:, i] = x.sum(1, keepdims=True)
            alpha[:, i] = x / scale[:, i]
        beta = np.ones((n, L))
        p, joint = np.empty_like(e), np.zeros((L, L))
        p[:, t - 1] = alpha[:, t - 1]
        for i in range(t - 1, 0, -1):
            v = e[:, i] * beta / scale[:, i]
            on = mask[:, i]
            joint += np.einsum("ni,nj->ij", alpha[on, i - 1], v[on]) * m
            beta = np.where(on[:, None], v @ m.T, beta)
            p[:, i - 1] = alpha[:, i - 1] * beta
        joint[0] += p[:, 0].sum(0)
        return p, joint

    # decoding: the sums for each distinct token are made once

    def tables(self) -> None:
        """The sums by distinct token and offset."""
        self._rows: dict[tuple[str, int], int] = {}
        self._alike: dict[tuple[str, ...], int] = {}
        self._n = 0
        self._cls = np.zeros(1024, np.int64)
        self._sums = np.zeros((2 * REACH + 1, 1024, L), np.float32)

    def row(self, key: tuple[str, int]) -> int:
        fs = (*self.token_features(*key), str(self._class(*key, False)))
        at = self._alike.get(fs)
        if at is None:
            at = self._alike[fs] = self._n
            self._n += 1
            if at >= len(self._cls):
                self._cls, self._sums = np.concatenate((self._cls, np.zeros_like(self._cls))), np.concatenate((self._sums, np.zeros_like(self._sums)), axis=1)
            for o in range(-REACH, REACH + 1):
                self._sums[o + REACH, at] = self.w[[self.features.get(f"{o}:{f}", 0) for f in fs[:-1]]].sum(0)
            self._cls[at] = self._class(*key, False)
        self._rows[key] = at
        return at

    def scores(self, cut: Tokens) -> np.ndarray:
        """(token, label) scores without transitions; zero for edge tokens."""
        if not hasattr(self, "_rows") or len(self._rows) > 300_000:  # chance tokens must not pile up in a long-lived worker
            self.tables()
        get = self._rows.get
        rows = np.array([r if (r := get(k)) is not None else self.row(k) for k in cut.distinct], np.int64)[cut.number]
        n = len(rows)
        em = np.zeros((n, L), np.float32)
        if n <= 2 * REACH:
            return em
        inner, cls = em[REACH : n - REACH], self._cls[rows]
        c = len(self.pair)
        pair = cls[:-1] * c + cls[1:]
        np.take(self.pair.reshape(-1, L), pair[REACH - 1 : n - REACH - 1], axis=0, out=inner)
        inner += self.triple.reshape(-1, L)[pair[REACH - 1 : n - REACH - 1] * c + cls[REACH + 1 : n - REACH + 1]]
        for o in range(-REACH, REACH + 1):
            inner += self._sums[o + REACH][rows[REACH + o : n - REACH + o]]
        return em

    def label(self, cut: Tokens, slack: float = 0.0) -> np.ndarray:
        """The label of each token; with slack, tokens that fall short of being open by no more are decoded too."""
        em, n = self.scores(cut), len(cut.text)
        open_ = np.flatnonzero(((em[:, 1:] + self.lift).max(1) > em[:, 0] - slack) & (cut.text >= 0))
        out = np.zeros(n, np.int8)
        if not len(open_):
            return out
        # stretches of one text round open tokens
        text = cut.text[open_]
        part = np.concatenate(([True], (open_[1:] - open_[:-1] > 2 * CONTEXT + 1) | (text[1:] != text[:-1])))
        first = open_[part]
        last = open_[np.concatenate((part[1:], [True]))]
        edges = np.flatnonzero(cut.text < 0)
        lo = np.maximum(first - CONTEXT, edges[np.searchsorted(edges, first) - 1] + 1)
        hi = np.minimum(last + CONTEXT + 1, edges[np.searchsorted(edges, last)])
        order, at = np.argsort(hi - lo, kind="stable"), 0
        while at < len(order):
            # stretches of like length, at most so many tokens at a time
            pick = order[at : at + 4096]
            while len(pick) > 1 and len(pick) * (hi[pick[-1]] - lo[pick[-1]]) > 120_000:
                pick = pick[: len(pick) // 2]
            at += len(pick)
            self._viterbi(em, lo[pick], hi[pick] - lo[pick], out)
        return out

    def _viterbi(self, em: np.ndarray, lo: np.ndarray, lengths: np.ndarray, out: np.ndarray) -> None:
        """Best paths of the stretches [lo, lo + length), an O before each, written to out."""
        k, t = len(lo), int(lengths[-1])
        # stretches shorter than the longest run on into what follows; their paths end where they do
        em = em[np.minimum(lo[:, None] + np.arange(t)[None, :], len(em) - 1)]
        score, back, into = em[:, 0] + self.trans[0], np.zeros((t, k, L), np.int8), np.ascontiguousarray(self.trans.T)
        final = np.where((lengths == 1)[:, None], score, 0)
        ends = np.searchsorted(lengths, np.arange(1, t + 2))
        for i in range(1, t):
            s = score[:, None, :] + into
            back[i] = s.argmax(2)
            score = s.max(2) + em[:, i]
            final[ends[i] : ends[i + 1]] = score[ends[i] : ends[i + 1]]
        now = final.argmax(1)
        each = np.arange(k)
        for j in range(t - 1, -1, -1):
            live = ends[j]
            out[lo[live:] + j] = now[live:]
            now[live:] = back[j][each[live:], now[live:]]


@lru_cache(maxsize=2)
def trained(sentences: int = SENTENCES) -> Crf:
    """Trained on the driver from the labelled table, whose size is the parameter; three seconds or so for each thousand rows."""
    return Crf().fit(pii_table.rows(sentences))


# Small words inside family names.
PARTICLES = set("af al ap da dal de del della den der des di do dos du e el en ibn la las le los van vom von y zu zum zur ter ten bin".split())
_GIVEN = {g.lower() for g in pii_table.GIVEN}
_HOST = re.compile(r"@|[(\[]\s*at\s*[)\]]|\s+at\s+", re.I)


def checked(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The exact bounds of an entity, or None if it lacks what its type needs."""
    while a < b and not text[a].isalnum() and not (text[a] in "+(" and kind == "phone"):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    piece = text[a:b]
    digits = sum(c.isdigit() for c in piece)
    if kind == "email":
        # the rest of the host and of the user name
        if m := re.match(r"(?:[.-][^\W_]+)+", text[b : b + 80]):
            b += m.end()
        if (m := re.search(r"[\w.+-]*$", text[max(0, a - 80) : a])) and m.group().strip(".-"):
            a -= len(m.group().lstrip(".-"))
        if "@" in text[a:b]:
            a = text.index("@", a)
            a -= len(re.search(r"[^\s@;,:<>()\[\]{}'\"=|]*$", text[max(0, a - 80) : a]).group().lstrip(".-"))
        piece = text[a:b]
        host = _HOST.split(piece, maxsplit=1)
        if len(host) < 2 or not re.search(r"\.|\bdot\b", host[1], re.I) or text[b : b + 1] == ":" or host[0].lower() == "git":
            return None
    elif kind == "phone":
        if m := re.search(r"(?<!\w)\+\d{1,3}[ -]?$", text[max(0, a - 6) : a]):
            a -= len(m.group())
        if not 7 <= digits <= 20:
            return None
    elif kind == "identity_number":
        if digits < 5:
            return None
    elif kind == "street_address":
        if not digits or not any(c.isalpha() for c in piece):
            return None
        if text[b : b + 1] == "." and re.search(r"\bAve$", piece):
            b += 1
    else:
        words = re.findall(r"[^\W\d_]+", piece)
        if text[b : b + 1] == "." and len(words[-1:]) and len(words[-1]) == 1 and re.match(r"\.(?![^\W\d_])", text[b : b + 2]):
            b += 1
        if len(words) < 2 or digits or "@" in piece or "_" in piece:
            return None
        small = [w for w in words if w.islower() and len(w) > 1 and w not in PARTICLES]
        if small and (len(small) < len(words) or small[0] not in _GIVEN):  # names are written in capitals, or all small from a known given name on
            return None
    return a, b


def entities(crf: Crf, texts: list[str | None], slack: float = 0.0) -> list[list[tuple[int, int, str]]]:
    """(from, to, type) in each text, in order."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size < CHUNK):
            size += len(texts[stop] or "")
            stop += 1
        part = [t or "" for t in texts[at:stop]]
        cut = tokens(part)
        label = crf.label(cut, slack)
        hit = np.flatnonzero(label)
        if len(hit):
            y = label[hit]
            new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (y[1:] % 2 == 1) | (y[1:] > y[:-1] + 1) | (cut.text[hit][1:] != cut.text[hit][:-1])))
            first, last = hit[new], hit[np.concatenate((new[1:], [True]))]
            for i, a, b, k in zip(cut.text[first].tolist(), cut.start[first].tolist(), cut.end[last].tolist(), ((label[first] - 1) // 2).tolist()):
                if ok := checked(TYPES[k], part[i], a, b):
                    mine = out[at + i]
                    if mine and ok[0] < mine[-1][1]:  # grown into the one before
                        continue
                    mine.append((*ok, TYPES[k]))
        at = stop
    return out


def _tagged(crf: Crf, redact: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            found = entities(crf, texts)
            if not redact:
                rows = [(d, kind, t[a:b], a, b) for d, t, es in zip(ids, texts, found) for a, b, kind in es]
                yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "pii_text", "char_from", "char_to"])
                continue
            done = []
            for t, es in zip(texts, found):
                parts, at = [], 0
                for a, b, kind in es:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                done.append("".join([*parts, t[at:]]) if es else t)
            yield pd.DataFrame({"doc_id": ids, "n_pii": [len(x) for x in found], "text": done})

    return run


def find_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: int = SENTENCES) -> DataFrame:
    """(doc_id, pii_type, pii_text, char_from, char_to)."""
    rows = documents.filter(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(_tagged(trained(sentences), False), "doc_id long, pii_type string, pii_text string, char_from int, char_to int")


def redact_pii(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences: int = SENTENCES) -> DataFrame:
    """(doc_id, n_pii, text) with typed placeholders; null texts stay null."""
    rows = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(_tagged(trained(sentences), True), "doc_id long, n_pii int, text string")
