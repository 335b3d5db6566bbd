"""Toxicity by a linear-chain conditional random field over tokens (operator 9).

Token labels come from document labels: in the training sample, words and word beginnings whose documents (or documents with two
or more of them) are significantly and mostly toxic mark the tokens of toxic documents; every other token is clean. A two-state chain with features of the
word, its beginnings, its ending, its shape and its neighbours is fitted on those tokens by gradient descent in numpy.
Forward-backward marginals tag tokens; a logistic layer over a document's marginals gives its score, and runs of tagged tokens
its spans.

A chain spans a whole document: its tokens are laid out in pieces of PIECE, each piece is reduced to the 2 x 2 matrix that
carries a state across it, the states at all piece ends follow from a scan over those matrices, and all pieces of a batch then
run side by side from the states that reach them. The result is that of one uncut chain, in vectorised steps.

Defined edge cases: null, empty and wordless texts get the score of a text without toxic tokens; texts of any length are
tagged whole; without any labelled row of both kinds every score is 0; a null doc_id is scored but never learned from, and of
an id with both labels 1 counts; equal texts score alike, and a marginal or score of exactly one half tags; spans are offsets
into the text as it is, whatever lower-casing does to its length; other columns never enter (kept ones are passed through); an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from lexloom.llm.sampling import labelled_rows

#: sample bounds: documents of each label; pieces of a document, drawn by hash over its whole text where it has more
PER_LABEL, MAX_PIECES = 1500, 256
PIECE = 64
DIMS = 1 << 18
CACHE = 300_000
OWN, POOLED = 7, 6
_TOKEN = re.compile(r"[^\W_]+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: OWN of its own, and what it tells the token after it and the one before it."""
    n = len(word)
    names = [f"w{word}", f"e{word[-3:]}", f"l{min(n, 12)}", *(f"b{word[:k]}" if n >= k else "-" for k in (4, 5, 6, 7)), f"p{word}", f"n{word}"]
    return [zlib.crc32(x.encode()) % DIMS for x in names]


def words_of(text: str) -> list[str]:
    """Lower-cased tokens of a text, one for each token of the text as it is."""
    low = text.lower()
    return _TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in _TOKEN.findall(text)]


def marginals(emission: np.ndarray, real: np.ndarray, log_move: np.ndarray, log_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of two-state chains. emission: (chains, steps) log-odds of state 1; real: steps that exist (a prefix).

    Returns P(state 1) per step, the expected moves (2, 2) and the expected starts (2,), summed over all chains.
    """
    n, steps = emission.shape
    odds = np.exp(np.clip(emission, -30, 30))
    move, start = np.exp(log_move), np.exp(log_start)
    fwd, back = np.empty((steps, 2, n)), np.empty((steps, 2, n))
    a0, a1 = np.full(n, start[0]), start[1] * odds[:, 0]
    for t in range(steps):
        if t:
            a0, a1 = a0 * move[0, 0] + a1 * move[1, 0], (a0 * move[0, 1] + a1 * move[1, 1]) * odds[:, t]
        s = a0 + a1
        a0, a1 = a0 / s, a1 / s
        fwd[t] = a0, a1
    b0, b1 = np.ones(n), np.ones(n)
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            live = real[:, t + 1]
            c1 = b1 * odds[:, t + 1]
            d0, d1 = move[0, 0] * b0 + move[0, 1] * c1, move[1, 0] * b0 + move[1, 1] * c1
            s = d0 + d1
            b0, b1 = np.where(live, d0 / s, 1.0), np.where(live, d1 / s, 1.0)
        back[t] = b0, b1
    both = fwd * back
    p = (both[:, 1] / both.sum(axis=1)).T
    pair = np.zeros((2, 2))
    for t in range(1, steps):
        out = [fwd[t - 1, i] * move[i, j] * back[t, j] * (odds[:, t] if j else 1.0) for i in (0, 1) for j in (0, 1)]
        total = sum(out)
        pair += np.array([(x / total * real[:, t]).sum() for x in out]).reshape(2, 2)
    first = p[real[:, 0], 0].sum() if steps else 0.0
    return np.where(real, p, 0.0), pair, np.array([real[:, 0].sum() - first, first])


def laid_out(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens of consecutive documents in a (pieces, PIECE) table: flat indexes, the mask of real steps, and each document's first piece."""
    rows = [-(-n // PIECE) for n in sizes]
    first = np.concatenate(([0], np.cumsum(rows))).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *(s * PIECE + np.arange(n) for s, n in zip(first, sizes))]).astype(np.int64)
    real = np.zeros((int(first[-1]), PIECE), bool)
    real.reshape(-1)[flat] = True
    return flat, real, first


@dataclass
class Tagger:
    """Fitted chain and document layer."""

    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray
    layer: np.ndarray
    fitted: bool = True

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, 3): log-odds of the word's own features, and what it adds to the token after it and the one before it."""
        w = self.weights[np.array([features(x) for x in words], np.int64).reshape(-1, OWN + 2)]
        return np.column_stack([w[:, :OWN].sum(axis=1), w[:, OWN], w[:, OWN + 1]])

    def documents(self, texts: list[str], cache: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of texts and their token marginals. cache: word -> row of the table of emissions, which it holds under the empty word."""
        tokens = [words_of(t) for t in texts]
        new = list({w for ws in tokens for w in ws}.difference(cache))
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list({w for ws in tokens for w in ws})
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            before = cache.get("", np.zeros((0, 3)))
            cache.update(zip(some, range(len(before), len(before) + len(some))))
            cache[""] = np.concatenate([before, self.emissions(some)])
        sizes = [len(ws) for ws in tokens]
        flat, real, first = laid_out(sizes)
        if not len(flat):
            return self.score([np.zeros(0)] * len(texts)), [np.zeros(0)] * len(texts)
        told = cache[""][np.fromiter((cache[w] for ws in tokens for w in ws), np.int64, sum(sizes))]
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1][np.array(sizes) > 0]
        emission = told[:, 0].copy()
        after, before = told[:-1, 1].copy(), told[1:, 2].copy()
        after[begins[1:] - 1] = 0  # neighbours in the list, not in a document
        before[begins[1:] - 1] = 0
        emission[1:] += after
        emission[:-1] += before
        table = np.zeros(real.shape)
        table.reshape(-1)[flat] = emission
        p = whole_marginals(table, real, first, self.move, self.start).reshape(-1)[flat]
        each = np.split(p, np.cumsum(sizes)[:-1])
        return self.score(each), each

    def score(self, each: list[np.ndarray]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(each))
        z = pooled(each) @ self.layer
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def carried(odds: np.ndarray, live: np.ndarray, move: np.ndarray, first_move: np.ndarray) -> np.ndarray:
    """(pieces, 2, 2): the matrix of each piece that takes the state before it to the state after it. odds, live: (steps, pieces);
    first_move: (pieces, 2, 2), the move into a piece's first step."""
    n = odds.shape[1]
    out = first_move.copy()
    out[:, :, 1] *= odds[0][:, None]
    full = live.all(axis=1)
    for t in range(1, len(odds)):
        to0 = out[:, :, 0] * move[0, 0] + out[:, :, 1] * move[1, 0]
        to1 = (out[:, :, 0] * move[0, 1] + out[:, :, 1] * move[1, 1]) * odds[t][:, None]
        if not full[t]:
            on = live[t][:, None]
            to0, to1 = np.where(on, to0, out[:, :, 0]), np.where(on, to1, out[:, :, 1])
        if t % 8 == 0:
            scale = (to0 + to1).sum(axis=1)[:, None]
            to0, to1 = to0 / scale, to1 / scale
        out[:, :, 0], out[:, :, 1] = to0, to1
    return out / out.sum(axis=(1, 2)).reshape(n, 1, 1)


def whole_marginals(emission: np.ndarray, real: np.ndarray, first: np.ndarray, log_move: np.ndarray, log_start: np.ndarray) -> np.ndarray:
    """P(state 1) per step of chains that run through several rows. emission: (pieces, steps) log-odds of state 1; real: steps
    that exist (a prefix of each row, all of it but in a chain's last row); first: the first row of each chain, and the end."""
    odds = np.exp(np.clip(emission, -30, 30)).T.copy()
    live = real.T
    move, start = np.exp(log_move), np.exp(log_start)
    n, n_rows = odds.shape[1], np.diff(first)
    # Whatever state is thought to be ahead of a chain, its first step is drawn from `start`.
    first_move = np.tile(move, (n, 1, 1))
    first_move[first[:-1][n_rows > 0]] = start
    ahead, behind = np.tile([1.0, 0.0], (n, 1)), np.ones((n, 2))
    later = [first[:-1][n_rows > k] + k for k in range(1, int(n_rows.max(initial=0)))]
    if later:
        through = carried(odds, live, move, first_move)
        for rows in later:
            state = np.einsum("ni,nij->nj", ahead[rows - 1], through[rows - 1])
            ahead[rows] = state / state.sum(axis=1, keepdims=True)
        for rows in reversed(later):
            state = np.einsum("nij,nj->ni", through[rows], behind[rows])
            behind[rows - 1] = state / state.sum(axis=1, keepdims=True)
    a = ahead[:, 1] / ahead[:, 0]
    r = (first_move[:, 0, 1] + a * first_move[:, 1, 1]) / (first_move[:, 0, 0] + a * first_move[:, 1, 0]) * odds[0]
    fwd = np.empty(odds.shape)
    fwd[0] = r
    for t in range(1, len(odds)):
        r = (move[0, 1] + r * move[1, 1]) / (move[0, 0] + r * move[1, 0]) * odds[t]
        fwd[t] = r
    last = behind[:, 1] / behind[:, 0]
    b = last
    for t in range(len(odds) - 1, -1, -1):
        if t < len(odds) - 1:
            c = b * odds[t + 1]
            b = np.where(live[t + 1], (move[1, 0] + move[1, 1] * c) / (move[0, 0] + move[0, 1] * c), last)
        fwd[t] *= b
    fwd /= 1 + fwd
    return np.where(live, fwd, 0.0).T


def pooled(each: list[np.ndarray]) -> np.ndarray:
    """Document features of token marginals: bias, tagged tokens (log), largest marginal, second largest, density of tags, and
    the evidence of all tokens together (minus the logarithm of the chance that none is toxic)."""
    out = np.zeros((len(each), POOLED))
    out[:, 0] = 1
    for k, p in enumerate(each):
        if len(p):
            top = np.partition(p, -2)[-2:] if len(p) > 1 else np.array([0.0, p[0]])
            total = p[p >= 0.5].sum()
            none = -np.log(1.001 - p[p >= 0.3]).sum()
            out[k, 1:] = np.log1p(total), top[1], top[0], min(1.0, 20 * total / len(p)), np.log1p(none)
    return out


def marking_features(docs: list[np.ndarray], seen: list[np.ndarray], y: np.ndarray) -> set[int]:
    """Hashed features of docs whose documents are mostly toxic (precision 0.85), beyond the chance that many features leave.

    Copies of a document support a feature once: documents count by a minimum hash of the rarer features seen in them, and of
    three such hashes the one with the fewest distinct values decides.
    """
    base = y.mean()
    hits, all_hits = np.zeros((2, DIMS), np.int64), np.zeros(DIMS, np.int64)
    for fs, every, label in zip(docs, seen, y):
        hits[label, fs] += 1
        all_hits[every] += 1
    chance = np.log(max((hits[1] >= 4).sum(), 1)) + 2

    def marks(clean: int, toxic: int) -> bool:
        if toxic < 4 or toxic < 0.85 * (clean + toxic):
            return False
        p = toxic / (clean + toxic)
        return toxic * np.log(p / base) + (clean * np.log((1 - p) / (1 - base)) if clean else 0) > chance

    likely = {int(f) for f in np.flatnonzero(hits[1]) if marks(*hits[:, f])}
    prime = (1 << 31) - 1
    factors = np.random.default_rng(5).integers(1, prime, (3, 2))
    rare = all_hits <= max(3, 0.02 * len(docs))
    own = [fs[rare[fs]] for fs in seen]
    signatures = [[int(((a * (fs + 1) + b) % prime).min()) if len(fs) else -1 - k for k, fs in enumerate(own)] for a, b in factors]
    where = defaultdict(list)
    for k, fs in enumerate(docs):
        if y[k]:
            for f in likely.intersection(fs.tolist()):
                where[f].append(k)
    return {f for f, ks in where.items() if marks(int(hits[0, f]), min(len({s[k] for k in ks}) for s in signatures))}


def marked_tokens(token: np.ndarray, edges: np.ndarray, usable: np.ndarray, skip: int, y: np.ndarray) -> np.ndarray:
    """Which tokens of toxic documents are toxic: those with a feature that marks them by being there, or by being there twice or more."""
    seen, twice = [], []
    for a, b in zip(edges, edges[1:]):
        fs, n = np.unique(usable[token[a:b]], return_counts=True)
        n = n[fs != skip]
        fs = fs[fs != skip]
        seen.append(fs)
        twice.append(fs[n >= 2])
    once = np.zeros(DIMS, bool)
    once[list(marking_features(seen, seen, y))] = True
    often = np.zeros(DIMS, bool)
    often[list(marking_features(twice, seen, y))] = True
    by_type = once[usable].any(axis=1)
    gold = np.zeros(len(token), bool)
    for k in np.flatnonzero(y):
        here = slice(edges[k], edges[k + 1])
        again = twice[k][often[twice[k]]]
        gold[here] = by_type[token[here]] | np.isin(usable[token[here]], again).any(axis=1)
    return gold


def pieces_of(text: str) -> list[str]:
    """The tokens of a text in pieces of PIECE (joined by spaces); of more than MAX_PIECES those of least hash, in order."""
    words = words_of(text)
    out = [" ".join(words[at : at + PIECE]) for at in range(0, len(words), PIECE)]
    if len(out) > MAX_PIECES:
        kept = sorted(range(len(out)), key=lambda k: (zlib.crc32(f"{k}:{out[k]}".encode()), k))[:MAX_PIECES]
        out = [out[k] for k in sorted(kept)]
    return out


def train(texts: list[str], labels: list[int], epochs: int = 25) -> Tagger:
    return train_pieces([pieces_of(t) for t in texts], labels, epochs)


def train_pieces(docs: list[list[str]], labels: list[int], epochs: int = 25) -> Tagger:
    """docs: the pieces of each document. Every piece is a chain of its own here."""
    y = np.array(labels, np.int64)
    blank = Tagger(np.zeros(DIMS), np.zeros((2, 2)), np.array([0.0, -6.0]), np.zeros(POOLED), fitted=False)
    if len(set(labels)) < 2:
        return blank
    types: dict[str, int] = {}
    rows, owner = [], []
    for k, pieces in enumerate(docs):  # token lists of all documents together would crowd the driver
        for piece in pieces:
            rows.append(np.array([types.setdefault(w, len(types)) for w in piece.split(" ")], np.int32))
            owner.append(k)
    if not rows:
        return blank
    table = np.empty((len(types), OWN + 2), np.int32)
    for k, w in enumerate(types):
        table[k] = features(w)
    del types
    usable = table[:, [0, 3, 4, 5, 6]]  # the word and its beginnings can mark tokens
    skip = zlib.crc32(b"-") % DIMS
    sizes, owner = np.array([len(r) for r in rows]), np.array(owner)
    token, doc = np.concatenate(rows), np.repeat(owner, sizes)
    edges = np.searchsorted(doc, np.arange(len(docs) + 1))
    flat, real, _ = laid_out(sizes.tolist())
    place, gold = np.zeros(real.shape, np.int32), np.zeros(real.shape, np.int8)
    place.reshape(-1)[flat] = token
    gold.reshape(-1)[flat] = marked_tokens(token, edges, usable, skip, y)
    g_pair = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & real[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)], float)
    g_start = np.array([(gold[:, 0] == k).sum() for k in (0, 1)], float)
    weights, move, start = np.zeros(DIMS), np.zeros((2, 2)), np.array([0.0, -4.0])
    move[:, 1] = -4.0
    square = np.full(DIMS, 1e-3)

    def emitted(at: int) -> tuple[np.ndarray, np.ndarray]:
        live, some = real[at : at + 4096], place[at : at + 4096]
        out = solo[some]
        out[:, 1:] += told[0][some[:, :-1]]
        out[:, :-1] += np.where(live[:, 1:], told[1][some[:, 1:]], 0)
        return out, live

    for _ in range(epochs):
        solo, told = weights[table[:, :OWN]].sum(axis=1), weights[table[:, OWN:]].T
        slope, pair, first = np.zeros((3, len(table))), np.zeros((2, 2)), np.zeros(2)
        for s in range(0, len(real), 4096):
            emission, live = emitted(s)
            p, more, begins = marginals(emission, live, move, start)
            d, some = np.where(live, gold[s : s + 4096] - p, 0), place[s : s + 4096]
            slope[0] += np.bincount(some.reshape(-1), d.reshape(-1), len(table))
            slope[1] += np.bincount(some[:, :-1].reshape(-1), d[:, 1:].reshape(-1), len(table))
            slope[2] += np.bincount(some[:, 1:].reshape(-1), np.where(live[:, 1:], d[:, :-1], 0).reshape(-1), len(table))
            pair += more
            first += begins
        g = np.bincount(table[:, :OWN].reshape(-1), np.repeat(slope[0], OWN), DIMS) - 0.02 * weights
        g += np.bincount(table[:, OWN], slope[1], DIMS) + np.bincount(table[:, OWN + 1], slope[2], DIMS)
        g[skip] = 0
        square += g * g
        weights += 0.6 * g / np.sqrt(square)
        move += 0.5 * (g_pair - pair) / np.maximum(g_pair.sum(axis=1, keepdims=True), 1)
        start += 0.5 * (g_start - first) / max(g_start.sum(), 1)
    solo, told = weights[table[:, :OWN]].sum(axis=1), weights[table[:, OWN:]].T
    filled = np.zeros(real.shape, np.float32)
    for s in range(0, len(real), 4096):
        emission, live = emitted(s)
        filled[s : s + 4096] = whole_marginals(emission, live, np.arange(len(live) + 1), move, start)
    p = filled.reshape(-1)[flat].astype(float)
    x, w = pooled(np.split(p, edges[1:-1])), np.zeros(POOLED)
    for _ in range(30):  # Newton steps of a lightly penalised logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - q) - 0.1 * w
        w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(POOLED), grad)
    return Tagger(weights, move, start, w)


def fit(docs: DataFrame, labels: DataFrame, where: Column, per_label: int = PER_LABEL) -> Tagger:
    """Fitted on up to MAX_PIECES pieces of up to per_label documents of each label: no more than that reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                cut = [pieces_of(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cut, pa.list_(pa.string()))], names=["doc_id", "label", "pieces"])

    rows = labelled_rows(docs, labels, "toxic", per_label, where)
    if rows is None:
        return train_pieces([], [])
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label long, pieces array<string>").collect()
    got.sort(key=lambda r: r["doc_id"])
    return train_pieces([r["pieces"] for r in got], [r["label"] for r in got])


def spans_of(text: str, p: np.ndarray, at_least: float = 0.5) -> list[dict]:
    """Runs of tagged tokens as code-point offsets with their mean marginal."""
    out: list[dict] = []
    if not len(p) or p.max() < at_least:
        return out
    last = -2
    for k, m in enumerate(_TOKEN.finditer(text)):
        if k < len(p) and p[k] >= at_least:
            if k == last + 1:
                out[-1]["end"] = m.end()
                out[-1]["scores"].append(float(p[k]))
            else:
                out.append({"begin": m.start(), "end": m.end(), "scores": [float(p[k])]})
            last = k
    return [{"begin": s["begin"], "end": s["end"], "score": sum(s["scores"]) / len(s["scores"])} for s in out]


def tag(df: DataFrame, model: Tagger, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted, spans (begin, end, score); with keep: the input's own columns and only clean documents."""
    cols = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                score, each = model.documents(texts, cache)
                if keep:
                    yield part.filter(pa.array(score < 0.5))
                    continue
                spans = [spans_of(t, p) for t, p in zip(texts, each)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "score", "predicted", "spans"])

    if keep:
        return df.mapInArrow(run, df.schema).select(*cols)
    id_type = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double, predicted int, spans array<struct<begin:int,end:int,score:double>>")
