"""Language identification by a bidirectional gated recurrent network over bytes (operator 6).

A gated recurrent unit reads the bytes of a window forwards, another one backwards; every position gets a distribution over
the learned languages from both states, and a document's probabilities are the mean over all its positions. The network is
trained in numpy by backpropagation through time on a bounded sample. A text is read whole, in windows of CORE bytes that begin
at characters and reach MARGIN bytes into their neighbours on either side: only a window's core is labelled, from states that
have read what lies around it. Thousands of windows advance together and memory is bounded.

Defined edge cases: null texts and texts without a letter are `und` with score 0; texts of any length are read whole; without
any labelled row everything is `und`; bytes never seen in training have zero input weights; ties of two languages go to the one
that sorts first; doc_ids may be of any type, and rows without one are labelled but never learned from; repeated rows are
labelled alike, and of rows that share id and language one is learned from; other columns never enter; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: sample bounds: documents in all, documents of a language (at least LEAST of each, however many languages there are), and
#: windows of a document, drawn by hash over its whole text
TOTAL, PER_LANG, LEAST, FIT_WINDOWS = 20_000, 300, 8, 16
CORE, MARGIN, HIDDEN = 128, 16, 12
#: training steps, and more for each language; windows of a step
STEPS, STEPS_PER_LANG, BATCH = 260, 4, 128
#: windows that advance together in prediction
ROWS = 2048


def squash(x: np.ndarray, work: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the candidate's squashing function, several times cheaper than exponentials."""
    np.abs(x, out=work)
    work += 1
    return np.divide(x, work, out=x)


def gate(x: np.ndarray, work: np.ndarray) -> np.ndarray:
    """The same function moved to (0, 1)."""
    squash(x, work)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    """inputs[d][g]: (256, H) rows added to gate g by a byte; loops[d][g]: (H, H); g is update, reset, candidate."""

    langs: list[str]
    inputs: np.ndarray
    loops: np.ndarray
    head: np.ndarray
    bias: np.ndarray

    def states(self, bytes_: np.ndarray, live: np.ndarray, way: int, keep: list | None = None) -> np.ndarray:
        """(steps, rows, H) states of one direction. bytes_: (steps, rows); live: real positions, a prefix of every row."""
        steps, rows = bytes_.shape
        hidden = self.loops.shape[-1]
        (ez, er, en), (uz, ur, un) = self.inputs[way], self.loops[way]
        out = np.empty((steps, rows, hidden), self.loops.dtype)
        h = np.zeros((rows, hidden), self.loops.dtype)
        full = live.all(axis=1)
        places = bytes_.astype(np.intp)
        z, r, n, c, work = (np.empty_like(h) for _ in range(5))
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            if keep is not None:
                z, r, n, c = (np.empty_like(h) for _ in range(4))
            b = places[t]
            np.take(ez, b, axis=0, out=z, mode="clip")
            z += np.matmul(h, uz, out=work)
            gate(z, work)
            np.take(er, b, axis=0, out=r, mode="clip")
            r += np.matmul(h, ur, out=work)
            gate(r, work)
            np.take(en, b, axis=0, out=n, mode="clip")
            np.matmul(h, un, out=c)
            n += np.multiply(r, c, out=work)
            squash(n, work)
            new = out[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            if not full[t]:
                np.copyto(new, h, where=~live[t][:, None])
            if keep is not None:
                keep.append((t, b, h, z, r, n, c))
            h = new
        return out

    def pooled(self, bytes_: np.ndarray, live: np.ndarray, core: np.ndarray) -> np.ndarray:
        """Sum over core positions of the language distribution: (rows, languages)."""
        f, b = self.states(bytes_, live, 0), self.states(bytes_, live, 1)
        steps, rows, hidden = f.shape
        p = f.reshape(-1, hidden) @ self.head[:hidden]
        p += b.reshape(-1, hidden) @ self.head[hidden:]
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= (core.reshape(-1) / p.sum(axis=1, dtype=np.float32))[:, None].astype(np.float32)
        return p.reshape(steps, rows, -1).sum(axis=0)


@dataclass
class Windows:
    """Windows of consecutive texts in one byte array: the core of window k is [cut[k], end[k]), read from lo[k] to hi[k]."""

    flat: np.ndarray
    doc: np.ndarray
    cut: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def table(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, rows) bytes, mask of real positions (a prefix of every window) and mask of core positions."""
        lo, hi = self.lo[rows], self.hi[rows]
        at = lo[None, :] + np.arange(int((hi - lo).max(initial=0)))[:, None]
        live = at < hi
        core = (at >= self.cut[rows]) & (at < self.end[rows])
        return np.where(live, self.flat[np.minimum(at, len(self.flat) - 1)], 0), live, core


def windows(raw: list) -> Windows:
    """Windows of UTF-8 texts (bytes or buffers)."""
    flat = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    begins = ends - np.array([len(x) for x in raw], np.int64)
    n = -(-(ends - begins) // CORE)
    doc = np.repeat(np.arange(len(raw)), n)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    k = np.arange(len(doc)) - first[doc]

    def at_character(place: np.ndarray) -> np.ndarray:
        for _ in range(3):  # a character has at most three bytes after its first
            inside = (place > begins[doc]) & (flat[np.minimum(place, len(flat) - 1)] & 0xC0 == 0x80) & (place < ends[doc])
            place = place - inside
        return place

    cut = at_character(begins[doc] + k * CORE)
    end = np.where(k + 1 < n[doc], np.append(cut[1:], 0), ends[doc])
    return Windows(flat, doc, cut, end, at_character(np.maximum(cut - MARGIN, begins[doc])), at_character(np.minimum(end + MARGIN, ends[doc])))


def drawn(raw: bytes) -> list[bytes]:
    """Up to FIT_WINDOWS windows of a text, with their margins, by hash of place and content."""
    w = windows([raw])
    out = [w.flat[a:b].tobytes() for a, b in zip(w.lo, w.hi)]
    return [out[k] for k in sorted(sorted(range(len(out)), key=lambda k: (zlib.crc32(out[k], k), k))[:FIT_WINDOWS])]


def train(texts: list[str], langs: list[str], steps: int | None = None) -> Network:
    return train_windows([drawn(t.encode()) for t in texts], langs, steps)


def train_windows(docs: list[list[bytes]], langs: list[str], steps: int | None = None) -> Network:
    """docs: the drawn windows of each document."""
    names = sorted(set(langs))
    k, hid = len(names), HIDDEN
    steps = steps or STEPS + STEPS_PER_LANG * k
    rng = np.random.default_rng(11)
    net = Network(
        names,
        (rng.standard_normal((2, 3, 256, hid)) * 0.3).astype(np.float32),
        (rng.standard_normal((2, 3, hid, hid)) / np.sqrt(hid)).astype(np.float32),
        np.zeros((2 * hid, k), np.float32),
        np.zeros(k, np.float32),
    )
    raw = [x for ws in docs for x in ws]
    if not raw:
        return net
    size = np.array([len(x) for x in raw])
    live = np.arange(size.max())[:, None] < size[None, :]
    data = np.zeros(live.shape, np.uint8)
    data.T[live.T] = np.frombuffer(b"".join(raw), np.uint8)
    seen = np.zeros(256, bool)
    seen[np.unique(data[live])] = True
    net.inputs[:, :, ~seen] = 0
    place = {x: i for i, x in enumerate(names)}
    label = np.repeat([place[x] for x in langs], [len(ws) for ws in docs])
    by_lang = [np.flatnonzero(label == i) for i in range(k)]
    by_lang = [r for r in by_lang if len(r)]
    params = [net.inputs, net.loops, net.head, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(steps):
        rows = np.concatenate([rng.choice(r, -(-BATCH // len(by_lang))) for r in by_lang])
        grads = gradients(net, data[:, rows], live[:, rows], label[rows])
        rate = 0.02 * min(1.0, 2 * (1 - step / steps))
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
    net.inputs[:, :, ~seen] = 0
    return net


def gradients(net: Network, data: np.ndarray, live: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time of the mean cross-entropy over real positions."""
    steps, rows = data.shape
    hid = net.loops.shape[-1]
    kept: list[list] = [[], []]
    f, b = (net.states(data, live, way, kept[way]) for way in (0, 1))
    both = np.concatenate([f, b], axis=2)
    p = both @ net.head + net.bias
    p = np.exp(p - p.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    p[:, np.arange(rows), label] -= 1
    p *= (live / max(live.sum(), 1))[:, :, None]
    p = p.astype(net.loops.dtype)
    g_head = both.reshape(-1, 2 * hid).T @ p.reshape(-1, p.shape[2])
    g_both = p @ net.head.T
    g_in, g_loop = np.zeros_like(net.inputs), np.zeros_like(net.loops)
    for way in (0, 1):
        uz, ur, un = net.loops[way]
        back = np.zeros((rows, hid), net.loops.dtype)
        for t, byte, h, z, r, n, c in reversed(kept[way]):
            on = live[t][:, None]
            d = back + g_both[t, :, way * hid : (way + 1) * hid]
            skipped = np.where(on, 0, d)
            d = np.where(on, d, 0)
            dz = d * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dn = d * (1 - z) * (1 - np.abs(n)) ** 2
            dr = dn * c * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            dc = dn * r
            for g, x in enumerate((dz, dr, dn)):
                np.add.at(g_in[way, g], byte, x)
            for g, x in enumerate((dz, dr, dc)):
                g_loop[way, g] += h.T @ x
            back = d * z + dz @ uz.T + dr @ ur.T + dc @ un.T + skipped
    return [g_in, g_loop, g_head, p.sum(axis=(0, 1))]


def fit(docs: DataFrame, where: Column, per_lang: int = PER_LANG) -> Network | None:
    """Fit on drawn windows of up to per_lang documents of every language; only those windows reach the driver."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & where).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    per_lang = max(LEAST, min(per_lang, TOTAL // len(counts)))
    spark = docs.sparkSession
    # A hash threshold for each language leaves a few times per_lang of its rows, so that ranking them stays small.
    rates = spark.createDataFrame([(lang, int((1 << 40) * min(1.0, 4 * per_lang / n))) for lang, n in counts.items()], "_lang string, _rate long")
    thin = rows.select("doc_id", "lang").join(F.broadcast(rates), F.col("lang") == F.col("_lang")).filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) < F.col("_rate"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = thin.select("doc_id", "lang").withColumn("at", F.dense_rank().over(order)).filter(F.col("at") <= per_lang).select("doc_id", "lang").distinct().collect()
    kind = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("lang", StringType())])
    hits = rows.join(F.broadcast(spark.createDataFrame([tuple(r) for r in ids], kind)), ["doc_id", "lang"])
    texts = hits.groupBy("doc_id", "lang").agg(F.min("text").cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([drawn(x.as_py()) for x in part.column(2)], pa.list_(pa.binary()))], names=["doc_id", "lang", "raw"])

    name = docs.schema["doc_id"].dataType.simpleString()
    got = texts.select("doc_id", "lang", "raw").mapInArrow(run, f"doc_id {name}, lang string, raw array<binary>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return train_windows([[bytes(x) for x in r["raw"]] for r in got], [r["lang"] for r in got]) if got else None


def predict(df: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score, and the probability of each learned language."""
    k = len(net.langs) if net else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [x.as_buffer() if y else b"" for x, y in zip(part.column(1), part.column(2).to_pylist())]
                total = np.zeros((len(raw), max(k, 1)))
                if net:
                    w = windows(raw)
                    for s in range(0, len(w.doc), ROWS):
                        some = slice(s, s + ROWS)
                        np.add.at(total, w.doc[some], net.pooled(*w.table(some)))
                n = total.sum(axis=1)
                p = total / np.maximum(n, 1e-9)[:, None]
                best = p.argmax(axis=1)
                names = [net.langs[b] if net and m else "und" for b, m in zip(best, n)]
                score = np.where(n > 0, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc_id", "lang_pred", "score", "probabilities"])

    kind = df.schema["doc_id"].dataType.simpleString()
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return df.select("doc_id", F.col("text").cast("binary"), letters).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, probabilities array<double>")
