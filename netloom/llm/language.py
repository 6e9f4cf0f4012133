"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of 256 bytes, all of them; filters of 2, 3 and 4 bytes run over each
window, their largest responses go into a softmax, and the windows' probabilities are averaged,
weighted by their bytes. A filter over bytes is a sum of table look-ups, one per pair of bytes, so
applying the network needs no multiplication per position.

The network is fitted on a bounded sample: at most ``per_language`` documents of each label, each
with ``pieces`` windows (the bound is that parameter; labels are few). Everything else reads
all rows.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every
text if there is nothing to learn from. Ties go to the label first in sort order. Each input row
gives one output row. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
_WORDLY = re.compile(r"[^\W\d_]")  # letters, and numbers such as ½ or Ⅷ that are none
_CHUNK = 64  # windows worked on at once: their responses stay in the processor's cache


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, zero-padded; the first window of each text; bytes in each window."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    flat = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist()))
    sizes = np.full(counts.sum(), WINDOW)
    sizes[np.concatenate((first[1:], [len(sizes)])) - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, counts.tolist())]
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), first, sizes


def has_letter(text: str | None) -> bool:
    """A letter by its Unicode category (L), as in the filter of ``train``."""
    return bool(text) and any(m[0].isalpha() for m in _WORDLY.finditer(text))


class ByteConvNet:
    """Embedding of bytes, filters of several widths, max pooling, softmax."""

    def __init__(self, classes: list[str], filters: int = 16, dims: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.filters, self.dims = classes, filters, dims
        self.w = {"embed": rng.normal(0, 0.5, (256, dims)),
                  "out": rng.normal(0, 0.1, (filters * len(WIDTHS), len(classes))), "bias": np.zeros(len(classes))}
        for k in WIDTHS:
            self.w[f"f{k}"] = rng.normal(0, (k * dims) ** -0.5, (k * dims, filters))
            self.w[f"b{k}"] = np.zeros(filters)
        self.w = {name: v.astype(np.float32) for name, v in self.w.items()}
        self.tables = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 5e-3, seed: int = 7):
        """Adam on the cross entropy; only the winning position of a filter gets a gradient."""
        rng, step = np.random.default_rng(seed), 0
        m = {n: np.zeros_like(v) for n, v in self.w.items()}
        s = {n: np.zeros_like(v) for n, v in self.w.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                pick = order[at:at + batch]
                step += 1
                for n, g in self._gradients(x[pick], y[pick]).items():
                    m[n] = 0.9 * m[n] + 0.1 * g
                    s[n] = 0.99 * s[n] + 0.01 * g * g
                    self.w[n] -= rate * (m[n] / (1 - 0.9 ** step)) / (np.sqrt(s[n] / (1 - 0.99 ** step)) + 1e-7)
        self.tables = None
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(x)
        e = w["embed"][x]
        pooled, seen = [], []
        for k in WIDTHS:
            patches = np.concatenate([e[:, j:WINDOW - k + 1 + j] for j in range(k)], axis=2)
            out = patches @ w[f"f{k}"]
            best = out.argmax(1)
            pooled.append(np.take_along_axis(out, best[:, None], 1)[:, 0] + w[f"b{k}"])
            seen.append((patches, best))
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        p = _softmax(hidden @ w["out"] + w["bias"])
        p[np.arange(n), y] -= 1
        p /= n
        g = {"out": hidden.T @ p, "bias": p.sum(0), "embed": np.zeros_like(w["embed"])}
        back = (p @ w["out"].T) * (raw > 0)
        rows = np.arange(n)[:, None]
        for i, k in enumerate(WIDTHS):
            d, (patches, best) = back[:, i * self.filters:(i + 1) * self.filters], seen[i]
            won = patches[rows, best]  # text, filter, k * dims
            g[f"f{k}"] = np.einsum("nfi,nf->if", won, d)
            g[f"b{k}"] = d.sum(0)
            into = (d[:, :, None] * w[f"f{k}"].T[None]).reshape(-1, self.dims)
            at = x[rows[:, :, None], best[:, :, None] + np.arange(k)]
            np.add.at(g["embed"], at.reshape(-1), into)
        return g

    def _lookup(self) -> dict[int, list[np.ndarray]]:
        """Per width, what each byte pair (or last single byte) adds to the filters."""
        if self.tables is None:
            self.tables = {}
            for k in WIDTHS:
                taps = [self.w["embed"] @ self.w[f"f{k}"][j * self.dims:(j + 1) * self.dims] for j in range(k)]
                pairs = [(taps[j][:, None] + taps[j + 1][None]).reshape(65536, -1) for j in range(0, k - 1, 2)]
                self.tables[k] = [t.astype(np.float32) for t in pairs + ([taps[-1]] if k % 2 else [])]
        return self.tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        tables, hidden = self._lookup(), np.empty((len(x), self.filters * len(WIDTHS)), np.float32)
        for at in range(0, len(x), _CHUNK):
            part = x[at:at + _CHUNK]
            pairs = part[:, :-1].astype(np.int64) << 8
            pairs |= part[:, 1:]
            for i, k in enumerate(WIDTHS):
                n = WINDOW - k + 1
                out = np.take(tables[k][0], pairs[:, :n], axis=0)
                for j, table in enumerate(tables[k][1:], 1):
                    index = pairs[:, 2 * j:2 * j + n] if len(table) > 256 else part[:, 2 * j:2 * j + n]
                    out += np.take(table, index, axis=0)
                hidden[at:at + _CHUNK, i * self.filters:(i + 1) * self.filters] = out.max(1) + self.w[f"b{k}"]
        return _softmax(np.maximum(hidden, 0) @ self.w["out"] + self.w["bias"])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [has_letter(t) for t in texts]
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        asked = [i for i, ok in enumerate(known) if ok]
        if asked and self.classes:
            x, first, sizes = windows([texts[i].encode() for i in asked])
            p = self.probabilities(x) * sizes[:, None]
            p = np.add.reduceat(p, first, axis=0) / np.add.reduceat(sizes, first)[:, None]
            for i, c, s in zip(asked, p.argmax(1).tolist(), p.max(1).tolist()):
                labels[i], scores[i] = self.classes[c], min(1.0, s)
        return labels, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 250, pieces: int = 3, chars: int = 2048, languages: int = 200) -> ByteConvNet:
    """Fit on at most ``per_language`` labelled documents of each language (see the module's text).

    The ``languages`` most frequent labels are learned, so that a dirty label column cannot fill the driver.
    """
    labels = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    labels = labels.orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    docs = docs.join(F.broadcast(labels), "lang", "left_semi")
    text = F.col("text")
    rows = docs.filter(F.col("lang").isNotNull() & text.rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    order = F.xxhash64(text)
    rows = rows.select(F.col("lang").alias("lang"), order.alias("o"), F.col("doc_id").alias("i"), F.substring(
        text, F.pmod(order, F.greatest(F.char_length(text) - chars, F.lit(1))).cast("int") + 1, F.lit(chars)).alias("piece"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "i"))
    sample = rows.withColumn("n", rank).filter(F.col("n") <= per_language).select("lang", "n", "piece").collect()
    sample.sort(key=lambda r: (r.lang, r.n))
    classes = sorted({r.lang for r in sample})
    rng, xs, ys = np.random.default_rng(11), [], []
    for r in sample:
        raw = r.piece.encode()
        for _ in range(pieces):
            # Lengths vary so that short texts are met in training too.
            n = int(rng.integers(24, WINDOW + 1))
            at = int(rng.integers(0, max(1, len(raw) - n + 1)))
            xs.append(raw[at:at + n].ljust(WINDOW, b"\0"))
            ys.append(classes.index(r.lang))
    net = ByteConvNet(classes)
    return net.fit(np.frombuffer(b"".join(xs), np.uint8).reshape(-1, WINDOW), np.array(ys)) if xs else net


def identify(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id, lang_pred, score of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = net.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double")


def accept(docs: DataFrame, net: ByteConvNet, min_score: float = 0.0) -> DataFrame:
    """The documents with a known language, with all their columns.

    ``min_score`` also drops those below it. The score averages all windows, so texts in several
    languages score low however clear each part is; by default they stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = net.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([l != UNKNOWN and s >= min_score for l, s in zip(labels, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
