"""Language identification with a byte convolutional network, trained here in numpy.

Text is read as UTF-8 bytes in windows of WINDOW. Bytes are embedded, filters of widths 2 to 5 slide
over them, each filter's maximum over the window goes through ReLU and a dense softmax layer. A
document's probabilities are those of its windows, weighted by their bytes; every byte of it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import written

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4, 5), 12, 8
#: Bounds of the training sample: documents of each label, characters of each of them, documents in all (but one of each label at least).
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL = 500, 4096, 32_000
_WIDE = max(WIDTHS)


@dataclass
class Model:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 pads and is zero
    filters: np.ndarray  # (_WIDE * EMBED) x (len(WIDTHS) * FILTERS); narrow filters are zero beyond their width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows]
        n, length, _ = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - _WIDE + 1, _WIDE * EMBED), (s[0], s[1], s[2])).reshape(-1, _WIDE * EMBED)

    def pooled(self, windows: np.ndarray, where: bool = False):
        cols = self._columns(windows)
        out = (cols @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        top = out.argmax(1) if where else None
        high = np.take_along_axis(out, top[:, None], 1)[:, 0] if where else out.max(1)
        return high + self.bias, top, cols

    def probabilities(self, windows: np.ndarray, chunk: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for at in range(0, len(windows), chunk):
            h, _, _ = self.pooled(windows[at : at + chunk])
            z = np.maximum(h, 0) @ self.dense + self.dense_bias
            e = np.exp(z - z.max(1, keepdims=True))
            out[at : at + chunk] = e / e.sum(1, keepdims=True)
        return out


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of WINDOW bytes data[start:end], zero beyond the end."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros((len(starts), WINDOW), np.uint8)


def train(texts: list[str], langs: list[str], seed: int = 11, epochs: int = 12, rate: float = 4e-3) -> Model | None:
    """Fit on texts with their labels (Adam, cross-entropy); None without any. Windows are cut to random lengths too, so short texts work."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    if not labels:
        return None
    rows, ys = [], []
    for text, lang in zip(texts, langs):
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data):
            continue
        for _ in range(4):
            size = WINDOW if rng.random() < 0.6 else int(rng.integers(12, WINDOW))
            start = int(rng.integers(0, max(1, len(data) - size + 1)))
            piece = data[start : start + size]
            rows.append(np.pad(piece, (0, WINDOW - len(piece))))
            ys.append(labels.index(lang))
    n_filters = len(WIDTHS) * FILTERS
    mask = np.zeros((_WIDE * EMBED, n_filters), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
    normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    m = Model(labels, normal(256, EMBED) * 0.5, normal(_WIDE * EMBED, n_filters) * 0.15 * mask, np.zeros(n_filters, np.float32), normal(n_filters, len(labels)) * 0.1, np.zeros(len(labels), np.float32))
    m.embed[0] = 0
    if not rows:
        return m
    x, y = np.array(rows, np.uint8), np.array(ys)
    count = np.bincount(y, minlength=len(labels))
    weigh = (len(y) / np.maximum(count, 1) / len(labels)).astype(np.float32)
    names = ("embed", "filters", "bias", "dense", "dense_bias")
    first, second = ({k: np.zeros_like(getattr(m, k)) for k in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            xb, yb = x[at], y[at]
            h, top, cols = m.pooled(xb, where=True)
            act = np.maximum(h, 0)
            z = act @ m.dense + m.dense_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p
            d[np.arange(len(yb)), yb] -= 1
            d *= weigh[yb][:, None] / len(yb)
            back = (d @ m.dense.T) * (h > 0)
            per = cols.reshape(len(xb), -1, cols.shape[1])
            picked = per[np.arange(len(xb))[:, None], top]  # windows x filters x columns: only the maxima carry gradient
            g = {"dense": act.T @ d, "dense_bias": d.sum(0), "bias": back.sum(0), "filters": np.einsum("nfc,nf->cf", picked, back) * mask}
            g_cols = back[:, :, None] * m.filters.T[None]
            embed = np.zeros_like(m.embed)
            for k in range(_WIDE):
                np.add.at(embed, xb[np.arange(len(xb))[:, None], top + k], g_cols[:, :, k * EMBED : (k + 1) * EMBED])
            embed[0] = 0
            g["embed"] = embed
            step += 1
            for k in names:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                getattr(m, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def training_rows(docs: DataFrame) -> DataFrame:
    """text, lang of the bounded sample: of every label the same number of documents, those of least hash, each cut to SAMPLE_CHARS.

    A label's number of different doc_ids (estimated) sets a threshold on their hash that some four times as many as wanted pass, 60 more,
    and the least hash always; so however common a label is, few of its rows are moved and ranked, and no label is left
    out. Rows that share doc_id and label are one for the sample, that of least text.
    """
    known = docs.where("text is not null and lang is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)
    known = known.withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)))
    counts = known.groupBy(F.col("lang").cast("string").alias("_lang")).agg(F.approx_count_distinct("doc_id", 0.02).alias("_n"), F.min("_h").alias("_least"))
    counts = written(counts, "labels").leave()
    labels = counts.count()
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // max(1, labels)))
    counts = F.broadcast(counts) if labels <= SAMPLE_ALL else counts.hint("merge")
    from_, size = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)), F.lit(SAMPLE_CHARS)
    cut = F.substring(F.col("text"), (from_ + 1).cast("int"), size)
    rows = known.select(F.col("lang").cast("string").alias("lang"), "doc_id", cut.alias("text"), "_h").join(counts, F.col("lang") == F.col("_lang"))
    rows = rows.where((F.col("_h") * F.col("_n") <= F.lit(float((4 * each + 60) << 30))) | (F.col("_h") == F.col("_least")))
    rows = rows.groupBy("lang", "_h", "doc_id").agg(F.min("text").alias("text"))
    order = W.partitionBy("lang").orderBy("_h", "doc_id")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each).orderBy("lang", "_k").select("text", "lang")


def fit(docs: DataFrame) -> Model | None:
    rows = training_rows(docs).collect()  # at most SAMPLE_ALL short texts, or one of each label
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def score_batch(model: Model | None, text: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """Label and probability of every text; windows are taken from the column's own bytes."""
    text = text.cast(pa.large_binary())
    n = len(text)
    if model is None or not n:
        return ["und"] * n, np.zeros(n)
    _, offsets, body = text.buffers()
    offs = np.frombuffer(offsets, np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    size = np.diff(offs)
    size[np.asarray(text.is_null())] = 0
    count = -(-size // WINDOW)
    total = np.zeros((n, len(model.labels)))
    ends, start_doc = np.cumsum(count), 0
    while start_doc < n:  # whole documents, about 4096 windows at a time (one document's windows in parts)
        stop_doc = max(start_doc + 1, int(np.searchsorted(ends, (ends[start_doc - 1] if start_doc else 0) + 4096, "right")))
        k = count[start_doc:stop_doc]
        doc = np.repeat(np.arange(start_doc, stop_doc), k)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
        for at in range(0, len(doc), 4096):
            d, i = doc[at : at + 4096], nth[at : at + 4096]
            starts, stops = offs[d] + i * WINDOW, offs[d] + size[d]
            p = model.probabilities(windows_of(data, starts, stops))
            weight = np.minimum(stops - starts, WINDOW)
            np.add.at(total, d, p * weight[:, None])
        start_doc = stop_doc
    score = total / np.maximum(size, 1)[:, None]
    best = score.argmax(1)
    return [model.labels[i] for i in best], np.clip(score[np.arange(n), best], 0, 1)


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text).

    Texts that are null or without a letter get ``und`` and score 0, as does every text if there was
    nothing to learn from. held_out is false for a null id. Repeated rows stay; an empty table gives
    no rows. Neither lang, source nor doc_id reaches the model.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(model)  # some 20 KB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = score_batch(known.value, b.column(2))
            letters = b.column(1).to_pylist()
            label = [x if ok else "und" for x, ok in zip(label, letters)]
            score = np.where(np.array([x != "und" for x in label], bool), score, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    rows = _marked(docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held_out"))).select("doc_id", "_letters", "text", "held_out")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that have a language: letters, and a best score of at least least."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = score_batch(known.value, b.column(at))
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(label, score)], pa.bool_()))

    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, schema)
