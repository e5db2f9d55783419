"""Language ID by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` positions. Two gated recurrent units read
each window, one from each end; a softmax over both states labels every position, and a document's
probabilities are the mean of its positions' probabilities. The network is trained on the driver by
backpropagation through time with Adam, on a sample of at most ``per_lang`` labelled documents of
each language and ``SAMPLE_CHARS`` characters of each, cut at a place that depends on the
identifier (a bounded sample; prediction reads every byte of every text).

Null texts and texts without a letter are ``und`` with score 0. If nothing is labelled, every text
is ``und``. Ties go to the language that sorts first. Repeated rows get a row each. Rows with a
null identifier are predicted like others and are not held out. Very long texts are read whole, in
windows. An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, HIDDEN, SAMPLE_CHARS = 64, 8, 1600
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Unit:
    """One direction: rows of the tables are bytes; gates z and r, then the candidate n."""

    gates: np.ndarray  # 256 x 2H
    cand: np.ndarray  # 256 x H
    u_gates: np.ndarray  # H x 2H
    u_cand: np.ndarray  # H x H
    b_cand: np.ndarray  # H

    def arrays(self) -> list[np.ndarray]:
        return [self.gates, self.cand, self.u_gates, self.u_cand, self.b_cand]


@dataclass
class Model:
    langs: list[str]
    units: list[Unit]  # forward, backward
    heads: list[np.ndarray]  # H x K for each direction
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [a for u in self.units for a in u.arrays()] + self.heads + [self.bias]


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)

    def m(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    def unit() -> Unit:
        return Unit(m(256, 2 * hidden, scale=0.3), m(256, hidden, scale=0.5), m(hidden, 2 * hidden, scale=hidden**-0.5), m(hidden, hidden, scale=hidden**-0.5), np.zeros(hidden, np.float32))

    return Model(list(langs), [unit(), unit()], [m(hidden, len(langs), scale=0.3) for _ in range(2)], np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _states(u: Unit, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each step of ``x`` (steps x rows), steps x rows x H; ``keep`` gets what training needs."""
    steps, rows = x.shape
    size = u.u_cand.shape[0]
    out = np.empty((steps, rows, size), np.float32)
    h = np.zeros((rows, size), np.float32)
    for t in range(steps):
        a = h @ u.u_gates
        a += u.gates[x[t]]
        _sigmoid(a)
        z, r = a[:, :size], a[:, size:]
        m = h @ u.u_cand
        m += u.b_cand
        n = r * m
        n += u.cand[x[t]]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((h, a, m, n))
        new = out[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        h = new
    return out


def _probs(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def _back(u: Unit, x: np.ndarray, keep: list, dout: np.ndarray) -> list[np.ndarray]:
    """Backpropagation through time; the gradients in the order of Unit.arrays()."""
    steps, rows, size = dout.shape
    d_ug, d_uc, d_bc = np.zeros_like(u.u_gates), np.zeros_like(u.u_cand), np.zeros_like(u.b_cand)
    da_all, dn_all = np.empty((steps, rows, 2 * size), np.float32), np.empty((steps, rows, size), np.float32)
    carry = np.zeros((rows, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, a, m, n = keep[t]
        z, r = a[:, :size], a[:, size:]
        dh = dout[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        dm = dn * r
        da = da_all[t]
        da[:, :size] = dh * (h - n) * z * (1 - z)
        da[:, size:] = dn * m * r * (1 - r)
        dn_all[t] = dn
        carry = dh * z + dm @ u.u_cand.T + da @ u.u_gates.T
        d_ug += h.T @ da
        d_uc += h.T @ dm
        d_bc += dm.sum(0)
    flat = x.reshape(-1)

    def table(d: np.ndarray) -> np.ndarray:
        d = d.reshape(len(flat), -1)
        return np.stack([np.bincount(flat, d[:, k], 256) for k in range(d.shape[1])], 1).astype(np.float32)

    return [table(da_all), table(dn_all), d_ug, d_uc, d_bc]


def loss_and_gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """``x``: rows x steps of bytes (0: padding, which is read but not labelled); ``y``: a class for each row."""
    f = np.ascontiguousarray(x.T)
    b = f[::-1]
    kf: list = []
    kb: list = []
    hf, hb = _states(model.units[0], f, kf), _states(model.units[1], b, kb)[::-1]
    p = _probs(hf @ model.heads[0] + hb @ model.heads[1] + model.bias)
    mask = (f > 0).astype(np.float32)
    total = max(float(mask.sum()), 1.0)
    own = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*f.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(own + 1e-9) * mask).sum() / total)
    d = p
    d[:, np.arange(len(y)), y] -= 1
    d *= mask[..., None] / total
    flat = d.reshape(-1, d.shape[-1])
    heads = [h.reshape(-1, h.shape[-1]).T @ flat for h in (hf, np.ascontiguousarray(hb))]
    gf = _back(model.units[0], f, kf, d @ model.heads[0].T)
    gb = _back(model.units[1], b, kb, (d @ model.heads[1].T)[::-1])
    return loss, [*gf, *gb, *heads, flat.sum(0)]


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    n = -(-len(data) // window) * window
    return np.frombuffer(data.ljust(n, b"\0"), np.uint8).reshape(-1, window)


def train(samples: list[tuple[str, str]], hidden: int = HIDDEN, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 0, least_steps: int = 150) -> Model:
    """Fit to (text, lang) pairs; the same pairs in any order give the same network."""
    samples = sorted(samples)
    langs = sorted({y for _, y in samples})
    model = new_model(langs, hidden, seed)
    if len(langs) < 2:
        return model
    xs = [windows_of(t.encode("utf-8", "ignore")) for t, _ in samples]
    x = np.concatenate(xs)
    y = np.repeat([langs.index(v) for _, v in samples], [len(w) for w in xs])
    rng = np.random.default_rng(seed)
    ps = model.arrays()
    m1, m2 = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
    epochs = max(epochs, -(-least_steps * batch // len(x)) if len(x) >= batch else least_steps)
    steps, step = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            own = order[k : k + batch]
            _, grads = loss_and_gradients(model, x[own], y[own])
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for p, g, a, b in zip(ps, grads, m1, m2, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def _window_sums(model: Model, x: np.ndarray) -> np.ndarray:
    """Sums over each window's positions of their probabilities, rows x K."""
    f = np.ascontiguousarray(x.T)
    logits = _states(model.units[0], f) @ model.heads[0]
    logits += (_states(model.units[1], f[::-1]) @ model.heads[1])[::-1]
    logits += model.bias
    # Logits are small (bounded states and weights), so exp needs no shift.
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    if not x.all():
        logits *= (f > 0)[..., None]
    return logits.sum(0)


def predict(model: Model, texts: list[str | None], block: int = 2048) -> tuple[list[str], list[float]]:
    """Language and its pooled probability of every whole text."""
    data = [t.encode("utf-8", "ignore").replace(b"\0", b" ") if t and _LETTER.search(t) else b"" for t in texts]
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(model.langs)))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    n = 0

    def run() -> None:
        nonlocal n
        if held:
            x, who = np.concatenate(held), np.concatenate(owner)
            for k in range(0, len(x), block):
                got = _window_sums(model, x[k : k + block])
                for c in range(got.shape[1]):
                    sums[:, c] += np.bincount(who[k : k + block], got[:, c], len(texts))
            held.clear()
            owner.clear()
            n = 0

    for i, d in enumerate(data):
        if d:
            w = windows_of(d)
            held.append(w)
            owner.append(np.full(len(w), i))
            n += len(w)
            if n >= block:
                run()
    run()
    best = sums.argmax(1)
    return ["und" if not d else model.langs[k] for d, k in zip(data, best.tolist(), strict=True)], [float(min(1.0, s[k] / len(d))) if d else 0.0 for d, s, k in zip(data, sums, best.tolist(), strict=True)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(train_docs: DataFrame, per_lang: int = 240, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> Model:
    """Train on at most ``per_lang`` rows of each language, those whose identifiers hash lowest."""
    narrow = train_docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    rows = narrow.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit("sample"), F.col(id_col)).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return new_model([])
    # Hashes are even, so a share of them a little above the wanted one is enough; ranks are taken within it only.
    shares = [(k, min(1.0, (1.5 * per_lang + 100) / n)) for k, n in counts.items()]
    share = train_docs.sparkSession.createDataFrame(shares, "lang string, share double")
    unit = (F.shiftrightunsigned("h", 11)).cast("double") / F.lit(float(1 << 53))
    near = rows.join(F.broadcast(share), "lang").where(unit < F.col("share"))
    cut = F.substring("text", F.lit(1) + F.pmod(F.col("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int"), F.lit(SAMPLE_CHARS))
    picked = near.select("lang", "h", cut.alias("part")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("rank") <= per_lang)
    return train([(r["part"], r["lang"]) for r in picked.select("part", "lang").collect()], **kw)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``: its identifier (as doc_id), lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                langs, scores = predict(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) with a language of at least ``min_score``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                langs, scores = predict(model, part.column(text_col).to_pylist())
                yield part.filter(pa.array([y != "und" and s >= min_score for y, s in zip(langs, scores, strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), **kw)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
