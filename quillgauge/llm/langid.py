"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a window of bytes in both directions (GRU cells with soft-sign activations), gives
every position a distribution over the languages, and a document's distribution is the mean over all
its positions. Windows cut the whole text without overlap or gap. Training is backpropagation
through time in numpy, on the driver, on windows of a bounded sample (see ``fit``): the only bound in
the operator, which the input's size does not change. Prediction is a pass over
Arrow batches with the weights in hand; nothing is shuffled.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without any labelled
text everything is ``und``; with one language every text with a letter is of that language; windows
are filled up with zero bytes that do not count, and very long texts are just more windows; rows that
repeat get equal predictions; null or repeated ids play no part but in the draw of the sample, which also
hashes the text; equal scores go to the label that sorts first; ``predict`` replaces columns named like
its own, in any case, ``keep_known`` keeps all columns; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.llm.batches import append
from quillgauge.llm.nets import F32, Adam, gate, gate_slope, scatter, soft_sign, soft_sign_slope

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_LANES = 2048


@dataclass
class Model:
    labels: list[str]
    params: dict[str, np.ndarray]
    window: int = 128


def new_params(labels: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    params = {"out": rng.normal(0, 0.3, (labels, 2 * hidden)), "bias": np.zeros((labels, 1))}
    for way in "fb":
        params[f"table_{way}"] = rng.normal(0, 0.5, (3 * hidden, 256))
        params[f"back_{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
    return {k: v.astype(F32) for k, v in params.items()}


def run_gru(table: np.ndarray, back: np.ndarray, symbols: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (T, hidden, B) of a GRU over symbols (T, B); ``trace`` receives what training needs."""
    hidden = back.shape[1]
    steps, lanes = symbols.shape
    states = np.empty((steps, hidden, lanes), F32)
    h = np.zeros((hidden, lanes), F32)
    x = np.empty((3 * hidden, lanes), F32)
    for t in range(steps):
        np.take(table, symbols[t], axis=1, out=x, mode="clip")
        g = back @ h
        rz = x[: 2 * hidden]
        rz += g[: 2 * hidden]
        gate(rz)
        inner = g[2 * hidden :]
        if trace is not None:
            trace.append([h, rz.copy(), inner.copy()])
        inner *= rz[:hidden]
        inner += x[2 * hidden :]
        n = soft_sign(inner)
        if trace is not None:
            trace[-1].append(n.copy())
        # h' = n + z (h - n)
        new = h - n
        new *= rz[hidden:]
        new += n
        states[t] = h = new
    return states


def gru_grads(back: np.ndarray, trace: list, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients by input (T, 3 hidden, B) and by ``back``."""
    hidden = back.shape[1]
    into = np.empty((len(trace), 3 * hidden, slopes.shape[2]), F32)
    grad, dh = np.zeros_like(back), np.zeros_like(slopes[0])
    for t in range(len(trace) - 1, -1, -1):
        h, rz, inner, n = trace[t]
        r, z = rz[:hidden], rz[hidden:]
        dh = dh + slopes[t]
        dn = dh * (1 - z) * soft_sign_slope(n)
        dz = dh * (h - n) * gate_slope(z)
        dr = dn * inner * gate_slope(r)
        into[t] = np.concatenate([dr, dz, dn])
        dg = np.concatenate([dr, dz, dn * r])
        grad += dg @ h.T
        dh = dh * z + back.T @ dg
    return into, grad


def probabilities(params: dict[str, np.ndarray], symbols: np.ndarray, traces: tuple[list, list] | None = None):
    """Label probabilities (T, labels, B) of every position, and the states behind them."""
    there = run_gru(params["table_f"], params["back_f"], symbols, traces and traces[0])
    back = run_gru(params["table_b"], params["back_b"], symbols[::-1], traces and traces[1])[::-1]
    hidden = there.shape[1]
    p = params["out"][:, :hidden] @ there + params["out"][:, hidden:] @ back
    p += params["bias"]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p, there, back


def train(texts: list[bytes], targets: np.ndarray, labels: list[str], hidden: int, window: int, steps: int, seed: int) -> Model:
    """Fit the network on random windows of the texts."""
    rng = np.random.default_rng(seed)
    params = new_params(len(labels), hidden, rng)
    if len(labels) < 2:
        return Model(labels, params, window)
    learn, lanes, span = Adam(params, 0.02), 64, 64
    by_label = [np.flatnonzero(targets == i) for i in range(len(labels))]
    for _ in range(steps):
        wanted = rng.integers(0, len(labels), lanes)
        symbols, valid = np.zeros((span, lanes), np.intp), np.zeros((span, lanes), bool)
        for lane, label in enumerate(wanted):
            text = texts[rng.choice(by_label[label])]
            at = int(rng.integers(0, max(1, len(text) - span // 2)))
            piece = np.frombuffer(text[at : at + span], np.uint8)
            symbols[: len(piece), lane], valid[: len(piece), lane] = piece, True
        traces: tuple[list, list] = ([], [])
        p, there, back = probabilities(params, symbols, traces)
        slope = p.copy()
        slope[:, wanted, np.arange(lanes)] -= 1
        slope *= (valid / max(1, valid.sum()))[:, None, :].astype(F32)
        grads = {"bias": slope.sum(axis=(0, 2))[:, None]}
        both = np.concatenate([there, back], axis=1)
        grads["out"] = np.einsum("tcb,thb->ch", slope, both)
        pulled = params["out"].T @ slope
        for way, trace, read, part in (("f", traces[0], symbols, pulled[:, :hidden]), ("b", traces[1], symbols[::-1], pulled[::-1, hidden:])):
            into, grads[f"back_{way}"] = gru_grads(params[f"back_{way}"], trace, part)
            flat = into.transpose(1, 0, 2).reshape(3 * hidden, -1)
            grads[f"table_{way}"] = scatter(read.reshape(-1), flat, 256)
        learn.step(grads)
    return Model(labels, params, window)


def _lanes(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of all texts, a bounded number at a time: owner of each, and their bytes."""
    owners: list[int] = []
    pieces: list[bytes] = []
    for owner, text in enumerate(texts):
        for at in range(0, len(text), window):
            owners.append(owner)
            pieces.append(text[at : at + window])
            if len(pieces) == _LANES:
                yield np.array(owners), pieces
                owners, pieces = [], []
    if pieces:
        yield np.array(owners), pieces


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """The mean label distribution over all positions of each text (0 for empty texts)."""
    total = np.zeros((len(texts), len(model.labels)))
    for owners, pieces in _lanes(texts, model.window):
        flat = np.frombuffer(b"".join(x.ljust(model.window, b"\0") for x in pieces), np.uint8)
        lengths = np.array([len(x) for x in pieces])
        symbols = np.ascontiguousarray(flat.reshape(len(pieces), model.window).T).astype(np.intp)
        p, _, _ = probabilities(model.params, symbols)
        whole = p.sum(axis=0)
        for lane in np.flatnonzero(lengths < model.window):
            whole[:, lane] = p[: lengths[lane], :, lane].sum(axis=0)
        np.add.at(total, owners, whole.T)
    return total / np.maximum(1, [len(t) for t in texts])[:, None]


def fit(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", hidden: int = 6, window: int = 128,
    per_language: int = 400, sample_bytes: int = 4096, steps: int = 150, seed: int = 7, languages: int = 256, sample: int = 25_600,
) -> Model:
    """Fit on up to ``per_language`` documents of each language, the first in a hash order of id and text.

    Bounds of what reaches the driver: the ``languages`` with the most documents, and ``sample`` pieces of
    ``sample_bytes`` characters in all, which up to 64 languages do not reach. Every language is read by
    its share of the rows; rows equal in id and text fall on one place, and no more of them are passed on
    than a language may have, so neither null ids nor copies leave a language without a sample or make it large.
    """
    rows = df.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.col("t") != ""))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    counts = rows.groupBy("l").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy(F.desc("n"), "l").limit(languages).collect()
    if not counts:
        return Model([], {}, window)
    per_language = min(per_language, max(1, sample // len(counts)))
    reach = {r["l"]: max(r["first"], min(1.0, 2 * per_language / r["n"])) for r in counts}
    share = F.try_element_at(F.create_map(*[F.lit(x) for pair in reach.items() for x in pair]), F.col("l"))
    # A piece from within the text, at a place that follows from the hash.
    longest = F.greatest(F.length("t") - sample_bytes, F.lit(0))
    piece = F.substring(F.col("t"), (longest * F.col("place")).cast("int") + 1, F.lit(sample_bytes))
    drawn = rows.filter(F.col("place") <= share).select("l", "place", "id", piece.cast("binary").alias("t"))
    first = Window.partitionBy("l").orderBy("place", "id", "t")
    found = drawn.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_language).collect()
    found = sorted(found, key=lambda r: (r["l"], r["rank"]))
    labels = sorted({r["l"] for r in found})
    code = {name: i for i, name in enumerate(labels)}
    return train([bytes(r["t"]) for r in found], np.array([code[r["l"]] for r in found]), labels, hidden, window, steps, seed)


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def predict(df: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the probability of that language, to every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = shared.value
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        known = [i for i, t in enumerate(texts) if own.labels and t and has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            p = pooled(own, [texts[i].encode() for i in known]).round(6)
            for i, best, row in zip(known, p.argmax(axis=1), p, strict=True):
                names[i], scores[i] = own.labels[best], min(1.0, float(row[best]))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return append(df, "lang_pred string, score double", make, drop)


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learnt from: those whose CRC-32 of the id is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def keep_known(df: DataFrame, model: Model, text: str = "text", least: float | None = None) -> DataFrame:
    """The rows with a known language of at least the given probability, with the columns of ``df``.

    By default that is 0.3, or 1.2 times an even share where there are more than four languages.
    """
    if least is None:
        least = min(0.3, 1.2 / max(1, len(model.labels)))
    names = [f"__own_{i}" for i in range(len(df.columns))]
    told = predict(df.toDF(*names), model, names[df.columns.index(text)])
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*names).toDF(*df.columns)
