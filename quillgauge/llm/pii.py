"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions.

The rules find emails, IP addresses, cards and phones by fixed patterns and checks. Their spans in a
bounded sample of documents, with copies in other spellings (``(at)`` for ``@``, ``00`` for a
phone's ``+``), are the labelled spans that the network learns from, in numpy, by backpropagation
through time. A conditional random field over its emissions decides the labels of a window at once.

All kinds hold a digit or an ``@`` (or its spelling: ``at`` in brackets, in any case), so characters
farther than ``context`` and the rest of a word from any of these are outside by definition; all others, of the whole text, are read in windows of
``window`` characters that overlap by twice ``context``. Every character takes its label from the
window in whose middle it lies deepest, and runs of labels become spans across windows. A span of
the network is taken to the ends of its name, domain or digits in the whole text, and added if it
meets the check of its kind and no rule has found anything there.

Edge cases: null and empty texts have no spans; offsets are code points; rows that repeat get equal
spans; without a labelled span in the sample only the rules speak; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.batches import append
from quillgauge.llm.nets import F32, Adam, gate, gate_slope, log_sum, scatter, soft_sign, soft_sign_slope

Span = tuple[str, int, int]

# Fixed patterns of the kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# A match cannot begin within a run of digits whose first digit fails; saying so keeps the search linear.
_IP = re.compile(r"(?<![0-9])" + PATTERNS["ip"].pattern)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]")
_AT = r"@|\([aA][tT]\)|\[[aA][tT]\]|\{[aA][tT]\}|<[aA][tT]>"
_TRIGGER = re.compile(f"[0-9]|{_AT}")
_MARK = re.compile(_AT)
_HOST = re.compile(r" ?([A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)")
# Spellings of the ``@`` in the copies that the network learns from.
SPELLINGS = (" (at) ", "(at)", " (AT) ", " [at] ", "[at]", " {at} ", "<at>", " @ ")
LABELS = ("out", *KINDS)
SYMBOLS = 129  # ASCII and everything else


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """The check that a match of a rule must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        # Long runs of digits are compared by length: int() of them is slow.
        return all(len(x := part.lstrip("0")) < 4 and int(x or "0") <= 255 for part in found.split("."))
    digits = "".join(_DIGITS.findall(found))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


_FIGURES = frozenset("0123456789")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each ``@``: the same spans without trying every letter."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _NAME:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def rules(text: str) -> list[Span]:
    """The spans of the rules, by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for kind in KINDS[1:]:
        pattern = _IP if kind == "ip" else PATTERNS[kind]
        out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


def told(text: str) -> list[Span]:
    """Labelled spans: those of the rules that lie in no longer one, in order of place."""
    spans: list[Span] = []
    for kind, a, b in sorted(rules(text), key=lambda s: (s[1] - s[2], s[1], s[0])):
        if all(b <= c or a >= d for _, c, d in spans):
            spans.append((kind, a, b))
    return sorted(spans, key=lambda s: s[1])


def respell(text: str, spans: list[Span], at_sign: str = " (at) ") -> tuple[str, list[Span]]:
    """The text with its emails and phones in another spelling, and the spans moved along."""
    out, moved, at, size = [], [], 0, 0
    for kind, a, b in spans:
        part = text[a:b]
        if kind == "email":
            part = part.replace("@", at_sign)
        elif kind == "phone":
            part = "00" + part[1:]
        out += [text[at:a], part]
        size += a - at
        moved.append((kind, size, size + len(part)))
        size, at = size + len(part), b
    return "".join([*out, text[at:]]), moved


@dataclass
class Model:
    params: dict[str, np.ndarray]
    window: int = 96
    context: int = 16


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.minimum(points, SYMBOLS - 1).astype(np.intp)


def new_params(hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    k = len(LABELS)
    params = {"out": rng.normal(0, 0.3, (k, 2 * hidden)), "bias": np.zeros((k, 1)), "moves": np.zeros((k, k)) + 2 * np.eye(k)}
    for way in "fb":
        params[f"table_{way}"] = rng.normal(0, 0.5, (4 * hidden, SYMBOLS))
        params[f"back_{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (4 * hidden, hidden))
    return {name: v.astype(F32) for name, v in params.items()}


def run_lstm(table: np.ndarray, back: np.ndarray, symbols: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (T, hidden, B) of an LSTM over symbols (T, B); gates in the order input, forget, output."""
    n = back.shape[1]
    steps, lanes = symbols.shape
    states = np.empty((steps, n, lanes), F32)
    h, c = np.zeros((n, lanes), F32), np.zeros((n, lanes), F32)
    for t in range(steps):
        x = np.take(table, symbols[t], axis=1, mode="clip")
        x += back @ h
        gates, g = gate(x[: 3 * n]), soft_sign(x[3 * n :])
        new = gates[n : 2 * n] * c + gates[:n] * g
        squashed = soft_sign(new.copy())
        if trace is not None:
            trace.append((h, c, gates, g, squashed))
        c = new
        states[t] = h = gates[2 * n :] * squashed
    return states


def lstm_grads(back: np.ndarray, trace: list, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = back.shape[1]
    into = np.empty((len(trace), 4 * n, slopes.shape[2]), F32)
    grad, dh, dc = np.zeros_like(back), np.zeros_like(slopes[0]), np.zeros_like(slopes[0])
    for t in range(len(trace) - 1, -1, -1):
        h, c, gates, g, squashed = trace[t]
        i, f, o = gates[:n], gates[n : 2 * n], gates[2 * n :]
        dh = dh + slopes[t]
        dc = dc + dh * o * soft_sign_slope(squashed)
        d = into[t]
        d[: 3 * n] = np.concatenate([dc * g, dc * c, dh * squashed]) * gate_slope(gates)
        d[3 * n :] = dc * i * soft_sign_slope(g)
        grad += d @ h.T
        dh, dc = back.T @ d, dc * f
    return into, grad


def emissions(params: dict[str, np.ndarray], symbols: np.ndarray, traces: tuple[list, list] | None = None):
    there = run_lstm(params["table_f"], params["back_f"], symbols, traces and traces[0])
    back = run_lstm(params["table_b"], params["back_b"], symbols[::-1], traces and traces[1])[::-1]
    n = there.shape[1]
    return params["out"][:, :n] @ there + params["out"][:, n:] @ back + params["bias"], there, back


def crf_slopes(e: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean negative log likelihood by emissions (T, K, B) and transitions."""
    steps, k, lanes = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        alpha[t] = e[t] + log_sum(alpha[t - 1][:, None, :] + moves[:, :, None], 0)
    for t in range(steps - 2, -1, -1):
        beta[t] = log_sum(moves[:, :, None] + (e[t + 1] + beta[t + 1])[None, :, :], 1)
    whole = log_sum(alpha[-1], 0)
    slope = np.exp(alpha + beta - whole)
    move_slope = np.zeros_like(moves)
    for t in range(1, steps):
        pair = alpha[t - 1][:, None, :] + moves[:, :, None] + (e[t] + beta[t])[None, :, :] - whole
        move_slope += np.exp(pair).sum(axis=2)
    lane = np.arange(lanes)
    for t in range(steps):
        slope[t, gold[t], lane] -= 1
    np.subtract.at(move_slope, (gold[:-1].reshape(-1), gold[1:].reshape(-1)), 1)
    return slope / (lanes * steps), move_slope / (lanes * steps)


def viterbi(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (T, B) of emissions (T, K, B)."""
    steps, _, lanes = e.shape
    best, came = e[0], np.empty(e.shape, np.int8)
    for t in range(1, steps):
        reach = best[:, None, :] + moves[:, :, None]
        came[t] = reach.argmax(axis=0)
        best = e[t] + reach.max(axis=0)
    out, lane = np.empty((steps, lanes), np.int8), np.arange(lanes)
    out[-1] = best.argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = came[t][out[t], lane]
    return out


def train(texts: list[str], hidden: int = 8, steps: int = 200, window: int = 96, context: int = 16, seed: int = 7) -> Model | None:
    """Fit the network on the labelled spans of the texts; None without any span."""
    rng = np.random.default_rng(seed)
    pieces, with_span = [], []
    for number, text in enumerate(texts):
        spans = told(text)
        for version, own in ((text, spans), respell(text, spans, SPELLINGS[number % len(SPELLINGS)])):
            gold = np.zeros(len(version), np.int8)
            for kind, a, b in own:
                gold[a:b] = LABELS.index(kind)
            coded = symbols_of(version)
            for a, b in regions(version, context):
                mark = len(pieces)
                pieces.append((coded[a:b], gold[a:b]))
                if gold[a:b].any():
                    with_span.append(mark)
    if not with_span:
        return None
    params, lanes = new_params(hidden, rng), 32
    learn = Adam(params, 0.02)
    for _ in range(steps):
        symbols, gold = np.full((window, lanes), 32, np.intp), np.zeros((window, lanes), np.int8)
        for lane in range(lanes):
            coded, own = pieces[rng.choice(with_span) if lane % 3 else rng.integers(len(pieces))]
            at = int(rng.integers(0, max(1, len(coded) - window + 1)))
            n = len(coded[at : at + window])
            symbols[:n, lane], gold[:n, lane] = coded[at : at + window], own[at : at + window]
        traces: tuple[list, list] = ([], [])
        e, there, back = emissions(params, symbols, traces)
        slope, moves = crf_slopes(e, params["moves"], gold)
        slope = slope.astype(F32)
        pulled = params["out"].T @ slope
        grads = {"moves": moves, "bias": slope.sum(axis=(0, 2))[:, None], "out": np.einsum("tcb,thb->ch", slope, np.concatenate([there, back], axis=1))}
        for way, trace, read, part in (("f", traces[0], symbols, pulled[:, :hidden]), ("b", traces[1], symbols[::-1], pulled[::-1, hidden:])):
            into, grads[f"back_{way}"] = lstm_grads(params[f"back_{way}"], trace, part)
            flat = into.transpose(1, 0, 2).reshape(4 * hidden, -1)
            grads[f"table_{way}"] = scatter(read.reshape(-1), flat, SYMBOLS)
        learn.step(grads)
    return Model(params, window, context)


def regions(text: str, context: int) -> list[tuple[int, int]]:
    """The stretches of a text within ``context`` of a digit or an ``@``, to the ends of their words, merged."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - context), min(len(text), m.end() + context)
        if out and b <= out[-1][1]:
            continue
        free = out[-1][1] if out else 0
        while free < a < len(text) and text[a - 1] in _NAME and text[a] in _NAME:
            a -= 1
        while b < len(text) and text[b - 1] in _NAME and text[b] in _NAME:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows(begin: int, end: int, window: int, context: int) -> Iterator[tuple[int, int, int, int]]:
    """Windows (from, to) over a stretch, and the part (first, last) of it that each decides."""
    step, at = window - 2 * context, begin
    while True:
        to = min(end, at + window)
        yield at, to, at if at == begin else at + context, to if to == end else to - context
        if to == end:
            return
        at += step


def decode(model: Model, texts: list[str], lanes: int = 1024) -> list[list[Span]]:
    """The spans of the network in each text, its windows decoded and put together."""
    coded = [symbols_of(t) for t in texts]
    parts = [(i, *w) for i, t in enumerate(texts) for a, b in regions(t, model.context) for w in windows(a, b, model.window, model.context)]
    found: list[list[Span]] = [[] for _ in texts]
    for block in range(0, len(parts), lanes):
        own = parts[block : block + lanes]
        symbols = np.full((model.window, len(own)), 32, np.intp)
        for lane, (i, a, b, _, _) in enumerate(own):
            symbols[: b - a, lane] = coded[i][a:b]
        e, _, _ = emissions(model.params, symbols)
        labels = viterbi(e, model.params["moves"])
        for lane, (i, a, _, first, last) in enumerate(own):
            run = labels[first - a : last - a, lane]
            if not run.any():
                continue
            edges = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if run[x]:
                    _extend(found[i], LABELS[run[x]], first + int(x), first + int(y))
    return found


def _extend(spans: list[Span], kind: str, a: int, b: int) -> None:
    """Add a run, or join it to the one before, which a window's edge may have cut."""
    if spans and spans[-1][0] == kind and spans[-1][2] == a:
        spans[-1] = (kind, spans[-1][1], b)
    else:
        spans.append((kind, a, b))


def spelt(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The emails in any spelling whose ``@`` lies within 8 characters of a proposal, whole, however long."""
    for m in _MARK.finditer(text, max(0, a - 8), min(len(text), b + 8)):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        begin = end
        while begin > 0 and text[begin - 1] in _NAME:
            begin -= 1
        host = _HOST.match(text, m.end())
        if begin < end and host:
            yield begin, host.end()


def additions(text: str, base: list[Span], proposed: list[Span]) -> list[Span]:
    """Proposed spans, trimmed, that pass the check of their kind and touch no span of the rules.

    An email is taken to the ends of its name and domain in the whole text; no other span ends within a
    run of digits.
    """
    out: list[Span] = []

    def add(kind: str, a: int, b: int) -> None:
        if all(b <= c or a >= d for _, c, d in [*base, *out]):
            out.append((kind, a, b))

    for kind, a, b in proposed:
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip(" .,;:-")), b - len(part) + len(part.rstrip(" .,;:-"))
        if kind == "email":
            for begin, end in spelt(text, a, b):
                add(kind, begin, end)
            continue
        while 0 < a < b and text[a] in _FIGURES and text[a - 1] in _FIGURES:
            a -= 1
        while a < b < len(text) and text[b - 1] in _FIGURES and text[b] in _FIGURES:
            b += 1
        part = text[a:b]
        digits = _DIGITS.findall(part)
        good = {
            "ip": part.count(".") == 3 and PATTERNS["ip"].fullmatch(part) and valid("ip", part),
            "card": valid("card", part),
            "phone": part.startswith("00") and 10 <= len(digits) <= 17 and len(digits) < len(part),
        }[kind]
        if good:
            add(kind, a, b)
    return out


def listed(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 600, sample_chars: int = 4096, **how) -> Model | None:
    """Fit on pieces of ``sample`` documents that hold a digit or an ``@``: a fixed bound.

    They are drawn by a hash of id and text, in the share that gives about twice as many, and the smallest
    hashes are kept. Rows equal in both share a place: the first place is always drawn, and no task
    passes on more than ``sample`` rows, so neither null ids nor copies leave nothing or too much.
    """
    hint = r"[0-9][0-9.() -]{5}|@"
    rows = df.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("t")).filter(F.col("t").rlike(hint))
    place = F.pmod(F.xxhash64("id", "t", F.lit("pii")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn("place", place)
    number, first = rows.agg(F.count("*"), F.min("place")).first()
    drawn = rows.filter(F.col("place") <= max(first or 0.0, 2 * sample / max(1, number)))
    at = F.greatest(F.regexp_instr(F.col("t"), F.lit(hint)) - sample_chars // 2, F.lit(1))
    found = drawn.select("place", "id", F.substring("t", at, F.lit(sample_chars)).alias("t")).orderBy("place", "id", "t").limit(sample).collect()
    return train([r["t"] for r in found], **how)


def find(df: DataFrame, model: Model | None, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``base`` (spans of the rules) and ``found`` (all spans) to every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        base = [rules(t) for t in texts]
        every = base
        if shared.value is not None:
            every = []
            for part in range(0, len(texts), 256):
                some = texts[part : part + 256]
                proposed = decode(shared.value, some)
                every += [listed(b + additions(t, b, p)) for t, b, p in zip(some, base[part:], proposed, strict=False)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in rows], kind) for rows in (base, every)]

    spans = "array<struct<kind:string,start:int,end:int>>"
    return append(df, f"base {spans}, found {spans}", make, drop)
