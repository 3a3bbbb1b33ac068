"""Two tokenizers' tokens of one text, aligned by bytes, and how often their ids meet.

The text is encoded by a byte-level BPE (A, after a blank) and by a piece model (B, which puts the
blank there itself). Each side's cumulative byte ends go into a dictionary from end to index; the
ends that both have, sorted, cut both id lists into groups. Within a group every A and B token whose
byte ranges overlap are linked.

No token of either side goes on from another character into a blank, so between a character that is not
white space and a blank both sides have an end, and what stands on one side of it does not depend on
the other. Texts are therefore taken in segments from one such place to the next, and a worker encodes
and aligns a segment once for all its occurrences; a text's ids and groups are those of its segments in
order. With a vocabulary that has such a token, a text is one segment.

The count of a pair of ids is the number of documents in which it is linked. A document passes on
its distinct pairs, which are counted with map-side combine. Counts go back to the documents in two
ways: the ``common`` pairs with the highest counts are broadcast (16 bytes each, a fixed bound) and
looked up in place; all other pairs meet their counts in a join, where no key has more rows than the
rarest of the common pairs. Which way a pair takes changes no result.

Edge cases: texts that are null or empty, or that one of the models does not give back byte for byte,
have no tokens, groups or links, and so have texts with a token that has no bytes; control strings inside
texts are plain text; rows that repeat are documents of their own; ids
of rows play no part, null or repeated; columns of the input named like an added one, in any case,
give way; an empty table stays empty.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.llm.batches import append
from quillgauge.session import stored

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# A pair is one long: the A id in the upper half, the B id in the lower.
_HALF = 32
# A blank and what follows, up to a character that is not white space before the next blank; a blank
# that ends the text belongs to what is before it.
_SEGMENT = re.compile(r" [^ ]*(?:(?<!\S) [^ ]*)*(?: \Z)?")


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level entry stands for: printable Latin-1 is itself, the rest follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """The bytes of every id of a tokenizer."""

    bytes: list[bytes]
    sizes: np.ndarray

    def gives_back(self, ids: Flat, told: list[bytes]) -> np.ndarray:
        """Which of the lists of ids are, byte for byte, what they should be; ids without bytes never are."""
        own = [self.bytes[i] for i in ids.values.tolist()]
        sizes = self.sizes[ids.values]
        owner = np.repeat(np.arange(len(told)), ids.sizes)
        good = np.bincount(owner, sizes, len(told)) == np.fromiter(map(len, told), np.int64, len(told))
        good &= np.bincount(owner[sizes == 0], minlength=len(told)) == 0
        if not good.all() or b"".join(own) != b"".join(told):
            ends = np.cumsum(ids.sizes).tolist()
            good &= np.array([b"".join(own[x:y]) == t for x, y, t in zip([0, *ends], ends, told, strict=False)])
        return good


class ByteLevel(Side):
    """Side A: a tokenizer file in which entries spell bytes as characters; texts come with their blank."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._own = Tokenizer.from_str(content)
        self._own.encode_special_tokens = True
        spelt, entries = byte_alphabet(), self._own.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(spelt[c] for c in entry) if all(c in spelt for c in entry) else entry.encode()
        self.sizes = np.array([len(b) for b in self.bytes])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._own.encode_batch_fast(texts, add_special_tokens=False)]


class PieceModel(Side):
    """Side B: a sentence piece model, which puts a blank before the text."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self._own = SentencePieceProcessor(model_proto=content)
        names = [self._own.id_to_piece(i) for i in range(self._own.get_piece_size())]
        self.bytes = [
            b"" if self._own.is_control(i) else bytes([int(n[3:-1], 16)]) if self._own.is_byte(i) else n.replace("▁", " ").encode()
            for i, n in enumerate(names)
        ]
        self.sizes = np.array([len(b) for b in self.bytes])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._own.encode(texts, num_threads=1)


def cuts(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end in both token lists, from the tokens' byte sizes."""
    ends_a = dict(zip(np.cumsum(a_sizes).tolist(), range(1, len(a_sizes) + 1), strict=True))
    ends_b = dict(zip(np.cumsum(b_sizes).tolist(), range(1, len(b_sizes) + 1), strict=True))
    common = sorted(ends_a.keys() & ends_b.keys())
    return tuple(np.fromiter(map(ends.__getitem__, common), np.int64, len(common)) for ends in (ends_a, ends_b))


def overlaps(a_sizes: Sequence[int], b_sizes: Sequence[int]) -> list[tuple[int, int]]:
    """Index pairs of the tokens of one group whose byte ranges overlap."""
    out, i, j, at = [], 0, 0, 0
    a_ends, b_ends = list(accumulate(a_sizes)), list(accumulate(b_sizes))
    while i < len(a_ends) and j < len(b_ends):
        a_end, b_end = a_ends[i], b_ends[j]
        if min(a_end, b_end) > at:
            out.append((i, j))
            at = min(a_end, b_end)
        i, j = i + (a_end <= b_end), j + (b_end <= a_end)
    return out


def links(a_sizes: np.ndarray, b_sizes: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, A index, B index) of all links, by group. With one token on a side all others overlap it."""
    a_from, b_from = (np.concatenate([[0], c[:-1]]) if len(c) else c for c in (a_cuts, b_cuts))
    n, m = a_cuts - a_from, b_cuts - b_from
    one = np.flatnonzero((n == 1) | (m == 1))
    each = n[one] * m[one]
    group = np.repeat(one, each)
    local = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
    first, second = [a_from[group] + local // m[group]], [b_from[group] + local % m[group]]
    groups = [group]
    for g in np.flatnonzero((n > 1) & (m > 1)).tolist():
        i, j = int(a_from[g]), int(b_from[g])
        met = np.array(overlaps(a_sizes[i : a_cuts[g]].tolist(), b_sizes[j : b_cuts[g]].tolist()))
        groups.append(np.full(len(met), g))
        first.append(met[:, 0] + i)
        second.append(met[:, 1] + j)
    group = np.concatenate(groups)
    order = np.argsort(group, kind="stable")
    return group[order], np.concatenate(first)[order], np.concatenate(second)[order]


def crosses(entry: bytes) -> bool:
    """Whether a blank follows a character that is not white space within an entry."""
    return re.search(r"\S ", entry.decode(errors="replace")) is not None


class Flat:
    """Lists of numbers one after the other, looked up by the number of the list."""

    def __init__(self, values: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.values, self.sizes = (np.empty(0, np.int64) if x is None else x for x in (values, sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def made(cls, lists: list[list[int]]) -> Flat:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return cls(np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes)

    def __add__(self, other: Flat) -> Flat:
        return Flat(np.concatenate([self.values, other.values]), np.concatenate([self.sizes, other.sizes]))

    def only(self, kept: np.ndarray) -> Flat:
        """The lists marked in ``kept``, the others empty."""
        return Flat(self.values[np.repeat(kept, self.sizes)], np.where(kept, self.sizes, 0))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The values of the lists with these numbers, in order."""
        sizes = self.sizes[numbers]
        first = self.starts[numbers] - (np.cumsum(sizes) - sizes)
        return self.values[np.repeat(first, sizes) + np.arange(sizes.sum())]


class Segments:
    """Segments that a worker has met, each encoded and aligned once.

    Of more than ``limit`` segments the half used most is kept, so memory is bounded; one that is met again
    is aligned again.
    """

    def __init__(self, one: ByteLevel, two: PieceModel, limit: int = 500_000):
        self._sides, self._limit = (one, two), limit
        self._whole = any(map(crosses, (*one.bytes, *two.bytes)))
        self._numbers: dict[str, int] = {}
        # Token ids of both sides, group ends of both sides, linked pairs.
        self.fields = [Flat() for _ in range(5)]
        self.spelt: list[str] = []
        self.good, self._used = np.empty(0, bool), np.empty(0, np.int64)

    def split(self, text: str) -> list[str]:
        """The segments of a text, each with the blank before it."""
        return [f" {text}"] if self._whole else _SEGMENT.findall(f" {text}")

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all segments of all texts; those not met yet are aligned."""
        if len(self.spelt) > self._limit:
            self._forget()
        known = self._numbers
        new = list(dict.fromkeys(s for s in chain.from_iterable(texts) if s not in known))
        if new:
            self._align(new)
        found = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64)
        self._used += np.bincount(found, minlength=len(self._used))
        return found

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self._used, kind="stable")[: self._limit // 2])
        names = list(self._numbers)
        self._numbers = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.spelt = [self.spelt[k] for k in kept.tolist()]
        self.fields = [Flat(f.of(kept), f.sizes[kept]) for f in self.fields]
        self.good, self._used = self.good[kept], self._used[kept] // 2

    def _align(self, new: list[str]) -> None:
        """Encode segments, and align all of them in one pass over their joined bytes."""
        one, two = self._sides
        sides = [Flat.made(one.encode(new)), Flat.made(two.encode([s[1:] for s in new]))]
        told = [s.encode() for s in new]
        good = np.ones(len(new), bool)
        for side, own in zip(sides, self._sides, strict=True):
            good &= own.gives_back(side, told)
        a, b = (side.only(good) for side in sides)
        a_sizes, b_sizes = one.sizes[a.values], two.sizes[b.values]
        a_cuts, b_cuts = cuts(a_sizes, b_sizes)
        # A segment ends where both sides have an end, so every group lies in one segment.
        of_token = np.repeat(np.arange(len(new)), a.sizes)
        of_group = of_token[a_cuts - 1]
        groups = np.bincount(of_group, minlength=len(new))
        group, i, j = links(a_sizes, b_sizes, a_cuts, b_cuts)
        pairs = Flat(a.values[i] << _HALF | b.values[j], np.bincount(of_group[group], minlength=len(new)))
        ends = [Flat(c - side.starts[of_group], groups) for side, c in ((a, a_cuts), (b, b_cuts))]
        self._numbers |= dict(zip(new, range(len(self.spelt), len(self.spelt) + len(new)), strict=True))
        self.spelt += _spelt(a, b, a_cuts, b_cuts)
        self.fields = [f + more for f, more in zip(self.fields, (a, b, *ends, pairs), strict=True)]
        self.good, self._used = np.concatenate([self.good, good]), np.concatenate([self._used, np.zeros(len(new), np.int64)])


def _spelt(a: Flat, b: Flat, a_cuts: np.ndarray, b_cuts: np.ndarray) -> list[str]:
    """The groups of every segment as ``a1,a2|b1;a3|b2,b3``."""
    signs: list[list[str]] = []
    for side, ends, last in ((a, a_cuts, "|"), (b, b_cuts, ";")):
        marks = np.full(len(side.values), ",", object)
        marks[ends - 1] = last
        signs.append([str(v) + s for v, s in zip(side.values.tolist(), marks.tolist(), strict=True)])
    sizes = [np.diff(c, prepend=0) for c in (a_cuts, b_cuts)]
    # Group by group: the A tokens stand after all B tokens of earlier groups, the B tokens after all A tokens so far.
    at = np.concatenate([np.arange(len(a.values)) + np.repeat(b_cuts - sizes[1], sizes[0]), np.arange(len(b.values)) + np.repeat(a_cuts, sizes[1])])
    line = np.empty(len(at), object)
    line[at] = [*signs[0], *signs[1]]
    parts, ends = line.tolist(), np.cumsum(a.sizes + b.sizes).tolist()
    return ["".join(parts[x:y])[:-1] for x, y in zip([0, *ends], ends, strict=False)]


def _lists(values: np.ndarray, sizes: np.ndarray, kind=np.int64) -> pa.ListArray:
    return pa.ListArray.from_arrays(_edges(sizes), values if isinstance(values, pa.Array) else pa.array(values.astype(kind)))


def _edges(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


OUTPUTS = {
    "a_ids": "array<int>", "b_ids": "array<int>", "groups": "array<struct<a:array<int>,b:array<int>>>", "n_a": "long", "n_b": "long",
    "n_groups": "long", "spelt": "string", "pairs": "array<long>", "times": "array<int>",
}


def _aligned(texts: list[str | None], met: Segments, give: Sequence[str] = tuple(OUTPUTS)) -> list[pa.Array]:
    """The outputs named in ``give`` for some texts."""
    parts = [met.split(t) if t else [] for t in texts]
    numbers = met.numbers(parts)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    # A text of which a segment is not given back byte for byte has no tokens.
    bad = np.bincount(owner[~met.good[numbers]], minlength=len(texts)) > 0
    numbers, owner = numbers[~bad[owner]], owner[~bad[owner]]

    def each(sizes: np.ndarray) -> np.ndarray:
        return np.bincount(owner, sizes, len(texts)).astype(np.int64)

    a, b, a_cuts, b_cuts, links = met.fields
    counts = {"n_a": a.sizes, "n_b": b.sizes, "n_groups": a_cuts.sizes}
    out = {name: pa.array(each(sizes[numbers])) for name, sizes in counts.items()}
    for name, side in (("a_ids", a), ("b_ids", b)):
        if name in give:
            out[name] = _lists(side.of(numbers), each(side.sizes[numbers]), np.int32)
    if "groups" in give:
        sides = []
        for side, ends in ((a, a_cuts), (b, b_cuts)):
            sizes = side.sizes[numbers]
            edges = ends.of(numbers) + np.repeat(np.cumsum(sizes) - sizes, ends.sizes[numbers])
            sides.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], edges]).astype(np.int32)), pa.array(side.of(numbers).astype(np.int32))))
        out["groups"] = _lists(pa.StructArray.from_arrays(sides, ["a", "b"]), each(a_cuts.sizes[numbers]))
    if "spelt" in give:
        words, ends = [met.spelt[n] for n in numbers.tolist()], np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
        out["spelt"] = pa.array([";".join(words[x:y]) for x, y in zip([0, *ends], ends, strict=False)], pa.string())
    pair, holder = links.of(numbers), np.repeat(owner, links.sizes[numbers])
    order = np.lexsort((pair, holder))
    pair, holder = pair[order], holder[order]
    first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(holder, prepend=-1) != 0))
    held = np.bincount(holder[first], minlength=len(texts))
    out["pairs"], out["times"] = _lists(pair[first], held), _lists(np.diff(np.append(first, len(pair))), held, np.int32)
    return [out[name] for name in give]


def align(
    df: DataFrame, text: str = "text", byte_level: str = BYTE_LEVEL, piece_model: str = PIECES, give: Sequence[str] = tuple(OUTPUTS), drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add the outputs named in ``give`` to every row.

    There are ``a_ids``, ``b_ids`` and ``groups``, their numbers ``n_a``, ``n_b`` and ``n_groups``, the groups as
    text in ``spelt``, and the distinct linked ``pairs`` with their ``times``.
    The two paths are read by the driver; the files, two megabytes, are broadcast.
    """
    with open(byte_level, encoding="utf-8") as f, open(piece_model, "rb") as g:
        content = df.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    cache: list = []

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not cache:
            cache.append(Segments(ByteLevel(content.value[0]), PieceModel(content.value[1])))
        return _aligned(batch.column(batch.schema.get_field_index(text)).to_pylist(), cache[0], give)

    return append(df, ", ".join(f"{name} {OUTPUTS[name]}" for name in give), make, drop, text)


def pair_counts(aligned: DataFrame, pairs: str = "pairs") -> DataFrame:
    """(pair, n, best): the documents that link a pair, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    # A window holds the pairs of one A id, at most one for each B id.
    same = Window.partitionBy(F.shiftright("pair", _HALF))
    return stored(counts.withColumn("best", F.col("n") == F.max("n").over(same)), "pairs")


def count_links(aligned: DataFrame, common: int = 1 << 18) -> DataFrame:
    """Replace ``pairs`` and ``times`` by ``n_links, n_best, count_sum``.

    ``n_best`` is the number of links whose count is the highest of their A id, ``count_sum`` the sum of
    the counts over all links.
    """
    new = ("n_links", "n_best", "count_sum", "pairs", "times")
    kept = [c for c in aligned.columns if c.lower() not in new]
    names = [f"__own_{i}" for i in range(len(kept))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)]
    rows = stored(aligned.select(*columns, "pairs", "times", F.monotonically_increasing_id().alias("__row")), "aligned")
    counts = pair_counts(rows)
    top = counts.orderBy(F.desc("n"), "pair").limit(common).toArrow()
    order = np.argsort(keys := top["pair"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order], top["best"].to_numpy()[order]))

    def look(batch: pa.RecordBatch) -> list[pa.Array]:
        known, n, best = shared.value
        pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
        owner = np.repeat(np.arange(len(batch)), pairs.value_lengths().to_numpy())
        pair, time = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
        met = known[at] == pair if len(known) else np.zeros(len(pair), bool)
        sums = np.zeros((3, len(batch)), np.int64)
        np.add.at(sums[0], owner, time)
        if len(known):
            np.add.at(sums[1], owner[met], time[met] * best[at[met]])
            np.add.at(sums[2], owner[met], time[met] * n[at[met]])
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[~met], minlength=len(batch)))]).astype(np.int32)
        rest = [pa.ListArray.from_arrays(ends, pa.array(x[~met])) for x in (pair, time)]
        return [*[pa.array(s) for s in sums], *rest]

    state = "n_links long, n_best long, count_sum long, rest array<long>, rest_times array<long>"
    found = stored(append(rows, state, look, ("pairs", "times")), "looked_up")
    rare = found.filter(F.size("rest") > 0).select("__row", F.inline(F.arrays_zip("rest", "rest_times"))).join(counts, F.col("rest") == F.col("pair"))
    more = rare.groupBy(F.col("__row").alias("__r")).agg(
        F.sum(F.when(F.col("best"), F.col("rest_times")).otherwise(0)).alias("more_best"), F.sum(F.col("rest_times") * F.col("n")).alias("more_sum")
    )
    out = found.join(more, F.col("__row") == F.col("__r"), "left")
    added = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], "n_links", *added)
