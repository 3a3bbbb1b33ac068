"""Byte-level BPE and the alignment of two tokenizers, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgauge.llm import align, bpe, queries

AWKWARD = [
    None, "", " ", "\n\n \t", "a", "don't we'll 'S it's '", "</s> <|endoftext|> <s> <unk> [INST]", "straße 東京 naïve 🙂‍🔥 \x00\x7f",
    "١٢٣ ½ Ⅷ", "　wide space ", "same text", "same text", "no" * 3000, "x" + " " * 70000 + "y", "\n" * 40000, " " * 33000 + "z  ", "word " * 20000,
    "▁ literal mark ▁▁", "tab\tand\r\nline", "1234567890" * 50, "!!!???..." * 40,
]


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.RANKS, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def own(ranks):
    return bpe.encoding(ranks)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i % 17 if i % 5 else None, t, "x", "x", 1.5) for i, t in enumerate(AWKWARD)]
    schema = "doc_id long, text string, IDS string, pairs string, n_best double"
    return spark.createDataFrame(rows, schema).repartition(3)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# 11. Byte-level BPE


def brute_ids(ranks, text):
    """Merge the pair of lowest rank, the first of equals, until none is left."""
    out = []
    for m in regex.finditer(bpe.PATTERN, text):
        parts = [bytes([b]) for b in m.group().encode()]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_ids_of_documents(spark, sf, texts, ranks):
    got = {r["doc_id"]: r for r in queries.op11_bpe(spark, sf).collect()}
    assert len(got) == len(texts)
    short = sorted(texts, key=lambda x: len(x[1] or ""))[:150]
    for i, t in short:
        ids = brute_ids(ranks, t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
    assert all(got[i]["decoded_sha256"] == sha(t or "") for i, t in texts)


def test_long_texts_are_cut_nowhere(own, texts):
    """Whole texts through the library at once, where it can take them, and in small pieces."""
    for t in [*(t for t in AWKWARD if t and len(t) < 25000), *(t for _, t in texts if t)]:
        whole = own.encode_ordinary(t)
        for piece in (1, 7, 500):
            assert bpe.ids_of(own, t, piece).tolist() == whole


@settings(max_examples=300, deadline=None)
@given(st.text("ab 's\n\t1é.　", max_size=40), st.integers(1, 6))
def test_pieces_are_safe(text, piece):
    own = _shared()
    parts = list(bpe.pieces(text, piece))
    assert "".join(p for p, _ in parts) == text
    assert bpe.ids_of(own, text, piece).tolist() == own.encode_ordinary(text)


_KEPT: list = []


def _shared():
    if not _KEPT:
        with open(bpe.RANKS, "rb") as f:
            _KEPT.append(bpe.encoding(bpe.read_ranks(f.read())))
    return _KEPT[0]


def test_white_space_without_end(own, ranks):
    """A million blanks, which the expression itself cannot take."""
    text = "a" + " " * 1_000_000 + "b"
    ids = bpe.ids_of(own, text)
    by_id = {i: b for b, i in ranks.items()}
    assert b"".join(by_id[i] for i in ids.tolist()).decode() == text
    assert by_id[int(ids[-1])] == b" b"
    short = bpe.ids_of(own, "a" + " " * 999 + "b", 10).tolist()
    assert short == own.encode_ordinary("a" + " " * 999 + "b")


def test_encode_awkward(awkward, ranks):
    out = bpe.decode(bpe.encode(awkward))
    assert out.columns == ["doc_id", "text", "pairs", "n_best", "ids", "decoded"]
    rows = out.collect()
    assert Counter(r["text"] for r in rows) == Counter(AWKWARD)
    for r in rows:
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        if len(r["text"] or "") < 1000:
            assert r["ids"] == brute_ids(ranks, r["text"] or "")
    assert bpe.encode(awkward.limit(0)).count() == 0
    odd = awkward.limit(1).select(F.expr("array(15496, null, 99999999, 995)").alias("ids"))
    assert bytes(bpe.decode(odd).first()["decoded"]) == b"Hello world"
    assert bytes(bpe.decode(odd.select(F.lit(None).cast("array<int>").alias("ids"))).first()["decoded"]) == b""


# 12. Alignment


def brute_aligned(texts):
    """Per text: ids, groups and links from the byte owners of both sides; then the counts over all texts."""
    with open(align.BYTE_LEVEL, encoding="utf-8") as f, open(align.PIECES, "rb") as g:
        a_side, b_side = align.ByteLevel(f.read()), align.PieceModel(g.read())
    rows, docs = [], Counter()
    for t in texts:
        a, b = (a_side.encode([f" {t}"])[0], b_side.encode([t])[0]) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if not t or any(b"".join(side.bytes[i] for i in ids) != whole for side, ids in ((a_side, a), (b_side, b))):
            a, b = [], []
        owners = [[k for k, i in enumerate(ids) for _ in side.bytes[i]] for side, ids in ((a_side, a), (b_side, b))]
        ends = [{p + 1 for p in range(len(o)) if p + 1 == len(o) or o[p] != o[p + 1]} for o in owners]
        groups, at = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[k]) for k in sorted(set(o[at:end]))) for ids, o in ((a, owners[0]), (b, owners[1]))))
            at = end
        met = [(a[x], b[y]) for x, y in sorted(set(zip(*owners, strict=True)))]
        docs.update(set(met))
        rows.append((len(a), len(b), len(groups), met, sha(";".join(groups)) if groups else ""))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return [
        (na, nb, ng, len(met), sum(docs[m] == best[m[0]] for m in met), sum(docs[m] for m in met), digest) for na, nb, ng, met, digest in rows
    ]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_documents(spark, sf, texts):
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in queries.op12_align(spark, sf).collect()}
    want = dict(zip([i for i, _ in texts], brute_aligned([t for _, t in texts]), strict=True))
    assert got == want
    assert sum(x[3] > x[2] for x in want.values()) > len(want) / 2


@pytest.mark.parametrize("common", [0, 3, 1 << 18])
def test_alignment_awkward(awkward, common):
    """Null ids, repeated rows, very long texts; the same counts whichever way the pairs go."""
    made = align.align(awkward)
    assert made.columns == ["doc_id", "text", "IDS", "n_best", "a_ids", "b_ids", "groups", "n_a", "n_b", "n_groups", "spelt", "pairs", "times"]
    out = align.count_links(made, common)
    assert out.columns == ["doc_id", "text", "IDS", "a_ids", "b_ids", "groups", "n_a", "n_b", "n_groups", "spelt", "n_links", "n_best", "count_sum"]
    want = Counter((t, x[3:6]) for t, x in zip(AWKWARD, brute_aligned(AWKWARD), strict=True))
    assert Counter((r["text"], (r["n_links"], r["n_best"], r["count_sum"])) for r in out.collect()) == want
    assert align.count_links(align.align(awkward.limit(0)), common).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é.\n\t'　▁1", max_size=30), max_size=4))
def test_segments_are_whole_texts(texts):
    """Whatever the white space: ids by segment are the ids of the whole text, if both sides give it back."""
    if not _SEGMENTS:
        with open(align.BYTE_LEVEL, encoding="utf-8") as f, open(align.PIECES, "rb") as g:
            _SEGMENTS.append(align.Segments(align.ByteLevel(f.read()), align.PieceModel(g.read()), limit=40))
    met = _SEGMENTS[0]
    one, two = met._sides
    a_ids, b_ids, groups, *_, spelt = align._aligned(texts, met, ("a_ids", "b_ids", "groups", "spelt"))
    for own, told in zip(groups.to_pylist(), spelt.to_pylist(), strict=True):
        assert ";".join("|".join(",".join(map(str, g[side])) for side in "ab") for g in own) == told
    for t, a, b in zip(texts, a_ids.to_pylist(), b_ids.to_pylist(), strict=True):
        whole = one.encode([f" {t}"])[0], two.encode([t])[0]
        if t and all(b"".join(s.bytes[i] for i in ids) == f" {t}".encode() for s, ids in zip((one, two), whole, strict=True)):
            assert (a, b) == whole
        else:
            assert (a, b) == ([], [])


_SEGMENTS: list = []


def test_overlaps_of_a_group():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.randint(1, 12)
        sides = []
        for _ in range(2):
            marks = sorted(rng.sample(range(1, total), rng.randint(0, total - 1))) if total > 1 else []
            sides.append([y - x for x, y in zip([0, *marks], [*marks, total], strict=True)])
        owners = [[k for k, n in enumerate(s) for _ in range(n)] for s in sides]
        want = sorted(set(zip(*owners, strict=True)))
        assert align.overlaps(*sides) == want
        _, i, j = align.links(*map(np.array, sides), *align.cuts(*map(np.array, sides)))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want
