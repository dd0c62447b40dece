"""Hard negatives, tokenizer alignment and the quality classifier against plain re-computations on awkward rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID
from llm_fixtures import bench, docs, frame  # noqa: F401
from tabula.llm import alignment, embedding_quality as eq, hard_negatives as hn

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ── Hard negatives ────────────────────────────────────────────────────────
def mined(table, every=100):
    part = []
    for i, v, y in table:
        if None in (i, v, y) or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        part.append((i, y, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in v]))
    out = []
    for a, (i, y, v) in enumerate(part):
        if i % every:
            continue
        scored = sorted(((max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(v, w)))), j, z) for b, (j, z, w) in enumerate(part) if b != a),
                        key=lambda s: (-s[0], s[1]))
        for ps, pid, _ in [s for s in scored if s[2] == y][:5]:
            hit = [s for s in scored if s[2] != y and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            out += [(i, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(hit)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    table = [(k, [float(x) for x in rng.normal(0, 0.3, 6) + (k % 4) * 0.2], int(rng.integers(0, 4))) for k in range(700)]
    table += [(700, [1.0] * 6, 2), (700, [1.0] * 6, 2), (700, [0.5] * 6, 2), (714, [1.0] * 6, 3)]  # repeated rows and ids
    table += [(1000 + k, [0.25, 0.25, 0.5, 0.25, 0.25, 0.5], k % 3) for k in range(60)]  # ties
    table += [(800, None, 1), (900, [1.0, None], 1), (1100, [float("nan")] * 6, 1), (1200, [float("inf")] * 6, 0), (1300, [1.0] * 6, None),
              (None, [1.0] * 6, 1), (1400, [], 1), (1500, [0.5], 1), (1600, [0.1] * 9, 2), (1700, [0.0] * 6, 3)]
    return table


def _embeddings(spark, table):
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").repartition(4)
    for n in ("row", "anchor", "i", "j", "id", "slot", "score", "vec", "place"):
        df = df.withColumn(n, F.lit("extra"))
    return df


def test_hard_negatives(spark, vectors, monkeypatch):
    want = mined(vectors)
    assert len({r[0] for r in want}) > 6 and max(r[2] for r in want) == 10
    df = _embeddings(spark, vectors)
    assert rows(hn.report(df)) == want
    monkeypatch.setattr(hn, "ROW_BLOCK", 40)  # many blocks of both sides, tiles of a few anchors
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hn, "TILE", 100)
    assert rows(hn.report(df)) == want
    assert hn.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e4, 1e8, 1e18])
def test_hard_negatives_of_large_components(spark, scale):
    rng = np.random.default_rng(6)
    table = [(k * 50, [float(x) for x in rng.normal(0, scale, 3)], k % 2) for k in range(12)]
    assert rows(hn.report(_embeddings(spark, table))) == mined(table)


# ── Tokenizer alignment ───────────────────────────────────────────────────
@pytest.fixture(scope="module")
def cut():
    """text -> (A ids, A bytes, B ids, B bytes), the A bytes taken from the rank file."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    ranks = dict(line.split() for line in open(f"{alignment.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))
    a_bytes = {int(v): base64.b64decode(k) for k, v in ranks.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/piece_bpe_32k.model")

    def of(text):
        x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        pieces = [b.id_to_piece(i) for i in y]
        return x, [a_bytes[i] for i in x], y, [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    return of


def by_hand(cut, texts):
    out, counts = [], Counter()
    for t in texts:
        x, xb, y, yb = cut(t) if t else ([], [], [], [])
        if not t or not b"".join(xb) == b"".join(yb) == b" " + t.encode():
            out.append(None)
            continue
        ae, be = np.cumsum([len(b) for b in xb]), np.cumsum([len(b) for b in yb])
        as_, bs = ae - [len(b) for b in xb], be - [len(b) for b in yb]
        links = [(i, j) for i in range(len(x)) for j in range(max(0, int(np.searchsorted(be, as_[i])) - 1), len(y))[:80] if as_[i] < be[j] and bs[j] < ae[i]]
        ends = sorted(set(ae.tolist()) & set(be.tolist()))
        groups, lo = [], 0
        for e in ends:
            groups.append(",".join(str(v) for v, s in zip(x, ae) if lo < s <= e) + "|" + ",".join(str(v) for v, s in zip(y, be) if lo < s <= e))
            lo = e
        ids = [(x[i], y[j]) for i, j in links]
        counts.update(set(ids))
        out.append((len(x), len(y), len(groups), ids, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(0,) * 6 + ("",) if r is None else (r[0], r[1], r[2], len(r[3]), sum(counts[p] == best[p[0]] for p in r[3]), sum(counts[p] for p in r[3]), r[4])
            for r in out]


ODD = ["  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> and <s> </s> <unk>", "ﬁ ligature", "🙂🙃 emoji 漢字 mixed", "a" * 3000, "▁ mark", "é é", " ", "\x00 nul",
       "x y", "1234567890 12 3.5", "don't they'll", "한국어"]


def test_alignment(spark, docs, cut):
    table = [(d[0], d[1] and d[1][:20000], *d[2:]) for d in docs] + [(500 + i, t, "en", "odd", 0) for i, t in enumerate(ODD)]
    want = sorted(((d[0], *w) for d, w in zip(table, by_hand(cut, [d[1] for d in table]))), key=repr)
    assert sum(w[1] > 0 for w in want) > 100 and sum(w[1] == 0 for w in want) >= 3
    df = spark.createDataFrame(table, SCHEMA).repartition(3).withColumn("row", F.lit("extra")).withColumn("pairs", F.lit("extra"))
    assert rows(alignment.report(df)) == want
    assert alignment.report(df.limit(0)).count() == 0


def test_lanes_change_nothing(docs):
    aligner = alignment.Aligner(*alignment.tokenizers(alignment.TOKENIZERS))
    texts = [d[1] for d in docs] + ODD
    x = aligner.tokens(texts)
    ends = np.cumsum(aligner.a_size[x[0]]), np.cumsum(aligner.b_size[x[2]])
    whole = alignment.lockstep(*ends, *alignment._lanes(*ends, x[1], x[3], size=1 << 30))
    for size in (5, 64):
        lanes = alignment._lanes(*ends, x[1], x[3], size=size)
        assert len(lanes[0]) > len(texts) + 50
        for got, want in zip(alignment.lockstep(*ends, *lanes), whole):
            np.testing.assert_array_equal(got, want)


def test_ranks_cut_as_the_library_of_the_file_does():
    from tokenizers import Tokenizer
    path = f"{alignment.TOKENIZERS}/{alignment.BYTE_BPE}"
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    chars = [chr(c) for c in range(0, 0x30000, 11) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c} 1{c}2  {c}" for c in chars] + ODD
    want = [e.ids for e in model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
    assert alignment.ByteTokens(path).ids(texts) == want


def test_link_rows(spark, cut):
    got = alignment.links(spark.createDataFrame([(1, "unbelievable words"), (2, None)], "doc_id long, text string")).collect()
    x, xb, y, yb = cut("unbelievable words")
    assert {(r.doc_id) for r in got} == {1} and {r.a_place for r in got} == set(range(len(x))) and {r.b_place for r in got} == set(range(len(y)))
    assert all(x[r.a_place] == r.a_id and y[r.b_place] == r.b_id for r in got)


# ── Quality classifier ────────────────────────────────────────────────────
def test_contexts_by_hand(spark, docs, monkeypatch):
    places, signs = eq._index()
    units, want, n = eq.Units(), np.zeros((eq.BUCKETS, eq.DIMS)), Counter()
    for d in docs:
        ids = units.of(d[1])
        n.update(ids)
        for i, w in enumerate(ids):
            for k in range(max(0, i - eq.WINDOW), min(len(ids), i + eq.WINDOW + 1)):
                if k != i:
                    want[w, places[ids[k]]] += signs[ids[k]]
    monkeypatch.setattr(eq, "COUNTED", 700)  # pieces that end inside texts
    got = np.zeros_like(want)
    counts = {}
    for b in eq._count(iter(spark.createDataFrame(docs, SCHEMA).select("text").toArrow().to_batches())):
        for i, c, v in zip(*(b.column(k).to_pylist() for k in range(3))):
            counts[i] = counts.get(i, 0) + c
            got[i] += v
    assert counts == dict(n)
    np.testing.assert_array_equal(got, want)


def test_pooled_by_hand(docs, monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(eq.BUCKETS, eq.DIMS))
    monkeypatch.setattr(eq, "PIECE", 100)
    texts = [d[1] for d in docs]
    got = eq.pooled(eq.Units(), vectors, texts)
    for t, x in zip(texts, got):
        ids = eq.Units().of(t)
        v = vectors[ids].astype(float) if ids else np.zeros((1, eq.DIMS))
        again = [sum(ids[i] == ids[i - k] for i in range(k, len(ids))) / max(len(ids), 1) for k in eq.LAGS]
        np.testing.assert_allclose(x, [*v.mean(0), *v.std(0), *again, np.log1p(len(ids))], atol=1e-6)


def test_network_gradient_and_temperature():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 5)), rng.integers(0, 2, 40).astype(float)
    w = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]

    def loss():
        z = np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
        return eq.log_loss(z, y) + eq.DECAY / 2 * ((w[0] ** 2).sum() + (w[2] ** 2).sum())

    for p, g in zip(w, eq.gradient(w, x, y)):
        for i in np.ndindex(p.shape):
            keep = p[i]
            p[i] = keep + 1e-6
            up = loss()
            p[i] = keep - 1e-6
            down = loss()
            p[i] = keep
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6
    z = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(eq.best_temperature(3 * z, y) - 3) < 0.4


def test_quality_classifier_held_out(spark):
    got = E.queries()["op13_quality_classifier"](spark, SF_MID).toPandas()
    table = pd.read_parquet(f"{SF_MID}/documents.parquet")
    assert sorted(got.doc_id) == sorted(table.doc_id) and got.score.between(0, 1).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{SF_MID}/labels.parquet"), on="doc_id")
    assert len(held) > 80 and (held.predicted == held.quality).mean() >= 0.97
    z, y = np.log(held.score / (1 - held.score)), held.quality
    assert eq.log_loss(z.to_numpy(), y.to_numpy()) < 0.1


def test_quality_classifier_edges(spark, frame, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = eq.report(frame, none)
    assert {r.score for r in got.collect()} == {0.5} and got.count() == len(docs)
    one = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in eq.report(frame, one).collect())
    mixed = spark.createDataFrame([(d[0], int(d[0] % 2), None) for d in docs if d[0]] + [(None, 1, None), (3, None, None), (4, 7, None)],
                                  "doc_id long, quality int, text string")
    got = eq.report(frame, mixed).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert eq.report(frame.limit(0), mixed).count() == 0
