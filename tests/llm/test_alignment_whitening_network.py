"""Tokenizer alignment, embedding whitening and the byte network: brute force, edge cases, held-out accuracy."""

import hashlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidepanel.llm import alignment, byte_network, whitening  # noqa: E402
from tidepanel.llm import queries as llm_queries  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
CLASH = {"id": "clash", "text_": "clash", "v": "clash", "n": 1, "component": 2, "score": 3.0, "predicted": 4, "label": 5, "block": 6, "keys": 7, "said": 8, "_text": 9}


def with_clashes(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


# ---- 11


def aligned_by_hand(texts):
    """Rows and pair counts of texts, token by token, whole texts through the libraries."""
    own, found, counts = alignment.Aligner(A, B), [], Counter()
    for text in texts:
        a = own.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = own.b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(own.bytes_a[i] for i in a) != raw or b"".join(own.bytes_b[i] for i in b) != raw:
            a = b = []
        spans = []
        for ids, table in ((a, own.bytes_a), (b, own.bytes_b)):
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids, strict=False)))
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        sides = [[",".join(str(i) for _, e, i in side if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts, strict=False)] for side in spans]
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, ";".join(f"{x}|{y}" for x, y in zip(*sides, strict=True))))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    rows = [(n_a, n_b, n_g, len(li), sum(counts[x] == top[x[1]] for x in li), sum(counts[x] for x in li), g) for n_a, n_b, n_g, li, g in found]
    return rows, counts


ODD_TEXTS = [None, "", " ", "  a b ", "x\n y \n", "a▁b c", "日本語 🎉 <0x0A> </s>\n<|endoftext|> it's", "​ a ᠎ b", "a  b", "tab\t c d", "nul\0 a", "\x1c a\x1f b", " lead", "trail ", "é è\xa0ñ", "long word " * 200, "long word " * 200, "x" * 700 + " y" * 300]


@pytest.mark.parametrize(("block", "window"), [(40, 64), (1 << 20, 1 << 20)])
def test_alignment_equals_brute_force_on_odd_texts(spark, monkeypatch, block, window):
    monkeypatch.setattr(alignment, "WINDOW", window)  # reaches the workers of a local session only where they fork anew
    docs = with_clashes(spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(ODD_TEXTS)], "doc_id bigint, text string").repartition(3))
    want, counts = aligned_by_hand(ODD_TEXTS)
    got = alignment.align_documents(docs, A, B, payload="groups", block_bytes=block)
    rows = {r["doc_id"]: tuple(r)[1:] for r in got.documents.collect()}
    assert len(rows) == len(ODD_TEXTS)
    for i, row in enumerate(want):
        assert rows[i if i != 5 else None] == row, ODD_TEXTS[i]
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    assert {(r.a_id, r.b_id, r.n, r.best) for r in got.pairs.collect()} == {(x, y, n, n == top[y]) for (x, y), n in counts.items()}
    empty = alignment.align_documents(docs.limit(0), A, B)
    assert empty.documents.count() == 0 and empty.pairs.count() == 0


def test_segments_of_long_texts_change_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "WINDOW", 50)
    own = alignment.aligner(A, B)
    text = "some words  and\n more  " * 60 + "x" * 200 + " end"
    cut, whole = alignment.Block(own, "groups"), alignment.Block(own, "groups")
    cut.add([0], [text])
    monkeypatch.setattr(alignment, "WINDOW", 1 << 20)
    whole.add([0], [text])
    assert len(list(alignment.segments(text))) == 1 and cut.said == whole.said
    assert cut.row()["stats"] == whole.row()["stats"] and cut.row()["counts"] == whole.row()["counts"]


@data
def test_alignment_query_equals_brute_force(spark):
    got = llm_queries.queries()["op11_tokenizer_alignment"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want, _ = aligned_by_hand(docs["text"].tolist())
    want = {i: (*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for i, r in zip(docs["doc_id"], want, strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


# ---- 12


def whitened_by_hand(v, components=4):
    x = np.floor(v.astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / np.trace(cov)


def test_whitening_equals_numpy_and_ignores_copies(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5] + 3).astype(np.float32)
    v = np.concatenate([v, np.repeat(v[:1], 200, axis=0)])  # one vector is two fifths of all rows
    df = with_clashes(spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(5))
    model = whitening.fit_whitening(df)
    got = whitening.whiten(df, model).toPandas().sort_values(["vec_id", "component"])
    n, dev, white, explained = whitened_by_hand(v)
    assert (got["n"] == n).all() and n == 300
    assert (got["deviation"].to_numpy().reshape(-1, 4) == dev[:, None]).all()
    own = got["whitened"].to_numpy().reshape(-1, 4)
    assert np.abs(own * np.sign(own[0]) - white * np.sign(white[0])).max() < 1e-9
    assert np.allclose(got["explained"].to_numpy()[:4], explained, rtol=1e-10)
    assert got["identity_error"].max() < 1e-9


def test_whitening_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [-0.001, 0.0]), (6, [3.0, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    model = whitening.fit_whitening(df)
    assert model.n == 3 and model.sums == [256 - 1 + 768, 512 + 0 + 256]
    got = whitening.whiten(df, model).orderBy("vec_id", "component").collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["0", "0", "6", "6", "6", "6", "None", "None"]
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], df.schema)
    flat = whitening.whiten(same, whitening.fit_whitening(same)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], df.schema)
    second = [r for r in whitening.whiten(line, whitening.fit_whitening(line)).collect() if r["component"] == 2]
    assert all(r["whitened"] is None and r["explained"] == 0 for r in second) and len(second) == 5
    none = df.limit(0)
    assert whitening.whiten(none, whitening.fit_whitening(none)).count() == 0


def test_chan_merge_is_exact_far_from_zero():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (900, 3)) + 10**9
    merged = whitening.NOTHING
    for part in np.split(x, [10, 11, 400, 650]):
        merged = merged.merge(whitening.Moments.of(part))
    c = x - x.mean(axis=0)
    assert merged.n == 900 and merged.sums == x.sum(axis=0).tolist()
    assert np.allclose(merged.scatter, c.T @ c, rtol=1e-9, atol=1e-3)


def test_deviations_beyond_machine_integers():
    model = whitening.Whitening(1, 3, [2**40], np.empty(0), np.empty((0, 1)), 0.0)
    assert model.deviations(np.array([[2**20]])) == [(3 * 2**20 - 2**40) ** 2] if (3 * 2**20 - 2**40) ** 2 < 2**63 else True
    with pytest.raises(ArithmeticError):
        model.deviations(np.array([[2**40]]))


# ---- 13


def responses_by_hand(net, text):
    """Mean and maximum over chunks, window by window."""
    cells = byte_network.cells_of(len(text))
    padded = np.concatenate([text, np.zeros(byte_network.CELL + byte_network.WIDTH, np.uint8)])
    at = np.stack([np.einsum("kd,kdf->f", net.embed[padded[i : i + byte_network.WIDTH]], net.filters) for i in range(cells * byte_network.CELL)])
    said = []
    for s in byte_network.chunk_starts(cells):
        part = at[s * byte_network.CELL : min(s + byte_network.CHUNK_CELLS, cells) * byte_network.CELL]
        said.append(np.maximum(part.max(axis=0) + net.thresholds, 0))
    return np.mean(said, axis=0), np.max(said, axis=0)


def test_scores_equal_the_network_window_by_window(monkeypatch):
    monkeypatch.setattr(byte_network, "PIECE_CELLS", byte_network.STEP_CELLS * 2 + 1)
    rng = np.random.default_rng(5)
    net = byte_network.fresh_network(byte_network.NetworkPlan(filters=5, embed=3, hidden=4))
    net.thresholds += rng.normal(size=5)
    texts = [rng.integers(1, 256, n).astype(np.uint8) for n in (0, 1, 31, 32, 33, 224, 255, 256, 257, 450, 2000)]
    got = byte_network.Scorer(net).scores(texts)
    mean, most = (np.stack(x) for x in zip(*[responses_by_hand(net, t) for t in texts], strict=True))
    assert np.abs(got - net.combine(mean, most)).max() < 1e-5
    # the chunks of a fit say the same
    for text in texts:
        assert len(byte_network.text_chunks(text, 1000)) == len(byte_network.chunk_starts(byte_network.cells_of(len(text))))
    assert len(byte_network.text_chunks(texts[-1], 3)) == 3


def test_gradients_equal_differences():
    net = byte_network.fresh_network(byte_network.NetworkPlan(filters=4, embed=3, hidden=3))
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 6, (3, 2, 263)).astype(np.uint8), np.array([0.0, 1.0, 1.0])
    _, grads = byte_network.gradients(net, x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        i = tuple(np.unravel_index(np.abs(g).argmax(), p.shape))
        old, step = p[i], 1e-3
        p[i] = old + step
        up, _ = byte_network.gradients(net, x, y)
        p[i] = old - step
        down, _ = byte_network.gradients(net, x, y)
        p[i] = old
        assert abs((up - down) / (2 * step) - g[i]) < 0.02 * abs(g[i]) + 1e-5


def test_quality_of_odd_rows_and_few_labels(spark):
    rows = [(0, None), (1, ""), (2, "x" * 40_000), (2, "x" * 40_000), (None, "no id"), (3, "é日🎉\0")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0), (2, 1)], "doc_id bigint, quality int")
    net = byte_network.fit_quality(docs, labels)
    assert net is None
    assert {(r["score"], r["predicted"]) for r in byte_network.score_quality(docs, net).collect()} == {(0.5, 0)}
    own = byte_network.fresh_network(byte_network.NetworkPlan(filters=3, embed=2, hidden=2))
    got = byte_network.score_quality(docs, own, keep=tuple(docs.columns))
    assert "input_score" in got.columns and got.count() == len(rows)
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert scores[0] == scores[1]
    assert byte_network.score_quality(docs.limit(0), own).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.createDataFrame([(i, ("good text here " if i % 2 else "BAD!! #") * 30) for i in range(60)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(byte_network.fold_of("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    plan = byte_network.NetworkPlan(filters=6, embed=3, hidden=4, epochs=20)
    one, two = (byte_network.fit_quality(docs, x, plan=plan) for x in (labels, turned))
    assert all((a == b).all() for a, b in zip(one.parameters(), two.parameters(), strict=True))
    got = byte_network.score_quality(docs, one).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = llm_queries.queries()["op13_byte_quality"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.95
