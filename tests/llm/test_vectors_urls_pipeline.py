"""Nearest neighbours, URL filters, the pipeline, and the SQL of the queries that have it."""

import glob
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from tidepanel.llm import permutation_index as pi  # noqa: E402
from tidepanel.llm import queries as llm_queries  # noqa: E402
from tidepanel.llm import url_filter as uf  # noqa: E402
from tidepanel.llm.q_urls import RULES  # noqa: E402

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_search_small_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0, float("nan")]), (8, [1.0, None]), (9, [float("inf"), 1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("clash"))
    got = [tuple(r) for r in pi.search(df, df.where("vec_id in (0, 2)"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, 2.0), (2, 1, 1, 4.0), (2, 2, 3, 4.0), (2, 3, 0, 2.0)]
    assert pi.search(df.limit(0), df.limit(0)).count() == 0


def recall(spark, v, **options):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = pi.search(df, df.where("vec_id % 20 = 0"), k=20, **options).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and got["query_id"].nunique() == -(-len(v) // 20)
    hits = 0
    for q, part in got.groupby("query_id"):
        s = (v * v[q]).sum(1)
        assert part["score"].tolist() == [s[i] for i in part["vec_id"]]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(part["vec_id"]))
    return hits / (20 * got["query_id"].nunique())


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 64)).astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    # nothing is ranked exactly beyond the share; two index blocks, two query blocks
    assert recall(spark, v, least=21, share=0.15, index_block=2000, query_block=100) >= 0.9
    # lengths that differ by factors of ten
    assert recall(spark, v * np.exp(rng.normal(size=4000))[:, None], least=21, share=0.15, index_block=4000) >= 0.9


def test_partitions_stay_bounded_and_block_sizes_change_nothing(spark, monkeypatch):
    from tidepanel.llm import common, lm_scoring

    for least, most in ((uf.BLOCK_BYTES, uf.MOST_BLOCK_BYTES), (lm_scoring.BLOCK_BYTES, lm_scoring.BLOCK_BYTES)):
        for total in (0, 1, 10**9, 10**12, 10**14):
            blocks, partitions = common.block_plan(total, least, most)
            assert 1 <= partitions <= min(blocks, 10_000) and blocks * max(least, most) >= total
    rows = [(i, f"https://{'org' if i % 3 else 'www.example.org/es'}/{'a' * (i % 7)}/{i * 37 % 101}") for i in range(300)] + [(300, "https://x/" + "long" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    docs = spark.createDataFrame([(i, f"a b c{i % 9} d{i % 5} " * 6) for i in range(80)], "doc_id bigint, text string")
    got = []
    for size, most in ((1 << 30, 8192), (600, 8192), (600, 3)):
        monkeypatch.setattr(uf, "BLOCK_BYTES", size)
        monkeypatch.setattr(uf, "MOST_BLOCK_BYTES", size)
        monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", size)
        monkeypatch.setattr(common, "MOST_PARTITIONS", most)
        judged = uf.judge_urls(pages, RULES, uf.fit_urls(pages, RULES))
        got.append((sorted((r["page_id"], r["verdict"], round(r["ratio"], 9)) for r in judged.collect()), sorted((r["doc_id"], round(r["log_score"], 9)) for r in lm_scoring.backoff_scores(docs).collect())))
    assert got[0] == got[1] == got[2]


def test_a_file_holds_only_vectors_near_its_pivot():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 16))
    model = pi.choose_pivots(v[:200], 100, 8)
    order = model.order(v)
    files = pi.InvertedFiles.of(order, 100)
    assert len(files.rows) == 500 * 8
    held = {(int(r), p): int(files.places[j]) for p in range(100) for j, r in enumerate(files.rows) if files.starts[p] <= j < files.starts[p + 1]}
    assert held == {(r, int(p)): at for r in range(500) for at, p in enumerate(order[r])}
    sums = files.sums(order[3])
    assert sums.tolist() == [sum(8 - abs(order[r].tolist().index(p) - at) for at, p in enumerate(order[3].tolist()) if p in order[r]) for r in range(500)]


def test_vectors_of_unequal_length_and_other_ids(spark):
    rows = [("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0]), ("c", [4.0]), ("d", [0.0, 0.0, 5.0]), ("b", [1.0, 2.0, 3.0]), ("a", [9.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = [tuple(r) for r in pi.search(df, df.where("vec_id = 'b'"), k=4).orderBy("rank").collect()]
    assert got == [("b", 1, "d", 15.0), ("b", 2, "a", 9.0), ("b", 3, "a", 5.0), ("b", 4, "c", 4.0)]


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x#y", "x://example.org/en/19", "http://badexample.org", "http://b.com/fr/", "http://b.com/de/9", "http://c.net?q", "http://ÄB.net/ü", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("id", F.lit("clash"))
    model = uf.fit_urls(df, RULES)
    got = {r["page_id"]: r for r in uf.judge_urls(df, RULES, model).collect()}
    show = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"])
    assert show(0) == show(1) == show(2) == ("", "", None)
    assert show(3) == ("a.example.org", "/es/1", "example.org/es/") and got[3]["verdict"] == "block"
    assert show(4)[2] == "example.org/en/1" and show(5) == ("badexample.org", "", None)
    assert (got[6]["verdict"], got[7]["verdict"]) == ("allow", "block")
    assert show(8) == ("c.net", "", None) and show(9)[0] == "Äb.net" and show(10) == ("b:", "//c/d", None)
    assert uf.judge_urls(df.limit(0), RULES, model).count() == 0


def test_ratio_equals_a_model_with_plain_dictionaries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"http://s{rng.integers(9)}.com/{'fr' if i % 2 else 'de'}/{'good' if i % 2 else 'spam'}{rng.integers(99)}") for i in range(400)] + [(900, "http://x.net/good1"), (901, "http://x.net/spam1")]
    df = spark.createDataFrame(rows, "page_id int, url string")
    model = uf.fit_urls(df, RULES)
    import zlib

    grams, ctx = (Counter(), Counter()), (Counter(), Counter())
    for i, u in rows[:400]:
        if zlib.crc32(str(i).encode()) % 5:
            x = b"\x02" * uf.ORDER + u.encode()
            for t in range(uf.ORDER, len(x)):
                for k in range(uf.ORDER + 1):
                    grams[i % 2][x[t - k : t + 1]] += 1
                    ctx[i % 2][(k, x[t - k : t])] += 1

    def plain(u):
        x, total = b"\x02" * uf.ORDER + u.encode(), [0.0, 0.0]
        for side in (0, 1):
            for t in range(uf.ORDER, len(x)):
                p = 1 / 256
                for k in range(uf.ORDER + 1):
                    n = ctx[side][(k, x[t - k : t])]
                    p = (grams[side][x[t - k : t + 1]] + 2 * p) / (n + 2)
                total[side] += math.log(p)
        return (total[1] - total[0]) / len(u.encode())

    for _, u in rows[395:]:
        assert model.ratio(u) == pytest.approx(plain(u), abs=0.02)
    got = {r["page_id"]: r["verdict"] for r in uf.judge_urls(df, RULES, model).collect()}
    assert (got[900], got[901]) == ("allow", "block")


def test_ratio_is_exact_with_many_ngrams(spark):
    import zlib

    rng = np.random.default_rng(8)
    rows = [(i, f"http://s.com/{'fr' if i % 2 else 'de'}/{''.join(map(str, rng.integers(10, size=30)))}") for i in range(8000)]
    model = uf.fit_urls(spark.createDataFrame(rows, "page_id int, url string"), RULES)
    grams, ctx = (Counter(), Counter()), (Counter(), Counter())
    for i, u in rows:
        if zlib.crc32(str(i).encode()) % 5:
            x = b"\x02" * uf.ORDER + u.encode()
            for t in range(uf.ORDER, len(x)):
                for k in range(uf.ORDER + 1):
                    grams[i % 2][x[t - k : t + 1]] += 1
                    ctx[i % 2][(k, x[t - k : t])] += 1
    assert len(grams[0] | grams[1]) > 1 << 17
    # contexts that no URL has fall back to lower orders, down to none
    asked = [rows[0][1], "http://s.com/en/0123456789", "ftp://unseen.example/ÄÖ?q=zzz", "http://s.com/\U0001f600"]
    got = uf._ratios(spark.createDataFrame(list(enumerate(asked)), "id int, url string"), model, ("id",)).toPandas().set_index("id")["ratio"]
    for j, u in enumerate(asked):
        x, total = b"\x02" * uf.ORDER + u.encode(), [0.0, 0.0]
        for side in (0, 1):
            for t in range(uf.ORDER, len(x)):
                p = 1 / 256
                for k in range(uf.ORDER + 1):
                    p = (grams[side][x[t - k : t + 1]] + 2 * p) / (ctx[side][(k, x[t - k : t])] + 2)
                total[side] += math.log(p)
        assert got[j] == pytest.approx((total[1] - total[0]) / len(u.encode()), abs=1e-9)


@data
@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{f}')")
    got = llm_queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rel = con.execute(llm_queries.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == want


CONTRACT = {
    "op2_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_toxicity": "doc_id held_out score predicted",
    "op4_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_histogram_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_permutation_index": "query_id rank vec_id score",
    "op7_url_filter": "page_id host path rule verdict",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
}


@data
@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered_query_keeps_its_contract(spark, name):
    import zlib

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = llm_queries.queries()[name](spark, SF)
    assert set(CONTRACT[name].split()) <= set(got.columns)
    rows = got.collect()
    if name in ("op2_sentencepiece", "op3_toxicity", "op5_histogram_sharding", "op8_token_counts"):
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if name == "op3_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    if name == "op4_best_fit_packing":
        assert {r["doc_id"] for r in rows} == set(docs) and all(1 <= r["length"] <= 2048 for r in rows)
    if name == "op5_histogram_sharding":
        assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]].encode()) + 1, zlib.crc32(docs[r["doc_id"]].encode()), "bytes", None) for r in rows)
        assert {r["shard"] for r in rows} <= set(range(16))
    if name == "op6_permutation_index":
        v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
        by = Counter(r["query_id"] for r in rows)
        assert set(by) == {i for i in v if i % 20 == 0} and set(by.values()) == {min(20, len(v) - 1)}
        assert all(r["score"] == (v[r["query_id"]] * v[r["vec_id"]]).sum() for r in rows)
    if name == "op7_url_filter":
        assert {r["verdict"] for r in rows} <= {"allow", "block"} and len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()


@data
def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from tidepanel.llm.minhash import exact_pairs, shingle_hashes, text_words
    from tidepanel.llm.quality import quality_report

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, x, kept = docs.columns, docs, [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        x = spark.createDataFrame(stage(spark, x, SF).collect(), docs.schema)
        assert x.columns == cols
        kept.append(x.count())
    assert kept[0] > kept[1] >= kept[2] >= kept[3] > 0
    assert quality_report(x).where("not kept").count() == 0
    sets = [s for s in (shingle_hashes(text_words(r["text"]), 5) for r in x.collect()) if len(s)]
    assert len(exact_pairs(sets, 0, cp.NEAR)[0]) == 0
    packed = cp.STAGES[-1][1](spark, x, SF)
    assert packed.select("doc_id").distinct().count() == kept[3]


INTERNAL = ["_q_text", "_q_lines", "_q_n_words", "_q_counts", "row", "source_", "_text", "text_", "hits", "label", "post", "id", "words", "key", "block", "part", "f1", "sequence_id", "piece", "length", "ids"]


@pytest.mark.parametrize("place", range(4))
def test_stages_keep_columns_of_any_name(spark, tmp_path, place):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"the w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good), (2, good + " end of it"), (3, None)], "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    clashing = docs.withColumns({c: F.lit(7) for c in INTERNAL})
    name, stage = cp.STAGES[place]
    plain, got = stage(spark, docs.where("doc_id < 3"), str(tmp_path)), stage(spark, clashing.where("doc_id < 3"), str(tmp_path))
    assert sorted(r["doc_id"] for r in plain.collect()) == sorted(r["doc_id"] for r in got.collect()), name
    if place < 3:
        assert got.columns == clashing.columns
        assert all(r[c] == 7 for r in got.collect() for c in INTERNAL)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard string"
    spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    good = " ".join(f"the w{i}" for i in range(60))
    rows = [(1, good, None, None, None, "a", "b"), (1, good, None, None, None, "a", "b"), (None, good + " z", None, None, None, None, None), (2, None, "en", "s", 0, None, None), (3, "", "en", "s", 0, None, None), (4, "the long " * 20_000, "en", "s", 1, None, None)]
    for part in (rows, []):
        x = spark.createDataFrame(part, schema)
        for _, stage in cp.STAGES[:-1]:
            x = spark.createDataFrame(stage(spark, x, str(tmp_path)).collect(), x.schema)
        assert sorted(str(r["doc_id"]) for r in x.collect()) == (["1", "None"] if part else [])
        assert cp.STAGES[-1][1](spark, x, str(tmp_path)).count() == (2 if part else 0)


def test_pipeline_bounds_batches_and_tables(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    import pyarrow as pa
    import public_tokenizers
    from tidepanel.llm import packing

    def weigh(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.createDataFrame([(i, f"the word {i} " * 100) for i in range(300)], "doc_id bigint, text string").coalesce(1)
    setting, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(cp, "BATCH_BYTES", 50_000)
    try:
        packed = cp.packing_stage(spark, docs, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == 300
        assert max(r["n"] for r in docs.mapInArrow(weigh, "n long").collect()) < 100_000
    finally:
        spark.conf.set(setting, before)
    # a small table gives the same ids and stays in its bound
    path, texts = public_tokenizers.path("word_bpe_49k.json"), [[f"word{i} other{i}"] for i in range(200)]
    monkeypatch.setattr(packing, "_TABLES", {})
    want = [packing.ids_of_texts(t, path) for t in texts]
    monkeypatch.setattr(packing, "_TABLES", {})
    assert [packing.ids_of_texts(t, path, 300) for t in texts] == want
    assert packing._TABLES[path][1].held <= 300
