"""Operators on documents: edge cases, brute force, library round trips."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidepanel.llm import chunks, lm_scoring, minhash, packing, pieces, quality, sharding, token_counts, toxicity  # noqa: E402

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
TEXTS = [(0, None), (1, ""), (2, " \n\t "), (3, COPY), (4, COPY), (5, COPY.upper()), (6, COPY + " seventeen"), (7, "it's  two   spaces "), (8, "日本語 🎉 <0x0A> </s>\n<|endoftext|>"), (9, "long " * 5000), (9, "long " * 5000), (None, "no id")]
SCHEMA = "doc_id bigint, text string, id string, size string, lang string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash", None, 1.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


# ---- 2 and 8: pieces and counts

odd_text = st.text(alphabet=st.sampled_from(list(" ab▁\n\té日🎉.<0x>A's|endofxt")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(odd_text)
def test_agenda_equals_the_library(text):
    own, _ = pieces.codec(PIECES)
    want = own.model.encode(text)
    assert own.encode(text) == want
    assert own.decode(want) == own.model.decode(want)
    assert [int(x) for x in pieces.encode_texts([text], PIECES)[0][0].split()] == want
    assert token_counts.count_texts([text], PIECES) == [len(want)]


def odd_chunks(n, rng):
    letters = ["th", "on", "e", "A", " ", "▁", "\n", "é", "日", "🎉", "\u0378", "aaaa", "<0x0A>", "."]
    made = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(n)}
    return sorted(made | {"x" * k for k in (1, 47, 48, 49, 300)} | {"▁", " ", "\n"})


def test_short_chunks_share_one_agenda(monkeypatch):
    own, calls = pieces.PieceCodec(PIECES), []
    given = odd_chunks(3000, random.Random(2))
    one_by_one = pieces.PieceCodec.merge
    monkeypatch.setattr(pieces.PieceCodec, "merge", lambda self, symbols: calls.append(1) or one_by_one(self, symbols))
    got = own.checked(given)
    assert len(calls) == sum(len(c) > 48 for c in given) < 300
    for chunk, (ids, text) in zip(given, got, strict=True):
        want = own.model.encode(chunk)
        assert [int(x) for x in ids.split()] == want == own.encode(chunk)
        assert text.decode()[1:] == own.model.decode(want)
    assert own.checked([]) == [] and own.checked(["", "th"])[0] == (b"", b"")


def test_the_shared_agenda_takes_the_leftmost_of_equal_scores():
    own = pieces.PieceCodec(PIECES)
    for chunk in ("aaa", "aaaaa", "thethethe", "ererer", "x" * 48):
        symbols, sizes = own.merge_many([chunk, "on", chunk])
        one = own.merge(list("▁" + chunk))
        assert sizes.tolist() == [len(one), sizes[1], len(one)]
        assert [own.symbols[n] for n in symbols[: len(one)]] == one == [own.symbols[n] for n in symbols[-len(one) :]]


def test_a_difference_from_the_library_stops_the_shared_agenda(monkeypatch):
    own = pieces.PieceCodec(PIECES)
    with monkeypatch.context() as m:
        m.setattr(own, "makes", np.full_like(own.makes, own.makes[-1]))  # no pair is a piece
        with pytest.raises(ValueError, match="encoding differs"):
            own.checked(["nation", "with"])
    number = int(own.merge_many(["with"])[0][0])
    own.said[number] = own.said[number].upper()
    monkeypatch.setattr(own, "decode_raw", lambda ids: " WITH")
    with pytest.raises(ValueError, match="decoding differs"):
        own.checked(["with"])


def test_windows_of_long_texts_change_nothing(monkeypatch):
    text = "ab  cd " * 400 + "x" * 300 + " " + "▁ y " * 50
    monkeypatch.setattr(chunks, "WINDOW", 64)
    own, _ = pieces.codec(PIECES)
    assert [int(x) for x in pieces.encode_texts([text], PIECES)[0][0].split()] == own.model.encode(text)


def test_encode_documents_digests(docs, none):
    own, _ = pieces.codec(PIECES)
    for r in pieces.encode_documents(docs, PIECES, payload="digest").collect():
        text = dict(TEXTS)[r["doc_id"]] or ""
        ids = own.model.encode(text) + [own.end]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.model.decode(ids).encode()).hexdigest()
    full = pieces.encode_documents(docs.where("doc_id = 3"), PIECES).first()
    assert full["decoded"] == COPY and full["ids"][-1] == own.end
    assert pieces.encode_documents(none, PIECES).count() == 0


def test_token_counts(docs, none):
    own, _ = pieces.codec(PIECES)
    rows = token_counts.token_counts(docs, PIECES, limit=16).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = dict(TEXTS)[r["doc_id"]] or ""
        n = len(own.model.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 16)
    assert token_counts.token_counts(none, PIECES).count() == 0


# ---- 4: packing


@settings(max_examples=200, deadline=None)
@given(odd_text)
def test_ids_equal_the_library(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids if text else []
    assert packing.ids_of_texts([text], WORDS) == [struct.pack(f"<{len(want)}I", *want)]


class Counted:
    """A library object that counts what is asked of it."""

    def __init__(self, inner, calls):
        self.inner, self.calls = inner, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.inner, name)


def plain_words(n, rng):
    return sorted({"".join(rng.choice(["th", "on", "ê", "Er", "ß", "x", "ly"]) for _ in range(rng.randint(1, 6))) + rng.choice(["", ",", ".%%%", "!"]) for _ in range(n)})


def test_plain_words_go_to_the_library_many_to_a_call():
    own, calls = packing.IdCodec(WORDS), []
    words = plain_words(3000, random.Random(1))
    whole = own.tokenizer
    own.tokenizer = Counted(whole, calls)
    if hasattr(own, "merges"):
        own.merges = Counted(own.merges, calls)
    got = own.encode(words)
    assert own.simple and len(words) > 1500 and len(calls) < 20
    assert got == [own._pack(whole.encode(w, add_special_tokens=False).ids) for w in words]


def test_ids_of_odd_chunks_among_plain_ones(monkeypatch):
    own = packing.IdCodec(WORDS)
    odd = ["", "it's", "a</w>b", "x\ry", "p\u2028q", "a\x85b", "n\xa0m", "日本", "e\u0301a", "A1", "...", "ÿ,", "Straße", "<|endoftext|>", "a\nb", "İa"]
    want = [own._pack(own.tokenizer.encode(c, add_special_tokens=False).ids) for c in odd * 40]
    assert own.encode(odd * 40) == want
    assert own.encode([]) == [] and own.encode(["", "1"]) == [want[0], own._pack(own.tokenizer.encode("1").ids)]
    monkeypatch.setattr(own, "closes", np.zeros_like(own.closes))  # ends that do not fit: the whole tokenizer
    assert own.encode(odd) == want[: len(odd)]


def test_packing_is_gapless_and_complete(docs, none):
    rows = packing.pack_documents(docs, WORDS, capacity=64).collect()
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_seq.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 64
    ids = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == 3)
    joined = [i for _, part in ids for i in part]
    assert struct.pack(f"<{len(joined)}I", *joined) == packing.ids_of_texts([COPY], WORDS)[0] + struct.pack("<I", 0)
    assert sum(r["doc_id"] == 0 for r in rows) == 1  # a null text is its end id
    crc = packing.pack_documents(docs.where("doc_id = 1"), WORDS, payload="crc32").first()
    assert crc["ids_crc32"] == zlib.crc32(struct.pack("<I", 0))
    assert packing.pack_documents(none, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_never_exceeds_the_optimum(lengths):
    def fewest(rest, bins):
        if not rest:
            return len(bins)
        best = len(bins) + len(rest)
        for k in range(len(bins)):
            if bins[k] >= rest[0]:
                best = min(best, fewest(rest[1:], bins[:k] + [bins[k] - rest[0]] + bins[k + 1 :]))
        return min(best, fewest(rest[1:], bins + [20 - rest[0]]))

    sizes = np.array(sorted(lengths, reverse=True))
    optimum = fewest(sizes.tolist(), [])
    assert packing.dff_bound(sizes, 20) <= optimum <= len(packing.best_fit_decreasing(sizes, 20)[2])


def test_rounds_pack_as_well_as_one_partition(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(rng.integers(1, 1500, 3000))], "doc_id bigint, length bigint")
    used, bound = packing.corpus_bound(packing.pack(df, partition_pieces=200))
    assert bound <= used <= bound * 1.01 + 1


def test_a_certified_partition_opens_nothing():
    # four bins that are needed, none of them full: certified, so nothing is opened
    import pandas as pd

    run = packing._pack_group(10, False, 100)
    got = run(pd.DataFrame({"row": range(4), "length": [6, 6, 6, 6], "part": 0}))
    assert got["bins"].tolist() == got["bound"].tolist() == [4] * 4 and got["closed"].all()
    # best-fit decreasing takes one bin more than the bound: the emptiest are opened, but not in a last round
    gap = pd.DataFrame({"row": range(8), "length": [11, 20, 17, 8, 10, 21, 18, 15], "part": 0})
    got = packing._pack_group(60, False, 5)(gap)
    assert (got["bins"].iloc[0], got["bound"].iloc[0]) == (3, 2) and not got["closed"].all()
    assert packing._pack_group(60, True, 5)(gap)["closed"].all()


def test_pack_of_odd_lengths_and_clashing_columns(spark):
    rows = [(1, None, "a", 1), (2, 0, "b", 2), (3, 65, "c", 3), (4, 64, "d", 4), (5, 30, "e", 5), (5, 30, "e", 5), (6, -1, "f", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, length bigint, offset string, row_number int").withColumn("sequence_id", F.lit("x")).withColumn("row", F.lit(9))
    got = packing.pack(df, capacity=64)
    assert got.columns == ["doc_id", "length", "input_offset", "row_number", "input_sequence_id", "row", "sequence_id", "offset", "partition_bins", "partition_bound"]
    out = sorted((r["doc_id"], r["sequence_id"] is None, r["offset"]) for r in got.collect() if r["doc_id"] != 5)
    assert out == [(1, True, None), (2, True, None), (3, True, None), (4, False, 0), (6, True, None)]
    five = got.where("doc_id = 5").collect()
    assert five[0]["sequence_id"] == five[1]["sequence_id"] and sorted(r["offset"] for r in five) == [0, 30]


# ---- 5: sharding


def test_shards_are_even_gapless_and_keep_small_groups(spark, none):
    rows = [(i, f"text {i % 700} " * (1 + i % 7)) for i in range(2000)] + [(2000 + i, "copy " * 20) for i in range(1000)] + [(9001, None), (None, "x")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 8).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(s - mean) for s in sizes.values()) <= 0.01 * mean + 220
    for s in range(8):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert sharding.shard(none, 8).count() == 0


def test_shards_equal_a_sorted_reference(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), f"doc {rng.integers(0, 400)} " * int(rng.integers(1, 30))) for i in range(1500)] + [(None, "the same"), (None, None)] * 400 + [(5, "hot " * 30)] * 700
    frame = spark.createDataFrame([(i, t, 1, "a", 2, 3) for i, t in rows], "doc_id bigint, text string, size int, shard string, _row int, _high int").repartition(6)
    got = sharding.shard(frame, 8).withColumn("high", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert frame.columns == ["doc_id", "text", "size", "shard", "_row", "_high"]
    assert set(got[0].asDict()) == {"doc_id", "text", "input_size", "input_shard", "_row", "_high", "size", "shard", "slot", "high"}
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    # in order of shard and slot the rows are sorted by hash and id, as a plain sort has them
    ordered = [(r["high"], -(1 << 63) if r["doc_id"] is None else r["doc_id"]) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)
    total, at = sum(r["size"] for r in got), 0
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        # the cut is within the tolerance of its exact place, or of one document
        at += sum(r["size"] for r in mine)
        assert abs(at - total * (s + 1) / 8) <= 0.005 * total / 8 + max(r["size"] for r in got)


def test_rows_equal_in_text_and_id_are_spread(spark):
    frame = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = Counter(r["shard"] for r in sharding.shard(frame, 8).collect())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 8


# ---- 9: quality


def brute_quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    seen, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_equal_brute_force(spark, docs, none):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["a", "b", "c*", "the", "\n", "x\ty"], rng.integers(0, 40)))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in quality.quality_report(frame).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(rows[r["doc_id"]][1])
    edge = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    assert edge[0]["n_words"] == 0 and edge[0]["base_failed"] and not edge[0]["kept"] and edge[9]["base_failed"]
    assert quality.quality_report(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


# ---- 10: near-duplicates


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = minhash.text_words(t)
        n = min(k, len(w))
        sets.append(set(zip(*(w[j:] for j in range(n)))) if w else set())
    comp = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {rows[i][0]: (len(sets[i]), comp[i]) for i in range(len(rows))}


@pytest.mark.parametrize("few", [6, 1])
def test_components_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 400, 60)] for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(base[i % 6])
        for j in rng.integers(0, 60, rng.integers(0, 9)):
            words[j] = f"v{rng.integers(0, 400)}"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "solo"), (103, "SOLO"), (104, "a b"), (105, "a  b")]
    plan = minhash.MinHashPlan(shingle=2)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), plan).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 2, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(docs, none):
    got = minhash.near_duplicates(docs, minhash.MinHashPlan(shingle=2)).collect()
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(TEXTS) and comp[4] == comp[5] == comp[6] == 3 and comp[None] is None and comp[1] == 1
    assert minhash.near_duplicates(none).count() == 0


def brute_rows(rows, k, percent):
    """Component of each row, with rows of one id told apart by their texts."""
    alone = [(i, t) for i, (_, t) in enumerate(rows)]
    reach = {i: c for i, (_, c) in brute_components(alone, k, percent).items()}
    least: dict = {}
    for i, (own, t) in enumerate(rows):
        if own is not None and minhash.text_words(t):
            least[reach[i]] = min(least.get(reach[i], own), own)
    return [None if own is None else least[reach[i]] if minhash.text_words(t) else own for i, (own, t) in enumerate(rows)]


@pytest.mark.parametrize("few", [6, 1])
def test_repeated_ids_are_linked_by_their_own_texts(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = np.random.default_rng(11)
    base = [[f"w{x}" for x in rng.integers(0, 400, 60)] for _ in range(5)]
    rows = [(7, " ".join(base[0])), (3, " ".join(base[0])), (7, " ".join(base[1])), (9, " ".join(base[1]) + " end"), (8, " ".join(base[2])), (None, " ".join(base[0])), (7, None), (7, ""), (8, " ".join(base[2]))]
    for _ in range(60):
        words = list(base[rng.integers(0, 5)])
        for j in rng.integers(0, 60, rng.integers(0, 7)):
            words[j] = f"v{rng.integers(0, 300)}"
        rows.append((int(rng.integers(20, 40)), " ".join(words)))
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id bigint, text string, _h string, _gone string, h string").repartition(4)
    plan = minhash.MinHashPlan(shingle=2)
    want = brute_rows(rows, 2, 80)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame, plan).collect())
    sizes = [len({tuple(w[j : j + 2]) for j in range(max(len(w) - 1, 1))}) if (w := minhash.text_words(t)) else 0 for _, t in rows]
    assert got == Counter((i, n, c, i is None or i == c) for (i, _), n, c in zip(rows, sizes, want, strict=True))
    left = minhash.drop_near_duplicates(frame, plan)
    assert left.columns == frame.columns
    kept = [(i, t) for (i, t), c in zip(rows, want, strict=True) if i is None or i == c]
    named = Counter(set(r for r in kept if r[0] is not None)) + Counter(r for r in kept if r[0] is None)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == named


def test_estimate_is_corrected_for_chance():
    plan = minhash.MinHashPlan(shingle=1)
    rng = np.random.default_rng(5)
    common, own = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sig = minhash.packed_bits(minhash.minima([np.unique(common), np.unique(np.concatenate([common, own]))], plan), plan)
    ones = np.uint64(sum(1 << i for i in range(0, 64, plan.bits)))
    x = sig[0] ^ sig[1]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    equal = plan.lanes - int(np.bitwise_count(x & ones).sum())
    assert abs((equal / plan.lanes - 1 / 16) / (15 / 16) - 0.8) < 0.2


# ---- 1: language-model scores


def brute_backoff(texts, order, backoff):
    """Sums of log scores with counts of the other texts, by the definition."""
    words = [(t or "").lower().split() for t in texts]
    counts = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    every = sum(counts, Counter())
    size = sum(map(len, words))
    out = []
    for w, own in zip(words, counts, strict=True):
        other = lambda g, own=own: every[g] - own[g]
        rest, total = size - len(w), 0.0
        for i in range(len(w)):
            factor = 0.0
            for n in range(min(order, i + 1), 1, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if other(gram):
                    total += factor + math.log(other(gram) / other(gram[:-1]))
                    break
                factor += math.log(backoff)
            else:
                total += factor + math.log((other((w[i],)) + 1) / (rest + 1))
        out.append(total)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 400)
    monkeypatch.setattr(lm_scoring, "TABLE_BYTES", 300)
    draw = random.Random(order)
    texts = [" ".join(draw.choice(["a", "b", "C", "d", "e\t", "ff"]) for _ in range(draw.randrange(0, 40))) for _ in range(60)] + [None, ""]
    # rows without an id are documents of their own
    rows = [(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)]
    got = lm_scoring.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=order).collect()
    want = brute_backoff(texts, order, lm_scoring.BACKOFF)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    a = sorted(((r["doc_id"], round(r["log_score"], 6)) for r in got), key=key)
    b = sorted(((i, round(x, 6)) for (i, _), x in zip(rows, want, strict=True)), key=key)
    assert len(a) == len(b)
    for (i, x), (j, y) in zip(a, b, strict=True):
        assert i == j and abs(x - y) < 1e-5


def test_scores_of_odd_rows(docs, none):
    got = lm_scoring.backoff_scores(docs, order=3).collect()
    assert len(got) == len(TEXTS)
    zero = [r for r in got if r["doc_id"] in (0, 1, 2)]
    assert all(r["n_words"] == 0 and r["log_score"] == 0 and r["mean_log_score"] is None for r in zero)
    by = {r["doc_id"]: r["mean_log_score"] for r in got}
    assert by[3] > by[7]  # copies vouch for each other, a lone text does not
    assert lm_scoring.backoff_scores(none).count() == 0


# ---- 3: toxicity


def test_toxicity_learns_from_votes(spark, none):
    rng = np.random.default_rng(2)
    bad = ["grobix", "vilnak", "morfud"]
    rows, labels = [], []
    for i in range(900):
        words = [f"w{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10]}" for x in rng.integers(0, 100, 40)]
        toxic = i % 6 == 0
        if toxic and i % 12:
            words[3:6] = rng.choice(bad, 3)
        elif toxic:  # another language: one word of many endings
            words[7] = "zurtel" + rng.choice(["an", "ig", "os"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if i % 50 else int(not toxic)))  # some labels are wrong
    labels += [(3, 1), (6, 1), (6, 1), (None, 1), (9, None), (12, 7)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "grobix " * 50_000), (1003, "what a gr0bix and m0rfud"), (6, rows[6][1])], "doc_id bigint, text string").withColumns({"score": F.lit("clash"), "_text": F.lit(1)})
    truth = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, truth)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["predicted"] == int(i % 6 == 0) for i in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[1000]["predicted"] == 0 and got[1001]["score"] == got[1000]["score"] and got[1002]["predicted"] == 1 and got[1003]["predicted"] == 1
    civil = toxicity.keep_civil(docs, model)
    assert civil.columns == docs.columns and civil.where("score = 'clash'").count() == sum(got[i]["predicted"] == 0 for i in got)
    blank = toxicity.fit_toxicity(docs, truth.where("toxic = 0"))
    assert all(r["score"] == pytest.approx(0.25) for r in toxicity.score_toxicity(docs, blank).collect())
    assert toxicity.score_toxicity(none, model).count() == 0


def test_given_labels_do_not_reach_the_posteriors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join([f"w{'abcdefghij'[x]}" for x in rng.integers(0, 10, 20)] + (["grobix", "vilnak"][: 1 + i % 2] if i % 5 == 0 else []))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    voters = toxicity.Voters(["grobix", "vilnak"], [])
    voted = toxicity.votes_on(toxicity.text_sample(docs, id_col="doc_id", text_col="text"), voters)
    assert voted.columns == ["text", "hits"]  # nothing else is handed on, so labels may be anything
    assert voted.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(500))
    model = toxicity.learn(voted, voters, 0.2)
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(scored[i] == int(i % 5 == 0) for i in scored)
    # turning the labels of voters' texts changes no posterior once voters and prior are the same
    truth = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) AS toxic")
    monkey = pytest.MonkeyPatch()
    monkey.setattr(toxicity, "choose_voters", lambda counts, n0, n1: voters)
    turned = truth.selectExpr("doc_id", "CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 10 = 1 THEN 1 ELSE toxic END AS toxic")
    fits = [toxicity.fit_toxicity(docs, t) for t in (truth, turned)]
    monkey.undo()
    own = [fits[0].labels.says, fits[1].labels.says]
    assert np.allclose(*own, atol=0.2)  # the prior alone differs, by the share of labels


def plain_em(votes, sides, prior, rounds):
    """The label model without links, voter by voter."""
    post = []
    for row in votes:
        balance = sum(v * s for v, s in zip(row, sides))
        post.append(0.95 if balance > 0 else 0.05 if balance < 0 else prior)
    for _ in range(rounds):
        n1, says = sum(post), []
        n0 = len(post) - n1
        for j in range(len(sides)):
            share = toxicity.TRUST if sides[j] > 0 else prior / 2
            c1 = sum(p for p, row in zip(post, votes) if row[j])
            c0 = sum(1 - p for p, row in zip(post, votes) if row[j])
            said = math.log((c1 + toxicity.SMOOTH * share) / (n1 + 1e-9)) - math.log((c0 + toxicity.SMOOTH * (1 - share)) / (n0 + 1e-9))
            says.append(max(said, 0) if sides[j] > 0 else min(said, 0))
        post = [1 / (1 + math.exp(-min(30, max(-30, math.log(prior / (1 - prior)) + sum(s for s, v in zip(says, row) if v))))) for row in votes]
    return post


def test_label_model_equals_a_plain_one(monkeypatch):
    rng = np.random.default_rng(3)
    y = rng.random(300) < 0.3
    votes = np.stack([y & (rng.random(300) < 0.7), y ^ (rng.random(300) < 0.1), ~y & (rng.random(300) < 0.5), rng.random(300) < 0.2], axis=1).astype(float)
    sides = np.array([1, 1, -1, 1])
    monkeypatch.setattr(toxicity, "draw_forest", lambda counts: (np.full(4, -1), []))
    with pytest.warns(UserWarning, match="after 7 rounds"):
        model, post = toxicity.fit_label_model(votes, sides, 0.3, rounds=7)
    assert post == pytest.approx(np.array(plain_em(votes.tolist(), sides.tolist(), 0.3, 7)), abs=1e-9)
    assert ((post > 0.5) == y).mean() > 0.9
    # the accuracies that were put in, in order
    assert model.accuracy[0] > model.accuracy[1] > model.accuracy[3]


def test_correlated_voters_do_not_count_twice():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    # a weak voter, nine copies of it, and a stronger one that disagrees with it at times
    weak = np.where(y, rng.random(6000) < 0.5, rng.random(6000) < 0.1)
    strong = np.where(y, rng.random(6000) < 0.8, rng.random(6000) < 0.02)
    votes = np.stack([weak] * 10 + [strong, ~strong], axis=1).astype(float)
    sides = np.array([1] * 11 + [-1])
    counts = toxicity.pair_counts(votes, np.where(y, 0.99, 0.01))
    parent, links = toxicity.draw_forest(counts)
    assert sum(c > 0.9 for _, _, c in links) == 9 and (parent >= 0).sum() == len(links)
    model = toxicity.estimate(votes, sides, np.where(y, 0.99, 0.01), 0.2, parent, links)
    alone = toxicity.estimate(votes, sides, np.where(y, 0.99, 0.01), 0.2, np.full(12, -1), [])
    only_weak = np.array([[1.0] * 10 + [0, 1]])
    # ten votes of one mind say about as much as one
    assert model.posterior(only_weak)[0] < 0.3 < 0.99 < alone.posterior(only_weak)[0]


def test_sparse_classifier_finds_the_features_that_matter():
    rng = np.random.default_rng(7)
    rows = [np.flatnonzero(rng.random(50) < 0.2) for _ in range(800)]
    y = np.array([float(3 in r or 8 in r) for r in rows])
    w, constant = toxicity.fit_sparse_logistic(rows, y, 50, 2e-3)
    assert set(np.argsort(-w)[:2]) == {3, 8} and constant < 0 and (w == 0).sum() > 30
    assert all((constant + w[r].sum() > 0) == (t > 0.5) for r, t in zip(rows, y))
