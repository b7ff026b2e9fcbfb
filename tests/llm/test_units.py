"""Units of texts in arrays: same ids as the library, each unit encoded once."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidepanel.llm import packing  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["th", "on", "E", "É", "ß", "ÿ", "À", "×", "÷", "Ā", "日", "🎉", " ", "  ", "\n", "\t", "\r", "\xa0", "\x85", " ", "\x00", "1", "'s", "'", ",", "...", "!?", "|", "<|endoftext|>", "<|", "H̱", "é", "́", "İ", "K", "</w>", "Ġ", "-"]
some_texts = st.lists(st.none() | st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=8)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@settings(max_examples=400, deadline=None)
@given(some_texts, st.sampled_from([3, 17, 1 << 20]), st.sampled_from([1, 40, 8 << 20]))
def test_units_give_the_ids_of_the_library(library, texts, window, table_bytes):
    from tidepanel.llm import units

    before, units.WINDOW_BYTES = units.WINDOW_BYTES, window
    try:
        ids, places = packing.ids_of_column(pa.array(["skipped É", None, *texts], pa.string()).slice(2), WORDS, table_bytes)
    finally:
        units.WINDOW_BYTES = before
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:], strict=False)] == want
    assert places[-1] == len(ids) and len(places) == len(texts) + 1


def test_a_word_is_encoded_once_whatever_its_case_and_signs(monkeypatch):
    asked, encode = [], packing.IdCodec.encode
    monkeypatch.setattr(packing, "_TABLES", {})
    monkeypatch.setattr(packing.IdCodec, "encode", lambda own, chunks: asked.extend(chunks) or encode(own, chunks))
    for text in ["Éreint éreint, ÉREINT!! éreint.", "éreint... Éreint,\nÉREINT:"]:
        packing.ids_of_texts([text], WORDS)
    assert sum("reint" in c.lower() for c in asked) == 1
    assert len(asked) == len(set(asked))


def test_a_small_table_takes_small_windows(monkeypatch):
    from tidepanel.llm import units

    seen, window = [], units.UnitTable.window
    monkeypatch.setattr(packing, "_TABLES", {})
    monkeypatch.setattr(units.UnitTable, "window", lambda own, data, starts: seen.append(len(data)) or window(own, data, starts))
    text = ["two words " * 60_000]
    want = packing.ids_of_texts(text, WORDS)
    assert seen == [600_000]
    assert packing.ids_of_texts(text, WORDS, 400_000) == want
    assert sum(seen[1:]) == 600_000 and max(seen[1:]) <= 100_000


def test_pieces_of_texts_in_one_batch(spark, library):
    texts = {1: None, 2: "", 3: "Over, and OVER! " * 20, 4: "one", 5: "\n", 6: "x" * 400}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    got = {"ids": {}, "crc32": {}}
    for payload in got:
        for r in packing.cut_pieces(docs, WORDS, capacity=16, payload=payload).collect():
            got[payload][r["doc_id"], r["piece"]] = (r["start"], r["length"], r[4])
    want: dict = {"ids": {}, "crc32": {}}
    for doc, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 16)):
            part = ids[at : at + 16]
            want["ids"][doc, k] = (at, len(part), part)
            want["crc32"][doc, k] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert got == want


def test_other_tokenizers_keep_their_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "_TABLES", {})
    ids, places = packing.ids_of_column(pa.array(["Two  words", None, "É, é"]), path)
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ("Two  words", "", "É, é")]
    assert not packing._TABLES[path][0].simple
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:], strict=False)] == want
    assert np.array_equal(ids, np.concatenate(want))
