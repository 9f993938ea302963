from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from groovehouse.llm import packing as K
from groovehouse.llm.queries import VOCABULARY, queries
from helpers import awkward
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tokenizer():
    return K.TextTokenizer(PATH)


def check(pieces, docs, reference):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids, at = [*reference(text or ""), 0], 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            part = np.array(ids[at:at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(part))
            at += p["length"]
        assert at == len(ids)
    used = pad = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 1024
        used, pad = used + at, pad + (0 if at & (at - 1) == 0 else 1024 - at)
    return pad / (used + pad)


def test_query_holds_every_id_once_with_little_padding(spark, reference):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check(queries()["op5_packing"](spark, SF).collect(), docs, reference) < 0.05


def test_leftovers_of_many_splits_are_merged(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(20)
    rows = K.pack_documents(docs, PATH, open_windows=4).collect()
    assert check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, reference) < 0.05
    whole = {r["sequence_id"]: r for r in K.sequences(K.pack_documents(docs, PATH)).collect()}
    assert all(4 * r["n_ids"] == len(r["ids"]) for r in whole.values())


def test_awkward_rows_and_empty_table(spark, reference):
    docs = awkward(spark, "sequence_id")
    unique = docs.dropDuplicates(["doc_id", "text"]).where("doc_id is not null")
    check(K.pack_documents(unique, PATH).collect(), {r["doc_id"]: r["text"] for r in unique.collect()}, reference)
    tokens = K.pack_documents(docs, PATH, keep_ids=False).where("start = 0")
    assert tokens.count() == docs.count()
    assert K.pack_documents(docs.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z\n\t\r .,'sd1é%²😀 　\u0085 "), max_size=20))
def test_ids_are_the_tokenizers(tokenizer, reference, text):
    raw = text.encode()
    single = K.spaced_singly(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    assert np.frombuffer(tokenizer.ids(text, bool(single)), "<u4").tolist() == reference(text)


def test_best_fit_and_the_fullest_goes():
    w = K.Windows(10, 2)
    assert w.place(6) == (0, 0, None) and w.place(7) == (1, 0, None)
    assert w.place(3) == (1, 7, None)  # the tightest
    assert w.place(5) == (2, 0, None) and w.place(9) == (3, 0, 0)  # sequence 0 is the fullest


@pytest.fixture(scope="module")
def default():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "a", " ", "  ", "\n", "b1", "é", "'s"]), max_size=8))
def test_added_tokens_in_a_text_are_the_tokenizers(tokenizer, default, parts):
    raw = "".join(parts).encode()
    single = K.spaced_singly(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    got = np.frombuffer(tokenizer.ids(raw.decode(), bool(single)), "<u4").tolist()
    assert got == default.encode(raw.decode(), add_special_tokens=False).ids


def test_an_added_token_has_its_own_id(tokenizer):
    assert np.frombuffer(tokenizer.ids("end<|endoftext|>", True), "<u4").tolist() == [437, 50256]


@pytest.mark.parametrize("space", [" ", "\t", "\n", " \n"])
def test_very_long_white_space(space, tokenizer, reference):
    for text in (space * (2_000_000 // len(space)) + "x", "x" + space * 600_000, space * 1_000_000):
        assert np.frombuffer(tokenizer.ids(text, False), "<u4").tolist() == reference(text)
