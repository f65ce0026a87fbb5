"""Token counts and records against the library, and exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opinara.llm.records import frame, index_records, payload, read_shuffled, record_table, unframe, write_records
from opinara.llm.token_counts import Counter, count_tokens, whole_tokens
from opinara.llm.tokenizing import BYTE_BPE, WORD_BPE, Encoder, vocabulary_path
from tests.llm.helpers import AWKWARD, documents

BYTE, WORD = vocabulary_path(BYTE_BPE), vocabulary_path(WORD_BPE)
LETTERS = "abXYz 'sStTrelvdm\n\t\r.,!09é×ßÿİ’日́\x0b\x1c |<>"
texts = st.text(st.sampled_from(LETTERS) | st.characters(codec="utf-8"), max_size=60)
byte_encoder, word_counter = Encoder(BYTE), Counter(WORD, whole_tokens(WORD))
byte_library, word_library = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@given(st.lists(texts, max_size=6))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_librarys(batch):
    ids, at = byte_encoder.batch(pa.array(batch, pa.string()))
    for k, text in enumerate(batch):
        assert ids[at[k] : at[k + 1]].tolist() == byte_library.encode(text, add_special_tokens=False).ids


@given(st.lists(texts, max_size=6))
@settings(max_examples=300, deadline=None)
def test_counts_are_the_librarys(batch):
    values, at = word_counter.batch(pa.array(batch, pa.string()))
    for k, text in enumerate(batch):
        assert values[at[k] : at[k + 1]].sum() == len(word_library.encode(text, add_special_tokens=False).ids)


def test_special_strings_and_small_tables(monkeypatch):
    monkeypatch.setattr("opinara.llm.tokenizing.KEPT_PIECES", 5)
    monkeypatch.setattr("opinara.llm.tokenizing.BATCH_BYTES", 10)
    fresh = Encoder(BYTE)
    batch = ["one two three", "<|endoftext|> in <|endoftext|>", None, "<|endof", "text|>", "four five six seven"]
    ids, at = fresh.batch(pa.array(batch))
    for k, text in enumerate(batch):
        assert ids[at[k] : at[k + 1]].tolist() == byte_library.encode(text or "", add_special_tokens=False).ids


def test_one_run_beyond_the_table(monkeypatch):
    monkeypatch.setattr("opinara.llm.tokenizing.KEPT_PIECES", 5)
    fresh, counter = Encoder(BYTE), Counter(WORD, whole_tokens(WORD))
    many = " ".join(f"xq{chr(97 + i % 26)}zv{'abcd'[i % 4]}k three" for i in range(40))
    for text in ("one two three", f"one two three {many}", "three four", f"{many} four"):
        ids, at = fresh.batch(pa.array([text]))
        assert ids.tolist() == byte_library.encode(text, add_special_tokens=False).ids
        values, _ = counter.batch(pa.array([text]))
        assert values.sum() == len(word_library.encode(text, add_special_tokens=False).ids)


def test_proven_tokens_encode_alone():
    proven = whole_tokens(WORD)
    assert len(proven) > 30000
    plain = [w for w in sorted(proven) if w.isascii() and w.isalpha()]
    for word in random.Random(1).sample(plain, 500):
        assert len(word_library.encode(word, add_special_tokens=False).ids) == 1


def test_count_tokens_of_awkward_rows(spark):
    rows = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(documents(spark, AWKWARD), WORD).collect()]
    want = []
    for k, t in AWKWARD:
        n = len(word_library.encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 2048))
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert count_tokens(documents(spark, []), WORD).count() == 0


@given(st.binary(max_size=200), st.integers(-(2**63), 2**63 - 1) | st.none())
def test_frames_round_trip(data, key):
    body = payload(key, data)
    got, after = unframe(frame(body) + b"\n" + b"rest", 0)
    assert bytes(got) == body and after == len(frame(body)) + 1


@pytest.mark.parametrize("at", [0, 9, 14, 25, -2])
def test_damage_is_found(at):
    data = bytearray(frame(payload(7, b"\x01\x02" * 10)) + b"\n")
    data[at] ^= 1
    with pytest.raises(ValueError):
        unframe(bytes(data), 0)


def test_records_of_awkward_rows(spark, tmp_path):
    write_records(documents(spark, AWKWARD), f"{tmp_path}/data", BYTE, 2)
    index_records(spark, f"{tmp_path}/data", f"{tmp_path}/index")
    got = [
        (r.doc_id, r.start, r.n_tokens, r.ids_crc32)
        for r in record_table(spark, f"{tmp_path}/index").orderBy("start").collect()
    ]
    want, start = [], 0
    for k, t in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = byte_library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    shuffled = read_shuffled(spark, f"{tmp_path}/data", f"{tmp_path}/index", 3).collect()
    ids = {(r.doc_id, len(r.ids)) for r in shuffled}
    assert ids == {(k, n) for k, _, n, _ in want} and len(shuffled) == len(want)
    assert [r.doc_id for r in shuffled] != [k for k, *_ in want]


def test_a_common_key_is_dealt_to_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("opinara.llm.records.PART_BYTES", 4000, raising=False)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " * 10) for i in range(900)]
    rows += [(5, "same " * 20)] * 300 + [(-1, "long " * 3000)] * 6
    write_records(documents(spark, rows), f"{tmp_path}/data", BYTE, 2)
    index_records(spark, f"{tmp_path}/data", f"{tmp_path}/index")
    got = record_table(spark, f"{tmp_path}/index").orderBy("part", "offset").collect()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted((k is not None, k or 0) for k, _ in rows)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = [(k, zlib.crc32(np.array(byte_library.encode(t).ids + [2], "<u4").tobytes())) for k, t in rows]
    assert sorted([(r.doc_id, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    parts = {}
    for r in got:
        parts.setdefault(r.part, []).append(r)
    assert max(len(v) for v in parts.values()) < 200
    assert max(sum(r.doc_id == -1 for r in v) for v in parts.values()) <= 2


def test_no_records(spark, tmp_path):
    write_records(documents(spark, []), f"{tmp_path}/data", BYTE, 2)
    index_records(spark, f"{tmp_path}/data", f"{tmp_path}/index")
    assert record_table(spark, f"{tmp_path}/index").count() == 0
