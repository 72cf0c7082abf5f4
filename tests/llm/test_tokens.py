import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from timelore.llm import token_codes
from timelore.llm.common import fresh_path
from timelore.llm.queries import tokenizer_path


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_codes_round_trip_and_random_access(ids):
    block = token_codes.Block.encode(np.array(ids, np.uint32))
    assert block.decode().tolist() == ids
    for i in range(0, len(ids), 7):
        assert block.access(i) == ids[i]
    with pytest.raises(IndexError):
        block.access(len(ids))


@pytest.fixture(scope="module")
def coder():
    return token_codes.TextEncoder(open(tokenizer_path(), encoding="utf-8").read())


@given(st.text(max_size=200) | st.text(alphabet="aBΣσ'sdt .,!\n\u0085 　\x1c1é́ﬁİ<|>endoftx", max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library(coder, text):
    assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_library_on_every_code_point(coder):
    """Each code point after a mark and before a letter, 512 of them in a text."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 1 << 17):
        texts = [" ".join(f":{c}a" for c in every[i : i + 512]) for i in range(at, min(at + (1 << 17), len(every)), 512)]
        want = coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        got = coder.encode_many([x.encode() for x in texts])
        bad = [t for t, w, g in zip(texts, want, got, strict=True) if np.array(w.ids, "<u4").tobytes() != g]
        assert not bad, bad[0][:40]


def test_encoder_lowers_only_where_nothing_else_changes(coder):
    for text in ("J\u030cA j\u030ca", "<|ENDOFTEXT|> <|endoftext|>A", "I\u0307 \u212a K", "ÀÉ àé A\u0301 ÿ Ÿ", "x\u0085y\u00a0Z \x1cA\x1fB\x0bC\x0cD"):
        assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_codes, "KNOWN_BYTES", 600)
    coder = token_codes.TextEncoder(open(tokenizer_path(), encoding="utf-8").read())
    for text in ("one two three four", "two five six seven eight", "one nine ten"):
        assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_at_any_number(spark, hard_docs):
    path = token_codes.write_archive(hard_docs, fresh_path(spark, "t"), tokenizer_path())
    archive = token_codes.read_archive(spark, path)
    ids = [i for r in sorted(token_codes.documents_of(archive, with_ids=True).collect(), key=lambda r: r.start) for i in r.ids]
    asked = [0, 1, 5, 5, len(ids) - 1, len(ids), -1, None, *range(100, len(ids), 997)]
    got = sorted(map(tuple, token_codes.tokens_at(archive, spark.createDataFrame([(x,) for x in asked], "token long")).collect()))
    assert got == sorted((x, ids[x]) for x in asked if x is not None and 0 <= x < len(ids))


def test_other_vocabularies_use_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = token_codes.TextEncoder(open(path, encoding="utf-8").read())
    assert not coder.by_run
    assert coder.encode("Hello  world\n").tolist() == Tokenizer.from_file(str(path)).encode("Hello  world\n", add_special_tokens=False).ids


def test_archive_of_hard_documents(spark, hard_docs):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    path = token_codes.write_archive(hard_docs, fresh_path(spark, "t"), tokenizer_path())
    rows = token_codes.documents_of(token_codes.read_archive(spark, path), with_ids=True).collect()
    assert len(rows) == hard_docs.count()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    start = 0
    texts = {}
    for r in hard_docs.collect():
        texts.setdefault(r.doc_id, []).append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
    for r in rows:
        assert r.start == start and list(r.ids) in texts[r.doc_id]
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


def test_empty_archive(no_docs):
    assert token_codes.encode_and_read(no_docs, tokenizer_path()).collect() == []
