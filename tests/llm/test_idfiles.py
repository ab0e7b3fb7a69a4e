import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelode.llm import idcoder, idfiles, tokens
from tracelode.llm.common import scratch
from tracelode.llm.queries import op7_token_id_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 999), max_size=400), st.integers(1, 50))
def test_round_trip(ids, copies):
    x = np.array(ids * copies, dtype=np.uint32)
    assert np.array_equal(idcoder.decode(idcoder.encode(x, 1000)), x)


@pytest.mark.parametrize("n", [0, 1, idcoder.BLOCK - 1, idcoder.BLOCK, idcoder.BLOCK + 1])
def test_block_edges_and_extremes(n):
    for x in (np.zeros(n), np.full(n, 49407), np.arange(n) % 49408, np.random.default_rng(1).integers(0, 49408, n)):
        x = x.astype(np.uint32)
        assert np.array_equal(idcoder.decode(idcoder.encode(x, 49408)), x)


def test_blocks_are_independent_and_checked():
    x = np.random.default_rng(0).zipf(1.4, 3 * idcoder.BLOCK).clip(0, 49000).astype(np.uint32)
    data = idcoder.encode(x, 49408)
    size = idcoder._HEADER.unpack_from(data)[4] + idcoder._HEADER.size
    assert np.array_equal(idcoder.decode(data[size:]), x[idcoder.BLOCK :])
    with pytest.raises(ValueError, match="checksum"):
        idcoder.decode(data[: size - 40] + bytes([data[size - 40] ^ 1]) + data[size - 39 :])
    with pytest.raises(ValueError, match="block"):
        idcoder.decode(b"????" + data[4:])
    with pytest.raises(ValueError, match="vocabulary"):
        idcoder.encode(np.array([49408], dtype=np.uint32), 49408)


@pytest.mark.parametrize("seed", range(4))
def test_wide_and_narrow_alphabets_side_by_side(seed):
    """Lanes of unlike alphabets and lengths do not disturb each other: each block decodes alone to what it does in company."""
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, k, idcoder.BLOCK) for k in (1, 2, 3000, 49408)] + [rng.zipf(1.3, idcoder.BLOCK - 7).clip(0, 49407)]
    x = np.concatenate(parts).astype(np.uint32)
    data = idcoder.encode(x, 49408)
    assert np.array_equal(idcoder.decode(data), x)
    at = 0
    for own in parts:
        size = idcoder._HEADER.unpack_from(data, at)[4] + idcoder._HEADER.size
        assert np.array_equal(idcoder.decode(data[at : at + size]), own)
        at += size


def test_any_flipped_byte_is_noticed():
    x = np.random.default_rng(3).zipf(1.4, 500).clip(0, 49000).astype(np.uint32)
    data = idcoder.encode(x, 49408)
    for at in range(len(data)):
        bad = data[:at] + bytes([data[at] ^ 0x41]) + data[at + 1 :]
        try:
            got = idcoder.decode(bad)
        except ValueError:
            continue
        assert np.array_equal(got, x), at
    for cut in range(1, len(data), 37):
        with pytest.raises(ValueError, match="block"):
            idcoder.decode(data[:-cut])


def test_words_of_every_kind_as_the_file_encodes_them():
    coder, plain = tokens.ChunkedEncoder(PATH), Tokenizer.from_file(PATH)
    assert coder.words is not None
    texts = ["", " ", "It's WE'RE 'twas don't'S x''s 12ab34 a-b_c... Émile ÿÀß ªµº ñandú ×÷ a\u0301 \u0130x İ ΑΣ σς 漢字 \x01 a\x01b x\x01", "tab\tand\x0bmore  spaces\n\nlines\r\n ", "".join(map(chr, range(1, 700))), "word" * 3000, "<|endoftext|> <|startoftext|>x"]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_latin1_texts_are_divided_at_once_and_like_the_file():
    """Words, signs and digits on either side of each other, a text with an odd one beside them, and no chunk is kept for plain ones."""
    coder, plain = tokens.ChunkedEncoder(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(3)
    signs = [*"abcXYZéßÿÀ 0159.,-\"(", "\n", "then", " of ", "  "]
    texts = ["".join(rng.choice(signs, rng.integers(0, 90))) for _ in range(400)]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not coder.cache
    odd = [texts[0], "it's", "x\x01y", "µ ª", "\u212a \u1e9e", "漢", texts[1], "", "'", "a'"]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(odd)] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_repeating_ids_take_little_room():
    x = np.tile(np.random.default_rng(0).integers(0, 49408, 200), 80).astype(np.uint32)
    assert 8 * len(idcoder.encode(x, 49408)) / len(x) < 2


def expected(pairs):
    plain, at, out = Tokenizer.from_file(PATH), 0, []
    for d, t in pairs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_query_against_plain_encoding(spark, sf, documents):
    pairs = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert sorted(tuple(r) for r in op7_token_id_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected(pairs)


def test_many_parts_and_segments(spark, documents, monkeypatch):
    monkeypatch.setattr(idfiles, "TASK_BYTES", 40_000)
    monkeypatch.setattr(idfiles, "SEGMENT_IDS", 5_000)
    path = scratch(spark, "ids")
    idfiles.write(documents, path, PATH)
    pairs = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert sorted(tuple(r) for r in idfiles.read(spark, path).collect()) == expected(pairs)
    assert spark.read.parquet(path).select("part").distinct().count() > 3


@pytest.mark.parametrize("change", ["doc_ids = transform(doc_ids, x -> x + 1)", "lengths = transform(lengths, x -> x + 1)", "blocks = unhex('')", "n_ids = n_ids - 1", "names_crc32 = 0"])
def test_damaged_files_raise(spark, documents, change):
    path, bad = scratch(spark, "ids"), scratch(spark, "ids")
    idfiles.write(documents.limit(20), path, PATH)
    name, value = change.split(" = ", 1)
    spark.read.parquet(path).withColumn(name, F.expr(value)).write.parquet(bad)
    with pytest.raises(Exception, match="segment"):
        idfiles.read(spark, bad).collect()


def test_odd_rows(spark, odd, none):
    for df, n in ((odd, odd.count()), (none, 0)):
        path = scratch(spark, "ids")
        idfiles.write(df, path, PATH)
        got = idfiles.read(spark, path).orderBy("start").collect()
        assert len(got) == n
        if n:
            assert [r["doc_id"] for r in got][:2] == [None, None] and [r["doc_id"] for r in got[2:]] == sorted(r["doc_id"] for r in got[2:])
            ends = [r["start"] + r["n_tokens"] for r in got]
            assert [r["start"] for r in got] == [0, *ends[:-1]]
            texts = sorted((t for t in expected([(r["doc_id"], r["text"]) for r in df.collect()])), key=lambda t: t[2:])
            assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == [t[2:] for t in texts]
