"""Token operators against the tokenizer libraries, with every odd input."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarmesh.llm import byte_encoding as B
from scholarmesh.llm import packing as P
from scholarmesh.llm import token_files as T
from scholarmesh.llm import tokens as K

WORD, BYTE, RANKS = (K.public_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def odd_texts(n=400):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèçñĀŁ" * 3 + "ABCÉÜ0123456789²½" + "  \n\t\r\x0b\xa0\x85\x1c\x01'’.,;:!?-_#$%<|>İΣσς中文🙂"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["it's DON'T we'll 'S' ''re x'y'sz", "<|endoftext|> <|startoftext|>", "é ﬁ Å", "", " ", "\n\n  a  \n b"]


def test_encoders_give_the_library_ids():
    words, bytes_ = K.word_bpe(WORD), K.byte_bpe(BYTE)
    for text in odd_texts():
        assert words.ids(text).tolist() == K.library_ids(WORD, text).tolist(), repr(text)
        assert bytes_.ids(text).tolist() == K.library_ids(BYTE, text).tolist(), repr(text)


def test_word_ids_of_real_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    words = K.word_bpe(WORD)
    for r in spark.read.parquet(path).select("text").collect():
        assert words.ids(r.text).tolist() == K.library_ids(WORD, r.text).tolist()


@pytest.mark.parametrize("percentile", [50, 90, 98, 100])
@pytest.mark.parametrize("ids", [
    [], [5], [0] * 3000, list(range(5000)), [7] * 1500 + [2**32 - 1] + [9] * 1023, [2**32 - 1, 0] * 900,
    np.random.default_rng(1).integers(0, 49408, 10_000).tolist(), np.random.default_rng(2).geometric(0.01, 4096).tolist(),
])
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, dtype=np.uint32)
    docs, lengths = ([None, -4], [len(ids) // 3, len(ids) - len(ids) // 3]) if len(ids) else ([3], [0])
    got, got_docs, got_lengths = T.decode_file(T.encode_file(ids, docs, lengths, percentile))
    assert got.tolist() == ids.tolist() and got_docs == docs and got_lengths.tolist() == lengths


def test_exceptions_keep_blocks_narrow():
    ids = np.full(1024 * 64, 3, dtype=np.uint32)
    ids[::1024] = 40_000
    assert len(T.encode_file(ids, [1], [len(ids)])) < 64 * 100


def written(spark, df, **how):
    folder = T.shared_folder(spark, "test")
    manifest = T.write_files(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), folder, WORD, **how)
    return manifest, T.read_files(spark, folder, manifest)


def test_token_files_in_order_of_documents(spark, docs_of, odd_rows):
    manifest, out = written(spark, docs_of(odd_rows), file_ids=60)
    assert len(manifest) > 2 and sum(m[2] for m in manifest) == len(odd_rows)
    at = 0
    for r, (doc, text) in zip(out.orderBy("start").collect(), sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = np.append(K.library_ids(WORD, text or ""), 1).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc, at, len(ids), ids.tobytes())
        at += len(ids)
    assert written(spark, docs_of([]))[1].count() == 0


@pytest.mark.parametrize("chunk, overlap", [(7, 3), (16, 8), (64, 32), (65536, 256)])
def test_stitched_ids_equal_whole_ids(spark, docs_of, odd_rows, chunk, overlap):
    rows = odd_rows[:6] + odd_rows[8:] + [(100 + n, t) for n, t in enumerate(odd_texts(60))] + [
        (900, "supercalifragilisticexpialidocious" * 9), (901, "ab  cd\n\n" * 40), (902, " " * 90), (903, "x" + " " * 90 + "y")]
    df = docs_of(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoder = K.rank_encoder(RANKS)
    want = sorted((d or -1, hashlib.sha256(np.array(encoder.encode_ordinary(t or ""), dtype="<u4").tobytes()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    got = B.encode(df, RANKS, chunk, overlap).select(
        F.coalesce("doc_id", F.lit(-1)), F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
    assert sorted(map(tuple, got)) == want


def test_encoding_of_nothing(spark, docs_of):
    assert B.encode(docs_of([]).select("doc_id", "text"), RANKS).count() == 0


def checked(rows, pieces):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    want = {}
    for d, t in rows:
        ids = np.append(K.library_ids(BYTE, t or ""), 0).astype("<u4")
        at = 0
        want.setdefault(d, []).append(ids)
    for d, texts in want.items():
        assert sum(p.length for p in by_doc[d]) == sum(map(len, texts))
        for p in by_doc[d]:
            assert any(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 and len(ids) == p.doc_tokens for ids in texts)
    total = padded = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= P.WINDOW
        total, padded = total + at, padded + P.WINDOW
    return total, padded


def test_packing_places_every_id_once(docs_of, odd_rows):
    rows = odd_rows + [(100 + n, "lorem ipsum dolor " * (n % 90 + 1)) for n in range(300)]
    df = docs_of(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).coalesce(1)
    total, padded = checked(rows, P.pack(df, BYTE).collect())
    assert padded - total <= 0.03 * total
    assert P.pack(docs_of([]).select("doc_id", "text"), BYTE).count() == 0


def test_differencing_is_near_equal_and_capacity_holds():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 257, 700)
        groups = P.pack_batch(sizes)
        assert sorted(n for g in groups for n in g) == list(range(700))
        assert max(sizes[g].sum() for g in groups) <= P.WINDOW
        assert len(groups) <= -(-int(sizes.sum()) // P.WINDOW) + 2
    sums = [int(sizes[g].sum()) for g in P.differencing(sizes, 50)]
    assert max(sums) - min(sums) <= 8
    assert P.differencing(np.array([8, 7, 6, 5, 4]), 2) and sorted(P.pack_batch(np.array([600, 600, 600]))) == [[0], [1], [2]]
