import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from leaseloom.llm import bpe, range_coder
from leaseloom.llm import token_output as O

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(n):
    r = random.Random(7)
    kinds = [lambda: r.randrange(32, 127), lambda: r.randrange(0x20, 0x24F), lambda: r.randrange(0x300, 0x400), lambda: r.randrange(0x1F300, 0x1F650),
             lambda: r.randrange(0, 33), lambda: 0x3A3, lambda: 0x130, lambda: 0x2028, lambda: 0xA0, lambda: 0x1C, lambda: 0x85, lambda: 32, lambda: 10]
    return ["".join(chr(r.choice(kinds)()) for _ in range(r.randrange(60))) for _ in range(n)] + [
        "<|endoftext|>x<|startoftext|>", "a <|endoftext|> <|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "it's THEY'LL 123abc", "", "  a   b \n\n c  ", "x" * 5000]


def test_encoding_and_decoding_are_those_of_the_library():
    pairs, library = bpe.BytePairs(WORDS), Tokenizer.from_file(WORDS)
    texts = odd_texts(1500)
    ids = [np.frombuffer(pairs.encode(t), np.int32).tolist() for t in texts]
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.decoded(pa.array(ids, pa.list_(pa.int32())), WORDS).to_pylist() == [library.decode(i, skip_special_tokens=False) for i in ids]


def test_long_words_are_encoded_as_the_library_does_and_in_time():
    pairs, library = bpe.BytePairs(WORDS), Tokenizer.from_file(WORDS)
    r = random.Random(3)
    letters = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    for text in ("".join(r.choice("acgt") for _ in range(40_000)), letters[:30_000], "ab" * 5_000, "x" * 301, letters[:bpe.LONG + 1]):
        assert np.frombuffer(pairs.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    begin = time.process_time()
    pairs.encode(letters)
    assert time.process_time() - begin < 10


def test_cuts_never_part_a_token():
    pairs = bpe.BytePairs(WORDS)
    assert not pairs.inside.all() and pairs.inside[ord("t"), ord("h")]
    word = "the\U0001F600qqzjxthe".encode()
    codes = np.frombuffer(word, np.uint8)
    assert (~pairs.inside[codes[:-1], codes[1:]]).any()


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, "The cat", 5), (2, None, 6), (None, "", 7)], "insight_id bigint, detail string, token_ids int")
    rows = {r.insight_id: r for r in bpe.encode_details(df, WORDS, with_decoded=True).collect()}
    assert rows[1].decoded == "the</w> cat</w>" and rows[2].token_ids == [] and rows[None].decoded == ""
    back = {r.insight_id: r.detail for r in bpe.decode_ids(bpe.encode_details(df, WORDS), WORDS).collect()}
    assert back == {1: "the</w> cat</w>", 2: "", None: ""}


@pytest.mark.parametrize("ids", [[], [5], list(range(3000)), [7] * 5000, [70000, 1, 1 << 26] * 300, [0] * 64, [0] * 65])
def test_blocks_come_back(ids):
    ids = np.array(ids, np.int64)
    blocks, sums = range_coder.encode_blocks(ids, 64)
    assert range_coder.decode_blocks(blocks, sums, len(ids), bool((ids > 0xFFFF).any()), 64).tolist() == ids.tolist()


def test_repetitive_ids_shrink_and_damage_is_found():
    ids = np.tile(np.arange(20), 500)
    data = O.payload(ids)
    assert len(data) < len(ids) // 2 and O.payload_ids(data).tolist() == ids.tolist()
    with pytest.raises(ValueError, match="damaged"):
        O.payload_ids(data[:-9] + bytes([data[-9] ^ 255]) + data[-8:])


@pytest.mark.parametrize("page_ids", [O.PAGE_IDS, 40])
def test_files_hold_the_stream_in_order(spark, tmp_path, page_ids):
    texts = odd_texts(120)
    r = random.Random(1)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "x"), (5000, None), (5001, "a"), (5001, "b")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "insight_id bigint, detail string").selectExpr("*", "1 as lengths", "2 as part").repartition(4)
    O.write_token_files(df, str(tmp_path / "t"), BYTES, end_id=2, page_ids=page_ids)
    got = sorted(map(tuple, O.read_token_files(spark, str(tmp_path / "t")).collect()), key=lambda g: g[1])
    library, at = Tokenizer.from_file(BYTES), 0
    for g, (i, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] or "")), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert g == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)


def test_no_rows(spark, tmp_path):
    O.write_token_files(spark.createDataFrame([], "insight_id bigint, detail string"), str(tmp_path / "t"), BYTES, end_id=2)
    assert O.read_token_files(spark, str(tmp_path / "t")).collect() == []


def test_plain_pieces_reach_the_model_uncut_and_get_the_ids_of_the_library():
    encoder, library, r = O._Encoder(BYTES), Tokenizer.from_file(BYTES), random.Random(5)
    marks = ["a", "the", "é", "ñon", "ɏ", "Ω", "1", ",", ".", "...", "!", ";", "'s", "'", "\n", "\n\n", " ", "  ", "\t", "\x1c", "\xa0", "　", "—", "…", "µ", "×", "中"]
    texts = odd_texts(300) + ["".join(r.choice(marks) for _ in range(r.randrange(40))) for _ in range(3000)] + [" ", " a", "a ", "a  b", None]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<i4").tobytes() for t in texts]
    assert encoder.plain and encoder.encode(pa.array(texts)) == want == encoder.encode(pa.array(texts))
    plain = ["ever tion, más.\nAbl " + " ".join("".join(r.choice("aeinorstüß") for _ in range(9)) for _ in range(50)) + "." for _ in range(20)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<i4").tobytes() for t in plain]
    cut, encoder.tokenizer = [], type("Seen", (), {"encode_batch_fast": lambda self, t, **kw: cut.extend(t) or library.encode_batch_fast(t, **kw)})()
    assert encoder.encode(pa.array(plain)) == want and cut == ["ever"]


def test_a_vocabulary_whose_tokens_span_words_is_cut_by_its_own_rule():
    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    assert O._parts_plain(spec)
    assert not O._parts_plain(spec | {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}})
    for token in ("e,", ".Ċ", "eĠt", "Ġt"):
        spec["model"]["vocab"] = {"e": 0, token: 1}
        assert O._parts_plain(spec) == (token == "Ġt")


@pytest.mark.parametrize("lanes", [3, range_coder.SIDE_BY_SIDE])
def test_blocks_are_written_as_before(monkeypatch, lanes):
    monkeypatch.setattr(range_coder, "SIDE_BY_SIDE", lanes)
    k = np.arange(9000, dtype=np.int64)
    for ids, want in [((k * k % 977) * ((k // 700) % 3 != 1) + k % 5, "3fb4c1471eb1367a"), (k * 7919 % 50000, "3f4ba156c05305f5"), ((k * k % 131) << 18, "a1518fb554e8fd5d")]:
        blocks, sums = range_coder.encode_blocks(ids, 512)
        assert hashlib.sha256(b"".join(blocks)).hexdigest()[:16] == want
        assert (range_coder.decode_blocks(blocks, sums, len(ids), bool((ids > 0xFFFF).any()), 512) == ids).all()
