"""Byte-level BPE against the library of the rank file, and its parts against plain loops."""

import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import byte_bpe
from palimpsest.llm.byte_bpe import NONE, Encoder, PairTable, Vocabulary, decoded, default_pattern, default_ranks, encoded, op13_byte_bpe, read_ranks, vocabulary

from .helpers import edge_docs, edge_rows, empty_docs


@pytest.fixture(scope="module")
def own():
    return vocabulary(default_ranks())


@pytest.fixture(scope="module")
def library(own):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=own.ranks, special_tokens={})


def plain_merges(piece: bytes, ranks: dict) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def test_pair_table_is_a_dictionary():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (20_000, 2)), axis=0)
    table = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    held = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    ask = rng.integers(0, 320, (400, 50, 2)).astype(np.int32)
    ask[0, :, 0] = NONE
    got = table.get(ask[..., 0], ask[..., 1])
    assert got.tolist() == [[held.get((a, b), NONE) for a, b in row] for row in ask.tolist()]


def test_merges_of_an_odd_vocabulary():
    """Ranks that were never trained: longer tokens may rank before their parts, and the order of merges shows."""
    rng = random.Random(3)
    for _ in range(20):
        tokens = {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)}
        order = [*(bytes([b]) for b in range(256)), *sorted(tokens)]
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        own = Vocabulary(ranks)
        pieces = [bytes(rng.choices(b"abcd", k=rng.choice([1, 2, 3, 5, 9, 17, 40, 130, 300]))) for _ in range(60)]
        for piece, ids in zip(pieces, own.merged(pieces), strict=True):
            assert numbers(ids) == plain_merges(piece, ranks)
            assert numbers(own._long(piece)) == plain_merges(piece, ranks)


def test_ids_are_the_library_s(own, library):
    rng = random.Random(5)
    alphabets = ["abcdefghij ", "aA'sdtll  \n\t", "äöüßéñ ", "日本語中文テスト ", "\U0001f600\U0001f1e9‍️ x", "0123456789½², ", "#*$%&|<>.-_", "  　\x1c\x85 x", "".join(map(chr, range(128)))]
    texts = ["", " ", "\n\n  x", "don't we'll I'D  '", "a" * 5000, "ab" * 3000, "日本" * 700, " " * 3000 + "x", "\u0000", "<|endoftext|>"]
    texts += ["".join(rng.choices(a, k=rng.randint(0, 400))) for a in alphabets for _ in range(40)]
    texts += ["".join(chr(c) for c in range(k, k + 4096) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 4096)]
    for text, ids in zip(texts, Encoder(own, default_pattern())(texts), strict=True):
        assert numbers(ids) == library.encode_ordinary(text), text[:80]
        assert own.decode(ids) == text.encode()


def test_forgotten_matches_and_long_texts(own, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN_BYTES", 3000)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 200)
    monkeypatch.setattr(byte_bpe, "BLOCK", 16)
    rng = random.Random(7)
    encode = Encoder(own, default_pattern())
    for _ in range(5):
        texts = [" ".join("".join(rng.choices("etaoin", k=rng.randint(1, 9))) for _ in range(rng.choice([3, 20, 300]))) for _ in range(20)]
        assert [numbers(i) for i in encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert len(encode.known) < 5000


def test_refused():
    with pytest.raises(ValueError, match="bytes"):
        Vocabulary({b"a": 0})
    with pytest.raises(ValueError, match="vocabulary"):
        Vocabulary({bytes([b]): b for b in range(256)}).decode(np.array([256], "<u4").tobytes())


def test_other_ranks_and_pattern(spark, tmp_path):
    from base64 import b64encode

    tokens = [*(bytes([b]) for b in range(256)), b"ab", b"abab"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)) + b"\n")
    assert read_ranks(path.read_bytes().splitlines())[b"abab"] == 257
    rows = spark.createDataFrame([(1, "ababab c")], "id long, body string")
    out = encoded(rows, "body", str(path), r"\S+|\s+")
    assert numbers(out.first()["ids"]) == [257, 256, 32, 99]
    assert decoded(out.select("ids"), "ids", str(path)).first()["decoded"] == b"ababab c"


def test_odd_rows_and_empty_tables(spark, library):
    out = decoded(encoded(edge_docs(spark))).collect()
    assert len(out) == len(edge_rows())
    for r in out:
        assert numbers(r["ids"]) == library.encode_ordinary(r["text"] or "") and r["n_tokens"] * 4 == len(r["ids"])
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["kept"] == "yes" and r["shard"] == 3
    assert decoded(encoded(empty_docs(spark))).collect() == []
    with pytest.raises(ValueError, match="exist"):
        encoded(edge_docs(spark).withColumnRenamed("kept", "ids"))


def test_query(spark, library, tmp_path):
    edge_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(i), len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in edge_rows())
    out = op13_byte_bpe(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == want
