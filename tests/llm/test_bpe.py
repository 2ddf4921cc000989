import random
import time

import numpy as np
import pyarrow as pa
import pytest

from roadlens.llm import bpe, token_output
from roadlens.llm.bytehash import buffer_of

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_tokenizer())


def test_encode_decode_hard_rows(spark, hard, library):
    out = bpe.decode(bpe.encode(hard)).collect()
    texts = sorted((r["text"] or "") for r in hard.collect())
    assert len(out) == len(texts) and sorted(r["decoded"] for r in out) == texts
    for r in out:
        assert list(r["ids"]) == library.encode(r["decoded"], add_special_tokens=False).ids
    assert set(out[0].asDict()) == set(hard.columns) - {"text"} | {"decoded"}


def test_empty_table(empty):
    assert bpe.encode(empty).count() == 0


def test_shared_chunks_are_joined(spark, library):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgé ,.'\n") for _ in range(rng.randint(1, 9)))
    passages = ["".join(word() + rng.choice([" ", "  ", "\n", ""]) for _ in range(600)) for _ in range(4)]
    texts = [word() + "".join(rng.choice([*passages, word() * 30]) for _ in range(4)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    assert bpe.shared_chunks(df).count() > 0
    for r in bpe.encode(df).collect():
        assert list(r["ids"]) == library.encode(texts[r["i"]], add_special_tokens=False).ids


def test_assemble_repairs_any_cut(library):
    vocab = bpe.vocabulary(bpe.default_tokenizer())
    rng = random.Random(2)
    for _ in range(200):
        raw = "".join(rng.choice(["ab", " the", "  ", "\n\n", "é", "'s", "'", "s", "123", "!?", " x", "日本", "。", "क्ष", "\u3000", "\u00ad"]) for _ in range(60)).encode()
        at = [i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80]
        cuts = [0, *sorted(rng.sample(at, 5)), len(raw)]
        pieces = [(a, b, vocab.encode(raw[a:b].decode()) if rng.random() < 0.6 else None) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert bpe.assemble(raw, pieces, vocab) == vocab.encode(raw.decode())


def test_assemble_is_linear_without_spaces():
    """Every second kilobyte of an unspaced text is known; with and without a place where every text is split."""
    vocab = bpe.vocabulary(bpe.default_tokenizer())
    rng = random.Random(4)
    for letters in ("".join(chr(0x4E00 + 11 * i) for i in range(900)) + "，。" * 30, "abcdefghijklmnop"):
        raw = "".join(rng.choice(letters) for _ in range(300_000)).encode()
        at = [i for i in range(0, len(raw), 1024)]
        at = [next(k for k in range(i, len(raw)) if raw[k] & 0xC0 != 0x80) for i in at] + [len(raw)]
        pieces = [(a, b, vocab.encode(raw[a:b].decode()) if k % 2 else None) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
        began = time.thread_time()
        want = vocab.encode(raw.decode())
        plain = time.thread_time() - began
        assert bpe.assemble(raw, pieces, vocab) == want
        assert time.thread_time() - began - plain < 4 * plain + 2


def test_same_as_library_on_unusual_characters(library):
    vocab = bpe.vocabulary(bpe.default_tokenizer())
    for c in [*range(1, 0x3000, 7), 0x1F600, 0xE000, 0x2028, 0x85, 0xA0, 0x3000]:
        text = f" a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}!"
        assert vocab.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_buffer_of_nulls_and_slices():
    data, at = buffer_of(pa.array(["x", None, "yz", ""]).slice(1))
    assert bytes(data) == b"yz" and at.tolist() == [0, 0, 2, 2]


def test_feistel_is_a_permutation():
    for n in (1, 2, 5, 64, 1000):
        got = token_output.feistel(np.arange(n), n, 9)
        assert sorted(got.tolist()) == list(range(n))
    assert token_output.feistel(np.arange(50), 50, 1).tolist() != token_output.feistel(np.arange(50), 50, 2).tolist()


def test_shards_hold_every_sequence(spark, hard, empty, library, tmp_path):
    shards = token_output.write_shards(hard, f"file://{tmp_path}/s", length=32, shard_rows=8)
    rows = token_output.read_shards(spark, shards).toPandas()
    assert rows["slot"].is_unique and (rows["byte_offset"] == rows["position"] * shards.stride).all()
    assert rows.sort_values(["shard", "position"])["slot"].is_monotonic_increasing
    got = sorted(tuple(np.frombuffer(b"".join(g.sort_values("seq")["tokens"]), np.uint16)) for _, g in rows[~rows["key"].isin([-1, 7])].groupby("key"))
    end = 50256
    want = sorted(tuple(library.encode(r["text"] or "", add_special_tokens=False).ids + [end]) for r in hard.where("doc_id is not null and doc_id <> 7").collect())
    assert got == want and (rows["key"] == 7).sum() == 2
    one = rows.iloc[3]
    with open(next((tmp_path / "s" / f"shard={one['shard']}").glob("part-*")), "rb") as f:
        f.seek(int(one["byte_offset"]) + token_output.HEAD.itemsize)
        assert f.read(2 * int(one["n_tokens"])) == one["tokens"]
    none = token_output.write_shards(empty, f"file://{tmp_path}/e")
    assert token_output.read_shards(spark, none).count() == 0
