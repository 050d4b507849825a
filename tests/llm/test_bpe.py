import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeseek.llm import bpe, token_files
from lodeseek.plans.staging import stage_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
FULL = Tokenizer.from_file(PATH)


def same(tree, texts):
    want = [FULL.encode(x, add_special_tokens=False).ids for x in texts]
    got = [np.frombuffer(x, np.int32).tolist() for x in tree.encode_batch(texts)]
    for a, b, text in zip(want, got, texts):
        assert a == b, text[:100]
    assert [tree.decode(x) for x in got] == [FULL.decode(x, skip_special_tokens=False) for x in want]


def test_classes_of_single_characters():
    tree = bpe.TreeBpe(PATH)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in (("", ""), (" ", "a"), ("x", " "), ("1", "\n"), ("'", "s "), (" !", "'ll"))]
    same(tree, texts)


@pytest.mark.parametrize("leaf", [8, 64])
def test_tree_equals_library(leaf):
    rng = random.Random(leaf)
    tree = bpe.TreeBpe(PATH, leaf=leaf, cache=50)
    for alphabet in ("ab", "aé", "the in", "0123", "!?-=", "the<|endoftext|>", "\n \t", "日本語と", "ünßaeiorst", "'srtvelmd \n!1é", "'sl ", "'re ll"):
        same(tree, ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, 7, 100, 1000, 3000)])
    words = ["international", "ization", "token", "ing", "http", "un"]
    same(tree, ["".join(rng.choice(words) for _ in range(900)), "a" * 5000, "<|endoftext|>" * 3 + "x" * 300 + "<|endoftext|>"])


def test_operator(spark):
    rows = [(1, "Hello  world", 5), (None, None, 6), (3, "", 7), (3, "z" * 50_000, 8), (3, "z" * 50_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()
    assert sorted((r.text or "", r.ids, r.decoded) for r in got) == sorted((t or "", FULL.encode(t or "", add_special_tokens=False).ids, t or "") for _, t, _ in rows)
    assert bpe.bpe_encode(docs.limit(0), PATH).count() == 0
    both = bpe.bpe_round_trip(docs, PATH)
    assert both.columns == ["doc_id", "text", "ids"]
    assert sorted((r.text, r.ids) for r in both.collect()) == sorted((r.decoded, r.ids) for r in got)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = 2**32 - 1
    data = token_files.pack(ids)
    assert (token_files.unpack(data) == ids).all()
    assert (token_files.unpack(data, 1, 2) == ids[512:1024]).all()
    wide = rng.integers(0, 2**32, n).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(wide)) == wide).all()
    assert (token_files.unpack(token_files.pack(np.full(n, 7, np.uint32))) == 7).all()


def test_files(spark):
    rows = [(5, "five five"), (None, "none"), (2, None), (2, ""), (9, "y" * 30_000)] + [(20 + i, f"text {i} " * (i % 7)) for i in range(50)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    path = stage_path(spark, "test-files")
    token_files.write_token_files(docs, PATH, path, shards=4, segment_ids=100)
    got = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    before = 0
    for (doc_id, text), r in zip(sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), got, strict=True):
        ids = [*FULL.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (doc_id, before, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    path = stage_path(spark, "test-none")
    token_files.write_token_files(docs.limit(0), PATH, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_many_short_texts_at_once():
    rng = random.Random(11)
    tree = bpe.TreeBpe(PATH)
    texts = ["".join(rng.choice("'''stmdrevl  \n\t!1éa") for _ in range(rng.randrange(12))) for _ in range(4000)]
    same(tree, texts + ["日本", "<|endoftext|>'s", "x²'s"])


def test_trees_of_real_documents():
    import pyarrow.parquet as pq

    texts = [x for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist() if x]
    tree = bpe.TreeBpe(PATH)
    same(tree, texts)
    assert tree.joins >= sum(len(x.encode()) > 2 * bpe.LEAF for x in texts) > 10


@pytest.mark.parametrize("leaf", [8, 16, 40])
def test_cuts_at_hard_places(leaf):
    rng = random.Random(leaf)
    tree = bpe.TreeBpe(PATH, leaf=leaf)
    parts = ["'ll", "'", "'re", "re", " ", "  ", "\n", "\t \n", "a", "word", "7", "2024", "!?", "é", "日本", "𝔘", "\u00a0", "\u3000", "²", "don't", "'S"]
    same(tree, ["".join(rng.choice(parts) for _ in range(n)) for n in [2, 5, 9, 20, 60, 200] * 40])
    assert tree.joins > 10_000 // leaf
