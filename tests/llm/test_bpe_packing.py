import random

import numpy as np
import pytest

from scholia.llm.bpe import BpeEncoder, default_pattern, default_tokenizer_path, encode_corpus
from scholia.llm.packing import pack_histogram, pack_items

TEXTS = ["", None, " ", "Hello world", "<|endoftext|> is text", "naïve — façade…", "中文" * 700, "a" * 3000, "\n\n\t x", "١٢٣ 🔬📈", " " * 900 + "y", "don't we'll", "x​y"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(texts):
    offsets, flat = BpeEncoder(default_tokenizer_path(), default_pattern()).encode(texts)
    return [flat[offsets[k] : offsets[k + 1]].tolist() for k in range(len(texts))]


def test_ids_equal_the_public_library(reference):
    assert encoded(TEXTS) == reference(TEXTS)


def test_random_strings_equal_the_public_library(reference):
    rng = random.Random(5)
    alphabet = "ab cdeé\n\t  0189中🔬'stm.,<|>​́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 700))) for _ in range(300)]
    texts += ["".join(rng.choice("abcde") for _ in range(n)) for n in (511, 512, 513, 2000)]
    assert encoded(texts) == reference(texts)


def test_corpus_column(spark):
    rows = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Hello world", "k"), (3, "Hello world", "k")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in encode_corpus(rows).collect())
    assert got[:2] == [(1, ()), (2, ())] and got[2] == got[3] and len(got[2][1]) == 2
    assert encode_corpus(rows.limit(0)).count() == 0


def check_packing(sizes, capacity, families):
    used = {}
    for f in families:
        assert sum(f.sizes) <= capacity
        for s in f.sizes:
            used[s] = used.get(s, 0) + f.times
    assert used == {s: n for s, n in sizes.items() if n}


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing_keeps_every_item_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    items = np.minimum(1024, rng.lognormal(4.8, 0.9, 20_000).astype(int) + 1)
    sizes = dict(zip(*(v.tolist() for v in np.unique(items, return_counts=True)), strict=True))
    families = pack_histogram(sizes, 1024)
    check_packing(sizes, 1024, families)
    assert sum(f.times for f in families) <= np.ceil(items.sum() / 1024) * 1.01 + 1
    assert len(families) < 3000  # depends on the sizes, not on the items


def test_two_items_replace_the_smallest():
    assert [f.sizes for f in pack_histogram({6: 1, 3: 1, 2: 2}, 10)][0] == (6, 2, 2)


def test_containers(spark):
    rows = [(1, 0), (2, None), (3, 2500), (4, 1024), (5, 500), (6, 500), (7, 24), (7, 24)] + [(100 + k, 300) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, n int").repartition(5)
    got = pack_items(df, "doc_id", "n", 1024).collect()
    assert len(got) == len(rows) + 2
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert max(fill.values()) <= 1024 and fill.pop(0) == 0
    assert sorted(r["size"] for r in got if r["doc_id"] == 3) == [452, 1024, 1024]
    assert {r["container"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert sorted(fill) == list(range(1, len(fill) + 1))
    assert pack_items(df.limit(0), "doc_id", "n").count() == 0
    with pytest.raises(ValueError):
        pack_items(df, "doc_id", "n", 0)
