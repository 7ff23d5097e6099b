import random

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm.packing import binary_lengths
from larkspur.llm.runtime import sliced
from larkspur.llm.tokens import encode, tokenizer_json

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    rng = random.Random(3)
    alphabet = list("ab Zé\n\t  'sΣß.,!0۳  　́\u0085\x1c\x0b😀漢") + ["the", "'ll ", " \n", "<|endoftext|>", "é "]
    texts = [None, "", " ", "\n\n", "x", "été de là"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(800)]
    js = tokenizer_json(P.path(name))
    ids, n = encode(pa.array(texts, pa.string()), js, 1)
    whole = tokenizers.Tokenizer.from_file(P.path(name))
    at = 0
    for t, k in zip(texts, n):
        assert ids[at : at + k].tolist() == whole.encode(t or "", add_special_tokens=False).ids + [1], repr(t)
        at += k
    part, m = encode(pa.array(["zz"] + texts, pa.string()).slice(1), js, 1)
    assert np.array_equal(part, ids) and np.array_equal(m, n)
    assert encode(pa.array([], pa.string()), js, 1)[0].size == 0


def test_binary_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        got = binary_lengths(n, 2048)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got) and got == sorted(got, reverse=True)


def test_slices_keep_every_row_in_order():
    texts = [None if i % 5 == 0 else "é" * (i * 7 % 40) for i in range(90)] + ["y" * 500, None, ""]
    whole = pa.table({"n": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    batches = [b for at, n in ((0, 3), (3, 0), (3, 40), (43, 1), (44, 49)) for b in whole.slice(at, n).combine_chunks().to_batches()]
    for most in (1, 30, 300, 10**6):
        out = list(sliced(iter(batches), most=most))
        assert pa.Table.from_batches(out).equals(whole)
        assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= most for b in out)
    assert len(out) == 1 and list(sliced(iter([]))) == []
