import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from redactory.llm import bpe, queries, text_encoder
from redactory.llm.text_encoder import TextEncoder, longest_runs

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def texts():
    rng = random.Random(5)
    some = ["", " ", "\n", "  two  spaces ", "tail \n", "a b　 c d", "it's we'll I'M they'd", "x1y22 333",
            "日本語のテキスト 。", "😀😀 é ​﻿", "<|endoftext|>", "a<|endoftext|> b <|endoftext", "\0 \0", "½ ² ٣ Ⅷ",
            "x" * 9000, " " * 9000 + "y", "ab " * 4000, "é" * 5000 + " <|endoftext|>", "\r\n\t\x0b\x0c \x85 \x1c"]
    letters = "ab AZ09'.,\n\t éß日😀 ́٣-<|>"
    return some + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


@pytest.mark.parametrize("longest_run", [4096, 3])
def test_ids_are_the_librarys(vocabulary, longest_run):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    some = texts()
    ids, ends = TextEncoder(vocabulary, longest_run).encode(pa.array(some, pa.large_string()))
    assert ids.dtype == np.int32
    for text, a, b in zip(some, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:40])


def test_ids_out_of_order_are_merged_exactly(vocabulary):
    swapped = bpe.Vocabulary(**vars(vocabulary))
    swapped.merged_ids = vocabulary.merged_ids[::-1].copy()
    encoder, some = TextEncoder(swapped), pa.array(["hello there", "", "a b"], pa.large_string())
    assert encoder.compiled is None
    for got, wanted in zip(encoder.encode(some), bpe.Encoder(swapped).encode(some)):
        assert got.tolist() == wanted.tolist()


def test_no_texts_and_slices(vocabulary):
    ids, ends = TextEncoder(vocabulary).encode(pa.array([], pa.large_string()))
    assert len(ids) == 0 and ends.tolist() == [0]
    every = pa.array(["abc def", "", "x  yz", "     ", "ab"], pa.large_string())
    assert longest_runs(every).tolist() == [3, 0, 2, 5, 2]
    assert longest_runs(every.slice(1, 3)).tolist() == [0, 2, 5]
    assert TextEncoder(vocabulary).encode(every.slice(2, 1))[0].tolist() == TextEncoder(vocabulary).encode(every.take([2]))[0].tolist()


def test_the_split_is_that_of_the_vocabulary(vocabulary):
    """The compiled encoder's pattern, and its one special token, which keeps it from looking for the empty string."""
    parts = [" ", "  ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "\0", "a", "é", "中", "1", "٣", "²",
             "́", "'s", "'S", "'", "re", "!", "﻿", "​", "\U0001f600", "\r\n", text_encoder.NO_SPECIAL]
    r = random.Random(11)
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)]
    split = regex.compile(text_encoder.SPLIT)
    assert all(split.findall(t) == bpe._SPLIT.findall(t) for t in texts)
    assert text_encoder._compiled(vocabulary).special_tokens_set == {text_encoder.NO_SPECIAL}
    array = pa.array(texts, pa.large_string())
    fast, exact = TextEncoder(vocabulary).encode(array), bpe.Encoder(vocabulary).encode(array)
    assert (fast[0] == exact[0]).all() and (fast[1] == exact[1]).all()
