import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quiremill.llm import backtrack_bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return B.WordBpe(f.read())


def same(library, bpe, text):
    ids = library.encode(text, add_special_tokens=False).ids
    mine = np.frombuffer(bpe.encode(text), np.int32)
    assert mine.tolist() == ids, repr(text)
    assert bpe.decode(mine).decode() == library.decode(ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(library, bpe):
    rng = random.Random(1)
    pool = "abcdeéèÀÉΣΟΔςǅİßſK \t\n\x0b\x1c\x85\xa0 　 'sStTlL123٣½!?.,<|>́̈\U0001F600日本語한글ก็ाि"
    for n in range(20000):
        text = "".join(rng.choices(pool, k=rng.randrange(15)))
        same(library, bpe, text + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext|"]) + text if n % 7 == 0 else text)


def test_joined_entries_equal_the_library(library, bpe):
    rng, entries = random.Random(2), list(library.get_vocab())
    back = {c: i for i, c in enumerate(bpe.alphabet)}
    for _ in range(20000):
        text = "".join(rng.choice(entries).replace("</w>", "") for _ in range(rng.randint(1, 5)))
        same(library, bpe, bytes(back[c] for c in text if c in back).decode("utf8", "ignore"))


def test_cache_generations(library, bpe, monkeypatch):
    monkeypatch.setattr(B, "CACHE_WORDS", 3)
    for text in ("one two three four five six seven eight", "one two, nine. ten"):
        same(library, bpe, text)


def test_rows(spark, library):
    texts = [None, "", " \n", "Hello <|endoftext|> World's", "Hello <|endoftext|> World's", "very long, " * 60000]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string")
    got = {r.doc_id: r for r in B.encode_documents(docs, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert B.encode_documents(docs.limit(0), PATH).count() == 0
