"""Token counts of texts that are long, or that no transition repeats in, with a small table."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import token_counts
from graphloom.llm.token_counts import Counter, Merges

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def small():
    """A counter whose table is renewed many times a text."""
    c = Counter(PATH)
    with open(PATH, encoding="utf-8") as f:
        c.merges = Merges(json.load(f)["model"], limit=3000, size=1 << 14)
    return c


def test_random_words_renew_the_table(small, library):
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=16)) for _ in range(3000))
    renewed = []
    reset = small.merges.reset
    small.merges.reset = lambda: (renewed.append(1), reset())
    assert small.count_all([text, "and a short one"]).tolist() == [library(text), library("and a short one")]
    assert len(renewed) > 3 and small.merges.used <= small.merges.size // 2


def test_one_piece_of_wide_characters(small, library):
    rnd = random.Random(4)
    text = "".join(chr(rnd.randrange(0x20000, 0x2A000)) for _ in range(8000))  # letters without any blank
    assert small.count_all([text]).tolist() == [library(text)]


def test_long_texts_are_cut_where_pieces_begin(monkeypatch, library):
    monkeypatch.setattr(token_counts, "PART_CHARS", 50)
    c, rnd = Counter(PATH), random.Random(5)
    parts = ["word", " ", "  ", "\n\n", "\t", "it's", "12", "<|endoftext|>", "é", "中文", "!!", " ", "x" * 70]
    texts = ["".join(rnd.choices(parts, k=120)) for _ in range(40)] + ["", "y" * 200, " " * 300]
    assert c.count_all(texts).tolist() == [library(t) for t in texts]
    assert all(len(list(c.segments(t))) > 5 for t in texts[:40]) and len(c.count_all([])) == 0
