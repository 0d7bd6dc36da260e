import random
import zlib

import numpy as np
import pytest

from callsieve.llm import packing
from callsieve.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, piece int, total string"
PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(frame, tokenizer, rows, capacity=2048, **options):
    got = packing.pack(frame([(d, t, 1, "x") for d, t in rows], SCHEMA), PATH, capacity=capacity, **options).collect()
    want, total = [], 0
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-total // capacity)


TEXTS = [
    None,
    "",
    " \n",
    "Hello, World's best don't you'LL see 'S",
    "á éx Été! İstanbul ΣΣ straße",
    "x y z\u0085w\x1cv ×÷ ½ 12345 a1b2",
    "<|endoftext|> a<|startoftext|>b",
    "\U0001f600\U0001f600 你好, こん!!??",
    "word..., (paren) [x] e-mail@host.tld https://a.b/c?d=e#f",
    "supercalifragilistic" * 40,
    "w" * 5000,
]


def test_words_have_the_tokenizers_ids(tokenizer):
    with open(PATH, encoding="utf-8") as file:
        words = packing.Words(file.read())
    ids, bounds = words.tokens([(t or "").encode() for t in TEXTS])
    for text, first, end in zip(TEXTS, bounds[:-1], bounds[1:]):
        assert ids[first:end].tolist() == ids_of(tokenizer, text).tolist(), text


def test_forgetting_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    with open(PATH, encoding="utf-8") as file:
        words = packing.Words(file.read())
    for text in ("one two three four", "two five", "one six!"):
        ids, _ = words.tokens([text.encode()])
        assert ids.tolist() == ids_of(tokenizer, text).tolist()


def test_few_words_are_remembered_first_those_met_again(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    with open(PATH, encoding="utf-8") as file:
        words = packing.Words(file.read())
    often = "the cat, the dog: don't!"
    for k in range(30):
        text = f"{often} " + " ".join(f"w{k}x{i}." for i in range(500 if k % 10 == 9 else 10))
        ids, bounds = words.tokens([often.encode(), b"", text.encode()])
        assert ids.tolist() == [*ids_of(tokenizer, often), 0, *ids_of(tokenizer, text)] and len(bounds) == 4
        assert len(words.numbers) <= 40 and words.used == words.lengths[: len(words.numbers)].sum()
        assert b"cat," in words.numbers
    text = " ".join(f"w{k}x{i}." for k in range(30) for i in range(10))
    assert words.tokens([text.encode()])[0].tolist() == ids_of(tokenizer, text).tolist()
    assert len(words.numbers) <= 40


def test_edge_cases(frame, tokenizer):
    rows = [*enumerate(TEXTS), (3, "again"), (None, "no id"), (None, None), (50, "many words here " * 3000)]
    check(frame, tokenizer, rows)


def test_exact_multiples_of_the_capacity(frame, tokenizer):
    used, least = check(frame, tokenizer, [(i, "the " * n) for i, n in enumerate([15, 16, 31, 32, 47])], capacity=16)
    assert used <= least + 1


def test_few_sequences(frame, tokenizer):
    draw = random.Random(1)
    rows = [(i, "the cat sat " * int(draw.paretovariate(1.1) * 3)) for i in range(1500)]
    used, least = check(frame, tokenizer, rows, capacity=256, fan_in=2)
    assert used <= least * 1.01 + 1


def test_last_round_in_several_tasks(frame, tokenizer):
    draw = random.Random(2)
    rows = [(i, "the " * draw.randrange(100)) for i in range(400)]
    used, least = check(frame, tokenizer, rows, capacity=128, last_bins=5)
    assert used <= least * 1.2


def test_best_fit_takes_the_fullest_bin_that_has_room():
    items = [(n, [(n, 0, 0, n, 0, 0)]) for n in (6, 5, 4, 3)]
    bins = packing.best_fit(items, 10)
    assert sorted(t for t, _ in bins) == [8, 10]
    assert bins[0][1] == [(6, 0, 0, 6, 0, 0), (4, 0, 0, 4, 0, 6)]


def test_empty_table(frame):
    assert packing.pack(frame([], SCHEMA), PATH).count() == 0
