"""Words cut by their bytes and encoded many at a time give the library's own ids."""

import random

import pytest

pa = pytest.importorskip("pyarrow")

from trendlake.llm import queries, token_store  # noqa: E402

BITS = ["ab", "The", "don't", "'s", "x'LL", "'", "12", "7", "--", "&&&", "<|", "<|endoftext|>", "|", "é", "éou$$$", "İ", "क़", "\x1c", "\x85", " ", " ", "  ", "\n", "\t\n", "日本", "_"]


@pytest.fixture()
def encoder():
    return token_store.WordEncoder(queries.tokenizer_file("word_bpe_49k.json"))


def same(encoder, texts):
    ids, firsts = encoder.encode(pa.array(texts, pa.string()))
    want = encoder_ids(encoder, [t or "" for t in texts])
    return [ids[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:])] == want


def encoder_ids(encoder, texts):
    library = getattr(encoder.tokenizer, "of", encoder.tokenizer)
    return [w.ids for w in library.encode_batch_fast(texts, add_special_tokens=False)]


class Counting:
    def __init__(self, of):
        self.of, self.texts, self.normalizer = of, 0, of.normalizer

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.of.encode_batch_fast(texts, **more)


def test_mixed_pieces_and_empty_rows(encoder):
    rng = random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(9))) for _ in range(4000)] + [None, "", " ", " \n", "a", None]
    assert same(encoder, texts) and same(encoder, [None, ""]) and same(encoder, [])
    ids, firsts = encoder.encode(pa.array(["zz zz", " a", "b-c"]).slice(1))
    assert ids.tolist() == sum(encoder_ids(encoder, [" a", "b-c"]), []) and len(firsts) == 3


def test_new_words_are_encoded_many_at_a_time(encoder):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    words = [word() for _ in range(4000)]
    encoder.tokenizer = Counting(encoder.tokenizer)
    encoder.model = Counting(getattr(encoder, "model", encoder.tokenizer.of))
    assert same(encoder, [f"{a}-{b.title()}{k % 10}, {a}é" for k, (a, b) in enumerate(zip(words[::2], words[1::2]))])
    assert encoder.tokenizer.texts + encoder.model.texts < 100


def test_a_full_memo_keeps_the_pieces_at_hand(encoder, monkeypatch):
    monkeypatch.setattr(token_store, "MAX_MEMO", 40)
    for k in range(30):
        assert same(encoder, [f"w{chr(97 + k % 26)}{chr(97 + j)}x é{j}! {j}" for j in range(20)])
        assert len(encoder.memo) <= 100 and len(encoder.odd) <= 60
