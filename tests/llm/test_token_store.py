"""The store of op2's encoder: what is met again and again is encoded once."""

import random

import public_tokenizers

from strandlake.llm import token_file


def test_runs_met_again_are_not_encoded_again(monkeypatch):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    common = [word() for _ in range(100)]
    texts = [" ".join([*common, *(word() + r.choice(["", "-x", "7"]) for _ in range(50))]) for _ in range(40)]
    path = public_tokenizers.path("word_bpe_49k.json")
    asked = []
    parts, run = token_file.RunEncoder._parts, token_file.RunEncoder._run
    monkeypatch.setattr(token_file.RunEncoder, "_parts", lambda self, x: asked.extend(x) or parts(self, x))
    small, large = token_file.RunEncoder(path, 600), token_file.RunEncoder(path)
    made = []
    for t in texts:
        made += small.texts([t])
        assert len(small) + len(small.older) <= 600 + 2 * 150
    assert max(map(asked.count, common)) == 1
    assert made == large.texts(texts) == [run(large, t) for t in texts]


def test_parts_go_to_the_model_alone():
    r = random.Random(2)
    letters, marks = "abcdefghijklmnopqrstuvwxyz\u00df\u00e0\u00e9\u00f1\u00f6\u00f8\u00fc\u00ff", "!$%&*#.,;:-_()/"
    some = lambda x, n: "".join(r.choice(x) for _ in range(r.randint(1, n)))
    texts = [" ".join(some(letters, 9) + r.choice(["", some(marks, 3), some(marks, 2) + some(letters, 4)]) for _ in range(60)) for _ in range(100)]
    encoder = token_file.RunEncoder(public_tokenizers.path("word_bpe_49k.json"))
    want = [encoder._run(t) for t in texts]
    encoder.tokenizer = None  # normalising and cutting parts again took most of the time
    assert encoder.texts(texts) == want
