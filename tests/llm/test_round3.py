import random

from evidencelake.llm import packing
from evidencelake.llm.queries import tokenizer_path


def test_texts_without_paired_blanks_are_encoded_without_look_ahead(monkeypatch):
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as file:
        source = file.read()
    known, rng = Tokenizer.from_file(tokenizer_path()), random.Random(5)
    bits = ["word", "Wörter", "12", "٣", "'ll", "'", "...", " ", "\n", "\t", " ", " ", "\x1c", "\x85", "語", "<|endoftext|>", "é", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    single = [t for t in texts if not packing.PAIRED.search(t)]
    assert 500 < len(single) < 2500
    for text in texts:
        assert packing.encoded(source, text).tolist() == known.encode(text, add_special_tokens=False).ids, repr(text)
    made, coder = [], packing.coder
    monkeypatch.setattr(packing, "coder", lambda *a: made.append(a) or coder(*a))
    packing.plain.cache_clear()
    for text in single:
        packing.encoded(source, text)
    assert made == [(source, packing.PLAIN)]
    assert "(?!" not in packing.PLAIN
