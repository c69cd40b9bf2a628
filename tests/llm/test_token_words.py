"""The words that go to the tokenizer, against split."""

import pyarrow as pa

from pulseforge.llm import token_store as T
from pulseforge.llm.common import Interned


def test_words_are_those_of_split():
    texts = [b"One two,\tthree.", None, b"", b" \n ", b"x!! y", "Größe «да»\x0bEND".encode(), b"end,"]
    spaced, ends = T.spaced_out(texts)
    parts = [spaced[a:b].tobytes().split() for a, b in zip([0, *ends], ends, strict=False)]
    words, sizes = T.words_of(texts)
    assert words.to_pylist() == [w for p in parts for w in p] and sizes.tolist() == [len(p) for p in parts]
    assert [b"two", b","] == parts[0][1:3] and T.words_of([None])[1].tolist() == [0]


def test_numbers_of_an_array_are_those_of_a_list():
    words = [b"a", b"b", b"a", b"c"]
    one, other = (Interned(lambda _: None, lambda: None) for _ in range(2))
    assert one.numbers(words).tolist() == other.numbers(pa.array(words)).tolist() == [0, 1, 0, 2]
    Interned.release()


def test_words_of_letters_need_no_rules():
    """The model alone gives words of letters a-z the ids that the whole tokenizer gives them; a file with other rules has no such short way."""
    import json

    from tokenizers import Tokenizer

    file = T.default_tokenizer()
    words = ["a", "the", "ing", "straightforwardness", "xqzjk", "s", "ll", "haanth", "x" * 3000, "tionnted"]
    text = " ".join(words)
    bare, whole = (t.encode(text, add_special_tokens=False) for t in (T.bare_of(file), Tokenizer.from_file(file)))
    assert bare.ids == whole.ids and bare.word_ids == whole.word_ids
    with open(file, encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"] = {"type": "Lowercase"}
    assert T.bare_of_rules(rules) is False and T.bare_of_rules(json.loads(Tokenizer.from_file(file).to_str())) is True
