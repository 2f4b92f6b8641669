"""Word hashes against plain splitting."""

from hypothesis import given, settings
from hypothesis import strategies as st

from otelframe.llm import shingles


def words(text):
    return text.encode().lower().split()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB é  \t\n\x0b\x0c\r\x1c.", max_size=40))
def test_words_are_those_of_ascii_splitting(text):
    w, h = words(text), shingles.word_hashes(text).tolist()
    assert len(w) == len(h)
    assert all((w[i] == w[j]) == (h[i] == h[j]) for i in range(len(w)) for j in range(i))
    assert h == [int(shingles.word_hashes(x.decode())[0]) for x in w]


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "".join(f"word{i} {'y' * (i % 90)}\n" for i in range(400)) + "z" * 700
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert shingles.word_hashes(text).tolist() == whole.tolist() and len(whole) == len(words(text))


def test_short_and_empty_texts():
    assert len(shingles.sequence(None)) == len(shingles.sequence(" \n")) == 0
    assert len(shingles.sequence("a b")) == 1 and len(shingles.sequence("a b c d e f")) == 2
    assert shingles.sequence("A b")[0] == shingles.sequence("a\tB ")[0] != shingles.sequence("b a")[0]
    assert len(shingles.distinct("x " * 50)) == 1
