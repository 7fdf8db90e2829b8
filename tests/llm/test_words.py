import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.words import mix, ngram_hashes, shingle_sets, words_of

TEXT = st.text(alphabet="aAbÄ \x1c \t\n\x0b\x0c\r", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.booleans())
def test_words_are_those_of_a_plain_split(texts, lower):
    found = words_of(pa.array(texts, pa.string()), lower)
    plain = [((t or "").encode().lower() if lower else (t or "").encode()).split() for t in texts]
    assert [[found.word(i) for i in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:])] == plain
    flat = [w for ws in plain for w in ws]
    assert len({*zip(flat, found.hash.tolist())}) == len(set(flat)) == len(set(found.hash.tolist()))


def test_hashes_do_not_depend_on_neighbours():
    one, two = words_of(pa.array(["alpha beta"]), False), words_of(pa.chunked_array([["x"], ["  beta gamma alpha"]]), False)
    assert one.hash[1] == two.hash[1] and one.hash[0] == two.hash[3]


def test_ngram_hashes_equal_a_plain_polynomial():
    values = np.random.default_rng(1).integers(0, 2**64, 90, dtype=np.uint64)
    step = 0xD6E8FEB86659FD93 | 1
    for n in (1, 2, 3, 5, 8, 35, 90, 91):
        plain = []
        for i in range(len(values) - n + 1):
            total = 0
            for v in values[i : i + n].tolist():
                total = (total * step + v) % 2**64
            plain.append(total)
        assert ngram_hashes(values, n).tolist() == mix(np.array(plain, np.uint64)).tolist()


def test_shingle_sets_count_distinct_runs():
    texts = ["a b c d e f", "a b c d e a b c d e", "a b", "A  b", "", None]
    sets = shingle_sets(words_of(pa.array(texts), True))
    assert np.diff(sets.first).tolist() == [2, 5, 1, 1, 0, 0]
    assert sets.hash[sets.first[2]] == sets.hash[sets.first[3]]


def test_chosen_words_with_spaces_between():
    found = words_of(pa.array(["ab  c", None, "é d"]), lower=False)
    text, edges = found.spaced(np.array([3, 0, 2]))
    assert text.tobytes() == "d ab é ".encode() and edges.tolist() == [0, 2, 5, 8]
    text, edges = found.spaced(np.zeros(0, np.int64))
    assert len(text) == 0 and edges.tolist() == [0]
