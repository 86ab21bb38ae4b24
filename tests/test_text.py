import re
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.functions.text import batch_grams, distinct_grams, folded_words, word_hashes, words
from lexigrid.operators.chunking import pack_sentences, split_sentences
from lexigrid.operators.linking import best_matching, greedy_pairs, lexical_similarity
from lexigrid.operators.minhash import murmur3, shingle_hashes, signature
from lexigrid.operators.records import graph_records, parse_answer

_RUNS = re.compile(r"[^\W_]+")


def plain_words(text):
    return [w.encode("utf-8", "replace") for w in _RUNS.findall(unicodedata.normalize("NFKC", text).lower())]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_folded_words_agree_with_the_definition(text):
    assert folded_words(text) == plain_words(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_word_hashes_of_a_batch(texts):
    hashes, bounds = word_hashes(texts)
    tokens = [plain_words(t or "") for t in texts]
    assert np.diff(bounds).tolist() == [len(t) for t in tokens]
    flat = [w for t in tokens for w in t]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_grams_do_not_cross_texts():
    hashes, bounds = word_hashes(["a b c", "d e", "a b c a b c"])
    grams, owner = batch_grams(hashes, bounds, 3)
    assert owner.tolist() == [0, 2, 2, 2, 2]
    assert grams[0] == grams[1] == grams[4]
    distinct, at = distinct_grams(hashes, bounds, 3)
    assert np.diff(at).tolist() == [1, 0, 3]


def test_words_split_at_unicode_white_space_only():
    assert words("a　b c\x1cd") == ["a", "b", "c\x1cd"]


def test_sentences_abbreviations_and_trailing_part():
    assert split_sentences('Dr. Smith met U.S. envoys. "Fine!" He left at 3.5 km. and then') == [
        "Dr. Smith met U.S. envoys.", '"Fine!"', "He left at 3.5 km.",
    ]
    assert split_sentences("") == split_sentences(None) == []


@given(st.lists(st.integers(1, 12), max_size=30), st.integers(3, 10))
def test_packing_keeps_all_sentences_in_order(sizes, most):
    sentences = [" ".join(["w"] * n) + "." for n in sizes]
    packed = pack_sentences(sentences, most)
    assert " ".join(packed) == " ".join(sentences)
    assert all(p.count(" ") < most or p in sentences for p in packed)


def test_murmur3_known_values():
    for text, value in ((b"hello", 0x248BFA47), (b"hello, world", 0x149BBB7F), (b"The quick brown fox jumps over the lazy dog", 0x2E4FF723)):
        assert int(murmur3(np.frombuffer(text, np.uint8)[None, :])[0]) == value


def test_signatures_of_short_texts_are_zero():
    assert not signature(shingle_hashes("abc")).any()
    assert signature(shingle_hashes("abcdef")).any()


def test_greedy_pairs_exact_then_contained(spark):
    side = lambda keys: spark.createDataFrame([("p", k, t) for k, t in enumerate(keys)], "id string, place int, key string")
    pairs = lambda a, b: [tuple(r)[1:] for r in greedy_pairs(side(a), side(b)).orderBy(F.desc("score")).collect()]
    assert pairs(["bank", "river bank", ""], ["river bank", "bank of"]) == [(1, 0, 2.0), (0, 1, 1 + 4 / 7)]
    assert pairs([], ["a"]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    from itertools import permutations

    score = np.random.default_rng(seed).random((n, m))
    small, large = sorted((n, m))
    turned = score if n <= m else score.T
    best = max(sum(turned[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
    assert abs(sum(score[i, j] for i, j in best_matching(score.tolist())) - best) < 1e-9


def test_lexical_similarity_ends():
    assert lexical_similarity("", "") == 1.0
    assert lexical_similarity("a", "") == 0.0


def test_records_without_strength_and_without_entities(spark):
    text = '("entity"<|>A<|>person<|>first (of two))\n**##**\n("relationship"<|>A<|>B<|>knows<|>12)##("relationship"<|>A<|>B<|>knows)\n<|COMPLETE|>'
    rows = [(0, text), (1, '("relationship"<|>A<|>B<|>x<|>2)'), (2, None)]
    found = graph_records(spark.createDataFrame(rows, "id int, t string"), "id", "t").orderBy("id").collect()
    assert [e[0] for e in found[0].entities] == ["A"]
    assert [r[3] for r in found[0].relationships] == [10.0, 1.0]
    assert found[1].entities is None
    assert found[2].entities is None


def test_answers_whole_repaired_and_lost():
    assert parse_answer('```json\n[{"a": 1}]\n```') == ("ok", ['{"a": 1}'])
    assert parse_answer('[{"a": 1}, {"a": 2}, {"a":') == ("repaired", ['{"a": 1}', '{"a": 2}'])
    assert parse_answer("[{'a': 1}]")[0] == "repaired"
    assert parse_answer("nothing here")[0] == parse_answer(None)[0] == "failed"
