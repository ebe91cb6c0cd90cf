"""Pieces of the operators that need no cluster."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import langid, licenses, near_dedup, packing, quality, ragged, secrets, tokens
from graphloom.llm.bpe import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = PieceEncoder(PATH, 200)
PLAIN = Tokenizer.from_file(PATH)
texts = st.lists(st.text(st.sampled_from("ab Zé\n\t'1²!_ ü \u0085　日|<endoftx>"), max_size=30), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_pieces_equal_the_library(some):
    ids, counts = ENCODER.encode(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [PLAIN.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_another_splitting_rule_goes_to_the_library(name):
    path = public_tokenizers.path(name)
    some = ["Hello  world, 42 times!\n\tÜber  été", "", "it's <|endoftext|> 日本", "a" * 50 + " b"]
    ids, counts = PieceEncoder(path, 200).encode(some)
    plain = Tokenizer.from_file(path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in some]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é\n,\t9"), max_size=20), max_size=6))
def test_words_of_rows(some):
    data, offsets = ragged.flat_bytes(pa.array(some, pa.string()))
    starts, ends, counts = ragged.words(data, offsets, ragged.SPACED)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert found == [w for t in some for w in t.split()] and counts.tolist() == [len(t.split()) for t in some]
    hashes = ragged.word_hashes(data, starts, ends)
    lowered = [w.encode().lower() for w in found]
    assert all((a == b) == (x == y) for a, x in zip(lowered, hashes) for b, y in zip(lowered, hashes))


def test_repair_round_trip_and_random_access():
    draw = np.random.default_rng(3)
    ids = np.tile(np.repeat(draw.integers(0, 50, 400), draw.integers(1, 4, 400)), 5).astype(np.uint32)
    ends = np.unique(np.append(draw.choice(np.arange(1, len(ids)), 30, replace=False), len(ids)))
    rules, widths, body = tokens.repair(ids, ends, 50_257, rounds=4, least=4)
    assert len(body) < len(ids) / 2 and (tokens.expand(body, rules, widths, 50_257) == ids).all()
    spread = np.where(body >= 50_257, widths[np.maximum(body, 50_257) - 50_257], 1)
    assert set(ends) <= set(np.cumsum(spread))  # no rule spans two documents
    assert len(tokens.expand(body[:0], rules, widths, 50_257)) == 0
    for few in ([7], [7, 7], []):
        r, w, b = tokens.repair(np.asarray(few, np.uint32), np.asarray([len(few)] if few else [], int), 50_257)
        assert tokens.expand(b, r, w, 50_257).tolist() == few


def test_repair_ends_when_no_pair_is_frequent(monkeypatch):
    draw = np.random.default_rng(4)
    passage = draw.integers(0, 40_000, 3000)
    docs = [np.concatenate([draw.integers(0, 40_000, 20), passage, [7] * int(draw.integers(0, 40))]) for _ in range(40)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    rules, widths, body = tokens.repair(ids, ends, 50_257)
    assert (tokens.expand(body, rules, widths, 50_257) == ids).all() and len(body) < len(ids) / 50
    edges = np.searchsorted(np.cumsum(np.where(body >= 50_257, widths[np.maximum(body, 50_257) - 50_257], 1)), ends) + 1
    pairs = Counter(p for part in np.split(body, edges[:-1]) for p in zip(part[:-1].tolist(), part[1:].tolist()) if p[0] != p[1])
    assert max(pairs.values()) < 16
    monkeypatch.setattr(tokens, "SLOT_BITS", 3)  # pairs that share a slot are told apart
    assert all((a == b).all() for a, b in zip(tokens.repair(ids, ends, 50_257), (rules, widths, body)))


@pytest.mark.parametrize("top", [100, 1 << 16, (1 << 16) + 1, 70_000, 1 << 19])
def test_packed_symbols(top):
    body = np.random.default_rng(1).integers(0, top, 1003).astype(np.uint32)
    raw = tokens.packed(body, high := tokens.planes(top, 0))
    assert (tokens.unpacked(raw, len(body), high) == body).all() and len(raw) == 2 * 1003 + high * 126
    assert len(tokens.unpacked(tokens.packed(body[:0], high), 0, high)) == 0


@pytest.mark.parametrize("lengths", [[], [1024] * 3, [600] * 50 + [300] * 60 + [124] * 40, list(range(1, 1025)), [1] * 5000, [513] * 9])
def test_plan_places_every_piece(lengths):
    counts = np.bincount(lengths, minlength=1025) if lengths else np.zeros(1025, int)
    made = packing.plan(counts, 1024)
    got = np.zeros(1025, int)
    for n, content in made:
        assert sum(length * k for length, k in content) <= 1024
        for length, k in content:
            got[length] += n * k
    assert (got == counts).all()
    if lengths == list(range(1, 1025)):
        assert sum(n for n, _ in made) <= 1.005 * sum(lengths) / 1024 + 1


def test_plan_is_near_the_bound():
    draw = np.random.default_rng(8)
    lengths = np.clip(draw.lognormal(5.7, 0.9, 20_000).astype(int), 1, 1024)
    used = sum(n for n, _ in packing.plan(np.bincount(lengths, minlength=1025), 1024))
    assert used <= 1.01 * max(lengths.sum() / 1024, (lengths > 512).sum())


def test_block_links_equal_brute_force():
    draw = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    made = []
    for _ in range(60):
        words = list(base[: draw.randint(3, 60)])
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(99)}"
        made.append(" ".join(words))
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for t in made)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    want = {frozenset(j for j in range(60) if find(j) == find(i)) for i in range(60)}
    links = near_dedup.block_links(pa.array(made), 3, 85)
    parent[:] = range(60)
    for a, b in links:
        parent[find(a)] = find(b)
    assert {frozenset(j for j in range(60) if find(j) == find(i)) for i in range(60)} == want


def test_bands_estimate_jaccard():
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 1 << 62, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:])
    keys = near_dedup.min_max_bands(np.concatenate([a, b]), np.asarray([2000, 2000]), 1, 400)
    assert abs((keys[0] == keys[1]).mean() - 1 / 3) < 0.08


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_pairs_at_the_threshold_share_a_bucket(percent):
    draw, size = np.random.default_rng(percent), 300
    rows, bands = near_dedup.bands_for(percent)
    common, own = size * percent // 100, size - size * percent // 100  # |A and B| of |A or B| = size
    missed = 0
    for _ in range(10):
        pool = draw.integers(0, 1 << 62, (50, size), dtype=np.uint64)
        a, b = np.sort(pool[:, : common + own // 2], axis=1), np.sort(np.concatenate([pool[:, :common], pool[:, common + own // 2 :]], axis=1), axis=1)
        keys = [near_dedup.min_max_bands(x.ravel(), np.full(50, x.shape[1]), rows, bands) for x in (a, b)]
        missed += int((~(keys[0] == keys[1]).any(1)).sum())
    assert missed == 0


def test_codewords_differ():
    for n in (1, 2, 3, 4, 7, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n


def test_label_model_finds_the_bad():
    draw = np.random.default_rng(1)
    good = draw.random(4000) < 0.8
    votes = np.where(draw.random((4000, 5)) < 0.7, np.where(draw.random((4000, 5)) < np.where(good, 0.95, 0.15)[:, None], 1, -1), 0)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, _, prior = quality.label_model(patterns, counts.astype(float))
    assert ((posterior[where.ravel()] > 0.5) == good).mean() > 0.95 and abs(prior - good.mean()) < 0.05


def test_markov_separates_held_out_samples():
    table = secrets.log_ratios(secrets.labelled_samples())
    index = {c: i for i, c in enumerate(secrets.ALPHABET)}
    right = 0
    held = secrets.labelled_samples(500, seed=99)
    for text, label in held:
        pairs = [table[index[a] * len(index) + index[b]] for a, b in zip(text, text[1:])]
        right += (sum(pairs) / len(pairs) > 0.5) == label
    assert right / len(held) > 0.97


def test_needles_are_necessary():
    grams = [["a b", "b c", "c d"], ["x y", "y z"]]
    chosen = set(licenses.needles(grams, 0.8))
    for g in grams:
        without = [x for x in g if not chosen & set(x.split())]
        assert len(without) < len(g) * 0.8 / 1.2
