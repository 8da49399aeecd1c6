import math
from collections import Counter

import numpy as np

from tarnfield.llm import brown


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def information(matrix, own):
    member = np.eye(own.max() + 1)[own]
    pairs = member.T @ matrix @ member
    return brown.entropy(pairs).sum() - brown.entropy(pairs.sum(0)).sum() - brown.entropy(pairs.sum(1)).sum()


def test_exchange_ends_where_no_single_move_gains():
    rng = np.random.default_rng(1)
    group = rng.integers(0, 3, 30)
    matrix = rng.poisson(np.where(group[:, None] == group[None], 9, 1))
    own = brown.exchange(matrix, 4, 60)
    best = information(matrix, own)
    for unit in range(1, 30):
        for to in range(1, 4):
            other = own.copy()
            other[unit] = to
            assert information(matrix, other) <= best + 1e-6
    assert own[0] == 0 and (own[1:] > 0).all()


def check(train, docs):
    model, vocabulary = brown.fit(train)
    counts = Counter(t for r in train.select("text").collect() for t in tokens(r[0]))
    assert {bytes(r[0]): r[1] for r in vocabulary.collect()} == counts
    n, v = sum(counts.values()), len(counts)
    kinds = lambda t: int(model.own[0 if t == b" " else model.units.of(t)])
    size, number = Counter(), Counter()
    for t, c in counts.items():
        size[kinds(t)] += c
        number[kinds(t)] += 1
    want = []
    for r in docs.select("doc_id", "text").collect():
        line = tokens(r[1])
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in line)
        path = [0, *map(kinds, line)]
        score = sum(model.step[a, b] for a, b in zip(path, path[1:]))
        score += sum(math.log10((counts[t] + 0.1) / (size[kinds(t)] + 0.1 * (number[kinds(t)] + 1))) for t in line)
        want.append((str(r[0]), len(line), sum(counts[t] > 0 for t in line), n, base, score))
    rows = brown.scored(docs, model, vocabulary).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in rows)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:4] == w[:4]
        assert np.allclose(g[4:], w[4:], rtol=1e-9)
    return model, got


def test_scores_match_a_plain_count(docs, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 3000)  # so that many words go the other way
    train, rest = docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0")
    model, _ = check(train, docs)
    assert np.allclose((10**model.step).sum(axis=1), 1)
    _, held = check(train, rest)
    assert sum(r[5] for r in held) > sum(r[4] for r in held)


def test_odd_rows(odd, none):
    check(odd, odd)
    check(none, odd)
    check(odd, none)


def test_gains_of_a_word_are_those_of_the_information():
    rng = np.random.default_rng(2)
    matrix = rng.poisson(rng.choice([0, 1, 9, 40], (30, 30)))
    np.fill_diagonal(matrix, rng.integers(0, 4, 30))
    matrix[-1] = matrix[:-1].sum(axis=0) + matrix[-1]  # every unit is left as often as it is entered
    for unit in range(30):
        more = matrix[:, unit].sum() - matrix[unit].sum()
        matrix[unit, 0] += max(more, 0)
        matrix[0, unit] += max(-more, 0)
    own = np.r_[0, rng.integers(1, 5, 29)]
    member = np.eye(5, dtype=np.int64)[own]
    bare = matrix - np.diag(np.diagonal(matrix))
    at, before, after = own[1:], (bare.T @ member)[1:], (bare @ member)[1:]
    gain = brown.gains(member.T @ matrix @ member, at, before, after, np.diagonal(matrix)[1:])
    for unit in range(1, 30):
        for to in range(5):
            other = own.copy()
            other[unit] = to
            want = information_of(matrix, other) - information_of(matrix, own)
            assert np.isclose(gain[unit - 1, to] - gain[unit - 1, own[unit]], want)


def information_of(matrix, own):
    member = np.eye(5)[own]
    pairs = member.T @ matrix @ member
    return brown.entropy(pairs).sum() - brown.entropy(pairs.sum(0)).sum() - brown.entropy(pairs.sum(1)).sum()


def test_words_beyond_the_core_have_classes_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 40)
    monkeypatch.setattr(brown, "CLASSES", 6)
    monkeypatch.setattr(brown, "HEAD", 45)
    monkeypatch.setattr(brown, "HELD", 20)  # so that the rows of a word come in several parts
    rng = np.random.default_rng(3)
    texts = []
    for i in range(240):
        for k in ("a", "b"):  # rare words of both kinds have the same ending, but stand among words of one kind only
            words = [f"{k}{x:02d}" for x in rng.integers(0, 20, 20)]
            texts.append(" ".join(w + f" rare{k}{i % 12}zz" if j % 5 == 2 else w for j, w in enumerate(words)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, got = check(docs, docs)
    kinds = {k: {model.own[model.units.of(f"rare{k}{i}zz".encode())] for i in range(12)} for k in ("a", "b")}
    assert not kinds["a"] & kinds["b"]
    assert model.units.of(b"unseenzz") in range(brown.CLASSES)
