import random

import pytest

from tagloom.llm import minhash


def _copies(rng, base, k, pool):
    w = list(base)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"p{rng.randrange(pool)}" if pool else f"e{rng.random()}"
    return w


def _components(sets, num, den):
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()} if a != b else root
    return root


def _checked(spark, monkeypatch, texts, num):
    """Components by the operator and by brute force, and the numbers of pairs whose sets were compared, one for each step."""
    made, whole = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, sets, test: made.append(pairs.count()) or whole(pairs, sets, test))
    got = {r.doc_id: r.component_id for r in minhash.near_dups(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), num).collect()}
    return got, _components({i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(texts)}, num, 100), made


def test_copies_with_changes_of_their_own_are_not_compared_in_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    # three changes and more part a copy from all others
    texts = [_copies(rng, base, (0 if not i else rng.randrange(1, 6)), 0)[rng.randrange(3) * 2 :] for i in range(500)]
    got, want, made = _checked(spark, monkeypatch, texts, 85)
    assert got == want and len({*want.values()}) > 50
    assert sum(made[1:]) <= 4 * len(texts), made


@pytest.mark.parametrize(("seed", "num", "hot"), [(1, 85, 3), (2, 80, 5)])
def test_finer_buckets_lose_no_link(spark, monkeypatch, seed, num, hot):
    rng = random.Random(seed)
    monkeypatch.setattr(minhash, "HOT", hot)
    texts = []
    for family in range(3):
        base = [f"b{rng.randrange(40 * family, 40 * family + 90)}" for i in range(rng.randrange(30, 90))]
        for _ in range(45):
            w = _copies(rng, base, rng.randrange(0, 7), rng.choice([0, 4, 12]))
            texts.append(w[rng.randrange(4) : len(w) - rng.randrange(4)] + rng.choice([[], w[:9], ["x"]]))
            base = texts[-1] if rng.random() < 0.1 else base
    got, want, _ = _checked(spark, monkeypatch, texts, num)
    assert got == want and len({*want.values()}) > 10
