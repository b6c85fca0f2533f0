import random

import pytest

from caseweave.llm import jaccard_join as j
from caseweave.llm.components import components


def plain(rows, k, num, den):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(doc, []).append(grams)
    parent = {d: d for d in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = [d for d in sets if d is not None]
    for a in ids:
        for b in ids:
            if b > a and any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in sets}


def corpus(seed, copies=12):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [random.choices(vocabulary, k=30) for _ in range(3)]
    rows = []
    for _ in range(30):
        base = random.choices(vocabulary, k=random.choice([2, 5, 20, 60, 150]))
        base += random.choice(passages) if random.random() < 0.5 else []
        for _ in range(random.choice([1, 1, 2, 3, copies])):
            text = base[:]
            for _ in range(random.choice([0, 1, 2, 3, 5])):
                text[random.randrange(len(text))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("k,num,den,tile,short", [(3, 9, 10, 200, 8), (5, 4, 5, 200, 8), (3, 4, 5, 4, 3)])
def test_components_equal_brute_force(docs_of, monkeypatch, k, num, den, tile, short):
    """The last case forces tiles in both rounds and lists that are not counted pair by pair."""
    monkeypatch.setattr(j, "TILE", tile)
    monkeypatch.setattr(j, "SHORT", short)
    rows = corpus(k + tile, copies=25)
    rows += [(3, rows[40][1]), (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a\tB"), (905, "w " * 20_000), (905, "w " * 20_000)]
    got = {r.doc_id: r.component_id for r in j.join(docs_of(rows), k=k, num=num, den=den).collect()}
    assert got == plain(rows, k, num, den)


def test_null_ids_link_with_nothing(docs_of):
    got = j.join(docs_of([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(["(None, None)", "(1, 1)", "(2, 1)"])


def test_short_lists_are_sure_to_meet():
    """Partners at the threshold share at least the promised number of grams in their short lists."""
    random.seed(9)
    for _ in range(300):
        n = random.choice([random.randint(1, 60), random.randint(60, 990)])
        a = random.sample(range(1000), n)
        b = set(a)
        while len(b & set(a)) * 5 > 4 * len(b | set(a)):
            b.discard(random.choice(list(b & set(a)))) if random.random() < 0.5 else b.add(random.randrange(1000, 9000))
        if len(b & set(a)) * 5 < 4 * len(b | set(a)):
            continue
        sure, firsts = [], []
        for x in (sorted(a), sorted(b)):
            t = j.least_overlap(len(x), 4, 5)
            sure.append(j.sure_meetings(len(x), 4, 5))
            firsts.append(set(x[: len(x) - t + sure[-1]]))
        assert len(firsts[0] & firsts[1]) >= min(sure)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1200)] + [(5, 5), (None, 3), (9, None), (2, 1), (1, 2)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(1000, 1200)]} | {1: 1, 2: 1}


def test_empty_table(docs_of):
    assert j.join(docs_of([])).collect() == []
