import random
import re

from caseweave.llm import personal_data as p

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and p.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return p.in_order(out)


def test_base_spans_equal_plain_patterns(odd_rows):
    random.seed(2)
    texts = [t or "" for _, t in odd_rows] + ["".join(random.choice("a@.1+- ()_%9b0é") for _ in range(random.randint(0, 60))) for _ in range(5000)]
    for text in texts:
        assert p.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    assert p.base_spans("a" * 200_000) == [] and p.base_spans("1" * 200_000) == [] and p.tokens_of("9" * 200_000) == [(0, 200_000)]


def corpus():
    random.seed(4)
    rows = []
    for i in range(300):
        phone = f"+1 ({random.randint(100, 999)}) 555-{random.randint(1000, 9999)}"
        mail = f"u{random.randint(10, 99)}@mail{i % 7}.example.com"
        rows.append((i, f"word {phone} word {mail} in {random.randint(1900, 2020)} for {random.randint(1, 99)} things"))
    return rows


def test_repetitions_take_the_label_of_the_full_form(docs_of):
    text = "call +1 (974) 555-3436 now, later 555-3436 again; in 1999 we had 12 things"
    rows = corpus() + [(999, text)]
    found = {r.doc_id: r for r in p.find(docs_of(rows)).collect()}
    spans = [(s.kind, text[s.start : s.stop]) for s in found[999].added]
    assert spans == [("phone", "555-3436")]
    assert sum(len(found[i].added) for i in range(300)) == 0  # years and counts are left alone


def test_number_grown_together_with_a_phone_is_recovered(docs_of):
    text = "x +1 (269) 555-3296 4539578763621486 y"
    assert p.base_spans(text) == []
    rows = corpus() + [(1000 + i, f"card 4539578763621486 and {i}") for i in range(40)] + [(999, text)]
    found = {r.doc_id: r for r in p.find(docs_of(rows)).collect()}
    assert ("phone", "+1 (269) 555-3296") in [(s.kind, text[s.start : s.stop]) for s in found[999].added]


def test_messages_agree_with_enumeration_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    field = p.Field({s: rng.normal(size=5) for s in "abc"}, {"": np.zeros(5)}, rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    field.chain, field.skip = field.chain + field.chain.T, field.skip + field.skip.T
    graph = p.Graph([(0, 1)] * 3, ["a", "b", "c"], [(0, 1)], [(1, 2)], [0, 0, 0])
    exact = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        w = np.exp(sum(field.node[s][k] for s, k in zip("abc", y)) + field.chain[y[0], y[1]] + field.skip[y[1], y[2]])
        for i, k in enumerate(y):
            exact[i, k] += w
    assert np.allclose(p.beliefs(graph, field, rounds=40), exact / exact.sum(axis=1, keepdims=True), atol=1e-6)


def test_many_repeats_have_as_many_edges():
    text = "555-3436 x " * 2000
    graph = p.graph_of(text, p.base_spans(text))
    assert len(graph.skip) + len(graph.chain) < 2 * len(graph.tokens)


def test_odd_rows_and_empty_table(docs_of, odd_rows):
    assert p.find(docs_of(odd_rows)).count() == len(odd_rows)
    assert p.find(docs_of([])).collect() == []
    assert p.masked("a b@c.de f", [("email", 2, 8)]) == "a <email> f"


def test_all_repetitions_take_the_label_of_the_full_form(docs_of):
    """Fifty bare repetitions before and after the one that a pattern recognises."""
    bare = "then 555-3436 again, "
    text = bare * 50 + "call +1 (974) 555-3436 now, " + bare * 50 + "in 1999"
    found = {r.doc_id: r for r in p.find(docs_of(corpus() + [(999, text)])).collect()}
    assert [(s.kind, text[s.start : s.stop]) for s in found[999].added] == [("phone", "555-3436")] * 100
    assert sum(len(found[i].added) for i in range(300)) == 0


def test_many_base_spans_take_linear_time():
    """A log dump of addresses: the work for a text grows with its spans, not with their square."""
    import time

    spent = []
    for n in (2_000, 16_000):
        text = " ".join(f"10.{i % 256}.{i // 256}.7 user{i}@mail.example" for i in range(n))
        base = p.base_spans(text)
        start = time.process_time()
        p.graph_of(text, base)
        spent.append(time.process_time() - start)
    assert len(base) == 32_000 and spent[1] < 20 * spent[0] + 0.5
