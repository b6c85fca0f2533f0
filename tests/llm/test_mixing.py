from caseweave.llm import mixing


def corpus():
    rows, n = [], 0
    for source, lang, many in (("a", "en", 400), ("b", "en", 60), ("b", "de", 40), ("c", "fr", 20)):
        for _ in range(many):
            rows.append((n, "w " * 50, lang, source))
            n += 1
    return rows


def test_rake_meets_the_marginals(docs_of):
    targets = {"source": {"a": 1.0, "b": 2.0, "c": 1.0}, "lang": {"en": 0.5, "de": 0.25, "fr": 0.25}}
    rows = docs_of(corpus())
    cells = mixing.probabilities(rows, targets, budget_share=0.1, rounds=60).toPandas()
    assert abs(cells.weight.sum() - 1) < 1e-9
    assert abs(cells[cells.source == "b"].weight.sum() - 0.5) < 1e-3
    assert abs(cells[cells.lang == "fr"].weight.sum() - 0.25) < 1e-3


def test_calibration_meets_the_budget(docs_of):
    for share in (0.05, 0.3, 0.8, 1.0):
        cells = mixing.probabilities(docs_of(corpus()), budget_share=share).toPandas()
        assert abs((cells.p * cells.tokens).sum() - share * cells.tokens.sum()) < 1e-6 * cells.tokens.sum()
        assert cells.p.between(0, 1).all()


def test_draw_follows_probabilities_and_is_stable(docs_of):
    docs = docs_of(corpus())
    first = {r.doc.doc_id: r.drawn for r in mixing.draw(docs).collect()}
    again = {r.doc.doc_id: r.drawn for r in mixing.draw(docs.repartition(7), max_broadcast=0).collect()}
    assert first == again and abs(sum(first.values()) - 260) < 60


def test_values_without_target_are_not_drawn(docs_of):
    drawn = mixing.draw(docs_of(corpus()), {"source": {"a": 1.0, "zzz": 5.0}}).filter("drawn").collect()
    assert drawn and {r.source for r in drawn} == {"a"}


def test_odd_rows_and_empty_table(docs_of, odd_rows):
    rows = [(d, t, None, None) if d == 4 else (d, t, "en", "s") for d, t in odd_rows]
    got = mixing.draw(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r.source for r in got} == {"?", "s"}
    assert len({r.drawn for r in got if r.doc.doc_id == 4}) == 1
    assert mixing.draw(docs_of([])).collect() == []


def test_texts_without_words_are_not_drawn(docs_of):
    """Their cell has no tokens and p = 0, whatever the budget; beside words in one cell they are drawn like any other."""
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n", "en", "s"), (4, "some words", "en", "s")]
    got = {r.doc.doc_id: (r.topic, r.p, r.drawn) for r in mixing.draw(docs_of(rows), budget_share=1.0).collect()}
    assert got == {1: ("empty", 0.0, False), 2: ("empty", 0.0, False), 3: ("note", 1.0, True), 4: ("note", 1.0, True)}
