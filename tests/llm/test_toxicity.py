import random
import zlib

import pytest

from caseweave.llm import toxicity as t

INSULTS = ["idiot", "scoundrel", "rotter"]


@pytest.fixture(scope="module")
def rows():
    random.seed(6)
    out = []
    for i in range(600):
        words = ["".join(random.choices(["ta", "re", "mi", "son", "lu", "ven"], k=random.randint(1, 3))) for _ in range(30)]
        if i % 5 == 0:
            words[random.randrange(30)] = random.choice(INSULTS)
            words[random.randrange(30)] = random.choice(INSULTS)
        out.append((i, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0, int(i % 5 == 0), "x") for i in range(600)] + [(None, 0, 1, "x"), (3, 0, None, "x")],
                                 "doc_id long, quality int, toxic int, text string")


def test_held_out_rows_and_disguises(docs_of, rows, labels):
    disguised = ["a 1d10t here", "an i d i o t", "idiiiiot says", "sc0undr3l!", "r-o-t-t-e-r", "@ plain tare mison", "v3n ta", None, ""]
    extra = [(10_000 + i, x) for i, x in enumerate(disguised)] + [(None, "idiot tare"), (10_000, "a 1d10t here")]
    got = t.scores(docs_of(rows + extra), labels).select("doc.doc_id", "doc.text", "held_out", "score", "predicted").collect()
    assert len(got) == len(rows) + len(extra)
    by_text = {r.text: r.predicted for r in got}
    assert [by_text[x] for x in disguised] == [1, 1, 1, 1, 1, 0, 0, 0, 0]
    assert by_text["idiot tare"] == 1
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_trigrams_cover_all_documents(docs_of):
    texts = ["Abc ß!", None, "", "zz 中 zz", "x" * 20_000]
    counts = {r.code: r.n for r in t.trigram_counts(docs_of(list(enumerate(texts)))).collect()}
    want = {}
    for text in texts:
        c = [0, 0, *[t.letter_class(x) for x in (text or "").lower()], 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            code = (a * 64 + b) * 64 + d
            want[code] = want.get(code, 0) + 1
    assert counts == want


def test_viterbi_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    model = t.CharModel(np.log(rng.dirichlet(np.ones(64), size=(64, 64))))
    for stretch in ("1d10t", "s.c*m", "aab1", "7$0"):
        options = t.lattice(stretch)
        best = None
        for path in itertools.product(*options):
            word = "".join(x for x, _ in path)
            c = [0, 0, *map(t.letter_class, word), 0]
            score = -sum(cost for _, cost in path) + sum(model.logs[a, b, d] for a, b, d in zip(c, c[1:], c[2:]))
            best = max(best or (score, word), (score, word))
        assert t.restore(stretch, model) == best[1]


def test_words_of_copies_are_not_learnt(docs_of, rows, labels, spark):
    """A toxic text copied often brings rare words along; a clean text with one of them stays clean."""
    copies = [(2000 + i, "idiot scoundrel quux") for i in range(60)]
    more = labels.select("doc_id", "toxic").union(spark.createDataFrame([(2000 + i, 1) for i in range(60)], "doc_id long, toxic int"))
    got = t.scores(docs_of(rows + copies + [(5000, "tare quux mison")]), more)
    assert got.filter("doc.doc_id = 5000").head().predicted == 0


def test_no_labels_and_empty_table(docs_of, labels):
    none = labels.filter("doc_id < 0")
    assert {r.predicted for r in t.scores(docs_of([(1, "idiot"), (2, None)]), none).collect()} == {0}
    assert t.scores(docs_of([]), labels).collect() == []


def test_replaced_endings_and_other_separators(docs_of, rows, labels):
    """Signs at the end of a word only, any separators, wider gaps between words than between letters."""
    disguised = ["an idio7", "an idio+", "a rotte® r0tter", "i/d/i/o/t", "i,d,i,o,t", "i   d   i   o   t", "i|d|i|o|t",
                 "t a   i d i o t   t a", "idiot! 1d10t!!", "tare! mison! 7", "t/a, r/e", "a $ 5"]
    got = t.scores(docs_of(rows + [(20_000 + i, x) for i, x in enumerate(disguised)]), labels).filter("doc.doc_id >= 20000")
    by_id = {r.doc_id - 20_000: r.predicted for r in got.select("doc.doc_id", "predicted").collect()}
    assert [by_id[i] for i in range(len(disguised))] == [1] * 9 + [0] * 3
    assert {"whor3", "a$$", "hat3"} <= t.stretches("whor3 a$$ hat3")
    for text in ("!" * 50_000, "* " * 50_000, "a!" * 50_000 + "bb", "a " * 50_000 + "bb"):  # no long searches
        t.stretches(text)


def test_long_unbroken_runs_take_linear_time(docs_of, rows, labels):
    """Base64 and the like: one run of letters and digits, or of one letter, as long as a text can be."""
    import time

    draw, model = random.Random(3), t.CharModel(__import__("numpy").zeros((64, 64, 64)))
    for alphabet in ("abcdeXYZ", "a", "ab1", "a0+"):
        spent = []
        for n in (20_000, 80_000):
            text = "".join(draw.choice(alphabet) for _ in range(n))
            start = time.process_time()
            t.TextScorer(model, t.Scorer({"=idiot": 1.0})).score(text)
            spent.append(time.process_time() - start)
        assert spent[1] < 10 * spent[0] + 0.3
    got = t.scores(docs_of(rows + [(9_000, "ab1" * 30_000 + " idiot 1d10t"), (9_001, "a" * 100_000)]), labels)
    assert {r.doc_id: r.predicted for r in got.filter("doc.doc_id >= 9000").select("doc.doc_id", "predicted").collect()} == {9000: 1, 9001: 0}


def test_runs_learnt_once_read_like_runs_read_anew():
    """A reader that has seen everything, one that forgets, and one for each text agree; so do score and scorer."""
    import numpy as np

    draw = random.Random(8)
    model = t.CharModel(np.log(np.random.default_rng(2).dirichlet(np.ones(64), size=(64, 64))))
    texts = ["".join(draw.choice("aab1!$*_ .-oé|(3\n") for _ in range(draw.randint(0, 30))) for _ in range(1500)]
    scorer = t.Scorer({"=ab": 1.0, "aabo": 0.5, "2aabo": 2.0, "oaab": -1.0})
    reader, texts_scorer = t.Reader(model), t.TextScorer(model, scorer)
    for text in texts:
        words = t.Reader(model).words(text)
        low = text.lower()
        assert words == set(t._WORD.findall(low)) | {w for x in t.stretches(low) if (w := t.restore(x, model))}
        assert reader.words(text) == words and texts_scorer.score(text) == scorer.score(words)
