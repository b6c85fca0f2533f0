import random

from caseweave.llm import line_dedup


def words(n, seed):
    random.seed(seed)
    return " ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_long_passage_stays_once(docs_of):
    passage = words(60, 1)
    rows = [(i, f"{words(9, 100 + i)}\n{passage}\n{words(7, 200 + i)}") for i in range(5)]
    got = texts(line_dedup.rewritten(docs_of(rows)))
    assert got[0] == rows[0][1]
    for i in range(1, 5):
        assert got[i] == f"{words(9, 100 + i)}\n{words(7, 200 + i)}"


def test_multi_line_passage_is_found_wherever_it_stands(docs_of):
    passage = [words(12, 10 + i) for i in range(30)]
    rows = [(i, "\n".join([words(5, 300 + i * 7 + j) for j in range(i)] + passage)) for i in range(4)]
    got = texts(line_dedup.rewritten(docs_of(rows)))
    assert got[0] == rows[0][1]
    for i in range(1, 4):  # the two ends may belong to chunks that reach beyond the passage
        left = got[i].split("\n")
        assert sum(line in passage for line in left) <= 16 and [x for x in left if x not in passage] == rows[i][1].split("\n")[:i]


def test_short_repeats_and_clean_texts_stay(docs_of):
    rows = [(i, f"Dear reader\n{words(30, 400 + i)}\nAll rights reserved.") for i in range(6)]
    assert texts(line_dedup.rewritten(docs_of(rows))) == dict(rows)


def test_repeat_within_a_document(docs_of):
    passage = words(70, 3)
    got = line_dedup.dedup(docs_of([(1, f"{passage}\nx\n{passage}")])).head()
    assert (got.new, got.n_lines_removed, got.n_chunks_removed) == (f"{passage}\nx", 1, 1)


def test_columns_odd_rows_and_empty_table(docs_of, odd_rows):
    docs = docs_of([*odd_rows, (None, words(60, 8)), (9, words(60, 8))])
    done = line_dedup.rewritten(docs)
    assert done.schema.simpleString() == docs.schema.simpleString()
    by_id = {}
    for r in done.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert by_id[1] == [None] and by_id[2] == [""] and by_id[9] == [words(60, 8)] and sorted(by_id[None]) == ["", "a text without id"]
    assert by_id[4] == ["some words here"] * 2 and len(by_id[5][0]) > 100_000
    assert line_dedup.rewritten(docs_of([])).count() == 0


def test_native_plan(docs_of):
    plan = line_dedup.rewritten(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("arrow", "")


def plainly_removed(rows):
    """Lines (doc, place) of passages of more than LONG_WORDS words that occur before, by trying all runs; ids ascend."""
    lines = {i: t.split("\n") for i, t in rows}
    first, gone = {}, set()
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a, len(lines[i])):
                run = tuple(lines[i][a : b + 1])
                if sum(len(x.split()) for x in run) > line_dedup.LONG_WORDS:
                    j, at = first.setdefault(run, (i, a))
                    if (j, at) != (i, a):
                        gone |= {(i, p) for p in range(a, b + 1) if j != i or p >= at + len(run)}
    return gone


def test_passages_of_short_lines_go_wherever_they_stand(docs_of):
    """Passages of 2 to 6 lines of at most 50 words each, between unlike lines."""
    rows, want = [], {}
    for n in range(2, 7):
        for k in range(4):
            passage = [words(60 // n + 1, 1000 + 10 * (4 * n + k) + j) for j in range(n)]
            for copy in range(3):
                i = len(rows)
                head = [words(4 + j, 5000 + 10 * i + j) for j in range(i % 4)]
                tail = [words(6 + j, 9000 + 10 * i + j) for j in range(i % 3)]
                rows.append((i, "\n".join(head + passage + tail)))
                want[i] = "\n".join(head + (passage if copy == 0 else []) + tail)
    assert texts(line_dedup.rewritten(docs_of(rows))) == want


def test_repeated_runs_equal_brute_force(docs_of, monkeypatch):
    """Lines of a small stock, so that runs repeat, overlap and follow themselves; blank lines too."""
    monkeypatch.setattr(line_dedup, "MIN_WORDS", line_dedup.LONG_WORDS + 1)  # chunks add nothing: a longer one is a run
    monkeypatch.setattr(line_dedup, "_BLOCK", 3)
    random.seed(12)
    stock = ["", *[" ".join([f"w{j}"] * n) for j, n in enumerate((3, 9, 15, 25, 30, 45, 55))]]
    rows = [(i, "\n".join(random.choices(stock, k=random.randint(1, 14)))) for i in range(40)]
    gone = plainly_removed(rows)
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}
    assert len(gone) > 50 and texts(line_dedup.rewritten(docs_of(rows))) == want


def test_passages_of_45_words_go(docs_of):
    """Three lines of fifteen words, each passage in two documents."""
    passages = [[words(15, 40_000 + 10 * k + j) for j in range(3)] for k in range(30)]
    rows = [(2 * k + c, "\n".join([words(8, 50_000 + 2 * k + c), *p, words(9, 60_000 + 2 * k + c)])) for k, p in enumerate(passages) for c in range(2)]
    got = texts(line_dedup.rewritten(docs_of(rows)))
    for k, p in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1]
        assert got[2 * k + 1] == "\n".join(x for x in rows[2 * k + 1][1].split("\n") if x not in p)


def test_near_copies_may_stay_whole(docs_of):
    body = [words(20, 70_000 + j) for j in range(10)]
    rows = [(1, "\n".join(body)), (2, "\n".join([*body[:9], words(20, 71_000)])), (3, "\n".join([*body[:4], *[words(20, 72_000 + j) for j in range(6)]]))]
    got = texts(line_dedup.rewritten(docs_of(rows), copies_from=0.8))
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and got[3] == "\n".join(rows[2][1].split("\n")[4:])
    assert texts(line_dedup.rewritten(docs_of(rows)))[2] == words(20, 71_000)
