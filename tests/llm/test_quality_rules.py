import re

from caseweave.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            again.update(p for s in starts for p in range(s, s + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in q.SYMBOLS), len(lines) - len(set(lines)), len(again))


def test_measures_equal_a_plain_count(odd_rows):
    texts = [t for _, t in odd_rows] + ["a b c d e f g h " * 3, "x\nx\n\ny\n \nx", "#a *b|c", "one two\x0b\x0cthree four"]
    for text in texts:
        assert q.measure(text or "")[:5] == plain(text)


def test_ledger_policies_and_ablation(docs_of):
    clean = " ".join(f"w{i}" for i in range(40))
    rows = [(1, clean), (2, "few words"), (3, "spam eggs ham one two three four five " * 6), (4, clean.replace(" ", "### ")), (5, None), (5, None)]
    ledger = q.ledger(docs_of(rows)).cache()
    bits = {r.doc_id: r.fail_bits for r in ledger.collect()}
    assert bits[1] == 0 and bits[2] == bits[5] == q.BIT["few_words"]
    assert bits[3] & q.BIT["repeated_windows"] and bits[4] == q.BIT["symbols"]
    kept = lambda p: sorted(r.doc_id for r in q.apply_policy(ledger, p).filter("kept").collect())
    assert kept("base") == [1, 4] and kept("v2") == [1] and kept([]) == [1, 2, 3, 4, 5, 5]
    by_rule = {r.rule: r for r in q.ablation(ledger, "v1").collect()}
    assert (by_rule["few_words"].n_failing, by_rule["few_words"].n_only_this) == (3, 3)
    assert (by_rule["symbols"].n_kept, by_rule["symbols"].n_kept_without) == (1, 2)


def test_odd_rows_and_empty_table(docs_of, odd_rows):
    assert q.ledger(docs_of(odd_rows)).count() == len(odd_rows)
    assert q.ledger(docs_of([])).count() == 0 and q.ablation(q.ledger(docs_of([])), "v2").count() == 0
