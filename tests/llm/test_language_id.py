import random
import zlib

from caseweave.llm import language_id as li

SYLLABLES = {"xx": "ba be bi bo bu da de", "yy": "kra krü stö sch tz", "zz": "ao ia oué çai"}


def text(lang, n, seed):
    random.seed(f"{lang}{seed}")
    return " ".join("".join(random.choices(SYLLABLES[lang].split(), k=random.randint(1, 4))) for _ in range(n))


def brute_phrases(learnt, parsed):
    count, i = 0, 0
    while i < len(parsed):
        n = 1
        while i + n <= len(parsed) and parsed[i : i + n] in learnt:
            n += 1
        i += max(n - 1, 1)
        count += 1
    return count


def test_phrases_equal_longest_matches():
    samples = {lang: li.letters(text(lang, 200, 0)) for lang in SYLLABLES}
    model = li.build(samples)
    for seed in range(20):
        for lang in SYLLABLES:
            parsed = li.letters(text(lang, 30, seed + 1) + " Wq")
            row = li.phrases(model, [parsed])[0]
            assert row.tolist() == [brute_phrases(samples[m], parsed) for m in model.languages]


def test_held_out_accuracy_and_defined_cases(docs_of, odd_rows):
    rows = [(i, text(lang, 25, i), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(900, "123 !?", "xx", "s"), (901, None, "yy", "s"), (902, text("zz", 3000, 7), None, "s"), (None, text("xx", 9, 8), "yy", "s")]
    got = {r.doc_id: r for r in li.predict(docs_of(rows)).collect()}
    for i, t, lang, _ in rows[:180]:
        assert got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[901].score == 0
    assert got[902].lang_pred == "zz" and got[None].lang_pred == "xx" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_teach_nothing(docs_of):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    got = li.predict(docs_of([(i, text("xx", 10, i), "xx", "s") for i in ids])).collect()
    assert {r.lang_pred for r in got} == {"und"}


def test_empty_table(docs_of):
    assert li.predict(docs_of([])).collect() == []


def test_numerals_are_no_letters_and_marks_belong_to_words(docs_of):
    assert li.letters("½ ² 12 Ⅻ́ ̈") == li.letters("½ ² 12") == b""
    assert li.letters("नमस्ते दुनिया, 1½ Ünïcode") == " नमस्ते दुनिया ünïcode ".encode()
    assert li.letters("Éa1b_c×d") == " éa b c d ".encode()
    rows = [(i, text("xx", 10, i), "xx", "s") for i in range(40)] + [(900, "½ ²", None, "s"), (901, "²½ 3", "xx", "s")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(docs_of(rows)).collect()}
    assert got[900] == got[901] == ("und", 0.0)


def test_bounds_of_the_sample(docs_of):
    """Whole texts in hash order up to the bound, the most frequent labels, hot labels in shares."""
    rows = [(i, text("xx", 50, i), "xx", "s") for i in range(120)] + [(500 + i, text("yy", 5, i), "yy", "s") for i in range(30)]
    rows += [(700, text("zz", 3000, 1), "zz", "s")] + [(800 + i, "rare words", f"l{i}", "s") for i in range(5)]
    docs = docs_of(rows)
    how = dict(fit_rows=20, id_col="doc_id", text_col="text", label_col="lang", may_learn=None)
    got = li.labelled_sample(docs, fit_chars=1500, max_labels=3, **how)
    assert set(got) == {"xx", "yy", "l0"}
    assert 1300 < len(got["xx"].decode()) <= 1600 and len(got["yy"].split()) == 20 * 5
    assert len(li.labelled_sample(docs, fit_chars=1500, max_labels=8, **how)["zz"].decode()) <= 1502
