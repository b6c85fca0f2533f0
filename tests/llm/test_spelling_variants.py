import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from caseweave.llm import spelling_variants as V


def plain_words(rows):
    counted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counted[word] += 1
    return {w: n for w, n in counted.items() if n >= 2}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = defaultdict(list)
    for a in words:
        near[a] = [b for b in words if b != a and one_edit(a, b)]
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 10 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return rows


def variants_of(docs):
    rows = [tuple(r) for r in V.variants(docs).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(seed, n=60):
    """Few stems with random edits, often enough to be words."""
    draw = random.Random(seed)
    letters = "abÀéÿz"
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(6, 11))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "abababababab"]
    made = []
    for doc_id in range(n):
        words = []
        for _ in range(60):
            w = list(draw.choice(stems))
            if draw.random() < 0.5:
                i = draw.randrange(len(w))
                w[i : i + 1] = draw.choice([[], [draw.choice(letters)], [w[i], draw.choice(letters)], [w[i].upper()]])
            words.append("".join(w))
        made.append((doc_id, draw.choice([" ", "-", "\n", "1"]).join(words)))
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_all_words(docs_of, seed):
    rows = texts(seed)
    assert variants_of(docs_of(rows)) == plain_variants(plain_words(rows))


def test_very_long_words_take_few_levels(spark, docs_of):
    draw = random.Random(5)
    long = "".join(draw.choice("abcd") for _ in range(3000))
    odd = [long, long[:1500] + "x" + long[1501:], long[:2990] + long[2991:], long[:40] + "y" + long[40:], long + "z", long[1:], "q" * 200, "q" * 201, "q" * 203]
    odd += [long[:k] + "w" + long[k + 1 : 120] for k in range(30, 60)] + [long[:120]]
    counted = spark.createDataFrame([(w, 2 + k) for k, w in enumerate(odd)], "word string, n long")
    got = {(r.a, r.b) for r in V.neighbours(counted).collect()}
    assert got == {(a, b) for a in odd for b in odd if a != b and one_edit(a, b)}
    assert sum(V.cut_depth(level) < 3000 for level in range(100)) < 50


def test_short_words_by_parameter(spark):
    some = ["a", "b", "ab", "ba", "abc", "abd", "bd", "abcd", "dcba", "é", "éa"]
    counted = spark.createDataFrame([(w, 3) for w in some], "word string, n long")
    got = [(r.a, r.b) for r in V.neighbours(counted, shortest=1).collect()]
    assert sorted(got) == sorted((a, b) for a in some for b in some if a != b and one_edit(a, b))


def test_split_words_over_partitions(spark):
    """Edges of words that lie in different partitions are put together."""
    draw = random.Random(9)
    some = sorted({"".join(draw.choice("abc") for _ in range(7)) for _ in range(300)})
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = spark.createDataFrame([(w, 2) for w in some], "word string, n long")
        got = sorted((r.a, r.b) for r in V.neighbours(counted).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == sorted((a, b) for a in some for b in some if a != b and one_edit(a, b))


def test_forms_are_followed_to_the_root(docs_of):
    rows = [(1, "hundredfold " * 400), (1, "hundredfald " * 30), (2, "hundretfald " * 2), (2, "hundredfolds " * 3)]
    got = {r[0]: r for r in variants_of(docs_of(rows))}
    want = {r[0]: r for r in plain_variants(plain_words(rows))}
    assert got == want
    assert want["hundretfald"][2] == "hundredfold"


def test_odd_rows(docs_of, odd_rows):
    rows = [*odd_rows, (7, "Ümlaute ümlaute umlaute ×÷×÷×÷× ×÷×÷×÷×"), (None, "Ümlaute übriges übriges"), (8, "x" * 5000 + " " + "x" * 5000)]
    assert variants_of(docs_of(rows)) == plain_variants(plain_words(rows))
    assert V.variants(docs_of([])).count() == 0
