import random
import re

from caseweave.llm import license_scan as s


def plain(text):
    """Places of the exact phrases in words."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase in s.PHRASES:
        w = phrase.text.split()
        found += [(i, phrase.label) for i in range(len(words) - len(w) + 1) if words[i : i + len(w)] == w]
    return len(words), sorted(found)


def test_phrases_equal_plain_search(docs_of, odd_rows):
    random.seed(3)
    vocabulary = "cc by general public license all rights reserved é BY CC-BY K x".split()
    rows = [*odd_rows, *[(100 + i, " ".join(random.choices(vocabulary, k=random.randint(0, 30)))) for i in range(150)]]
    rows += [(400, "cc by " * 5000), (401, "licenKe rights"), (400, "cc by " * 5000)]
    got = sorted(str((r.doc_id, r.n_words, sorted((x.start, x.label) for x in r.spans if x.exact))) for r in s.scan(docs_of(rows)).collect())
    assert got == sorted(str((d, *plain(t))) for d, t in rows)


def test_notices_with_small_changes_are_found(docs_of):
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    words = body.split()
    rows = [
        (1, "intro words " + body + " end"),
        (2, "x " + " ".join(words[:8] + words[9:])),  # a word dropped: two neighbouring diagonals
        (3, "y " + " ".join(words[:6] + ["totally"] + words[6:])),  # a word added
        (4, " ".join(words[:5])),  # too little of it
        (5, "of this software and to any person and free of a copy"),
    ]
    got = {r.doc_id: [(x.label, x.start) for x in r.spans] for r in s.scan(docs_of(rows)).collect()}
    assert got == {1: [("mit", 2)], 2: [("mit", 1)], 3: [("mit", 1)], 4: [], 5: []}


def plain_notices(text, templates, min_cover=0.7, max_shift=2):
    """(label, start, cover) of the verified spans, by comparing all pairs of words."""
    words, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()), []
    for t in templates:
        tw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.text.lower())
        n, by_diagonal = len(tw) - 1, {}
        for at in range(n):
            for place in range(len(words) - 1):
                if words[place : place + 2] == tw[at : at + 2]:
                    by_diagonal.setdefault(place - at, []).append((at, place))
        groups, before = [], None
        for d in sorted(d for d, h in by_diagonal.items() if len(h) > 1 or n == 1):
            if before is None or d - before > max_shift:
                groups.append([])
            groups[-1] += by_diagonal[d]
            before = d
        for hits in groups:
            first, last = min(p for _, p in hits), max(p for _, p in hits) + 2
            longest = {}
            for at, place in sorted(hits):
                longest[at, place] = 1 + max((k for (a, p), k in longest.items() if a < at and p < place), default=0)
            cover = max(longest.values()) / n
            if cover >= min_cover and last - first <= n + 1 + 2 * max_shift + n / 2:
                found.append((t.label, first, round(cover, 9)))
    return sorted(found)


def test_verified_spans_equal_a_plain_search(docs_of):
    random.seed(11)
    templates = (
        s.Template("song", "la la la la end of the song now"),
        s.Template("two", "one two"),
        s.Template("terms", "use copy and change this work for any purpose with or without a fee"),
    )
    rows = [(0, None), (1, ""), (2, "la " * 40), (3, "one two one three two one two")]
    for i in range(120):
        words = []
        for t in random.choices(templates, k=2):
            part = t.text.split()
            for _ in range(random.randint(0, 3)):
                at = random.randrange(len(part))
                part[at : at + random.randint(0, 2)] = random.choices("la the of one x use".split(), k=random.randint(0, 2))
                part = part or ["x"]
            words += part + ["between"] * random.randint(0, 2)
        rows.append((10 + i, " ".join(words)))
    got = {r.doc_id: sorted((x.label, x.start, round(x.cover, 9)) for x in r.spans) for r in s.scan(docs_of(rows), templates).collect()}
    assert got == {d: plain_notices(t, templates) for d, t in rows}
    assert got[2] == []  # many agreeing pairs, but a third of the template at most in its order
    assert sum(map(bool, got.values())) > 60


def test_empty_table(docs_of):
    assert s.scan(docs_of([])).collect() == []
