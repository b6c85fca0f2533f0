"""Golden verdicts, and random traces against a brute-force reading of the definitions."""

import random

import pytest

from caseweave.operators import metrics, templates

GOLDEN = {"t1": "acbabb", "t2": "bac", "t3": "aab"}
RATIOS = {
    "Response": (5, 4, 0.8),
    "Alternate Response": (5, 3, 0.6),
    "Chain Response": (5, 2, 0.4),
    "Precedence": (5, 4, 0.8),
    "Alternate Precedence": (5, 3, 0.6),
    "Chain Precedence": (5, 2, 0.4),
    "Responded Existence": (5, 5, 1.0),
}


def brute(trace, first, second, template, closed):
    """{position: verdict} straight from the definition."""
    out = {}
    for i, x in enumerate(trace):
        before, after = trace[:i], trace[i + 1 :]
        if template in ("Precedence", "Alternate Precedence", "Chain Precedence"):
            if x != second:
                continue
            if template == "Precedence":
                ok = first in before
            elif template == "Chain Precedence":
                ok = bool(before) and before[-1] == first
            else:
                seen = [y for y in before if y in (first, second)]
                ok = bool(seen) and seen[-1] == first
            out[i + 1] = "fulfilled" if ok else "violated"
            continue
        if x != first:
            continue
        both = [y for y in after if y in (first, second)]
        if template == "Response":
            ok, open_ = second in after, second not in after
        elif template == "Alternate Response":
            ok, open_ = bool(both) and both[0] == second, not both
        elif template == "Chain Response":
            ok, open_ = bool(after) and after[0] == second, not after
        else:
            ok, open_ = second in before or second in after, True
        out[i + 1] = "fulfilled" if ok else ("pending" if open_ and not closed else "violated")
    return out


def expected(traces, pairs, closed):
    return {
        (t, a, b, case, pos, verdict)
        for t in templates.TEMPLATES
        for a, b in pairs
        for case, trace in traces.items()
        for pos, verdict in brute(list(trace), a, b, t, closed(case)).items()
    }


def found(df):
    return {(r.template, r.first, r.second, r.case_id, r.pos, r.verdict) for r in df.collect()}


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_golden_ratios(make_log, hot_rows):
    ratios = metrics.constraint_ratios(make_log(GOLDEN), [("a", "b")], negations=True, hot_rows=hot_rows)
    got = {r.template: (r.n_activations, r.n_fulfilled, r.ratio) for r in ratios.collect()}
    want = dict(RATIOS)
    want |= {f"Not {t}": (n, n - f, round(1 - r, 3)) for t, (n, f, r) in RATIOS.items()}
    assert got == want


def random_traces(seed, n=60, letters="abcd", longest=9):
    rnd = random.Random(seed)
    return {f"c{i:02d}": "".join(rnd.choices(letters, k=rnd.randint(1, longest))) for i in range(n)}


@pytest.mark.parametrize("hot_rows", [None, 4])
def test_random_traces(make_log, hot_rows):
    traces = random_traces(1)
    pairs = [(a, b) for a in "abcd" for b in "abcd" if a != b]
    log = make_log(traces)
    assert found(templates.verdicts(log, pairs, hot_rows=hot_rows)) == expected(traces, pairs, lambda c: True)


def test_open_traces_are_pending(make_log):
    traces = random_traces(2)
    pairs = [("a", "b"), ("b", "a"), ("c", "a")]
    open_log = make_log(traces, closed=False)
    closed = {c for c in traces if c < "c30"}
    mixed = make_log(traces).filter("case_id < 'c30'").unionByName(open_log.filter("case_id >= 'c30'"))
    assert found(templates.verdicts(mixed, pairs)) == expected(traces, pairs, lambda c: c in closed)


def test_one_case_holds_most_rows(make_log):
    rnd = random.Random(3)
    traces = random_traces(4, n=10) | {"hot": "".join(rnd.choices("abc", k=700))}
    pairs = [("a", "b"), ("b", "c"), ("a", "d")]
    got = templates.verdicts(make_log(traces), pairs, times=True, hot_rows=50)
    assert found(got) == expected(traces, pairs, lambda c: True)


def test_more_activities_than_one_pass(make_log, monkeypatch):
    monkeypatch.setattr(templates, "PASS_WIDTH", 2)
    traces = random_traces(5, letters="abcde")
    pairs = [(a, b) for a in "abcde" for b in "abcde" if a != b]
    log = make_log(traces)
    assert found(templates.verdicts(log, pairs)) == expected(traces, pairs, lambda c: True)
    timed = templates.verdicts(log, pairs, times=True)
    assert found(timed) == expected(traces, pairs, lambda c: True)


def test_invariants(make_log):
    traces = random_traces(6)
    pairs = [(a, b) for a in "abcd" for b in "abcd" if a != b]
    rows = found(templates.verdicts(make_log(traces), pairs))
    ok = {t: {r[1:5] for r in rows if r[0] == t and r[5] == "fulfilled"} for t in templates.TEMPLATES}
    assert ok["Chain Response"] <= ok["Alternate Response"] <= ok["Response"] <= ok["Responded Existence"]
    assert ok["Chain Precedence"] <= ok["Alternate Precedence"] <= ok["Precedence"]


def test_resolution_times(make_log):
    log = make_log({"x": "abca", "y": "ac"})
    rows = templates.verdicts(log, [("a", "b")], ["Response", "Chain Response"], times=True).collect()
    got = {(r.template, r.case_id, r.pos): r.resolved_seq for r in rows}
    assert got == {
        ("Response", "x", 1): 1, ("Response", "x", 4): 3, ("Response", "y", 1): 5,
        ("Chain Response", "x", 1): 1, ("Chain Response", "x", 4): 3, ("Chain Response", "y", 1): 5,
    }


def test_names_are_compared_whole(make_log):
    log = make_log({"x": ["pay_1", "ship", "pay"]})
    ratios = metrics.constraint_ratios(log, [("pay", "ship")], ["Response"]).collect()
    assert [(r.n_activations, r.n_fulfilled) for r in ratios] == [(1, 0)]


def test_expansion_needs_no_extra_shuffle(make_log):
    df = templates.verdicts(make_log(GOLDEN), [("a", "b"), ("b", "c")], complete=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
