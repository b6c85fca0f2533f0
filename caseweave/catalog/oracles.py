"""The same results in ANSI SQL (DuckDB dialect) over the plain tables.

Written from the definitions -- self-joins, windows per pair, recursive folds -- and not from
the Spark plans, so that agreement means something.
"""

from __future__ import annotations

from caseweave.catalog.queries import DRIFT_DELTA, EVENTS_SUPPORT, ORDER_CONDITIONS, ORDER_CUTS, ORDER_YEARS, ORDERS_SUPPORT, REPLAY_YEARS
from caseweave.operators.learning import Settings

EVENTS = r"""log AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts, event_id AS seq,
    CAST(value AS DOUBLE) AS value, regexp_extract(props, '"k": ?([0-9]+)', 1) AS k FROM events)"""
ORDERS = """log AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderpriority AS activity,
    o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS price, o_orderstatus AS status,
    CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS BIGINT) AS quarter FROM orders)"""
CONVERSATIONS = """log AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity, turn AS seq,
    turn AS ts FROM conversations)"""


def pairs_cte(support: float) -> str:
    return f"""thr AS (SELECT CAST(ceil(round({support} * count(DISTINCT case_id), 9)) AS BIGINT) AS t FROM log),
    sup AS (SELECT activity, count(DISTINCT case_id) AS s FROM log GROUP BY activity),
    ca AS (SELECT DISTINCT case_id, activity FROM log),
    js AS (SELECT x.activity AS a, y.activity AS b, count(*) AS j FROM ca x JOIN ca y
        ON x.case_id = y.case_id AND x.activity <> y.activity GROUP BY 1, 2),
    pairs AS (SELECT js.a, js.b, js.j, t FROM js, thr
        WHERE j >= t AND a IN (SELECT activity FROM sup WHERE s >= t)
        AND b IN (SELECT activity FROM sup WHERE s >= t))"""


def verdict_cte(closed: str = "true", extra: str = "") -> str:
    """``v``: one row per activation of every template; ``extra``: more columns of the log."""
    more = f", {extra}" if extra else ""
    rows = [
        ("Response", "a", "coalesce(last_b > pos, false)", "NOT coalesce(last_b > pos, false)", "coalesce(next_b, n)"),
        ("Alternate Response", "a", "coalesce(next_role = 'b', false)", "next_role IS NULL", "coalesce(next_pos, n)"),
        ("Chain Response", "a", "coalesce(next_act = b, false)", "pos = n", "least(pos + 1, n)"),
        ("Precedence", "b", "coalesce(first_a < pos, false)", "false", "pos"),
        ("Alternate Precedence", "b", "coalesce(prev_role = 'a', false)", "false", "pos"),
        ("Chain Precedence", "b", "coalesce(prev_act = a, false)", "false", "pos"),
        ("Responded Existence", "a", "last_b IS NOT NULL", "last_b IS NULL",
         "CASE WHEN first_b < pos THEN pos ELSE coalesce(next_b, n) END"),
    ]
    union = " UNION ALL ".join(
        f"""SELECT '{name}' AS template, a AS first, b AS second, case_id, pos, ts, seq{more},
        CASE WHEN {fulfilled} THEN 'fulfilled' WHEN {undecided} AND NOT closed THEN 'pending'
        ELSE 'violated' END AS verdict, {resolved} AS resolved_pos FROM w WHERE role = '{role}'"""
        for name, role, fulfilled, undecided, resolved in rows
    )
    return f"""placed0 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, seq) AS pos,
        lead(activity) OVER (PARTITION BY case_id ORDER BY ts, seq) AS next_act,
        lag(activity) OVER (PARTITION BY case_id ORDER BY ts, seq) AS prev_act,
        count(*) OVER (PARTITION BY case_id) AS n, max(ts) OVER (PARTITION BY case_id) AS end_ts FROM log),
    placed AS (SELECT *, {closed} AS closed FROM placed0),
    pe AS (SELECT a, b, l.*, CASE WHEN activity = a THEN 'a' ELSE 'b' END AS role
        FROM pairs JOIN placed l ON activity = a OR activity = b),
    w AS (SELECT *, max(pos) FILTER (role = 'b') OVER p AS last_b, min(pos) FILTER (role = 'b') OVER p AS first_b,
        min(pos) FILTER (role = 'a') OVER p AS first_a, lead(role) OVER o AS next_role, lag(role) OVER o AS prev_role,
        lead(pos) OVER o AS next_pos, min(pos) FILTER (role = 'b') OVER
        (PARTITION BY a, b, case_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_b
        FROM pe WINDOW p AS (PARTITION BY a, b, case_id), o AS (PARTITION BY a, b, case_id ORDER BY pos)),
    v AS ({union})"""


NEGATED = """vn AS (SELECT * FROM v UNION ALL SELECT * REPLACE ('Not ' || template AS template,
    CASE verdict WHEN 'fulfilled' THEN 'violated' WHEN 'violated' THEN 'fulfilled' ELSE verdict END AS verdict) FROM v)"""

CONDITIONS = """conds AS (SELECT * FROM (VALUES ('high_price', 'o_totalprice > 250000'),
    ('open_low', 'o_orderstatus == ''O'' and o_totalprice <= 150000'),
    ('absent_last', 'o_totalprice > 400000 and channel == ''web''')) AS c(label, condition))"""
# An absent attribute (channel) makes the condition true once it is reached.
HOLDS = """CASE label WHEN 'high_price' THEN price > 250000
    WHEN 'open_low' THEN status = 'O' AND price <= 150000 ELSE price > 400000 END"""

ORDER_PAIRS = pairs_cte(ORDERS_SUPPORT)
EVENT_PAIRS = pairs_cte(EVENTS_SUPPORT)
ORDER_V = f"{ORDERS}, {ORDER_PAIRS}, {verdict_cte(extra='price, status, quarter')}"
EVENT_V = f"{EVENTS}, {EVENT_PAIRS}, {verdict_cte()}"

RUNNING = """timed AS (SELECT v.*, r.ts AS rts, r.seq AS rseq FROM v JOIN placed r
        ON r.case_id = v.case_id AND r.pos = v.resolved_pos),
    run AS (SELECT *, count(*) OVER k AS n_activations,
        CAST(sum(CASE WHEN verdict = 'fulfilled' THEN 1 ELSE 0 END) OVER k AS BIGINT) AS n_fulfilled FROM timed
        WINDOW k AS (PARTITION BY template, first, second ORDER BY rts, rseq, ts, seq, case_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

DATA_AWARE = """SELECT template, first, second, condition, label{group}, count(*) AS n_activations,
    count(*) FILTER (verdict = 'fulfilled') AS n_fulfilled,
    count(*) FILTER ({holds}) AS n_activations_data,
    count(*) FILTER (({holds}) AND verdict = 'fulfilled') AS n_fulfilled_data,
    round_even(count(*) FILTER (verdict = 'fulfilled') / count(*), 3) AS ratio,
    round_even(coalesce(count(*) FILTER (({holds}) AND verdict = 'fulfilled') / nullif(count(*) FILTER ({holds}), 0), 0.0), 3)
        AS ratio_data
    FROM vn, conds GROUP BY ALL"""

RECORDS = f"""{ORDER_V}, {NEGATED}, {CONDITIONS}, da AS ({DATA_AWARE.format(holds=HOLDS, group=', quarter')}),
    rec AS (SELECT *, template || '[' || first || ', ' || second || ']' AS "constraint", quarter * 10 +
        CASE label WHEN 'high_price' THEN 0 WHEN 'open_low' THEN 1 ELSE 2 END AS run FROM da)"""
BEST = f"""{RECORDS}, best AS (SELECT * FROM rec WHERE ratio_data > 0.0
        QUALIFY row_number() OVER (PARTITION BY "constraint" ORDER BY n_activations DESC, run) = 1),
    d AS (SELECT *, round(ratio - ratio_data, 3) AS diff FROM best)"""

STATS = """SELECT count(*) AS "Event_counter", min(ts) AS "Log_start_timestamp", max(ts) AS "Log_end_timestamp",
    count(DISTINCT case_id) AS "Counter_trace_id" FROM log"""


def _entropy(a: str, b: str) -> str:
    def term(x):
        return f"(CASE WHEN {x} > 0 THEN -({x} / ({a} + {b})) * log2({x} / ({a} + {b})) ELSE 0 END)"

    return f"({term(a)} + {term(b)})"


def _split_sql() -> str:
    tests = [(f"o_orderstatus == {s}", f"status = '{s}'") for s in ("F", "O", "P")]
    tests += [(f"o_totalprice <= {cut}", f"price <= {cut}") for cut in ORDER_CUTS]
    union = " UNION ALL ".join(
        f"""SELECT template, first, second, '{name}' AS test,
        count(*) FILTER (({test}) AND verdict = 'fulfilled') AS left1,
        count(*) FILTER (({test}) AND verdict = 'violated') AS left0,
        count(*) FILTER (NOT ({test}) AND verdict = 'fulfilled') AS right1,
        count(*) FILTER (NOT ({test}) AND verdict = 'violated') AS right0 FROM v GROUP BY ALL"""
        for name, test in tests
    )
    l, r = "(left1 + left0)", "(right1 + right0)"
    gain = (
        f"{_entropy('(left1 + right1)', '(left0 + right0)')} - {l} / ({l} + {r}) * {_entropy('left1', 'left0')}"
        f" - {r} / ({l} + {r}) * {_entropy('right1', 'right0')}"
    )
    return f"""WITH {ORDER_V}, s AS ({union})
        SELECT *, round({gain}, 6) AS gain FROM s WHERE least({l}, {r}) > 0.01 * ({l} + {r})"""


def _replay_sql(cumulative: bool) -> str:
    window = (
        "PARTITION BY template, first, second ORDER BY valid_from ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    )
    n, hits = (f"CAST(sum(n) OVER ({window}) AS BIGINT)", f"CAST(sum(hits) OVER ({window}) AS BIGINT)") if cumulative else ("n", "hits")
    months = ", ".join(f"('{label}', {1 + 4 * k})" for k, (label, _) in enumerate(ORDER_CONDITIONS))
    return f"""WITH {ORDER_V}, {NEGATED}, {CONDITIONS}, timed AS (SELECT vn.*, r.ts AS rts FROM vn JOIN placed r
        ON r.case_id = vn.case_id AND r.pos = vn.resolved_pos),
    dated AS (SELECT label, condition, make_timestamp(y, m, 1, 0, 0, 0.0) AS valid_from, y * 12 + m AS rule_seq
        FROM conds JOIN (VALUES {months}) AS t(l, m) ON l = label, (SELECT CAST(unnest(range({REPLAY_YEARS[0]}, {REPLAY_YEARS[-1] + 1})) AS BIGINT) AS y)),
    rules AS (SELECT t.template, a AS first, b AS second, dated.*, lag(valid_from) OVER (PARTITION BY t.template, a, b ORDER BY valid_from) AS since
        FROM pairs, (SELECT DISTINCT template FROM vn) t, dated),
    applied AS (SELECT r.template, r.first, r.second, r.condition, r.valid_from, r.rule_seq, count(x.case_id) AS n,
        count(x.case_id) FILTER (x.verdict = 'fulfilled') AS hits
        FROM rules r LEFT JOIN timed x ON x.template = r.template AND x.first = r.first AND x.second = r.second
        AND ({HOLDS}) AND x.rts <= r.valid_from AND (since IS NULL OR x.rts > since) GROUP BY ALL),
    c AS (SELECT template, first, second, condition, valid_from, rule_seq, {n} AS n_activations_data, {hits} AS n_fulfilled_data FROM applied)
    SELECT template, first, second, condition, valid_from, rule_seq, n_activations_data,
        n_fulfilled_data, round_even(coalesce(n_fulfilled_data / nullif(n_activations_data, 0), 0.0), 3) AS ratio_data FROM c"""


def _tree_ctes(keys: str, rows: str) -> str:
    """Trees over ``rows`` (keys, y, w: 1 to learn from, price, status, nth), one level after the other; every value is tried."""
    rule = Settings()
    using = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"n.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    parts = [f"n0 AS MATERIALIZED (SELECT {keys}, y, w, price, status, nth, '' AS node, '' AS rule FROM {rows})"]
    for d in range(rule.max_depth):
        right1, right0, present = "(all1 - left1)", "(all0 - left0)", "(all1 + all0)"
        left = "(left1 + left0)"
        gain = (f"round({present} / total * ({_entropy('all1', 'all0')} - {left} / {present} * {_entropy('left1', 'left0')}"
                f" - ({right1} + {right0}) / {present} * {_entropy(right1, right0)}), 9)")
        parts.append(f"""t{d} AS (SELECT {keys}, node, sum(w * y) AS t1, sum(w) AS total FROM n{d} WHERE length(node) = {d}
            GROUP BY ALL HAVING sum(w) >= {rule.grace}),
        f{d} AS (SELECT {keys}, node, attr, num, val, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM (
            SELECT {keys}, node, y, 'nth_order' AS attr, CAST(nth AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS val FROM n{d} WHERE w = 1 AND length(node) = {d}
            UNION ALL SELECT {keys}, node, y, 'o_totalprice', price, NULL FROM n{d} WHERE w = 1 AND length(node) = {d}
            UNION ALL SELECT {keys}, node, y, 'o_orderstatus', NULL, status FROM n{d} WHERE w = 1 AND length(node) = {d}) GROUP BY ALL),
        g{d} AS (SELECT {keys}, node, attr, num, val,
            CASE WHEN val IS NULL THEN sum(n1) OVER (o ORDER BY num) ELSE n1 END AS left1,
            CASE WHEN val IS NULL THEN sum(n0) OVER (o ORDER BY num) ELSE n0 END AS left0,
            sum(n1) OVER o AS all1, sum(n0) OVER o AS all0 FROM f{d} WINDOW o AS (PARTITION BY {keys}, node, attr)),
        q{d} AS (SELECT *, {gain} AS gain FROM g{d} JOIN t{d} USING ({keys}, node) WHERE least({left}, {present} - {left}) > {rule.min_branch} * {present}),
        b{d} AS (SELECT *, sqrt(ln(1 / {rule.delta}) / (2 * total)) AS bound FROM q{d}
            QUALIFY row_number() OVER (PARTITION BY {keys}, node, attr ORDER BY gain DESC, num, val) = 1),
        r{d} AS (SELECT *, lead(gain) OVER (PARTITION BY {keys}, node ORDER BY gain DESC, attr) AS runner_up,
            row_number() OVER (PARTITION BY {keys}, node ORDER BY gain DESC, attr) AS rank FROM b{d}),
        s{d} AS (SELECT * FROM r{d} WHERE rank = 1 AND gain > bound
            AND (gain - CASE WHEN runner_up > bound THEN runner_up ELSE 0 END > bound OR bound < {rule.tau})),
        m{d} AS (SELECT n.*, s.attr, s.num, s.val, CASE s.attr WHEN 'nth_order' THEN nth <= s.num WHEN 'o_totalprice' THEN price <= s.num
            ELSE status = s.val END AS side FROM n{d} n LEFT JOIN s{d} s ON {same} AND n.node = s.node),
        n{d + 1} AS MATERIALIZED (SELECT {using}, y, w, price, status, nth,
            CASE WHEN attr IS NULL THEN node ELSE node || CASE WHEN side THEN '0' ELSE '1' END END AS node,
            CASE WHEN attr IS NULL THEN rule ELSE rule || CASE WHEN rule = '' THEN '' ELSE ' and ' END || attr || CASE
                WHEN val IS NULL THEN CASE WHEN side THEN ' <= ' ELSE ' > ' END || CAST(num AS VARCHAR)
                ELSE CASE WHEN side THEN ' == ' ELSE ' != ' END || chr(39) || val || chr(39) END END AS rule FROM m{d} n)""")
    return ", ".join(parts)


_CONSTRAINT = "template, first, second"
PLACED_V = f"{ORDERS}, {ORDER_PAIRS}, {verdict_cte(extra='price, status')}, vy AS (SELECT *, CAST(verdict = 'fulfilled' AS INT) AS y, pos AS nth FROM v)"


def _leaves_sql() -> str:
    """``leaves`` of the trees of all constraints."""
    return f"""WITH {PLACED_V}, lr AS (SELECT *, 1 AS w FROM vy), {_tree_ctes(_CONSTRAINT, 'lr')},
    leaves AS (SELECT {_CONSTRAINT}, node, rule, CAST(sum(y) AS BIGINT) AS n1, CAST(sum(1 - y) AS BIGINT) AS n0 FROM n{Settings().max_depth} GROUP BY ALL)"""


def _learned_sql() -> str:
    return f"""{_leaves_sql()}, either AS (SELECT *, round(n1 / (n1 + n0), 2) AS probability FROM (SELECT * FROM leaves
        UNION ALL SELECT 'Not ' || template, first, second, node, rule, n0, n1 FROM leaves)),
    sums AS (SELECT {_CONSTRAINT}, sum(n1) AS s1, sum(n0) AS s0, count(*) AS n FROM either GROUP BY ALL),
    best AS (SELECT * FROM either WHERE n1 > n0 QUALIFY row_number() OVER (PARTITION BY {_CONSTRAINT} ORDER BY probability DESC, node) = 1)
    SELECT template || '[' || first || ', ' || second || ']' AS "constraint", rule AS condition, probability,
        CAST(s1 + s0 AS BIGINT) AS n_activations, round_even(s1 / (s1 + s0), 3) AS ratio
    FROM best JOIN sums USING ({_CONSTRAINT}) WHERE n > 1 AND least(s1, s0) > 0 AND greatest(s1, s0) / least(s1, s0) <= {Settings().balance}"""


def _prequential_sql() -> str:
    """Version v learns from the years before v (w = 1) and is held against year v (w = 0)."""
    keys = f"version, {_CONSTRAINT}"
    return f"""WITH {PLACED_V}, lr AS (SELECT vy.*, version, CASE WHEN year(ts) < version THEN 1 ELSE 0 END AS w FROM vy
        JOIN (SELECT unnest(range({ORDER_YEARS[0]}, {ORDER_YEARS[-1] + 1})) AS version) ON year(ts) <= version), {_tree_ctes(keys, 'lr')},
    labels AS (SELECT {keys}, node, sum(w * y) > sum(w * (1 - y)) AS p FROM n{Settings().max_depth} GROUP BY ALL),
    q AS (SELECT {_CONSTRAINT}, y = 1 AS y, p FROM n{Settings().max_depth} JOIN labels USING ({keys}, node) WHERE w = 0)
    {_f1("count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn", "q")}"""


def _f1(tp_fp_fn: str, source: str) -> str:
    return f"""SELECT template, first, second, tp, fp, fn,
        round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 3) AS f1
        FROM (SELECT template, first, second, {tp_fp_fn} FROM {source} GROUP BY ALL)"""


def _as_of_sql() -> str:
    """Event by event: after each one, the traces so far and the joint support of every pair so far."""
    return f"""WITH {ORDERS}, e AS (SELECT *, row_number() OVER (ORDER BY ts, seq, case_id) AS n FROM log),
    f AS (SELECT case_id, activity, min(n) AS n FROM e GROUP BY ALL),
    joined AS (SELECT x.activity AS first, y.activity AS second, greatest(x.n, y.n) AS n FROM f x JOIN f y
        ON x.case_id = y.case_id AND x.activity <> y.activity),
    per AS (SELECT first, second, n, count(*) AS more FROM joined GROUP BY ALL),
    births AS (SELECT case_id, min(n) AS n FROM e GROUP BY case_id),
    traces AS (SELECT e.n, count(births.n) OVER (ORDER BY e.n) AS traces FROM e LEFT JOIN births ON births.n = e.n),
    replay AS (SELECT p.first, p.second, t.n, t.traces, CAST(coalesce(sum(per.more) OVER w, 0) AS BIGINT) AS joint,
        CAST(ceil(round({ORDERS_SUPPORT} * t.traces, 9)) AS BIGINT) AS threshold
        FROM traces t CROSS JOIN (SELECT DISTINCT first, second FROM joined) p
        LEFT JOIN per ON per.n = t.n AND per.first = p.first AND per.second = p.second
        WINDOW w AS (PARTITION BY p.first, p.second ORDER BY t.n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    flagged AS (SELECT *, joint >= threshold AS is_in, coalesce(lag(joint >= threshold) OVER (PARTITION BY first, second ORDER BY n), false) AS was_in FROM replay)
    SELECT first, second, min(n) FILTER (is_in) AS born_n, arg_min(traces, n) FILTER (is_in) AS born_traces, arg_min(joint, n) FILTER (is_in) AS born_joint,
        arg_min(threshold, n) FILTER (is_in) AS born_threshold, count(*) FILTER (is_in AND NOT was_in) AS n_spells,
        arg_max(joint, n) AS joint_support, arg_max(threshold, n) AS threshold, arg_max(is_in, n) AS candidate
    FROM flagged GROUP BY first, second HAVING count(*) FILTER (is_in) > 0"""


def _drift_sql() -> str:
    """The windows year by year: every cut of the years so far is tested, and the part before the best one goes."""
    keys = f"version, {_CONSTRAINT}"
    n0, e0 = "list_sum(list_transform(w[:pl], lambda b: b.n))", "list_sum(list_transform(w[:pl], lambda b: b.errors))"
    n1, e1 = "list_sum(list_transform(w[pl + 1:], lambda b: b.n))", "list_sum(list_transform(w[pl + 1:], lambda b: b.errors))"
    log = f"ln(2 * greatest(ln(n0 + n1), 1.0) / {DRIFT_DELTA})"
    size, rate = "(1 / (1 / n0 + 1 / n1))", "((e0 + e1) / (n0 + n1))"
    passed = f"round(abs(e0 / n0 - e1 / n1) - (sqrt(2 / {size} * {rate} * (1 - {rate}) * {log}) + 2 / (3 * {size}) * {log}), 9)"
    return f"""WITH RECURSIVE {PLACED_V}, lr AS (SELECT vy.*, version, CASE WHEN year(ts) < version THEN 1 ELSE 0 END AS w FROM vy
        JOIN (SELECT unnest(range({ORDER_YEARS[0]}, {ORDER_YEARS[-1] + 1})) AS version) ON year(ts) <= version), {_tree_ctes(keys, 'lr')},
    labels AS (SELECT {keys}, node, sum(w * y) > sum(w * (1 - y)) AS p FROM n{Settings().max_depth} GROUP BY ALL),
    q AS MATERIALIZED (SELECT {_CONSTRAINT}, version AS batch, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER ((y = 1) <> p) AS DOUBLE) AS errors,
        row_number() OVER (PARTITION BY {_CONSTRAINT} ORDER BY version) AS k
        FROM n{Settings().max_depth} JOIN labels USING ({keys}, node) WHERE w = 0 GROUP BY {_CONSTRAINT}, version),
    fold AS (
        SELECT {_CONSTRAINT}, 0::BIGINT AS k, []::STRUCT(batch BIGINT, n DOUBLE, errors DOUBLE)[] AS w, 0::BIGINT AS dropped FROM (SELECT DISTINCT {_CONSTRAINT} FROM q)
        UNION ALL
        SELECT {_CONSTRAINT}, k, w[coalesce(pl, 0) + 1:], coalesce(pl, 0) FROM (
            SELECT {_CONSTRAINT}, k, w, (SELECT arg_max(pl, (exceeds, pl)) FROM (SELECT pl, {passed} AS exceeds FROM (
                SELECT pl, {n0} AS n0, {e0} AS e0, {n1} AS n1, {e1} AS e1 FROM (SELECT unnest(range(1, len(w))) AS pl))) WHERE exceeds > 0) AS pl
            FROM (SELECT fold.template, fold.first, fold.second, q.k, list_append(fold.w, {{'batch': q.batch, 'n': q.n, 'errors': q.errors}}) AS w
                FROM fold JOIN q ON q.template = fold.template AND q.first = fold.first AND q.second = fold.second AND q.k = fold.k + 1)))
    SELECT {_CONSTRAINT}, batch, CAST(n AS BIGINT) AS n, CAST(errors AS BIGINT) AS errors, w[1].batch AS window_start,
        CAST(list_sum(list_transform(w, lambda b: b.n)) AS BIGINT) AS window_n,
        CAST(list_sum(list_transform(w, lambda b: b.errors)) AS BIGINT) AS window_errors, dropped > 0 AS drift
    FROM fold JOIN q USING ({_CONSTRAINT}, k)"""


def _lossy(log: str, tail: str) -> str:
    return f"""WITH RECURSIVE {log},
    g AS (SELECT *, row_number() OVER (ORDER BY ts, seq, case_id) AS n FROM log),
    e AS (SELECT *, (n + 4) // 5 AS bucket, row_number() OVER (PARTITION BY case_id ORDER BY n) AS p FROM g),
    f AS (SELECT case_id, p, n, bucket, bucket AS s, false AS kept FROM e WHERE p = 1
        UNION ALL SELECT e.case_id, e.p, e.n, e.bucket,
            CASE WHEN f.s <= e.bucket - 1 THEN e.bucket ELSE f.s + 1 END, f.s > e.bucket - 1
        FROM f JOIN e ON e.case_id = f.case_id AND e.p = f.p + 1),
    kept AS (SELECT e.* FROM e JOIN f ON e.n = f.n WHERE f.kept){tail}"""


def all_sql() -> dict[str, str]:
    sql = {
        "log_metrics": f"WITH {EVENTS} {STATS}",
        "running_log_metrics": f"""WITH {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY case_id
            ORDER BY ts, seq) AS pos FROM log)
            SELECT count(*) OVER g AS "Event_counter", min(ts) OVER g AS "Log_start_timestamp",
            max(ts) OVER g AS "Log_end_timestamp", count(*) FILTER (pos = 1) OVER g AS "Counter_trace_id" FROM o
            WINDOW g AS (ORDER BY ts, seq, case_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "activity_frequency": f"""WITH {EVENTS} SELECT activity AS "Activity", count(*) AS "Frequency" FROM log GROUP BY 1""",
        "traces_per_activity": f"""WITH {ORDERS} SELECT activity AS "Activity",
            count(DISTINCT case_id) AS "Trace_count" FROM log GROUP BY 1""",
        "activity_stats_union": f"""WITH {ORDERS}, s AS ({STATS})
            SELECT 'log_metrics' AS kind, "Event_counter", "Counter_trace_id", "Log_start_timestamp", "Log_end_timestamp",
            CAST(NULL AS VARCHAR) AS "Activity", CAST(NULL AS BIGINT) AS "Frequency", CAST(NULL AS BIGINT) AS "Trace_count" FROM s
            UNION ALL SELECT 'activity', NULL, NULL, NULL, NULL, activity, count(*), count(DISTINCT case_id) FROM log GROUP BY activity""",
        "ranked_activities": f"""WITH {ORDERS} SELECT activity AS "Activity", count(*) AS "Frequency",
            count(DISTINCT case_id) AS "Trace_count" FROM log GROUP BY 1 ORDER BY 2 DESC, 1""",
        "end_tagging": f"""WITH {ORDERS} SELECT case_id, seq, activity, row_number() OVER (PARTITION BY case_id
            ORDER BY ts DESC, seq DESC) = 1 AS is_end FROM log""",
        "time_sorted_log": f"WITH {ORDERS} SELECT case_id, activity, ts, seq FROM log ORDER BY ts, seq",
        "trace_history": f"""WITH {EVENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, seq) AS pos FROM log)
            SELECT case_id, (pos - 1) // 50 AS chunk, min(pos) AS start_pos,
            string_agg(activity, '>' ORDER BY pos) AS activities FROM o GROUP BY 1, 2""",
        "neighbours": f"""WITH {EVENTS} SELECT case_id, row_number() OVER o AS pos, activity,
            lag(activity) OVER o AS previous_activity, lead(activity) OVER o AS next_activity FROM log
            WINDOW o AS (PARTITION BY case_id ORDER BY ts, seq)""",
        "typed_attributes": f"""WITH {ORDERS} SELECT seq, 'o_totalprice' AS attr, price AS num, CAST(NULL AS BOOLEAN) AS bool,
            CAST(NULL AS VARCHAR) AS str FROM log UNION ALL SELECT seq, 'o_orderstatus', NULL, NULL, status FROM log""",
        "wire_events": f"""WITH {EVENTS} SELECT case_id AS case_concept_name, activity AS concept_name,
            strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time_text, k, 'False' AS is_end_event FROM log""",
        "wire_round_trip": f"WITH {EVENTS} SELECT case_id, activity, epoch_us(ts) // 1000 AS millis, epoch_us(ts) AS micros, false AS is_end, k FROM log",
        "clock_times": f"WITH {EVENTS} SELECT seq, strftime(ts, '%H:%M:%S %d-%m-%Y') AS clock FROM log",
        "json_records": f"""WITH {EVENTS} SELECT seq, '{{"case_id":"' || case_id || '","activity":"' || activity || '","seq":' || seq || '}}'
            AS record FROM log""",
        "lossy_sampled_events": _lossy(ORDERS, " SELECT case_id, activity, seq, n, bucket FROM kept"),
        "lossy_sampled_frequency": _lossy(EVENTS, """ SELECT activity AS "Activity", count(*) AS "Frequency",
            count(DISTINCT case_id) AS "Trace_count" FROM kept GROUP BY 1"""),
        "frequent_activities": f"""WITH {CONVERSATIONS}, {pairs_cte(0.4)}
            SELECT activity, s AS support, t AS threshold FROM sup, thr WHERE s >= t""",
        "joint_support": f"WITH {ORDERS}, {ORDER_PAIRS} SELECT a AS first, b AS second, j AS joint_support FROM js",
        "candidate_pairs": f"""WITH {ORDERS}, {ORDER_PAIRS}
            SELECT a AS first, b AS second, j AS joint_support, t AS threshold FROM pairs""",
        "candidates_as_of": _as_of_sql(),
        "candidate_events": f"""WITH {ORDERS}, {ORDER_PAIRS}, o AS (SELECT *, row_number() OVER
            (PARTITION BY case_id ORDER BY ts, seq) AS pos FROM log), r AS (
            SELECT a AS own, b AS other, true AS f, false AS s FROM pairs UNION ALL SELECT b, a, false, true FROM pairs)
            SELECT case_id, pos, activity, other, bool_or(f) AS as_first, bool_or(s) AS as_second
            FROM o JOIN r ON activity = own GROUP BY ALL""",
        "template_expansion": f"""WITH {ORDERS} SELECT template, activity, count(*) AS n FROM log, (SELECT unnest(
            ['Response', 'Alternate Response', 'Chain Response', 'Precedence', 'Alternate Precedence',
            'Chain Precedence', 'Responded Existence']) AS template) GROUP BY 1, 2""",
        "negated_constraints": f"""WITH {ORDER_V}, {NEGATED}
            SELECT template, first, second, verdict, count(*) AS n FROM vn GROUP BY ALL""",
        "constraint_ratios": f"""WITH {EVENT_V}, {NEGATED}
            SELECT template || '[' || first || ', ' || second || ']' AS "constraint", count(*) AS n_activations,
            count(*) FILTER (verdict = 'fulfilled') AS n_fulfilled, CAST(0 AS BIGINT) AS n_pending,
            CASE WHEN template LIKE 'Not %' THEN
                round(1 - round_even(count(*) FILTER (verdict = 'violated') / count(*), 3), 3)
                ELSE round_even(count(*) FILTER (verdict = 'fulfilled') / count(*), 3) END AS ratio
            FROM vn GROUP BY template, first, second""",
        "sampled_constraint_ratios": _lossy(
            EVENTS.replace("log AS", "log AS", 1),
            f""", whole AS (SELECT * FROM log), {EVENT_PAIRS},
            {verdict_cte().replace("FROM log)", "FROM kept)")}
            SELECT template, first, second, count(*) AS n_activations,
            count(*) FILTER (verdict = 'fulfilled') AS n_fulfilled,
            round_even(count(*) FILTER (verdict = 'fulfilled') / count(*), 3) AS ratio FROM v GROUP BY ALL""",
        ),
        "running_ratios": f"""WITH {ORDER_V}, {RUNNING} SELECT template, first, second, case_id, pos, verdict,
            n_activations, n_fulfilled, round_even(n_fulfilled / n_activations, 3) AS ratio FROM run""",
        "open_traces_pending": f"""WITH {ORDERS}, {ORDER_PAIRS},
            {verdict_cte(closed="end_ts < TIMESTAMP '2000-06-01'")}
            SELECT template, first, second, count(*) FILTER (verdict <> 'pending') AS n_activations,
            count(*) FILTER (verdict = 'fulfilled') AS n_fulfilled, count(*) FILTER (verdict = 'pending') AS n_pending,
            round_even(count(*) FILTER (verdict = 'fulfilled') / count(*), 3) AS ratio FROM v GROUP BY ALL""",
        "condition_filter": f"""WITH {ORDERS}, {CONDITIONS}
            SELECT seq, label, condition, {HOLDS} AS holds FROM log, conds""",
        "data_aware_ratios": f"""WITH {ORDER_V}, {NEGATED}, {CONDITIONS}
            {DATA_AWARE.format(holds=HOLDS, group='')}""",
        "rule_replay": _replay_sql(True),
        "rule_replay_separate": _replay_sql(False),
        "majority_f1": f"""WITH {ORDER_V}, {RUNNING}, q AS (SELECT template, first, second, verdict = 'fulfilled' AS y,
            2 * (n_fulfilled - CASE WHEN verdict = 'fulfilled' THEN 1 ELSE 0 END) > n_activations - 1 AS p FROM run)
            {_f1("count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn", "q")}""",
        "prequential_f1": _prequential_sql(),
        "condition_f1": f"""WITH {ORDER_V}, {NEGATED}, {CONDITIONS}, q AS (SELECT template, first, second, label, verdict = 'fulfilled' AS y,
            ({HOLDS}) AS p FROM vn, conds), c AS (SELECT template, first, second, label, count(*) FILTER (y AND p) AS tp,
            count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn FROM q GROUP BY ALL)
            SELECT *, round_even(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 3) AS f1 FROM c""",
        "leaf_class_totals": f"{_leaves_sql()} SELECT * FROM leaves",
        "learned_conditions": _learned_sql(),
        "split_statistics": _split_sql(),
        "result_records": f"""WITH {RECORDS} SELECT "constraint" AS "Constraint", condition AS "Data Condition",
            n_activations AS "# Activations No Data", ratio AS "Fulfilment Ratio No Data",
            n_activations_data AS "# Activations Data", printf('%.3f', ratio_data) AS "Fulfilment Ratio Data"
            FROM rec""",
        "jsonl_round_trip": f"""WITH {RECORDS} SELECT "constraint", condition, n_activations, ratio, n_activations_data,
            CAST(printf('%.3f', ratio_data) AS DOUBLE) AS ratio_data FROM rec""",
        "count_windows": f"""WITH {RECORDS}, q AS (SELECT *, (row_number() OVER (ORDER BY run, template, first, second) - 1) // 10
            AS window_id FROM rec) SELECT window_id, count(*) AS n, CAST(sum(n_activations) AS BIGINT) AS n_activations,
            min(run) AS first_run FROM q GROUP BY 1 HAVING count(*) = 10""",
        "distinct_model": f"""WITH {RECORDS} SELECT template, first, second, condition, run, n_activations FROM rec
            QUALIFY row_number() OVER (PARTITION BY template, first, second, condition ORDER BY run) = 1""",
        "model_edges": f"""WITH {RECORDS} SELECT DISTINCT template, first AS src, second AS dst, condition,
            CASE WHEN template LIKE '%Precedence%' THEN 'left' ELSE 'right' END AS label_side FROM rec WHERE ratio_data > 0.5""",
        "model_nodes": f"""WITH {RECORDS} SELECT first AS id FROM rec WHERE ratio_data > 0.5
            UNION SELECT second FROM rec WHERE ratio_data > 0.5""",
        "latest_stats": f"WITH {ORDERS} {STATS}",
        "upsert_activity": f"""WITH {EVENTS}, h AS (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, activity AS "Activity",
            count(*) AS "Frequency" FROM log GROUP BY 1, 2)
            SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY "Activity" ORDER BY hour DESC) = 1""",
        "dedupe_results": f"""WITH {RECORDS} SELECT "constraint", condition, n_activations, ratio, ratio_data, max(run) AS run
            FROM rec GROUP BY 1, 2, 3, 4, 5""",
        "best_run_per_constraint": f"""WITH {BEST} SELECT "constraint", run, condition, n_activations, ratio,
            n_activations_data, ratio_data FROM best""",
        "diff_summary": f"""WITH {BEST} SELECT count(*) AS total, count(*) FILTER (diff > 0) AS higher_without_data,
            count(*) FILTER (diff < 0) AS higher_with_data, count(*) FILTER (diff = 0) AS ties FROM d""",
        "diff_describe": f"""WITH {BEST} SELECT count(*) AS count, round(avg(diff), 6) AS mean,
            round(stddev_samp(diff), 6) AS std, min(diff) AS min, round(quantile_cont(diff, 0.25), 6) AS p25,
            round(quantile_cont(diff, 0.5), 6) AS p50, round(quantile_cont(diff, 0.75), 6) AS p75, max(diff) AS max FROM d""",
        "diff_histogram": f"""WITH {BEST}, m AS (SELECT min(diff) AS lo, max(diff) AS hi FROM d)
            SELECT CASE WHEN lo = hi THEN 1 ELSE least(CAST(floor(20 * (diff - lo) / (hi - lo)) AS BIGINT) + 1, 20) END AS bin,
            count(*) AS n FROM d, m GROUP BY 1""",
        "ranked_diffs": f"""WITH {BEST} SELECT "constraint", run, diff FROM d WHERE diff < 0 ORDER BY diff, "constraint" """,
        "positive_diffs": f"""WITH {BEST} SELECT "constraint", run, diff FROM d WHERE diff > 0 ORDER BY diff DESC, "constraint" """,
        "diff_extremes": f"""WITH {RECORDS}, q AS (SELECT "constraint", run, round(ratio - ratio_data, 3) AS diff
            FROM rec WHERE ratio_data > 0.0), p AS (SELECT * FROM q WHERE diff > 0)
            SELECT "constraint", run, diff FROM p QUALIFY row_number() OVER (PARTITION BY "constraint" ORDER BY diff, run) = 1
            OR row_number() OVER (PARTITION BY "constraint" ORDER BY diff DESC, run DESC) = 1""",
    }
    sql["drift_windows"] = _drift_sql()
    sql["streamed_lossy_events"] = sql["lossy_sampled_events"]
    sql["streamed_statistics"] = f"""WITH {EVENTS} SELECT activity AS "Activity", count(*) AS "Frequency",
        count(DISTINCT case_id) AS "Trace_count" FROM log GROUP BY 1"""
    sql["streamed_constraint_ratios"] = f"""WITH {CONVERSATIONS}, {pairs_cte(0.4)}, {verdict_cte()} SELECT template, first, second, count(*) AS n_activations,
        count(*) FILTER (verdict = 'fulfilled') AS n_fulfilled,
        round_even(count(*) FILTER (verdict = 'fulfilled') / count(*), 3) AS ratio FROM v GROUP BY ALL"""
    for name in (
        "Response", "Alternate Response", "Chain Response", "Precedence", "Alternate Precedence",
        "Chain Precedence", "Responded Existence",
    ):
        sql[name.lower().replace(" ", "_")] = f"""WITH {EVENT_V}
            SELECT first, second, case_id, pos, verdict FROM v WHERE template = '{name}'"""
    return sql
