"""SQL counterparts of the registered queries, where SQL can express them."""

from __future__ import annotations

from caseweave.llm import license_scan, line_dedup, mixing, quality_rules, spelling_variants

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


def _fail_bits() -> str:
    return " + ".join(f"CASE WHEN {r.fails} THEN {quality_rules.BIT[r.name]} ELSE 0 END" for r in quality_rules.RULES)


def op2() -> str:
    base, full = quality_rules.policy_mask("base"), quality_rules.policy_mask("v2")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, row_number() OVER () AS r FROM documents),
grams AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS p FROM twice, generate_series(0, 7) AS s(j)) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim,
    len(list_filter(list_zip(w[:-2], w[2:]), lambda p: p[1] = p[2])) AS n_stutter
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM d)
  LEFT JOIN covered USING (r)),
b AS (SELECT *, {_fail_bits()} AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {base}) <> 0 AS base_failed,
  (fail_bits & {full}) = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b"""


def op3() -> str:
    """Windows and chunks of every document, the first place of each text, and the lines beyond it."""
    d, long_, few = line_dedup.DIVISOR, line_dedup.LONG_WORDS, line_dedup.MIN_WORDS
    prime, base = line_dedup._PRIME, line_dedup._BASE
    words = r"len(list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"
    return f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT r, doc_id, unnest(generate_series(1, len(s))) AS i, unnest(s) AS line FROM d WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, {words.format('line')} AS w FROM l),
e AS MATERIALIZED (SELECT *, w > {long_} AS long, sum(w) OVER (PARTITION BY r ORDER BY i) AS cum,
    ((coalesce(lag(h) OVER o, 0) % {prime}) * {base} + h % {prime}) % {prime} % {d} = 0 OR w > {long_}
    OR coalesce(lead(w) OVER o > {long_}, false) AS last FROM h WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT *, coalesce(sum(last::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
runs AS MATERIALIZED (
  SELECT r, doc_id, min(i) AS start, max(i) AS stop FROM c GROUP BY r, doc_id, c HAVING count(*) > 1 AND sum(w) >= {few}
  UNION SELECT a.r, a.doc_id, a.i, min(b.i) FROM e a JOIN e b ON a.r = b.r AND b.i >= a.i AND b.cum - a.cum + a.w > {long_} GROUP BY a.r, a.doc_id, a.i
  UNION SELECT b.r, b.doc_id, max(a.i), b.i FROM e a JOIN e b ON a.r = b.r AND b.i >= a.i AND b.cum - a.cum + a.w > {long_} GROUP BY b.r, b.doc_id, b.i),
t AS MATERIALIZED (SELECT r, runs.doc_id, start, stop, array_to_string(s[start:stop], chr(10)) AS body FROM runs JOIN d USING (r)),
f AS (SELECT body, min(doc_id) AS first_id FROM t GROUP BY body HAVING count(*) > 1),
p AS (SELECT t.*, t.doc_id = first_id AS is_first, min(start) OVER (PARTITION BY r, body) AS first FROM t JOIN f USING (body)),
gone AS (SELECT DISTINCT r, unnest(generate_series(CASE WHEN is_first THEN greatest(start, first + stop - start + 1) ELSE start END, stop)) AS i
  FROM p WHERE NOT is_first OR start > first),
left_ AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS lines, count(*) FILTER (before IS NULL OR before < i - 1) AS runs
  FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM gone) GROUP BY r)
SELECT doc_id, coalesce(lines, 0) AS n_lines_removed, coalesce(runs, 0) AS n_chunks_removed,
  length(x) AS n_chars, sha256(x) AS text_sha256
FROM (SELECT d.doc_id, lines, runs, CASE WHEN d.text IS NOT NULL THEN coalesce(left_.text, '') END AS x
  FROM d LEFT JOIN left_ USING (r) LEFT JOIN n USING (r))"""


def op4(budget_share: float = 0.5) -> str:
    dims = mixing.DIMENSIONS
    cols = ", ".join(dims)
    words = r"len(list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))"
    targets = ", ".join(f"sqrt(sum(tokens) OVER (PARTITION BY {d})) AS w_{d}, row_number() OVER (PARTITION BY {d} ORDER BY {cols}) AS k_{d}" for d in dims)
    shares = ", ".join(f"w_{d} / sum(CASE WHEN k_{d} = 1 THEN w_{d} ELSE 0 END) OVER () AS t_{d}" for d in dims)
    steps, last = [], "r0"
    for i in range(mixing.ROUNDS):
        for d in dims:
            name = f"r{i}_{d}"
            steps.append(f"{name} AS (SELECT * EXCLUDE (w), CASE WHEN h > 0 THEN w * t_{d} / h ELSE 0 END AS w FROM "
                         f"(SELECT * EXCLUDE (h), sum(w) OVER (PARTITION BY {d}) AS h FROM {last}))")
            last = name
    return f"""
WITH d AS (SELECT doc_id, text, coalesce(text, '') AS t, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang FROM documents),
x AS (SELECT *, {words} AS tokens, length(t) AS size, length(regexp_replace(t, '[^#*$%&|<>=]', '', 'g')) AS signs FROM d),
y AS (SELECT *, CASE WHEN size = 0 THEN 'empty' WHEN signs * 20 > size THEN 'markup' WHEN size < 500 THEN 'note'
  WHEN size < 4000 THEN 'article' ELSE 'long read' END AS topic FROM x),
c AS (SELECT {cols}, sum(tokens)::DOUBLE AS tokens FROM y GROUP BY ALL),
c1 AS (SELECT *, {targets} FROM c),
r0 AS (SELECT {cols}, tokens, {shares}, tokens / sum(tokens) OVER () AS w, 0.0::DOUBLE AS h FROM c1),
{", ".join(steps)},
n AS (SELECT *, CASE WHEN w > 0 THEN tokens / w END AS need, sum(tokens) OVER () * {budget_share} AS budget FROM {last}),
f AS (SELECT *, coalesce(sum(tokens) FILTER (need IS NOT NULL) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM n WINDOW o AS (ORDER BY need NULLS FIRST, {cols})),
s AS (SELECT *, CASE WHEN need IS NOT NULL AND rest > 1e-12 AND (budget - before) / rest < need THEN (budget - before) / rest END AS fits FROM f),
z AS (SELECT *, (SELECT arg_min(fits, need) FROM s WHERE fits IS NOT NULL) AS scale FROM s),
p AS (SELECT {cols}, CASE WHEN need IS NULL THEN 0.0 WHEN scale IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, scale / need)) END AS p FROM z)
SELECT doc_id, {cols}, round(p, 6) AS p,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || t)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < p AS drawn
FROM y JOIN p USING ({cols})"""


def op7(threshold: float = 0.93) -> str:
    """Components by propagation of minima along the links."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS l FROM u),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= {threshold}),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT link.b, r FROM reach JOIN link ON id = a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
k AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = id LEFT JOIN k ON vec_id = a"""


def op9() -> str:
    templates = ", ".join(
        f"({i}, '{t.label}', '{t.text}', {t.exact})" for i, t in enumerate(license_scan.PHRASES + license_scan.NOTICES)
    )
    words = r"list_filter(string_split_regex(lower({}), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE t AS (SELECT id, label, exact, {words.format('body')} AS w FROM (VALUES {templates}) AS v(id, label, body, exact)),
tg AS (SELECT id, label, exact, len(w) - 1 AS n, i - 1 AS at_, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM t)),
d AS (SELECT doc_id, row_number() OVER () AS r, {words.format("coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT r, i - 1 AS place, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d)),
hit AS MATERIALIZED (SELECT r, id, label, exact, n, place, at_, place - at_ AS diag FROM dg JOIN tg USING (g)),
votes AS (SELECT r, id, label, exact, n, diag, count(*) AS v, min(place) AS f, max(place) AS l FROM hit GROUP BY ALL),
phrase AS (SELECT r, label, f AS start, true AS exact, 1.0::DOUBLE AS cover FROM votes WHERE exact AND v = n),
grp AS (SELECT *, sum(new) OVER (PARTITION BY r, id ORDER BY diag) AS grp FROM (
  SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, id ORDER BY diag) <= 2 THEN 0 ELSE 1 END AS new
  FROM votes WHERE NOT exact AND (v > 1 OR n = 1))),
span AS MATERIALIZED (SELECT r, id, grp, label, n, min(f) AS start FROM grp GROUP BY r, id, label, n, grp
  HAVING sum(v) / n >= 0.7 AND max(l) + 2 - min(f) <= n + 5 + n / 2),
inside AS MATERIALIZED (SELECT r, id, grp, place, at_ FROM hit JOIN grp USING (r, id, diag) JOIN span USING (r, id, grp)),
run AS (SELECT r, id, grp, place, at_, 1 AS k FROM inside UNION
  SELECT i.r, i.id, i.grp, i.place, i.at_, k + 1 FROM run JOIN inside i USING (r, id, grp) WHERE i.place > run.place AND i.at_ > run.at_),
notice AS (SELECT r, label, start, false AS exact, (max(k) / n)::DOUBLE AS cover FROM run JOIN span USING (r, id, grp)
  GROUP BY r, id, grp, label, n, start HAVING max(k) / n >= 0.7),
s AS (SELECT * FROM phrase UNION ALL SELECT * FROM notice),
a AS (SELECT r, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al, max(cover) AS score
  FROM s GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN a USING (r)"""


def op10(k: int = 3, num: int = 9, den: int = 10) -> str:
    """All pairs that share a shingle, and components by propagation of minima along the links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = _WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')")
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < {k} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {k - 1}], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {k - 1}, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * i >= {num} * (x.n + y.n - i)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT link.b, r FROM reach JOIN link ON id = a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN c ON d.doc_id = c.id LEFT JOIN n ON n.doc_id = d.doc_id"""


#: crc32 by its definition: the table of 256 remainders, then one look-up for each byte.
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc(text: str) -> str:
    """Needs ``crc`` in scope; bytes of the UTF-8 text, two hex digits each."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def op11() -> str:
    """Words equal after deleting the character at the same place differ by a replacement; a word that is another's rest by a deletion."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{spelling_variants.RUN}]+')) AS run FROM documents),
low AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, '{upper}', '{upper.lower()}') AS run FROM runs WHERE length(run) >= {spelling_variants.MIN_LENGTH}),
keyed AS (SELECT run, {_crc("id || ':' || run")} AS h FROM low, crc),
cut AS (SELECT CASE WHEN h % {spelling_variants.DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM keyed),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM cut WHERE length(word) >= {spelling_variants.MIN_LENGTH} GROUP BY word HAVING count(*) >= {spelling_variants.MIN_COUNT}),
one AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) AS s(i)),
near AS (
  SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM one a JOIN one b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM one a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM one a JOIN w b ON a.rest = b.word),
g AS (SELECT a, count(*) AS n_near, arg_min(b, (-nb, b)) AS top, max(nb) AS top_n FROM near GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= {spelling_variants.TIMES} * n THEN top END AS form,
  CASE WHEN top_n >= {spelling_variants.TIMES} * n THEN top_n END AS form_n FROM w LEFT JOIN g ON word = a),
path AS (SELECT word, word AS here, 0 AS k FROM f UNION ALL SELECT path.word, f.form, k + 1 FROM path JOIN f ON f.word = path.here WHERE f.form IS NOT NULL),
r AS (SELECT word, arg_max(here, k) AS root FROM path GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON f.word = r.word"""


def op13() -> str:
    """The cheapest edits row by row, for each of four states; then a walk along the audit."""
    solid = "[^ \\t\\n\\x0B\\f\\r]"
    add = lambda s, cost, letter: f"CASE WHEN {s} < '~' THEN lpad((substr({s}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({s}, 10) || '{letter}' ELSE '~' END"
    cut = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END"
    free = "fault NOT IN ('blank', 'duplicate')"

    def closed(s: list[str]) -> list[str]:
        """Insertions: an open pair from 0, 1 or 3, a closed one from what is then open."""
        two = f"least({s[2]}, {add(s[0], 2, 'I')}, {add(s[1], 2, 'I')}, {add(s[3], 2, 'I')})"
        return [s[0], s[1], two, f"least({s[3]}, {add(two, 2, 'I')})"]

    def to(state: int, initial: str, sources: tuple[int, ...], reroled: bool) -> str:
        """Row k read from one of ``sources`` into ``state``, or deleted in it."""
        old = closed(["s0", "s1", "s2", "s3"])
        ways = [add(f"({old[state]})", 3, "D")]
        for q in sources:
            keep = f"CASE WHEN {free} AND i = '{initial}' THEN {add(f'({old[q]})', f'({cut})', 'K')} ELSE '~' END"
            ways.append(keep)
            if reroled:
                ways.append(f"CASE WHEN {free} THEN {add(f'({old[q]})', f'(2 + {cut})', 'R')} ELSE '~' END")
        return f"least({', '.join(ways)})"

    last = closed(["s0", "s1", "s2", "s3"])
    return f"""
WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
all_ids AS (SELECT DISTINCT conv_id, dense_rank() OVER (ORDER BY conv_id) AS c FROM conversations),
live AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(z)),
o AS (SELECT c, turn, role, text, substr(role, 1, 1) AS i, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS k
  FROM live JOIN all_ids ON live.conv_id IS NOT DISTINCT FROM all_ids.conv_id),
rows_ AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '{solid}') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ \\t\\n\\x0B\\f\\r]*\\z') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN lag(i) OVER (PARTITION BY c ORDER BY k) || i NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM o),
dp AS (
  SELECT c, 0::BIGINT AS k, '000000000' AS s0, '~' AS s1, '~' AS s2, '~' AS s3 FROM all_ids
  UNION ALL
  SELECT dp.c, dp.k + 1, {to(0, '', (), False)}, {to(1, 's', (0,), False)}, {to(2, 'u', (0, 1, 3), True)}, {to(3, 'a', (2,), True)}
  FROM dp JOIN rows_ ON rows_.c = dp.c AND rows_.k = dp.k + 1),
best AS MATERIALIZED (SELECT c, substr(b, 1, 9)::BIGINT AS cost, substr(b, 10) AS audit
  FROM (SELECT c, least({last[0]}, {last[3]}) AS b FROM dp QUALIFY row_number() OVER (PARTITION BY c ORDER BY k DESC) = 1)),
walk AS (
  SELECT c, audit, 1 AS nth, 0::BIGINT AS k, 0 AS state, ''::VARCHAR AS body FROM best
  UNION ALL
  SELECT w.c, w.audit, w.nth + 1, w.k + CASE WHEN e <> 'I' THEN 1 ELSE 0 END,
    CASE WHEN e = 'D' THEN w.state WHEN e = 'K' AND i = 's' THEN 1 WHEN w.state = 2 THEN 3 ELSE 2 END,
    CASE WHEN e = 'D' THEN w.body ELSE w.body || CASE WHEN w.state = 0 THEN '' ELSE chr(10) END
      || CASE WHEN e = 'K' THEN role WHEN w.state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END
  FROM (SELECT *, substr(audit, nth, 1) AS e FROM walk WHERE nth <= length(audit)) w
  LEFT JOIN rows_ r ON e <> 'I' AND r.c = w.c AND r.k = w.k + 1),
done AS (SELECT c, body FROM walk WHERE nth > length(audit)),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, sum(illegal)::BIGINT AS illegal FROM rows_ GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cost, audit, sha256(body) AS repaired_sha256
FROM all_ids LEFT JOIN sums USING (c) JOIN best USING (c) JOIN done USING (c)"""


def all_sql() -> dict[str, str]:
    return {"op2_quality_rules": op2(), "op3_line_dedup": op3(), "op4_mixing": op4(), "op7_embedding_dedup": op7(), "op9_license_scan": op9(),
            "op10_jaccard_join": op10(), "op11_spelling_variants": op11(), "op13_conversation_repair": op13()}
