"""DuckDB SQL for the oracle check: the same views as ``lexivec.sources.tables``
and the same query semantics as ``lexivec.plans.catalog``, written
independently in SQL (cross joins and self joins are fine here: this only
runs on the small check scale)."""

from __future__ import annotations

NONLETTER = "[^\\p{L}]+"

TAG = "CASE length({t}) % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'V' ELSE 'J' END"


def tag(t: str) -> str:
    return f"{t} || '/' || " + TAG.format(t=t)


SENT = f"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
sent AS (
  SELECT doc_id, line_no,
         list_transform(list_filter(regexp_split_to_array(lower(line), '{NONLETTER}'), lambda x: x <> ''),
                        lambda t: {tag('t')}) AS toks
  FROM lines),
stok AS (
  SELECT doc_id, line_no, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
  FROM sent WHERE len(toks) > 0),
pairs AS (
  SELECT a.tok AS entry, 'T:' || b.tok AS feature
  FROM stok a JOIN stok b
    ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND abs(a.pos - b.pos) BETWEEN 1 AND 2),
counts AS (SELECT entry, feature, count(*) AS n FROM pairs GROUP BY entry, feature)"""

FILT = SENT + """,
kept AS (SELECT feature FROM counts GROUP BY feature HAVING sum(n) >= 40),
filt AS (SELECT entry, feature, n FROM counts WHERE n >= 15 AND feature IN (SELECT feature FROM kept)),
marg AS (
  SELECT entry, feature, n,
         CAST(sum(n) OVER (PARTITION BY entry) AS BIGINT) AS entry_total,
         CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS feature_total,
         CAST(sum(n) OVER () AS BIGINT) AS total
  FROM filt),
ppmi AS (
  SELECT entry, feature,
         greatest(ln(n::DOUBLE * total / (entry_total::DOUBLE * feature_total)), 0.0) AS weight
  FROM marg)"""

CORPUS = f"""
clines AS (
  SELECT doc_id, source AS file, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
corpus AS (
  SELECT file, doc_id, line_no, toks FROM (
    SELECT file, doc_id, line_no,
           list_transform(list_filter(regexp_split_to_array(line, '[ \\t]+'),
                                      lambda x: regexp_matches(x, '^[^/_]+$')),
                          lambda t: {tag('lower(t)')}) AS toks
    FROM clines) WHERE len(toks) > 8)"""

SQL = {}

SQL["cooc_counts"] = "WITH " + FILT + """
SELECT entry, feature, n, entry_total, feature_total FROM marg"""

SQL["ppmi_top_contexts"] = "WITH " + FILT + """,
r AS (SELECT entry, feature, weight,
             row_number() OVER (PARTITION BY entry ORDER BY weight DESC, feature ASC) AS rank
      FROM ppmi WHERE weight > 0)
SELECT entry, feature, CAST(rank AS BIGINT) AS rank, round(weight, 6) AS ppmi FROM r WHERE rank <= 10"""

SQL["vocab_mincount"] = "WITH " + CORPUS + """
SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM corpus)
GROUP BY token HAVING count(*) >= 50"""

SQL["type_quota"] = "WITH " + SENT + """,
freq AS (
  SELECT entry, CAST(sum(n) AS BIGINT) AS total,
         CASE WHEN regexp_matches(entry, '^[^/_]+/[A-Z]+$')
              THEN regexp_extract(entry, '^([^/_]+)/([A-Z]+)$', 2) ELSE 'EMPTY' END AS type
  FROM counts GROUP BY entry),
quota AS (SELECT * FROM (VALUES ('N', 200000), ('V', 200000), ('J', 100000), ('RB', 0), ('AN', 0), ('NN', 0)) q(type, quota)),
r AS (
  SELECT f.entry, f.type, f.total, q.quota,
         row_number() OVER (PARTITION BY f.type ORDER BY f.total DESC, f.entry ASC) AS rank
  FROM freq f JOIN quota q ON f.type = q.type WHERE q.quota > 0)
SELECT entry, type, total, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= quota"""

# ---- composition ------------------------------------------------------------------

TOKEN_RE = "'^([^/_]+)/([A-Z]+)$'"


def ftype(f: str) -> str:
    toks = f"string_split({f}, '_')"
    tags = f"array_to_string(list_transform({toks}, lambda t: regexp_extract(t, {TOKEN_RE}, 2)), ',')"
    bad = f"len(list_filter({toks}, lambda t: NOT regexp_matches(t, {TOKEN_RE}))) > 0"
    return (f"CASE WHEN {bad} OR len({toks}) > 3 THEN 'EMPTY' WHEN len({toks}) = 1 THEN '1-GRAM' "
            f"WHEN len({toks}) = 2 AND {tags} = 'J,N' THEN 'AN' "
            f"WHEN len({toks}) = 2 AND {tags} = 'N,N' THEN 'NN' "
            f"WHEN len({toks}) = 2 AND {tags} = 'V,N' THEN 'VO' "
            f"WHEN len({toks}) = 2 THEN '2-GRAM' WHEN {tags} = 'N,V,N' THEN 'SVO' ELSE '3-GRAM' END")


COMPOSABLE = "('2-GRAM', '3-GRAM', 'AN', 'NN', 'VO', 'SVO')"

LEX = """
etag AS (SELECT vec_id, embedding,
                CASE WHEN label < 7 THEN 'N' WHEN label < 9 THEN 'J' ELSE 'V' END AS tag
         FROM embeddings),
lex AS (SELECT 'w' || CAST(vec_id AS VARCHAR) || '/' || tag AS entry, vec_id,
               list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM etag),
ph AS (
  SELECT 'w' || CAST(vec_id AS VARCHAR) || '/' || tag || '_w' || CAST((vec_id * 7 + 1) % (SELECT count(*) FROM embeddings) AS VARCHAR) || '/N'
           AS phrase, vec_id * 2 AS ord FROM etag
  UNION ALL
  SELECT 'w' || CAST((vec_id * 3 + 2) % (SELECT count(*) FROM embeddings) AS VARCHAR) || '/N_w' || CAST(vec_id AS VARCHAR) || '/' || tag
           || '_w' || CAST((vec_id * 11 + 5) % (SELECT count(*) FROM embeddings) AS VARCHAR) || '/N', vec_id * 2 + 1 FROM etag),
ptype AS (SELECT phrase, ord, """ + ftype("phrase") + """ AS type FROM ph),
ptok AS (SELECT phrase, unnest(string_split(phrase, '_')) AS token,
                generate_subscripts(string_split(phrase, '_'), 1) - 1 AS pos FROM ph),
allknown AS (SELECT p.phrase FROM ptok p LEFT JOIN lex l ON p.token = l.entry
             GROUP BY p.phrase HAVING count(l.entry) = count(*))"""


def _elementwise(agg: str, types: str = COMPOSABLE) -> str:
    return "WITH " + LEX + f""",
ok AS (SELECT phrase FROM ptype WHERE type IN {types} AND phrase IN (SELECT phrase FROM allknown)),
cells AS (SELECT p.phrase, unnest(l.vec) AS val, generate_subscripts(l.vec, 1) - 1 AS dim
          FROM ptok p JOIN lex l ON p.token = l.entry WHERE p.phrase IN (SELECT phrase FROM ok))
SELECT phrase, CAST(dim AS BIGINT) AS dim, round({agg}, 6) AS value FROM cells GROUP BY phrase, dim"""


def _pick(index: str, types: str = COMPOSABLE) -> str:
    return "WITH " + LEX + f""",
pick AS (SELECT phrase, list_extract(string_split(phrase, '_'), {index}) AS token
         FROM ptype WHERE type IN {types})
SELECT p.phrase, CAST(generate_subscripts(l.vec, 1) - 1 AS BIGINT) AS dim, round(unnest(l.vec), 6) AS value
FROM pick p JOIN lex l ON p.token = l.entry"""


SQL["compose_add"] = _elementwise("sum(val)")
SQL["compose_avg"] = _elementwise("sum(val) / 2.0")
SQL["compose_mult"] = _elementwise("product(val)")
SQL["compose_min"] = _elementwise("min(val)")
SQL["compose_max"] = _elementwise("max(val)")
SQL["compose_left"] = _pick("1")
SQL["compose_right"] = _pick("-1")
SQL["compose_verb"] = _pick("2", "('SVO')")

SQL["compose_all_index"] = "WITH " + LEX + f""",
ok AS (SELECT phrase, min(ord) AS ord FROM ptype
       WHERE type IN {COMPOSABLE} AND phrase IN (SELECT phrase FROM allknown) GROUP BY phrase),
n AS (SELECT count(*) AS n FROM lex)
SELECT entry, CAST(vec_id AS BIGINT) AS row_id, 'unigram' AS kind FROM lex
UNION ALL
SELECT phrase AS entry, CAST((SELECT n FROM n) + row_number() OVER (ORDER BY ord, phrase) - 1 AS BIGINT) AS row_id,
       'phrase' AS kind
FROM ok"""


def _pick_known(index: str, types: str) -> str:
    return (f"(SELECT count(DISTINCT phrase) FROM ptype WHERE type IN {types} "
            f"AND list_extract(string_split(phrase, '_'), {index}) IN (SELECT entry FROM lex))")


def _all_known(types: str) -> str:
    return (f"(SELECT count(DISTINCT phrase) FROM ptype WHERE type IN {types} "
            f"AND phrase IN (SELECT phrase FROM allknown))")


SQL["compose_coverage"] = "WITH " + LEX + f""",
c AS (
  SELECT 'Add' AS composer, {_all_known(COMPOSABLE)} AS n UNION ALL
  SELECT 'Avg', {_all_known(COMPOSABLE)} UNION ALL
  SELECT 'Mult', {_all_known(COMPOSABLE)} UNION ALL
  SELECT 'Min', {_all_known(COMPOSABLE)} UNION ALL
  SELECT 'Max', {_all_known(COMPOSABLE)} UNION ALL
  SELECT 'Left', {_pick_known('1', COMPOSABLE)} UNION ALL
  SELECT 'Right', {_pick_known('-1', COMPOSABLE)} UNION ALL
  SELECT 'Verb', {_pick_known('2', "('SVO')")} UNION ALL
  SELECT 'Guevara', {_all_known("('AN', 'NN')")})
SELECT composer, CAST(n AS BIGINT) AS n_composable,
       CAST((SELECT count(DISTINCT phrase) FROM ph) AS BIGINT) AS n_phrases,
       CAST((SELECT count(DISTINCT entry) FROM lex) AS BIGINT) AS n_unigrams
FROM c"""

SQL["compose_sparse_mult"] = "WITH " + FILT + f""",
w AS (SELECT entry, feature, weight FROM ppmi WHERE weight > 0),
ents AS (SELECT DISTINCT entry FROM filt),
big AS (SELECT DISTINCT a.tok || '_' || b.tok AS phrase, a.tok AS t1, b.tok AS t2
        FROM stok a JOIN stok b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.pos = a.pos + 1),
ok AS (SELECT phrase, t1, t2 FROM big
       WHERE t1 IN (SELECT entry FROM ents) AND t2 IN (SELECT entry FROM ents)
         AND {ftype('phrase')} IN {COMPOSABLE}),
cells AS (SELECT o.phrase, x.feature, x.weight * y.weight AS value
          FROM ok o JOIN w x ON x.entry = o.t1 JOIN w y ON y.entry = o.t2 AND y.feature = x.feature)
SELECT o.phrase, c.feature, round(c.value, 6) AS value FROM ok o LEFT JOIN cells c ON o.phrase = c.phrase"""

LONG = "WITH " + FILT + f""",
w AS (SELECT entry, feature, weight FROM ppmi WHERE weight > 0),
big AS (SELECT a.tok || '_' || b.tok AS phrase, a.tok AS t1, b.tok AS t2
        FROM stok a JOIN stok b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.pos = a.pos + 1
        GROUP BY ALL HAVING count(*) >= 15),
ok AS (SELECT phrase, t1, t2 FROM big WHERE t1 IN (SELECT entry FROM w) AND t2 IN (SELECT entry FROM w)
         AND {ftype('phrase')} IN {COMPOSABLE}),
cells AS (SELECT phrase, feature, max(a) AS a, max(b) AS b FROM (
  SELECT o.phrase, x.feature, x.weight AS a, 0.0 AS b FROM ok o JOIN w x ON x.entry = o.t1 UNION ALL
  SELECT o.phrase, x.feature, 0.0 AS a, x.weight AS b FROM ok o JOIN w x ON x.entry = o.t2) GROUP BY ALL)"""

for _name, _value in {"add": "a + b", "avg": "(a + b) / 2", "mult": "a * b", "min": "least(a, b)", "max": "greatest(a, b)"}.items():
    SQL[f"compose_long_{_name}"] = LONG + f"""
SELECT phrase, feature, round({_value}, 6) AS value FROM cells WHERE {_value} <> 0"""

SQL["compose_pick_long"] = LONG + """
SELECT composer, phrase, count(*) AS n_features, round(sum(weight), 6) AS total FROM (
  SELECT 'Left' AS composer, phrase, weight FROM ok JOIN w ON w.entry = t1 UNION ALL
  SELECT 'Right' AS composer, phrase, weight FROM ok JOIN w ON w.entry = t2) GROUP BY ALL"""

SQL["sparse_tsv_round_trip"] = "WITH " + FILT + f"""
SELECT entry, feature, round(weight, 6) AS value FROM ppmi WHERE weight > 0 AND {ftype('entry')} = '1-GRAM'"""

SQL["glove_text_round_trip"] = "WITH " + LEX + """,
cells AS (SELECT entry, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM lex)
SELECT entry, CAST(dim AS BIGINT) AS dim, round(v, 6) AS value FROM cells"""

# ---- tensors ------------------------------------------------------------------------

TENSOR = "WITH " + LEX + """,
svo AS (SELECT DISTINCT 'w' || CAST(l_partkey % (SELECT count(*) FROM embeddings) AS VARCHAR) || '/N' AS subj,
                        'v' || CAST(l_linenumber AS VARCHAR) || '/V' AS verb,
                        'w' || CAST(l_suppkey % (SELECT count(*) FROM embeddings) AS VARCHAR) || '/N' AS obj FROM lineitem),
nv AS (SELECT entry, vec FROM lex),
ksvo AS (SELECT subj, verb, obj FROM svo
         WHERE subj IN (SELECT entry FROM nv) AND obj IN (SELECT entry FROM nv)),
verbs AS (SELECT verb FROM ksvo GROUP BY verb HAVING count(*) >= 3),
sx AS (SELECT entry, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM nv),
tensor AS (SELECT k.verb, a.i, b.i AS j, sum(a.x * b.x) AS w
           FROM ksvo k JOIN sx a ON a.entry = k.subj JOIN sx b ON b.entry = k.obj
           WHERE k.verb IN (SELECT verb FROM verbs) GROUP BY k.verb, a.i, b.i),
kv AS (SELECT * FROM ksvo WHERE verb IN (SELECT verb FROM verbs)),
mrow AS (SELECT verb, i, list(w ORDER BY j) AS m FROM tensor GROUP BY verb, i),
mcol AS (SELECT verb, j AS i, list(w ORDER BY i) AS m FROM tensor GROUP BY verb, j),
lhalf AS (SELECT kv.subj, kv.verb, kv.obj, t.i, list_dot_product(t.m, b.vec) AS m
          FROM kv JOIN mrow t ON t.verb = kv.verb JOIN nv b ON b.entry = kv.obj),
rhalf AS (SELECT kv.subj, kv.verb, kv.obj, t.i, list_dot_product(t.m, a.vec) AS m
          FROM kv JOIN mcol t ON t.verb = kv.verb JOIN nv a ON a.entry = kv.subj),
halves AS (SELECT l.subj || '_' || l.verb || '_' || l.obj AS phrase, l.i AS dim,
                  s.x * l.m AS lv, o.x * r.m AS rv
           FROM lhalf l JOIN rhalf r ON l.subj = r.subj AND l.verb = r.verb AND l.obj = r.obj AND l.i = r.i
           JOIN sx s ON s.entry = l.subj AND s.i = l.i JOIN sx o ON o.entry = l.obj AND o.i = l.i)"""

SQL["verb_tensors"] = TENSOR + """
SELECT verb, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(w, 6) AS weight FROM tensor"""
SQL["copy_object"] = TENSOR + """
SELECT phrase, CAST(dim AS BIGINT) AS dim, round(lv, 6) AS value FROM halves"""
SQL["frobenius_add"] = TENSOR + """
SELECT phrase, CAST(dim AS BIGINT) AS dim, round(lv + rv, 6) AS value FROM halves"""
SQL["frobenius_mult"] = TENSOR + """
SELECT phrase, CAST(dim AS BIGINT) AS dim, round(lv * rv, 6) AS value FROM halves"""

# ---- neighbours and baselines ----------------------------------------------------------

SQL["knn_exact"] = "WITH " + LEX + """,
d AS (SELECT a.entry, b.entry AS neighbour, list_distance(a.vec, b.vec) AS dist
      FROM lex a JOIN lex b ON a.entry <> b.entry),
r AS (SELECT entry, neighbour, dist,
             row_number() OVER (PARTITION BY entry ORDER BY dist, neighbour) AS rank FROM d)
SELECT entry, CAST(rank AS BIGINT) AS rank, neighbour, round(dist, 6) AS distance FROM r WHERE rank <= 10"""

SQL["knn_lsh_audit"] = "WITH " + LEX + """,
n AS (SELECT count(DISTINCT entry) - 1 AS others FROM lex)
SELECT split_part(entry, '/', 2) AS tag, count(*) AS entries, CAST(sum(least(10, others)) AS BIGINT) AS neighbours,
       CAST(sum(least(10, others)) AS BIGINT) AS exact, CAST(max(least(10, others)) AS BIGINT) AS last_rank
FROM lex, n GROUP BY 1"""

SQL["random_vectors"] = f"""
WITH voc AS (
  SELECT DISTINCT {tag('t')} AS entry FROM (
    SELECT unnest(list_filter(regexp_split_to_array(lower(text), '{NONLETTER}'), lambda x: x <> '')) AS t
    FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)))
SELECT entry, array_to_string(list_transform(range(100), lambda d: CAST(floor(
         CAST(('0x' || substr(md5(entry || '#' || CAST(d AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 * 1000000)
         AS BIGINT)), ',') AS vec
FROM voc"""

SQL["constant_neighbours"] = "WITH " + LEX + """
SELECT entry, CAST(1 AS BIGINT) AS rank, 'b/N' AS neighbour, 1.0::DOUBLE AS score FROM lex"""

SQL["random_neighbours"] = "WITH " + LEX + """,
voc AS (SELECT entry, row_number() OVER (ORDER BY entry) - 1 AS idx FROM (SELECT DISTINCT entry FROM lex)),
n AS (SELECT count(*) AS n FROM voc),
h AS (SELECT DISTINCT entry, n, CAST(('0x' || substr(md5(entry || '#0#0'), 1, 8)) AS BIGINT) % (n - 2) AS r0,
             CAST(('0x' || substr(md5(entry || '#0#1'), 1, 8)) AS BIGINT) % (n - 1) AS r1,
             CAST(('0x' || substr(md5(entry || '#0#2'), 1, 8)) AS BIGINT) % n AS r2 FROM lex, n),
h1 AS (SELECT *, CASE WHEN r1 = r0 THEN n - 2 ELSE r1 END AS p1 FROM h),
h2 AS (SELECT *, CASE WHEN r2 IN (r0, p1) THEN n - 1 ELSE r2 END AS p2 FROM h1),
picks AS (SELECT entry, 0 AS t, r0 AS idx FROM h2 UNION ALL SELECT entry, 1, p1 FROM h2
          UNION ALL SELECT entry, 2, p2 FROM h2)
SELECT p.entry, CAST(p.t + 1 AS BIGINT) AS rank, v.entry AS neighbour, 1.0::DOUBLE AS score
FROM picks p JOIN voc v ON p.idx = v.idx"""

# ---- feature selection --------------------------------------------------------------------

DOCFEAT = f"""
lab AS (SELECT l.doc_id, CAST(l.quality AS INTEGER) AS y FROM labels l
        WHERE l.doc_id IN (SELECT doc_id FROM documents)),
docfeat AS (
  SELECT doc_id, feature, CAST(count(*) AS DOUBLE) AS weight FROM (
    SELECT doc_id, {tag('t')} AS feature FROM (
      SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{NONLETTER}'), lambda x: x <> '')) AS t
      FROM documents WHERE doc_id IN (SELECT doc_id FROM lab)))
  GROUP BY doc_id, feature),
prior AS (SELECT y, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY y),
obs AS (SELECT f.feature, l.y, sum(f.weight) AS o FROM docfeat f JOIN lab l ON f.doc_id = l.doc_id
        GROUP BY f.feature, l.y),
tot AS (SELECT feature, sum(o) AS total FROM obs GROUP BY feature),
grid AS (SELECT t.feature, t.total, p.y, p.p, coalesce(o.o, 0) AS o
         FROM tot t CROSS JOIN prior p LEFT JOIN obs o ON o.feature = t.feature AND o.y = p.y),
chi AS (SELECT feature, sum((o - p * total) * (o - p * total) / (p * total)) AS score FROM grid GROUP BY feature),
dfc AS (SELECT f.feature, count(*) FILTER (WHERE l.y = 1) AS df1, count(*) FILTER (WHERE l.y <> 1) AS df0
        FROM (SELECT DISTINCT doc_id, feature FROM docfeat WHERE weight > 0) f JOIN lab l ON f.doc_id = l.doc_id
        GROUP BY f.feature),
ncls AS (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y <> 1) AS n0 FROM lab),
lo AS (SELECT feature, ln((df1 + 0.5) / (n1 - df1 + 0.5)) - ln((df0 + 0.5) / (n0 - df0 + 0.5)) AS log_odds
       FROM dfc, ncls)"""

SQL["chi2_scores"] = "WITH " + DOCFEAT + """
SELECT feature, round(score, 6) AS score FROM chi"""

SQL["select_k_best"] = "WITH " + DOCFEAT + """
SELECT feature, round(score, 6) AS score FROM chi ORDER BY score DESC, feature ASC LIMIT 200"""

SQL["log_odds_band"] = "WITH " + DOCFEAT + """
SELECT feature, round(log_odds, 6) AS log_odds FROM lo WHERE abs(log_odds) > 1.0"""

SQL["vector_presence"] = "WITH " + FILT + "," + DOCFEAT + """
SELECT DISTINCT feature FROM docfeat WHERE feature IN (SELECT entry FROM filt)"""

SQL["feature_selection"] = "WITH " + FILT + "," + DOCFEAT + """,
best AS (SELECT feature, score FROM chi ORDER BY score DESC, feature ASC LIMIT 2000),
keep AS (SELECT feature, score FROM best
         WHERE feature IN (SELECT entry FROM filt)
           AND feature IN (SELECT feature FROM lo WHERE abs(log_odds) > 0.3))
SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS BIGINT) AS col_id, round(score, 6) AS score
FROM keep"""

# ---- parsing, cleaning, repeats, sampling, unions, CoNLL --------------------------------------

SQL["parse_features"] = "WITH " + SENT + f""",
grams AS (
  SELECT DISTINCT feature FROM (
    SELECT unnest(list_transform(range(len(toks) - n + 1), lambda i: array_to_string(toks[i + 1:i + n], '_')))
             AS feature
    FROM sent, (SELECT unnest(range(1, 5)) AS n) WHERE len(toks) >= n)),
typed AS (SELECT feature, {ftype('feature')} AS type, string_split(feature, '_') AS toks FROM grams)
SELECT feature, type, CAST(len(toks) AS BIGINT) AS n_tokens, split_part(toks[1], '/', 1) AS head,
       regexp_extract(toks[-1], {TOKEN_RE}, 2) AS last_pos,
       (type = '1-GRAM' AND regexp_extract(feature, {TOKEN_RE}, 2) IN ('N', 'J', 'V')) AS is_row,
       type IN ('AN', 'NN') AS is_np
FROM typed"""

SQL["combine_repeats"] = """
WITH reps AS (
  SELECT vec_id % 2 AS repeat, 'w' || CAST(vec_id // 2 AS VARCHAR) || '/N' AS entry,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
cells AS (SELECT entry, repeat, unnest(vec) AS val, generate_subscripts(vec, 1) - 1 AS dim FROM reps)
SELECT entry, CAST(dim AS BIGINT) AS dim, round(avg(val), 6) AS value
FROM cells GROUP BY entry, dim HAVING count(DISTINCT repeat) = 2"""

SURF = """
elines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents),
raw AS (
  SELECT doc_id, line_no, unnest(regexp_split_to_array(line, '[ \\t]+')) AS surface,
         generate_subscripts(regexp_split_to_array(line, '[ \\t]+'), 1) - 1 AS pos FROM elines),
occ AS (SELECT surface, doc_id, line_no, pos,
               row_number() OVER (PARTITION BY surface ORDER BY doc_id, line_no, pos) AS k
        FROM raw WHERE surface <> '' AND NOT regexp_matches(surface, '[!-/:-@\\[-`{-~0-9]')),
surf AS (SELECT surface, doc_id, line_no, pos FROM occ WHERE k = 1),
low AS (SELECT DISTINCT lower(surface) AS word FROM surf),
dict AS (SELECT word, substr(word, 1, length(word) - 1) AS lemma FROM low
         WHERE word LIKE '%s' AND length(word) > 1 AND substr(word, 1, length(word) - 1) IN (SELECT word FROM low)),
lem AS (SELECT s.surface, s.doc_id, s.line_no, s.pos, coalesce(d.lemma, lower(s.surface)) AS lemma
        FROM surf s LEFT JOIN dict d ON lower(s.surface) = d.word),
best AS (SELECT lemma, surface, doc_id, line_no, pos,
                row_number() OVER (PARTITION BY lemma
                                   ORDER BY length(surface), surface <> lower(surface), doc_id, line_no, pos) AS rk
         FROM lem)"""

SQL["surface_form_pick"] = "WITH " + SURF + """
SELECT lemma, surface FROM best WHERE rk = 1"""

SQL["pos_expand"] = "WITH " + SURF + """,
num AS (SELECT lemma, row_number() OVER (ORDER BY doc_id, line_no, pos, lemma) - 1 AS i FROM best WHERE rk = 1),
n AS (SELECT count(*) AS n FROM num)
SELECT lemma || '/' || tag AS entry, CAST(b * (SELECT n FROM n) + i AS BIGINT) AS row_id
FROM num, (VALUES (0, 'N'), (1, 'J'), (2, 'V')) t(b, tag)"""

SQL["sample_files"] = """
WITH files AS (SELECT DISTINCT source AS file FROM documents),
k AS (SELECT ceil(30 * count(*) / 100.0) AS k FROM files),
ranked AS (
  SELECT 0 AS repeat, file, row_number() OVER (ORDER BY file) AS pos FROM files
  UNION ALL
  SELECT r, file, row_number() OVER (PARTITION BY r ORDER BY md5(CAST(r AS VARCHAR) || file), file)
  FROM files, (VALUES (1), (2)) t(r)),
nd AS (SELECT source AS file, count(*) AS n_docs FROM documents GROUP BY source)
SELECT CAST(r.repeat AS BIGINT) AS repeat, r.file, CAST(r.pos AS BIGINT) AS pos, nd.n_docs
FROM ranked r JOIN nd ON r.file = nd.file WHERE r.pos <= (SELECT k FROM k)"""

SQL["observed_union"] = "WITH " + SENT + """,
bg AS (SELECT a.doc_id, a.line_no, a.pos, a.tok || '_' || b.tok AS entry
       FROM stok a JOIN stok b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.pos = a.pos + 1),
bpairs AS (SELECT g.entry, 'T:' || c.tok AS feature
           FROM bg g JOIN stok c ON c.doc_id = g.doc_id AND c.line_no = g.line_no
            AND c.pos BETWEEN g.pos - 2 AND g.pos + 3 AND c.pos <> g.pos AND c.pos <> g.pos + 1),
allc AS (SELECT entry, feature, count(*) AS n FROM (SELECT * FROM pairs UNION ALL SELECT * FROM bpairs)
         GROUP BY entry, feature),
ukept AS (SELECT feature FROM allc GROUP BY feature HAVING sum(n) >= 40),
ufilt AS (SELECT * FROM allc WHERE n >= 15 AND feature IN (SELECT feature FROM ukept))
SELECT entry, CASE WHEN contains(entry, '_') THEN 'phrase' ELSE 'unigram' END AS kind,
       count(*) AS n_features, CAST(sum(n) AS BIGINT) AS total
FROM ufilt GROUP BY entry"""

SQL["conll_reformat"] = f"""
WITH c AS (SELECT conv_id, turn,
                  list_filter(regexp_split_to_array(lower(text), '{NONLETTER}'), lambda x: x <> '') AS toks
           FROM conversations)
SELECT conv_id, turn,
       array_to_string(list_transform(list_filter(toks, lambda t: length(t) % 7 <> 0),
         lambda t: t || '/' || CASE length(t) % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'V' WHEN 2 THEN 'J'
                                                 WHEN 3 THEN 'DET' ELSE 'RB' END), ' ') AS sentence,
       CAST(len(list_filter(toks, lambda t: length(t) % 7 = 0)) AS BIGINT) AS n_malformed
FROM c"""

# ---- stores and lists read back, the composed matrix ------------------------------------------

LEX_CELLS = "SELECT entry, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim, round(unnest(vec), 6) AS value FROM lex"
SQL["dense_store_round_trip"] = SQL["model_round_trip"] = "WITH " + LEX + "\n" + LEX_CELLS
SQL["line_aligned_round_trip"] = "WITH " + LEX + f"""
SELECT entry AS phrase, dim, value FROM ({LEX_CELLS}) WHERE NOT entry LIKE '%/V'"""

SQL["embedding_table"] = """
SELECT vec_id AS row_id, 'w' || CAST(vec_id AS VARCHAR) AS surface, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim,
       round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM embeddings"""

SQL["compose_all_matrix"] = "WITH " + LEX + f""",
ok AS (SELECT phrase, min(ord) AS ord FROM ptype
       WHERE type IN {COMPOSABLE} AND phrase IN (SELECT phrase FROM allknown) GROUP BY phrase),
ids AS (SELECT phrase, (SELECT count(*) FROM lex) + row_number() OVER (ORDER BY ord, phrase) - 1 AS row_id FROM ok),
cells AS (SELECT p.phrase, unnest(l.vec) AS val, generate_subscripts(l.vec, 1) - 1 AS dim
          FROM (SELECT DISTINCT * FROM ptok) p JOIN lex l ON p.token = l.entry WHERE p.phrase IN (SELECT phrase FROM ok))
SELECT entry, CAST(vec_id AS BIGINT) AS row_id, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS dim, round(unnest(vec), 6) AS value FROM lex
UNION ALL
SELECT phrase AS entry, CAST(row_id AS BIGINT) AS row_id, CAST(dim AS BIGINT) AS dim, round(sum(val), 6) AS value
FROM cells JOIN ids USING (phrase) GROUP BY ALL"""

SQL["triples_round_trip"] = "WITH " + FILT + """,
w AS (SELECT entry, feature, weight FROM ppmi WHERE weight > 0),
rows_ AS (SELECT entry, row_number() OVER (ORDER BY entry) - 1 AS row_id FROM (SELECT DISTINCT entry FROM w)),
cols_ AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS col_id FROM (SELECT DISTINCT feature FROM w))
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(col_id AS BIGINT) AS col_id, entry, feature, round(weight, 6) AS value
FROM w JOIN rows_ USING (entry) JOIN cols_ USING (feature)"""

SQL["phrase_list_round_trip"] = "WITH " + LEX + """
SELECT DISTINCT phrase FROM ptype WHERE type <> '1-GRAM'"""

SQL["svo_list_round_trip"] = "WITH " + LEX + """,
svo AS (SELECT 'w' || CAST(l_partkey % (SELECT count(*) FROM embeddings) AS VARCHAR) || '/N_v' || CAST(l_linenumber AS VARCHAR)
               || '/V_w' || CAST(l_suppkey % (SELECT count(*) FROM embeddings) AS VARCHAR) || '/N' AS phrase FROM lineitem
        UNION SELECT phrase FROM ptype WHERE type = 'SVO')
SELECT string_split(phrase, '_')[1] AS subj, string_split(phrase, '_')[2] AS verb, string_split(phrase, '_')[3] AS obj, phrase FROM svo"""

SQL["sentence_files_round_trip"] = "WITH " + SENT + """
SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM sent WHERE len(toks) > 8) GROUP BY token"""

SQL["instances_round_trip"] = "WITH " + SENT + """
SELECT entry, feature, count(*) AS n FROM (SELECT toks[1] AS entry, unnest(toks[2:]) AS feature FROM sent) GROUP BY entry, feature"""

SQL["tensor_round_trip"] = SQL["verb_tensors"]

SQL["cluster_presence"] = "WITH " + FILT + "," + DOCFEAT + """,
best AS (SELECT feature, score FROM chi ORDER BY score DESC, feature ASC LIMIT 2000),
keep AS (SELECT feature, score FROM best WHERE feature IN (SELECT toks[1] FROM sent))
SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS BIGINT) AS col_id, round(score, 6) AS score FROM keep"""

SQL["run_report"] = "WITH " + SENT + ", " + LEX.lstrip() + f""",
able AS (SELECT DISTINCT phrase, type FROM ptype WHERE type IN {COMPOSABLE} AND phrase IN (SELECT phrase FROM allknown))
SELECT 'unigrams' AS name, count(*) AS n FROM lex
UNION ALL SELECT 'phrases', count(DISTINCT phrase) FROM ptype
UNION ALL SELECT 'composable', count(*) FROM able
UNION ALL SELECT 'modifiers', count(DISTINCT string_split(phrase, '_')[1]) FROM able WHERE type IN ('AN', 'NN')
UNION ALL SELECT 'verbs', count(DISTINCT l_linenumber) FROM lineitem
UNION ALL SELECT 'sentences', count(*) FROM sent WHERE len(toks) > 0
UNION ALL SELECT 'sentences kept', count(*) FROM sent WHERE len(toks) > 8
UNION ALL SELECT 'features', count(DISTINCT feature) FROM counts
UNION ALL SELECT 'features kept', count(DISTINCT feature) FROM (
  SELECT feature FROM counts WHERE n >= 15
  AND feature IN (SELECT feature FROM counts GROUP BY feature HAVING sum(n) >= 40))"""
