"""SQL (DuckDB dialect) for the queries of this package that SQL can express."""

from emberframe.llm import collocations, jaccard_join, line_dedup, suffix_dedup

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = "'[^\\x20\\x09-\\x0D]+'"

EXACT_TOP_K = """WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

N = jaccard_join.WIDTH
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {N} THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + {N - 1}], ' ') FOR i IN range(1, len(words) - {N - 2})]) END AS s
  FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
pairs_both AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN pairs_both e ON r.other = e.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, MIN(other) AS component_id
FROM sets JOIN reach ON sets.doc_id = reach.doc_id GROUP BY sets.doc_id, len(s)"""

# two lines within one edit have one half in common, where it stands or one character on
LINES = f"""WITH RECURSIVE places AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
lines AS (SELECT line, MIN((doc_id, line_no)) AS first, length(line) AS n FROM places WHERE trim(line) <> '' GROUP BY line),
long AS (SELECT * FROM lines WHERE n >= {line_dedup.LEAST}),
near AS (
  SELECT a.line AS a, b.line AS b FROM long a JOIN long b ON b.n = a.n AND a.line < b.line AND left(b.line, a.n // 2) = left(a.line, a.n // 2)
  WHERE levenshtein(a.line, b.line) = 1 UNION
  SELECT a.line, b.line FROM long a JOIN long b ON b.n = a.n AND a.line < b.line AND right(b.line, a.n - a.n // 2) = right(a.line, a.n - a.n // 2)
  WHERE levenshtein(a.line, b.line) = 1 UNION
  SELECT a.line, b.line FROM long a JOIN long b ON b.n = a.n + 1 AND left(b.line, a.n // 2) = left(a.line, a.n // 2)
  WHERE levenshtein(a.line, b.line) = 1 UNION
  SELECT a.line, b.line FROM long a JOIN long b ON b.n = a.n + 1 AND right(b.line, a.n - a.n // 2) = right(a.line, a.n - a.n // 2)
  WHERE levenshtein(a.line, b.line) = 1),
pairs_both AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(line, other) AS (SELECT DISTINCT a, a FROM pairs_both UNION SELECT r.line, e.b FROM reach r JOIN pairs_both e ON r.other = e.a),
classes AS (SELECT r.line, MIN(l.first) AS first FROM reach r JOIN lines l ON r.other = l.line GROUP BY r.line),
named AS (SELECT l.line, coalesce(c.first, l.first) AS first FROM lines l LEFT JOIN classes c ON l.line = c.line),
found AS (SELECT p.doc_id, p.line_no, coalesce(n.first, (p.doc_id, p.line_no)) AS first FROM places p LEFT JOIN named n ON p.line = n.line)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, first[1] AS first_doc_id, CAST(first[2] AS INTEGER) AS first_line_no,
  first[1] = doc_id AND first[2] = line_no AS kept FROM found"""

M = suffix_dedup.SPAN
SPANS = f"""WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORD}) AS words, regexp_extract_all({LOWER}, '(?:[\\x20\\x09-\\x0D]*)(?:[^\\x20\\x09-\\x0D]+)') AS runs FROM documents),
one AS (SELECT doc_id, unnest(words) AS word, unnest([length(r) FOR r IN runs]) AS run, unnest(range(0, len(words))) AS i FROM w),
placed AS (
  SELECT doc_id, i, CAST(SUM(run) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS stop, length(word) AS n FROM one),
windows AS (SELECT doc_id, unnest(range(0, len(words) - {M - 1})) AS i, unnest([md5(array_to_string(words[k:k + {M - 1}], ' ')) FOR k IN range(1, len(words) - {M - 2})]) AS code FROM w WHERE len(words) >= {M}),
many AS (SELECT code FROM windows GROUP BY code HAVING COUNT(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM windows JOIN many USING (code)),
marked AS (SELECT *, CASE WHEN i - LAG(i) OVER (PARTITION BY doc_id ORDER BY i) <= {M} THEN 0 ELSE 1 END AS new FROM hit),
numbered AS (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM marked),
spans AS (SELECT doc_id, MIN(i) AS low, MAX(i) + {M} AS high FROM numbered GROUP BY doc_id, nth)
SELECT s.doc_id, CAST(low AS INTEGER) AS first_word, CAST(high - low AS INTEGER) AS n_words, CAST(a.stop - a.n AS INTEGER) AS "start", b.stop AS "end"
FROM spans s JOIN placed a ON a.doc_id = s.doc_id AND a.i = s.low JOIN placed b ON b.doc_id = s.doc_id AND b.i = s.high - 1"""

PHRASES = f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, CAST(SUM(len(words)) AS BIGINT) AS n FROM pieces WHERE len(words) > 0 GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, range(1, {collocations.LONGEST + 1}) AS t(k) WHERE len(words) >= k)),
f AS (SELECT lang, k, phrase, COUNT(*) AS f FROM grams GROUP BY lang, k, phrase HAVING COUNT(*) >= {collocations.LEAST}),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, s.n, CAST((CAST(1000 AS HUGEINT) * c.a * s.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN sizes s ON s.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:c.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')),
weakest AS (SELECT * FROM scores QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, MAX(a) AS f FROM (
    SELECT lang, a, array_to_string(words[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, a, words, k, m, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, {collocations.LONGEST}) AS t(m) WHERE m < k))
  GROUP BY lang, phrase),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.f IS NULL OR i.f < w.a),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {collocations.MOST}"""

ORACLE = {
    "op1_suffix_dedup": SPANS,
    "op8_ngram_jaccard": JACCARD,
    "op9_exact_topk": EXACT_TOP_K,
    "op10_line_dedup": LINES,
    "op13_collocations": PHRASES,
}
