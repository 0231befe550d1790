"""The SQL that the corpus queries must equal, where SQL can express them."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (
  SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
  FROM windows JOIN firsts USING (k) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

URL_FILTERS = rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
named AS (
  SELECT url, regexp_replace(t, '(?i)&(?:amp|#0*38|#x0*26);', '&', 'g') AS t,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS root,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (
    SELECT url, unnest([
      regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0),
                     '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0),
                     '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t
    FROM p WHERE url LIKE '%://%')),
relative AS (
  SELECT *, regexp_extract(t, '(?s)^[^?#]*(.*)', 1) AS tail,
    CASE WHEN t LIKE '/%' THEN '' ELSE regexp_extract(path || '/', '(?s)^(.*/)[^/]*/\z', 1) END AS folder,
    regexp_extract(t, '^[^?#]*', 0) AS way
  FROM named WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '//')
    AND NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:')),
rooted AS (
  SELECT *, CASE WHEN way LIKE '/%' OR folder <> '' THEN folder ELSE '/' END || way AS plain FROM relative WHERE way <> ''),
dots AS (
  SELECT DISTINCT plain, regexp_replace(regexp_replace(regexp_replace(plain,
    '/(\.\.?)\z', '/\1/'), '/(\./)+', '/', 'g'), '^(/\.\.)+/', '/') AS way
  FROM rooted
  UNION ALL
  SELECT plain, regexp_replace(regexp_replace(way, '/[^/]*/\.\./', '/'), '^(/\.\.)+/', '/')
  FROM dots WHERE regexp_matches(way, '/[^/]*/\.\./')),
links AS (
  SELECT url, t AS target FROM named WHERE regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://')
  UNION ALL SELECT url, regexp_extract(url, '(?s)^(.*?:)//', 1) || t FROM named WHERE t LIKE '//%'
  UNION ALL SELECT url, root || path || tail FROM relative WHERE way = ''
  UNION ALL SELECT url, root || dots.way || tail FROM rooted JOIN dots USING (plain)
  WHERE NOT regexp_matches(dots.way, '/[^/]*/\.\./')),
spellings AS (
  SELECT url, 'https://' || {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}
    || regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1')
    || CASE WHEN q = '' THEN '' ELSE '?' || q END AS target
  FROM (
    SELECT url, array_to_string(list_filter(
      string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: NOT starts_with(x, 'utm_') AND x <> ''), '&') AS q
    FROM (SELECT url FROM p WHERE url LIKE '%://%' UNION SELECT target FROM links))),
edges AS (
  SELECT DISTINCT url AS a, target AS b
  FROM (SELECT * FROM links UNION ALL SELECT * FROM spellings) WHERE target IS NOT NULL AND target <> url),
both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
nodes AS (SELECT url FROM p UNION SELECT a FROM both_ways),
parsed AS (
  SELECT url, {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM nodes),
rules (rule_host, rule_path, own) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
ruled AS (
  SELECT url, any_value(host) AS host, any_value(path) AS path,
    arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(own, length(rule_host || rule_path)) AS own
  FROM parsed LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY url),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
spread AS (SELECT DISTINCT a AS url FROM reach JOIN ruled ON ruled.url = reach.b WHERE own = 'block')
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN spread.url IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p JOIN ruled USING (url) LEFT JOIN spread USING (url)
"""

_SEED_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"
# No seeds: a window with 80 % agreement has three agreeing words in a row, so every alignment that
# shares three is laid side by side as a whole and all its windows are compared.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_SEED_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_SEED_WORDS} AS w FROM benchmark),
dt AS (SELECT doc_id, w, pos, w[pos + 1:pos + 3] AS three FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS pos FROM d WHERE len(w) >= 6)),
bt AS (SELECT item_id, w, pos, w[pos + 1:pos + 3] AS three FROM (SELECT item_id, w, unnest(range(0, len(w) - 2)) AS pos FROM b WHERE len(w) >= 6)),
laid AS (
  SELECT DISTINCT doc_id, item_id, dt.w AS dw, bt.w AS iw, dt.pos - bt.pos AS shift, least(15, len(bt.w)) AS size
  FROM dt JOIN bt USING (three)),
starts AS (SELECT *, unnest(range(greatest(0, -shift), least(len(iw), len(dw) - shift) - size + 1)) AS s FROM laid),
agreed AS (
  SELECT doc_id, item_id, shift, s, size FROM starts
  WHERE len(list_filter(range(0, size), lambda x: dw[s + shift + x + 1] = iw[s + x + 1])) >= ceil(size * 0.8)),
spans AS (
  SELECT doc_id, item_id, min(s) + shift AS first_word, max(s + size - 1) + shift AS last_word FROM agreed
  GROUP BY doc_id, item_id, shift)
SELECT doc_id, item_id, first_word, last_word, last_word - first_word + 1 AS n_words FROM spans
"""

_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {}) & 31)::INT + 1, 1)"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
firsts AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(
    list_transform(range(0, 8), lambda g: ('0x' || substr(sha1(payload), (5 * g + 1)::INT, 5))::BIGINT),
    lambda v: {' || '.join(_BASE32.format(k) for k in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN firsts USING (payload)
"""

# CRC-32 bit by bit over the bytes of "<doc_id>:<run>"; pairs by equal remainders after one deletion.
SPELLING_VARIANTS = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, {_LOWER.format('run')} AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM r),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, 4 * length(hx)),
      lambda k: CASE WHEN k % 8 = 0 THEN ('0x' || substr(hx, (2 * (k // 8) + 1)::INT, 2))::BIGINT ELSE 0::BIGINT END)),
    lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384))) AS h
  FROM b),
w AS (
  SELECT word, sum(n) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT e.word, w.word FROM e JOIN w ON w.word = e.rest
  UNION SELECT w.word, e.word FROM e JOIN w ON w.word = e.rest),
ranked AS (
  SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
  FROM near JOIN w o ON o.word = other),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
    CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN ranked ON ranked.word = w.word AND place = 1),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM f JOIN walk ON walk.word = f.word JOIN f last ON last.word = walk.at AND last.form IS NULL
"""

# Every document is taken through every order, step by step.
FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
f AS (
  SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
      WHEN 'A' THEN len(w) < 200
      WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
      WHEN 'C' THEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text)
      WHEN 'D' THEN regexp_matches(text, '[#$%&*|]')
      ELSE coalesce(d.doc_id > first_id, false) END) AS fails
  FROM d JOIN firsts USING (text) LEFT JOIN l ON l.doc_id = d.doc_id),
x (x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.x, b.x, c.x, d.x, e.x] AS letters
  FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x)
  JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
alike AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
taken AS (
  SELECT part, filter_order, step, letters[step] AS letter, n, good, toxic,
    list_contains(fails, letters[step]) AS failing, fails = [letters[step]] AS alone,
    list_has_any(fails, letters[1:step - 1]) AS gone
  FROM alike CROSS JOIN (SELECT *, unnest(range(1, 6)) AS step FROM o)),
steps AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
  FROM taken GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps
"""

QUERIES = {
    "op1_ngram_jaccard": NGRAM_JACCARD,
    "op2_url_filters": URL_FILTERS,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op9_decontamination": DECONTAMINATION,
    "op10_warc": WARC,
    "op11_spelling_variants": SPELLING_VARIANTS,
    "op13_filter_audit": FILTER_AUDIT,
}
