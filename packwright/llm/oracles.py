"""SQL of the queries, for the same tables."""

from packwright.llm.licenses import Params as LicenseParams
from packwright.llm.licenses import templates
from packwright.llm.linedup import Params as LineParams

CHATS = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
    ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST]') + length(role) + length('[/INST]') + length(text) + length('</s>')
    + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]'))
    + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

_ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
    r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT row, '{kind}' AS kind, {rank} AS rank,
      (list_sum([length(x) FOR x IN pieces[1:i]])
        + coalesce(list_sum([length(x) FOR x IN whole[1:i - 1]]), 0))::BIGINT AS s,
      length(whole[i]) AS n
    FROM (
      SELECT row, whole, part, pieces, unnest(generate_series(1, len(whole))) AS i FROM (
        SELECT row, regexp_extract_all(text, '{pattern}') AS whole,
          regexp_extract_all(text, '{pattern}', {group}) AS part,
          string_split_regex(text, '{pattern}') AS pieces
        FROM docs
      )
    ) WHERE length(part[i]) >= {least}"""


SECRETS = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
),
spans AS ({_spans("assign", 0, _ASSIGN, 2, 6)}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_spans("hex", 2, "[0-9a-f]+", 0, 24)}
  UNION ALL {_spans("github", 3, "gh[pousr]_[A-Za-z0-9]+", 0, 40)}
  UNION ALL {_spans("slack", 4, "xox[abprs]-[A-Za-z0-9-]+", 0, 15)}
  UNION ALL {_spans("google", 5, "AIza[A-Za-z0-9_-]+", 0, 39)}
  UNION ALL {_spans("jwt", 6, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 30)}
  UNION ALL {_spans("pem", 7, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27)}
),
per_row AS (
  SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
    count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (WHERE rank <= 2) AS base,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_row USING (row)
"""

# DuckDB has no base32: five bits of the digest at a time.
ARCHIVES = """
WITH p AS (
  SELECT row_number() OVER () AS row, page_id, encode(coalesce(html, '')) AS payload,
    sha1(encode(coalesce(html, ''))) AS hex FROM pages
),
bits AS (
  SELECT row, page_id, octet_length(payload)::BIGINT AS payload_bytes, hex,
    array_to_string([lpad(bin(('0x' || hex[i])::INT), 4, '0') FOR i IN range(1, 41)], '') AS b FROM p
),
named AS (
  SELECT row, page_id, payload_bytes, hex,
    array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum([
      (b[5 * i + j] = '1')::INT * (16 >> (j - 1)) FOR j IN range(1, 6)])::BIGINT] FOR i IN range(0, 32)], '') AS payload_digest
  FROM bits
),
leaders AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS leader FROM named)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM leaders
"""

# Lower-casing of A-Z alone, and words, as the scans take them.
_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i
        FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row, w[i:i + n - 1] AS win, n, i FROM (
    SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)
),
hits AS (SELECT p.row, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
n_hit AS (
  SELECT row, count(DISTINCT word)::BIGINT AS n_hit
  FROM (SELECT row, unnest(generate_series(i, i + n - 1)) AS word FROM (SELECT DISTINCT row, i, n FROM hits))
  GROUP BY row
),
n_items AS (
  SELECT row, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n_hit USING (row) LEFT JOIN n_items USING (row)
"""

_LICENSE = LicenseParams()


def _templates() -> str:
    return ", ".join(
        f"({template}, '{label}', {base}, {k}, string_split('{phrase}', ' '))"
        for template, (phrase, label, base, k) in enumerate(templates(_LICENSE))
    )


LICENSES = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
templates(template, label, base, k, t) AS (VALUES {_templates()}),
grams AS (
  SELECT template, label, base, k, len(t) - k + 1 AS total, o - 1 AS o, t[o:o + k - 1] AS g
  FROM (SELECT *, unnest(generate_series(1, len(t) - k + 1)) AS o FROM templates)
),
places AS (
  SELECT row, k, i - 1 AS pos, w[i:i + k - 1] AS g FROM (
    SELECT row, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
    FROM docs, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)
),
diagonals AS (
  SELECT row, template, label, base, total, g.k AS k, pos - o AS diagonal,
    list(DISTINCT o) AS offsets, min(pos) AS low, max(pos) AS high
  FROM places p JOIN grams g ON p.g = g.g AND p.k = g.k GROUP BY ALL
),
gaps AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) AS gap FROM diagonals
),
clustered AS (
  SELECT *, sum(CASE WHEN base OR gap IS NULL OR gap > {_LICENSE.reach} THEN 1 ELSE 0 END)
    OVER (PARTITION BY row, template ORDER BY diagonal) AS cluster FROM gaps
),
spans AS (
  SELECT row, label, base, min(low) AS first,
    len(list_distinct(flatten(list(offsets))))::DOUBLE / total AS score
  FROM clustered GROUP BY row, template, label, base, total, cluster
),
per_row AS (
  SELECT row, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word,
    max(first) FILTER (WHERE base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM spans WHERE score >= {_LICENSE.least} GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0) AS score
FROM docs LEFT JOIN per_row USING (row)
"""

# A line goes if it lies in a run of enough characters that is there earlier; the shortest
# such runs from each line and up to each line are enough to see that.
LINES = f"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, text, string_split(text, chr(10)) AS l FROM documents
),
lines AS (SELECT row, l, unnest(generate_series(1, len(l))) AS p FROM docs),
sums AS (
  SELECT row, p, length(l[p]) AS c, sum(length(l[p])) OVER (PARTITION BY row ORDER BY p) AS upto FROM lines
),
runs AS (
  SELECT a.row, a.p AS i, min(b.p) AS j FROM sums a JOIN sums b ON a.row = b.row AND b.p >= a.p
    AND b.upto - a.upto + a.c >= {LineParams().least_chars} GROUP BY ALL
  UNION
  SELECT b.row, max(a.p) AS i, b.p AS j FROM sums a JOIN sums b ON a.row = b.row AND b.p >= a.p
    AND b.upto - a.upto + a.c >= {LineParams().least_chars} GROUP BY ALL
),
named AS (SELECT row, i, j, md5(array_to_string(l[i:j], chr(10))) AS run FROM runs JOIN docs USING (row)),
firsts AS (SELECT run, min({{'row': row, 'i': i}}) AS first FROM named GROUP BY run),
gone AS (
  SELECT DISTINCT row, p FROM (
    SELECT row, unnest(generate_series(i, j)) AS p FROM named JOIN firsts USING (run)
    WHERE first <> {{'row': row, 'i': i}})
),
left_over AS (
  SELECT row, count(gone.p) AS n_removed,
    coalesce(string_agg(l[lines.p], chr(10) ORDER BY lines.p) FILTER (WHERE gone.p IS NULL), '') AS text
  FROM lines LEFT JOIN gone USING (row, p) GROUP BY row
)
SELECT doc_id, left_over.text AS text, coalesce(len(l), 0)::BIGINT AS n_lines,
  coalesce(n_removed, 0)::BIGINT AS n_removed
FROM docs LEFT JOIN left_over USING (row)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM roots LEFT JOIN sizes USING (doc_id)
"""

HARD_NEGATIVES = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS "rank", vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
