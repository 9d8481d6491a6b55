"""DuckDB SQL for the operators whose results plain SQL can state."""

from __future__ import annotations

from . import chat_format, laesa, mixing
from . import secret_scan as S

#: (id, root) pairs of everything that links reach, then the smallest per id.
_CLOSURE = """
    reach(id, root) AS (
      SELECT id, id FROM nodes
      UNION
      SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.id),
    comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""


def jaccard_sql() -> str:
    return rf"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
      FROM words),
    nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets),
    shingles AS (SELECT doc_id AS id, unnest(s) AS t FROM sets),
    shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.t = b.t AND a.id < b.id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    {_CLOSURE}
    SELECT id AS doc_id, n::BIGINT AS n_shingles, component_id FROM nodes JOIN comp USING (id)"""


def vectors_sql() -> str:
    return f"""
    WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
    usable AS (
      SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.id < b.id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    {_CLOSURE}
    SELECT id AS vec_id, (SELECT count(*) FROM both_ways l WHERE l.a = c.id)::BIGINT AS n_links, component_id, component_id = id AS kept
    FROM comp c"""


def secrets_sql() -> str:
    """Places from what a regular-expression split leaves between the matches; entropy counted anew per window."""
    def lit(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"
    kinds = (("assign", S.ASSIGN), ("access", S.ACCESS), ("hex", S.HEX), ("entropy", S.CANDIDATE))
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ord, regexp_extract_all(t, {lit(p)}) AS m, string_split_regex(t, {lit(p)}) AS rest FROM texts"
        for i, (_, p) in enumerate(kinds))
    hex_, upper, mixed = (bits for _, bits in S.CLASSES)
    allowed = " OR ".join(f"regexp_matches(m, {lit(p)})" for p in S.ALLOW)
    w = S.WINDOW
    return rf"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({found}),
    placed AS (
      SELECT doc_id, ord, m[i] AS m,
             (list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
    base AS (
      SELECT doc_id, ord, start, start + length(m) AS stop FROM placed
      WHERE ord IN (1, 2) OR ord = 0 AND length(regexp_extract(m, {lit(S.ASSIGN)}, 2)) >= {S.MIN_VALUE}),
    cand AS (
      SELECT doc_id, start, m, CASE
          WHEN NOT regexp_matches(m, '[0-9]') THEN NULL
          WHEN regexp_full_match(m, '[0-9a-f]+|[0-9A-F]+') THEN {hex_}
          WHEN NOT regexp_matches(m, '[A-Z]') THEN NULL
          WHEN regexp_full_match(m, '[0-9A-Z]+') THEN {upper}
          WHEN regexp_matches(m, '[a-z]') THEN {mixed} END AS bits
      FROM placed WHERE ord = 3 AND NOT ({allowed})),
    chars AS (
      SELECT doc_id, start, bits, i, unnest(string_split(substr(m, i + 1, {w}), '')) AS ch
      FROM (SELECT *, unnest(range(0, length(m) - {w - 1})) AS i FROM cand WHERE bits IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = cand.doc_id AND b.start <= cand.start AND cand.start + length(m) <= b.stop))),
    windows AS (
      SELECT doc_id, start, bits, i, sum(c * log2(c)) AS s
      FROM (SELECT doc_id, start, bits, i, ch, count(*) AS c FROM chars GROUP BY ALL) GROUP BY ALL),
    added AS (
      SELECT doc_id, 3 AS ord, start + min(i) AS start, start + max(i) + {w} AS stop FROM windows w2
      WHERE s <= {w} * (log2({w}) - bits) + 1e-9 GROUP BY doc_id, w2.start),
    spans AS (
      SELECT *, ['assign', 'access', 'hex', 'entropy'][ord + 1] || ':' || start || ':' || stop AS shown
      FROM (SELECT * FROM base UNION ALL SELECT doc_id, ord, start, stop FROM added))
    SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
           sha256(coalesce(string_agg(shown, ',' ORDER BY start, ord, stop) FILTER (ord < 3), '')) AS base_sha256,
           coalesce(string_agg(shown, ',' ORDER BY start, ord, stop), '') AS spans
    FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


ORACLES = {
    "op3_chat_formatting": chat_format.oracle_sql(),
    "op4_embedding_near_dedup": vectors_sql(),
    "op8_secret_scan": secrets_sql(),
    "op9_ngram_jaccard_join": jaccard_sql(),
    "op10_source_mixing": mixing.oracle_sql(),
    "op12_centroid_clustering": laesa.oracle_sql(),
}
