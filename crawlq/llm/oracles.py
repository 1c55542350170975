"""SQL for a second engine, where it can express an operator on whole tables."""

from __future__ import annotations

from crawlq.llm.centroids import CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED
from crawlq.llm.decontamination import BREAKS, UPPER, WORDS
from crawlq.llm.quality_rules import FEATURES, MAX_REPEAT_PERCENT, MIN_WORDS, PRIOR, SPREAD, WINDOW
from crawlq.llm.ranked_search import TOP

_SPACE = r"\x20\x09-\x0D"
_BINS = ", ".join(f"CAST({bin_of.replace(' DIV ', ' // ')} AS BIGINT) AS {name}" for name, (bin_of, _) in FEATURES.items())
_SLACK = "CASE feature " + " ".join(f"WHEN '{name}' THEN {slack}" for name, (_, slack) in FEATURES.items()) + " END"


def _fences(*keys: str) -> str:
    """Per keys and feature: how many documents, and the largest bin that passes."""
    group = ", ".join([*keys, "feature"])
    quantile = lambda q: f"min(bin) FILTER (WHERE bin > 0 AND (r - n0) * 100 >= (n - n0) * {q})"
    return f"""SELECT {group}, n, {_SLACK} + ((coalesce(least(1000, median + {SPREAD} * (median - low) + {_SLACK}) - {_SLACK}, 0) * (n - n0)) // n * (n - n0)) // n AS fence
  FROM (SELECT {group}, max(n) AS n, max(n0) AS n0, {quantile(50)} AS median, {quantile(10)} AS low
    FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY bin) AS r, count(*) OVER (PARTITION BY {group}) AS n,
      count(*) FILTER (WHERE bin = 0) OVER (PARTITION BY {group}) AS n0 FROM bins) GROUP BY {group})"""


QUALITY_RULES = f"""WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT *, list_filter(string_split_regex(t, '[{_SPACE}]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls FROM texts
), windows AS (
  SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut WHERE len(w) >= {WINDOW})
), found AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM found) GROUP BY rid
), counts AS (
  SELECT rid, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[{_SPACE}]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS n_run_words, coalesce(n, 0) AS n_repeat_words
  FROM cut LEFT JOIN covered USING (rid)
), binned AS (SELECT rid, lang, source, {_BINS} FROM counts
), bins AS (
  UNPIVOT binned ON {', '.join(FEATURES)} INTO NAME feature VALUE bin
), own AS ({_fences("lang", "source")}), by_lang AS ({_fences("lang")}), every AS ({_fences()}
), verdicts AS (
  SELECT b.rid, bool_and(b.bin <= (o.n * o.fence + {PRIOR} * ((l.n * l.fence + {PRIOR} * e.fence) // (l.n + {PRIOR}))) // (o.n + {PRIOR})) AS passes
  FROM bins b JOIN own o ON b.lang IS NOT DISTINCT FROM o.lang AND b.source IS NOT DISTINCT FROM o.source AND b.feature = o.feature
    JOIN by_lang l ON b.lang IS NOT DISTINCT FROM l.lang AND b.feature = l.feature JOIN every e ON b.feature = e.feature
  GROUP BY b.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND passes AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS failed FROM counts) JOIN verdicts USING (rid)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

RANKED_SEARCH = f"""WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, '{_TERM}') AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all({_LOWERED}, '{_TERM}')) AS w FROM benchmark
), asked AS MATERIALIZED (SELECT item, item_id, unnest(w) AS term FROM items
), size AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM docs
), counts AS MATERIALIZED (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), size
), damped AS (SELECT rid, doc_id, 100 - 90 + ((90 * len(w) * n_docs) // n_terms) AS m FROM docs, size WHERE len(w) > 0
), scores AS (
  SELECT item, item_id, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN damped USING (rid) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""

_WORDS = f"list_filter(string_split_regex({_LOWERED}, '{BREAKS}'), lambda x: x <> '')"

DECONTAMINATION = f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), items AS (SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, list_slice(w, i, i + {WORDS - 1}) AS g
  FROM (SELECT item_id, w, unnest(range(1, 1 + greatest(1, len(w) - {WORDS - 1}))) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(g) AS k FROM windows
), places AS (
  SELECT rid, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)
), found AS MATERIALIZED (SELECT rid, i, k, item_id FROM places JOIN windows USING (g)
), hits AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM found) GROUP BY rid
), names AS (
  SELECT rid, count(DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null')) AS n_items,
    array_to_string(list_sort(list(DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null'))), ',') AS listed
  FROM found GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN names USING (rid)"""


def _rounds() -> str:
    """Each round of the clustering as tables of its own: squared distances by component, the nearest centroid, floors of the means."""
    text = ""
    for r in range(ROUNDS + 1):
        text += f""", d{r} AS MATERIALIZED (
  SELECT v.rid, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM parts v JOIN c{r} c ON v.i = c.i GROUP BY v.rid, c.cluster
), a{r} AS MATERIALIZED (SELECT rid, distance, cluster FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
)"""
        if r < ROUNDS:
            text += f""", m{r} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN a{r} USING (rid) GROUP BY cluster, i
), c{r + 1} AS MATERIALIZED (
  SELECT cluster, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN m{r} USING (cluster, i)
)"""
    return text


CENTROIDS = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor({SCALE}.0::DOUBLE * x) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), parts AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(0, {DIMENSIONS})) AS i FROM kept
), first AS (
  SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS cluster FROM kept
  QUALIFY cluster < {CLUSTERS}
), c0 AS MATERIALIZED (SELECT cluster, unnest(v) AS x, unnest(range(0, {DIMENSIONS})) AS i FROM first
){_rounds()}, sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster
), digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{ROUNDS}) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN kept USING (rid) JOIN sums USING (cluster) JOIN digests USING (cluster)"""

ORACLES = {
    "op8_quality_rules": QUALITY_RULES,
    "op11_ranked_search": RANKED_SEARCH,
    "op12_decontamination": DECONTAMINATION,
    "op13_centroid_clustering": CENTROIDS,
}
