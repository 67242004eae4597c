"""DuckDB SQL of the operators that SQL can express."""

from palisade.llm.urls import BLOCK_GLOBS, SITE_RULES

LLM_ORACLES: dict[str, str] = {}

LLM_ORACLES["op2_topk"] = """
WITH v AS (
    SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.k, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.k <> b.k
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

_rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.name}', {i})" for i, r in enumerate(SITE_RULES))
_block = " OR ".join(f"host || path LIKE '{g.replace('*', '%')}'" for g in BLOCK_GLOBS)
LLM_ORACLES["op10_urls"] = f"""
WITH rules(verdict, rhost, rpath, name, n) AS (VALUES {_rules}), cut AS (
    SELECT row_number() OVER () AS k, page_id,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT k, page_id,
        translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), best AS (
    SELECT k, arg_max(name, len(name) * 1000 - n) AS rule, arg_max(verdict, len(name) * 1000 - n) AS verdict
    FROM parts, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k
)
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN {_block} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (k)
"""

MIXED = """
sized AS (
    SELECT doc_id, source, md5(concat_ws('|', 'mix', doc_id::VARCHAR, md5(text))) AS h, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
    FROM {docs}
), ranked AS (SELECT *, (('0x' || substr(h, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656 AS u FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM ranked GROUP BY source),
named AS (
    SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS n, 2 * source_size AS cap FROM sizes
), weighted AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1] AS weight FROM named),
filling AS (
    SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER f, 0) AS words_left,
        2 * (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS weight_left
    FROM weighted WINDOW f AS (ORDER BY cap::DOUBLE / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (SELECT *, words_left::DOUBLE * weight > cap::DOUBLE * weight_left AS over FROM filling),
level AS (SELECT arg_min(words_left, (cap::DOUBLE / weight, n)) AS l, arg_min(weight_left, (cap::DOUBLE / weight, n)) AS w FROM judged WHERE NOT over),
targets AS (
    SELECT source, source_size, CASE WHEN over THEN cap::DOUBLE ELSE (l * weight)::DOUBLE / w::DOUBLE END AS target FROM judged, level
), shares AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected, least(floor(expected), 2)::BIGINT AS certain,
        expected - certain AS f, target - certain * source_size AS need FROM targets
), bands AS (SELECT source, len(bin(size)) AS band, sum(size)::BIGINT AS words FROM ranked GROUP BY ALL
), plan AS (
    SELECT b.source, band, source_size, target, certain, need, CASE WHEN f > 0 THEN f * (1 + 0.5::DOUBLE * least(1.0::DOUBLE, (1 - f) / f) * (1 - 2 *
        ((coalesce(sum(words) OVER (PARTITION BY b.source ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2)
        / source_size))) ELSE 0 END AS p
    FROM bands b JOIN shares s ON b.source IS NOT DISTINCT FROM s.source
), placed AS (
    SELECT doc_id, text, r.source, size, source_size, target, certain, p, need, u / (1 - u) * (1 - p) / p AS q
    FROM ranked r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source AND len(bin(r.size)) = plan.band
), summed AS (
    SELECT *, p > 0 AND coalesce(sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 <= need AS extra FROM placed
), mixed AS (SELECT *, certain + extra::BIGINT AS copies FROM summed)
"""
LLM_ORACLES["op3_mixing"] = "WITH " + MIXED.format(docs="documents") + """
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed
"""

CONTAINED = """
lists AS (
    SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS k, regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}
    UNION ALL
    SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') FROM benchmark
), cut AS (
    SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1),
        lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM lists
), items AS (SELECT id AS item_id, k, s, count(*) OVER (PARTITION BY k) AS n FROM cut WHERE kind = 'b'),
contained AS (
    SELECT d.id AS doc_id, d.k AS doc_k, item_id, any_value(n) AS n_shingles, count(*) AS found
    FROM cut d JOIN items USING (s) WHERE d.kind = 'd' GROUP BY d.id, d.k, item_id, items.k HAVING count(*) >= ceil(round(any_value(n) * 0.8, 9))
)
"""
LLM_ORACLES["op5_decontaminate"] = "WITH " + CONTAINED.format(docs="documents") + """
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, found::INTEGER AS found, found / n_shingles AS containment FROM contained
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# crc32 by its table: entry i is i shifted right eight times, the polynomial added whenever a one falls out.
LLM_ORACLES["op12_resample"] = rf"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), texts AS (
    SELECT 'd' AS kind, doc_id, row_number() OVER () AS k, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents
    UNION ALL
    SELECT 'b', NULL, row_number() OVER (), regexp_extract_all({_LOWER}, '{_PLAIN}') FROM benchmark
), features AS (
    SELECT kind, k, unnest(w) AS f FROM texts
    UNION ALL
    SELECT kind, k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts
), counted AS (SELECT kind, k, f, count(*) AS n FROM features GROUP BY ALL
), spelled AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), buckets AS (
    SELECT f, xor(list_reduce(list_transform(range(0, len(h), 2), lambda i: ('0x' || h[i + 1:i + 2])::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM spelled, crc
), placed AS (SELECT kind, k, bucket, n FROM counted JOIN buckets USING (f)
), totals AS (SELECT sum(n) FILTER (kind = 'd') AS s_all, sum(n) FILTER (kind = 'b') AS t_all FROM placed
), gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (kind = 'b'), 0) + 1)::DOUBLE * (any_value(s_all) + 10000)::DOUBLE
        / ((coalesce(sum(n) FILTER (kind = 'd'), 0) + 1)::DOUBLE * (coalesce(any_value(t_all), 0) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM placed, totals GROUP BY bucket
), weights AS (
    SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
    FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY k
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM texts LEFT JOIN weights USING (k) WHERE kind = 'd'
), placed_rows AS (
    SELECT *, n_words >= 20 AND doc_id IS NOT NULL AS enough, row_number() OVER (PARTITION BY n_words >= 20 AND doc_id IS NOT NULL
        ORDER BY score DESC, doc_id, n_features, weight) AS r, count(*) FILTER (n_words >= 20 AND doc_id IS NOT NULL) OVER () AS n_enough FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= 25 * n_enough // 100 THEN r END AS rank FROM placed_rows
"""

LLM_ORACLES["op13_search"] = rf"""
WITH docs AS (
    SELECT * FROM (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents) WHERE len(w) > 0
), size AS (SELECT count(*)::BIGINT AS n_all, sum(len(w))::BIGINT AS l_all FROM docs
), items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_PLAIN}')) AS term FROM benchmark WHERE item_id IS NOT NULL
), held AS (
    SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weighed AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM held, size GROUP BY term
), valued AS (
    SELECT doc_id, k, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(w)::HUGEINT * n_all) // l_all)::BIGINT))) AS value
    FROM held JOIN weighed USING (term) JOIN docs USING (k), size
), scored AS (
    SELECT item_id, doc_id, sum(value)::BIGINT AS score FROM items JOIN valued USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, k
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0
)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 50
"""
