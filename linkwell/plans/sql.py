"""The same queries in DuckDB's SQL. Boundaries are spelt as consumed neighbours, as RE2 has no look-around."""

from __future__ import annotations

from linkwell.functions import text as T
from linkwell.functions.phonetic import CODES
from linkwell.operators.blocking import GENERIC

_D = r"[^\p{L}\p{N}_]"


def _words_out(column: str, words: list[str]) -> str:
    """column without whole words; two passes, as neighbours share a boundary."""
    pattern = rf"(^|{_D})(?:{'|'.join(sorted(words, key=len, reverse=True))})($|{_D})"
    once = f"regexp_replace({column}, '{pattern}', '\\1 \\2', 'gi')"
    return f"regexp_replace({once}, '{pattern}', '\\1 \\2', 'gi')"


_PLACE = "lower({0}) IN ('null', '<null>', 'nan', 'n/a', 'none')"
_SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_PUNCT = "regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
_URL = T.URL.removeprefix("(?i)")
_ABBR = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ABBREVIATIONS.items())

ENTITIES = f"""
words AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents),
ent AS (
  SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id, array_to_string(w[1:6], ' ') AS business_name,
    array_to_string(w[7:20], ' ') || ' ' || (doc_id % 900 + 100000) AS business_address, lang AS country,
    md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_key
  FROM words),
n0 AS (SELECT *, trim(business_name) AS a, trim(business_address) AS b FROM ent),
n1 AS (SELECT *, CASE WHEN {_PLACE.format('a')} THEN '' ELSE regexp_replace(regexp_replace(a, '{_URL}', ' ', 'gi'), '@[\\p{{L}}\\p{{N}}_]+', ' ', 'g') END AS c FROM n0),
n2 AS (SELECT *, regexp_replace(regexp_replace(c, '\\b5([a-zA-Z]{{3,}})\\b', 's\\1', 'g'), '([a-zA-Z]+)5([a-zA-Z]+)', '\\1s\\2', 'g') AS d FROM n1),
n3 AS (SELECT *, lower(strip_accents(regexp_replace(regexp_replace(d, '\\b6([a-zA-Z]{{3,}})\\b', 'g\\1', 'g'), '([a-zA-Z]+)6([a-zA-Z]+)', '\\1g\\2', 'g'))) AS e FROM n2),
n4 AS (SELECT *, regexp_replace(replace(e, '&', ' and '), '\\s+\\+\\s+', ' and ', 'g') AS f FROM n3),
n5 AS (SELECT *, {_SQUEEZE.format(_PUNCT.format(_words_out('f', T.LEGAL_SUFFIXES)))} AS name_norm,
  regexp_replace(lower(strip_accents({_words_out('b', ['null', '<null>', 'nan', 'n/a', 'none'])})), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g') AS g FROM n4),
norm AS (
  SELECT entity_id, business_name, business_address, country, text_key, name_norm,
    array_to_string(list_transform(string_split({_SQUEEZE.format('g')}, ' '), lambda t: CASE t {_ABBR} ELSE t END), ' ') AS address_norm,
    lower(trim(country)) AS country_norm,
    nullif(regexp_extract(b, '(?:^|{_D})([1-9][0-9]{{5}})(?:$|{_D})', 1), '') AS postal_code
  FROM n5),
full_norm AS (
  SELECT *, list_sort(list_distinct(list_filter(string_split(name_norm, ' '), lambda x: x <> ''))) AS name_tokens,
    list_filter(string_split(address_norm, ' '), lambda x: x <> '') AS address_tokens FROM norm),
s1 AS (SELECT * FROM full_norm WHERE entity_id LIKE 'S1%'),
ext AS (SELECT * FROM full_norm WHERE entity_id NOT LIKE 'S1%'),
truth AS (
  SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT ext.entity_id, ',' ORDER BY ext.entity_id), '') AS matched_entity_ids
  FROM s1 LEFT JOIN ext ON s1.country = ext.country AND s1.text_key = ext.text_key GROUP BY 1),
truth_pairs AS (SELECT s1.entity_id AS s1, ext.entity_id AS id FROM s1 JOIN ext ON s1.country = ext.country AND s1.text_key = ext.text_key),
stops AS (SELECT t AS key, count(*) AS n FROM (SELECT unnest(name_tokens) AS t FROM ext) GROUP BY 1 HAVING count(*) > 50),
stopped AS (SELECT t AS key FROM (SELECT unnest(name_tokens) AS t FROM ext) GROUP BY 1 HAVING count(*) > greatest(500, floor(0.005 * (SELECT count(*) FROM ext)))),
tok AS (SELECT country_norm AS part, t AS key, entity_id AS id FROM (SELECT country_norm, entity_id, unnest(name_tokens) AS t FROM ext) WHERE length(t) >= 2 AND t NOT IN (SELECT key FROM stopped)),
token_pairs AS (
  SELECT DISTINCT q.entity_id AS s1, tok.id FROM (SELECT entity_id, country_norm, unnest(name_tokens) AS key FROM s1) q JOIN tok ON tok.key = q.key AND tok.part = q.country_norm),
jac AS (
  SELECT p.s1, p.id, len(list_intersect(a.name_tokens, b.name_tokens)) AS common,
    len(list_distinct(list_concat(a.name_tokens, b.name_tokens))) AS any_
  FROM token_pairs p JOIN s1 a ON a.entity_id = p.s1 JOIN ext b ON b.entity_id = p.id)
"""


def q(body: str, more: str = "") -> str:
    return f"WITH {ENTITIES}{more}\n{body}"


_LINKED = ", linked AS (SELECT s1, id FROM jac WHERE common * 2 >= any_)"
_PRED = _LINKED + ", pred AS (SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT l.id, ',' ORDER BY l.id), '') AS matched_entity_ids FROM s1 LEFT JOIN linked l ON l.s1 = s1.entity_id GROUP BY 1)"
_SCORES = _PRED + """,
sets AS (SELECT t.source1_entity_id, list_filter(string_split(t.matched_entity_ids, ','), lambda x: x <> '') AS t, list_filter(string_split(p.matched_entity_ids, ','), lambda x: x <> '') AS p
  FROM truth t JOIN pred p USING (source1_entity_id)),
cnt AS (SELECT source1_entity_id, len(t) AS tc, len(p) AS pc, len(list_intersect(t, p)) AS c FROM sets),
pr AS (SELECT *, CASE WHEN tc = 0 AND pc = 0 THEN 1.0 WHEN tc = 0 OR pc = 0 THEN 0.0 ELSE c::DOUBLE / pc END AS precision_, CASE WHEN tc = 0 AND pc = 0 THEN 1.0 WHEN tc = 0 OR pc = 0 THEN 0.0 ELSE c::DOUBLE / tc END AS recall_ FROM cnt),
scores AS (SELECT *, CASE WHEN precision_ * recall_ = 0 THEN 0.0 ELSE 1.25 * precision_ * recall_ / (0.25 * precision_ + recall_) END AS f FROM pr)"""
_SPLIT = """, strata AS (SELECT source1_entity_id AS entity_id, least(len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')), 2) AS stratum FROM truth),
sized AS (SELECT *, round_even(count(*) OVER (PARTITION BY stratum) * 0.2, 0) AS take, row_number() OVER (PARTITION BY stratum ORDER BY md5(entity_id || '|42'), entity_id) AS place FROM strata),
parts AS (SELECT entity_id, stratum, CASE WHEN place <= take THEN 'val' ELSE 'train' END AS split FROM sized)"""
_FAKE = ", scored AS (SELECT s1 AS source1_entity_id, id AS candidate_entity_id, common::DOUBLE / any_ AS match_probability FROM jac)"
_LETTERS = "regexp_replace(upper(replace(name_norm, 'ß', 'ss')), '[^A-Z]', '', 'g')"
_SOUNDEX = "rpad(left(l, 1) || left(regexp_replace(array_to_string(list_filter(string_split(c, ''), lambda x, i: i > 1 AND x <> substr(c, i - 1, 1)), ''), '[^1-9]', '', 'g'), 3), 4, '0')"
_GENERIC = ", ".join(f"'{g}'" for g in GENERIC)

_ADDRESS = f""", codes AS (SELECT country_norm, postal_code, count(*) AS n FROM ext WHERE postal_code IS NOT NULL GROUP BY 1, 2 HAVING count(*) <= 1500),
by_code AS (SELECT s1.entity_id AS s1, ext.entity_id AS id FROM s1 JOIN ext ON s1.country_norm = ext.country_norm AND s1.postal_code = ext.postal_code JOIN codes c ON c.country_norm = ext.country_norm AND c.postal_code = ext.postal_code),
aw AS (SELECT country_norm, entity_id, unnest(address_tokens) AS t FROM ext), awf AS (SELECT * FROM aw WHERE length(t) >= 3 AND t NOT IN ({_GENERIC})),
astop AS (SELECT t FROM awf GROUP BY 1 HAVING count(*) > greatest(500, floor(0.01 * (SELECT count(*) FROM ext)))), ai AS (SELECT DISTINCT country_norm, t, entity_id FROM awf WHERE t NOT IN (SELECT t FROM astop)),
by_word AS (SELECT s.entity_id AS s1, ai.entity_id AS id FROM (SELECT entity_id, country_norm, unnest(list_distinct(address_tokens)) AS t FROM s1) s JOIN ai ON ai.t = s.t AND ai.country_norm = s.country_norm GROUP BY 1, 2 HAVING count(*) >= 2)"""
_LENGTHS = ", lengths AS (SELECT entity_id, length(business_name) AS c, CASE WHEN business_name = '' THEN 0 ELSE length(business_name) - length(replace(business_name, ' ', '')) + 1 END AS w FROM ent)"


_VIOLATED = _LINKED + """, half AS (SELECT s1, id FROM linked WHERE id LIKE 'S2%'),
violated AS (SELECT x.s1 AS source1_entity_id, string_agg(x.id, ',' ORDER BY x.id) AS extra FROM truth_pairs x LEFT JOIN half USING (s1, id) WHERE half.id IS NULL GROUP BY 1)"""


def _sweep(mode: str) -> str:
    """sweep_<mode>: macro scores at every threshold; top1 keeps each entity's best candidate."""
    only = "" if mode == "multi" else " WHERE place = 1"
    return f""", pool_{mode} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY match_probability DESC, candidate_entity_id) AS place FROM scored){only}),
th_{mode} AS (SELECT 0.05::DOUBLE + i * 0.05::DOUBLE AS threshold FROM range(19) r(i)),
hits_{mode} AS (SELECT th.threshold, t.source1_entity_id, (SELECT count(*) FROM truth_pairs x WHERE x.s1 = t.source1_entity_id) AS tc, count(s.candidate_entity_id) AS pc, count(x.id) AS c
  FROM th_{mode} th CROSS JOIN truth t LEFT JOIN pool_{mode} s ON s.source1_entity_id = t.source1_entity_id AND s.match_probability >= th.threshold LEFT JOIN truth_pairs x ON x.s1 = s.source1_entity_id AND x.id = s.candidate_entity_id GROUP BY 1, 2),
rates_{mode} AS (SELECT threshold, CASE WHEN tc = 0 AND pc = 0 THEN 1.0 WHEN tc = 0 OR pc = 0 THEN 0.0 ELSE c::DOUBLE / pc END AS p, CASE WHEN tc = 0 AND pc = 0 THEN 1.0 WHEN tc = 0 OR pc = 0 THEN 0.0 ELSE c::DOUBLE / tc END AS r FROM hits_{mode}),
sweep_{mode} AS (SELECT round(threshold, 4) AS threshold, '{mode}' AS mode, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p * r = 0 THEN 0.0 ELSE 1.25 * p * r / (0.25 * p + r) END), 6) AS macro_f_beta, count(*) AS evaluated_entities FROM rates_{mode} GROUP BY threshold)"""


ORACLE_SQL = {
    "normalized_entities": q("SELECT entity_id, name_norm, address_norm, country_norm, postal_code, array_to_string(name_tokens, ' ') AS name_tokens, array_to_string(address_tokens, ' ') AS address_tokens FROM full_norm"),
    "token_linked_records": q("SELECT * FROM pred", _PRED.replace("linked l", "linked l")),
    "stop_tokens": q("SELECT key, CAST(n AS BIGINT) AS n FROM stops"),
    "soundex_codes": q(
        f"SELECT entity_id, CASE WHEN l = '' THEN '' ELSE {_SOUNDEX} END AS code "
        f"FROM (SELECT entity_id, l, translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{CODES}') AS c FROM (SELECT entity_id, {_LETTERS} AS l FROM full_norm))"
    ),
    "sorted_neighbours": q(
        "SELECT DISTINCT a.s1, e.id FROM asked a JOIN listed e ON a.part = e.part AND e.place BETWEEN a.p - 10 AND a.p + 10",
        """, sn AS (SELECT country_norm AS part, name_norm AS name, entity_id AS id, NULL AS s1 FROM ext WHERE name_norm <> '' UNION ALL SELECT country_norm, name_norm, NULL, entity_id FROM s1 WHERE name_norm <> '' AND country_norm IN (SELECT country_norm FROM ext WHERE name_norm <> '')),
ranked AS (SELECT *, sum(CASE WHEN id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY part ORDER BY name, id IS NOT NULL, id, s1 ROWS UNBOUNDED PRECEDING) AS place FROM sn),
listed AS (SELECT part, place - 1 AS place, id FROM ranked WHERE id IS NOT NULL), asked AS (SELECT part, place AS p, s1 FROM ranked WHERE s1 IS NOT NULL)""",
    ),
    "postal_address_candidates": q("SELECT * FROM by_code UNION SELECT * FROM by_word", _ADDRESS),
    "phonetic_candidates": q(
        "SELECT DISTINCT a.id AS s1, b.id FROM pkeys a JOIN pkeys b USING (part, key) JOIN psizes USING (part, key) WHERE a.id LIKE 'S1%' AND b.id NOT LIKE 'S1%'",
        f""", pw AS (SELECT entity_id AS id, country_norm AS part, list_filter(string_split(name_norm, ' '), lambda x: length(x) >= 2) AS w FROM full_norm),
pt AS (SELECT id, part, unnest(w) AS t FROM pw), pl AS (SELECT *, {_LETTERS.replace('name_norm', 't')} AS l FROM pt),
pc AS (SELECT *, translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{CODES}') AS c FROM pl WHERE l <> ''),
pkeys AS (
  SELECT DISTINCT id, part, 'sx_' || {_SOUNDEX} AS key FROM pc UNION SELECT id, part, 'p3_' || left(t, 3) FROM pt UNION SELECT id, part, 'first_' || left(w[1], 4) FROM pw WHERE len(w) > 0),
psizes AS (SELECT part, key FROM pkeys WHERE id NOT LIKE 'S1%' GROUP BY 1, 2 HAVING count(*) <= 2000)""",
    ),
    "pair_features": q(
        """SELECT p.s1 AS source1_entity_id, p.id AS candidate_entity_id, CAST(a.business_name = b.business_name AS INTEGER) AS name_exact_raw, CAST(a.name_norm = b.name_norm AND a.name_norm <> '' AS INTEGER) AS name_exact_norm,
  round(p.common::DOUBLE / p.any_, 6) AS name_jaccard_tokens, CAST(p.common AS INTEGER) AS name_token_overlap_count, CAST(a.address_norm = b.address_norm AND a.address_norm <> '' AS INTEGER) AS address_exact_norm,
  CAST(a.postal_code IS NOT NULL AND b.postal_code IS NOT NULL AS INTEGER) AS postal_available, CAST(coalesce(a.postal_code = b.postal_code, FALSE) AS INTEGER) AS postal_exact_match,
  CASE WHEN p.id LIKE 'S3%' THEN 1 ELSE 0 END AS candidate_source_id, CAST(row_number() OVER (PARTITION BY p.s1 ORDER BY p.common::DOUBLE / p.any_ DESC, p.id) AS INTEGER) AS candidate_rank_in_group, CAST(count(*) OVER (PARTITION BY p.s1) AS INTEGER) AS candidate_set_size
FROM jac p JOIN s1 a ON a.entity_id = p.s1 JOIN ext b ON b.entity_id = p.id"""
    ),
    "entity_scores": q("SELECT source1_entity_id, CAST(tc AS INTEGER) AS true_count, CAST(pc AS INTEGER) AS pred_count, CAST(c AS INTEGER) AS correct_count, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f, 6) AS f_beta FROM scores", _SCORES),
    "macro_scores": q("SELECT round(avg(precision_), 6) AS macro_precision, round(avg(recall_), 6) AS macro_recall, round(avg(f), 6) AS macro_f_beta, count(*) AS evaluated_entities FROM scores", _SCORES),
    "stratified_split": q("SELECT entity_id, CAST(stratum AS INTEGER) AS stratum, split FROM parts", _SPLIT),
    "split_distribution": q("SELECT split, CAST(stratum AS INTEGER) AS stratum, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM parts GROUP BY 1, 2", _SPLIT),
    "subset_violations": q("SELECT * FROM violated", _VIOLATED),
    "output_validation": q(
        "SELECT (SELECT count(*) FROM s1 WHERE entity_id NOT IN (SELECT source1_entity_id FROM truth)) AS missing_matches, CAST(0 AS BIGINT) AS unknown_matches, (SELECT count(*) FROM s1 WHERE entity_id NOT IN (SELECT s1 FROM half)) AS missing_candidates, CAST(0 AS BIGINT) AS unknown_candidates, (SELECT count(*) FROM violated) AS violations, count(*) AS rows, (SELECT count(*) FROM truth_pairs) AS matched_references, count(*) FILTER (matched_entity_ids = '') AS singletons FROM truth",
        _VIOLATED,
    ),
    "match_count_histogram": q(
        "SELECT b.bucket, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM (VALUES ('0'), ('1'), ('2'), ('3'), ('4'), ('5+')) b(bucket) LEFT JOIN h USING (bucket)",
        ", h AS (SELECT CASE WHEN m >= 5 THEN '5+' ELSE m::VARCHAR END AS bucket, count(*) AS n FROM (SELECT len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')) AS m FROM truth) GROUP BY 1)",
    ),
    "matched_source_shares": q("SELECT left(id, 2) AS source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM truth_pairs GROUP BY 1"),
    "unreferenced_externals": q("SELECT entity_id FROM ext WHERE entity_id NOT IN (SELECT id FROM truth_pairs)"),
    "id_quality": q("SELECT left(entity_id, 2) AS source, count(*) AS n, count(*) - count(DISTINCT entity_id) AS duplicates, CAST(count(*) FILTER (name_norm = '') AS BIGINT) AS empty_names, bool_and(starts_with(entity_id, 'S')) AS prefixed FROM full_norm GROUP BY 1"),
    "field_stats": q("SELECT left(entity_id, 2) AS source, round(avg(c), 6) AS mean_chars, median(c) AS median_chars, CAST(min(c) AS INTEGER) AS min_chars, CAST(max(c) AS INTEGER) AS max_chars, round(avg(w), 6) AS mean_tokens, median(w) AS median_tokens, CAST(min(w) AS INTEGER) AS min_tokens, CAST(max(w) AS INTEGER) AS max_tokens FROM lengths GROUP BY 1", _LENGTHS),
    "name_length_histogram": q("SELECT CAST(CASE WHEN c >= 100 THEN 51 ELSE floor(c / 2.0) + 1 END AS BIGINT) AS bin, count(*) AS n FROM lengths GROUP BY 1", _LENGTHS),
    "null_counts": q("SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in ("entity_id", "business_name", "business_address", "country", "text_key")) + " FROM ent"),
    "reverse_truth": q("SELECT id AS matched_id, max(s1) AS source1_entity_id FROM truth_pairs GROUP BY 1"),
    "orphan_matches": q("SELECT DISTINCT id AS matched_id FROM truth_pairs WHERE id NOT IN (SELECT entity_id FROM ext WHERE entity_id LIKE 'S2%')"),
    "id_set_differences": q("SELECT count(*) FILTER (matched_entity_ids = '') AS only_left, CAST(0 AS BIGINT) AS only_right FROM truth"),
    "empty_baseline": q("SELECT round(avg(e), 6) AS macro_precision, round(avg(e), 6) AS macro_recall, round(avg(e), 6) AS macro_f_beta, count(*) AS evaluated_entities FROM (SELECT CASE WHEN matched_entity_ids = '' THEN 1.0 ELSE 0.0 END AS e FROM truth)"),
    "class_balance": q("SELECT count(t.id) AS positives, count(*) - count(t.id) AS negatives, round((count(*) - count(t.id))::DOUBLE / nullif(count(t.id), 0), 6) AS ratio FROM jac j LEFT JOIN truth_pairs t ON t.s1 = j.s1 AND t.id = j.id"),
    "candidate_set_sizes": q("SELECT round(avg(n), 6) AS mean, median(n) AS median, max(n) AS max, round(avg(CASE WHEN n >= 50 THEN 1.0 ELSE 0.0 END), 6) AS at_cap FROM (SELECT count(*) AS n FROM jac GROUP BY s1)"),
    "score_distribution": q(
        "SELECT round(avg(p), 6) AS mean, round(median(p), 6) AS median, round(stddev_samp(p), 6) AS std, round(min(p), 6) AS min, round(max(p), 6) AS max, " + ", ".join(f"round(avg(CASE WHEN p {o} {x} THEN 1.0 ELSE 0.0 END), 6) AS {n}" for n, o, x in (("below_30", "<", 0.3), ("below_40", "<", 0.4), ("below_50", "<", 0.5), ("from_60", ">=", 0.6))) + " FROM (SELECT common::DOUBLE / any_ AS p FROM jac)"
    ),
    "blocking_recall": q(
        "SELECT strategy, count(*) AS hits, (SELECT count(*) FROM truth_pairs) AS total, round(count(*)::DOUBLE / (SELECT count(*) FROM truth_pairs), 6) AS recall FROM (SELECT 'token' AS strategy, s1, id FROM token_pairs UNION SELECT 'postal_address', s1, id FROM by_address UNION SELECT 'any', s1, id FROM (SELECT s1, id FROM token_pairs UNION SELECT s1, id FROM by_address)) f JOIN truth_pairs USING (s1, id) GROUP BY 1",
        _ADDRESS + ", by_address AS (SELECT * FROM by_code UNION SELECT * FROM by_word)",
    ),
    "top1_sweep": q("SELECT * FROM sweep_top1", _FAKE + _sweep("top1")),
    "best_threshold": q("SELECT * FROM (SELECT * FROM sweep_multi UNION ALL SELECT * FROM sweep_top1) ORDER BY macro_f_beta DESC, mode, threshold LIMIT 1", _FAKE + _sweep("multi") + _sweep("top1")),
    "country_by_source": q("SELECT country, count(*) FILTER (entity_id LIKE 'S1%') AS S1, count(*) FILTER (entity_id LIKE 'S2%') AS S2, count(*) FILTER (entity_id LIKE 'S3%') AS S3 FROM ent GROUP BY 1"),
    "stratified_sample": q(
        "SELECT entity_id, CAST(stratum AS INTEGER) AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(entity_id || '|7'), entity_id) AS place FROM (SELECT source1_entity_id AS entity_id, least(len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')), 3) AS stratum FROM truth)) WHERE place <= CASE stratum WHEN 1 THEN 35 WHEN 2 THEN 25 WHEN 3 THEN 20 ELSE 0 END"
    ),
    "training_sample": q(
        "SELECT source1_entity_id, candidate_entity_id, label FROM kinds WHERE kind <> 'fuzzy' UNION ALL SELECT source1_entity_id, candidate_entity_id, label FROM (SELECT *, row_number() OVER (ORDER BY md5(source1_entity_id || '|' || candidate_entity_id || '|42'), source1_entity_id, candidate_entity_id) AS place FROM kinds WHERE kind = 'fuzzy') WHERE place <= (SELECT greatest(0, round(count(*) FILTER (kind = 'positive') * 15.0) - count(*) FILTER (kind = 'exact')) FROM kinds)",
        ", lab AS (SELECT j.s1 AS source1_entity_id, j.id AS candidate_entity_id, CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS label, CASE WHEN j.common >= 3 THEN 1 ELSE 0 END AS tier FROM jac j LEFT JOIN truth_pairs t ON t.s1 = j.s1 AND t.id = j.id), kinds AS (SELECT *, CASE WHEN label = 1 THEN 'positive' WHEN tier = 1 THEN 'exact' ELSE 'fuzzy' END AS kind FROM lab)",
    ),
    "threshold_sweep": q("SELECT * FROM sweep_multi", _FAKE + _sweep("multi")),
    "name_tfidf_cosines": q(
        "SELECT p.s1, p.id, round(least(1.0, coalesce(sum(x.w * y.w), 0.0)), 6) AS cosine FROM token_pairs p JOIN s1 a ON a.entity_id = p.s1 JOIN ext b ON b.entity_id = p.id LEFT JOIN unit x ON x.t = a.name_norm LEFT JOIN unit y ON y.t = b.name_norm AND y.term = x.term WHERE y.term IS NOT NULL OR NOT EXISTS (SELECT 1 FROM unit u JOIN unit v ON u.term = v.term WHERE u.t = a.name_norm AND v.t = b.name_norm) GROUP BY 1, 2",
        """, dn AS (SELECT DISTINCT name_norm AS t FROM full_norm), ws AS (SELECT t, list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM dn),
tm AS (SELECT t, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ws),
tf AS (SELECT t, term, count(*) AS tf FROM tm GROUP BY 1, 2), df AS (SELECT term, ln((1 + (SELECT count(*) FROM dn)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY 1),
raw AS (SELECT t, term, tf * idf AS w FROM tf JOIN df USING (term)), unit AS (SELECT t, term, w / sqrt(sum(w * w) OVER (PARTITION BY t)) AS w FROM raw)""",
    ),
}
