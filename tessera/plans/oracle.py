"""DuckDB SQL for the named queries: the same rows, written apart from the Spark plans."""

from __future__ import annotations

from tessera.functions.text import LEGAL_FORMS

_NORM = r"trim(regexp_replace(lower(strip_accents({0})), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
# letters with accents fall apart into the letter and a mark, which is no word character
_SPLIT = "list_aggregate(list_transform(string_split(lower({0}), ''), lambda c: CASE WHEN strip_accents(c) = c THEN c ELSE strip_accents(c) || ' ' END), 'string_agg', '')"
_AUDIT = r"trim(regexp_replace(regexp_replace(" + _SPLIT + r", '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
norm, audit_norm = _NORM.format, _AUDIT.format

_BASE = rf"""
WITH rec AS (
  SELECT s || '-' || doc_id AS entity_id, s AS source, lang AS country, substr(text, 1, 60) AS truth_key,
    CASE WHEN s = 'S1' OR doc_id % 5 = 4 THEN n WHEN doc_id % 5 = 0 THEN replace(n, 'e', 'E') WHEN doc_id % 5 = 1 THEN n || ' Pvt. Ltd.'
         WHEN doc_id % 5 = 2 THEN replace(n, ' ', '-') || ', Inc' ELSE substr(text, 1, 30) END AS business_name,
    CASE WHEN s <> 'S1' AND doc_id % 20 = 7 THEN '' ELSE substr(text, 41, 40) END AS business_address
  FROM (SELECT *, 'S' || (doc_id % 3 + 1) AS s, substr(text, 1, 40) AS n FROM documents)),
gt AS (SELECT a.entity_id AS s1_id, b.entity_id AS target_id, b.source AS target_source
       FROM rec a JOIN rec b ON a.country = b.country AND a.truth_key = b.truth_key WHERE a.source = 'S1' AND b.source <> 'S1'),
gs AS (SELECT r.entity_id AS source1_entity_id, r.country, count(g.target_id)::INT AS match_count FROM rec r LEFT JOIN gt g ON r.entity_id = g.s1_id
       WHERE r.source = 'S1' GROUP BY ALL),
sp AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || source1_entity_id), source1_entity_id) <= round(0.2 * count(*) OVER (PARTITION BY stratum)) AS is_val
       FROM (SELECT *, country || '_' || CASE match_count WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE 'multi' END AS stratum FROM gs)),
val AS (SELECT source1_entity_id FROM sp WHERE is_val)
"""
_NORMED = rf""",
nb AS (SELECT *, {norm("business_name")} AS norm_name, {norm("business_address")} AS norm_addr FROM rec),
nrm AS (SELECT *, coalesce(nullif(trim(regexp_replace(norm_name, '(?i)\b({LEGAL_FORMS})\b$', '')), ''), norm_name) AS norm_name_legal FROM nb),
s1 AS (SELECT * FROM nrm WHERE source = 'S1'),
s1v AS (SELECT * FROM s1 WHERE entity_id IN (SELECT source1_entity_id FROM val)),
t AS (SELECT * FROM nrm WHERE source <> 'S1')
"""

_FIELDS = {
    "raw_name": ["business_name"], "norm_name": ["norm_name"], "raw_addr": ["business_address"], "norm_addr": ["norm_addr"], "norm_name_and_addr": ["norm_name", "norm_addr"],
}
_BLOCKED = {**_FIELDS, "legal_norm_name": ["norm_name_legal"], "legal_norm_name_and_addr": ["norm_name_legal", "norm_addr"]}
_ON = {
    key: " AND ".join([*(["a.country = t.country"] if blocked else []), *[f"a.{f} = t.{f} AND a.{f} <> ''" for f in fields]])
    for blocked, group in ((False, _FIELDS), (True, _BLOCKED)) for key, fields in ((f"country_{k}" if blocked else k, v) for k, v in group.items())
}


def _pairs(key: str, s1: str = "s1") -> str:
    return f"SELECT a.entity_id AS s1_id, t.entity_id AS target_id, t.source AS target_source FROM {s1} a JOIN t ON {_ON[key]}"


def _labeled(key: str, s1: str = "s1") -> str:
    return f"SELECT p.*, g.target_id IS NOT NULL AS is_tp FROM ({_pairs(key, s1)}) p LEFT JOIN gt g USING (s1_id, target_id)"


def _per(key: str, val: bool = False) -> str:
    s1, entities = ("s1v", "(SELECT * FROM gs WHERE source1_entity_id IN (SELECT source1_entity_id FROM val))") if val else ("s1", "gs")
    return f"""SELECT source1_entity_id, country, match_count AS gt_count, match_count = 0 AS is_singleton, coalesce(pred, 0) AS pred_count, coalesce(tp, 0) AS tp_count,
      coalesce(s2p, 0) AS s2_pred_count, coalesce(s3p, 0) AS s3_pred_count, coalesce(s2t, 0) AS s2_tp_count, coalesce(s3t, 0) AS s3_tp_count,
      coalesce(pred, 0) - coalesce(tp, 0) AS fp_count, match_count - coalesce(tp, 0) AS fn_count,
      round(CASE WHEN match_count = 0 THEN CASE WHEN coalesce(pred, 0) = 0 THEN 1.0::DOUBLE ELSE 0.0 END WHEN coalesce(tp, 0) = 0 THEN 0.0
        ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * match_count + pred) END, 6) AS f05
      FROM {entities} e LEFT JOIN (SELECT s1_id, count(*) AS pred, count(*) FILTER (is_tp) AS tp, count(*) FILTER (target_source = 'S2') AS s2p, count(*) FILTER (target_source = 'S3') AS s3p,
        count(*) FILTER (is_tp AND target_source = 'S2') AS s2t, count(*) FILTER (is_tp AND target_source = 'S3') AS s3t FROM ({_labeled(key, s1)}) GROUP BY s1_id) c ON e.source1_entity_id = c.s1_id"""


def _div(a: str, b: str) -> str:
    return f"coalesce({a}::DOUBLE / nullif({b}, 0), 0)"


def _panel_row(key: str, val: bool) -> str:
    # f05 from the counts again: the rounded one must not enter a mean
    f05 = "CASE WHEN gt_count = 0 THEN CASE WHEN pred_count = 0 THEN 1.0::DOUBLE ELSE 0.0 END WHEN tp_count = 0 THEN 0.0 ELSE 1.25::DOUBLE * tp_count / (0.25::DOUBLE * gt_count + pred_count) END"
    part = lambda m, w: ", ".join([f"round(coalesce(avg(f) FILTER ({w}), 0), 6) AS {m}_f05", f"round({_div(f'sum(tp_count) FILTER ({w})', f'sum(pred_count) FILTER ({w})')}, 6) AS {m}_prec", f"round({_div(f'sum(tp_count) FILTER ({w})', f'sum(gt_count) FILTER ({w})')}, 6) AS {m}_rec"])
    prec, rec = _div("sum(tp_count)", "sum(pred_count)"), _div("sum(tp_count)", "sum(gt_count)")
    return f"""SELECT '{"val" if val else "full"}' AS split, '{key}' AS key, round(avg(f), 6) AS macro_f05, round({prec}, 6) AS pair_prec, round({rec}, 6) AS pair_rec,
      round(coalesce(1.25::DOUBLE * {prec} * {rec} / nullif(0.25::DOUBLE * {prec} + {rec}, 0), 0), 6) AS pair_f05, round({rec}, 6) AS cand_rec,
      round(1.0::DOUBLE - sum(pred_count) / (count(*)::DOUBLE * (SELECT count(*) FROM t)), 6) AS reduction_ratio,
      count(*) AS total_s1, sum(pred_count)::BIGINT AS total_cand, sum(tp_count)::BIGINT AS total_tp, sum(fp_count)::BIGINT AS total_fp, sum(fn_count)::BIGINT AS total_fn,
      round(avg(pred_count), 6) AS avg_cand, round(median(pred_count), 6) AS median_cand, round(quantile_cont(pred_count, 0.95), 6) AS p95_cand, max(pred_count) AS max_cand,
      count(*) FILTER (pred_count = 0) AS unresolved_s1, round(100.0::DOUBLE * count(*) FILTER (pred_count = 0) / count(*), 6) AS unresolved_pct,
      count(*) FILTER (is_singleton AND pred_count = 0) AS correct_sing, count(*) FILTER (is_singleton AND pred_count > 0) AS fp_sing,
      round(100 * {_div("count(*) FILTER (is_singleton AND pred_count > 0)", "count(*) FILTER (is_singleton)")}, 6) AS sing_fpr, round(coalesce(avg(f) FILTER (gt_count = 0), 0), 6) AS m0_f05,
      {part("m1", "gt_count = 1")}, {part("mm", "gt_count > 1")},
      round({_div("sum(s2_tp_count)", "sum(s2_pred_count)")}, 6) AS s2_prec, round({_div("sum(s3_tp_count)", "sum(s3_pred_count)")}, 6) AS s3_prec
      FROM (SELECT *, {f05} AS f FROM ({_per(key, val)}))"""


def _breakdown(by: str, name: str) -> str:
    f05 = "CASE WHEN gt_count = 0 THEN CASE WHEN pred_count = 0 THEN 1.0::DOUBLE ELSE 0.0 END WHEN tp_count = 0 THEN 0.0 ELSE 1.25::DOUBLE * tp_count / (0.25::DOUBLE * gt_count + pred_count) END"
    return f"""SELECT {by} AS {name}, count(*) AS entities, round(avg({f05}), 6) AS f05, round({_div("sum(tp_count)", "sum(pred_count)")}, 6) AS prec, round({_div("sum(tp_count)", "sum(gt_count)")}, 6) AS rec
      FROM ({_per("country_norm_name")}) GROUP BY 1"""


def _sampled(field: str, key: str) -> str:
    chosen = f"substr(md5('42:' || s1_id), 1, 8) < '{int(0.1 * 16**8):08x}'"
    f = f"round(coalesce(1.25::DOUBLE * {_div('p', 'c')} * {_div('p', 'n')} / nullif(0.25::DOUBLE * {_div('p', 'c')} + {_div('p', 'n')}, 0), 0), 6)"
    return f"""SELECT '{"_".join(_BLOCKED[key.removeprefix("country_")])}' AS signal, c * 10 AS candidate_count, p * 10 AS tp, (c - p) * 10 AS fp, (n - p) * 10 AS fn, round({_div("p", "c")}, 6) AS precision,
      round({_div("p", "n")}, 6) AS recall, {f} AS f05 FROM (SELECT (SELECT count(*) FROM gt WHERE {chosen}) AS n, count(*) AS c, count(*) FILTER (is_tp) AS p FROM ({_labeled(key)}) q
      WHERE {chosen} AND (SELECT {field} FROM s1 WHERE entity_id = q.s1_id) NOT IN (SELECT {field} FROM t WHERE {field} <> '' GROUP BY 1 HAVING count(*) > 100000))"""


_HYDRATED = """SELECT s1_id, target_id, a.business_name AS an, b.business_name AS bn, a.business_address AS aa, b.business_address AS ba, a.country AS ac, b.country AS bc
  FROM gt JOIN rec a ON a.entity_id = s1_id JOIN rec b ON b.entity_id = target_id"""
_NAMES = "(SELECT business_name AS name FROM (SELECT business_name, count(*) AS c FROM rec WHERE source = 'S1' GROUP BY 1 ORDER BY c DESC, 1 LIMIT 5) UNION ALL SELECT 'No Such Name LLC')"


def _grams(table: str, low: int, high: int) -> str:
    lists = " || ".join(f"list_transform(range(1, greatest(length(x) - {k - 2}, 1)), lambda i: substr(x, i, {k}))" for k in range(low, high + 1))
    return rf"""SELECT entity_id, country, gram, count(*) AS tf FROM (SELECT entity_id, country, unnest({lists}) AS gram
      FROM (SELECT entity_id, country, regexp_replace(norm_name, '\s\s+', ' ', 'g') AS x FROM {table})) GROUP BY ALL"""


def _vocabulary(counts: str) -> str:
    return f"""SELECT country, gram, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM (SELECT country, gram, count(*) AS df FROM {counts} GROUP BY ALL)
      JOIN (SELECT country, count(*) AS n FROM t GROUP BY 1) USING (country) WHERE df >= 2 AND df <= 0.05::DOUBLE * n"""


def _weights(counts: str) -> str:
    return f"SELECT entity_id, country, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS weight FROM (SELECT entity_id, country, gram, tf * idf AS w FROM {counts} JOIN voc USING (country, gram))"


def _ranked_ctes(low: int, high: int, k: int, name: str = "ranked") -> str:
    x = f"_{low}_{high}"
    return f""", tc{x} AS ({_grams("t", low, high)}), qc{x} AS ({_grams("s1v", low, high)}), voc{x} AS ({_vocabulary(f"tc{x}")}),
      tw{x} AS ({_weights(f"tc{x}").replace("JOIN voc", f"JOIN voc{x}")}), qw{x} AS ({_weights(f"qc{x}").replace("JOIN voc", f"JOIN voc{x}")}),
      {name} AS (SELECT *, (row_number() OVER (PARTITION BY source1_entity_id ORDER BY score DESC, target_entity_id))::INT AS rank FROM (
        SELECT q.entity_id AS source1_entity_id, w.entity_id AS target_entity_id, split_part(w.entity_id, '-', 1) AS target_source, q.country, '{low}_{high}' AS ngram_config, round(sum(q.weight * w.weight), 6) AS score
        FROM qw{x} q JOIN tw{x} w ON q.country = w.country AND q.gram = w.gram GROUP BY ALL) QUALIFY rank <= {k})"""


_PER_QUERY = """, ks AS (SELECT unnest([5, 10, 20, 50]) AS k),
  pq AS (SELECT e.entity_id, e.country, k, (SELECT 0) AS z FROM s1v e, ks),
  found AS (SELECT r.source1_entity_id AS entity_id, k, count(*) AS cands, count(g.s1_id) AS tp FROM ranked r JOIN ks ON r.rank <= k
         LEFT JOIN gt g ON g.s1_id = r.source1_entity_id AND g.target_id = r.target_entity_id GROUP BY ALL),
  per AS (SELECT pq.entity_id, pq.country, pq.k, coalesce(cands, 0) AS cands, coalesce(tp, 0) AS tp, gs.match_count AS gt
          FROM pq LEFT JOIN found USING (entity_id, k) JOIN gs ON gs.source1_entity_id = pq.entity_id),
  grouped AS (SELECT 'OVERALL' AS grouping, * FROM per UNION ALL SELECT country, * FROM per),
  panel AS (SELECT '3_5' AS ngram_config, grouping, k, round(coalesce(sum(tp)::DOUBLE / nullif(sum(gt), 0), 0), 6) AS pair_recall,
    round(coalesce(count(*) FILTER (gt > 0 AND tp >= gt)::DOUBLE / nullif(count(*) FILTER (gt > 0), 0), 0), 6) AS s1_complete_recovery,
    round(coalesce(sum(tp)::DOUBLE / nullif(sum(cands), 0), 0), 6) AS precision, sum(cands)::BIGINT AS total_candidates, round(avg(cands), 6) AS avg_candidates_per_s1,
    round(median(cands), 6) AS median_candidates, round(quantile_cont(cands, 0.95), 6) AS p95_candidates, round(quantile_cont(cands, 0.99), 6) AS p99_candidates,
    max(cands) AS max_candidates, count(*) FILTER (cands = 0) AS zero_candidate_s1s FROM grouped GROUP BY ALL)"""


def _lengths(where: str) -> str:
    return f"""SELECT source, field, round(avg(length(v)), 6) AS mean_len, round(median(length(v)), 6) AS median_len, min(length(v))::INT AS min_len, max(length(v))::INT AS max_len,
      round(quantile_cont(length(v), 0.95), 6) AS p95_len FROM (SELECT source, 'name' AS field, business_name AS v FROM rec UNION ALL SELECT source, 'address', business_address FROM rec) {where} GROUP BY ALL"""


def _variation(a: str, b: str) -> str:
    cut = lambda c: f"replace(substr({c}, 1, 100), '|', '/')"
    return f"SELECT s1_id AS source1_entity_id, target_id AS target_entity_id, {cut(a)} AS s1_value, {cut(b)} AS match_value FROM ({_HYDRATED}) WHERE {a} <> {b} ORDER BY 1, 2 LIMIT 20"


_SAME = "count(*) FILTER ({0})"
_HINDI = "SELECT entity_id, source, country, CASE WHEN source <> 'S1' AND crc % 3 = 0 THEN business_name || ' प्राइवेट लिमिटेड' ELSE business_name END AS business_name FROM (SELECT *, {0} AS crc FROM rec)"
# crc32 bit by bit over the hexadecimal bytes; 3988292384 is its polynomial
_CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode(entity_id)), '..'), lambda h: ('0x' || h)::BIGINT), lambda x, y:
  list_reduce(range(8), lambda z, j: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END, xor(x, y)), 4294967295), 4294967295)"""
_SCRIPT = rf"""SELECT s1_id, target_id, a.business_name AS an, b.business_name AS bn, a.country AS ac FROM gt JOIN ({_HINDI.format(_CRC)}) a ON a.entity_id = s1_id
  JOIN ({_HINDI.format(_CRC)}) b ON b.entity_id = target_id WHERE regexp_matches(a.business_name, '[\x{{0900}}-\x{{097F}}]') <> regexp_matches(b.business_name, '[\x{{0900}}-\x{{097F}}]')"""
_HARD = """SELECT a.entity_id AS s1_id, b.entity_id AS s2_id, a.business_name AS s1_name, b.business_name AS s2_name, a.business_address AS s1_addr, b.business_address AS s2_addr
  FROM rec a JOIN rec b ON trim(lower(a.business_name)) = trim(lower(b.business_name)) AND a.country = b.country AND a.source = 'S1' AND b.source = 'S2'
  WHERE length(trim(lower(a.business_name))) > 8 AND (a.entity_id, b.entity_id) NOT IN (SELECT s1_id, target_id FROM gt) ORDER BY 1, 2 LIMIT 20"""
#: Without the normalized columns.
_PLAIN = {
    "norm_basic": f"SELECT entity_id, {norm('business_name')} AS name, {norm('business_address')} AS address FROM rec",
    "norm_audit": f"SELECT entity_id, coalesce({audit_norm('business_name')}, '') AS name, coalesce({audit_norm('business_address')}, '') AS address FROM rec",
    "norm_light": "SELECT entity_id, trim(lower(business_name)) AS name, trim(lower(business_address)) AS address FROM rec",
    "gt_pairs_explode": "SELECT s1_id AS source1_entity_id, target_id AS target_entity_id, target_source FROM gt",
    "gt_s1_summary": "SELECT *, match_count = 0 AS is_singleton FROM gs",
    "split_stratified": "SELECT source1_entity_id, stratum, is_val FROM sp",
    "gt_counts": "SELECT sum(match_count)::BIGINT AS full_pairs, (sum(match_count) FILTER (is_val))::BIGINT AS val_pairs, count(*) AS full_s1, count(*) FILTER (is_val) AS val_s1 FROM sp",
    "top_names": "SELECT business_name, count(*) AS cnt FROM rec WHERE source <> 'S1' GROUP BY 1 ORDER BY cnt DESC, 1 LIMIT 25",
    "name_source_counts": f"SELECT name, s1, s2, s3, s2 + s3 AS s2_s3, s1 * (s2 + s3) AS potential_pairs FROM (SELECT name, count(*) FILTER (source = 'S1') AS s1, count(*) FILTER (source = 'S2') AS s2, count(*) FILTER (source = 'S3') AS s3 FROM {_NAMES} LEFT JOIN rec ON lower(business_name) = lower(name) GROUP BY 1)",
    "hard_negatives": """SELECT a.entity_id AS s1_id, b.entity_id AS s2_id, a.business_name AS s1_name, b.business_name AS s2_name, a.business_address AS s1_addr, b.business_address AS s2_addr
      FROM rec a JOIN rec b ON trim(lower(a.business_name)) = trim(lower(b.business_name)) AND a.country = b.country AND a.source = 'S1' AND b.source = 'S2'
      WHERE length(trim(lower(a.business_name))) > 8 AND (a.entity_id, b.entity_id) NOT IN (SELECT s1_id, target_id FROM gt) ORDER BY 1, 2 LIMIT 20""",
    "source_stats": "SELECT source, count(*) AS total_rows, count(DISTINCT entity_id) AS unique_ids, count(DISTINCT business_name) AS unique_names, count(*) FILTER (business_name = '') AS empty_names, count(*) FILTER (business_address = '') AS empty_addresses, count(*) FILTER (country = '') AS empty_countries, count(*) - count(DISTINCT entity_id) AS duplicate_ids FROM rec GROUP BY 1",
    "country_dist": "SELECT source, country, count(*) AS n FROM rec GROUP BY ALL",
    "length_stats": _lengths("WHERE v <> ''"),
    "length_stats_all": _lengths(""),
    "match_count_dist": "SELECT match_count, count(*) AS n FROM gs GROUP BY 1",
    "match_classes": "SELECT " + ", ".join(f"count(*) FILTER (match_count = {k}) AS matches_{k}" for k in range(4)) + ", count(*) FILTER (match_count >= 4) AS matches_4_plus, round(avg(match_count), 6) AS mean_matches, round(median(match_count), 6) AS median_matches, max(match_count) AS max_matches, sum(match_count)::BIGINT AS total_matches FROM gs",
    "s2_s3_overlap": "SELECT coalesce(sum(a), 0)::BIGINT AS s2_total, coalesce(sum(b), 0)::BIGINT AS s3_total, count(*) FILTER (a > 0 AND b > 0) AS both, count(*) FILTER (a > 0 AND b = 0) AS only_s2, count(*) FILTER (a = 0 AND b > 0) AS only_s3, count(*) FILTER (a > 1) AS multi_s2, count(*) FILTER (b > 1) AS multi_s3 FROM (SELECT s1_id, count(*) FILTER (target_source = 'S2') AS a, count(*) FILTER (target_source = 'S3') AS b FROM gt GROUP BY 1)",
    "multi_assigned": "SELECT target_id AS target_entity_id, count(DISTINCT s1_id) AS owners FROM gt GROUP BY 1 HAVING owners > 1",
    "exact_rates": f"""SELECT *, {", ".join(f"round({_div(k, 'total_pairs')}, 6) AS {k}_rate" for k in ("raw_name", "raw_address", "norm_name", "norm_address"))} FROM (
      SELECT count(*) AS total_pairs, {_SAME.format("an = bn")} AS raw_name, {_SAME.format("aa = ba")} AS raw_address,
      {_SAME.format(f"{audit_norm('an')} = {audit_norm('bn')} AND {audit_norm('an')} <> ''")} AS norm_name, {_SAME.format(f"{audit_norm('aa')} = {audit_norm('ba')} AND {audit_norm('aa')} <> ''")} AS norm_address,
      {_SAME.format("ac = bc")} AS country_match, {_SAME.format("ac <> bc")} AS country_mismatch FROM ({_HYDRATED}))""",
    "script_mismatch": rf"SELECT count(*) AS n FROM ({_HYDRATED}) WHERE regexp_matches(an, '[\x{{0900}}-\x{{097F}}]') <> regexp_matches(bn, '[\x{{0900}}-\x{{097F}}]')",
    "missing_asymmetry": f"SELECT {_SAME.format(chr(97) + 'n = ' + chr(39) * 2 + ' AND bn <> ' + chr(39) * 2)} AS missing_name_s1, count(*) FILTER (bn = '' AND an <> '') AS missing_name_match, count(*) FILTER (aa = '' AND ba <> '') AS missing_addr_s1, count(*) FILTER (ba = '' AND aa <> '') AS missing_addr_match FROM ({_HYDRATED})",
    "name_variations": _variation("an", "bn"),
    "address_variations": _variation("aa", "ba"),
    "pair_space": "SELECT sum(a)::BIGINT AS s1_rows, sum(b)::BIGINT AS target_rows, sum(a * b)::BIGINT AS blocked_pairs, (sum(a) * sum(b))::BIGINT AS all_pairs FROM (SELECT country, count(*) FILTER (source = 'S1') AS a, count(*) FILTER (source <> 'S1') AS b FROM rec GROUP BY 1)",
    "hash_sample": f"SELECT entity_id FROM rec WHERE substr(md5('42:' || entity_id), 1, 8) < '{int(0.1 * 16**8):08x}'",
    "tsv_roundtrip": "SELECT entity_id, business_name, business_address, country FROM rec",
    "tsv_columns": "SELECT entity_id, country FROM rec",
    "tsv_sql": "SELECT country, count(*) AS n, count(*) FILTER (business_address = '') AS no_address FROM rec GROUP BY 1",
    "file_listing": "SELECT DISTINCT source, true AS filled FROM rec",
    "json_report": _HARD,
    "markdown_report": "SELECT '| source | country | n |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT '| ' || source || ' | ' || country || '/ | ' || count(*) || ' |' FROM rec GROUP BY source, country",
    "duration_format": """SELECT s::INT AS seconds, CASE WHEN s < 60 THEN s || '.0s' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS shown
      FROM range(0, 9000, 59) AS t(s)""",
    "script_examples": f"SELECT s1_id AS source1_entity_id, target_id AS target_entity_id, replace(substr(an, 1, 100), '|', '/') AS s1_value, replace(substr(bn, 1, 100), '|', '/') AS match_value FROM ({_SCRIPT}) ORDER BY 1, 2 LIMIT 10",
    "script_counts": f"SELECT ac AS s1_country, count(*) AS n FROM ({_SCRIPT}) GROUP BY 1",
    # DuckDB's strip_accents takes Indic marks away too, so the legal form is added to the normalized name
    "norm_legal_hindi": rf"""SELECT entity_id, CASE WHEN hindi THEN trim(x || ' प्राइवेट लिमिटेड') ELSE x END AS norm_name,
      CASE WHEN hindi THEN coalesce(nullif(x, ''), 'प्राइवेट लिमिटेड') ELSE coalesce(nullif(trim(regexp_replace(x, '(?i)\b({LEGAL_FORMS})\b$', '')), ''), x) END AS norm_name_legal
      FROM (SELECT entity_id, source <> 'S1' AND {_CRC} % 3 = 0 AS hindi, {norm("business_name")} AS x FROM rec)""",
}
#: With them.
_RICH = {
    "norm_legal": "SELECT entity_id, norm_name, norm_name_legal FROM nrm",
    "targets_union": "SELECT entity_id, source, country, norm_name, norm_addr FROM t",
    **{f"signal_{k}": _pairs(k) for k in _ON},
    **{f"labeled_{k}": _labeled(k) for k in ("norm_name", "country_legal_norm_name")},
    **{f"per_s1_{k}": _per(k) for k in ("norm_name", "country_norm_name", "country_legal_norm_name")},
    "per_s1_from_pairs": _per("country_norm_name"),
    "csv_report": "SELECT split, key, total_cand, avg_cand, median_cand, p95_cand, max_cand, unresolved_s1, reduction_ratio FROM (" + " UNION ALL ".join(_panel_row(k, False) for k in _ON) + ")",
    "metrics_panel": " UNION ALL ".join(_panel_row(k, False) for k in _ON),
    "metrics_panel_val": " UNION ALL ".join(_panel_row(k, True) for k in _ON),
    "by_match_class": _breakdown("CASE gt_count WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2+' END", "match_class"),
    "by_country": _breakdown("country", "country"),
    "by_target_source": f"""SELECT target_source, coalesce(p, 0) AS pred, coalesce(q, 0) AS tp, coalesce(g, 0) AS gt, round({_div("coalesce(q, 0)", "p")}, 6) AS prec, round({_div("coalesce(q, 0)", "g")}, 6) AS rec
      FROM (SELECT target_source, count(*) AS g FROM gt GROUP BY 1) FULL JOIN (SELECT target_source, count(*) AS p, count(*) FILTER (is_tp) AS q FROM ({_labeled("country_norm_name")}) GROUP BY 1) USING (target_source)""",
    "singleton_panel": f"SELECT count(*) FILTER (is_singleton) AS singletons, count(*) FILTER (is_singleton AND pred_count = 0) AS correct, count(*) FILTER (is_singleton AND pred_count > 0) AS wrong FROM ({_per('country_norm_name')})",
    "union_recall": f"""SELECT count(*) AS total_candidates, count(g.s1_id) AS tp, count(*) - count(g.s1_id) AS fp FROM (SELECT s1_id, target_id FROM ({_pairs("country_norm_name", "s1v")}) UNION SELECT s1_id, target_id FROM ({_pairs("country_norm_addr", "s1v")})) u
      LEFT JOIN gt g ON u.s1_id = g.s1_id AND u.target_id = g.target_id""",
    "addr_incompat": """SELECT count(*) AS total_pairs, count(*) FILTER (tp) AS total_tp, count(*) FILTER (NOT tp) AS total_fp, count(*) FILTER (NOT tp AND x <> '' AND y <> '') AS fp_both_addrs,
      count(*) FILTER (NOT tp AND x <> '' AND y <> '' AND x <> y) AS fp_different_addrs, count(*) FILTER (NOT tp AND y = '') AS fp_missing_target_addr
      FROM (SELECT a.norm_addr AS x, t.norm_addr AS y, g.s1_id IS NOT NULL AS tp FROM s1v a JOIN t ON a.country = t.country AND a.norm_name = t.norm_name LEFT JOIN gt g ON g.s1_id = a.entity_id AND g.target_id = t.entity_id)""",
    "name_literals": f"""SELECT name, count(p.s1_id) AS pairs, count(*) FILTER (is_tp) AS tp, count(*) FILTER (NOT is_tp) AS fp, count(DISTINCT p.s1_id) AS unique_s1, count(DISTINCT p.target_id) AS unique_targets FROM {_NAMES} LEFT JOIN (
      SELECT lower(a.business_name) AS low, a.entity_id AS s1_id, t.entity_id AS target_id, g.s1_id IS NOT NULL AS is_tp FROM s1 a JOIN t ON lower(a.business_name) = lower(t.business_name) AND a.country = t.country
      LEFT JOIN gt g ON g.s1_id = a.entity_id AND g.target_id = t.entity_id) p ON p.low = lower(name) GROUP BY 1""",
    "heavy_hitter_filtered_join": f"SELECT * FROM ({_pairs('country_norm_name')}) p WHERE (SELECT norm_name FROM s1 WHERE entity_id = p.s1_id) NOT IN (SELECT norm_name FROM t WHERE norm_name <> '' GROUP BY 1 HAVING count(*) > 100000)",
    "sampled_signals": " UNION ALL ".join(_sampled(*x) for x in (
        ("business_name", "country_raw_name"), ("norm_name", "country_norm_name"), ("business_address", "country_raw_addr"), ("norm_addr", "country_norm_addr"), ("norm_name", "country_norm_name_and_addr"))),
    "sql_views": f"""SELECT count(*) AS total_candidates, count(g.s1_id) AS tp, (SELECT sum(match_count)::BIGINT FROM sp WHERE is_val) AS wanted FROM (SELECT s1_id, target_id FROM ({_pairs("country_norm_name", "s1v")}) UNION SELECT s1_id, target_id FROM ({_pairs("country_norm_addr", "s1v")})) u
      LEFT JOIN gt g ON u.s1_id = g.s1_id AND u.target_id = g.target_id""",
    "char_ngrams": _grams("s1", 3, 5),
}
#: After further tables.
_STEPS = {
    "ngram_df": (f", tc AS ({_grams('t', 3, 5)})", f"SELECT country, gram, df, round(idf, 6) AS idf FROM ({_vocabulary('tc')})"),
    "tfidf_weights": (f", tc AS ({_grams('t', 3, 5)}), voc AS ({_vocabulary('tc')})", f"SELECT entity_id, country, gram, round(weight, 6) AS weight FROM ({_weights('tc')})"),
    "topk_3_5": (_ranked_ctes(3, 5, 50), "SELECT * FROM ranked"),
    "topk_3_6": (_ranked_ctes(3, 6, 50), "SELECT * FROM ranked"),
    "recall_at_k": (_ranked_ctes(3, 5, 50) + _PER_QUERY, "SELECT k, pair_recall FROM panel WHERE grouping = 'OVERALL'"),
    "complete_recovery": (_ranked_ctes(3, 5, 50) + _PER_QUERY, "SELECT grouping, k, s1_complete_recovery FROM panel"),
    "recall_panel": (_ranked_ctes(3, 5, 50) + _PER_QUERY, "SELECT * FROM panel"),
    "recall_panel_v1": (
        _ranked_ctes(3, 5, 50) + _PER_QUERY,
        """SELECT grouping, k, round(coalesce(sum(tp)::DOUBLE / nullif(sum(gt), 0), 0), 6) AS pair_recall,
        round(coalesce(count(*) FILTER (gt > 0 AND tp = gt)::DOUBLE / nullif(count(*) FILTER (gt > 0), 0), 0), 6) AS s1_complete_recovery,
        round(coalesce(sum(tp)::DOUBLE / nullif(sum(cands), 0), 0), 6) AS precision FROM grouped GROUP BY ALL""",
    ),
    "candidate_overlap": (
        _ranked_ctes(3, 5, 20, "r1") + _ranked_ctes(3, 6, 20, "r2"),
        "SELECT (SELECT count(*) FROM r1) AS first, (SELECT count(*) FROM r2) AS second, (SELECT count(*) FROM r1 JOIN r2 USING (source1_entity_id, target_entity_id)) AS shared",
    ),
    "checkpoint_resume": (_ranked_ctes(3, 5, 10), "SELECT * FROM ranked"),
}

SQL: dict[str, str] = {
    **{k: f"{_BASE} {q}" for k, q in _PLAIN.items()},
    **{k: f"{_BASE} {_NORMED} {q}" for k, q in _RICH.items()},
    **{k: f"{_BASE} {_NORMED} {ctes} {q}" for k, (ctes, q) in _STEPS.items()},
}
