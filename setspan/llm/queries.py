"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from setspan.llm.chat import rotate
from setspan.llm.common import table
from setspan.llm.decontaminate import contamination_report
from setspan.llm.infill import fill_in_middle, infill_report, restore
from setspan.llm.langid import identify
from setspan.llm.licenses import scan_licenses
from setspan.llm.lines import line_report
from setspan.llm.mixing import mix, mix_report
from setspan.llm.pii import pseudonymize
from setspan.llm.quality import line_quality
from setspan.llm.packing import pack
from setspan.llm.runs import collapse_runs, run_report, with_planted_runs
from setspan.llm.simhash import duplicate_report
from setspan.llm.toxicity import score


def op1_simhash(spark, sf_dir):
    return duplicate_report(table(spark, sf_dir, "documents"))


def op2_licenses(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op4_quality(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark, sf_dir):
    return pseudonymize(table(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op10_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return run_report(collapse_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_fill_in_middle(spark, sf_dir):
    return infill_report(restore(fill_in_middle(table(spark, sf_dir, "documents"))))


def op13_mixing(spark, sf_dir):
    return mix_report(mix(table(spark, sf_dir, "documents")))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")},
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), items AS (
  SELECT item_id,
         list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")},
                     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, g, len(g) AS n FROM (
    SELECT item_id, w[i:i + 12] AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
          FROM items WHERE len(w) > 0))
), sizes AS (SELECT DISTINCT n FROM grams),
places AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n
), hits AS (
  SELECT r, i, places.n, item FROM places JOIN grams ON grams.n = places.n AND g = w[i:i + places.n - 1]
), hit_words AS (
  SELECT r, count(DISTINCT j) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r
), hit_items AS (
  SELECT r, count(DISTINCT item) AS n_items,
         array_to_string(list_sort(list(DISTINCT item)), ',') AS items
  FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), repeated AS (
  SELECT r, count(DISTINCT j) AS n FROM (
    SELECT r, unnest(range(i, i + 8)) AS j FROM (
      SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM (
        SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)))
    WHERE c > 1) GROUP BY r
), per_line AS (
  SELECT r, l, length(l) AS n,
         len(regexp_split_to_array(trim(l, SPACES), '[\x20\x09-\x0D]+')) AS words,
         length(l) - length(regexp_replace(l, '[#*$%&|<>~^=_{}\[\]\\]', '', 'g')) AS marks,
         len(regexp_extract_all(l, '[!?]{2,}')) AS shouts,
         len(regexp_extract_all(l, '[ \t\n\v\f\r][|>»•·/][ \t\n\v\f\r]|[ \t\n\v\f\r]\|$')) AS seps,
         regexp_matches(l, '[.!?…。！？:;][''"”’»)\]]*[ \t\n\v\f\r]*$') AS ended,
         regexp_matches(l, 'BOILERPLATE') AS boiler
  FROM (SELECT r, unnest(lines) AS l FROM docs)
), lost AS (
  SELECT r, sum(n) AS chars, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost,
         count(*) FILTER (WHERE fails) AS n_lost
  FROM (SELECT *, marks * 10 >= n OR (shouts >= 3 AND shouts * 5 >= words)
               OR (words < 6 AND NOT ended) OR (seps >= 3 AND seps * 4 >= words)
               OR (words <= 15 AND boiler) AS fails FROM per_line)
  GROUP BY r
), measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words,
         CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lines_removed,
         CAST(coalesce(lost, 0) AS BIGINT) AS chars_removed, coalesce(chars, 0) AS chars
  FROM docs LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * chars_removed > 50 * chars AS kept,
       n_lines_removed, chars_removed
FROM failed
""".replace("SPACES", _SPACE).replace(
    "BOILERPLATE",
    "(?i)all rights reserved|cookie (policy|settings)|privacy policy|terms of (use|service)"
    "|click here|read more|subscribe (now|to our)|sign (in|up)\\b|log ?in\\b|enable javascript"
    "|skip to (main )?content|share (this|on)|back to top|lorem ipsum|powered by",
)

OP10_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), per_line AS (
  SELECT r, doc_id, i, lines[i] AS l, trim({_LOWER.format('lines[i]')}, {_SPACE}) AS k
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
), shared AS (
  SELECT k, max(doc_id) AS owner FROM per_line WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT r) >= 3
), marked AS (
  SELECT r, per_line.doc_id, i, l, owner IS NOT NULL AND owner <> per_line.doc_id AS gone
  FROM per_line LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

OP9_SQL = """
WITH placed AS (
  SELECT conv_id, role, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), cut AS (
  SELECT *, 0 AS segment,
         regexp_replace(said, '<\\|(im_start|im_end)\\|>', '< |\\1| >', 'g') AS safe
  FROM placed
), views AS (
  SELECT DISTINCT conv_id, segment, role AS perspective FROM cut
  WHERE role IS NOT NULL AND role <> 'system'
), spelled AS (
  SELECT conv_id, segment, perspective, place, safe,
         coalesce(role = perspective, false) AS own,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(coalesce(role, 'unknown'), '[\\s<>|]', '_', 'g') END
           || chr(10) AS head
  FROM views JOIN cut USING (conv_id, segment)
), lengths AS (
  SELECT *, head || safe || '<|im_end|>' || chr(10) AS message,
         coalesce(sum(length(head) + length(safe) + 11) OVER (
           PARTITION BY conv_id, segment, perspective ORDER BY place
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM spelled
)
SELECT conv_id, segment, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
       string_agg(message, '' ORDER BY place) AS text,
       string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(message) - 1 AS BIGINT), ','
                  ORDER BY place) FILTER (WHERE own) AS mask
FROM lengths GROUP BY conv_id, segment, perspective
"""

OP13_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS digest FROM documents
), sized AS (
  SELECT doc_id, source, digest,
         len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size,
         1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(t) - length(translate(t, '#*$%&|<>{{}}[]=_~^\\', '')))
                / greatest(length(t), 1)::DOUBLE) AS quality,
         ('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 13))::BIGINT AS drawn
  FROM docs
), keyed AS (
  SELECT *, -ln((drawn::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / quality AS key FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, 2 * source_size AS lim,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(lim) OVER before, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level,
         lim::DOUBLE / weight::DOUBLE AS ratio
  FROM weighed
  WINDOW before AS (ORDER BY lim::DOUBLE / weight::DOUBLE, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(coalesce(
           (SELECT level FROM levels WHERE level * weight < lim ORDER BY ratio, source NULLS LAST LIMIT 1) * weight,
           lim), lim::DOUBLE) AS target
  FROM weighed
), summed AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 AND target >= source_size
              THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY key, doc_id NULLS FIRST, digest
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed JOIN targets ON keyed.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + least(greatest(floor(target) - epochs * source_size - before, 0), size) AS BIGINT) AS taken
FROM summed
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_chat": op9_chat,
    "op10_line_dedup": op10_line_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_mixing": op13_mixing,
}
ORACLES = {
    "op3_decontaminate": OP3_SQL,
    "op4_quality": OP4_SQL,
    "op9_chat": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op13_mixing": OP13_SQL,
}
