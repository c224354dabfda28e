"""The document operators as named queries, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from polybag.llm import (
    op1_html, op2_url_filters, op3_mixing, op4_fingerprints, op5_substrings, op6_quality,
    op7_sharding, op8_license_scans, op9_decontamination, op10_simhash, op11_divergence,
    op12_token_counts, op13_conversations)
from polybag.llm.common import UPPER, table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_html": _on("pages", op1_html.html_digest),
    "op2_url_filters": _on("pages", op2_url_filters.url_digest),
    "op3_mixing": _on("documents", op3_mixing.mix_digest),
    "op4_fingerprints": _on("documents", op4_fingerprints.fingerprint_digest),
    "op5_substrings": _on("documents", op5_substrings.substring_digest),
    "op6_quality": lambda spark, sf_dir: op6_quality.quality_digest(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op7_sharding": _on("documents", op7_sharding.shard_digest),
    "op8_license_scans": _on("documents", op8_license_scans.license_digest),
    "op9_decontamination": lambda spark, sf_dir: op9_decontamination.leak_digest(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op10_simhash": _on("documents", op10_simhash.simhash_digest),
    "op11_divergence": _on("documents", op11_divergence.divergence_digest),
    "op12_token_counts": _on("documents", op12_token_counts.token_digest),
    "op13_conversations": _on("conversations", op13_conversations.repair_digest),
    "pipeline": corpus_pipeline.run,
}

WORDS = r"'[^\x20\x09-\x0D]+'"
TOKENS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
A_TO_Z = f"'{UPPER}', '{UPPER.lower()}'"


def _quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _url_filters() -> str:
    rules = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in op2_url_filters.RULES)
    return rf"""
WITH rules AS (SELECT rule, verdict, rule[:strpos(rule, '/') - 1] AS own, rule[strpos(rule, '/'):] AS start
               FROM (VALUES {rules}) r(rule, verdict)),
cut AS (SELECT row_number() OVER () AS r, page_id,
               CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
parsed AS (SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
judged AS (SELECT r, page_id, translate(raw, {A_TO_Z}) AS host,
                  regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path FROM parsed)
SELECT page_id, host, path, rule, coalesce(verdict, '{op2_url_filters.DEFAULT}') AS verdict
FROM judged LEFT JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)
QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC NULLS LAST) = 1"""


def _mixing() -> str:
    weights = "[" + ", ".join(f"{w}::DOUBLE" for w in op3_mixing.WEIGHTS) + "]"
    return f"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents),
sources AS (SELECT source, source_size, {weights}[(place % {len(op3_mixing.WEIGHTS)})::INTEGER + 1] AS weight,
                   source_size * {op3_mixing.CAP}::DOUBLE AS ceiling
            FROM (SELECT source, sum(size)::BIGINT AS source_size,
                         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source)),
-- Level after the k sources of the least ceiling per weight are held there.
steps AS (SELECT ceiling / weight AS edge, coalesce(sum(ceiling) OVER before, 0) AS spent,
                 sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free,
                 sum(source_size) OVER () AS total
          FROM sources WINDOW before AS (ORDER BY ceiling / weight, source
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (total - spent) / free AS level FROM steps WHERE (total - spent) / free <= edge ORDER BY edge LIMIT 1),
plan AS (SELECT source, source_size, least(weight * level, ceiling) AS target FROM sources, level),
drawn AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                 ('0x' || md5(concat_ws(':', '{op3_mixing.SEED}', docs.source, doc_id))[:8])::BIGINT / 4294967296.0::DOUBLE AS draw
          FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS taken FROM drawn"""


def _substrings() -> str:
    more = op5_substrings.WINDOW - 1
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w
              FROM documents),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM docs),
windows AS (SELECT r, j, count(*) OVER span AS c, string_agg(x, ' ') OVER span AS k FROM words
            WINDOW span AS (PARTITION BY r ORDER BY j ROWS BETWEEN CURRENT ROW AND {more} FOLLOWING)),
repeated AS (SELECT r, j FROM windows WHERE c = {more + 1} QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, unnest(range(j, j + {more + 1})) AS j FROM repeated),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)"""


def _license_scans() -> str:
    phrases = [(p.split(" "), label) for p, label in op8_license_scans.PHRASES.items()]
    places = ", ".join(
        f"""CASE WHEN contains(spaced, ' {' '.join(p)} ') THEN list_filter(range(0, len(w) - {len(p) - 1}),
          lambda i: w[i + 1:i + {len(p)}] = {_quoted(p)}) ELSE [] END AS at_{k}"""
        for k, (p, _) in enumerate(phrases))
    every = "list_concat(list_concat(at_0, at_1), at_2)"
    base = "list_filter([" + ", ".join(
        f"CASE WHEN len(at_{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases)
    ) + "], lambda x: x IS NOT NULL)"
    notices = ", ".join(f"({k}, '{t.label}', '{t.text}', {_quoted(t.must)})"
                        for k, t in enumerate(op8_license_scans.TEMPLATES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), {TOKENS}) AS w FROM documents),
spaced AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS spaced FROM docs),
placed AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, {places} FROM spaced),
found AS (SELECT r, doc_id, n_words, {every} AS spots, {base} AS base FROM placed),
said AS (SELECT t, label, must, regexp_extract_all(translate(notice, {A_TO_Z}), {TOKENS}) AS said
         FROM (VALUES {notices}) n(t, label, notice, must)),
templates AS (SELECT t, label, must, list_distinct(said) AS words, len(list_distinct(said)) AS size,
                     ceil({op8_license_scans.CONTAINMENT} * len(list_distinct(said)) - 1e-9) AS need,
                     ceil(len(said) / {op8_license_scans.CONTAINMENT} - 1e-9) AS reach FROM said),
-- A window may begin at any word of the template; only texts with its telling words can match.
hits AS (SELECT r, t, j, x FROM (
           SELECT r, t, unnest(w) AS x, generate_subscripts(w, 1) AS j, words
           FROM docs JOIN templates ON list_has_all(w, must)) WHERE list_contains(words, x)),
windows AS (SELECT a.r, a.t, a.j, list(DISTINCT b.x) AS held FROM hits a JOIN templates USING (t)
            JOIN hits b ON a.r = b.r AND a.t = b.t AND b.j >= a.j AND b.j < a.j + reach GROUP BY a.r, a.t, a.j),
matched AS (SELECT r, label, max(len(held) / size) AS containment FROM windows JOIN templates USING (t)
            WHERE len(held) >= need AND list_has_all(held, must) GROUP BY r, label),
labelled AS (SELECT r, list(label) AS more, max(containment) AS containment FROM matched GROUP BY r)
SELECT doc_id, n_words, len(spots)::BIGINT AS n_base, list_min(spots)::BIGINT AS first_word,
       list_max(spots)::BIGINT AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
       coalesce(containment, CASE WHEN len(base) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM found LEFT JOIN labelled USING (r)"""


def _divergence() -> str:
    def p(n, total):
        return f"1 + (({n} + 1)::HUGEINT * {op11_divergence.SCALE}) // ({total} + size)"

    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), {A_TO_Z}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
              FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term
         HAVING count(DISTINCT r) >= {op11_divergence.MIN_DOCS}),
langs AS (SELECT lang, count(*) AS size, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {p('lang_n', 'lang_total')} AS q,
                 {p('coalesce(n, 0)', 'coalesce(total, 0)')} AS p
          FROM groups g JOIN langs USING (lang) JOIN kept k USING (lang)
          LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
          LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= {op11_divergence.TOP}"""


def _conversations() -> str:
    def add(state: str, cost: str, edit: str) -> str:
        return f"lpad(({state}[:9]::BIGINT + {cost})::VARCHAR, 9, '0') || {state}[10:] || '{edit}'"

    def stay(state: str, initial: str) -> str:
        """A row that stays after ``state`` and counts as ``initial``."""
        kept = f"CASE WHEN may AND initial = '{initial}' THEN {add(state, 'more', 'K')} END"
        given = f"CASE WHEN may THEN {add(state, 'more + 1', 'R')} END"
        return kept if initial == "s" else f"{kept}, {given}"

    # A state is its least cost in nine digits and its least audit; null if it cannot be reached.
    insert_user = "least(u, " + ", ".join(add(s, "5", "I") for s in "zsa") + ")"
    return rf"""
WITH RECURSIVE told AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key,
                               coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
-- CRC-32, bit by bit: 4294967295 is all ones, 3988292384 the reversed polynomial.
hit AS (SELECT *, xor(4294967295, list_reduce(
          list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: unicode(x)::BIGINT)),
          lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS fault
        FROM told),
after AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS j,
                  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1:] AS tail FROM after),
steps AS (SELECT *, CASE WHEN tail = '' THEN 'blank'
                         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 'duplicate'
                         WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS wrong, role[1] AS initial,
                 coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY j) || role[1] NOT IN ('su', 'ua', 'au'), false) AS bad
          FROM placed),
moves AS (SELECT *, wrong NOT IN ('blank', 'duplicate') AS may,
                 CASE wrong WHEN 'truncated' THEN 5 ELSE 0 END AS more FROM steps),
-- z: nothing yet, s, u, a: after a row of that initial; inserts follow each row.
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS j, '000000000' AS z, NULL::VARCHAR AS s, '000000005I' AS u, '000000010II' AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, j, z, s, u, least(a, {add('u', '5', 'I')}) FROM (
    SELECT conv_id, j, z, s, {insert_user} AS u, a FROM (
      SELECT m.conv_id, m.j, {add('z', '2', 'D')} AS z, least({add('s', '2', 'D')}, {stay('z', 's')}) AS s,
             least({add('u', '2', 'D')}, {stay('z', 'u')}, {stay('s', 'u')}, {stay('a', 'u')}) AS u,
             least({add('a', '2', 'D')}, {stay('u', 'a')}) AS a
      FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.j = w.j + 1))),
best AS (SELECT conv_id, least(z, a) AS route FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY j DESC) = 1),
edits AS (SELECT conv_id, unnest(string_split(route[10:], '')) AS edit, generate_subscripts(string_split(route[10:], ''), 1) AS pos
          FROM best WHERE length(route) > 9),
matched AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS j,
                   count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS out FROM edits),
given AS (SELECT e.conv_id, pos, out, edit, role, text,
                 max(CASE WHEN out = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
          FROM matched e LEFT JOIN steps p ON p.conv_id IS NOT DISTINCT FROM e.conv_id AND p.j = e.j AND edit <> 'I'
          WHERE edit <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                        || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS t
             FROM given GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                   count(*) FILTER (wrong = 'blank') AS blank, count(*) FILTER (wrong = 'duplicate') AS duplicate,
                   count(*) FILTER (wrong = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal
            FROM steps GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, route[:9]::BIGINT AS cost,
       route[10:] AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM best b LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM b.conv_id"""


ORACLE: dict[str, str] = {
    "op2_url_filters": _url_filters(),
    "op3_mixing": _mixing(),
    "op5_substrings": _substrings(),
    "op8_license_scans": _license_scans(),
    "op11_divergence": _divergence(),
    "op13_conversations": _conversations(),
}
