"""``ORACLE``: the queries of :mod:`polybag.catalog.queries` as DuckDB SQL.

Written the plain way (unpartitioned windows, self-joins, long rows), so that it shares no
idea with the Spark side.
"""

from __future__ import annotations

import math

from polybag.catalog import queries as q
from polybag.catalog import tables as t
from polybag.functions import pixels as px
from polybag.operators import losses, metrics, views

EPS = "1e-8::DOUBLE"
SEED = views.VIEW_SEED


def uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def number(value: float) -> str:
    return f"{value!r}::DOUBLE"


def with_(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


# ---------------------------------------------------------------- labels

ORDER_LABELS = """
order_labels AS (
  SELECT l_orderkey AS sid, string_agg(p_type, ';' ORDER BY p_type) AS label, l_orderkey AS ord
  FROM (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY l_orderkey)"""

USER_LABELS = """
user_labels AS (
  SELECT 'u' || user_id AS sid, string_agg(event_type, ';' ORDER BY event_type) AS label,
         user_id AS ord
  FROM (SELECT user_id, event_type, count(*) AS c,
               sum(count(*)) OVER (PARTITION BY user_id) AS total
        FROM events GROUP BY user_id, event_type)
  WHERE 5 * c > total GROUP BY user_id)"""


def cells(source: str) -> str:
    return f"""
{source}_cells AS (
  SELECT sid, ord, unnest(string_split(label, ';')) AS code,
         unnest(range(len(string_split(label, ';')))) AS pos FROM {source})"""


def vocab(source: str, k: int) -> str:
    return f"""
vocab AS (
  SELECT code, (row_number() OVER (ORDER BY n DESC, first) - 1)::INTEGER AS idx, n
  FROM (SELECT code, count(*) AS n, min(ord * 1000 + pos) AS first
        FROM {source}_cells GROUP BY code)
  QUALIFY row_number() OVER (ORDER BY n DESC, first) <= {k})"""


def entities(source: str, k: int) -> list[str]:
    """kept(sid, code, pos), entities(sid, split), gt(sid, label_idx, gt)."""
    return [cells(source), vocab(source, k), f"""
kept AS (SELECT sid, code, pos FROM {source}_cells
         WHERE code IN (SELECT code FROM vocab))""", f"""
entities AS (
  SELECT sid, CASE WHEN r < floor(n * 0.4::DOUBLE) THEN 'train'
                   WHEN r < floor(n * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT sid, row_number() OVER (ORDER BY md5('286501567:' || sid), sid) - 1 AS r,
               count(*) OVER () AS n
        FROM (SELECT DISTINCT sid FROM kept)))""", """
gt AS (
  SELECT s.sid, s.idx AS label_idx, (k.sid IS NOT NULL)::INTEGER AS gt, s.code
  FROM (SELECT sid, unnest((SELECT list(code ORDER BY idx) FROM vocab)) AS code,
               unnest((SELECT list(idx ORDER BY idx) FROM vocab)) AS idx FROM entities) s
  LEFT JOIN (SELECT DISTINCT sid, code FROM kept) k ON k.sid = s.sid AND k.code = s.code)""",
            ]


def hot(alias: str) -> str:
    return f"string_agg({alias}::VARCHAR, ',' ORDER BY label_idx)"


ORACLE: dict[str, str] = {}
OL = [ORDER_LABELS, cells("order_labels")]

ORACLE["scan_labels"] = with_(
    ORDER_LABELS, select="SELECT sid::VARCHAR AS sid, label, ord FROM order_labels")
ORACLE["scan_label_files"] = with_(ORDER_LABELS, select="""
SELECT sid::VARCHAR AS sid, label, row_number() OVER (ORDER BY ord) - 1 AS ord FROM order_labels""")
ORACLE["explode_labels"] = with_(
    *OL, select="SELECT sid, pos::INTEGER AS pos, code FROM order_labels_cells")
ORACLE["label_frequency"] = with_(
    *OL, select="SELECT code, count(*) AS n FROM order_labels_cells GROUP BY code")
ORACLE["latest_labels"] = """
SELECT user_id AS sid, event_type AS label, event_id AS ord FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
ORACLE["top_labels"] = with_(
    *OL, vocab("order_labels", q.TOP_K), select="SELECT code, idx, n FROM vocab")
ORACLE["filter_top_labels"] = with_(ORDER_LABELS, *entities("order_labels", q.TOP_K), select="""
SELECT sid, string_agg(code, ';' ORDER BY pos) AS codes, count(*)::INTEGER AS n_codes
FROM kept GROUP BY sid""")
ORACLE["vocab_check"] = with_(*OL, vocab("order_labels", 10), select="""
SELECT 10::BIGINT AS requested_k, count(*) AS found_k, (count(*) < 10)::INTEGER AS too_few
FROM vocab""")
ORACLE["multi_hot"] = with_(ORDER_LABELS, *entities("order_labels", q.TOP_K), select="""
SELECT sid, label_idx, gt FROM gt""")
ORACLE["seeded_order"] = """
SELECT doc_id, row_number() OVER (ORDER BY md5('286501567:' || doc_id), doc_id) - 1 AS rank
FROM documents"""
ORACLE["split_assign"] = """
SELECT doc_id, CASE WHEN r < floor(n * 0.4::DOUBLE) THEN 'train'
                    WHEN r < floor(n * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, count(*) OVER () AS n,
             row_number() OVER (ORDER BY md5('286501567:' || doc_id), doc_id) - 1 AS r
      FROM documents)"""
ORACLE["dataset_summary"] = with_(ORDER_LABELS, *entities("order_labels", q.TOP_K), select="""
SELECT split, count(DISTINCT sid) AS n_sids, count(*) AS n_labels,
       (count(DISTINCT sid) // 8)::BIGINT AS n_batches
FROM entities JOIN kept USING (sid) GROUP BY split""")
ORACLE["split_label_counts"] = with_(ORDER_LABELS, *entities("order_labels", q.TOP_K), select="""
SELECT split, code, count(*) AS n FROM entities JOIN kept USING (sid) GROUP BY split, code""")

# ---------------------------------------------------------------- bags

IMAGES = """
images AS (SELECT DISTINCT 'u' || user_id AS sid,
                  'u' || user_id || '/' || event_id || '.jpg' AS path, event_id FROM events)"""


def members(limit: int, source: str = "images") -> str:
    return f"""
sized AS (
  SELECT sid, n, (SELECT max(n // (1::BIGINT << k)) FROM range(0, 40) h(k)
                  WHERE n // (1::BIGINT << k) <= {limit}) AS size
  FROM (SELECT sid, count(*) AS n FROM {source} GROUP BY sid)),
members AS (
  SELECT sid, path, event_id, r // size AS bag_no, sid || '_' || (r // size) AS bag_id,
         r % size AS instance_no
  FROM (SELECT sid, path, event_id,
               row_number() OVER (PARTITION BY sid ORDER BY md5(':' || path), path) - 1 AS r
        FROM {source}) JOIN sized USING (sid)),
bags AS (
  SELECT bag_id, sid, bag_no, count(*)::INTEGER AS nslice,
         string_agg(path, ';' ORDER BY instance_no) AS images
  FROM members GROUP BY bag_id, sid, bag_no)"""


def batched(source: str, size: int, order: str = "bag_id") -> str:
    return f"""
batched AS (
  SELECT *, r // {size} AS batch_id, (r % {size})::INTEGER AS pos
  FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS r, count(*) OVER () AS total
        FROM {source})
  WHERE r < total - total % {size})"""


SHUFFLED = "md5('286501567:' || bag_id), bag_id"
BAGS = [IMAGES, members(20)]

ORACLE["gene_images"] = with_(IMAGES, select="SELECT sid, path FROM images")
ORACLE["gene_image_counts"] = with_(
    IMAGES, select="SELECT sid, count(*) AS n_images FROM images GROUP BY sid")
ORACLE["missing_images"] = """
SELECT 'u' || c_custkey AS sid FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events)"""
ORACLE["bag_size"] = with_(*BAGS, select="""
SELECT sid, n AS n_images, size AS bag_size, (n // size)::BIGINT AS full_bags,
       n % size AS leftover FROM sized""")
ORACLE["make_bags"] = with_(
    *BAGS, select="SELECT sid, path, bag_no, bag_id, instance_no FROM members")
ORACLE["bag_labels"] = with_(*BAGS, USER_LABELS, select="""
SELECT bag_id, sid, bag_no, nslice, label FROM bags JOIN user_labels USING (sid)""")


def mode_bags(mode: str, limit: int, size: int, order: str) -> list[str]:
    return [USER_LABELS, *entities("user_labels", q.TOP_K), IMAGES, f"""
chosen AS (SELECT * FROM images
           WHERE sid IN (SELECT sid FROM entities WHERE split = '{mode}'))""",
            members(limit, "chosen"), batched("bags", size, order), f"""
annotation AS (SELECT sid, {hot('gt')} AS labels FROM gt GROUP BY sid)"""]


ORACLE["bag_samples"] = with_(*mode_bags("test", 20, 4, "bag_id"), select="""
SELECT batch_id, pos, bag_id, nslice, images AS imgs, labels
FROM batched JOIN annotation USING (sid)""")
ORACLE["val_samples"] = with_(*mode_bags("val", 20, 1, "bag_id"), select="""
SELECT batch_id, pos, bag_id, nslice, images AS imgs, labels
FROM batched JOIN annotation USING (sid)""")
ORACLE["train_samples"] = with_(*mode_bags("train", 1, 8, SHUFFLED), select="""
SELECT batch_id, pos, bag_id, images AS path, labels FROM batched JOIN annotation USING (sid)""")
ORACLE["pad_bags"] = with_(*BAGS, batched("bags", 8), select="""
SELECT batch_id, pos, bag_id, nslice, max_slice,
       images || repeat(';', max_slice - nslice) AS padded
FROM (SELECT *, max(nslice) OVER (PARTITION BY batch_id) AS max_slice FROM batched)""")
ORACLE["assign_batches"] = with_(
    *BAGS, batched("bags", 8), batched("bags", 8, SHUFFLED).replace("batched AS", "shuffled AS"),
    select="""
SELECT 'lexical' AS kind, batch_id, pos, bag_id FROM batched
UNION ALL SELECT 'shuffled', batch_id, pos, bag_id FROM shuffled""")
ORACLE["batch_stats"] = with_(*BAGS, batched("bags", 8), select="""
SELECT batch_id, count(*) AS n_bags, sum(nslice)::BIGINT AS n_instances,
       max(nslice) AS max_slice FROM batched GROUP BY batch_id""")
ORACLE["segment_offsets"] = with_(*BAGS, batched("bags", 8), select="""
SELECT batch_id, pos, bag_id, nslice,
       coalesce(sum(nslice) OVER (PARTITION BY batch_id ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
FROM batched""")
BALANCED = ["""
totals AS (SELECT batch_id, sum(nslice)::BIGINT AS total, count(*) AS n_bags
           FROM batched GROUP BY batch_id)""", """
reach AS (
  SELECT batch_id, 0 AS i, 0 AS picked, 0::BIGINT AS v FROM totals
  UNION
  SELECT r.batch_id, r.i + 1, r.picked + take, r.v + take * b.nslice
  FROM reach r JOIN batched b ON b.batch_id = r.batch_id AND b.pos = r.i
  JOIN totals s ON s.batch_id = r.batch_id
  JOIN (SELECT unnest([0, 1]) AS take) ON r.picked + take <= s.n_bags // 2
       AND r.v + take * b.nslice <= s.total // 2)""", """
best AS (
  SELECT batch_id, any_value(n_bags)::INTEGER AS n, max(v) AS v
  FROM reach JOIN totals USING (batch_id)
  WHERE i = n_bags AND picked = n_bags // 2 GROUP BY batch_id)""", """
back AS (
  SELECT batch_id, n AS i, n // 2 AS wanted, v AS remaining, false AS took FROM best
  UNION ALL
  SELECT k.batch_id, k.i - 1, k.wanted - (r.i IS NOT NULL)::INTEGER,
         k.remaining - CASE WHEN r.i IS NULL THEN 0 ELSE b.nslice END, r.i IS NOT NULL
  FROM back k JOIN batched b ON b.batch_id = k.batch_id AND b.pos = k.i - 1
  LEFT JOIN reach r ON r.batch_id = k.batch_id AND r.i = k.i - 1 AND r.picked = k.wanted - 1
       AND r.v = k.remaining - b.nslice)"""]
BALANCE = "WITH RECURSIVE " + ", ".join([*BAGS, batched("bags", 8), *BALANCED])
BALANCED_ORDER = """
SELECT batch_id, place AS pos, bag_id, nslice, (place >= n // 2)::INTEGER AS half
FROM (SELECT b.batch_id, b.bag_id, b.nslice, n,
             (row_number() OVER (PARTITION BY b.batch_id ORDER BY k.took DESC,
                CASE WHEN k.took THEN -b.pos ELSE b.pos END) - 1)::INTEGER AS place
      FROM back k JOIN batched b ON b.batch_id = k.batch_id AND b.pos = k.i
      JOIN best ON best.batch_id = b.batch_id)"""
ORACLE["balanced_order"] = BALANCE + BALANCED_ORDER
ORACLE["collate_batches"] = "WITH RECURSIVE " + ", ".join([
    *mode_bags("test", 20, 4, "bag_id"), *BALANCED, f"ordered AS ({BALANCED_ORDER})", """
placed AS (
  SELECT o.batch_id, o.bag_id, labels, sum(o.nslice) OVER (PARTITION BY o.batch_id ORDER BY o.pos)
           - o.nslice AS start
  FROM ordered o JOIN batched USING (batch_id, bag_id) JOIN annotation USING (sid))"""]) + f"""
SELECT 'instance' AS part, batch_id, (start + instance_no)::BIGINT AS row_no, bag_id, path, labels
FROM placed JOIN members USING (bag_id)
UNION ALL
SELECT 'instance', batch_id, unnest(range(total, 20 * n_bags)), NULL, NULL,
       '{','.join(['0'] * q.TOP_K)}' FROM totals
UNION ALL SELECT 'bag', batch_id, start::BIGINT, bag_id, NULL, labels FROM placed"""
ORACLE["balance_batches"] = BALANCE + """
SELECT batch_id, max(v) AS half_sum, any_value(total) AS total, any_value(n_bags) AS n_bags
FROM reach JOIN totals USING (batch_id)
WHERE i = n_bags AND picked = n_bags // 2 GROUP BY batch_id"""

# ---------------------------------------------------------------- scores and metrics

EVENT_SCORES = f"""
event_scores AS (
  SELECT event_id, 'u' || user_id AS sid, idx AS label_idx,
         round(0.25::DOUBLE + (event_type = code)::INTEGER * 0.5::DOUBLE
               + {uniform("'score:' || event_id || ':' || code")} * 0.25::DOUBLE, 6) AS score
  FROM (SELECT event_id, user_id, event_type,
               unnest((SELECT list(code ORDER BY idx) FROM vocab)) AS code,
               unnest((SELECT list(idx ORDER BY idx) FROM vocab)) AS idx FROM events))"""

PREDICTED = """
cells AS (
  SELECT *, (score >= least(max(score) OVER (PARTITION BY example), 0.5::DOUBLE))::INTEGER AS pred
  FROM scored)"""

EVENTS = [USER_LABELS, *entities("user_labels", t.EVENT_CLASSES), EVENT_SCORES, """
scored AS (SELECT event_id AS example, label_idx, gt, score
           FROM event_scores JOIN gt USING (sid, label_idx))""", PREDICTED]

BAG_EVALUATION = [USER_LABELS, *entities("user_labels", t.EVENT_CLASSES), EVENT_SCORES, IMAGES, """
chosen AS (SELECT * FROM images WHERE sid IN (SELECT sid FROM entities WHERE split = 'test'))""",
                  members(20, "chosen"), """
scored AS (
  SELECT bag_id AS example, label_idx, any_value(gt) AS gt, round(avg(score), 12) AS score
  FROM members m JOIN event_scores s USING (event_id)
  JOIN gt USING (label_idx) WHERE gt.sid = m.sid
  GROUP BY bag_id, label_idx)""", PREDICTED]


def metric_ctes(by: str = "") -> list[str]:
    """counts, label_metrics, pooled, macro, examples, auc over ``cells``; ``by`` ends in a comma."""
    group = f"GROUP BY {by[:-1]}" if by else ""
    part = f"{by} label_idx"
    return [f"""
counts AS (
  SELECT {by} label_idx, sum(gt * pred)::BIGINT AS tp, sum((1 - gt) * pred)::BIGINT AS fp,
         sum((1 - gt) * (1 - pred))::BIGINT AS tn, sum(gt * (1 - pred))::BIGINT AS fn
  FROM cells GROUP BY {part})""", f"""
label_metrics AS (
  SELECT *, (2 * lab_precision * lab_recall) / (lab_precision + lab_recall + {EPS}) AS lab_f1
  FROM (SELECT {by} label_idx,
               (tp + tn + {EPS}) / (tp + fp + tn + fn + {EPS}) AS label_accuracy,
               (tp + {EPS}) / (tp + fp + {EPS}) AS lab_precision,
               (tp + {EPS}) / (tp + fn + {EPS}) AS lab_recall FROM counts))""", f"""
macro AS (
  SELECT *, 2 * label_precision_macro * label_recall_macro
            / (label_precision_macro + label_recall_macro + {EPS}) AS label_f1_macro
  FROM (SELECT {by} avg(label_accuracy) AS label_accuracy_macro,
               avg(lab_precision) AS label_precision_macro,
               avg(lab_recall) AS label_recall_macro, avg(lab_f1) AS label_f1_average
        FROM label_metrics {group}))""", f"""
micro AS (
  SELECT *, 2 * label_precision_micro * label_recall_micro
            / (label_precision_micro + label_recall_micro + {EPS}) AS label_f1_micro,
         label_recall_micro AS lab_sensitivity
  FROM (SELECT {by} (sum(tp) + sum(tn) + {EPS})
                 / (sum(tp) + sum(fp) + sum(tn) + sum(fn) + {EPS}) AS label_accuracy_micro,
               (sum(tp) + {EPS}) / (sum(tp) + sum(fp) + {EPS}) AS label_precision_micro,
               (sum(tp) + {EPS}) / (sum(tp) + sum(fn) + {EPS}) AS label_recall_micro,
               (sum(tn) + {EPS}) / (sum(tn) + sum(fp) + {EPS}) AS lab_specificity
        FROM counts {group}))""", f"""
zero AS (
  SELECT {by} avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE
                  ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END) AS sk_f1_macro,
         CASE WHEN sum(2 * tp + fp + fn) = 0 THEN 0.0::DOUBLE
              ELSE 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) END AS sk_f1_micro
  FROM counts {group})""", f"""
examples AS (
  SELECT *, 2 * example_precision * example_recall
            / (example_precision + example_recall + {EPS}) AS example_f1
  FROM (SELECT {by} avg((g = hits AND p = hits)::INTEGER::DOUBLE) AS example_subset_accuracy,
               avg((hits + {EPS}) / (g + p - hits + {EPS})) AS example_accuracy,
               avg((hits + {EPS}) / (p + {EPS})) AS example_precision,
               avg((hits + {EPS}) / (g + {EPS})) AS example_recall
        FROM (SELECT {by} example, sum(gt)::DOUBLE AS g, sum(pred)::DOUBLE AS p,
                     sum(gt * pred)::DOUBLE AS hits FROM cells GROUP BY {by} example) {group}))""",
            f"""
label_auc AS (
  SELECT {by} label_idx, sum(pos)::BIGINT AS p, sum(neg)::BIGINT AS n,
         CASE WHEN sum(pos) > 0 AND sum(neg) > 0
              THEN sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE)
         END AS auc
  FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {part} ORDER BY score
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
        FROM (SELECT {by} label_idx, score, sum(gt)::DOUBLE AS pos, sum(1 - gt)::DOUBLE AS neg
              FROM cells GROUP BY {part}, score)) GROUP BY {part})""", f"""
area AS (
  SELECT {by} CASE WHEN count(*) = count(auc) THEN avg(auc) ELSE -1.0::DOUBLE END AS sk_auc_macro
  FROM label_auc {group})""", f"""
pooled_auc AS (
  SELECT {by} sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS sk_auc_micro
  FROM (SELECT *, coalesce(sum(neg) OVER ({f'PARTITION BY {by[:-1]}' if by else ''} ORDER BY score
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
        FROM (SELECT {by} score, sum(gt)::DOUBLE AS pos, sum(1 - gt)::DOUBLE AS neg
              FROM cells GROUP BY {by} score)) {group})"""]


def rounded(columns: list[str], decimals: int = q.DECIMALS) -> str:
    return ", ".join(f"round({c}, {decimals}) AS {c}" for c in columns)


EXAMPLE = ["example_subset_accuracy", "example_accuracy", "example_precision", "example_recall",
           "example_f1"]
MACRO = ["label_accuracy_macro", "label_precision_macro", "label_recall_macro",
         "label_f1_average", "label_f1_macro"]
MICRO = ["label_accuracy_micro", "label_precision_micro", "label_recall_micro",
         "label_f1_micro", "lab_sensitivity", "lab_specificity"]
LABEL = ["label_accuracy", "lab_precision", "lab_recall", "lab_f1"]
EM = [*EVENTS, *metric_ctes()]

ORACLE["bag_scores"] = with_(
    USER_LABELS, *entities("user_labels", t.EVENT_CLASSES), EVENT_SCORES, *BAGS, select="""
SELECT bag_id, count(*)::INTEGER AS nslice, label_idx, round(avg(score), 12) AS score
FROM members JOIN event_scores USING (event_id) GROUP BY bag_id, label_idx""")
ORACLE["confusion_counts"] = with_(*EM, select="SELECT * FROM counts")
ORACLE["example_metrics"] = with_(*EM, select=f"SELECT {rounded(EXAMPLE)} FROM examples")
ORACLE["label_macro_metrics"] = with_(*EM, select=f"SELECT {rounded(MACRO)} FROM macro")
ORACLE["label_micro_metrics"] = with_(*EM, select=f"SELECT {rounded(MICRO)} FROM micro")
ORACLE["per_label_metrics"] = with_(
    *EM, select=f"SELECT label_idx, {rounded(LABEL)} FROM label_metrics")
ORACLE["f1_zero_division"] = with_(
    *EM, select=f"SELECT {rounded(['sk_f1_macro', 'sk_f1_micro'])} FROM zero")
ORACLE["auc_per_label"] = with_(
    *EM, select="SELECT label_idx, p, n, round(auc, 9) AS auc FROM label_auc")
ORACLE["auc_macro"] = with_(*EM, select=f"SELECT {rounded(['sk_auc_macro'])} FROM area")
ORACLE["auc_micro"] = with_(*EM, select=f"SELECT {rounded(['sk_auc_micro'])} FROM pooled_auc")


def melted(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS metric, NULL::INTEGER AS label_idx, round({n}, 9) AS value FROM {source}"
        for n in names)


BRIEF = " UNION ALL ".join([
    melted("examples", EXAMPLE), melted("macro", [m for m in MACRO if m != "label_f1_average"]),
    melted("micro", MICRO[:4])])
FULL = " UNION ALL ".join([
    BRIEF, melted("macro", ["label_f1_average"]), melted("micro", MICRO[4:]),
    melted("zero", ["sk_f1_macro", "sk_f1_micro"]), melted("area", ["sk_auc_macro"]),
    melted("pooled_auc", ["sk_auc_micro"]),
    *[f"SELECT '{n}', label_idx, round({n}, 9) FROM label_metrics" for n in LABEL]])
ORACLE["eval_report"] = with_(*BAG_EVALUATION, *metric_ctes(), select=FULL)
ORACLE["eval_report_brief"] = with_(*BAG_EVALUATION, *metric_ctes(), select=BRIEF)

PADDED = [f"SELECT {i + 1} AS section, '{m}' AS metric, '{m + ':':<27}' AS form"
          for i, m in enumerate(metrics.REPORT_METRICS[:-1])]
TITLES = [("label_accuracy", "label_accuracy_macro: ", "label_accuracy: "),
          ("lab_precision", "label_precious_macro: ", "lab_precision:  "),
          ("lab_recall", "label_recall_macro: ", "lab_recall:     "),
          ("lab_f1", "label_f1_macro: ", "lab_f1:         ")]


def lined(layout: str, forms: list[str], more: list[str]) -> str:
    values = f"""SELECT section, -1 AS row, form || printf('%.4f', value) AS line
    FROM report JOIN ({' UNION ALL '.join(forms)}) USING (metric) WHERE label_idx IS NULL"""
    return f"""SELECT '{layout}' AS layout,
    (row_number() OVER (ORDER BY section, row) - 1)::INTEGER AS line_no, line
    FROM ({' UNION ALL '.join([values, *more])})"""


LISTS = [part for i, (metric, title, word) in enumerate(TITLES) for part in (
    f"SELECT {30 + i}, -1, '{title}'",
    f"SELECT {30 + i}, label_idx, printf('(label:%d,{word}%.4f)', label_idx, value) "
    f"FROM report WHERE metric = '{metric}' AND label_idx IS NOT NULL")]
ORACLE["report_text"] = with_(*BAG_EVALUATION, *metric_ctes(), f"report AS ({FULL})", select=" UNION ALL ".join([
    lined("full", [*PADDED, "SELECT 29, 'label_f1_average', 'label_f1_average: '"],
          [f"SELECT 0, -1, '{'-' * 44}'", "SELECT 28, -1, ''", *LISTS]),
    lined("brief", PADDED[:13], []),
    lined("score", [f"SELECT {i} AS section, '{m}' AS metric, '{n}:' AS form"
                    for i, (n, m) in enumerate(metrics.SCORE_METRICS.items())], [])]))

ORACLE["positive_slices"] = with_(*EVENTS, select="""
SELECT a.label_idx, any_value(n.n) AS n_examples, b.label_idx AS other_idx,
       sum(b.gt)::BIGINT AS n_gt, sum(b.pred)::BIGINT AS n_pred,
       round(avg(b.score), 9) AS mean_score
FROM cells a JOIN cells b USING (example)
JOIN (SELECT label_idx, count(*) AS n FROM cells WHERE gt = 1 GROUP BY label_idx) n
  ON n.label_idx = a.label_idx
WHERE a.gt = 1 GROUP BY a.label_idx, b.label_idx""")
ORACLE["epoch_eval"] = with_(
    *EVENTS[:-1], f"""
cells AS (
  SELECT * FROM (
    SELECT *, example // {t.STEPS_PER_EPOCH} + 1 AS epoch,
           (score >= least(max(score) OVER (PARTITION BY example), 0.5::DOUBLE))::INTEGER AS pred
    FROM scored) WHERE epoch % 2 = 0)""", *metric_ctes("epoch,"), select="""
SELECT epoch, round(sk_f1_macro, 9) AS f1_macro, round(sk_f1_micro, 9) AS f1_micro,
       round(sk_auc_macro, 9) AS auc FROM zero JOIN area USING (epoch)""")

VECTORS = f"""
centroids AS (
  SELECT label AS class, list(m ORDER BY i) AS centroid
  FROM (SELECT label, i, avg(v) AS m
        FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i
              FROM embeddings) GROUP BY label, i) GROUP BY label),
scored AS (
  SELECT vec_id AS example, (row_number() OVER (PARTITION BY vec_id ORDER BY class) - 1)::INTEGER
           AS label_idx,
         (label = class)::INTEGER AS gt,
         round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(60.0::DOUBLE
           * list_inner_product(embedding::DOUBLE[], centroid) - 1.0::DOUBLE))), 6) AS score
  FROM embeddings JOIN centroids ON true)"""
ORACLE["score_samples"] = with_(
    VECTORS, select="SELECT example AS vec_id, label_idx, score FROM scored")
ORACLE["adaptive_threshold"] = with_(
    VECTORS, PREDICTED, select="SELECT example AS vec_id, label_idx, score, pred FROM cells")
ORACLE["vector_auc"] = with_(VECTORS, PREDICTED, *metric_ctes(), select="""
SELECT round((SELECT sk_auc_macro FROM area), 9) AS sk_auc_macro,
       round((SELECT sk_auc_micro FROM pooled_auc), 9) AS sk_auc_micro""")

# ---------------------------------------------------------------- losses

ORACLE["l2_normalize"] = """
SELECT vec_id, i::INTEGER AS pos, round(v / norm, 9) AS value
FROM (SELECT vec_id, unnest(raw) AS v, unnest(range(64)) AS i,
             sqrt(list_inner_product(raw, raw)) AS norm
      FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * (vec_id % 7 + 1)) AS raw
            FROM embeddings))"""

VIEWS = """
vecs AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
samples AS (
  SELECT x.vec_id // 32 AS batch_id, x.vec_id AS sample_id, x.e AS x, y.e AS y, z.e AS z
  FROM vecs x JOIN vecs y ON y.vec_id = (x.vec_id + 1) % (SELECT count(*) FROM vecs)
  JOIN vecs z ON z.vec_id = (x.vec_id + 2) % (SELECT count(*) FROM vecs))"""
SIMILARITIES = """
sims AS (
  SELECT batch_id, a.sample_id, m AS matrix, a.sample_id = b.sample_id AS same,
         exp(list_inner_product(
           CASE m[1] WHEN 'x' THEN a.x WHEN 'y' THEN a.y ELSE a.z END,
           CASE m[2] WHEN 'x' THEN b.x WHEN 'y' THEN b.y ELSE b.z END) / 0.1::DOUBLE) AS s
  FROM samples a JOIN samples b USING (batch_id)
  JOIN (SELECT unnest(['xx', 'yy', 'xy', 'xz', 'yz', 'zx', 'zy']) AS m) ON true),
anchors AS (
  SELECT batch_id, sample_id, matrix, sum(s) FILTER (same) AS own,
         coalesce(sum(s) FILTER (NOT same), 0) AS rest
  FROM sims GROUP BY batch_id, sample_id, matrix),
wide AS (
  SELECT batch_id, sample_id,
         max(own) FILTER (matrix = 'xy') AS xy_own,
         sum(rest) FILTER (matrix IN ('xx', 'yy', 'xy')) AS mutual_rest
  FROM anchors GROUP BY batch_id, sample_id),
terms AS (
  SELECT batch_id, mutual, aux_x, aux_y, aux_z_x, aux_z_y
  FROM (SELECT batch_id, avg(-2 * ln(xy_own / mutual_rest)) AS mutual FROM wide GROUP BY batch_id)
  JOIN (SELECT batch_id,
               avg(-ln(own / rest)) FILTER (matrix = 'xz') AS aux_x,
               avg(-ln(own / rest)) FILTER (matrix = 'yz') AS aux_y,
               avg(-ln(own / rest)) FILTER (matrix = 'zx') AS aux_z_x,
               avg(-ln(own / rest)) FILTER (matrix = 'zy') AS aux_z_y
        FROM anchors GROUP BY batch_id) USING (batch_id))"""
AUX = list(losses.AUX_TERMS)
ORACLE["view_align"] = with_(VIEWS, select="""
SELECT batch_id, sample_id, round(list_inner_product(x, y), 9) AS xy,
       round(list_inner_product(x, z), 9) AS xz, round(list_inner_product(y, z), 9) AS yz
FROM samples""")
ORACLE["pairwise_similarity"] = with_(VIEWS, SIMILARITIES, select="""
SELECT batch_id, sample_id, matrix, round(own, 6) AS own, round(rest, 6) AS rest FROM anchors""")
ORACLE["contrastive_mutual"] = with_(
    VIEWS, SIMILARITIES, select=f"SELECT batch_id, {rounded(['mutual'])} FROM terms")
ORACLE["contrastive_aux"] = with_(
    VIEWS, SIMILARITIES, select=f"SELECT batch_id, {rounded(AUX)} FROM terms")
ORACLE["contrastive_loss"] = with_(VIEWS, SIMILARITIES, select=f"""
SELECT batch_id, {rounded(['mutual', *AUX])},
       round(mutual + {' + '.join(AUX)}, 9) AS loss FROM terms""")
ORACLE["bce_loss"] = with_(*EVENTS, """
bce AS (
  SELECT label_idx, -(gt * ln(x) + (1 - gt) * ln(1 - x)) AS b
  FROM (SELECT label_idx, gt, greatest(least(score, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS x
        FROM cells))""", select="""
SELECT label_idx, round(avg(b), 6) AS mean, round(sum(b), 6) AS sum,
       round(avg(b * (label_idx + 1)), 6) AS weighted_mean FROM bce GROUP BY label_idx""")

# ---------------------------------------------------------------- views

NAMES = "[" + ", ".join(f"'{n}'" for n, _, _ in views.AUGMENTATIONS) + "]"
MAGNITUDES = "[" + ", ".join(
    number(10 / 30.0 * (hi - lo) + lo) for _, lo, hi in views.AUGMENTATIONS) + "]"
SIGNED = ", ".join(f"'{n}'" for n in views.SIGNED)
ORACLE["augmentation_plan"] = f"""
SELECT event_id AS image_id, 'aux' AS view, slot::INTEGER AS slot, {NAMES}[i] AS op,
       round({MAGNITUDES}[i], 6) AS magnitude,
       CASE WHEN {NAMES}[i] IN ({SIGNED}) AND s > 0.5 THEN -1 ELSE 1 END AS sign
FROM (SELECT event_id, slot,
             floor({uniform(f"'{SEED}:' || event_id || ':aux:' || slot || ':op'")} * 18)::INTEGER
               + 1 AS i,
             {uniform(f"'{SEED}:' || event_id || ':aux:' || slot || ':sign'")} AS s
      FROM (SELECT event_id, unnest([0, 1]) AS slot FROM events))"""


def draw(name: str) -> str:
    return uniform(f"'{SEED}:' || image_id || ':' || view || ':{name}'")


def between(name: str, low: float, high: float) -> str:
    return f"({draw(name)} * {number(high - low)} + {number(low)})"


LOG_RATIO = (math.log(3.0 / 4.0), math.log(4.0 / 3.0))
FRAMED = """
framed AS (
  SELECT image_id, view, floor(512 * 256 / 512)::INTEGER AS frame_h,
         floor(width * 256 / 512)::INTEGER AS frame_w
  FROM ({}))"""
VIEW_PLAN = f"""
boxed AS (
  SELECT *, CASE WHEN view = 'eval' THEN frame_w
                 ELSE greatest(least(floor(sqrt(area * ratio) + 0.5)::INTEGER, frame_w), 1) END
              AS box_w,
         CASE WHEN view = 'eval' THEN frame_h
              ELSE greatest(least(floor(sqrt(area / ratio) + 0.5)::INTEGER, frame_h), 1) END
              AS box_h
  FROM (SELECT *, {between('area', 0.2, 1.0)} * frame_h * frame_w AS area,
               exp({between('ratio', *LOG_RATIO)}) AS ratio FROM framed)),
plans AS (
SELECT image_id, view, frame_h, frame_w,
       floor({draw('x')} * (frame_w - box_w + 1))::INTEGER AS box_x,
       floor({draw('y')} * (frame_h - box_h + 1))::INTEGER AS box_y, box_w, box_h,
       {', '.join(f"round(CASE WHEN view LIKE 'basic%' THEN {between(n, 0.6, 1.4)} ELSE 1 END, 6) AS {n}"
                  for n in ('brightness', 'contrast', 'saturation'))},
       round(CASE WHEN view LIKE 'basic%' THEN {between('hue', -0.4, 0.4)} ELSE 0 END, 6) AS hue,
       (view LIKE 'basic%' AND {draw('gray')} < 0.2::DOUBLE)::INTEGER AS gray,
       (view <> 'eval' AND {draw('flip')} < 0.5::DOUBLE)::INTEGER AS flip
FROM boxed)"""
ORACLE["view_plan"] = with_(FRAMED.format("""
SELECT event_id AS image_id, (512 + user_id % 3 * 64)::INTEGER AS width,
       unnest(['basic1', 'basic2', 'aux', 'eval']) AS view FROM events"""), VIEW_PLAN, select="SELECT * FROM plans")

RASTERS = """
rasters AS (
  SELECT vec_id AS image_id,
         list_transform(range(192), lambda i: level[(i // 3 + i % 3 * 21) % 64 + 1]) AS pixels
  FROM (SELECT vec_id, list_transform(embedding, lambda v:
          floor((v::DOUBLE + 1) * 127.5::DOUBLE)::INTEGER) AS level FROM embeddings))"""


ORACLE["scan_images"] = """
SELECT label::VARCHAR AS sid, vec_id || '.bmp' AS name, 246::BIGINT AS length FROM embeddings"""
ORACLE["decode_images"] = with_(RASTERS, select="""
SELECT label::VARCHAR AS sid, vec_id || '.bmp' AS name, 8 AS height, 8 AS width,
       array_to_string(pixels, ',') AS pixels
FROM rasters JOIN embeddings ON vec_id = image_id""")
ORACLE["undecodable_images"] = """
SELECT n_regionkey::VARCHAR AS sid, 1::BIGINT AS n FROM nation GROUP BY n_regionkey"""


def lumas(at: str) -> str:
    r, g, b = px.LUMA
    return (f"((pixels[{at} - {at} % 3 + 1] * {r} + pixels[{at} - {at} % 3 + 2] * {g} "
            f"+ pixels[{at} - {at} % 3 + 3] * {b} + 32768) >> 16)")


def mapped(op: str, body: str, source: str = "rasters") -> str:
    """One kernel as a list expression over i = 0..191."""
    return (f"SELECT image_id, '{op}' AS op, array_to_string(list_transform(range(192), "
            f"lambda i: ({body})::INTEGER), ',') AS pixels FROM {source}")


P = "pixels[i + 1]"
ADDED = f"least(255, floor({P} + {number(110 / 3.0)}))"
CHANNELS = """
stretched AS (
  SELECT *, [list_min(ch[1]), list_min(ch[2]), list_min(ch[3])] AS lo,
         [list_max(ch[1]), list_max(ch[2]), list_max(ch[3])] AS hi
  FROM (SELECT *, [list_transform(range(64), lambda k: pixels[k * 3 + 1]),
                   list_transform(range(64), lambda k: pixels[k * 3 + 2]),
                   list_transform(range(64), lambda k: pixels[k * 3 + 3])] AS ch FROM rasters)),
greyed AS (
  SELECT *, floor(list_sum(list_transform(range(64), lambda k: """ + lumas("(k * 3)") + """))
                  / 64.0::DOUBLE + 0.5) AS grey FROM rasters)"""
SPAN = "(hi[i % 3 + 1] - lo[i % 3 + 1])"
SCALE = f"(255.0::DOUBLE / {SPAN})"
ORACLE["pointwise_kernels"] = with_(RASTERS, CHANNELS, select=" UNION ALL ".join([
    mapped("Invert", f"255 - {P}"),
    mapped("Solarize",
           f"CASE WHEN {P} < {number(256 / 3.0)} THEN {P} ELSE 255 - {P} END"),
    mapped("SolarizeAdd", f"CASE WHEN {ADDED} < 128 THEN {ADDED} ELSE 255 - {ADDED} END"),
    mapped("Posterize", f"{P} & 128"),
    mapped("AutoContrast",
           f"CASE WHEN {SPAN} = 0 THEN {P} ELSE "
           f"least(255, greatest(0, trunc({P} * {SCALE} - lo[i % 3 + 1] * {SCALE}))) END",
           "stretched"),
    mapped("Brightness", f"{P} // 2"),
    mapped("Contrast", f"trunc(grey + 0.5::DOUBLE * ({P} - grey))", "greyed"),
    mapped("Color", f"trunc({lumas('i')} + 0.5::DOUBLE * ({P} - {lumas('i')}))"),
    mapped("Identity", P)]))

X, Y = "(i // 3 % 8)", "(i // 24)"


def filtered(name: str) -> str:
    kernel, divisor, offset = px.FILTERS[name]
    r = len(kernel) // 2
    total = " + ".join(
        f"{w} * pixels[i + {((dy - r) * 8 + dx - r) * 3} + 1]"
        for dy, row in enumerate(kernel) for dx, w in enumerate(row) if w)
    value = f"least(255, greatest(0, floor(({total}) / {divisor}.0::DOUBLE + {offset} + 0.5)))"
    return (f"CASE WHEN {X} BETWEEN {r} AND {7 - r} AND {Y} BETWEEN {r} AND {7 - r} "
            f"THEN {value} ELSE {P} END")


SMOOTH = filtered("smooth")
ORACLE["neighbour_kernels"] = with_(RASTERS, select=" UNION ALL ".join([
    mapped("ToBLUR", filtered("blur")), mapped("ToCONTOUR", filtered("contour")),
    mapped("ToEMBOSS", filtered("emboss")), mapped("ToEDGES", filtered("edges")),
    mapped("Sharpness", f"trunc(({SMOOTH}) + 0.5::DOUBLE * ({P} - ({SMOOTH})))")]))


def moved(op: str, sx: str, sy: str) -> str:
    sx, sy = (f"floor({s} + 1e-9::DOUBLE)::BIGINT" for s in (sx, sy))
    return mapped(op, f"CASE WHEN {sx} BETWEEN 0 AND 7 AND {sy} BETWEEN 0 AND 7 "
                      f"THEN pixels[({sy} * 8 + {sx}) * 3 + i % 3 + 1] ELSE 0 END")


CX, CY = f"({X} + 0.5::DOUBLE)", f"({Y} + 0.5::DOUBLE)"
COS, SIN = number(math.cos(math.radians(30))), number(math.sin(math.radians(30)))


def corner(axis: str) -> str:
    key = f"'{SEED}:' || image_id || ':CutoutAbs:0:{axis}'"
    return f"trunc(greatest(0, {uniform(key)} * 8 - 1.5::DOUBLE))"


def fill() -> str:
    r, g, b = px.CUTOUT_COLOR
    return (f"CASE WHEN {X} BETWEEN x0 AND least(8, x0 + 3) AND {Y} BETWEEN y0 "
            f"AND least(8, y0 + 3) THEN [{r}, {g}, {b}][i % 3 + 1] ELSE {P} END")


ORACLE["geometric_kernels"] = with_(RASTERS, f"""
holes AS (SELECT *, {corner('u')} AS x0, {corner('v')} AS y0 FROM rasters)""",
    select=" UNION ALL ".join([
        moved("ShearX", f"{CX} + 0.25 * {CY}", CY),
        moved("ShearY", CX, f"{CY} + 0.25 * {CX}"),
        moved("TranslateXabs", f"{CX} + 3", CY),
        moved("TranslateYabs", CX, f"{CY} - 2"),
        moved("TranslateX", f"{CX} + 2", CY),
        moved("TranslateY", CX, f"{CY} - 2"),
        mapped("Flip", f"pixels[({Y} * 8 + 7 - {X}) * 3 + i % 3 + 1]"),
        moved("Rotate", f"{COS} * ({CX} - 4) - {SIN} * ({CY} - 4) + 4",
              f"{SIN} * ({CX} - 4) + {COS} * ({CY} - 4) + 4"),
        mapped("CutoutAbs", fill(), "holes")]))



def once() -> str:
    """One drawn operation per image: a branch per operation and sign, on its own images."""
    m = {n: views.magnitude_of(10, lo, hi) for n, lo, hi in views.AUGMENTATIONS}

    def shifted(op: str, sign: int) -> str:
        v, a = number(m[op] * sign), math.radians(m[op] * sign)
        cos, sin = number(math.cos(a)), number(math.sin(a))
        sx, sy = {
            "ShearX": (f"{CX} + {v} * {CY}", CY), "ShearY": (CX, f"{CY} + {v} * {CX}"),
            "TranslateXabs": (f"{CX} + {v}", CY), "TranslateYabs": (CX, f"{CY} + {v}"),
            "Rotate": (f"{cos} * ({CX} - 4) - {sin} * ({CY} - 4) + 4",
                       f"{sin} * ({CX} - 4) + {cos} * ({CY} - 4) + 4"),
        }[op]
        return moved(op, sx, sy).replace("FROM rasters", f"FROM drawn WHERE op = '{op}' "
                                         f"AND sign = {sign}")

    side = number(m["CutoutAbs"])
    corners = [f"trunc(greatest(0, {uniform(key)} * 8 - {side} / 2))" for key in (
        f"'{SEED}:' || image_id || ':aux:0:u'", f"'{SEED}:' || image_id || ':aux:0:v'")]
    r, g, b = px.CUTOUT_COLOR
    hole = (f"CASE WHEN {X} BETWEEN x0 AND least(8, x0 + {side}) AND {Y} BETWEEN y0 "
            f"AND least(8, y0 + {side}) THEN [{r}, {g}, {b}][i % 3 + 1] ELSE {P} END")
    bodies = {
        "AutoContrast": f"CASE WHEN {SPAN} = 0 THEN {P} ELSE least(255, greatest(0, "
                        f"trunc({P} * {SCALE} - lo[i % 3 + 1] * {SCALE}))) END",
        "Equalize": P,  # 64 pixels are too few to move any level
        "Invert": f"255 - {P}",
        "Posterize": f"{P} & 128",
        "Solarize": f"CASE WHEN {P} < {number(m['Solarize'])} THEN {P} ELSE 255 - {P} END",
        "SolarizeAdd": f"CASE WHEN {ADDED} < 128 THEN {ADDED} ELSE 255 - {ADDED} END",
        "Contrast": f"trunc(grey + {number(m['Contrast'])} * ({P} - grey))",
        "Sharpness": f"trunc(({SMOOTH}) + {number(m['Sharpness'])} * ({P} - ({SMOOTH})))",
        "CutoutAbs": hole,
        "ToBLUR": filtered("blur"), "ToCONTOUR": filtered("contour"),
        "ToEMBOSS": filtered("emboss"), "ToEDGES": filtered("edges"),
    }
    parts = [mapped(op, body, f"drawn WHERE op = '{op}'") for op, body in bodies.items()]
    parts += [shifted(op, sign) for op in ("ShearX", "ShearY", "TranslateXabs", "TranslateYabs",
                                           "Rotate") for sign in (1, -1)]
    key = f"'{SEED}:' || image_id || ':aux:0:"
    return with_(RASTERS, CHANNELS, f"""
drawn AS (
  SELECT *, CASE WHEN op IN ({SIGNED}) AND s > 0.5 THEN -1 ELSE 1 END AS sign,
         {corners[0]} AS x0, {corners[1]} AS y0
  FROM (SELECT c.*, grey, {NAMES}[floor({uniform(key + "op'")} * 18)::INTEGER + 1] AS op,
               {uniform(key + "sign'")} AS s
        FROM stretched c JOIN (SELECT image_id, grey FROM greyed) USING (image_id)))""",
                 select=f"SELECT image_id, 'aux' AS view, pixels FROM ({' UNION ALL '.join(parts)})")


ORACLE["augment_once"] = once()

MEAN = "[" + ", ".join(number(v) for v in px.CHANNEL_MEAN) + "]"
STD = "[" + ", ".join(number(v) for v in px.CHANNEL_STD) + "]"
NORMALIZED = f"(p / 255.0::DOUBLE - {MEAN}[i % 3 + 1]) / {STD}[i % 3 + 1]"
LONG_PIXELS = "SELECT image_id, unnest(pixels) AS p, unnest(range(192)) AS i FROM rasters"
ORACLE["normalize_pixels"] = with_(RASTERS, select=f"""
SELECT image_id, i::INTEGER AS pos, round({NORMALIZED}, 9) AS value FROM ({LONG_PIXELS})""")
ORACLE["eval_views"] = with_(RASTERS, select=f"""
SELECT image_id, (i % 3 * 64 + i // 3)::INTEGER AS pos,
       round(({NORMALIZED})::FLOAT::DOUBLE, 4) AS value FROM ({LONG_PIXELS})""")
ORACLE["channel_means"] = with_(RASTERS, select=f"""
SELECT image_id, (i % 3)::INTEGER AS channel, round(avg(p), 9) AS mean
FROM ({LONG_PIXELS}) GROUP BY image_id, i % 3""")
ORACLE["sample_pairing"] = with_(RASTERS, f"""
numbered AS (
  SELECT image_id, pixels, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5('{SEED}:' || image_id), image_id) - 1 AS r
  FROM rasters)""", select=f"""
SELECT a.image_id, b.image_id AS partner_id,
       array_to_string(list_transform(range(192), lambda i:
         trunc(a.pixels[i + 1] + 0.25::DOUBLE * (b.pixels[i + 1] - a.pixels[i + 1]))::INTEGER),
         ',') AS pixels
FROM numbered a JOIN numbered b
  ON b.r = floor({uniform(f"'{SEED}:' || a.image_id || ':pair'")} * a.n)::BIGINT""")


def slot(i: int) -> str:
    """(image_id, op, magnitude) of one slot of the auxiliary view."""
    chosen = f"floor({uniform(f"'{SEED}:' || path || ':aux:{i}:op'")} * 18)::INTEGER + 1"
    return f"""
slot{i} AS (
  SELECT path, {NAMES}[i] AS op{i}, round({MAGNITUDES}[i] * CASE WHEN {NAMES}[i] IN ({SIGNED})
           AND {uniform(f"'{SEED}:' || path || ':aux:{i}:sign'")} > 0.5 THEN -1 ELSE 1 END, 6) AS magnitude{i}
  FROM (SELECT path, {chosen} AS i FROM samples))"""


ORACLE["pretrain_samples"] = with_(
    *mode_bags("train", 1, 32, SHUFFLED), """
samples AS (SELECT *, images AS path FROM batched JOIN annotation USING (sid))""", FRAMED.format("""
SELECT path AS image_id, (512 + substr(sid, 2)::BIGINT % 3 * 64)::INTEGER AS width,
       unnest(['basic1', 'basic2', 'aux']) AS view FROM samples"""), VIEW_PLAN, slot(0), slot(1), select="""
SELECT batch_id, pos, bag_id, plans.*, labels AS label,
       CASE WHEN view = 'aux' THEN op0 END AS op0, CASE WHEN view = 'aux' THEN op1 END AS op1,
       CASE WHEN view = 'aux' THEN magnitude0 END AS magnitude0,
       CASE WHEN view = 'aux' THEN magnitude1 END AS magnitude1
FROM plans JOIN samples ON path = image_id JOIN slot0 USING (path) JOIN slot1 USING (path)""")

# ---------------------------------------------------------------- runs

ORACLE["parse_run_log"] = f"""
SELECT kind, epoch, count(*) AS n,
       CASE kind WHEN 'train' THEN '2021-01-15 00:11:06.861'
                 ELSE '2020-12-18 23:25:39.857' END AS ts,
       round(avg(value) FILTER (kind = 'train'), 6) AS loss,
       round(avg(CASE kind WHEN 'train' THEN 763.72::DOUBLE ELSE 365.93::DOUBLE END), 6)
         AS cost_seconds,
       round(avg(event_id % 1000 / 1000.0::DOUBLE) FILTER (kind = 'eval'), 6) AS auc
FROM (SELECT *, event_id // {t.STEPS_PER_EPOCH} + 1 AS epoch,
             CASE WHEN event_id % 3 = 0 THEN 'eval' ELSE 'train' END AS kind
      FROM events WHERE event_id % 7 <> 0)
GROUP BY kind, epoch"""
STEPS = f"""
steps AS (SELECT 'run' || user_id % 4 AS run_id, ts, event_id + 1 AS step, value AS loss,
                 event_id // {t.STEPS_PER_EPOCH} + 1 AS epoch FROM events)"""
ORACLE["epoch_loss"] = with_(STEPS, select=f"""
SELECT run_id, epoch, round(avg(loss), 6) AS loss, count(*) AS steps,
       round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE
             / {t.STEPS_PER_EPOCH}.0::DOUBLE, 6) AS step_seconds,
       round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6::DOUBLE
             / {t.STEPS_PER_EPOCH}.0::DOUBLE * {t.STEPS_PER_EPOCH}.0::DOUBLE, 6) AS total_seconds
FROM steps GROUP BY run_id, epoch""")
ORACLE["keep_latest"] = with_(STEPS, select="""
SELECT run_id, epoch, max(step) AS step FROM steps GROUP BY run_id, epoch
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 2""")
ORACLE["append_run_log"] = with_(STEPS, select="""
SELECT run_id, epoch, epoch % 10 AS batch, count(*) AS steps, round(avg(loss), 6) AS loss
FROM steps GROUP BY run_id, epoch""")
ORACLE["append_report"] = f"SELECT *, (epoch % 4) // 2 AS batch FROM ({ORACLE['epoch_eval']})"
ORACLE["expire_outputs"] = with_(STEPS, select="""
SELECT run_id, epoch, count(*) AS steps, max(step) AS last_step FROM steps GROUP BY run_id, epoch
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 2""")
ORACLE["run_manifest"] = """
SELECT event_id, 'type' AS name, event_type AS setting FROM events
UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events"""

# ---------------------------------------------------------------- streams

STREAM = [f"""
scored AS (
  SELECT event_id AS example, label_idx::INTEGER AS label_idx, (event_type = code)::INTEGER AS gt,
         0.3::DOUBLE * (event_type = code)::INTEGER
         + 0.7::DOUBLE * {uniform("'stream:' || event_id || ':' || code")} AS score
  FROM (SELECT event_id, event_type, unnest(range(5)) AS label_idx,
               unnest(['click', 'error', 'purchase', 'signup', 'view']) AS code FROM events))""",
          PREDICTED, *metric_ctes()]
ORACLE["stream_confusion"] = with_(*STREAM, select="SELECT * FROM counts")
ORACLE["stream_metrics"] = with_(*STREAM, select=FULL)
EPOCH_SOURCES = {"examples": EXAMPLE, "macro": MACRO, "micro": MICRO, "area": ["sk_auc_macro"],
                 "zero": ["sk_f1_macro", "sk_f1_micro"], "pooled_auc": ["sk_auc_micro"]}
ORACLE["stream_epoch_eval"] = with_(STREAM[0], f"""
cells AS (
  SELECT * FROM (
    SELECT *, example // {t.STEPS_PER_EPOCH} + 1 AS epoch,
           (score >= least(max(score) OVER (PARTITION BY example), 0.5::DOUBLE))::INTEGER AS pred
    FROM scored) WHERE epoch % 2 = 0)""", *metric_ctes("epoch,"), select=" UNION ALL ".join(
    f"SELECT epoch, '{n}' AS metric, round({n}, 9) AS value FROM {source}"
    for source, names in EPOCH_SOURCES.items() for n in names))
ORACLE["stream_epoch_loss"] = with_(STEPS, select="""
SELECT run_id, epoch, round(avg(loss), 6) AS loss, count(*) AS steps
FROM steps GROUP BY run_id, epoch""")

ORACLE["stream_metrics_in_batches"] = ORACLE["stream_metrics"]
ORACLE["stream_progress_log"] = """
SELECT input_rows, count(*) AS batches FROM (
  SELECT event_id % 8 AS part, count(*) AS input_rows FROM events GROUP BY part) GROUP BY input_rows"""

def _losses(part: str, by: str) -> str:
    return f"""
SELECT {part} AS part, 'hamming_loss' AS metric, round(avg((gt <> pred)::INTEGER), 9) AS value FROM cells {by}
UNION ALL SELECT {part}, 'one_error', round(avg(1 - gt), 9) FROM best {by}"""


ORACLE["custom_metric"] = with_(*EVENTS, """
best AS (SELECT * FROM cells
         QUALIFY row_number() OVER (PARTITION BY example ORDER BY score DESC, label_idx) = 1)""",
    select=f"""{_losses("(example % 10)::VARCHAR", "GROUP BY example % 10")}
UNION ALL {_losses("'all'", "")}""")
ORACLE["matched_examples"] = """
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN (quality = toxic)::INTEGER END AS agree,
       (doc_id % 7 <> 0)::INTEGER + 2 * (doc_id % 5 <> 0)::INTEGER AS sides
FROM labels WHERE doc_id % 35 <> 0"""
ORACLE["image_manifest"] = """
SELECT label::VARCHAR AS sid, vec_id || '.bmp' AS name, 246::BIGINT AS length,
       (1 + label % 2)::BIGINT AS batch FROM embeddings"""
ORACLE["fetch_samples"] = """
SELECT vec_id, label, pos::INTEGER AS pos, round(value::DOUBLE, 9) AS value FROM (
  SELECT vec_id, label, unnest(embedding) AS value, unnest(range(len(embedding))) AS pos
  FROM embeddings WHERE vec_id % 50 = 0)"""
ORACLE["probe_data"] = """
SELECT split, label, count(*) AS n FROM (
  SELECT label, CASE WHEN r < floor(n * 0.4::DOUBLE) THEN 'train'
                     WHEN r < floor(n * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT label, count(*) OVER () AS n,
               row_number() OVER (ORDER BY md5('286501567:' || vec_id), vec_id) - 1 AS r FROM embeddings))
GROUP BY split, label"""

ORACLE["document_labels"] = """
SELECT doc_id AS sid, (quality + toxic)::INTEGER AS n,
       CASE WHEN quality = 1 AND toxic = 1 THEN 'quality;toxic' WHEN quality = 1 THEN 'quality'
            WHEN toxic = 1 THEN 'toxic' ELSE '' END AS label, quality || ',' || toxic AS gt
FROM labels"""
