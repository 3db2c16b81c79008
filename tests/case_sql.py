"""DuckDB SQL that works out the literal cases' results from the same inputs; cases without an entry here state their rows."""

from __future__ import annotations

_DIGITS_17 = "list_sum(list_transform(range(1, 18), lambda i: [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i] * coalesce(TRY_CAST(v[i] AS INTEGER), 0)))"
_LUHN = """(list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 1 THEN
  CASE WHEN 2 * coalesce(TRY_CAST(v[i] AS INTEGER), 0) > 9 THEN 2 * coalesce(TRY_CAST(v[i] AS INTEGER), 0) - 9 ELSE 2 * coalesce(TRY_CAST(v[i] AS INTEGER), 0) END ELSE coalesce(TRY_CAST(v[i] AS INTEGER), 0) END)) % 10 = 0)"""
_SHARES = "least(greatest(a, 0), 1)"
_TRUTH = """t(item, page, type, role, b) AS (VALUES (1, 1, 'PERSON', 'redact', [0.1, 0.1, 0.3, 0.2]), (2, 1, 'PERSON', 'redact', [0.1, 0.3, 0.3, 0.4]), (3, 1, 'PHONE', 'redact', [0.1, 0.5, 0.3, 0.6]),
  (4, 1, 'DATE', 'keep', [0.5, 0.1, 0.7, 0.2]), (5, 1, 'DATE', 'keep', [0.5, 0.3, 0.7, 0.4]), (6, 2, 'PHONE', 'redact', [0.1, 0.1, 0.3, 0.2])),
p(page, source, b) AS (VALUES (1, 'rule', [0.1, 0.1, 0.2, 0.2]), (1, 'rule', [0.2, 0.1, 0.3, 0.2]), (1, 'rule', [0.1, 0.3, 0.2, 0.4]), (1, 'rule', [0.6, 0.1, 0.7, 0.2]), (1, 'watermark', [0.5, 0.3, 0.7, 0.4]), (1, 'rule', [0.8, 0.8, 0.9, 0.9])),
x AS (SELECT item, unnest(range(CAST(floor(CAST(b[1] AS DOUBLE) * 707) AS BIGINT), CAST(ceil(CAST(b[3] AS DOUBLE) * 707) AS BIGINT))) AS x FROM t),
c AS (SELECT item, page, role, x, unnest(range(CAST(floor(CAST(b[2] AS DOUBLE) * 1000) AS BIGINT), CAST(ceil(CAST(b[4] AS DOUBLE) * 1000) AS BIGINT))) AS y FROM x JOIN t USING (item)),
k AS (SELECT item, any_value(role) AS role, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.page = c.page AND (c.role = 'redact' OR source <> 'watermark')
  AND x >= floor(CAST(p.b[1] AS DOUBLE) * 707) AND x < ceil(CAST(p.b[3] AS DOUBLE) * 707) AND y >= floor(CAST(p.b[2] AS DOUBLE) * 1000) AND y < ceil(CAST(p.b[4] AS DOUBLE) * 1000))) AS hit FROM c GROUP BY item),
s AS (SELECT item, CASE WHEN role = 'redact' THEN CASE WHEN hit / n >= 0.8 THEN 'full' WHEN hit / n >= 0.3 THEN 'partial' ELSE 'miss' END WHEN hit / n > 0.15 THEN 'over' ELSE 'ok' END AS status FROM k)"""
_REVIEW = """a(page, type, b, style) AS (VALUES (1, 'PERSON', [0.1, 0.1333, 0.4, 0.2], 'black'), (1, 'PERSON', [0.1, 0.1333, 0.4, 0.2], 'black'), (2, 'ORG', [0.0, 0.0, 0.5, 0.5], 'label')),
n(page, type, b, style) AS (VALUES (1, 'PERSON', [0.1, 0.1333, 0.4, 0.2], 'black'), (2, 'ORG', [0.0, 0.0, 0.5, 0.5], 'label'), (3, 'PHONE', [0.5, 0.5, 0.9, 0.6], 'label'))"""
_PROSE = """nm(d, a, b, role) AS (VALUES (1, 0, 3, 'PERSON'), (1, 10, 12, 'STAFF'), (1, 20, 23, 'PERSON')),
h(d, a, b, type) AS (VALUES (1, 0, 2, 'PERSON'), (1, 2, 5, 'STAFF'), (1, 10, 12, 'PERSON'), (1, 20, 22, 'PERSON')),
ch AS (SELECT *, unnest(range(a, b)) AS pos FROM nm),
sc AS (SELECT d, a, role, bool_and(EXISTS (SELECT 1 FROM h WHERE h.d = ch.d AND pos >= h.a AND pos < h.b)) AS covered FROM ch GROUP BY ALL),
got AS (SELECT sc.*, (SELECT max_by(type, h.a) FROM h WHERE h.d = sc.d AND h.a <= sc.a AND h.b > sc.a) AS got FROM sc)"""

CASE_SQL = {
    "id_card_ok": f"""WITH c(value) AS (VALUES ('11010519491231002X'), ('11010519491231002x'), ('110105194912310021'), ('110105194913310021'), ('11010519490230002X'), (''), (NULL)), u AS (SELECT value, upper(value) AS v FROM c)
SELECT value, coalesce(regexp_full_match(v, '[0-9]{{17}}[0-9X]') AND try_strptime(substr(v, 7, 8), '%Y%m%d') IS NOT NULL AND TRY_CAST(substr(v, 7, 4) AS INTEGER) BETWEEN 1900 AND 2100
  AND substr('10X98765432', CAST({_DIGITS_17} % 11 AS INTEGER) + 1, 1) = v[18], FALSE) AS ok FROM u""",
    "luhn_ok": f"""WITH c(v) AS (VALUES ('4111111111111111'), ('4111111111111112'), ('6222021234567890128'), (''), (NULL)) SELECT v AS value, coalesce(v <> '' AND {_LUHN}, FALSE) AS ok FROM c""",
    "uscc_ok": """WITH c(v) AS (VALUES ('91350100M000100Y43'), ('91350100M000100Y44'), ('91350100I000100Y43'), (NULL)), a AS (SELECT v, '0123456789ABCDEFGHJKLMNPQRTUWXY' AS al FROM c),
s AS (SELECT *, list_sum(list_transform(range(1, 18), lambda i: (strpos(al, v[i]) - 1) * [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28][i])) AS t FROM a)
SELECT v AS value, coalesce(regexp_full_match(v, '[0-9A-HJ-NP-RTUWXY]{18}') AND al[CAST((31 - t % 31) % 31 AS INTEGER) + 1] = v[18], FALSE) AS ok FROM s""",
    "slanted_angles": "SELECT CAST(a AS DOUBLE) AS angle, (abs(a) % 180 BETWEEN 15 AND 75) OR (abs(a) % 180 BETWEEN 105 AND 165) AS slanted FROM (VALUES (0.0), (15.0), (75.0), (76.0), (-45.0), (120.0), (170.0), (210.0)) t(a)",
    "rotate_rect": """WITH r(rotation, h) AS (VALUES (0, 200), (90, 200), (180, 300), (270, 200)), c AS (SELECT *, unnest([10, 50]) AS x FROM r), d AS (SELECT *, unnest([20, 60]) AS y FROM c),
t AS (SELECT rotation, CASE rotation WHEN 90 THEN y WHEN 180 THEN 100 - 1 - x WHEN 270 THEN 100 - 1 - y ELSE x END AS u, CASE rotation WHEN 90 THEN h - 1 - x WHEN 180 THEN h - 1 - y WHEN 270 THEN x ELSE y END AS w FROM d)
SELECT CAST(rotation AS BIGINT) AS rotation, CAST(min(u) AS DOUBLE) AS x0, CAST(min(w) AS DOUBLE) AS y0, CAST(max(u) AS DOUBLE) AS x1, CAST(max(w) AS DOUBLE) AS y1 FROM t GROUP BY rotation""",
    "image_size_pt": "SELECT CAST(px AS BIGINT) AS px, CAST(dpi AS DOUBLE) AS dpi, round(px * 72.0 / CASE WHEN dpi BETWEEN 36 AND 2400 THEN dpi ELSE 200 END, 6) AS points FROM (VALUES (1654, 200.0), (100, 0.0), (100, 72.0), (100, 5000.0), (100, NULL)) t(px, dpi)",
    "pixel_limit": "SELECT CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(w AS BIGINT) * h > 80000000 AS refused FROM (VALUES (8000, 10000), (8001, 10000), (100000, 100000)) t(w, h)",
    "plausible_codes": "SELECT CAST(h AS DOUBLE) AS side, CAST(w AS DOUBLE) AS w, w BETWEEN 200 / 2.54 * 0.6 AND 200 / 2.54 * 6 AND h BETWEEN 200 / 2.54 * 0.6 AND 200 / 2.54 * 6 AND w / h BETWEEN 0.75 AND 1.33 AS ok FROM (VALUES (120.0, 120.0), (720.0, 720.0), (90.0, 300.0), (40.0, 40.0)) t(h, w)",
    "pad_boxes": "SELECT CAST(greatest(10 - p, 0) AS DOUBLE) AS x0, CAST(greatest(20 - q, 0) AS DOUBLE) AS y0, CAST(least(50 + p, 100) AS DOUBLE) AS x1, CAST(least(60 + q, 100) AS DOUBLE) AS y1 FROM (SELECT greatest((50 - 10) * 0.08, 4.0) AS p, greatest((60 - 20) * 0.08, 4.0) AS q)",
    "upper_median": "SELECT CAST(n AS BIGINT) AS n, CAST(list_sort(xs)[len(xs) // 2 + 1] AS DOUBLE) AS m FROM (VALUES (1, [5.0]), (2, [9.0, 1.0]), (3, [9.0, 5.0, 1.0]), (4, [9.0, 7.0, 5.0, 1.0])) t(n, xs)",
    "interval_union": """WITH i(k, lo, hi) AS (VALUES (1, 0, 10), (1, 10, 15), (1, 20, 30), (1, 22, 24), (2, 0, 5)), b AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi) AS run FROM b) SELECT CAST(k AS BIGINT) AS k, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi FROM r GROUP BY k, run""",
    "verify_strips": """WITH i(a, b) AS (VALUES (10.0, 30.0), (110.0, 160.0), (400.0, 410.0), (60.0, 130.0)), g AS (SELECT greatest(a - greatest(40, b - a), 0) AS lo, least(b + greatest(40, b - a), 1000) AS hi FROM i),
f AS (SELECT *, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g), r AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi) AS run FROM f)
SELECT CAST(min(lo) AS DOUBLE) AS lo, CAST(max(hi) AS DOUBLE) AS hi FROM r GROUP BY run""",
    "strip_layout": """WITH s(lo, hi) AS (VALUES (0.0, 100.0), (300.0, 400.0)) SELECT CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, sum(hi - lo) OVER () > 0.7 * 1000 AS "whole",
  CAST(coalesce(sum(hi - lo + 48) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS "offset",
  CAST(ceil(greatest(sum(hi - lo) OVER () + 48 * (count(*) OVER () - 1), 736) / 256) * 256 AS BIGINT) AS canvas FROM s""",
    "model_classes": """SELECT CAST(id AS BIGINT) AS id, CASE WHEN 1 / (1 + exp(-list_max(l))) >= 0.6 THEN ['SEAL', 'SIGNATURE'][list_position(l, list_max(l))] END AS type
FROM (VALUES (1, [2.0, 4.0, -20.0, -20.0]), (2, [2.0, 1.0, 8.0, -20.0]), (3, [3.0, 1.0, 0.0, 0.0]), (4, [0.1, 0.0, 0.0, 0.0])) t(id, l)""",
    "protect_dates": "SELECT CAST(id AS BIGINT) AS id, CASE WHEN x0 < 60 AND 0 < x1 AND y0 < 30 AND 10 < y1 THEN 'concern' ELSE 'accepted' END AS outcome FROM (VALUES (1, 5, 15, 100, 40), (2, 5, 60, 100, 90)) t(id, x0, y0, x1, y1)",
    "image_objects": """WITH i(id, page, w, h, digest) AS (VALUES (1, 0, 68, 40, 's'), (2, 0, 200, 200, 'l'), (3, 1, 200, 200, 'l'), (4, 0, 300, 300, 'k'), (5, 0, 10, 10, 't'), (6, 2, 1654, 2300, 'p'), (7, 2, 68, 40, 'q')),
s AS (SELECT *, w * h / (1654.0 * 2339) AS share, 200 / 2.54 AS cm FROM i), m AS (SELECT *, max(share) OVER (PARTITION BY page) AS most, (SELECT count(DISTINCT page) FROM i j WHERE j.digest = s.digest) AS on_pages FROM s)
SELECT CAST(id AS BIGINT) AS id, CASE WHEN most >= 0.8 OR least(w, h) < 0.2 * cm OR share > 0.3 THEN NULL WHEN h < 1.4 * cm AND w >= 1.4 * h AND share < 0.02 THEN 'SIGNATURE' WHEN on_pages >= 2 THEN 'LOGO' ELSE 'keep' END AS kind FROM m""",
    "repeated_graphics": """WITH g(id, page, cx, cy, w, h, t) AS (VALUES (1, 1, 0.50, 0.50, 0.1, 0.1, [1.0, 1.0]), (2, 2, 0.52, 0.49, 0.1, 0.11, [1.0, 0.9]), (3, 3, 0.70, 0.50, 0.1, 0.1, [1.0, 1.0]), (4, 4, 0.51, 0.50, 0.2, 0.1, [1.0, 1.0]), (5, 5, 0.50, 0.50, 0.1, 0.1, [-1.0, 1.0]))
SELECT DISTINCT CAST(a.id AS BIGINT) AS id FROM g a JOIN g b ON a.page <> b.page AND abs(a.cx - b.cx) <= 0.04 AND abs(a.cy - b.cy) <= 0.04 AND a.w / b.w BETWEEN 0.8 AND 1.25 AND a.h / b.h BETWEEN 0.8 AND 1.25 AND (a.t[1] * b.t[1] + a.t[2] * b.t[2]) / 2 >= 0.6""",
    "coverage_status": f"WITH {_TRUTH} SELECT CAST(item AS BIGINT) AS item, status FROM s",
    "recall_table": f"""WITH {_TRUTH} SELECT type, count(*) FILTER (role = 'redact') AS redact, count(*) FILTER (role = 'redact' AND status = 'full') AS "full", count(*) FILTER (role = 'redact' AND status = 'partial') AS partial,
  count(*) FILTER (role = 'redact' AND status = 'miss') AS miss, count(*) FILTER (role <> 'redact') AS keep, count(*) FILTER (status = 'over') AS over,
  CASE WHEN count(*) FILTER (role = 'redact') > 0 THEN round(count(*) FILTER (role = 'redact' AND status = 'full') / count(*) FILTER (role = 'redact'), 3) END AS recall FROM t JOIN s USING (item) GROUP BY type""",
    "review_added": f"WITH {_REVIEW} SELECT CAST(page AS BIGINT) AS page, type FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM a)",
    "review_removed": f"WITH {_REVIEW} SELECT CAST(page AS BIGINT) AS page, type FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM n)",
    "changed_pages": f"WITH {_REVIEW} SELECT DISTINCT CAST(page AS BIGINT) AS page FROM ((SELECT * FROM n EXCEPT ALL SELECT * FROM a) UNION ALL (SELECT * FROM a EXCEPT ALL SELECT * FROM n))",
    "coco_export": """WITH c AS (SELECT unnest(['ADDRESS', 'BANK_CARD', 'CUSTOM', 'EMAIL', 'HANDWRITTEN_FIELD', 'ID_CARD', 'LOGO', 'MEDICAL_ID', 'ORG', 'PERSON', 'PHONE', 'PLATE', 'QRCODE', 'SEAL', 'SIGNATURE', 'STAFF', 'USCC', 'WATERMARK']) AS type, unnest(range(1, 19)) AS id),
i(page, type, x0, y0, x1, y1) AS (VALUES (1, 'PERSON', 0.1, 0.1333, 0.4, 0.2), (1, 'ORG', 0.0, 0.0, 0.5, 0.5), (1, 'WATERMARK', 0.0, 0.0, 1.0, 1.0))
SELECT CAST(page AS BIGINT) AS image_id, CAST(id AS BIGINT) AS category_id, round(CAST(x0 * 200 AS DOUBLE), 1) AS x, round(CAST(y0 * 300 AS DOUBLE), 1) AS y, round(CAST((x1 - x0) * 200 AS DOUBLE), 1) AS w, round(CAST((y1 - y0) * 300 AS DOUBLE), 1) AS h FROM i JOIN c USING (type) WHERE type <> 'WATERMARK'""",
    "bio_tags": """WITH e AS (SELECT '由张三陪' AS t, 1 AS s, 3 AS f) SELECT CAST(i AS BIGINT) AS pos, t[i + 1] AS ch, CASE WHEN i = s THEN 'B-PER' WHEN i > s AND i < f THEN 'I-PER' ELSE 'O' END AS tag FROM (SELECT *, unnest(range(0, length(t))) AS i FROM e)""",
    "ner_windows": "SELECT CAST(n AS BIGINT) AS n, CAST(unnest(range(0, greatest(n - 40, 1), 160)) AS BIGINT) AS start FROM (VALUES (10), (200), (201), (400)) t(n)",
    "check_digits": f"""WITH c(v) AS (VALUES ('11010519491231002'), ('411111111111111')) SELECT v AS body, CASE WHEN length(v) = 17 THEN substr('10X98765432', CAST({_DIGITS_17} % 11 AS INTEGER) + 1, 1) END AS id,
  CASE WHEN length(v) = 15 THEN (SELECT CAST(d AS VARCHAR) FROM (SELECT d, c.v || CAST(d AS VARCHAR) AS v FROM range(10) r(d)) WHERE {_LUHN}) END AS luhn FROM c""",
    "prose_summary": f"WITH {_PROSE} SELECT count(*) AS names, round(count(*) FILTER (covered) / count(*), 4) AS recall, round(count(*) FILTER (covered AND got = role) / count(*) FILTER (covered), 4) AS type_accuracy FROM got",
    "prose_confusion": f"WITH {_PROSE} SELECT role, got, count(*) AS n FROM got WHERE covered GROUP BY ALL",
    "evidence_states": """SELECT CAST(id AS BIGINT) AS id, CASE WHEN NOT e THEN 'disabled' WHEN NOT ap THEN 'not_applicable' WHEN a <> b THEN 'error' WHEN r > 0 THEN 'review' ELSE 'passed' END AS status
FROM (VALUES (1, FALSE, TRUE, 1, 1, 0), (2, TRUE, FALSE, 1, 1, 0), (3, TRUE, TRUE, 2, 1, 0), (4, TRUE, TRUE, 1, 1, 1), (5, TRUE, TRUE, 1, 1, 0)) t(id, e, ap, a, b, r)""",
    "printed_text": "SELECT CAST(id AS BIGINT) AS id, length(t) >= 4 AND list_avg(s) >= 0.9 AS printed FROM (VALUES (1, '四个字呢', [0.9, 0.95, 0.9, 0.9]), (2, '四个字呢', [0.5, 0.95, 0.9, 0.9]), (3, '三个字', [1.0, 1.0, 1.0])) x(id, t, s)",
    "beside_names": "SELECT CAST(x AS DOUBLE) AS x0, greatest(0 - (x + 50), x - 100) BETWEEN -0.1 * 50 AND 1.5 * 50 AND 10 BETWEEN 0 - 20 * 0.3 AND 20 + 20 * 0.3 AS beside FROM (VALUES (110.0), (400.0), (-60.0)) t(x)",
    "job_states": """WITH e(job_id, seq, status, code) AS (VALUES ('a', 1, 'queued', NULL), ('a', 2, 'running', NULL), ('a', 3, 'succeeded', NULL), ('b', 1, 'queued', NULL), ('c', 1, 'queued', NULL), ('c', 2, 'failed', 'INVALID_FILE')),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1) SELECT job_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'INTERRUPTED' ELSE code END AS code FROM l""",
    "key_checks": """WITH k(id, h, revoked) AS (VALUES ('k1', sha256('alpha'), NULL), ('k2', sha256('beta'), 5.0)), r(request_id, key) AS (VALUES (1, 'alpha'), (2, 'beta'), (3, 'gamma'))
SELECT CAST(request_id AS BIGINT) AS request_id, id AS key_id FROM r LEFT JOIN k ON h = sha256(key) AND revoked IS NULL""",
    "stale_files": "SELECT name FROM (VALUES ('a.upload', 0.0), ('tmpx', 0.0), ('sync-1', 0.0), ('b.upload', 9000.0), ('keep.pdf', 0.0)) t(name, m) WHERE 7200 - m > 3600 AND (name LIKE '%.upload' OR name LIKE 'tmp%' OR name LIKE 'sync-%')",
    "retention": "SELECT CAST(h AS DOUBLE) AS hours, CAST(least(greatest(h, 0.1), 168.0) AS DOUBLE) AS kept FROM (VALUES (0.0), (24.0), (500.0)) t(h)",
    "orientation_votes": """WITH b AS (SELECT 1 AS page, 10 AS w, 40 AS h FROM range(9) UNION ALL SELECT 1, 40, 10 UNION ALL SELECT 2, 40, 10 FROM range(9) UNION ALL SELECT 2, 10, 40 FROM range(3)),
c AS (SELECT page, count(*) AS n, count(*) FILTER (h > 1.5 * w) AS tall, count(*) FILTER (w > 1.5 * h) AS wide FROM b GROUP BY page) SELECT CAST(page AS BIGINT) AS page, tall, wide, n >= 5 AND tall >= 8 AND tall >= 2 * wide AS sideways FROM c""",
    "manifest_check": """WITH f(name, found) AS (VALUES ('a.onnx', sha256('a')), ('b.onnx', sha256('b')), ('d.onnx', sha256('d'))), m(name, listed) AS (VALUES ('a.onnx', upper(sha256('a'))), ('b.onnx', sha256('x')), ('c.onnx', sha256('c')), ('../e', sha256('e')))
SELECT name, CASE WHEN regexp_matches(name, '^/|(^|/)\\.\\.(/|$)') THEN 'bad_name' WHEN found IS NULL THEN 'missing' WHEN listed IS NULL THEN 'unlisted' WHEN found = lower(listed) THEN 'ok' ELSE 'mismatch' END AS status FROM f FULL JOIN m USING (name)""",
    "regr_template_fit": """WITH t(x, y, x1, y1) AS (VALUES (0.05, 0.05, 0.10, 0.06), (0.45, 0.05, 0.50, 0.06), (0.05, 0.15, 0.10, 0.16), (0.45, 0.15, 0.52, 0.16)),
p AS (SELECT CAST((x + x1) / 2 * 1000 AS DOUBLE) AS tx, CAST((y + y1) / 2 * 2000 AS DOUBLE) AS ty, CAST((1050 * x + 20 + 1050 * x1 + 20) / 2 AS DOUBLE) AS px, CAST((2100 * y + 35 + 2100 * y1 + 35) / 2 AS DOUBLE) AS py FROM t)
SELECT CAST(1 AS BIGINT) AS doc_id, 't' AS name, count(*) AS n, round(regr_slope(px, tx), 6) AS ax, round(regr_intercept(px, tx), 6) AS bx, round(regr_slope(py, ty), 6) AS ay, round(regr_intercept(py, ty), 6) AS "by" FROM p""",
    "prose_false_runs": """WITH c(d, pos, ch, hit, allowed) AS (VALUES (1, 0, 'a', TRUE, FALSE), (1, 1, 'b', TRUE, FALSE), (1, 2, 'x', TRUE, TRUE), (1, 3, 'c', TRUE, FALSE), (2, 5, 'a', TRUE, FALSE), (2, 6, 'b', TRUE, FALSE), (2, 7, chr(10), TRUE, FALSE)),
w AS (SELECT *, pos - row_number() OVER (PARTITION BY d ORDER BY pos) AS run FROM c WHERE hit AND NOT allowed AND ch <> chr(10)) SELECT text, count(*) AS n FROM (SELECT string_agg(ch, '' ORDER BY pos) AS text FROM w GROUP BY d, run) GROUP BY text""",
    # Cases of plans/more.py.
    "bands": "SELECT k, CAST(sum(n) AS DOUBLE) ** 2 / sum(n * n) AS bands FROM (VALUES ('spread', 5), ('spread', 5), ('spread', 5), ('spread', 5), ('one', 18), ('one', 1), ('one', 1)) t(k, n) GROUP BY k",
    "variant_costs": "SELECT variant, CAST(sum(extras) AS BIGINT) AS extras, round(CAST(sum(elapsed) AS DOUBLE) / sum(pages), 1) AS sec_per_page FROM (VALUES ('scan', 4, 8.0, 1), ('scan', 6, 13.0, 0), ('text', 10, 2.0, 2)) t(variant, pages, elapsed, extras) GROUP BY variant",
    "crowded_pages": "SELECT CAST(page AS BIGINT) AS page FROM (SELECT 1 AS page FROM range(100) UNION ALL SELECT 2 FROM range(101)) GROUP BY page HAVING count(*) > 100",
    "image_digests": "SELECT CAST(id AS BIGINT) AS id, substr(sha1(t), 1, 16) AS digest FROM (VALUES (1, 'a'), (2, 'b'), (3, 'a')) x(id, t)",
    "key_usage": """WITH k(id, revoked) AS (VALUES ('a', NULL), ('b', 5.0), ('c', NULL)), j(owner) AS (VALUES ('a'), ('a'), ('b'), ('x')) SELECT id, revoked IS NULL AS active, (SELECT count(*) FROM j WHERE owner = id) AS jobs FROM k""",
    "read_images": """SELECT CAST(id AS BIGINT) AS id FROM (VALUES (1, 'text', 400, 300, FALSE), (2, 'text', 400, 299, FALSE), (3, 'text', 400, 300, TRUE), (4, 'ocr', 400, 300, FALSE)) t(id, src, w, h, rep) WHERE src = 'text' AND w * h / 1000000.0 >= 0.12 AND NOT rep""",
}
