"""SQL for the pN_ queries, stated from the problem definitions."""

STATUS = """
status AS (
  SELECT m.delivery_id, m.edition, m.release_date, m.delivered_at, m.concept_count, m.archive_sha256,
         coalesce(c.n_found, 0) AS n_found, coalesce(coalesce(c.n_found, 0) >= m.concept_count, false) AS complete
  FROM edition_manifest m LEFT JOIN (
    SELECT delivery_id, count(DISTINCT referenced_component) AS n_found FROM identifier_snapshot GROUP BY 1) c USING (delivery_id))"""

LINKS = """
newest AS (SELECT * FROM sct_relationship QUALIFY rank() OVER (PARTITION BY id ORDER BY coalesce(effective_time, 0) DESC) = 1),
links AS (
  SELECT DISTINCT source_id AS child, destination_id AS parent FROM newest
  WHERE active = 1 AND type_id = 116680003 AND characteristic_type_id = 900000000000011006)"""

ORPHANS = """
states AS (
  SELECT id, coalesce(effective_time, 0) AS as_of, max(active) AS active
  FROM (SELECT id, effective_time, active FROM sct_concept UNION ALL SELECT id, effective_time, active FROM metadata_concept)
  GROUP BY ALL),
referring AS (
  SELECT 'historical_association' AS in_table, delivery_id, id AS record_key, 'referenced_component_id' AS field_name, referenced_component_id AS key
  FROM historical_association WHERE active = 1
  UNION SELECT 'historical_association', delivery_id, id, 'target_component_id', target_component_id FROM historical_association WHERE active = 1
  UNION SELECT 'identifier_snapshot', delivery_id, scheme || '#' || code, 'referenced_component', referenced_component
  FROM identifier_snapshot WHERE active AND (referenced_component // 10) % 100 IN (0, 10)
  UNION SELECT 'member_manifest', delivery_id, CAST(refset_id AS VARCHAR), 'refset_id', refset_id FROM member_manifest),
dated AS (SELECT r.*, m.release_date AS as_of FROM referring r JOIN edition_manifest m USING (delivery_id) WHERE r.key IS NOT NULL AND m.release_date IS NOT NULL),
asked AS (SELECT DISTINCT key, as_of FROM dated),
judged AS (
  SELECT a.key, a.as_of, CASE WHEN count(s.id) = 0 THEN 'missing' WHEN min(s.as_of) > a.as_of THEN 'late'
    WHEN max(CASE WHEN s.as_of <= a.as_of THEN s.as_of * 10 + s.active END) % 10 = 0 THEN 'deleted' END AS reason
  FROM asked a LEFT JOIN states s ON s.id = a.key GROUP BY a.key, a.as_of),
orphans AS (
  SELECT d.*, j.reason FROM dated d JOIN judged j USING (key, as_of)
  WHERE j.reason IS NOT NULL AND NOT (d.field_name = 'referenced_component_id' AND j.reason = 'deleted'))"""

DRIFT = r"""
cells AS (
  SELECT file_id, pos, CASE WHEN pos = 1 THEN regexp_replace(written, '^' || chr(65279), '') ELSE written END AS written
  FROM (SELECT file_id, unnest(header_columns) AS written, generate_subscripts(header_columns, 1) AS pos FROM refset_file)),
own AS (SELECT file_id, lower(regexp_replace(written, '\s', '', 'g')) AS name, min(pos) AS pos FROM cells WHERE pos > 6 GROUP BY 1, 2),
steps AS (SELECT file_id, lag(file_id) OVER (PARTITION BY refset_id ORDER BY release_date, file_id) AS previous FROM refset_file),
split AS (SELECT DISTINCT file_id, string_split(line, chr(9)) AS c FROM refset_raw_row WHERE trim(line, chr(9) || chr(10) || chr(13) || ' ') <> ''),
vals AS (
  SELECT DISTINCT s.file_id, o.name, trim(s.c[1], chr(10) || chr(13) || ' ') AS member, coalesce(trim(s.c[o.pos], chr(10) || chr(13) || ' '), '') AS value
  FROM split s JOIN own o USING (file_id)),
types AS (
  SELECT file_id, name, CASE WHEN bool_and(regexp_full_match(value, '[+-]?[0-9]+')) THEN 'integer'
    WHEN bool_and(regexp_full_match(value, '[+-]?[0-9]+(\.[0-9]+)?')) THEN 'decimal'
    WHEN bool_and(lower(value) IN ('true', 'false')) THEN 'boolean' ELSE 'text' END AS type
  FROM vals WHERE value <> '' GROUP BY 1, 2),
pairs AS (SELECT * FROM steps WHERE previous IS NOT NULL),
news AS (SELECT p.file_id, p.previous, o.name FROM pairs p JOIN own o USING (file_id)),
olds AS (SELECT p.file_id, p.previous, o.name FROM pairs p JOIN own o ON o.file_id = p.previous),
only_new AS (SELECT * FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE o.file_id = n.file_id AND o.name = n.name)),
only_old AS (SELECT * FROM olds o WHERE NOT EXISTS (SELECT 1 FROM news n WHERE o.file_id = n.file_id AND o.name = n.name)),
renamed AS (
  SELECT n.file_id, n.previous, n.name, o.name AS old_name
  FROM only_new n JOIN only_old o USING (file_id) JOIN vals a ON a.file_id = n.file_id AND a.name = n.name
  JOIN vals b ON b.file_id = o.previous AND b.name = o.name AND b.member = a.member
  GROUP BY ALL HAVING bool_and(a.value = b.value) AND bool_or(a.value <> '')),
matched AS (
  SELECT file_id, previous, name, old_name FROM renamed
  UNION ALL SELECT n.file_id, n.previous, n.name, n.name FROM news n JOIN olds o USING (file_id, name))"""

#: The consistent name of every own column: its name in the last file of its line of matches, with that file's number where two lines of one file would share it.
LINEAGE = f"""{DRIFT},
walk AS (
  SELECT file_id AS f0, name AS n0, file_id AS f, name AS n FROM own
  UNION ALL SELECT w.f0, w.n0, m.file_id, m.name FROM walk w JOIN matched m ON m.previous = w.f AND m.old_name = w.n),
ends AS (SELECT w.* FROM walk w WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.previous = w.f AND m.old_name = w.n)),
shared AS (SELECT f0, n FROM ends GROUP BY 1, 2 HAVING count(*) > 1),
clash AS (SELECT DISTINCT e.f, e.n FROM ends e JOIN shared s ON s.f0 = e.f0 AND s.n = e.n),
named AS (
  SELECT e.f0 AS file_id, e.n0 AS name, e.n || CASE WHEN c.f IS NULL THEN '' ELSE '#' || c.f END AS field
  FROM ends e LEFT JOIN clash c ON c.f = e.f AND c.n = e.n)"""

DISTINCT_MEMBERS = "SELECT DISTINCT delivery_id, refset_id, id FROM refset_member WHERE id IS NOT NULL"

SQL = {
    "p1_deliveries": f"""
WITH {STATUS}
SELECT delivery_id, edition, release_date, n_found, concept_count, complete,
  CASE WHEN complete AND archive_sha256 IS NOT NULL AND first_same <> delivery_id THEN first_same END AS repeats
FROM (SELECT *, first_value(delivery_id) OVER (PARTITION BY edition, archive_sha256, complete ORDER BY release_date, delivered_at, delivery_id) AS first_same FROM status)""",
    "p1_found": f"""
WITH {STATUS},
pairs AS (
  SELECT delivery_id, lag(delivery_id) OVER (PARTITION BY edition ORDER BY release_date, delivered_at, delivery_id) AS previous
  FROM status WHERE complete),
rows_ AS (SELECT DISTINCT delivery_id, scheme, code, referenced_component, module_id, effective_time, active FROM identifier_snapshot),
new AS (SELECT p.delivery_id, r.* EXCLUDE (delivery_id) FROM pairs p JOIN rows_ r ON r.delivery_id = p.delivery_id WHERE p.previous IS NOT NULL),
old AS (SELECT p.delivery_id, r.* EXCLUDE (delivery_id) FROM pairs p JOIN rows_ r ON r.delivery_id = p.previous)
SELECT DISTINCT coalesce(n.delivery_id, o.delivery_id) AS delivery_id, coalesce(n.scheme, o.scheme) AS scheme, coalesce(n.code, o.code) AS code,
  CASE WHEN o.delivery_id IS NULL THEN 'added' WHEN n.delivery_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new n FULL JOIN old o ON n.delivery_id = o.delivery_id AND n.scheme = o.scheme AND n.code = o.code
WHERE o.delivery_id IS NULL OR n.delivery_id IS NULL OR n.referenced_component IS DISTINCT FROM o.referenced_component
  OR n.module_id IS DISTINCT FROM o.module_id OR n.effective_time IS DISTINCT FROM o.effective_time OR n.active IS DISTINCT FROM o.active""",
    "p2_found": f"""
WITH RECURSIVE {LINKS},
ends AS (SELECT child AS c FROM links UNION SELECT parent FROM links),
down AS (
  SELECT parent AS c, parent AS root, 0 AS depth FROM links WHERE parent NOT IN (SELECT child FROM links)
  UNION SELECT l.child, d.root, d.depth + 1 FROM down d JOIN links l ON l.parent = d.c),
loops AS (SELECT l.* FROM links l WHERE l.child NOT IN (SELECT c FROM down)),
walk AS (
  SELECT child AS c, parent AS met FROM loops
  UNION SELECT w.c, l.parent FROM walk w JOIN loops l ON l.child = w.met),
ring AS (SELECT c FROM walk WHERE c = met)
SELECT c AS concept_id, root AS root_id, CAST(depth AS BIGINT) AS node_depth FROM down
UNION ALL
SELECT w.c, min(w.met), CAST(CASE WHEN w.c IN (SELECT c FROM ring) THEN -1 ELSE -2 END AS BIGINT)
FROM walk w WHERE w.met IN (SELECT c FROM ring) GROUP BY w.c""",
    "p2_paths": f"""
WITH RECURSIVE {LINKS},
down AS (
  SELECT DISTINCT parent AS c, parent AS root, 0 AS depth, CAST(parent AS VARCHAR) AS path FROM links WHERE parent NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, d.root, d.depth + 1, d.path || '/' || l.child FROM down d JOIN links l ON l.parent = d.c),
below AS (SELECT CAST(a AS BIGINT) AS c, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS a FROM down) GROUP BY 1)
SELECT c AS concept_id, root AS root_id, CAST(depth AS BIGINT) AS node_depth, n AS n_descendants, path FROM down JOIN below USING (c)""",
    "p2_descendants": f"""
WITH RECURSIVE {LINKS},
tree AS (
  SELECT DISTINCT parent AS c FROM links WHERE parent NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child FROM tree t JOIN links l ON l.parent = t.c),
up AS (
  SELECT l.parent AS a, l.child AS d, 1 AS n FROM links l JOIN tree t ON t.c = l.child
  UNION ALL SELECT l.parent, u.d, u.n + 1 FROM up u JOIN links l ON l.child = u.a)
SELECT a AS concept_id, d AS descendant_id, CAST(n AS BIGINT) AS distance FROM up""",
    "p3_found": f"""
WITH c AS (SELECT delivery_id, refset_id, count(*) AS n FROM ({DISTINCT_MEMBERS}) GROUP BY 1, 2)
SELECT DISTINCT m.delivery_id, m.refset_id FROM member_manifest m LEFT JOIN c USING (delivery_id, refset_id)
WHERE m.n_rows IS NOT NULL AND m.n_rows <> coalesce(c.n, 0)""",
    "p3_members": f"SELECT delivery_id, refset_id, count(*) AS n_members FROM ({DISTINCT_MEMBERS}) GROUP BY 1, 2",
    "p3_refsets": "SELECT refset_id, count(DISTINCT id) AS n_members FROM refset_member GROUP BY 1",
    "p4_found": f"""
WITH {DRIFT}
SELECT file_id, 'repaired' AS change_kind, std AS field_name, written AS old_name
FROM (SELECT *, ['id', 'effectiveTime', 'active', 'moduleId', 'refsetId', 'referencedComponentId'][pos] AS std FROM cells WHERE pos <= 6) WHERE written <> std
UNION ALL SELECT file_id, 'renamed', name, old_name FROM renamed
UNION ALL SELECT file_id, 'added', name, '' FROM only_new n WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = n.file_id AND r.name = n.name)
UNION ALL SELECT file_id, 'removed', name, '' FROM only_old o WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = o.file_id AND r.old_name = o.name)
UNION ALL SELECT m.file_id, 'retyped', m.name, '' FROM matched m JOIN types a ON a.file_id = m.file_id AND a.name = m.name
  JOIN types b ON b.file_id = m.previous AND b.name = m.old_name WHERE a.type <> b.type""",
    "p4_rows": f"""
WITH RECURSIVE {LINEAGE},
lines AS (
  SELECT file_id, line_no, string_split(line, chr(9)) AS c FROM refset_raw_row
  WHERE trim(line, chr(9) || chr(10) || chr(13) || ' ') <> ''),
told AS (
  SELECT file_id, line_no, array_to_string(list_sort(list(field || '=' || coalesce(trim(c[pos], chr(10) || chr(13) || ' '), ''))), chr(9)) AS fields
  FROM lines JOIN named USING (file_id) JOIN own USING (file_id, name) GROUP BY 1, 2)
SELECT file_id, line_no, coalesce(trim(c[1], chr(10) || chr(13) || ' '), '') AS id, coalesce(trim(c[2], chr(10) || chr(13) || ' '), '') AS effectiveTime,
  coalesce(trim(c[3], chr(10) || chr(13) || ' '), '') AS active, coalesce(trim(c[4], chr(10) || chr(13) || ' '), '') AS moduleId,
  coalesce(trim(c[5], chr(10) || chr(13) || ' '), '') AS refsetId, coalesce(trim(c[6], chr(10) || chr(13) || ' '), '') AS referencedComponentId,
  coalesce(fields, '') AS fields
FROM lines LEFT JOIN told USING (file_id, line_no)""",
    "p4_fields": f"""
WITH RECURSIVE {LINEAGE},
kinds AS (
  SELECT f.refset_id, n.field, count(DISTINCT n.file_id) AS n_files, coalesce(list_sort(list(DISTINCT t.type) FILTER (t.type IS NOT NULL)), []) AS k
  FROM named n JOIN refset_file f USING (file_id) LEFT JOIN types t USING (file_id, name) GROUP BY 1, 2)
SELECT refset_id, field, CASE WHEN len(k) = 1 THEN k[1] WHEN k = ['decimal', 'integer'] THEN 'decimal' ELSE 'text' END AS type, n_files FROM kinds""",
    "p4_notes": r"""
WITH cells AS (
  SELECT file_id, pos, CASE WHEN pos = 1 THEN regexp_replace(written, '^' || chr(65279), '') ELSE written END AS written
  FROM (SELECT file_id, unnest(header_columns) AS written, generate_subscripts(header_columns, 1) AS pos FROM refset_file)),
own AS (SELECT file_id, list_sort(list(DISTINCT lower(regexp_replace(written, '\s', '', 'g')))) AS own FROM cells WHERE pos > 6 GROUP BY 1),
fixed AS (SELECT DISTINCT file_id FROM cells WHERE pos <= 6 AND written <> ['id', 'effectiveTime', 'active', 'moduleId', 'refsetId', 'referencedComponentId'][pos])
SELECT file_id, refset_id, CASE WHEN field_list IS NULL THEN 'absent'
  WHEN list_sort(list_distinct(list_transform(field_list, lambda x: lower(regexp_replace(x, '\s', '', 'g'))))) IS DISTINCT FROM own THEN 'wrong' ELSE 'right' END AS field_list_state,
  file_id IN (SELECT file_id FROM fixed) AS repaired, header_repair IS NOT NULL AS repair_noted
FROM refset_file LEFT JOIN own USING (file_id)""",
    "p5_found": f"""
WITH {ORPHANS},
counted AS (SELECT delivery_id, count(DISTINCT record_key) AS n FROM orphans WHERE in_table = 'historical_association' AND reason IN ('missing', 'late') GROUP BY 1)
SELECT in_table, CAST(as_of // 100 AS BIGINT) AS period_ym, delivery_id, record_key, field_name, reason FROM orphans
UNION
SELECT 'edition_manifest', CAST(release_date // 100 AS BIGINT), delivery_id, edition, 'history_skipped', 'miscounted'
FROM edition_manifest LEFT JOIN counted USING (delivery_id) WHERE history_skipped IS NOT NULL AND history_skipped <> coalesce(n, 0)""",
    "p5_periods": f"""
WITH {ORPHANS}
SELECT in_table, field_name, CAST(as_of // 100 AS BIGINT) AS period_ym, reason, count(*) AS n_references, count(DISTINCT key) AS n_keys FROM orphans GROUP BY ALL""",
}
