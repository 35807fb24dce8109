"""Queries of the general problems: snapshots (p1), timestamps (p3), references (p4)."""

from __future__ import annotations

from ..operators import references, snapshots, timestamps

QUERIES = {
    "p1_found": snapshots.p1_found,
    "p1_bilanz": snapshots.p1_bilanz,
    "p3_found": timestamps.p3_found,
    "p3_formen": timestamps.p3_formen,
    "p4_found": references.p4_found,
    "p4_je_monat": references.p4_je_monat,
}

# German month names by number.
_MONATE = "(VALUES ('januar',1),('februar',2),('märz',3),('april',4),('mai',5),('juni',6),('juli',7),('august',8),('september',9),('oktober',10),('november',11),('dezember',12)) AS mo(name, nr)"

_P1 = rf"""
WITH v AS (
  SELECT lieferung, regelwerk, regexp_replace(id, '^\s+|\s+$', '', 'g') AS id, eingang, zeile,
    CASE WHEN hash IS NULL OR regexp_replace(lower(hash), '\s', '', 'g') IN ('', '-', '--', 'null', 'n/a') THEN NULL
         ELSE regexp_replace(regexp_replace(lower(hash), '\s', '', 'g'), '^sha256:', '') END AS h,
    lower(trim(regexp_replace(coalesce(gueltig_bis, ''), '\s+', ' ', 'g'))) AS g
  FROM fassungen WHERE lieferung IS NOT NULL
), t AS (
  SELECT v.*, CASE WHEN g IN ('', '-', '--', 'null', 'n/a') THEN NULL
    WHEN regexp_matches(g, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN substr(g, 1, 10)
    WHEN regexp_matches(g, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}$') THEN split_part(g, '.', 3) || '-' || lpad(split_part(g, '.', 2), 2, '0') || '-' || lpad(split_part(g, '.', 1), 2, '0')
    WHEN mo.nr IS NOT NULL THEN regexp_extract(g, '\d{{4}}$') || '-' || lpad(CAST(mo.nr AS VARCHAR), 2, '0') || '-' || lpad(split_part(g, '.', 1), 2, '0')
    ELSE g END AS tag
  FROM v LEFT JOIN {_MONATE} ON regexp_extract(g, '^\d{{1,2}}\. (\S+) \d{{4}}$', 1) = mo.name
), c AS (
  SELECT lieferung, regelwerk, id, h, tag FROM t
  QUALIFY row_number() OVER (PARTITION BY lieferung, regelwerk, id ORDER BY eingang DESC NULLS LAST, zeile DESC) = 1
), n AS (SELECT * FROM c WHERE lieferung > (SELECT min(lieferung) FROM c)),
a AS (SELECT lieferung + 1 AS lieferung, regelwerk, id, h, tag FROM c WHERE lieferung < (SELECT max(lieferung) FROM c)),
found AS (
  SELECT coalesce(n.lieferung, a.lieferung) AS lieferung, coalesce(n.regelwerk, a.regelwerk) AS regelwerk, coalesce(n.id, a.id) AS id,
    CASE WHEN a.lieferung IS NULL THEN 'neu' WHEN n.lieferung IS NULL THEN 'entfallen' ELSE 'geaendert' END AS art
  FROM n FULL JOIN a ON n.lieferung = a.lieferung AND n.regelwerk IS NOT DISTINCT FROM a.regelwerk AND n.id IS NOT DISTINCT FROM a.id
  WHERE a.lieferung IS NULL OR n.lieferung IS NULL OR n.h IS DISTINCT FROM a.h OR n.tag IS DISTINCT FROM a.tag
)
"""

_P4 = r"""
WITH k AS (SELECT regelwerk AS rw, lower(regexp_replace(pfad, '^[\s/]+|[\s/]+$', '', 'g')) AS pfad, erfasst, geloescht FROM knoten),
r0 AS (
  SELECT 'verweise' AS tabelle, CAST(verweis_nr AS VARCHAR) AS schluessel, 'von' AS seite, erfasst AS t, von.rw AS rw, von.pfad AS p FROM verweise
  UNION ALL SELECT 'verweise', CAST(verweis_nr AS VARCHAR), 'nach', erfasst, nach.rw, nach.pfad FROM verweise
  UNION ALL
  SELECT 'lektionen', id || '/' || a || '/' || s, 'fundstelle', CAST(stand AS TIMESTAMP), f.rw, f.pfad FROM (
    SELECT id, stand, a, s, fs[s] AS f FROM (
      SELECT id, stand, a, fs, unnest(range(1, len(fs) + 1)) AS s FROM (
        SELECT id, stand, a, abschnitte[a].fundstellen AS fs FROM (
          SELECT id, stand, abschnitte, unnest(range(1, len(abschnitte) + 1)) AS a FROM lektionen)) WHERE fs IS NOT NULL))
), r AS (SELECT DISTINCT tabelle, schluessel, seite, t, rw, lower(regexp_replace(p, '^[\s/]+|[\s/]+$', '', 'g')) AS pfad FROM r0),
j AS (
  SELECT r.tabelle, r.schluessel, r.seite, r.t, r.rw, r.pfad, count(k.rw) AS n,
    coalesce(bool_or(k.erfasst <= r.t AND (k.geloescht IS NULL OR r.t < k.geloescht)), false) AS gilt, coalesce(bool_or(k.geloescht <= r.t), false) AS vorbei
  FROM r LEFT JOIN k ON k.rw = r.rw AND k.pfad = r.pfad WHERE r.pfad IS NOT NULL AND r.t IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT r.tabelle, r.schluessel, r.seite, r.t, r.rw, r.pfad, count(k.rw) AS n,
    coalesce(bool_or(k.erfasst <= r.t AND (k.geloescht IS NULL OR r.t < k.geloescht)), false), coalesce(bool_or(k.geloescht <= r.t), false)
  FROM r LEFT JOIN k ON k.rw = r.rw WHERE r.pfad IS NULL AND r.rw IS NOT NULL AND r.t IS NOT NULL GROUP BY ALL
), found AS (
  SELECT DISTINCT tabelle, schluessel, seite, strftime(t, '%Y-%m') AS periode,
    CASE WHEN n = 0 THEN 'fehlt' WHEN vorbei THEN 'geloescht' ELSE 'spaeter' END AS grund
  FROM j WHERE NOT gilt
)
"""

SQL = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_bilanz": _P1 + """SELECT lieferung, count(*) FILTER (art = 'neu') AS neu, count(*) FILTER (art = 'entfallen') AS entfallen,
        count(*) FILTER (art = 'geaendert') AS geaendert FROM found GROUP BY lieferung""",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_je_monat": _P4 + "SELECT tabelle, periode, grund, count(*) AS anzahl FROM found GROUP BY tabelle, periode, grund",
}
