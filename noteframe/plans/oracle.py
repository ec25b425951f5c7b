"""SQL that computes the query answers straight from the relational tables.

No note is rendered or parsed here: the SQL knows which notes, links and tasks
the tables stand for and counts them relationally.
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-01'"


def _guid(text: str) -> str:
    h = f"md5({text})"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "(" + "||'-'||".join(f"substr({h},{a},{n})" for a, n in cuts) + ")"


_CTE = {
    "cust": """
        SELECT c_custkey AS k, replace(c_name,'#',' ') AS n, c_nationkey AS nat, lower(c_mktsegment) AS seg,
          CASE WHEN c_custkey%10=0 THEN 'Customers/'||replace(c_name,'#',' ')||'.md'
               ELSE 'Customers/'||replace(c_name,'#',' ')||'/'||replace(c_name,'#',' ')||'.md' END AS path,
          replace(c_name,'#',' ')||CASE WHEN c_custkey%9<>0 THEN ' Account' ELSE '' END AS title,
          CASE c_custkey%3 WHEN 0 THEN 'active' WHEN 1 THEN 'at-risk' ELSE 'closed' END AS status,
          CASE WHEN c_custkey%7>1 THEN (100000+c_custkey)::VARCHAR END AS tpid,
          CASE WHEN c_custkey%3=1 THEN '2001-07-'||lpad((1+c_custkey%28)::VARCHAR,2,'0') END AS validated,
          TIMESTAMP '2001-07-01' + to_days((c_custkey%60)::INTEGER) AS mtime
        FROM customer""",
    "supp": """
        SELECT s_suppkey AS sk, replace(s_name,'#',' ') AS sn, s_nationkey AS snat,
          'People/'||replace(s_name,'#',' ')||'.md' AS path,
          CASE WHEN s_suppkey%6=0 THEN 'Person '||s_suppkey ELSE replace(s_name,'#',' ') END AS title,
          CASE WHEN s_suppkey%2=0 THEN 'internal' ELSE 'partner' END AS kind
        FROM supplier""",
    "works": "SELECT s.sk, s.sn, s.path, c.k, c.n, s.sk%7<>3 AS listed FROM supp s JOIN cust c ON c.k//15 = s.sk",
    "team": """
        SELECT c.k, c.n AS customer, c.path, v.i, s.sn AS name, s.path AS person,
          CASE v.i WHEN 0 THEN 'Architect' WHEN 1 THEN 'Lead' WHEN 2 THEN 'Owner' END AS role,
          CASE WHEN c.k%16=1 THEN 'Key Stakeholders' ELSE 'Team' END AS head
        FROM cust c CROSS JOIN (VALUES (0),(1),(2),(3)) v(i) JOIN supp s ON s.sk = c.k//15 + v.i
        WHERE c.k%8<>0""",
    "opp_line": f"""
        SELECT c.k, c.n AS customer, c.path, v.i, p_name||' '||p_partkey AS name,
          CASE WHEN (c.k+v.i)%3<>0 THEN {_guid("'o-'||c.k||'-'||v.i")} END AS guid,
          row_number() OVER (PARTITION BY c.k ORDER BY v.i) - 1 AS ordinal
        FROM cust c CROSS JOIN (VALUES (0),(1),(2)) v(i) JOIN part ON p_partkey = c.k + v.i
        WHERE c.k%4<>3""",
    "opp_note": f"""
        SELECT c.k, c.n AS customer, 'Customers/'||c.n||'/opportunities/Deal '||c.k||'-'||v.i||'.md' AS path,
          p_name||' deal '||c.k||'-'||v.i AS name,
          CASE WHEN v.i=0 OR c.k%8=1 THEN {_guid("'d-'||c.k||'-'||v.i")} END AS guid,
          CASE WHEN v.i=0 THEN 'open' ELSE 'won' END AS status, 'S'||c.k%5 AS stage, 'Owner '||c.nat AS owner,
          'Play '||v.i AS salesplay, CASE WHEN v.i=0 THEN '2001-06-01' END AS last_validated,
          'deal '||c.k||'-'||v.i AS stem
        FROM cust c CROSS JOIN (VALUES (0),(1)) v(i) JOIN part ON p_partkey = c.k + v.i
        WHERE c.k%10<>0 AND c.k%4=1""",
    "opp": """
        SELECT customer, path, 0 AS ordinal, name, guid, status, stage, owner, salesplay, last_validated FROM opp_note
        UNION ALL
        SELECT customer, path, ordinal, name, guid, NULL, NULL, NULL, NULL, NULL FROM opp_line
        WHERE customer NOT IN (SELECT customer FROM opp_note)""",
    "ms_line": f"""
        SELECT k, n AS customer, path, 0 AS ordinal, 'Stage '||k AS name,
          CASE WHEN k%4=0 THEN {_guid("'s-'||k")} END AS id, (k*2)::VARCHAR AS number FROM cust
        UNION ALL
        SELECT k, n, path, 1, CASE WHEN k%3=0 THEN 'Kickoff planned' ELSE 'Milestone #'||(k*2+1)||' go-live' END,
          NULL, CASE WHEN k%3<>0 THEN (k*2+1)::VARCHAR END FROM cust""",
    "ms_note": f"""
        SELECT k, n AS customer, 'Customers/'||n||'/milestones/M '||k||'.md' AS path, 'Milestone '||k AS name,
          CASE WHEN k%8=2 THEN {_guid("'m-'||k")} END AS id, CASE WHEN k%8<>2 THEN k::VARCHAR END AS number,
          'm '||k AS stem
        FROM cust WHERE k%10<>0 AND k%4=2""",
    "ms": """
        SELECT customer, path, 0 AS ordinal, name, id, number, 'on-track' AS status, '2001-09-01' AS milestonedate,
          NULL::VARCHAR AS owner, 'Deal '||k||'-0' AS opportunity FROM ms_note
        UNION ALL
        SELECT customer, path, ordinal, name, id, number, NULL, NULL, NULL, NULL FROM ms_line
        WHERE customer NOT IN (SELECT customer FROM ms_note)""",
    "quarters": """
        SELECT o_custkey AS k, year(o_orderdate)||'-Q'||quarter(o_orderdate) AS q,
          max(strftime(o_orderdate,'%Y-%m-%d')) AS d, count(*) AS cnt,
          arg_max(o_orderkey, strftime(o_orderdate,'%Y-%m-%d')||lpad(o_orderkey::VARCHAR,20,'0')) AS last_order
        FROM orders GROUP BY 1, 2""",
    "ins_note": """
        SELECT c.k, c.n AS customer, 'Customers/'||c.n||'/insights/'||q||'.md' AS path, q, d, cnt
        FROM quarters JOIN cust c USING (k) WHERE c.k%10<>0 AND c.k%5=1""",
    "ins_line": """
        SELECT c.k, c.n AS customer, c.path, q, d, cnt, c.k%11=0 AS colon,
          row_number() OVER (PARTITION BY c.k ORDER BY q) - 1 AS ordinal
        FROM quarters JOIN cust c USING (k) WHERE c.k%5<>2""",
    "meet": """
        SELECT o_orderkey AS okey, o_custkey AS ck, c.n, c.path AS cpath, strftime(o_orderdate,'%Y-%m-%d') AS day,
          'Meetings/'||strftime(o_orderdate,'%Y-%m-%d')||'-'||o_orderkey||'.md' AS path,
          'Order '||o_orderkey||' review' AS title, lower(o_orderpriority) AS prio, o_orderstatus AS status,
          CASE WHEN o_custkey%50<>0 THEN c.n END AS customer, o_totalprice AS total,
          CASE WHEN o_orderkey%40=11 THEN 'soon' WHEN o_orderkey%40<>9 THEN strftime(o_orderdate,'%Y-%m-%d') END AS date,
          o_orderdate + INTERVAL 9 HOURS AS mtime
        FROM orders JOIN cust c ON c.k = o_custkey""",
    "li": """
        SELECT m.okey, m.path, l_linestatus='F' AS done, s.sn, s.sk, s.path AS person,
          'Ship part '||l_partkey||' line '||l_linenumber||' @Supplier_'||l_suppkey AS text,
          row_number() OVER (PARTITION BY m.okey ORDER BY l_linestatus='F',
            'Ship part '||l_partkey||' line '||l_linenumber||' @Supplier_'||l_suppkey) - 1 AS ordinal
        FROM lineitem JOIN meet m ON m.okey = l_orderkey JOIN supp s ON s.sk = l_suppkey""",
    "notes": """
        SELECT path, title, lower(n) AS stem,
          CASE WHEN k%13=0 THEN ['customer','nation-'||nat] ELSE ['customer', seg, 'nation-'||nat] END AS tags FROM cust
        UNION ALL SELECT path, title, lower(sn), ['person', kind] FROM supp
        UNION ALL SELECT path, title, day||'-'||okey, ['meeting', prio] FROM meet
        UNION ALL SELECT path, name, stem, ['opportunity'] FROM opp_note
        UNION ALL SELECT path, name, stem, ['milestone'] FROM ms_note
        UNION ALL SELECT path, q, lower(q), [] FROM ins_note""",
    "titles": """
        SELECT key, max(path) AS path FROM (
          SELECT lower(title) AS key, path FROM notes UNION ALL SELECT stem, path FROM notes) GROUP BY key""",
    "links": """
        SELECT DISTINCT src, target, dst FROM (
          SELECT path AS src, name AS target, person AS dst FROM team WHERE i=0
          UNION ALL SELECT path, sn, person FROM li
          UNION ALL SELECT path, CASE WHEN okey%3=2 THEN replace(cpath,'.md','') ELSE n END, cpath FROM meet WHERE ck%50<>0
          UNION ALL SELECT path, min(n), arg_min(cp, n) FROM
            (SELECT w.path, w.n, c.path AS cp FROM works w JOIN cust c ON c.k=w.k) GROUP BY path)""",
    "edge": "SELECT DISTINCT src, dst FROM links",
    "tasks": """
        SELECT path, ordinal, done, text, 'Supplier_'||sk AS assignee FROM li
        UNION ALL
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY place) - 1, done, text, assignee FROM (
          SELECT path, 0 AS place, true AS done, name||CASE WHEN guid IS NULL THEN '' ELSE ' ('||guid||')' END AS text,
            NULL AS assignee FROM opp_line WHERE i=2
          UNION ALL SELECT path, 1, false, 'Send summary @team_'||nat, 'team_'||nat FROM cust WHERE k%3=0
          UNION ALL SELECT path, 2, true, 'Archive notes', NULL FROM cust WHERE k%3=0)""",
    "fm_meet": f"""
        SELECT c.n AS customer, 'Meetings/'||d||'-'||last_order||'.md' AS path, d||'-'||last_order AS title, d AS date
        FROM quarters JOIN cust c USING (k) WHERE c.k%6=1 AND d::DATE >= {AS_OF} - 90""",
    "recent": f"""
        SELECT c.n AS customer, m.path, m.title, m.date FROM meet m JOIN cust c ON c.n = m.customer
        WHERE m.date IS NULL OR TRY_CAST(m.date AS DATE) >= {AS_OF} - 90""",
    "met": """
        SELECT * FROM fm_meet UNION ALL
        SELECT * FROM recent WHERE customer NOT IN (SELECT customer FROM fm_meet)""",
    "stale": f"""
        SELECT customer, ordinal, cnt||' orders' AS text, d AS date, ({AS_OF} - d::DATE)::INTEGER AS age_days
        FROM ins_line WHERE NOT colon AND ({AS_OF} - d::DATE) > 30""",
    "orphan": """
        SELECT path FROM meet WHERE customer IS NULL""",
    "near_items": """
        SELECT n AS customer, path FROM cust
        UNION SELECT c.n, e.dst FROM cust c JOIN edge e ON e.src = c.path
        UNION SELECT c.n, e.src FROM cust c JOIN edge e ON e.dst = c.path
        UNION SELECT customer, path FROM recent""",
    "open_item": """
        SELECT a.customer, t.path, t.ordinal, t.text, t.assignee
        FROM near_items a JOIN tasks t ON t.path = a.path WHERE NOT t.done""",
    "fresh": """
        SELECT c.n AS customer, c.path, c.mtime AS last_modified, c.validated AS last_validated,
          coalesce(s.n, 0) AS stale_insights, coalesce(o.n, 0) AS opportunities, coalesce(o.g, 0) AS with_guid,
          coalesce(m.n, 0) AS milestones, coalesce(m.g, 0) AS with_id, s.age AS first_stale_days,
          t.customer IS NOT NULL AS has_team, c.k%2=0 AS has_connect_hooks
        FROM cust c
        LEFT JOIN (SELECT customer, count(*) AS n, arg_min(age_days, ordinal) AS age FROM stale GROUP BY 1) s ON s.customer = c.n
        LEFT JOIN (SELECT customer, count(*) AS n, count(guid) AS g FROM opp GROUP BY 1) o ON o.customer = c.n
        LEFT JOIN (SELECT customer, count(*) AS n, count(coalesce(id, number)) AS g FROM ms GROUP BY 1) m ON m.customer = c.n
        LEFT JOIN (SELECT DISTINCT customer FROM team WHERE head='Team') t ON t.customer = c.n""",
    "issue": """
        SELECT customer, 'stale_insights' AS kind, stale_insights AS count, first_stale_days::BIGINT AS age_days FROM fresh WHERE stale_insights > 0
        UNION ALL SELECT customer, 'missing_guid', opportunities - with_guid, NULL FROM fresh WHERE opportunities > with_guid
        UNION ALL SELECT customer, 'missing_id', milestones - with_id, NULL FROM fresh WHERE milestones > with_id
        UNION ALL SELECT customer, 'no_team', 1, NULL FROM fresh WHERE NOT has_team
        UNION ALL SELECT NULL, 'orphaned_meetings', count(*), NULL FROM orphan HAVING count(*) > 0""",
    "ids": """
        SELECT n AS customer, 'tpid' AS kind, coalesce(tpid, CASE WHEN k%4=1 THEN '9'||k END) AS value FROM cust
          WHERE coalesce(tpid, CASE WHEN k%4=1 THEN '9'||k END) IS NOT NULL
        UNION ALL SELECT n, 'accountid', CASE WHEN k%4=0 THEN 'ACC-' ELSE 'MSX-' END||k FROM cust WHERE k%4 IN (0,1)
        UNION ALL SELECT customer, 'opportunity_guid', guid FROM opp WHERE guid IS NOT NULL
        UNION ALL SELECT customer, 'milestone_id', id FROM ms WHERE id IS NOT NULL
        UNION ALL SELECT customer, 'milestone_number', number FROM ms WHERE number IS NOT NULL
        UNION ALL SELECT customer, 'team_member', name FROM team""",
    "insight": """
        SELECT customer, source, true AS partitioned, ordinal, entry FROM (
          SELECT customer, path AS source, dense_rank() OVER (PARTITION BY customer ORDER BY path DESC) AS r, ordinal, entry
          FROM (SELECT customer, path, 0 AS ordinal, d||' '||cnt||' orders' AS entry FROM ins_note
                UNION ALL SELECT customer, path, 1, 'Closed '||q FROM ins_note)) WHERE r <= 2
        UNION ALL
        SELECT customer, path, false, ordinal, entry FROM (
          SELECT customer, path, ordinal, d||CASE WHEN colon THEN ': ' ELSE ' ' END||cnt||' orders' AS entry FROM ins_line
          UNION ALL SELECT c.n, c.path, (SELECT count(*) FROM quarters x WHERE x.k=c.k), 'Reviewed quarterly.' FROM cust c WHERE k%5<>2)
        WHERE customer NOT IN (SELECT customer FROM ins_note)""",
    "person_map": """
        SELECT key, arg_max(customers, path) AS customers FROM (
          SELECT lower(s.title) AS key, s.path, string_agg(w.n, ',' ORDER BY w.n) AS customers
          FROM supp s JOIN works w ON w.sk=s.sk AND w.listed GROUP BY 1, 2) GROUP BY key""",
}


def with_prelude(body: str) -> str:
    """The query with the named tables it uses, in order."""
    import re

    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name, text in _CTE.items():
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(text)

    visit(body)
    heads = ",\n".join(f"{name} AS ({text})" for name, text in _CTE.items() if name in needed)
    return f"WITH {heads}\n{body}" if heads else body
