"""DuckDB SQL of the registered queries, over the driver's tables.

Every statement is a list of common tables and a body. ``TABLES`` holds the engine's tables derived from the driver's;
only those that a body needs, and what they need, are put before it.
"""

from __future__ import annotations

import re

JAN = "DATE '1998-01-01' AND DATE '1998-01-31'"
FEB = "DATE '1998-02-01' AND DATE '1998-02-28'"
LONG = "DATE '1995-12-20' AND DATE '1997-01-15'"
EARLIER = "DATE '1995-03-01' AND DATE '1996-02-10'"

TABLES = {
    "articles": """SELECT 'enwiki' AS wiki, p_partkey + 1000000 AS page_id, p_partkey AS qid,
        concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR)) AS page_title FROM part
      UNION ALL SELECT 'frwiki', p_partkey + 1500000, p_partkey,
        concat('fr_', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_partkey % 2 = 0""",
    "categories": """SELECT 'enwiki' AS wiki, s_suppkey + 2000000 AS page_id, s_suppkey AS qid, replace(s_name, '#', '_') AS page_title FROM supplier
      UNION ALL SELECT 'frwiki', s_suppkey + 2500000, s_suppkey, concat('fr_', replace(s_name, '#', '_')) FROM supplier WHERE s_suppkey % 3 <> 0""",
    "category_graph": """SELECT s.s_suppkey AS parent_qid, (2 * s.s_suppkey + k.k) % n.n AS child_qid
      FROM supplier AS s CROSS JOIN (SELECT count(*) AS n FROM supplier) AS n CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS k""",
    "article_category": "SELECT DISTINCT l_partkey AS article_qid, l_suppkey AS category_qid FROM lineitem WHERE l_linenumber = 1",
    "dump": """SELECT CASE WHEN l_orderkey % 4 = 0 THEN 'fr.wikipedia' ELSE 'en.wikipedia' END AS domain,
        CASE WHEN l_orderkey % 4 = 0 THEN l_partkey + 1500000 ELSE l_partkey + 1000000 END AS page_id,
        CASE l_returnflag WHEN 'A' THEN 'desktop' WHEN 'N' THEN 'mobile-web' ELSE 'mobile-app' END AS access_method,
        CAST(l_quantity AS BIGINT) AS daily_views, CAST(l_shipdate AS DATE) AS date FROM lineitem""",
    "pageviews": """SELECT replace(domain, '.wikipedia', 'wiki') AS wiki, page_id,
        CASE access_method WHEN 'desktop' THEN 0 WHEN 'mobile-web' THEN 1 ELSE -1 END AS access_method, daily_views, date FROM dump""",
    "all_daily": """SELECT a.wiki, p.date, a.qid AS article_qid, CAST(sum(p.daily_views) AS BIGINT) AS views
      FROM pageviews AS p JOIN articles AS a ON a.wiki = p.wiki AND a.page_id = p.page_id GROUP BY a.wiki, p.date, a.qid""",
    "daily": "SELECT * FROM all_daily WHERE wiki = 'enwiki'",
    "january": f"SELECT article_qid, date, views FROM daily WHERE date BETWEEN {JAN}",
    "own_articles": "SELECT * FROM articles WHERE wiki = 'enwiki'",
    "own_categories": "SELECT * FROM categories WHERE wiki = 'enwiki'",
    "fr_articles": "SELECT * FROM articles WHERE wiki = 'frwiki'",
    "fr_categories": "SELECT * FROM categories WHERE wiki = 'frwiki'",
    "edges": """SELECT parent_qid, child_qid FROM category_graph
      WHERE parent_qid IN (SELECT qid FROM own_categories) AND child_qid IN (SELECT qid FROM own_categories)""",
    "pairs": """SELECT DISTINCT article_qid, category_qid FROM article_category
      WHERE article_qid IN (SELECT qid FROM own_articles) AND category_qid IN (SELECT qid FROM own_categories)""",
    "roots": "SELECT qid AS root FROM own_categories",
    # The graph doubles ids, so that 16 levels reach all there is at every size tested.
    "walk": """SELECT root, root AS node, 0 AS depth FROM roots
      UNION SELECT w.root, e.child_qid, w.depth + 1 FROM walk AS w JOIN edges AS e ON e.parent_qid = w.node WHERE w.depth < 16""",
    "reach": "SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node",
    "mask0": "SELECT category_qid AS root, article_qid FROM pairs",
    "mask1": "SELECT DISTINCT r.root, p.article_qid FROM reach AS r JOIN pairs AS p ON p.category_qid = r.node WHERE r.depth <= 1",
    "mask2": "SELECT DISTINCT r.root, p.article_qid FROM reach AS r JOIN pairs AS p ON p.category_qid = r.node WHERE r.depth <= 2",
    "days": "SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-01-31', INTERVAL 1 DAY)) AS DATE) AS date",
    "by_article": "SELECT article_qid, CAST(sum(views) AS BIGINT) AS views FROM january GROUP BY article_qid",
    "category_totals": """SELECT p.category_qid, CAST(sum(a.views) AS BIGINT) AS total_views
      FROM by_article AS a JOIN pairs AS p USING (article_qid) GROUP BY p.category_qid""",
    "best": "SELECT * FROM (SELECT * FROM category_totals ORDER BY total_views DESC, category_qid LIMIT 10) WHERE total_views > 0",
    "nested": """SELECT * FROM (SELECT b.category_qid, b.total_views,
        row_number() OVER (PARTITION BY b.category_qid ORDER BY a.views DESC, a.article_qid) AS rank, a.article_qid, a.views AS article_views
      FROM best AS b JOIN pairs AS p USING (category_qid) JOIN by_article AS a ON a.article_qid = p.article_qid AND a.views > 0) WHERE rank <= 10""",
    "fr_titles": "SELECT qid, min_by(page_title, page_id) AS title FROM fr_articles GROUP BY qid",
    "periods": f"""SELECT article_qid, sum(CASE WHEN date BETWEEN {JAN} THEN views ELSE 0 END) AS b,
        sum(CASE WHEN date BETWEEN {FEB} THEN views ELSE 0 END) AS i FROM daily WHERE date BETWEEN {JAN} OR date BETWEEN {FEB} GROUP BY article_qid""",
    "direct": "SELECT p.category_qid AS qid, sum(a.b) AS b, sum(a.i) AS i FROM periods AS a JOIN pairs AS p USING (article_qid) GROUP BY ALL",
    "deep": "SELECT m.root AS qid, sum(a.b) AS db, sum(a.i) AS di FROM periods AS a JOIN mask1 AS m USING (article_qid) GROUP BY ALL",
    "chosen": """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY b DESC, qid) <= 20 AND b > 0 AS in_b,
        row_number() OVER (ORDER BY i DESC, qid) <= 20 AND i > 0 AS in_i FROM direct) WHERE in_b OR in_i""",
    "long_totals": f"SELECT article_qid, CAST(sum(views) AS BIGINT) AS views FROM daily WHERE date BETWEEN {LONG} GROUP BY article_qid",
    "long_periods": f"""SELECT article_qid, sum(CASE WHEN date BETWEEN {EARLIER} THEN views ELSE 0 END) AS b,
        sum(CASE WHEN date BETWEEN {LONG} THEN views ELSE 0 END) AS i FROM daily WHERE date BETWEEN {EARLIER} OR date BETWEEN {LONG} GROUP BY article_qid""",
    "long_direct": "SELECT p.category_qid AS qid, sum(a.b) AS b, sum(a.i) AS i FROM long_periods AS a JOIN pairs AS p USING (article_qid) GROUP BY ALL",
    "long_deep": "SELECT m.root AS qid, sum(a.b) AS b, sum(a.i) AS i FROM long_periods AS a JOIN mask1 AS m USING (article_qid) GROUP BY ALL",
    "long_chosen": """SELECT qid FROM (SELECT *, row_number() OVER (ORDER BY b DESC, qid) <= 20 AND b > 0 AS in_b,
        row_number() OVER (ORDER BY i DESC, qid) <= 20 AND i > 0 AS in_i FROM long_direct) WHERE in_b OR in_i""",
    "letters": "SELECT CAST(unnest(range(8)) AS BIGINT) AS place, unnest(string_split('a,e,i,n,o,r,s,t', ',')) AS letter",
    "vectors": "SELECT vec_id AS qid, concat('cat_', CAST(vec_id AS VARCHAR)) AS page_title, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "asked": "SELECT qid AS query_id, v AS q FROM vectors WHERE qid % 20 = 0",
    "scores": "SELECT a.query_id, o.qid, o.page_title, round(list_cosine_similarity(a.q, o.v), 6) AS score FROM asked AS a CROSS JOIN vectors AS o",
    "ranks": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, qid) AS rank FROM scores WHERE score IS NOT NULL",
    "found": "SELECT query_id, qid, page_title, score AS match_score FROM ranks WHERE rank <= 1000 AND score >= 0.6",
    "page": """SELECT page_id, 0 AS page_namespace, page_title, CAST(qid % 11 = 0 AS INT) AS page_is_redirect, CAST(qid % 13 = 0 AS INT) AS page_is_new, qid FROM own_articles
      UNION ALL SELECT page_id, 14, page_title, 0, 0, qid FROM own_categories""",
    "x_articles": "SELECT page_id, qid, page_title FROM page WHERE page_namespace = 0 AND page_is_redirect = 0 AND page_is_new = 0 AND qid % 17 <> 0",
    "x_categories": "SELECT page_id, qid, page_title FROM page WHERE page_namespace = 14 AND qid % 9 <> 0",
}


def _change(b: str, i: str) -> str:
    return f"""CAST({b} AS BIGINT) AS baseline_views, CAST({i} AS BIGINT) AS impact_views,
      round(CASE WHEN {b} = 0 THEN CASE WHEN {i} > 0 THEN 100.0 ELSE 0.0 END ELSE CAST({i} - {b} AS DOUBLE) / {b} * 100.0 END, 6) AS delta_percentage,
      CAST({i} - {b} AS BIGINT) AS absolute_delta"""


def _trend(mask: str, key: str = "root") -> str:
    """Daily sums of a mask, every day of January."""
    return f"""SELECT k.root AS {key}, d.date, CAST(coalesce(s.views, 0) AS BIGINT) AS views
      FROM (SELECT DISTINCT root FROM {mask}) AS k CROSS JOIN days AS d LEFT JOIN (
        SELECT m.root, j.date, sum(j.views) AS views FROM january AS j JOIN {mask} AS m USING (article_qid) GROUP BY ALL) AS s
      ON s.root = k.root AND s.date = d.date"""


_SERIES = """SELECT d.date, CAST(coalesce(s.views, 0) AS BIGINT) AS views FROM days AS d LEFT JOIN
  (SELECT j.date, sum(j.views) AS views FROM january AS j JOIN {mask} AS m USING (article_qid) GROUP BY ALL) AS s ON s.date = d.date"""
_TOP_OF = """SELECT *, CAST(sum(views) OVER (PARTITION BY root) AS BIGINT) AS total_views FROM (SELECT m.root, a.article_qid, a.views,
  row_number() OVER (PARTITION BY m.root ORDER BY a.views DESC, a.article_qid) AS rank FROM by_article AS a JOIN {mask} AS m USING (article_qid) WHERE a.views > 0)
  WHERE rank <= {n}"""
_COUNTED = "CAST(length({t}) - length(replace(lower({t}), letter, '')) AS DOUBLE)"
_LABEL = "coalesce({t}, concat('Q', CAST({q} AS VARCHAR)))"

BODIES = {
    "read_pageview_dump": "SELECT * FROM dump WHERE page_id % 10 NOT IN (3, 7)",
    "normalize_pageviews": "SELECT * FROM pageviews",
    "daily_article_views": "SELECT * FROM all_daily",
    "backfill_days": "SELECT date FROM days WHERE date NOT IN (SELECT date FROM all_daily WHERE day(date) % 5 <> 0)",
    "backfill_range": f"SELECT * FROM all_daily WHERE date BETWEEN {JAN}",
    "write_pageviews": "SELECT * FROM pageviews",
    "write_daily_views": "SELECT * FROM all_daily",
    "scan_daily_views": "SELECT * FROM by_article",
    "write_dimension": "SELECT * FROM articles",
    "scan_vectors_source": "SELECT wiki, qid, page_title FROM categories",
    "stream_daily_views": """SELECT a.wiki, p.date, a.qid AS article_qid, CAST(sum(p.daily_views) AS BIGINT) AS views FROM pageviews AS p
      JOIN articles AS a ON a.wiki = p.wiki AND a.page_id = p.page_id WHERE p.page_id % 10 NOT IN (3, 7) GROUP BY ALL""",
    "taken_days": f"SELECT date FROM daily WHERE day(date) % 2 = 0 AND date BETWEEN {FEB} UNION SELECT date FROM days",
    "global_views_by_months": f"SELECT article_qid, CAST(sum(views) AS BIGINT) AS views FROM all_daily WHERE date BETWEEN {LONG} GROUP BY article_qid",
    "top_categories_by_months": """SELECT * FROM (SELECT p.category_qid, CAST(sum(a.views) AS BIGINT) AS total_views FROM long_totals AS a JOIN pairs AS p USING (article_qid)
      GROUP BY p.category_qid ORDER BY total_views DESC, p.category_qid LIMIT 10) WHERE total_views > 0""",
    "category_delta_by_months": f"SELECT qid, {_change('b', 'i')} FROM long_chosen JOIN long_deep USING (qid)",
    "category_components": """SELECT a.root AS node, min(a.node) AS component FROM reach AS a JOIN reach AS b ON b.root = a.node AND b.node = a.root
      WHERE a.root IN (SELECT parent_qid FROM edges UNION SELECT child_qid FROM edges) GROUP BY a.root""",
    "read_compressed_dump": """SELECT replace(domain, '.wikipedia', 'wiki') AS wiki, page_id, CASE access_method WHEN 'desktop' THEN 0 WHEN 'mobile-web' THEN 1 ELSE -1 END AS access_method,
      daily_views, last_day(date) AS date FROM dump WHERE page_id % 10 NOT IN (3, 7)""",
    "parse_replica_tsv": "SELECT page_id, qid, page_title FROM articles WHERE page_id % 10 NOT IN (3, 7)",
    "wiki_editions": "SELECT concat('c', CAST(c_custkey AS VARCHAR), 'wiki') AS wiki FROM customer WHERE c_custkey % 5 > 2 AND c_custkey % 7 <> 0",
    "site_matrix_editions": """SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS code, c_name AS name, concat('c', CAST(c_custkey AS VARCHAR), 'wiki') AS dbname,
      concat('https://', CAST(c_custkey AS VARCHAR)) AS url FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""",
    "column_functions": """SELECT wiki, qid, concat('Category: ', replace(page_title, '_', ' ')) AS title, concat('Category:_', replace(page_title, ' ', '_')) AS underscored,
      replace(page_title, '_', ' ') AS bare, qid AS number, '1998-01-01 to 1998-01-31' AS period, page_title AS decoded FROM categories""",
    "extract_articles": "SELECT * FROM x_articles",
    "extract_categories": "SELECT * FROM x_categories",
    "extract_category_graph": """SELECT p.qid AS parent_qid, c.qid AS child_qid FROM category_graph AS g
      JOIN x_categories AS p ON p.qid = g.parent_qid JOIN x_categories AS c ON c.qid = g.child_qid""",
    "extract_article_category": """SELECT a.article_qid, a.category_qid FROM article_category AS a
      JOIN x_articles AS x ON x.qid = a.article_qid JOIN x_categories AS c ON c.qid = a.category_qid""",
    "referential_integrity": """SELECT 'frwiki' AS wiki, * FROM article_category WHERE article_qid IN (SELECT qid FROM fr_articles)
      AND category_qid IN (SELECT qid FROM fr_categories)""",
    "scan_category_edges": """SELECT 'frwiki' AS wiki, * FROM category_graph WHERE parent_qid IN (SELECT qid FROM fr_categories)
      AND child_qid IN (SELECT qid FROM fr_categories)""",
    "scan_dimension": "SELECT * FROM articles",
    "child_categories": "SELECT parent_qid, child_qid FROM edges",
    "parent_categories": "SELECT child_qid, parent_qid FROM edges",
    "article_categories": "SELECT article_qid, category_qid FROM pairs",
    "category_exists": "SELECT qid, qid IN (SELECT qid FROM fr_categories) AS exists FROM own_categories",
    "article_exists": "SELECT qid, qid IN (SELECT qid FROM fr_articles) AS exists FROM own_articles",
    "sub_category_counts": "SELECT parent_qid, count(DISTINCT child_qid) AS child_count FROM edges GROUP BY parent_qid",
    "sub_categories_counted": """SELECT e.parent_qid, e.child_qid AS qid, c.page_title AS title,
        (SELECT count(DISTINCT x.child_qid) FROM edges AS x WHERE x.parent_qid = e.child_qid) AS child_count,
        count(*) OVER (PARTITION BY e.parent_qid) AS total_count
      FROM (SELECT DISTINCT parent_qid, child_qid FROM edges) AS e LEFT JOIN fr_categories AS c ON c.qid = e.child_qid""",
    "descendant_categories": "SELECT root, node AS qid, CAST(depth AS BIGINT) AS depth FROM reach WHERE depth BETWEEN 1 AND 3",
    "articles_in_category": "SELECT * FROM mask2",
    "articles_in_category_unlimited": "SELECT DISTINCT r.root, p.article_qid FROM reach AS r JOIN pairs AS p ON p.category_qid = r.node",
    "category_depth_stats": """SELECT root, CAST(max(depth) AS BIGINT) AS max_depth, round(avg(depth), 6) AS average_depth, count(*) AS reached,
      (SELECT count(*) FROM own_categories) - count(*) AS unreachable FROM reach GROUP BY root""",
    "depth_histogram": "SELECT root, CAST(depth AS BIGINT) AS depth, count(*) AS n FROM reach GROUP BY ALL",
    "top_categories": "SELECT * FROM best",
    "top_categories_nested": "SELECT * FROM nested",
    "top_categories_titled": f"""SELECT n.*, {_LABEL.format(t="c.page_title", q="n.category_qid")} AS category_title, {_LABEL.format(t="f.title", q="n.article_qid")} AS article_title
      FROM nested AS n LEFT JOIN own_categories AS c ON c.qid = n.category_qid LEFT JOIN fr_titles AS f ON f.qid = n.article_qid""",
    "ranked_categories": """SELECT row_number() OVER (ORDER BY total_views DESC, category_qid) AS rank, category_qid, total_views,
      round(total_views / 31.0, 6) AS daily_average FROM best""",
    "category_trend": _trend("mask2"),
    "category_trend_direct": _trend("mask0"),
    "article_trend": """SELECT a.qid AS article_qid, d.date, CAST(coalesce(j.views, 0) AS BIGINT) AS views FROM own_articles AS a CROSS JOIN days AS d
      LEFT JOIN january AS j ON j.article_qid = a.qid AND j.date = d.date""",
    "article_trend_by_title": """SELECT a.page_title, a.qid AS article_qid, d.date, CAST(coalesce(j.views, 0) AS BIGINT) AS views FROM own_articles AS a CROSS JOIN days AS d
      LEFT JOIN january AS j ON j.article_qid = a.qid AND j.date = d.date""",
    "top_articles_in_category": _TOP_OF.format(mask="mask1", n=10),
    "category_trend_with_top": f"""SELECT root, 'trend' AS part, CAST(date AS VARCHAR) AS item, views FROM ({_trend("mask1")})
      UNION ALL SELECT t.root, 'top', a.page_title, t.views FROM ({_TOP_OF.format(mask="mask1", n=10)}) AS t JOIN own_articles AS a ON a.qid = t.article_qid""",
    "categories_trend": _SERIES.format(mask="mask1"),
    "categories_trend_distinct": _SERIES.format(mask="(SELECT DISTINCT article_qid FROM mask1)"),
    "categories_trend_top_articles": f"""SELECT t.article_qid, t.views, a.page_title AS title FROM (SELECT article_qid, CAST(sum(views) AS BIGINT) AS views
      FROM ({_TOP_OF.format(mask="mask1", n=50)}) GROUP BY article_qid ORDER BY views DESC, article_qid LIMIT 10) AS t JOIN own_articles AS a ON a.qid = t.article_qid""",
    "sub_categories_titled": "SELECT DISTINCT e.parent_qid, e.child_qid AS qid, c.page_title AS title FROM edges AS e JOIN fr_categories AS c ON c.qid = e.child_qid",
    "category_articles_titled": f"""SELECT m.root, m.article_qid, {_LABEL.format(t="f.title", q="m.article_qid")} AS title FROM mask0 AS m
      LEFT JOIN fr_titles AS f ON f.qid = m.article_qid""",
    "category_articles_series": """SELECT m.root, m.article_qid, CAST(coalesce(a.views, 0) AS BIGINT) AS total_views, j.date, j.views FROM mask0 AS m
      LEFT JOIN by_article AS a USING (article_qid) LEFT JOIN january AS j ON j.article_qid = m.article_qid""",
    "category_delta": f"SELECT qid, {_change('b', 'i')} FROM chosen",
    "category_delta_deep": f"SELECT qid, {_change('db', 'di')} FROM chosen JOIN deep USING (qid)",
    "category_delta_reference_mode": f"""SELECT qid, {_change('b', 'i')} FROM (SELECT qid, CASE WHEN in_b THEN b ELSE db END AS b, CASE WHEN in_i THEN i ELSE di END AS i
      FROM chosen JOIN deep USING (qid))""",
    "article_delta": f"""SELECT root, qid, {_change('b', 'i')} FROM (SELECT m.root, m.article_qid AS qid, p.b, p.i,
        row_number() OVER (PARTITION BY m.root ORDER BY p.b DESC, m.article_qid) AS rb, row_number() OVER (PARTITION BY m.root ORDER BY p.i DESC, m.article_qid) AS ri
      FROM periods AS p JOIN mask1 AS m USING (article_qid)) WHERE rb <= 20 AND b > 0 OR ri <= 20 AND i > 0""",
    "trending_articles": """SELECT article_qid, views, category_qid FROM (SELECT p.category_qid, a.article_qid, a.views,
        row_number() OVER (PARTITION BY p.category_qid ORDER BY a.views DESC, a.article_qid) AS rank
      FROM (SELECT category_qid FROM category_totals ORDER BY total_views DESC, category_qid LIMIT 50) JOIN pairs AS p USING (category_qid)
      JOIN by_article AS a ON a.article_qid = p.article_qid AND a.views > 0) WHERE rank <= 50""",
    "overlay_series": f"""SELECT date, CAST(sum(CASE WHEN root = 3 THEN views ELSE 0 END) AS BIGINT) AS c3,
      CAST(sum(CASE WHEN root = 7 THEN views ELSE 0 END) AS BIGINT) AS c7 FROM ({_trend("mask1")}) WHERE root IN (3, 7) GROUP BY date""",
    "global_views": f"SELECT article_qid, CAST(sum(views) AS BIGINT) AS views FROM all_daily WHERE date BETWEEN {JAN} GROUP BY article_qid",
    "dataset_stats": """SELECT d.wiki, (SELECT count(DISTINCT qid) FROM articles AS a WHERE a.wiki = d.wiki) AS articles,
      (SELECT count(DISTINCT qid) FROM categories AS c WHERE c.wiki = d.wiki) AS categories,
      count(DISTINCT date) AS days, max(date) AS latest_date, CAST(sum(views) AS BIGINT) AS views FROM all_daily AS d GROUP BY d.wiki""",
    "category_rollup_totals": """SELECT m.root, CAST(sum(a.views) AS BIGINT) AS total_views FROM by_article AS a JOIN mask2 AS m USING (article_qid) GROUP BY m.root""",
    "qids_by_titles": "SELECT page_title, qid FROM own_articles",
    "qid_by_title": "SELECT page_title, qid FROM own_categories",
    "page_id_by_title": "SELECT page_title, page_id FROM own_articles",
    "titles_by_qids": "SELECT qid, title FROM fr_titles",
    "title_by_qid": "SELECT qid, page_title AS title FROM own_categories",
    "translate_titles": "SELECT a.page_title, a.qid, f.title AS translated FROM own_articles AS a JOIN fr_titles AS f USING (qid)",
    "similarity_matrix": "SELECT query_id, qid, score FROM scores",
    "most_similar": "SELECT query_id, qid, score, rank FROM ranks WHERE rank <= 10",
    "vector_search": "SELECT query_id, qid, page_title, score AS match_score, rank FROM ranks WHERE rank <= 50",
    "search_categories": "SELECT f.query_id, f.qid, c.page_title AS title, f.match_score FROM found AS f JOIN fr_categories AS c USING (qid)",
    "search_categories_own_titles": "SELECT query_id, qid, page_title AS title, match_score FROM found",
    "search_categories_trend": _trend("(SELECT f.query_id AS root, m.article_qid FROM found AS f JOIN mask1 AS m ON m.root = f.qid)"),
    "category_trend_or_search": _trend("""(SELECT a.query_id AS root, m.article_qid FROM asked AS a
        JOIN own_categories AS c ON a.query_id % 40 = 0 AND c.page_title = concat('Supplier_', lpad(CAST(a.query_id // 20 + 1 AS VARCHAR), 9, '0')) JOIN mask2 AS m ON m.root = c.qid
      UNION ALL SELECT f.query_id, m.article_qid FROM found AS f JOIN mask1 AS m ON m.root = f.qid WHERE f.query_id NOT IN (SELECT a.query_id FROM asked AS a
        JOIN own_categories AS c ON a.query_id % 40 = 0 AND c.page_title = concat('Supplier_', lpad(CAST(a.query_id // 20 + 1 AS VARCHAR), 9, '0'))))"""),
    "upsert_vectors": """SELECT 'enwiki' AS wiki, qid, CASE WHEN qid % 3 = 0 THEN concat(page_title, '_new') ELSE page_title END AS page_title,
      round(CAST(CAST(CASE WHEN qid % 3 = 0 THEN v[len(v)] ELSE v[1] END AS FLOAT) AS DOUBLE), 6) AS first, len(v) AS length,
      CAST(CASE WHEN qid % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM vectors""",
    "embed_categories": f"SELECT wiki, qid, page_title, CAST(1 AS BIGINT) AS version, place, {_COUNTED.format(t='page_title')} AS value FROM categories CROSS JOIN letters",
    "encode_texts": f"SELECT wiki, page_id, place, {_COUNTED.format(t="concat('title: ', page_title)")} AS value FROM articles CROSS JOIN letters",
}
BODIES |= {
    "titles_by_qids_bucketed": BODIES["titles_by_qids"], "translate_titles_bucketed": BODIES["translate_titles"],
    "top_categories_bucketed": BODIES["top_categories"], "most_similar_by_clusters": BODIES["most_similar"], "title_map": BODIES["sub_categories_titled"],
}


def _needed(text: str, seen: list[str]) -> None:
    for name in TABLES:
        if name not in seen and re.search(rf"\b{name}\b", text):
            own = TABLES[name]
            before = len(seen)
            seen.append(name)
            _needed(own, seen)
            # What a table needs comes before it.
            seen.append(seen.pop(before))


def statement(body: str) -> str:
    names: list[str] = []
    _needed(body, names)
    if not names:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names) + "\n" + body


def all_sql() -> dict[str, str]:
    return {name: statement(body) for name, body in BODIES.items()}
