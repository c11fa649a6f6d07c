"""Schemas of all tables, as DDL. Ids and counts are BIGINT, days are DATE; nothing is inferred."""

from __future__ import annotations

PAGEVIEWS_RAW = "wiki string, page_id bigint, access_method tinyint, daily_views bigint, date date"
DIMENSION = "wiki string, page_id bigint, qid bigint, page_title string"
CATEGORY_GRAPH = "wiki string, parent_qid bigint, child_qid bigint"
ARTICLE_CATEGORY = "wiki string, article_qid bigint, category_qid bigint"
DAILY_VIEWS = "wiki string, date date, article_qid bigint, views bigint"
CATEGORY_VECTORS = "wiki string, qid bigint, page_title string, embedding array<float>, version bigint"

PAGE = "page_id bigint, page_namespace int, page_title string, page_is_redirect int, page_is_new int"
PAGE_PROPS = "pp_page bigint, pp_propname string, pp_value string"
CATEGORYLINKS = "cl_from bigint, cl_target_id bigint, cl_type string"
LINKTARGET = "lt_id bigint, lt_namespace int, lt_title string"
