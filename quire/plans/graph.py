"""Hypergraph queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import graph as H
from quire.operators import layout as L
from quire.plans.layout import _CAPTION, B, MERGED, OVER
from quire.session import cut, table


def _g(spark, d):
    return table(spark, d, "hypergraphs")


def _en(spark, d):
    """Edges, kept since their records are nested and used several times, and nodes."""
    g = _g(spark, d)
    return cut(H.edges(g)), H.nodes(g)


def hypergraph_stats(spark, d):
    return H.edge_statistics(H.edges(_g(spark, d)))


def hypergraph_members(spark, d):
    return H.members(H.edges(_g(spark, d)))


def graph_nodes(spark, d):
    return H.nodes(_g(spark, d)).groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.count("text").alias("with_text"))


def graph_pages(spark, d):
    return H.pages(_g(spark, d)).groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("page").alias("last_page"))


def visual_types_map(spark, d):
    return H.edges(_g(spark, d)).select("doc_id", "edge_id", F.explode("visual_types").alias("visual_type", "n"))


def edges_by_type(spark, d):
    return H.edges_of(H.edges(_g(spark, d)), "contextual", "contextual").select("doc_id", "edge_id", "seq")


def anchor_of_edge(spark, d):
    return H.anchors(*_en(spark, d))


def caption_of_edge(spark, d):
    return H.edge_captions(*_en(spark, d))


def related_of_edge(spark, d):
    return H.related(*_en(spark, d)).select("doc_id", "edge_id", "pos", "block_id", "type")


def edge_text(spark, d):
    return H.edge_text(*_en(spark, d))


def co_members(spark, d):
    e, n = _en(spark, d)
    return H.co_members(e, n.filter(F.contains("block_id", F.lit("_anchor"))))


def title_of_anchor(spark, d):
    return H.section_titles(*_en(spark, d))


def sub_graph(spark, d):
    e, n = _en(spark, d)
    return H.sub_graph(e, n, F.col("edge_type") == "contextual")[1].groupBy("doc_id").agg(F.count("*").alias("n"))


def _grouped(g, *keys):
    return g.select("doc_id", *keys, "num_visuals", F.size("visual_types").cast("bigint").alias("n_types"), F.array_join("members", ",").alias("members"))


def page_grouping(spark, d):
    e, n = _en(spark, d)
    return _grouped(H.grouping_edges(H.anchors(H.edges_of(e, "contextual"), n)), "page")


def section_grouping(spark, d):
    e, n = _en(spark, d)
    a = H.anchors(H.edges_of(e, "contextual"), n).join(H.section_titles(e, n), ["doc_id", "anchor_id"])
    return _grouped(H.grouping_edges(a, "section"), "title_id")


def document_grouping(spark, d):
    e, n = _en(spark, d)
    return _grouped(H.grouping_edges(H.anchors(H.edges_of(e, "contextual"), n), "document"))


def _units(spark, d):
    b = L.layout(table(spark, d, "ocr_blocks"), text=False)
    v = L.merge_adjacent(b)
    return H.build_units(v, L.captions(v, b), L.nearest_titles(v, b))


def visual_units(spark, d):
    return _units(spark, d).select("doc_id", "page", "block_id", "type", "caption_id", "title_id", "total_blocks", "is_cross_page", "page_span_size")


def unit_stats(spark, d):
    return _units(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("units"), F.count("caption_id").alias("captioned"), F.count("title_id").alias("titled"), F.count_if(F.col("merged") > 1).alias("merged_units"),
        F.round(F.avg("total_blocks"), 6).alias("mean_blocks"), F.round(100.0 * F.count("caption_id") / F.count("*"), 6).alias("captioned_percent"))


def hypergraph_edges(spark, d):
    return H.build_edges(_units(spark, d)).select("doc_id", "page", "edge_id", "edge_type", "relation", F.array_join("members", ",").alias("members"), "visual_type")


QUERIES = {f.__name__: f for f in (hypergraph_stats, hypergraph_members, graph_nodes, graph_pages, visual_types_map, edges_by_type, anchor_of_edge, caption_of_edge, related_of_edge,
                                   edge_text, co_members, title_of_anchor, sub_graph, page_grouping, section_grouping, document_grouping, visual_units, unit_stats, hypergraph_edges)}

RAW = """WITH RECURSIVE rj AS (SELECT DISTINCT document_id, CAST(raw_record AS JSON) AS j FROM hypergraphs WHERE hyperedges IS NULL AND raw_record IS NOT NULL AND json_valid(raw_record)),
 rl AS (SELECT document_id, CAST(coalesce(j->'$.hyperedges', j->'$.document.graph.hyperedges') AS JSON[]) AS l FROM rj),
 re AS (SELECT document_id, unnest(range(len(l))) AS seq, unnest(l) AS e FROM rl UNION ALL
   SELECT document_id, unnest(range(len(c))) AS seq, unnest(c) AS e FROM (SELECT document_id, CAST(e->'$.children' AS JSON[]) AS c FROM re) WHERE c IS NOT NULL),
 rm AS (SELECT document_id, seq, e, CASE WHEN json_type(e->'$.meta') = 'VARCHAR' THEN CAST(e->>'$.meta' AS JSON) ELSE e->'$.meta' END AS m FROM re),
"""
E = RAW + """ g AS (SELECT DISTINCT document_id, hyperedges FROM hypergraphs WHERE hyperedges IS NOT NULL),
 e AS (SELECT document_id AS doc_id, unnest(range(len(hyperedges))) AS seq, unnest(hyperedges) AS e FROM g),
 ed AS (SELECT doc_id, CAST(seq AS INTEGER) AS seq, e.edge_id AS edge_id, e.edge_type AS edge_type, e.members AS members, e.meta.relation AS relation, e.meta.page_num AS page, e.meta.section_title AS section_title, e.meta.visual_types AS vt FROM e
   UNION ALL SELECT document_id, CAST(seq AS INTEGER), e->>'$.edge_id', e->>'$.edge_type',
     list_transform(CAST(e->'$.members' AS JSON[]), lambda x: CASE json_type(x) WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN coalesce(x->>'$.block_id', x->>'$.ref.block.id') ELSE x->>'$' END),
     m->>'$.relation', TRY_CAST(m->>'$.page_num' AS INTEGER), m->>'$.section_title',
     CASE json_type(m->'$.visual_types') WHEN 'OBJECT' THEN CAST(m->'$.visual_types' AS MAP(VARCHAR, INTEGER)) WHEN 'ARRAY' THEN map_from_entries(list_transform(CAST(m->'$.visual_types' AS JSON[]), lambda x: {'k': x->>'$.type', 'v': CAST(x->>'$.count' AS INTEGER)})) END FROM rm),
 mb AS (SELECT * FROM (SELECT doc_id, edge_id, unnest(range(len(members))) AS pos, unnest(members) AS block_id FROM ed) WHERE block_id IS NOT NULL),
 nb AS (SELECT DISTINCT document_id, blocks FROM hypergraphs),
 n AS (SELECT DISTINCT doc_id, b.block_id AS block_id, b.block_type AS type, b.page AS page, b.bbox AS bbox, b.text AS text, b.rec_conf AS rec_conf FROM (SELECT document_id AS doc_id, unnest(blocks) AS b FROM nb)),
 j AS (SELECT mb.doc_id, mb.edge_id, mb.pos, mb.block_id, n.type, n.page, n.text, (coalesce(lower(n.type) IN ('figure','table','chart','map','diagram','graph'), false) OR contains(lower(mb.block_id), 'anchor')) AS anchor
   FROM mb JOIN n USING (doc_id, block_id))"""
_ANCHORS = ", a AS (SELECT DISTINCT doc_id, page, block_id, type FROM (SELECT j.* FROM j JOIN ed USING (doc_id, edge_id) WHERE anchor AND ed.edge_type = 'contextual' QUALIFY row_number() OVER (PARTITION BY doc_id, edge_id ORDER BY pos, block_id) = 1))"
_FIRST = " QUALIFY row_number() OVER (PARTITION BY doc_id, edge_id ORDER BY pos, block_id) = 1"
_REL = "'text','title','figure_caption','table_caption','chart_caption','map_caption','diagram_caption','graph_caption'"
_UNITS = B + MERGED + ", " + _CAPTION + f""", t AS (SELECT * FROM b WHERE type IN ('title','section_header') AND x1 IS NOT NULL),
 pt AS (SELECT a.doc_id, a.page, a.block_id, c.block_id AS title_id, c.page AS title_page, round(CASE WHEN c.page = a.page THEN abs(a.y1 - c.y2)/1000.0 ELSE CAST(a.page - c.page AS DOUBLE) END, 9) AS score
   FROM m a JOIN t c ON a.doc_id = c.doc_id AND c.page BETWEEN a.page - 3 AND a.page WHERE c.page < a.page OR c.y2 <= a.y1 OR {OVER} < 50),
 ti AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_id ORDER BY score, -title_page, title_id) = 1),
 u AS (SELECT m.doc_id, m.page, m.block_id, m.type, m.merged, cap.caption_id, ti.title_id, coalesce(ti.title_page <> m.page, false) AS is_cross_page,
   1 + (cap.caption_id IS NOT NULL)::INT + (ti.title_id IS NOT NULL)::INT AS total_blocks FROM m LEFT JOIN cap USING (doc_id, page, block_id) LEFT JOIN ti USING (doc_id, page, block_id))"""
SQL = {
    "hypergraph_stats": E + " SELECT doc_id, count(*) AS edges, count(*) FILTER (WHERE edge_type = 'contextual') AS contextual, count(*) FILTER (WHERE edge_type = 'containment') AS containment, " + ", ".join(
        f"count(*) FILTER (WHERE relation = '{r}') AS {r}" for r in ("page_contains_visual", "section_contains_visual", "page_contains_visuals", "section_contains_visuals", "document_contains_visuals")) + " FROM ed GROUP BY doc_id",
    "hypergraph_members": E + " SELECT doc_id, edge_id, pos, block_id FROM mb",
    "graph_nodes": E + " SELECT doc_id, type, count(*) AS n, count(text) AS with_text FROM n GROUP BY ALL",
    "graph_pages": "WITH p AS (SELECT DISTINCT document_id AS doc_id, x.page_id AS page_id, x.page_num AS page, x.page_image_path AS image FROM (SELECT document_id, unnest(pages) AS x FROM hypergraphs)) SELECT doc_id, count(*) AS pages, max(page) AS last_page FROM p GROUP BY doc_id",
    "visual_types_map": E + ", v AS (SELECT doc_id, edge_id, unnest(map_entries(vt)) AS x FROM ed WHERE vt IS NOT NULL) SELECT doc_id, edge_id, x.key AS visual_type, x.value AS n FROM v",
    "edges_by_type": E + " SELECT doc_id, edge_id, seq FROM ed WHERE edge_type = 'contextual' AND relation = 'contextual'",
    "anchor_of_edge": E + " SELECT doc_id, edge_id, block_id AS anchor_id, type, page FROM j WHERE anchor" + _FIRST,
    "caption_of_edge": E + " SELECT doc_id, edge_id, block_id AS caption_id, text AS caption FROM j WHERE NOT anchor AND (contains(lower(type), 'caption') OR contains(lower(block_id), 'caption'))" + _FIRST,
    "related_of_edge": E + f" SELECT doc_id, edge_id, pos, block_id, type FROM j WHERE NOT anchor AND type IN ({_REL})",
    "edge_text": E + " SELECT doc_id, edge_id, string_agg(text, ' ' ORDER BY pos, block_id, text) AS text FROM j WHERE trim(text) <> '' GROUP BY ALL",
    "co_members": E + " SELECT DISTINCT a.doc_id, a.block_id AS asked, c.block_id AS block_id FROM mb a JOIN (SELECT DISTINCT doc_id, block_id FROM n WHERE contains(block_id, '_anchor')) q USING (doc_id, block_id) JOIN mb c ON a.doc_id = c.doc_id AND a.edge_id = c.edge_id AND a.block_id <> c.block_id",
    "title_of_anchor": E + """, c AS (SELECT j.*, ed.seq FROM j JOIN ed USING (doc_id, edge_id) WHERE ed.edge_type = 'containment'),
 t AS (SELECT doc_id, edge_id, block_id, text FROM c WHERE type IN ('title','section_header')""" + _FIRST + """)
 SELECT c.doc_id, c.block_id AS anchor_id, t.block_id AS title_id, t.text AS title FROM c JOIN t USING (doc_id, edge_id) WHERE c.anchor QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.block_id ORDER BY c.seq, c.edge_id) = 1""",
    "sub_graph": E + " SELECT doc_id, count(*) AS n FROM n WHERE (doc_id, block_id) IN (SELECT (mb.doc_id, mb.block_id) FROM mb JOIN ed USING (doc_id, edge_id) WHERE edge_type = 'contextual') GROUP BY doc_id",
    "page_grouping": E + _ANCHORS + " SELECT doc_id, page, count(*) AS num_visuals, count(DISTINCT type) AS n_types, string_agg(block_id, ',' ORDER BY block_id) AS members FROM a GROUP BY ALL",
    "document_grouping": E + _ANCHORS + ", x AS (SELECT DISTINCT doc_id, block_id, type FROM a) SELECT doc_id, count(*) AS num_visuals, count(DISTINCT type) AS n_types, string_agg(DISTINCT block_id, ',' ORDER BY block_id) AS members FROM x GROUP BY ALL",
    "visual_units": _UNITS + " SELECT doc_id, page, block_id, type, caption_id, title_id, total_blocks, is_cross_page, 1 + is_cross_page::INT AS page_span_size FROM u",
    "unit_stats": _UNITS + " SELECT doc_id, count(*) AS units, count(caption_id) AS captioned, count(title_id) AS titled, count(*) FILTER (WHERE merged > 1) AS merged_units, round(avg(total_blocks), 6) AS mean_blocks, round(100.0*count(caption_id)/count(*), 6) AS captioned_percent FROM u GROUP BY doc_id",
    "hypergraph_edges": _UNITS + """, x AS (SELECT *, doc_id || '_block_' || block_id || '_anchor' AS an, doc_id || '_block_' || block_id || '_caption' AS cn, doc_id || '_block_' || block_id || '_title' AS tn FROM u)
 SELECT doc_id, page, doc_id || '_edge_' || block_id || '_page_contains_visual' AS edge_id, 'containment' AS edge_type, 'page_contains_visual' AS relation, doc_id || '_page_' || page || ',' || an AS members, type AS visual_type FROM x
 UNION ALL SELECT doc_id, page, doc_id || '_edge_' || block_id || '_section_contains_visual', 'containment', 'section_contains_visual', tn || ',' || an, type FROM x WHERE title_id IS NOT NULL
 UNION ALL SELECT doc_id, page, doc_id || '_edge_' || block_id || '_contextual', 'contextual', 'contextual', an || CASE WHEN caption_id IS NULL THEN '' ELSE ',' || cn END || CASE WHEN title_id IS NULL THEN '' ELSE ',' || tn END, type FROM x""",
}
SQL["section_grouping"] = ("WITH y AS (" + SQL["title_of_anchor"] + "), z AS (" + E + _ANCHORS + " SELECT * FROM a) SELECT doc_id, title_id, count(*) AS num_visuals, count(DISTINCT type) AS n_types, "
                           "string_agg(DISTINCT block_id, ',' ORDER BY block_id) AS members FROM (SELECT DISTINCT z.doc_id, y.title_id, z.block_id, z.type FROM z JOIN y ON y.doc_id = z.doc_id AND y.anchor_id = z.block_id) GROUP BY ALL")
