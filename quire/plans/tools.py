"""Queries of the retrieval tools over visual units, and their SQL twins, which meet every question with every unit of its document."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from quire.functions.text import normalize_dashes
from quire.operators import graph as H
from quire.operators import retrieval as Rt
from quire.operators import tools as T
from quire.plans.graph import _REL, E, _en
from quire.plans.retrieval import _DASH, _FOLD, _KW
from quire.session import cut, table


class Asked:
    """What the tools of one query share, each made once: edges, nodes, units, wishes, keywords, totals."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def table(self, name):
        return table(self.spark, self.d, name)

    @cached_property
    def _graph(self):
        e, n = _en(self.spark, self.d)
        return e, cut(n)

    @property
    def edges(self):
        return self._graph[0]

    @property
    def nodes(self):
        return self._graph[1]

    @cached_property
    def units(self):
        return cut(T.units(self.edges, self.nodes))

    @cached_property
    def wanted(self):
        return cut(T.asks(self.table("samples").select("sample_idx", "doc_id", "question").distinct()))

    @cached_property
    def keywords(self):
        return cut(Rt.keywords(self.table("samples").distinct()))

    @cached_property
    def totals(self):
        return self.table("ocr_documents").select(F.col("document_id").alias("doc_id"), "total_pages").distinct()

    @cached_property
    def held(self):
        """Units that hold a keyword of a question on their document."""
        return Rt.matches(self.keywords, self.units, "edge_id", "text")

    def by_id(self):
        return T.find_by_id(self.units, self.wanted)

    def by_page(self):
        return T.find_by_page(self.units, self.wanted, self.totals)

    def sections(self):
        return T.section_units(self.edges, self.nodes, self.units)

    def by_section(self):
        return T.find_by_section(cut(self.sections()), self.units, self.wanted)

    def candidates(self, intent):
        w = self.wanted.filter(F.col("intent") == intent)
        return w, cut(T.candidates(self.units, w, self.keywords.join(w.select("sample_idx"), "sample_idx", "left_semi"), self.held))

    def items(self):
        return T.enumerate_items(self.candidates("enumerate")[1])

    def search(self):
        """Keyword search over captions and related texts: a match in the caption counts in full, one in the related texts three quarters."""
        named = Rt.matches(self.keywords, self.units, "edge_id", "caption").withColumn("_c", F.lit(True))
        strong = self.held.join(named, ["doc_id", "keyword", "edge_id"], "left").select("doc_id", "keyword", "edge_id", F.when(F.col("_c"), 1.0).otherwise(0.75).alias("strength"))
        s = Rt.keyword_scores(Rt.idf(self.keywords, self.held, self.units, "edge_id"), strong, "edge_id")
        return Rt.top_k(s, ["sample_idx"], [F.col("score").desc(), F.col("edge_id")], 5).select("sample_idx", "edge_id", F.round("score", 6).alias("score"), "matched", "rank")


def unit_table(spark, d):
    return Asked(spark, d).units.select("doc_id", "edge_id", "seq", "anchor_id", "type", "page", F.md5("caption").alias("caption"), F.md5("text").alias("text"))


def question_constraints(spark, d):
    a = Asked(spark, d).wanted
    return a.select("sample_idx", F.array_join(F.transform("ids", lambda x: F.concat_ws(" ", x["kind"], x["id"])), ",").alias("ids"), "type", F.array_join("pages", ",").alias("pages"), "section", "intent", "level")


def route_plan(spark, d):
    a = Asked(spark, d)
    return T.route(a.wanted, a.keywords)


def find_by_id(spark, d):
    return Asked(spark, d).by_id()


def find_by_page_units(spark, d):
    return Asked(spark, d).by_page()


def find_by_section(spark, d):
    return Asked(spark, d).by_section()


def section_filter(spark, d):
    """Units below every section title."""
    return Asked(spark, d).sections()


def enumerate_items(spark, d):
    return Asked(spark, d).items()


def global_count(spark, d):
    a = Asked(spark, d)
    w, c = a.candidates("count")
    b = a.table("ocr_blocks").select("doc_id", "block_id", "page", "text").distinct()
    often = w.filter(F.lower("question").rlike("how many times?")).select("sample_idx")
    kw = Rt.keywords(a.table("samples").distinct(), normalize_dashes).join(often, "sample_idx", "left_semi")
    j = Rt.matches(kw, b, "block_id", "text", normalize_dashes).join(b, ["doc_id", "block_id"]).withColumn("t", normalize_dashes(F.col("text")))
    times = j.groupBy("doc_id", "keyword").agg(F.sum((F.length("t") - F.length(F.replace("t", "keyword"))) / F.length("keyword")).cast("bigint").alias("times"))
    return T.global_count(w, c, kw.join(times, ["doc_id", "keyword"]), a.totals)


def unit_keyword_topk(spark, d):
    return Asked(spark, d).search()


def unit_text(spark, d):
    a = Asked(spark, d)
    return T.unit_text(a.units, a.nodes, a.edges, caption=True, title=False, related=True).select("doc_id", "edge_id", F.md5("text").alias("text"))


def entity_key(spark, d):
    a = Asked(spark, d)
    f = a.by_id().join(a.units.select("edge_id", "page"), "edge_id")
    reason = F.when(F.col("score") == 1.0, F.concat(F.lit("Matched ID "), "id", F.lit(" in caption")))
    return f.select("sample_idx", "edge_id", T.entity_key(reason, F.col("page")).alias("entity")).distinct()


def block_by_id(spark, d):
    """The first block and the first page of each document, found by their keys."""
    g = table(spark, d, "hypergraphs")
    n, p = H.nodes(g), H.pages(g)
    wanted = n.groupBy("doc_id").agg(F.min("block_id").alias("block_id"))
    found = n.join(wanted, ["doc_id", "block_id"]).groupBy("doc_id", "block_id").agg(F.min("type").alias("type"))
    return found.join(p.filter("page = 0").groupBy("doc_id").agg(F.min("page_id").alias("page_id")), "doc_id", "left")


def page_containment(spark, d):
    """Containment edges of each page."""
    return H.edges(table(spark, d, "hypergraphs")).filter("edge_type = 'containment' and page is not null").select("doc_id", "page", "edge_id").distinct()


QUERIES = {f.__name__: f for f in (unit_table, question_constraints, route_plan, find_by_id, find_by_page_units, find_by_section, section_filter, enumerate_items, global_count, unit_keyword_topk,
                                   unit_text, entity_key, block_by_id, page_containment)}

U = E + f""", cx AS (SELECT doc_id, edge_id, any_value(seq) AS seq FROM ed WHERE edge_type = 'contextual' AND relation = 'contextual' GROUP BY ALL),
 ju AS (SELECT DISTINCT mb.doc_id, mb.edge_id, mb.pos, mb.block_id, n.type, n.page, n.text, n.bbox[2] AS top, (coalesce(lower(n.type) IN ('figure','table','chart','map','diagram','graph'), false) OR contains(lower(mb.block_id), 'anchor')) AS anchor
   FROM mb JOIN cx USING (doc_id, edge_id) JOIN n USING (doc_id, block_id)),
 un AS (SELECT doc_id, edge_id, arg_min({{'b': block_id, 't': type, 'p': page, 'top': top}}, pos) FILTER (WHERE anchor) AS a,
   arg_min({{'text': text}}, pos) FILTER (WHERE NOT anchor AND (contains(lower(type), 'caption') OR contains(lower(block_id), 'caption'))) AS c,
   string_agg(text, ' ' ORDER BY pos, block_id, text) FILTER (WHERE NOT anchor AND type IN ({_REL}) AND trim(text) <> '') AS r FROM ju GROUP BY ALL),
 us AS (SELECT doc_id, edge_id, seq, a.b AS anchor_id, lower(a.t) AS type, a.p AS page, a.top AS top, c.text AS caption, concat_ws(' ', c.text, nullif(r, '')) AS text FROM un JOIN cx USING (doc_id, edge_id) WHERE a IS NOT NULL),
 s AS (SELECT DISTINCT * FROM samples), """ + _KW.format(_FOLD.format("k")) + r""",
 q0 AS (SELECT DISTINCT sample_idx, doc_id, question, lower(coalesce(question,'')) AS q FROM s),
 ids AS (SELECT DISTINCT sample_idx, doc_id, unnest(regexp_extract_all(q, '(figure|table|chart|map|graph)\s*([0-9]+)', 1)) AS kind, unnest(regexp_extract_all(q, '(figure|table|chart|map|graph)\s*([0-9]+)', 2)) AS id FROM q0),
 aw AS (SELECT *, nullif(regexp_extract(q, '(figure|table|chart|map|diagram|graph)', 1), '') AS type, nullif(regexp_extract(q, 'section on ([\p{L}]+)', 1), '') AS section,
   list_distinct(regexp_extract_all(q, 'page\s*([0-9]{1,6})', 1)) AS pages, (SELECT count(*) FROM ids WHERE ids.sample_idx = q0.sample_idx) AS n_ids,
   CASE WHEN starts_with(q, 'list') THEN 'enumerate' WHEN regexp_matches(q, 'how many|number of|count of|total number|total pages') THEN 'count' WHEN regexp_matches(q, 'differ|change between|compare') THEN 'compare' ELSE 'locate' END AS intent FROM q0),
 w AS (SELECT *, CASE WHEN intent IN ('enumerate','count') AND n_ids = 0 THEN 'DOCUMENT' WHEN n_ids > 1 THEN 'MULTI_UNIT' ELSE 'UNIT' END AS level FROM aw)"""
_DIGITS = "replace(replace(replace(replace(replace(id, '1', '[1lI|i!j]'), '0', '[0OoQ]'), '2', '[2Zz]'), '5', '[5Ss]'), '8', '[8B]')"
_NOUN = r"CASE kind WHEN 'figure' THEN 'f[il1!|][gq9](?:ure)?\.?' WHEN 'table' THEN 't[a@]b(?:le)?\.?' WHEN 'chart' THEN 'chart\.?' WHEN 'map' THEN 'm[a@]p\.?' ELSE 'graph\.?' END"
_BY_ID = U + f""", pt AS (SELECT *, '(?:' || {_NOUN} || ')[^0-9a-zA-Z]*' || {_DIGITS} || '(?:[^0-9]|$)' AS pattern, NOT EXISTS (SELECT 1 FROM us WHERE us.doc_id = ids.doc_id AND us.type = ids.kind) AS any_type FROM ids),
 hit AS (SELECT DISTINCT sample_idx, kind, id, us.edge_id, 1.0::DOUBLE AS score FROM pt JOIN us ON us.doc_id = pt.doc_id AND (us.type = kind OR any_type) AND regexp_matches(lower(coalesce(caption,'')), pattern)),
 lost AS (SELECT ids.*, CAST(id AS INTEGER) AS num FROM ids ANTI JOIN hit USING (sample_idx, kind, id)),
 pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY page, coalesce(top, 0.0), seq, edge_id) AS place, TRY_CAST(nullif(regexp_extract(lower(coalesce(caption,'')), '(?:figure|fig)\\s*([0-9]{{1,9}})', 1), '') AS INTEGER) AS number FROM us),
 pr AS (SELECT doc_id, type AS kind, place, number, lead(place) OVER o AS np, lead(number) OVER o AS nn FROM pl WHERE number IS NOT NULL WINDOW o AS (PARTITION BY doc_id, type ORDER BY place)),
 fs AS (SELECT lost.*, place, number, np, nn FROM lost JOIN pr ON pr.doc_id = lost.doc_id AND pr.kind = lost.kind AND number < num AND num < nn AND np > place + 1 QUALIFY row_number() OVER (PARTITION BY sample_idx, lost.kind, id ORDER BY place) = 1),
 sp AS (SELECT *, CASE WHEN np - place = 2 THEN place + 1 ELSE place + CAST(floor((num - number)/(nn - number)::DOUBLE*(np - place)) AS BIGINT) END AS spot FROM fs),
 fi AS (SELECT * FROM hit UNION ALL SELECT sample_idx, sp.kind, id, pl.edge_id, CASE WHEN np - sp.place = 2 THEN 0.75 ELSE 0.65 END FROM sp JOIN pl ON pl.doc_id = sp.doc_id AND pl.type = sp.kind AND pl.place = sp.spot WHERE spot > sp.place AND spot < np)"""
_CANDS = U + f""", uu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, edge_id) AS no, count(*) OVER (PARTITION BY doc_id) AS n FROM us),
 h AS (SELECT kw.sample_idx, us.edge_id, count(*) AS held FROM kw JOIN us ON us.doc_id = kw.doc_id AND contains({_FOLD.format("us.text")}, keyword) GROUP BY ALL),
 ak AS (SELECT sample_idx, count(*) AS asked FROM kw GROUP BY ALL),
 c0 AS (SELECT w.sample_idx, w.type AS want, w.intent, coalesce(asked, 0) AS asked, uu.edge_id, uu.type AS kind, uu.page, uu.caption, uu.seq, uu.no, uu.n, coalesce(held, 0) AS held FROM w JOIN uu USING (doc_id) LEFT JOIN ak USING (sample_idx) LEFT JOIN h ON h.sample_idx = w.sample_idx AND h.edge_id = uu.edge_id),
 c1 AS (SELECT * FROM c0 WHERE n <= 40 OR (asked = 0 AND no <= 40) OR (asked > 0 AND held > 0) QUALIFY n <= 40 OR row_number() OVER (PARTITION BY sample_idx ORDER BY no) <= 40),
 cd AS (SELECT * FROM c1 QUALIFY coalesce(kind = want, false) OR NOT bool_or(coalesce(kind = want, false)) OVER (PARTITION BY sample_idx))"""
SQL = {
    "unit_table": U + " SELECT doc_id, edge_id, seq, anchor_id, type, page, md5(caption) AS caption, md5(text) AS text FROM us",
    "question_constraints": U + r""" SELECT sample_idx, coalesce((SELECT string_agg(k || ' ' || i, ',' ORDER BY o) FROM (SELECT k, i, min(o) AS o FROM (SELECT unnest(regexp_extract_all(w.q, '(figure|table|chart|map|graph)\s*([0-9]+)', 1)) AS k, unnest(regexp_extract_all(w.q, '(figure|table|chart|map|graph)\s*([0-9]+)', 2)) AS i, unnest(range(20)) AS o) WHERE k IS NOT NULL GROUP BY k, i)), '') AS ids,
   type, array_to_string(pages, ',') AS pages, section, intent, level FROM w""",
    "route_plan": U + """, l AS (SELECT sample_idx, list_filter(CASE WHEN level = 'DOCUMENT' AND intent = 'count' THEN ['global_count'] WHEN level = 'DOCUMENT' AND intent = 'enumerate' THEN ['enumerate', CASE WHEN has THEN 'keyword_search' END]
   ELSE [CASE WHEN n_ids > 0 THEN 'find_by_id' END, CASE WHEN len(pages) > 0 THEN 'find_by_page' END, CASE WHEN section IS NOT NULL THEN 'find_by_section' END, CASE WHEN has OR (n_ids = 0 AND len(pages) = 0 AND section IS NULL) THEN 'keyword_search' END] END, lambda x: x IS NOT NULL) AS t
   FROM (SELECT *, EXISTS (SELECT 1 FROM kw WHERE kw.sample_idx = w.sample_idx) AS has FROM w)) SELECT sample_idx, unnest(range(len(t))) AS seq, unnest(t) AS tool FROM l""",
    "find_by_id": _BY_ID + " SELECT sample_idx, kind, id, edge_id, score FROM fi",
    "entity_key": _BY_ID + " SELECT DISTINCT sample_idx, edge_id, CASE WHEN score = 1.0 THEN 'entity_' || id ELSE 'page_' || page END AS entity FROM fi JOIN us USING (edge_id)",
    "find_by_page_units": U + """, p0 AS (SELECT sample_idx, doc_id, type, CAST(unnest(pages) AS INTEGER) AS p FROM w), p1 AS (SELECT DISTINCT sample_idx, doc_id, type, unnest([p - 1, p]) AS page FROM p0),
 pj AS (SELECT sample_idx, edge_id, us.page, p1.type IS NULL OR p1.type = us.type AS hit FROM p1 JOIN us USING (doc_id, page) WHERE page >= 0) SELECT sample_idx, edge_id, page, CASE WHEN hit THEN 0.95 ELSE 0.75 END AS score FROM pj QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY sample_idx)""",
    "section_filter": U + """, se AS (SELECT DISTINCT doc_id, edge_id FROM ed WHERE edge_type = 'containment' AND relation IN ('containment', 'section_contains_visual', 'section_contains_visuals')),
 sm AS (SELECT DISTINCT mb.doc_id, mb.edge_id, mb.pos, mb.block_id, n.type, n.text FROM mb JOIN se USING (doc_id, edge_id) JOIN n USING (doc_id, block_id)),
 st AS (SELECT doc_id, edge_id, arg_max({'x': text}, pos) FILTER (WHERE type IN ('title','section_header')) AS t, arg_max({'b': block_id, 'k': type}, pos) FILTER (WHERE lower(type) IN ('figure','table','chart','map','diagram','graph')) AS v FROM sm GROUP BY ALL),
 s2 AS (SELECT DISTINCT doc_id, t.x AS title, v.b AS block_id, lower(v.k) AS kind FROM st WHERE t IS NOT NULL AND v IS NOT NULL),
 fc AS (SELECT mb.doc_id, mb.block_id, arg_min(mb.edge_id, (cx.seq, mb.edge_id)) AS edge_id FROM mb JOIN cx USING (doc_id, edge_id) GROUP BY ALL),
 su AS (SELECT DISTINCT s2.doc_id, title, coalesce(fc.edge_id, s2.block_id || '_section_synthetic') AS edge_id, coalesce(us.type, kind) AS type FROM s2 LEFT JOIN fc USING (doc_id, block_id) LEFT JOIN us ON us.doc_id = s2.doc_id AND us.edge_id = fc.edge_id WHERE fc.edge_id IS NULL OR us.type IS NOT NULL) SELECT * FROM su""",
    "enumerate_items": _CANDS + r""", ei AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY seq, edge_id) AS item_no, lower(coalesce(caption,'')) AS l FROM cd WHERE intent = 'enumerate' AND held >= asked)
 SELECT sample_idx, item_no, CASE WHEN regexp_matches(l, '(figure|table|chart)\s*([0-9]+)') THEN upper(regexp_extract(l, '(figure|table|chart)\s*([0-9]+)', 1)[1]) || regexp_extract(l, '(figure|table|chart)\s*([0-9]+)', 1)[2:] || ' ' || regexp_extract(l, '(figure|table|chart)\s*([0-9]+)', 2) ELSE 'Item ' || item_no END AS item,
   edge_id, kind AS type, page + 1 AS page FROM ei""",
    "unit_keyword_topk": U + f""", mt AS (SELECT DISTINCT k.doc_id, k.keyword, us.edge_id, contains({_FOLD.format("coalesce(us.caption,'')")}, k.keyword) AS named FROM (SELECT DISTINCT doc_id, keyword FROM kw) k JOIN us ON us.doc_id = k.doc_id AND contains({_FOLD.format("us.text")}, k.keyword)),
 df AS (SELECT doc_id, keyword, count(DISTINCT edge_id) AS df FROM mt GROUP BY ALL), nn AS (SELECT doc_id, count(DISTINCT edge_id) AS n FROM us GROUP BY doc_id),
 w0 AS (SELECT kw.*, CASE WHEN coalesce(n,0) = 0 THEN 1.0 WHEN df IS NULL THEN ln(n+1) ELSE ln((n+1)/(df+1)::DOUBLE) END AS w0 FROM kw LEFT JOIN nn USING (doc_id) LEFT JOIN df USING (doc_id, keyword)),
 wi AS (SELECT *, CASE WHEN max(w0) OVER (PARTITION BY sample_idx) > 0 THEN w0/max(w0) OVER (PARTITION BY sample_idx) ELSE w0 END AS idf FROM w0),
 tt AS (SELECT sample_idx, sum(idf) AS ai FROM wi GROUP BY sample_idx),
 sc AS (SELECT wi.sample_idx, mt.edge_id, round(CASE WHEN any_value(ai) > 0 THEN sum(idf*CASE WHEN named THEN 1.0 ELSE 0.75 END)/any_value(ai) ELSE 0.0 END, 9) AS score, count(*) AS matched FROM wi JOIN mt USING (doc_id, keyword) JOIN tt ON tt.sample_idx = wi.sample_idx GROUP BY ALL)
 SELECT sample_idx, edge_id, round(score, 6) AS score, matched, row_number() OVER (PARTITION BY sample_idx ORDER BY score DESC, edge_id) AS rank FROM sc QUALIFY rank <= 5""",
    "unit_text": U + f""", x AS (SELECT DISTINCT doc_id, edge_id, pos, block_id, text, CASE WHEN ends_with(type, '_caption') AND type <> 'caption' THEN 0 ELSE 2 END AS part FROM ju WHERE NOT anchor AND trim(text) <> '' AND coalesce(type,'') NOT IN ('title','section_header')),
 y AS (SELECT doc_id, edge_id, string_agg(text, ' ' ORDER BY part, pos, block_id, text) AS text FROM x GROUP BY ALL) SELECT us.doc_id, us.edge_id, md5(coalesce(y.text, '')) AS text FROM us LEFT JOIN y USING (doc_id, edge_id)""",
    "block_by_id": E + ", b AS (SELECT doc_id, min(block_id) AS block_id FROM n GROUP BY doc_id), f AS (SELECT n.doc_id, n.block_id, min(type) AS type FROM n JOIN b USING (doc_id, block_id) GROUP BY ALL), p AS (SELECT document_id AS doc_id, min(x.page_id) AS page_id FROM (SELECT document_id, unnest(pages) AS x FROM hypergraphs) WHERE x.page_num = 0 GROUP BY ALL) SELECT f.*, page_id FROM f LEFT JOIN p USING (doc_id)",
    "page_containment": E + " SELECT DISTINCT doc_id, page, edge_id FROM ed WHERE edge_type = 'containment' AND page IS NOT NULL",
}
SQL["find_by_section"] = SQL["section_filter"].removesuffix(" SELECT * FROM su") + """, ws AS (SELECT sample_idx, doc_id, section, type AS want FROM w WHERE section IS NOT NULL),
 hs AS (SELECT ws.*, su.edge_id, su.type AS kind, false AS fell_back FROM ws JOIN su ON su.doc_id = ws.doc_id AND contains(lower(su.title), ws.section)),
 al AS (SELECT * FROM hs UNION SELECT ws.*, us.edge_id, us.type, true FROM ws JOIN us USING (doc_id) WHERE sample_idx NOT IN (SELECT sample_idx FROM hs))
 SELECT sample_idx, edge_id, 0.9 AS score, fell_back FROM al QUALIFY coalesce(kind = want, false) OR NOT bool_or(coalesce(kind = want, false)) OVER (PARTITION BY sample_idx)"""
SQL["global_count"] = _CANDS + ", kd AS (" + _KW.format(_DASH.format("k")).removeprefix("kw AS (") + f""",
 bt AS (SELECT doc_id, {_DASH.format('text')} AS t FROM (SELECT DISTINCT doc_id, block_id, page, text FROM ocr_blocks)),
 oc AS (SELECT kd.sample_idx, CAST(sum((length(t) - length(replace(t, keyword, '')))//length(keyword)) AS BIGINT) AS times FROM kd JOIN q0 USING (sample_idx) JOIN bt ON bt.doc_id = kd.doc_id AND contains(t, keyword) WHERE contains(q, 'how many time') GROUP BY ALL),
 cn AS (SELECT sample_idx, count(*) AS candidates, count(*) FILTER (WHERE held >= asked) AS held FROM cd WHERE intent = 'count' GROUP BY ALL), tp AS (SELECT document_id AS doc_id, max(total_pages) AS total FROM ocr_documents GROUP BY ALL),
 wp AS (SELECT w.*, CASE WHEN regexp_matches(q, 'how many pages (does|do|are|in|did|has)|total (number of )?pages|pages (does|do) (the )?(document|report|paper|file|newspaper) (have|contain|consist)') AND type IS NULL AND len(pages) = 0 THEN 'pages'
   WHEN contains(q, 'how many time') AND type IS NULL AND len(pages) = 0 THEN 'occurrences' WHEN regexp_matches(q, '(?s){T.VALUE_CUES}') AND NOT regexp_matches(q, '{T.STRUCTURE_CUES}') THEN 'value' ELSE 'units' END AS path FROM w WHERE intent = 'count')
 SELECT wp.sample_idx, CASE WHEN path = 'units' AND candidates IS NULL THEN 'none' ELSE path END AS path, CASE path WHEN 'pages' THEN total WHEN 'occurrences' THEN coalesce(times, 0) WHEN 'units' THEN held END AS n
   FROM wp LEFT JOIN cn USING (sample_idx) LEFT JOIN oc USING (sample_idx) LEFT JOIN tp ON tp.doc_id = wp.doc_id"""
