"""Vocabularies and record shapes of documents, layout blocks and hypergraphs."""

from __future__ import annotations

# Fixed values.
VISUAL_TYPES = ("figure", "table", "chart", "map", "diagram", "graph")
CAPTION_TYPES = ("figure_caption", "table_caption", "chart_caption", "map_caption", "diagram_caption", "graph_caption")
RELATED_TYPES = ("text", "title", *CAPTION_TYPES)
TITLE_TYPES = ("title", "section_header")
TEXT_TYPES = ("text", "title", "list", "figure_caption", "table_caption", "caption")
FURNITURE_TYPES = ("header", "footer")
RELATIONS = ("page_contains_visual", "section_contains_visual", "contextual", "document_contains_visuals", "page_contains_visuals", "section_contains_visuals")
HARD_TOOLS = ("find_by_id", "find_by_section", "find_by_page")
AGGREGATION_TOOLS = ("global_count", "enumerate")

BLOCK = "struct<block_id:bigint,page:int,bbox:array<double>,type:string,text:string,rec_conf:double>"
OCR_DOCUMENT = ("document_id string, pdf_path string, total_pages int, max_pages_processed int, "
                f"blocks array<{BLOCK}>, created_at string")
EDGE = ("struct<edge_id:string,edge_type:string,members:array<string>,meta:struct<hyperedge_id:string,relation:string,page_num:int,"
        "section_title:string,num_visuals:int,visual_types:map<string,int>,statistics:struct<has_caption:boolean,has_title:boolean,"
        "num_related_texts:int,total_blocks:int,page_span_size:int,is_cross_page:boolean,is_merged_block:boolean>>>")
QA_SAMPLE = ("doc_id string, doc_type string, question string, answer string, evidence_pages string, evidence_sources string, answer_format string")
INTENT = ("intent_type string, target struct<evidence_level:string,constraints:struct<id:string,type:string,page_range:array<string>,"
          "section_title:string,keywords:array<string>,spatial_hint:string>>")
INTENT_TYPES = ("locate", "count", "enumerate", "compare", "cross_reasoning")
EVIDENCE_LEVELS = ("UNIT", "MULTI_UNIT", "DOCUMENT")
