import json

from quire.operators.nested import array_levels, edge_children, flatten_levels, merged_schema

SCHEMA = ("document_id string, hyperedges array<struct<edge_id:string,edge_type:string,members:array<string>,meta:struct<relation:string,visual_types:map<string,int>,"
          "statistics:struct<has_caption:boolean,total_blocks:int>>>>, raw_record string, edge_id string")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_of_all_exporters(spark):
    native = [("e0", "containment", ["p", None, "a", "a"], ("r", {"map": 2}, (True, None)))]
    nested = {"document": {"graph": {"hyperedges": [
        {"edge_id": "x", "members": [{"block_id": "m0"}, None, {"ref": {"block": {"id": "m2"}}}], "meta": json.dumps({"statistics": {"has_caption": "false", "total_blocks": "3"}}),
         "children": [{"edge_id": "y", "members": [], "meta": {"visual_types": [{"type": "figure", "count": 2}]}, "children": [{"edge_id": "z", "members": None}]}]}]}}}
    data = [("d1", native, None, "clash"), ("d1", native, None, "clash"), ("d2", None, json.dumps(nested), None), ("d3", None, "{broken", None), ("d4", None, None, None), ("d5", [], None, None), (None, native, None, None)]
    got = found(edge_children(spark.createDataFrame(data, SCHEMA)).filter("document_id is not null"))
    assert got == sorted([
        ("d1", "e0", "member", 0, "p"), ("d1", "e0", "member", 2, "a"), ("d1", "e0", "member", 3, "a"), ("d1", "e0", "visual_type", 2, "map"), ("d1", "e0", "statistic", 1, "has_caption"),
        ("d2", "x", "member", 0, "m0"), ("d2", "x", "member", 2, "m2"), ("d2", "x", "statistic", 0, "has_caption"), ("d2", "x", "statistic", 3, "total_blocks"), ("d2", "x", "child_edge", 0, "y"),
        ("d2", "y", "visual_type", 2, "figure"), ("d2", "y", "child_edge", 0, "z")])
    assert found(edge_children(spark.createDataFrame([], SCHEMA))) == []


def test_generic_levels_link_to_parents(spark):
    docs = spark.createDataFrame([("a", '{"xs": [{"ys": [1, 2]}, {"ys": []}, null]}'), ("b", '{"xs": null, "zs": ["q"]}')], "id string, j string").selectExpr("id", "parse_json(j) as doc")
    schema = merged_schema(docs, "doc")
    assert array_levels(schema) == [("xs",), ("xs", "[]", "ys"), ("zs",)]
    t = flatten_levels(docs, "id", "doc", schema)
    xs, ys = t[("xs",)].collect(), t[("xs", "[]", "ys")].collect()
    assert len(xs) == 3 and len(ys) == 2
    assert {y.parent_sk for y in ys} == {x.sk for x in xs if x.ordinal == 0}
    assert [r.value.toPython() for r in t[("zs",)].collect()] == ["q"]
