import json

from quern.cli import Prompt


def test_a_session(spark, tmp_path):
    path = lambda *p: [[x] for x in p]
    column = lambda name, tag, *target: {"path": path(name), "type": {"tag": tag, **({"path": path(*target)} if target else {})}}
    entity = lambda name, *cols: {"path": path("T", name), "value": {"entityVariant": {"tag": "table"}, "columns": list(cols), "primaryKey": None}}
    law = {"path": path("T", "E", "fk"), "value": {"ruleVariant": "enforced", "varNames": [path("a")], "varTypes": [], "antecedents": [{"tag": "atom", "atom": {"entity": path("T", "E"), "rowId": None, "values": [{"column": 0, "term": {"tag": "var", "index": 0}}]}}], "consequents": [{"tag": "atom", "atom": {"entity": path("T", "V"), "rowId": {"tag": "var", "index": 0}, "values": []}}]}}
    theory = tmp_path / "t.json"
    theory.write_text(json.dumps({"entities": [entity("V", column("n", "builtinInt")), entity("E", column("a", "rowId", "T", "V"))], "rules": [law]}))
    (tmp_path / "v.csv").write_text("n\n7\n8\n")
    said = list(Prompt(spark).session([
        ".tables", f".load {theory}", ".tables", ".schema", ".rules", "begin transact; add T.V values 5 as v; add T.E values v; commit;",
        "add T.V values 'no'", "add T.V values 6", f"COPY T.V FROM '{tmp_path}/v.csv' WITH (FORMAT csv, HEADER true)", ".dump T.V", f".save {tmp_path}/s", f".open {tmp_path}/s", "what", ".exit", ".tables",
    ]))
    assert said[0].startswith("error") and said[2] == "T.V\nT.E" and "T.E(a T.V)" in said[3] and "T.E.fk" in said[4]
    assert said[8].startswith("committed") and said[9].startswith("error") and said[10].startswith("committed") and said[11].startswith("committed")
    assert all(f"|{n}" in said[12].replace(" ", "") for n in (5, 6, 7, 8)) and said[14] == "3 commits" and said[15].startswith("error") and len(said) == 16
