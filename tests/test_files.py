from wirelattice.operators import experiments as ex
from wirelattice.operators import graph
from wirelattice.sources import files


def test_flow_folder_round_trip(spark, tmp_path):
    (tmp_path / "day1").mkdir()
    (tmp_path / "day1" / "a.csv").write_text(" Flow Duration , Label\n10,Benign\n20,Attack\n")
    (tmp_path / "b.csv").write_text(" Flow Duration , Label\n30,Benign\n")
    df = files.read_flows(spark, str(tmp_path), keep=["Benign"])
    assert df.columns == ["Flow Duration", "Label"] and df.count() == 2
    assert files.numeric_features(df).columns == ["Flow Duration", "Label"]


def test_cache_depends_on_the_whole_configuration(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for seed in (1, 1, 2):
        assert files.cached(spark, {"seed": seed, "missing": "mean"}, str(tmp_path), build).count() == 3
    assert len(built) == 2


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("a<1>", "ip"), ("b", "request")], "id string, type string")
    edges = spark.createDataFrame([("b", "a<1>", "fromIP")], "src string, dst string, rel string")
    import xml.etree.ElementTree as et

    for form in ("graphml", "gexf"):
        lines = [r["line"] for r in graph.graph_xml(nodes, edges, form).orderBy("part", "at").collect()]
        et.fromstring("\n".join(lines[1:]))
    text = [r["line"] for r in graph.mermaid(nodes, edges).orderBy("part", "at").collect()]
    assert text[0] == "graph TD" and len(text) == 4
    out = ex.latex_table(spark.createDataFrame([("random_forest", 0.9)], "method string, f1 double"), ["method", "f1"], "f1").orderBy("seq").collect()
    assert out[2]["line"] == "Random Forest & 0.900 \\\\"
    files.write_text(graph.mermaid(nodes, edges).orderBy("part", "at").select("line"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 4
