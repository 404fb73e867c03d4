import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom import schemas
from lexloom.operators import stats
from lexloom.sources import readers, writers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b")])
    path = put(tmp_path / "x.csv", 'a,b\n"he said ""no""","two\nlines"\nplain,NA\n')
    assert [tuple(r) for r in readers.read_csv(spark, path, schema, na=schemas.NA_STRINGS).collect()] == [('he said "no"', "two\nlines"), ("plain", None)]
    out = str(tmp_path / "out")
    df = readers.read_csv(spark, path, schema)
    writers.write_csv(df, out)
    assert sorted(map(tuple, readers.read_csv(spark, out, schema).collect())) == sorted(map(tuple, df.collect()))


def test_csv_index(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9)], "a long")
    writers.write_csv(df, str(tmp_path / "o"), index=True, order=["a"])
    rows = spark.read.csv(str(tmp_path / "o"), header=True).collect()
    assert sorted(tuple(r) for r in rows) == [("0", "3"), ("1", "5"), ("2", "9")]


def test_tsv_keeps_stray_quotes(spark, tmp_path):
    path = put(tmp_path / "e.tsv", '1\tT1\tCHEMICAL\t0\t3\t"abc\n1\tT2\tGENE-Y\t10\t14\tXYZ1\n2\tT1\tGENE-N\t0\t2\tNA\n')
    got = [tuple(r) for r in readers.read_tsv(spark, path, schemas.ENTITIES).collect()]
    assert got == [(1, "T1", "CHEMICAL", 0, 3, '"abc'), (1, "T2", "GENE-Y", 10, 14, "XYZ1"), (2, "T1", "GENE-N", 0, 2, None)]


def test_json_shapes(spark, tmp_path):
    keyed = put(tmp_path / "k.json", json.dumps({"11": {"QUESTION": "q", "CONTEXTS": ["a", "b"], "final_decision": "yes"}, "12": {"QUESTION": "r"}}))
    rows = {r.pmid: r for r in readers.read_keyed_json(spark, keyed, schemas.KEYED_QUESTION).collect()}
    assert rows["11"].CONTEXTS == ["a", "b"] and rows["12"].CONTEXTS is None
    array = put(tmp_path / "a.json", json.dumps([{"tokenized_text": ["x"], "ner": [{"start_tok": 0, "end_tok": 0, "label": "G"}]}]))
    assert readers.read_json_array(spark, array, schemas.ANNOTATED).collect()[0].validated is None
    lines = put(tmp_path / "l.jsonl", '{"question":"q","answer":"a","contexts":["c"],"ground_truth":"g"}\n')
    assert readers.read_json_lines(spark, lines, schemas.RAG_SAMPLES).collect()[0].contexts == ["c"]


def test_span_annotations(spark, tmp_path):
    path = put(tmp_path / "s.json", json.dumps({"classes": ["G"], "annotations": [["ab cd", {"entities": [[0, 2, "G"], [3, 5, "C"]]}], ["none", {"entities": []}]]}))
    got = {r.text: [tuple(e) for e in r.entities] for r in readers.read_span_annotations(spark, path).collect()}
    assert got == {"ab cd": [(0, 2, "G"), (3, 5, "C")], "none": []}


def test_plain_texts_and_documents(spark, tmp_path):
    put(tmp_path / "t.txt", "one\ntwo\n")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    assert readers.read_whole_texts(spark, str(tmp_path / "t.txt")).collect()[0].text == "one\ntwo\n"
    df = spark.createDataFrame([(7, "x", None)], "PubMedID long, Text string, Note string")
    row = readers.rows_as_documents(df, "PubMedID").collect()[0]
    assert row.page_content == "Text: x\nNote: " and row.metadata == {"source": "7"}
    assert readers.empty(spark, "a int").count() == 0 and readers.from_rows(spark, [(1,)], "a int").count() == 1
    assert [r.a for r in readers.rows_by_position(spark.createDataFrame([(3,), (1,), (2,)], "a int"), ["a"], 1, 1).collect()] == [2]
    copied = readers.copy_into(spark, str(tmp_path / "t.txt"), str(tmp_path / "data"))
    assert copied.endswith("t.txt") and readers.list_folder(spark, str(tmp_path / "data"))[-1] == "t.txt"


def test_resume_and_in_place(spark, tmp_path):
    done, calls = str(tmp_path / "done"), []
    df = spark.createDataFrame([(i, i * i) for i in range(6)], "k long, v long")

    def step(batch):
        calls.append(sorted(r.k for r in batch.collect()))
        return batch

    writers.resume(df.where("k < 3"), done, "k", step)
    writers.resume(df, done, "k", step)
    assert calls == [[0, 1, 2], [3, 4, 5]] and spark.read.parquet(done).count() == 6
    writers.overwrite_in_place(spark.read.parquet(done).where("k > 3"), done)
    assert sorted(r.k for r in spark.read.parquet(done).collect()) == [4, 5]


def test_small_exports(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1), (None, 2)], "x string, n long")
    assert "<td>a&lt;b</td>" in writers.html_table(df)
    assert json.loads(writers.json_array(df.where("n = 1"))) == [{"x": "a<b", "n": 1}]
    with pytest.raises(ValueError):
        writers.html_table(df, limit=1)
    writers.write_folds(df.withColumn("fold", F.lit(0)).withColumn("split", F.lit("val")), str(tmp_path / "f"))
    assert (tmp_path / "f" / "fold=0" / "split=val").is_dir()
    assert stats.drop_matching(df.withColumn("Unnamed: 0", F.lit(1)), "^Unnamed").columns == ["x", "n"]
