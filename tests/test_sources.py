import bz2
import csv
import json
import zipfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from textquarry.errors import CorpusReadError, InvalidInput, ModelExportError
from textquarry.operators.prepare import load_config, mapped, parse_config, prepare_file, select_news
from textquarry.sources import readers, sinks


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_tables(spark, tmp_path):
    body = 'id,text\n1,"a, ""b""\n c"\n2,\n'
    path = write(tmp_path / "a.csv", body)
    assert [tuple(r) for r in readers.read_table(spark, path, ("id",)).orderBy("id").collect()] == [("1", 'a, "b"\n c'), ("2", "")]
    packed = tmp_path / "a.csv.bz2"
    packed.write_bytes(bz2.compress(body.encode()))
    assert readers.read_table(spark, str(packed)).count() == 2
    assert readers.read_table(spark, write(tmp_path / "b.tsv", "x\ty\nж\t2\n", "cp1251"), (), "\t", "cp1251").first()["x"] == "ж"
    for text, required in (("id,text\n", ("label",)), ("", ()), ("id,id\n1,2\n", ())):
        with pytest.raises(CorpusReadError):
            readers.read_table(spark, write(tmp_path / "c.csv", text), required)
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_table(spark, write(tmp_path / "d.csv", "id,text\n1,2,3\n")).collect()
    with pytest.raises(InvalidInput):
        readers.read_table(spark, path, (), ";;")


def test_canonical_round_trip(spark, tmp_path):
    rows = [("b", ' two "q"\nlines ', "y", "test"), ("a", "one", "x", "train")]
    df = spark.createDataFrame(rows, "id string, text string, label string, split string")
    path = str(tmp_path / "c.csv")
    sinks.write_canonical(df, path)
    assert open(path, "rb").read() == 'id,text,label,split\na,one,x,train\nb," two ""q""\nlines ",y,test\n'.encode()
    assert sorted(tuple(r) for r in readers.read_canonical(spark, path).collect()) == sorted(rows)
    sinks.write_canonical(df.selectExpr("id", "text", "cast(null as string) label", "cast(null as string) split"), path)
    assert next(csv.reader(open(path))) == ["id", "text"]
    first = open(path, "rb").read()
    with pytest.raises(InvalidInput):
        sinks.write_canonical(df.union(df), path)
    assert open(path, "rb").read() == first


@pytest.mark.parametrize("body", ["id,text\n1,a\n1,b\n", "id,text\n1,a\n2,a\n", "id,text\n,a\n", "id,text\n1,\n", "id,text,label\n1,a,\n", "id,text,label\n1,a,x\n2,b,\n", "id,text,split\n1,a,dev\n", "id,text\n"])
def test_canonical_rules(spark, tmp_path, body):
    with pytest.raises(InvalidInput):
        readers.read_canonical(spark, write(tmp_path / "c.csv", body))


def test_canonical_header(spark, tmp_path):
    with pytest.raises(CorpusReadError):
        readers.read_canonical(spark, write(tmp_path / "c.csv", "text,id\na,1\n"))


def test_reviews(spark, tmp_path):
    ok = write(tmp_path / "r.csv", "review\tsentiment\nхорошо\tpositive\nтак\tneautral\n")
    assert readers.read_reviews(spark, ok).count() == 2
    for body in ("review\tlabel\na\tpositive\n", "review\tsentiment\n\tpositive\n", "review\tsentiment\na\tgreat\n", "review\tsentiment\nNA\tpositive\n"):
        with pytest.raises((CorpusReadError, InvalidInput)):
            readers.read_reviews(spark, write(tmp_path / "x.csv", body))


def test_same_documents_from_each_format(spark, tmp_path):
    rows = [("a.txt", "a.txt", "Первый\nтекст"), ("sub/б в.TXT", "б в.TXT", "второй, +"), ("z.txt", "z.txt", "третий")]
    folder = tmp_path / "documents.csv"
    (folder / "sub").mkdir(parents=True)
    for i, _, text in rows:
        write(folder / i, text)
    write(folder / "skip.md", "нет")
    lines = "\n".join(json.dumps({"_id": i, "title": t, "text": x}, ensure_ascii=False) for i, t, x in rows) + "\n\n"
    jsonl = write(tmp_path / "d.JSONL", lines)
    packed = tmp_path / "d.zip"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("other.txt", "x")
        z.writestr("corpus.jsonl", lines)
    table = tmp_path / "d.csv"
    with open(table, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([("id", "title", "text", "extra"), *[(*r, "e") for r in rows]])
    for path in (str(folder), jsonl, str(packed), str(table)):
        found = readers.read_corpus(spark, path)
        assert [tuple(r)[:3] for r in found.orderBy("seq").collect()] == rows, path
        assert readers.read_until(found, 1).first()["id"] == "a.txt"
    with pytest.raises(InvalidInput):
        readers.read_corpus(spark, str(tmp_path / "none.doc"))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x", "y")
    with pytest.raises(CorpusReadError):
        readers.read_corpus(spark, str(tmp_path / "e.zip"))


@pytest.mark.parametrize("line", ['{"_id": null, "text": "a"}', '{"text": "a"}', '{"_id": "1", "text": 5}', '{"_id": "1"}', "{bad", '{"_id": [1], "text": "a"}'])
def test_bad_lines(spark, tmp_path, line):
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_json_lines(spark, write(tmp_path / "x.jsonl", '{"_id": 7, "text": "ok"}\n' + line + "\n")).collect()


def test_scalar_ids(spark, tmp_path):
    found = readers.read_json_lines(spark, write(tmp_path / "x.jsonl", '{"_id": 7, "text": "ok"}\n')).first()
    assert (found["id"], found["title"]) == ("7", "")


def test_queries_and_judgments(spark, tmp_path):
    queries = readers.read_queries(spark, write(tmp_path / "q.jsonl", '{"_id": "q1", "text": "a"}\n\n{"_id": "q2", "text": "b"}\n'))
    good = '{"query-id": "q1", "corpus-id": "d1", "score": 1}\n{"query-id": "q1", "corpus-id": "d2", "score": 0}\n'
    assert [tuple(r) for r in readers.read_judgments(spark, write(tmp_path / "r.jsonl", good), queries).collect()] == [("q1", "d1", 1)]
    for line in ('{"query-id": "q1", "corpus-id": "d1", "score": 1}', '{"query-id": "q9", "corpus-id": "d1", "score": 1}', '{"query-id": "q1", "corpus-id": "d3", "score": 1.5}', '{"query-id": "q1", "corpus-id": "d3", "score": -1}'):
        with pytest.raises(CorpusReadError):
            readers.read_judgments(spark, write(tmp_path / "r.jsonl", good + line + "\n"), queries)
    for body in ('{"_id": " ", "text": "a"}\n', '{"_id": "q"}\n', '{"_id": "q", "text": "a"}\n{"_id": "q", "text": "b"}\n'):
        with pytest.raises(CorpusReadError):
            readers.read_queries(spark, write(tmp_path / "q.jsonl", body))


def test_rendering(tmp_path):
    assert sinks.render({"a": 1, "б": "в"}) == "a: 1\nб: в"
    assert sinks.render({"б": 1}, "json") == '{"б":1}'
    sinks.write_json({"b": 1, "a": "ж"}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text("utf-8") == '{\n  "a": "ж",\n  "b": 1\n}\n'
    with pytest.raises(InvalidInput):
        readers.query_text("a", "b")


def test_collections_are_not_overwritten(spark, tmp_path):
    docs = spark.createDataFrame([("d", "t", 'x "y"\nz', 0)], "id string, title string, text string, seq long")
    queries, qrels = spark.createDataFrame([("q", "a", 0)], "query_id string, text string, seq long"), spark.createDataFrame([("q", "d", 1)], "query_id string, doc_id string, score int")
    target = str(tmp_path / "c")
    manifest = sinks.write_collection(docs, queries, qrels, target, {"seed": 1})
    assert manifest["sha256"]["corpus.csv"] == sinks.checksum(tmp_path / "c/corpus.csv")
    assert (tmp_path / "c/qrels.jsonl").read_text() == '{"query-id":"q","corpus-id":"d","score":1}\n'
    with pytest.raises(ModelExportError):
        sinks.write_collection(docs, queries, qrels, target, {})


CONFIG = """
[dataset]
format = "csv"
[columns]
text = ["title", "body"]
label = "kind"
[cleaning]
empty = "drop"
labels = { neautral = "neutral" }
duplicates = "keep"
conflicts = "majority"
tie = "drop"
[split]
enabled = true
train = 65
validation = 10
test = 25
[sampling]
per_split = { train = 4, test = 1 }
[expect]
rows = 10
classes = 2
splits = { train = 80, test = 20 }
"""


def test_preparation(spark, tmp_path):
    rows = "title,body,kind\n" + "".join(f"t,текст {i},{'neautral' if i % 2 else 'good'}\n" for i in range(40)) + ",,good\nt,текст 1,neutral\n"
    source, config = write(tmp_path / "s.csv", rows), write(tmp_path / "c.toml", CONFIG)
    out = [str(tmp_path / n) for n in ("a.csv", "b.csv")]
    summary = prepare_file(spark, source, out[0], load_config(config))
    assert (summary["input_rows"], summary["rows"], summary["splits"]) == (42, 10, {"test": 2, "train": 8})
    assert summary["classes"] == {"good": 5, "neutral": 5}
    prepare_file(spark, source, out[1], load_config(config))
    assert open(out[0], "rb").read() == open(out[1], "rb").read()
    first = readers.read_canonical(spark, out[0]).first()
    assert first["id"].startswith("sha256:") and first["text"].startswith("t текст")
    bad = write(tmp_path / "bad.toml", CONFIG.replace("rows = 10", "rows = 11"))
    with pytest.raises(InvalidInput):
        prepare_file(spark, source, str(tmp_path / "n.csv"), load_config(bad))
    assert not (tmp_path / "n.csv").exists()


@pytest.mark.parametrize(("trim", "kept"), [(True, 1), (False, 2)])
def test_untrimmed_blanks_are_a_text(spark, trim, kept):
    df = spark.createDataFrame([("a",), ("  ",), ("",), (None,)], "t string")
    assert mapped(df, parse_config(BASE | {"cleaning": {"trim": trim, "empty": "drop"}})).count() == kept


BASE = {"dataset": {"format": "csv"}, "columns": {"text": "t"}}


@pytest.mark.parametrize(
    "change",
    [
        {"dataset": {"format": "xml"}}, {"dataset": {"format": "csv", "delimiter": ";;"}}, {"columns": {"text": []}}, {"columns": {"text": ["a", "a"]}}, {"columns": {}}, {"other": {}}, {"cleaning": {"x": 1}},
        {"cleaning": {"trim": "yes"}}, {"split": {"enabled": True}}, {"columns": {"text": "t", "label": "l", "split": "s"}, "split": {"enabled": True}}, {"split": {"train": 50}}, {"split": {"train": True, "test": 99}}, {"split": {"train": float("nan")}}, {"sampling": {"per_class": 0}},
        {"sampling": {"per_split": 3}}, {"sampling": {"per_split": {"dev": 1}}}, {"expect": {"rows": -1}}, {"expect": {"splits": {"train": 99}}}, {"adapter": {"path": ""}},
    ],
)
def test_configuration_errors(change):
    parse_config(BASE)
    with pytest.raises(InvalidInput):
        parse_config(BASE | change)


def test_news(spark):
    rows = [(f"u{i}", f"t{i}", f"текст {i}", ["Россия", "Мир"][i % 2]) for i in range(40)] + [("u1", "x", "y", "Мир"), ("v", "t3", "текст 3", "Мир"), ("w", "", "a", "Мир"), ("s", "a", "b", "Дом")]
    df = spark.createDataFrame(rows, "url string, title string, text string, topic string")
    corpus, counts = select_news(df, ("Россия", "Мир"), 10)
    got = corpus.collect()
    assert len(got) == 20 and counts == {"input_rows": 44, "dropped_rows": 24}
    assert not {"u1", "v", "w", "s"} & {r["id"] for r in got}
    assert sum(r["split"] == "test" for r in got) == 4 and "\n" in got[0]["text"]


def adapter(spark, path, parameters):
    return spark.createDataFrame([("1", path, parameters["label"], "train")], "id string, text string, label string, split string"), {"input_rows": 5}


def test_adapters(spark, tmp_path):
    config = parse_config(BASE | {"adapter": {"path": f"{__name__}:adapter", "parameters": {"label": "x"}}})
    summary = prepare_file(spark, "source", str(tmp_path / "o.csv"), config, label="y")
    assert summary["dropped_rows"] == 4 and summary["classes"] == {"y": 1}
    for path in ("nowhere:x", f"{__name__}:none", "plain"):
        with pytest.raises(InvalidInput):
            prepare_file(spark, "s", str(tmp_path / "p.csv"), parse_config(BASE | {"adapter": {"path": path}}))
