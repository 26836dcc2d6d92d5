import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from itemforge.operators.identity import Property
from itemforge.sinks import writers
from itemforge.sources import readers
from itemforge.streaming import crawl, hook


@pytest.fixture()
def dataset(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
        return str(path)
    put.root = str(tmp_path)
    return put


def test_discovery(spark, dataset):
    for name in ("a.csv", "sub/b.md", "_hidden/c.csv", "evalset/d.csv", "eval-set.csv", "workspace/e.csv", "f.bin", ".dot/deep/er/g.csv", "sub/_h.csv"):
        dataset(name, "x,y\n1,2\n")
    names = lambda rule: [r["relative_path"] for r in readers.discover(spark, dataset.root, ["csv", ".MD"], rule=rule).collect()]
    assert names("enrich") == [".dot/deep/er/g.csv", "a.csv", "sub/_h.csv", "sub/b.md"]
    assert names("identity") == [".dot/deep/er/g.csv", "a.csv", "eval-set.csv", "sub/b.md"]
    assert len(names("profile")) == 8
    one = readers.discover(spark, f"{dataset.root}/a.csv").collect()
    assert [(r["ext"], r["bytes"]) for r in one] == [("csv", 8)]
    assert readers.default_extensions(readers.discover(spark, dataset.root)) is None
    assert {r["path"] for r in readers.file_hashes(spark, dataset.root, ["csv"]).collect()} == {"a.csv", "eval-set.csv"}


def test_tables(spark, dataset):
    one = dataset("a.csv", chr(0xFEFF) + 'a;b;a\n1;"x;""y""";3\n\n4;5\n')
    (header, rows), = readers.read_table(spark, [one], root=dataset.root)
    assert header == ["a", "b"]
    assert [(r["source_row"], r["a"], r["b"]) for r in rows.orderBy("source_row").collect()] == [(1, "3", 'x;"y"'), (2, "", "5")]
    multi = dataset("m.csv", 'a,\n"line1\nline2",2\n , \n')
    (header, rows), = readers.read_table(spark, [multi], multi_line=True, blank_names=True)
    assert header == ["a", "column_2"] and [r["a"] for r in rows.collect()] == ["line1\nline2"]


def test_lines_and_json(spark, dataset):
    path = dataset("r.json", "\n".join(json.dumps({"duns": str(i), "nested": {"k": i}, **({"late": True} if i > 2 else {})}) for i in range(4)))
    lines = readers.read_lines(spark, path, dataset.root)
    assert sorted(r["line"] for r in lines.collect()) == [1, 2, 3, 4]
    assert [r["source_file"] for r in readers.json_lines_files(lines).collect()] == ["r.json"]
    header, rows = readers.json_lines_table(readers.read_json_records(lines))
    assert header == ["duns", "nested", "late"] and rows.filter("source_row = 1").first()["late"] == ""
    array = dataset("arr.json", '[{"a": 1}, 5, "x"]')
    docs = readers.read_json_documents(readers.read_documents(spark, array))
    assert [json.loads(r["json"]) for r in docs.orderBy("ordinal").collect()] == [{"a": 1}, {"value": 5}, {"value": "x"}]


def test_line_numbers_over_many_splits(spark, dataset):
    path = dataset("big.txt", "\n".join(f"row {i}" for i in range(1, 20001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.read_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 20000 and all(r["value"] == f"row {r['line']}" for r in rows)


def quoted_rows(text):
    """Records by single characters: a quote opens or closes, a doubled one inside is a quote."""
    rows, row, cell, inside, at = [], [], "", False, 0
    while at < len(text):
        if text[at] == '"':
            if inside and text[at + 1:at + 2] == '"':
                cell, at = cell + '"', at + 1
            else:
                inside = not inside
        elif text[at] in ",\n" and not inside:
            row, cell = [*row, cell], ""
            if text[at] == "\n":
                rows, row = [*rows, row], []
        else:
            cell += text[at]
        at += 1
    rows += [[*row, cell]] if cell or row else []
    return [r for r in rows if any(c.strip() for c in r)]


def test_quoted_line_breaks_over_many_splits(spark, dataset):
    rng = random.Random(3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        paths, want = [], set()
        for name in ("one.csv", "two.csv"):
            out = io.StringIO()
            table = csv.writer(out, lineterminator="\n")
            table.writerow(["a", "b\nx", "c"])
            for i in range(150):
                k = rng.random()
                table.writerow(["", "", ""] if k < 0.1 else ["\n\n", "  ", ""] if k < 0.15 else [str(i), rng.choice(['x', 'multi\nline "q"\n\n,' * rng.randint(1, 40), '"', "a,b"]), "é" * rng.randint(0, 20)])
            paths.append(dataset(name, out.getvalue()))
            want |= {(name, i, *[*r, "", ""][:3]) for i, r in enumerate(quoted_rows(out.getvalue())) if i}
        (header, rows), = readers.read_table(spark, paths, multi_line=True, root=dataset.root)
        assert header == ["a", "b\nx", "c"] and rows.rdd.getNumPartitions() > 20
        found = rows.collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_line_numbers_move_no_rows(spark, dataset):
    plan = readers.read_lines(spark, dataset("few.txt", "a\nb\n"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_eval_items(spark, dataset):
    path = dataset("e.json", json.dumps({"items": [{"prompt": "q", "assertions": [{"type": "must_contain", "value": "v", "wholeWord": True}, {"type": "other", "value": "w"}],
                                                  "supporting_facts": ["a=1", "b"], "source_location": "A.csv:row 4"}]}))
    row = readers.read_eval_items(spark, path).collect()[0]
    assert row["eval_id"] == "eval-1" and row["assertions"] == ["v"] and [tuple(f) for f in row["facts"]] == [("a", "1")]


def test_runs(spark, dataset):
    for i, mode in enumerate(("build", "provision")):
        dataset(f"j{i}/job.json", json.dumps({"id": f"j{i}", "createdAt": f"2024-01-0{i + 1}", "config": {"mode": mode, "noEnhance": bool(i)}}, indent=1))
    runs = readers.read_runs(spark, dataset.root)
    assert [r["run_id"] for r in runs.collect()] == ["j1", "j0"]
    assert [r["run_id"] for r in readers.filter_runs(runs, mode="build").collect()] == ["j0"]


SCHEMA = [Property("title", "String", aliases=["name"]), Property("url", "String"), Property("n", "Int64")]


def start(spark, base, version="v1"):
    return crawl.crawl(spark, f"{base}/in", raw_schema="id string, name string, n string", schema=SCHEMA, target=f"{base}/items",
                       quarantine=f"{base}/bad", checkpoint=f"{base}/ckpt", version=version)


def test_crawl_is_idempotent_and_incremental(spark, dataset):
    base = dataset.root
    dataset("in/a.jsonl", '{"id":"1","name":"one","n":"7x"}\n{"id":"2","name":"two"}\n{"name":"no id"}\n\n{broken\n')
    start(spark, base).awaitTermination()
    start(spark, base).awaitTermination()
    items = {r["id"]: r["properties"] for r in writers.latest_items(spark, f"{base}/items").collect()}
    assert items == {"1": {"title": "one", "url": "file:///external-items/1", "n": "7"}, "2": {"title": "two", "url": "file:///external-items/2"}}
    assert spark.read.parquet(f"{base}/bad/rows").count() == 2
    dataset("in/b.jsonl", '{"id":"2","name":"newer"}\n')
    start(spark, base).awaitTermination()
    items = {r["id"]: r["properties"]["title"] for r in writers.latest_items(spark, f"{base}/items").collect()}
    assert items == {"1": "one", "2": "newer"}


def test_budget_is_kept_over_batches_and_restarts(spark, dataset):
    base = dataset.root
    for i, bad in enumerate((3, 0, 4)):
        dataset(f"in/{i}.jsonl", f'{{"id":"{i}","name":"n"}}\n' + '{"name":"no id"}\n' * bad)
        start(spark, base).awaitTermination()
        assert crawl.failures_so_far(spark, f"{base}/bad", "v1", i) == (3, 3, 7)[i]
    dataset("in/3.jsonl", '{"id":"3","name":"n"}\n' + "{broken\n" * 3)
    for _ in range(2):  # the batch is tried again and counts once
        with pytest.raises(Exception, match="10 records failed"):
            start(spark, base).awaitTermination()
    assert {r["id"] for r in writers.latest_items(spark, f"{base}/items").collect()} == {"0", "1", "2"}


def test_newest_line_of_a_file_wins(spark, dataset):
    lines = [json.dumps({"id": str(i % 50), "name": f"n{i}"}) for i in range(5_000)]
    dataset("in/a.jsonl", "\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        start(spark, dataset.root).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    items = {r["id"]: r["properties"]["title"] for r in writers.latest_items(spark, f"{dataset.root}/items").collect()}
    assert items == {str(i): f"n{4_950 + i}" for i in range(50)}


def test_source_hook_in_batch_and_stream(spark, dataset):
    class Blocks:
        """Raw items of a hook; the folder's files are its blocks."""

        def __init__(self, options):
            self.folder = options["folder"]

        def blocks(self):
            import os
            return len(os.listdir(self.folder))

        def read(self, block):
            with open(f"{self.folder}/{block}.txt", encoding="utf-8") as f:
                for line in f:
                    yield {"id": line.strip(), "name": f"{line.strip()} of {block}"}

    hook.register(spark, "block_items", lambda options: Blocks(options))
    base = dataset.root

    def run(checkpoint="ckpt"):
        crawl.crawl(spark, hook.stream(spark, "block_items", folder=f"{base}/blocks"), raw_schema="id string, name string", schema=SCHEMA, target=f"{base}/items",
                    quarantine=f"{base}/bad", checkpoint=f"{base}/{checkpoint}", version="v1").awaitTermination()
        return {r["id"]: r["properties"]["title"] for r in writers.latest_items(spark, f"{base}/items").collect()}
    dataset("blocks/0.txt", "a\nb\n")
    assert run() == {"a": "a of 0", "b": "b of 0"}
    dataset("blocks/1.txt", "b\nc\n")
    dataset("blocks/2.txt", "c\n")
    want = {"a": "a of 0", "b": "b of 1", "c": "c of 2"}
    assert run() == want and run() == want
    assert run("another") == want  # everything once more, as one batch
    rows = hook.read(spark, "block_items", folder=f"{base}/blocks").orderBy("block", "at").collect()
    assert [(json.loads(r.value)["id"], r.block, r.at) for r in rows] == [("a", 0, 0), ("b", 0, 1), ("b", 1, 0), ("c", 1, 1), ("c", 2, 0)]


def test_compaction_changes_no_item(spark, tmp_path):
    target = f"{tmp_path}/items"

    def put(version, batch, rows):
        writers.upsert_batch(spark.createDataFrame(rows, "id string, n long, place long"), target, version, batch, "place")

    def now():
        return {r.id: r.n for r in writers.latest_items(spark, target).collect()}
    put("v9", 0, [("a", 1, 0), ("b", 2, 0), ("a", 3, 1)])
    put("v10", 0, [("b", 4, 0)])
    assert now() == {"a": 3, "b": 4} and writers.compact(spark, target) == 2
    assert now() == {"a": 3, "b": 4} and writers.compact(spark, target) == 0
    put("v9", 1, [("b", 5, 0), ("c", 6, 0)])  # older than the base's row of b
    put("v10", 0, [("b", 4, 0)])  # a replay of what the base holds
    assert now() == {"a": 3, "b": 4, "c": 6} and writers.compact(spark, target) == 1 and now() == {"a": 3, "b": 4, "c": 6}
    put("v11", 0, [("a", 7, 0)])
    assert now() == {"a": 7, "b": 4, "c": 6}
    (tmp_path / "items/base/_half").mkdir()  # what a compaction that broke off leaves
    assert now() == {"a": 7, "b": 4, "c": 6}


def test_crawl_stops_on_too_many_failures(spark, dataset):
    dataset("in/a.jsonl", '{"name":"no id"}\n' * 10)
    with pytest.raises(Exception, match="failed to map"):
        start(spark, dataset.root).awaitTermination()


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("i", {"title": "T", "chunkIndex": "0"}, 'say "hi", ok', [])],
                                  "id string, properties map<string,string>, content string, acl array<struct<type:string,value:string,accessType:string>>")
    writers.write_items(items, f"{tmp_path}/items")
    assert json.loads(spark.read.text(f"{tmp_path}/items").first()[0]) == {"id": "i", "properties": {"title": "T", "chunkIndex": "0"}, "content": {"type": "text", "value": 'say "hi", ok'}}
    writers.write_flat_table(items, f"{tmp_path}/flat")
    row = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/flat").first()
    assert row["content"] == 'say "hi", ok' and row["chunkIndex"] in (None, "")
    with pytest.raises(ValueError):
        writers.require_items(items.filter(F.lit(False)), ["csv"], ["json"])
