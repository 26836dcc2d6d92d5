import json

from pyspark.sql import functions as F

from itemforge.functions import chunks, json_tree, names
from itemforge.functions import numbers as nm
from itemforge.functions import text as tx
from itemforge.functions.fixed import WS_CODES
from itemforge.session import spread


def values(spark, items, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r[1] for r in rows.select("i", build(F.col("v"))).orderBy("i").collect()]


def test_fold(spark):
    words = ["caf" + chr(0xE9), "cafe" + chr(0x301), chr(0xFB01) + "le", "".join(map(chr, (0xFF21, 0xFF22, 0xFF23))),
             "".join(map(chr, (0xFF11, 0xFF12, 0xFF13))), "Hello, World!", "MiXeD", ""]
    assert values(spark, words, tx.fold) == ["cafe", "cafe", "file", "abc", "123", "hello, world!", "mixed", ""]


def test_rounding(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, -0.5, -1.5, -2.5)], "v double")
    assert [r[0] for r in rows.select(nm.round_half_up(F.col("v"), 0)).collect()] == [1, 2, 3, 0, -1, -2]


def test_prose(spark):
    sentence = "This is a plain sentence with quite a number of ordinary words that goes on for a while, really."
    others = ["short text", "https://example.com/" + "a" * 90, "12345678-1234-1234-1234-123456789012", '{"a": "' + "b c " * 30 + '"}', "a" * 150, "1 2 3 4 5 6 7 8 9 " * 8]
    assert values(spark, [sentence, *others], tx.is_prose) == [True] + [False] * len(others)


def test_clean_and_entities(spark):
    raw = "a&nbsp;&amp;lt;\r\n\t b  c \r\n\n\n\n" + chr(0xA0) + "&#65;&#x42;&#0; end"
    assert values(spark, [raw], tx.clean_content) == ["a <\nb c\n\nAB\x00 end"]


def test_references_and_facts(spark):
    refs = values(spark, ["A.csv:row 2, x/B.TSV:row 10; c:row 3"], tx.row_references)[0]
    assert [(r["file"], r["row"]) for r in refs] == [("a.csv", 2), ("x/b.tsv", 10)]
    assert values(spark, ["a = b=c", "plain", "=x"], tx.fact_value) == ["b=c", "plain", "x"]
    assert values(spark, ["a = b=c", "plain", "=x"], tx.fact_key) == ["a", None, None]


def test_names(spark):
    assert names.unique_names([names.plain_base(n) for n in ("First Name", "first.name", "first-name")], first_suffix=1) == ["FirstName", "firstName", "firstName1"]
    samples = ["user_id", "9lives", "__", "a" * 40, "two words-Here"]
    assert values(spark, samples, names.search_name) == [names.search_base(s) for s in samples]
    assert values(spark, samples, names.plain_name) == [names.plain_base(s) for s in samples]


def test_chunking_cases(spark):
    def packed(text, size=2000, overlap=200):
        return values(spark, [text], lambda c: chunks.packed_chunks(c, size, overlap))[0]

    def windows(text, size=2000, overlap=200):
        return values(spark, [text], lambda c: chunks.window_chunks(c, size, overlap))[0]
    assert packed("a" * 2500 + "\n\ntail") == ["a" * 2500, "a" * 200 + "\n\ntail"]
    assert packed("one\n\n\n two \n\nthree") == ["one\n\ntwo\n\nthree"] and packed("\n\n") == []
    assert packed("x" * 60 + "\n\n" + "y" * 60, 100, 0) == ["x" * 60, "y" * 60]
    cuts = windows("word " * 1000)
    assert all(len(c) <= 2001 for c in cuts) and cuts[0].startswith("word") and len(cuts) == 3
    assert windows("") == [] and windows(None) is None and windows("short") == ["short"]
    assert windows("ab cd ef gh", 5, 0) == ["ab cd", "ef gh"]
    assert windows("aaaa. bbb", 4, 0) == ["aaaa.", "bbb"]  # a sentence end that straddles the limit
    assert windows("é" * 4500) == ["é" * 2000, "é" * 2000, "é" * 900]
    # the only mark of a window stands near its start: windows move on by one character, far more often than usual
    stuck = "ab " + "c" * 12
    want, at = [], 0
    while True:
        end = min(len(stuck), at + 6)
        mark = stuck.rfind(" ", at, end + 1) if end < len(stuck) else -1
        end = mark + 1 if mark > at else end
        want += [stuck[at:end].strip()]
        if end >= len(stuck):
            break
        at = max(end - 5, at + 1)
    assert windows(stuck, 6, 5) == want


def test_flatteners(spark):
    from pyspark.sql import functions as F

    from itemforge.functions import json_tree
    record = {"id": "a", "address": {"city": "NYC", "zip": "10001"}, "tags": ["x", "y"], "gone": None, "rows": [{"n": 1}, {"n": 2}], "deep": {"b": {"c": [[1, None], "z"], "d": {}}}, "price": 12345678.9}
    rows = spark.createDataFrame([(json.dumps(record),), ('[1,{"a":2}]',), ("no json",)], "v string")
    found = json_tree.with_eval_entries(json_tree.with_identity_entries(rows, "v", "i"), "v", "e").withColumn("c", json_tree.canonical_json(F.col("v"))).collect()
    assert {e.key: e.value for e in found[0].i} == {"id": "a", "address.city": "NYC", "address.zip": "10001", "tags": "x, y", "gone": "", "rows": '[{"n":1},{"n":2}]', "deep.b.c": '[[1,null],"z"]',
                                                    "price": "12345678.9"}
    assert {e.key: e.value for e in found[0].e} == {"id": "a", "address.city": "NYC", "address.zip": "10001", "tags": "x, y", "rows.n": "1", "deep.b.c": "z", "price": "12345678.9"}
    assert [e.key for e in found[0].i][:3] == ["id", "address.city", "address.zip"]
    assert {e.key: e.value for e in found[1].i} == {"value": '[1,{"a":2}]'} and found[2].i is None and found[2].c == "null"
    assert found[1].c == '[1,{"a":2}]'
    flat = {e.key: e.value for e in json_tree.with_search_entries(rows, "v", "s").collect()[0].s}
    assert flat["city"] == "NYC" and flat["address.city"] == "NYC" and flat["tags"] == "x; y" and flat["rows.1.n"] == "2"
    assert flat["rows"] == "[object Object]; [object Object]" and flat["deep.b.c"] == "1,; z" and flat["gone"] == "null" and flat["n"] == "2"
    ordered = spark.createDataFrame([('{"b": [1, {"d": 1, "c": null}], "a": 1.0}',)], "v string")
    assert ordered.select(json_tree.canonical_json(F.col("v"))).first()[0] == '{"a":1,"b":[1,{"c":null,"d":1}]}'


def test_search_aliases(spark):
    from itemforge.functions import json_tree
    cases = {
        '{"a":{"name":"x"},"name":"y"}': [("a.name", "x"), ("name", "y")],
        '{"name":"y","a":{"name":"x"}}': [("name", "x"), ("a.name", "x")],
        '{"p":{"n":"1","q":{"n":"2"},"r.n":"3"}}': [("p.n", "1"), ("n", "2"), ("p.q.n", "2"), ("p.r.n", "3")],
        '{"p":{"r.n":"3","n":"1"}}': [("p.r.n", "3"), ("n", "3"), ("p.n", "1")],
        '[{"k":1},[2,{"k":3}]]': [("0.k", "1"), ("k", "3"), ("1", "2; [object Object]"), ("1.1.k", "3")],
        '{"t":"","long":"' + "x" * 1001 + '","l":["", "' + "y" * 1001 + '", true]}': [("l", "true")],
        '"text"': [], "7": [], "no json": [],
    }
    rows = spark.createDataFrame([(t,) for t in cases] + [(None,)], "v string").coalesce(1)
    found = {r.v: r.e for r in json_tree.with_search_entries(rows, "v", "e").collect()}
    assert found.pop(None) is None
    assert {v: [tuple(e) for e in es] for v, es in found.items()} == cases


def test_record_roles(spark):
    from itemforge.functions import json_tree
    cases = {
        '{"Name":"n","title":"t","by":["a",1],"link":{"x":1,"name":"l"},"Created At":7,"date":"d"}': {"title": "n", "author": "a, 1", "url": "l", "date": "d"},
        '{"authors":["a",null],"subject":{"title":3,"name":"s"},"icon":""}': {"title": "s"},
        '[{"title":"t"}]': None, "no": None,
    }
    got = values(spark, list(cases), json_tree.record_roles)
    assert [None if g is None else {e.key: e.value for e in g} for g in got] == list(cases.values())


def test_records_of_thirty_levels(spark):
    from itemforge.functions import json_tree
    text = '{"leaf":0}'
    for i in range(1, 30):
        text = '{"leaf":%d,"k%d":%s}' % (i, i, text)
    row = spark.createDataFrame([(text,)], "v string")
    path = ".".join(f"k{i}" for i in range(29, 0, -1)) + ".leaf"
    for build in (json_tree.with_search_entries, json_tree.with_identity_entries, json_tree.with_eval_entries):
        found = {e.key: e.value for e in build(row, "v", "e").first().e}
        assert found[path] == "0" and found["leaf"] == ("0" if build is json_tree.with_search_entries else "29") and len(found) == 30
    assert json_tree.with_outline(row, "v", "o").first().o.endswith("- Leaf: 0")


def test_outline_levels(spark):
    from itemforge.functions import json_tree
    rows = spark.createDataFrame([('{"title":"T","partsList":[{"a":1},2,""],"body":"' + "w" * 130 + '"}',)], "v string")
    assert json_tree.with_outline(rows, "v", "o").first().o == "- Title: T\n\n## Parts List\n\n### Item 1\n\n- A: 1\n\n- 2\n\n-\n\n## Body\n\n" + "w" * 130


def test_number_text(spark):
    from pyspark.sql import functions as F

    from itemforge.functions.numbers import number_text
    cases = {12345678.9: "12345678.9", 0.5: "0.5", 3.0: "3", -0.25: "-0.25", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e300: "1.5e+300", 1e-6: "0.000001", 1.5e-7: "1.5e-7",
             0.00012: "0.00012", -123456789.125: "-123456789.125", 1e7 + 0.5: "10000000.5", 1e-7: "1e-7", 0.001: "0.001", 0.0: "0"}
    rows = spark.createDataFrame([(k,) for k in cases], "x double")
    assert [r.t for r in rows.select(number_text(F.col("x")).alias("t")).collect()] == list(cases.values())


def test_version_order(spark):
    from pyspark.sql import functions as F

    from itemforge.sinks.writers import version_place
    rows = spark.createDataFrame([("v9", 3), ("v10", 1), ("v10", 2), ("v2", 9), ("2024-01-31", 0), ("2024-02-01", 0)], "version string, batch long")
    ordered = rows.orderBy(version_place(F.col("version"), F.col("batch"))).collect()
    assert [tuple(r) for r in ordered] == [("v2", 9), ("v9", 3), ("v10", 1), ("v10", 2), ("2024-01-31", 0), ("2024-02-01", 0)]


def test_upper_each(spark):
    assert values(spark, ["ab", chr(0xC4) + chr(0xDF), chr(0xFB01) + "x", chr(0xE9) + "1"], tx.upper_each) == ["AB", chr(0xC4) + chr(0xDF), chr(0xFB01) + "X", chr(0xC9) + "1"]


def test_json_is_one_whole_value(spark):
    texts = ["1 and more", '{"k": 1} {"k": 2}', "1] x", '1, "v": 2', "1, 2", "1}", "", " ", ' {"k": [1, null]} ', "null", '"a]"', "12"]
    assert values(spark, texts, lambda v: json_tree.parsed_json(v).isNotNull()) == [False] * 8 + [True] * 4
    assert values(spark, [*texts, '{"k": 1, "k": 2}'], json_tree.is_json) == [False] * 8 + [True] * 5
    assert values(spark, [texts[8]], lambda v: F.to_json(json_tree.parsed_json(v))) == ['{"k":[1,null]}']


def test_kinds_of_members(spark):
    raw = '{"a": "{x}", "b": "[1]", "c": {}, "d": [], "e": null, "f": "null", "g": true, "h": 1.50, "i": {"j": [1, {"k": "{"}]}}'
    assert [tuple(m) for m in values(spark, [raw], json_tree.members)[0]] == [
        ("a", "string", "{x}"), ("b", "string", "[1]"), ("c", "object", "{}"), ("d", "array", "[]"), ("e", "null", None), ("f", "string", "null"),
        ("g", "boolean", "true"), ("h", "number", "1.5"), ("i", "object", '{"j":[1,{"k":"{"}]}')]


def test_records_are_dealt_by_rows_not_by_row_groups(spark, tmp_path):
    from itemforge.plans import documents as plans
    for name, key in (("customer", "c_custkey"), ("events", "event_id")):
        rows = spark.range(0, 500_000, 1, 1).select(F.col("id").alias(key), *[F.lit("x").alias(c) for c in ("c_name", "c_mktsegment", "event_type", "user_id")], F.lit('{"k":1}').alias("props"))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    assert plans.deep_json(spark, str(tmp_path)).rdd.getNumPartitions() == 500_000 // plans.DEEP_ROWS
    assert plans.event_json(spark, str(tmp_path)).rdd.getNumPartitions() == -(-500_000 // plans.FLAT_ROWS)


def test_blank_classes_hold_the_trimmed_code_points(spark):
    points = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF], "i int, c string")
    for pattern, but in ((tx.WS, ()), (tx.WS_INLINE, (0x0A,)), (tx.WS_EXOTIC, (0x09, 0x0A, 0x20))):
        assert {r["i"] for r in points.filter(F.col("c").rlike(pattern)).collect()} == set(WS_CODES) - set(but)


def test_scan_of_one_row_group_is_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 50_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("v")).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= 8
        rows = [r["n"] for r in spread(scan).groupBy(F.spark_partition_id().alias("p")).agg(F.count("id").alias("n")).collect()]
        assert sum(rows) == 50_000 and max(rows) < 10_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
