import hashlib
import json

from pyspark.sql import functions as F

from itemforge import EnrichConfig
from itemforge.functions import text as tx
from itemforge.operators import documents, evalset, identity, json_items, longform, matching, records, schema, scoring, shape
from itemforge.operators.identity import Property
from itemforge.operators.ordinals import with_ordinal


def frame(spark, header, rows, file="a.csv"):
    data = [(file, i + 1, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "source_file string, source_row long, " + ", ".join(f"`{h}` string" for h in header))


def test_identity_types_and_items(spark):
    header = ["id", "name", "year", "score", "zip_code", "when", "big", "sci", "flag"]
    df = frame(spark, header, [("1", "Alice", "2024", "87", "02134", "2024-01-15T10:00:00Z", "9999999999999999999", "1.23e10", "true"),
                               ("2", "Bob", "2023", "42", "09001", "2024-02-01", "1", "2", "FALSE")])
    types = identity.infer_types(df, header)
    assert types == {"id": "String", "name": "String", "year": "String", "score": "Int64", "zip_code": "String", "when": "DateTime",
                     "big": "String", "sci": "String", "flag": "Boolean"}
    items = identity.identity_items(df, header, types).orderBy("source_row").collect()
    assert items[0]["title"] == "Alice" and items[0]["properties"]["year"] == "2024" and items[1]["properties"]["flag"] == "false"
    props = {p.name: p for p in identity.identity_schema(header, types)}
    assert props["name"].labels == ["title"] and {"url", "iconUrl"} <= set(props)


def test_content_cap(spark):
    items = records.record_items(frame(spark, ["name", "note"], [("x", "n" * 5000)]), ["name", "note"]).collect()
    assert len(items[0]["content"]) < 4200 and items[0]["content"].endswith("chars elided)")
    assert len(items[0]["properties"]["note"]) == 5000


def test_clashing_property_names(spark):
    header = ["year", "year2", "year-", "title"]
    row = records.record_items(frame(spark, header, [("a", "b", "c", "T")]), header).collect()[0]
    assert row["properties"]["year2"] == "a" and row["properties"]["year22"] == "b" and row["properties"]["year3"] == "c"
    assert row["properties"]["title"] == "T"


def test_long_groups(spark):
    header = ["indicatorId", "indicatorName", "countryName", "date", "value", "countryiso3code"]
    rows = [("SP.POP", "Population", "Chad", "2020", "16", "TCD"), ("EN.CO2", "CO2", "Chad", "2020", "1.2", "TCD"), ("SP.POP", "Population", "Chad", "2021", "", "TCD")]
    items = longform.grouped_items(frame(spark, header, rows), header, EnrichConfig(explicit_long=True)).collect()
    assert [i["title"] for i in items] == ["Chad (2020) — long-format indicators"]
    assert items[0]["content"].endswith("Grouped values:\n- EN.CO2 (CO2): 1.2\n- SP.POP (Population): 16")


def test_long_group_prefix_is_exact(spark):
    header = ["indicatorId", "indicatorName", "countryName", "date", "value", "countryiso3code"]
    rows = [(f"I{i:05d}", "n", "Chad", "2020", str(i), "TCD") for i in range(3000)]
    item = longform.grouped_items(frame(spark, header, rows), header, EnrichConfig(explicit_long=True)).collect()[0]
    raw = ["countryName: Chad", "date: 2020", "countryiso3code: TCD"] + [f"I{i:05d} value: {i}" for i in range(3000)]
    full = "\n".join(["Chad (2020) — long-format indicators", "", "Raw fields:", *raw, "", "Key facts:", "", "All populated fields:", *[f"- {x}" for x in raw],
                      "", "Grouped values:", *[f"- I{i:05d} (n): {i}" for i in range(3000)]])
    assert item["content"] == full[:4000] + f"\n…(truncated; {len(full) - 4000} chars elided)"


def test_heading_stack(spark):
    body = "# A\nx\n### C\ny\n### D\nz\n## B\nw"
    rows = spark.createDataFrame([(body,)], "b string").select(F.inline(documents.heading_sections(F.col("b")))).collect()
    assert [(r["section_path"], r["text"]) for r in rows] == [("A", "x"), ("A > C", "y"), ("A > C > D", "z"), ("A > B", "w")]


def test_html_metadata(spark):
    html = ('<html><head><meta name="author" content="Ann &amp; Co"><meta property="date" content="2024"><link rel="canonical icon" href=" http://x/y "></head>'
            "<body><nav>skip</nav><h1>T <b>x</b></h1><p>one<br>two</p><h2></h2></body></html>")
    d = documents.html_documents(spark.createDataFrame([("p.html", html)], "source_file string, raw string")).collect()[0]
    assert (d["title"], d["author"], d["date"], d["doc_url"], d["body"]) == ("T  x", "Ann & Co", "2024", "http://x/y", "# T x\n\none\ntwo")


def test_domains(spark):
    cases = [({"recordId": "1", "title": "P", "customProperties": {"npi": "1093137432", "taxonomyDescriptions": ["Acupuncturist"]}}, "npi", "NPI 1093137432 — P — primary taxonomy Acupuncturist."),
             ({"recordId": "r", "customProperties": {"code": "A000", "codeSystem": "ICD-10-CM", "chapter": "c"}}, "icd10", "ICD-10-CM code A000 — chapter c."),
             ({"title": "Dialysis", "customProperties": {"measureName": "m"}}, "cms", "CMS dataset Dialysis — measure m."),
             ({"packageName": "p", "displayName": "D", "recordCount": 3, "bytes": 4.5}, "generic", "D record.")]
    lines = spark.createDataFrame([("f.jsonl", i + 1, json.dumps(c[0])) for i, c in enumerate(cases)] + [("f.jsonl", 9, "not json")], "source_file string, line long, value string")
    items = {r["source_file"]: r for r in json_items.json_line_items(lines).collect()}
    for i, (_, domain, sentence) in enumerate(cases):
        item = items[f"f.jsonl#line-{i + 1}"]
        assert item["properties"]["domain"] == domain and item["content"].startswith(sentence)
    assert items["f.jsonl#line-4"]["properties"]["bytes"] == "4.5" and items["f.jsonl#line-9"]["content"].startswith("not json")


def test_eval_matching(spark):
    rows = records.with_roles(frame(spark, ["country", "year", "gdp"], [("Chad", "2020", "5"), ("Chad", "2021", "6")]), ["country", "year", "gdp"], EnrichConfig())
    rows = rows.withColumn("item_id", F.col("source_row"))
    evals = spark.createDataFrame([("e1", ["z=1"], "a.csv:row 2"), ("e2", ["country=Chad", "year=2020", "gdp=5"], ""), ("e3", ["country=Chad", "year=2020", "gdp=9"], "")],
                                  "eval_id string, raw array<string>, source_location string").withColumn("facts", evalset.parse_facts(F.col("raw")))
    refs = matching.match_by_reference(rows, matching.reference_rows(evals))
    edges = matching.merge_matches(refs, matching.match_by_entity_year(rows, ["country", "year", "gdp"], evals))
    assert {tuple(r) for r in edges.collect()} == {(2, "e1"), (1, "e2")}
    assert [r["eval_id"] for r in matching.unmatched(evals, edges).collect()] == ["e3"]


def test_content_paths_agree_with_brute_force(spark):
    texts = ["The quick brown fox jumps", "over the lazy dog, again", "quickest of THE  brown", "x" * 50 + "needle" + "y" * 50, "a b", ""]
    phrases = ["quick brown fox", "uick brown", "the lazy dog", "needle", "k b", "b", "missing words here", "er the", "e  b", "zz", "again"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, content string")
    evals = spark.createDataFrame([(p, [p, " "]) for p in phrases], "eval_id string, assertions array<string>")
    want = {(i, p) for i, t in enumerate(texts) for p in phrases if p in t.lower()}
    assert {tuple(r) for r in matching.match_by_content(items, evals).collect()} == want


def test_grounding_case(spark):
    pair = spark.createDataFrame([("", "Paris is it [^1^]", [("Paris", True), ("France", False)], ["capital=Paris"])],
                                 "expected_answer string, actual_answer string, assertions array<struct<value:string,whole_word:boolean>>, supporting_facts array<string>")
    s = scoring.library_scores(pair).collect()[0]
    assert (s["assertions_passed"], s["facts_passed"], s["grounding_score"], s["status"], s["has_citation"]) == (1, 1, 60.0, "partial", True)


def test_invalid_gate(spark):
    for blanks, passed in ((5, True), (6, False)):
        df = spark.createDataFrame([(i < blanks,) for i in range(10)], "invalid boolean")
        assert scoring.invalid_gate(df).collect()[0]["passed"] is passed


def test_shape_verdicts(spark):
    prose = "A long and thoroughly descriptive summary sentence of a clinical trial with many words in it, indeed."
    trials = shape.table_samples(spark.createDataFrame([("t", "t", i, str(i), prose) for i in range(20)], "source_id string, source_file string, ordinal long, id string, summary string"), ["id", "summary"])
    numeric = shape.table_samples(spark.createDataFrame([("n", "n", i, str(i)) for i in range(50)], "source_id string, source_file string, ordinal long, v string"), ["v"])
    mixed = [shape.table_samples(spark.createDataFrame([("m", h, i, str(i)) for i in range(30)], f"source_id string, source_file string, ordinal long, {h} string"), [h]) for h in ("p", "q")]
    sources = spark.createDataFrame([("t",), ("n",), ("m",), ("empty",)], "source_id string")
    samples = trials.unionByName(numeric).unionByName(mixed[0]).unionByName(mixed[1])
    got = {r["source_id"]: r["recommendation"] for r in shape.shape_verdicts(samples, sources).collect()}
    assert got == {"t": "identity", "n": "tie", "m": "enhance", "empty": "enhance"}


def test_evalset_hash(spark):
    shape_ = "eval_id string, prompt string, expected_answer string, assertions array<struct<value:string,whole_word:boolean>>, supporting_facts array<string>, category string, difficulty string"
    rows = [("b", "q2", "a", [("v", True)], ["k=v"], "", ""), ("a", "q1", "a", [], [], "c", ""), ("", "  ", "x", [], [], "", ""), (None, "q3", None, None, None, None, None)]
    one = evalset.evalset_fingerprint(spark.createDataFrame(rows, shape_)).collect()[0]
    two = evalset.evalset_fingerprint(spark.createDataFrame(rows[::-1], shape_)).collect()[0]
    changed = evalset.evalset_fingerprint(spark.createDataFrame([("b", "q2", "a", [("w", True)], ["k=v"], "", ""), *rows[1:]], shape_)).collect()[0]
    assert one == two and one["n"] == 3 and one["hash"] != changed["hash"]
    ids = [r["id"] for r in evalset.canonical_items(spark.createDataFrame(rows, shape_)).collect()]
    assert hashlib.sha256(b"q3").hexdigest()[:12] in ids


def test_harden_and_validate(spark):
    props = schema.property_frame(spark, "s", [Property("title", "string"), Property("content", "String"), Property("id", "String", is_searchable=True, is_exact_match=True), Property("iconUrl", "String", is_retrievable=False)])
    rows = {r["name"]: r for r in schema.harden(props).collect()}
    assert set(rows) == {"title", "id", "iconUrl", "url"} and rows["iconUrl"]["labels"] == ["iconUrl"] and rows["iconUrl"]["is_retrievable"]
    assert rows["id"]["is_searchable"] is False and rows["url"]["labels"] == ["url"]
    assert schema.validate(schema.harden(props)).count() == 0


def test_ordinals_match_plain_numbering(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), (F.col("id") * 7).alias("at"))
    got = with_ordinal(df, ["g"], "at", width=50).collect()
    for g in ("hot", "cold"):
        rows = sorted((r["at"], r["ordinal"]) for r in got if r["g"] == g)
        assert [o for _, o in rows] == list(range(1, len(rows) + 1))


def test_comparison(spark):
    runs = spark.createDataFrame([("a", "provision", False, "d", "e", "j"), ("b", "provision", True, "d", "e", "k"), ("c", "build", True, "d", None, "j"), ("d", "provision", False, "x", "e", "j")],
                                 "run_id string, mode string, no_enhance boolean, dataset_hash string, evalset_hash string, judge string")
    pairs = spark.createDataFrame([("b", "a"), ("a", "c"), ("d", "b"), ("a", "d")], "run_a string, run_b string")
    got = {(r["run_a"], r["run_b"]): (r["comparable"], r["semantic_comparable"]) for r in scoring.check_pairs(pairs, runs).collect()}
    assert got == {("a", "b"): (True, False), ("a", "c"): (False, False), ("d", "b"): (False, False), ("a", "d"): (False, True)}
    chosen = runs.filter("run_id = 'a'").first().asDict()
    assert {r["run_id"]: r["comparable"] for r in scoring.candidates_for(runs, chosen).collect()} == {"b": True, "c": False, "d": False}


def test_eval_set_skips_in_order(spark):
    shape_ = "eval_id string, prompt string, _source string, _row long"
    # r2 repeats the prompt of r1; r3 repeats only the id of the rejected r2, so it stays
    rows = [("i1", "p", "s", 1), ("i2", " P ", "s", 2), ("i2", "other", "s", 3), ("i4", "other", "s", 4)]
    kept = evalset.build_eval_set(spark.createDataFrame(rows, shape_), 10).collect()
    assert [(r["eval_id"], r["prompt"]) for r in kept] == [("i1", "p"), ("i2", "other")]


def test_phrases_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(matching, "SHARD_BYTES", 200)
    texts = spark.createDataFrame([(1, "the café bar and the cafés"), (2, "aaaa"), (3, None), (4, ""), (5, "barand"), (5, "barand")], "item_id long, content string")
    phrases = ["café", "bar and", "a", "aa", "the café bar and the cafés!", "", "and", "zz", "rand", "é", "bar and", "漢"]
    found = {tuple(r) for r in matching.texts_holding(texts, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    assert found == {(i, p) for i, t in [(1, "the café bar and the cafés"), (2, "aaaa"), (5, "barand")] for p in phrases if p and p in t}
    assert matching.texts_holding(texts, spark.createDataFrame([], "phrase string")).count() == 0


def test_report_marks_stay_with_their_letter(spark):
    asked = "eval_id string, actual_answer string, assertions array<struct<value:string,whole_word:boolean>>, supporting_facts array<string>, matched boolean, category string"
    rows = [("1", "ci" + chr(0xF3) + "n" + chr(0xF3) + ".", [("N" + chr(0xD3), False)], ["a = no"], True, "x")]
    df = spark.createDataFrame(rows, asked)
    composed = scoring.report_scores(df, tx.fold_composed).collect()[0]
    assert (composed["assertions_passed"], composed["facts_passed"]) == (1, 0)
    assert scoring.report_scores(df).collect()[0]["facts_passed"] == 1


def test_all_ranked_fields_on_demand(spark):
    sources = spark.createDataFrame([("s", True)], "source_id string, has_documents boolean")
    domains = spark.createDataFrame([("s", "npi"), ("s", "cms")], "source_id string, domain string")
    fields = spark.createDataFrame([("s", f"column {chr(97 + i // 26)}{chr(97 + i % 26)}", 100 - i, i) for i in range(90)], "source_id string, field string, weight long, ordinal long")
    kept = [schema.suggest(sources, domains, fields, most=most).filter("field is not null").count() for most in (schema.MAX_SUGGESTED, None)]
    assert kept == [76, 80]


def test_chunks_are_cut_once(spark):
    files = spark.createDataFrame([("a.txt", "One. " * 1200), ("b.txt", " ")], "source_file string, raw string")
    chunks = documents.document_chunks(documents.text_documents(files))
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Generate posexplode")[1]
    assert [(r["source_file"], r["chunk_index"], r["chunk_count"]) for r in chunks.orderBy("source_file", "chunk_index").collect()] == [("a.txt", i, 4) for i in range(4)]


def test_rarest_fact_is_found_without_grouping_items(spark):
    header = ["code", "country", "year", "status", "total"]
    rows = frame(spark, header, [(f"c{i}", "Chad", "2020", "O", str(i)) for i in range(50)]).select("*", F.col("source_row").alias("item_id"), F.col("country").alias("entity_name"), F.col("year").alias("role_year"))
    facts = [F.array(F.lit("country=chad"), F.lit("year=2020"), F.lit("status=o"), F.concat(F.lit("total="), F.col("id").cast("string")))]
    evals = spark.range(45, 55).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("eval_id"), evalset.parse_facts(facts[0]).alias("facts"))
    found = matching.match_by_entity_year(rows, header, evals)
    assert sorted((r["item_id"], r["eval_id"]) for r in found.collect()) == [(i + 1, f"e{i}") for i in range(45, 50)]
    anchors = found.select("item_id").inputFiles()
    table = spark.read.parquet(*[f for f in anchors if "anchors" in f])
    assert {len(r["anchor"]["places"]) for r in table.collect()} == {1} and {r["anchor"]["want"] for r in table.collect()} == {str(i) for i in range(45, 55)}
    assert [f.name for f in table.schema["facts"].dataType.elementType.fields] == ["want", "places"]


def test_evaluation_records_are_settled_once(spark):
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.concat(F.lit(v), F.col("id").cast("string")).alias("value")) for k, v in (("id", "x"), ("name", "N"), ("country", "C"))])
    made = evalset.generate(spark.range(3).select(F.lit("a.csv").alias("source"), F.col("id").alias("row"), cells.alias("entries")))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("transform(" in line.split("Filter ")[1] for line in plan.split("\n") if "Filter " in line)
    chosen = evalset.build_eval_set(made, 2)
    assert any("/pool-" in f for f in chosen.inputFiles()) and [r["source_location"] for r in chosen.collect()] == ["a.csv:row 0", "a.csv:row 1"]


def test_json_lines_are_worked_on_after_the_exchange(spark):
    """The blank test of a line stays above the exchange that deals the lines out."""
    lines = spark.range(4).select(F.lit("f.jsonl").alias("source_file"), F.col("id").alias("line"), F.to_json(F.struct("id")).alias("value"))
    plan = json_items.json_lines_documents(lines.repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 2" in plan and "Filter" not in plan[plan.index("Repartition 2"):]


def test_clean_content_replaces_only_where_signs_are(spark):
    cases = {"a\r\nb\rc": "a\nb\nc", "a  b\tc \t d": "a b c d", "x\n\n\n\ny\n\nz": "x\n\ny\n\nz", " \r\r\r q ": "q", "plain a b": "plain a b", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r.t for r in rows.select(tx.clean_content(F.col("v")).alias("t")).collect()] == list(cases.values())


def test_prose_reads_a_text_once_for_each_count(spark):
    half = "ab 12 " * 20
    cases = {half: True, half + "3": False, " " * 90: False, "1 " * 50: False, "word " * 20: True, "word": False, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select(tx.is_prose(F.col("v")).alias("p"))
    assert [r.p for r in rows.collect()] == list(cases.values())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
