import json
import re

import pytest
from docweave.operators import ledgers, pages, text
from docweave.plans import benchmark, catalog
from docweave.sources import readers, sinks
from docweave.streaming.incremental import convert_stream, landing
from oracle import compare
from pyspark.sql import functions as F
from test_pages import page

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalog(spark, name):
    compare(spark, name, SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_catalog_without_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_dollar_spacing_cjk(spark, tmp_path):
    """Every document is there, and its text as two plain rules make it."""
    texts = ["中$x$文", "价格$5$，好", "a  $x$  b", "$$块$$", "全角（$y$）", "纯中文****", "none", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cjk = lambda c: any(a <= c <= b for a, b in ("\u4e00\u9fff", "\u3000\u303f", "\uff00\uffef"))

    def spaced(t):
        while "  $" in t or "$  " in t:
            t = t.replace("  $", " $").replace("$  ", "$ ")
        out = "".join(c + " " if cjk(c) and t[i + 1 : i + 2] == "$" and t[i + 2 : i + 3] != "$" else c for i, c in enumerate(t))
        return "".join(c + " " if c == "$" and out[i - 1 : i] != "$" and i + 1 < len(out) and cjk(out[i + 1]) else c for i, c in enumerate(out)).replace("****", "")

    got = {r["doc_id"]: r["text"] for r in catalog.queries()["p2_dollar_spacing"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else spaced(t) for i, t in enumerate(texts)}
    assert got[0] == "中 $x$ 文"


def test_report(spark):
    jobs = spark.createDataFrame([("f1", "h1", "x"), ("f2", "h2", "y")], "source_id string, dom_hash string, latex string")
    good = {"schema_version": "1.1", "katex_version": "0.16.9", "runtime_loaded": True, "completed": True, "total": 2, "passed": 2, "failures": [], "items": [{"source_id": "f1", "dom_hash": "h1", "latex": "x"}, {"source_id": "f2", "dom_hash": "h2", "latex": "y"}]}

    def said(**change):
        df = spark.read.schema(readers.REPORT).json(spark.sparkContext.parallelize([json.dumps(good | change)]))
        return {(r["unlocked"], r["message"]) for r in ledgers.report_unlocks(jobs, df, {"schema_version": "1.1"}).collect()}

    assert said() == {(True, None)}
    assert said(schema_version="1.0") == {(False, "validation report schema_version mismatch")}
    assert said(completed=False) == {(False, "validation did not complete with a loaded runtime")}
    assert said(items=good["items"][:1]) == {(False, "source ids do not match the pending batch")}
    assert said(passed=1) == {(False, "counts do not match the pending batch")}
    assert said(items=[good["items"][0], good["items"][1] | {"latex": "z"}]) == {(False, "LaTeX mismatch for f2")}
    assert said(failures=[{"source_id": "f1"}]) == {(False, "failures: 1")}


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None)], "k int, x string, y string")
    f = {r["k"]: r["fingerprint"] for r in ledgers.fingerprint(df, ["y", "x"]).collect()}
    assert f[1] == f[2] != f[3]


def test_files_and_urls(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>é</p>".encode())
    (tmp_path / "b.html").write_bytes(b"\xff\xfe")
    rows = sorted((r["html"] or "", r["error"]) for r in readers.html_files(spark, str(tmp_path / "*.html")).collect())
    assert rows == [("", "not valid UTF-8"), ("<p>é</p>", None)]
    (tmp_path / "u.txt").write_text("https://x/a\n\n https://x/b?skip \nhttps://x/c\n")
    df = readers.url_file(spark, str(tmp_path / "u.txt"))
    assert [r["url"] for r in text.url_list(df, ["skip"], 2).collect()] == ["https://x/a", "https://x/c"]
    maps = {"i": '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> m </loc></sitemap></sitemapindex>', "m": '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>p</loc></url></urlset>'}
    assert readers.sitemap("i", maps.__getitem__) == ["p"]
    with pytest.raises(ValueError, match="deeply"):
        readers.sitemap("r", lambda u: maps["i"].replace("m ", "r "))

    def get(url):
        if url == "bad":
            raise OSError("no")
        return f"<p>{url}</p>"

    got = readers.fetched(spark.createDataFrame([(1, "ok"), (2, "bad")], "ord int, url string"), get).orderBy("ord").collect()
    assert got[0]["html"] == "<p>ok</p>" and got[1]["error"] == "OSError: no"


def test_sinks_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", page("")), (2, "u", None)], "page_id bigint, url string, html string")
    done = pages.convert_pages(df)
    sinks.write_corpus(done, str(tmp_path / "out"))
    sinks.write_corpus(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/markdown")).count() == 1
    a, b = (sinks.packages(done).collect()[0] for _ in range(2))
    assert a["zip"] == b["zip"] and a["zip"][:2] == b"PK" and a["package"] == "Title"
    assert json.loads(spark.read.parquet(str(tmp_path / "out/reports")).filter("page_id = 1").first()["report"])["status"] == "converted"
    assert sinks.validation_document([{"source_id": "f", "dom_hash": "h", "latex": '<"'}]).count("&lt;&quot;") == 1
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = convert_stream(landing(spark, str(tmp_path / "in")), str(tmp_path / "md"), str(tmp_path / "ck"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "md")).count() == 2


def test_files_written_once(tmp_path):
    path = str(tmp_path / "v.html")
    assert sinks.write_if_changed(path, "a") and not sinks.write_if_changed(path, "a") and sinks.write_if_changed(path, "b")
    sinks.write_json(str(tmp_path / "r.json"), {"b": 1, "a": "é"})
    assert (tmp_path / "r.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    (tmp_path / "katex.js").write_text("x")
    (tmp_path / "out").mkdir()
    assert open(sinks.copy_runtime(str(tmp_path / "katex.js"), str(tmp_path / "out"))).read() == "x"
    with pytest.raises(OSError):
        sinks.copy_runtime(str(tmp_path / "none.js"), str(tmp_path / "out"))


def test_preflight_artifacts(spark, tmp_path):
    pre = pages.preflights(spark.createDataFrame([(1, page('<img src="data:,x"><p><math alttext="y"></math></p>')), (2, None)], "page_id bigint, html string"))
    sinks.write_preflight(pre, str(tmp_path))
    n = {k: spark.read.parquet(str(tmp_path / k)).count() for k in ("content", "manifest", "formulas", "assets")}
    assert n == dict.fromkeys(n, 1)
    m = json.loads(spark.read.parquet(str(tmp_path / "manifest")).first()["manifest"])
    assert m["counts"]["formula_total"] == 1 and m["recommended_mode"] == "fast" and m["signals"]["iframes"] == 0


def test_validation_documents(spark):
    jobs = spark.createDataFrame([(f"f{i}", f"h{i}", "<") for i in range(30)], "source_id string, dom_hash string, latex string")
    got = sinks.validation_documents(jobs, 10).collect()
    assert 1 < len(got) <= 3 and sum(r["html"].count("data-latex=") for r in got) == 30


def test_artifacts_and_resume(spark):
    rows = [(p, a, f"{p}{a}", "1.0") for p in (1, 2, 3, 4) for a in ledgers.ARTIFACTS]
    made = spark.createDataFrame(rows, "page_id bigint, path string, content string, schema_version string")
    ledger = ledgers.artifact_ledger(made)
    now = made.filter("not (page_id = 2 and path = 'formula-results')").withColumn("content", F.when((F.col("page_id") == 3) & (F.col("path") == "preflight/assets"), F.lit("3preflight/assetz")).otherwise(F.col("content")))
    got = {r["page_id"]: r["error"] for r in ledgers.artifact_errors(ledger, now).collect()}
    assert got == {1: None, 2: "resume artifact missing or unreadable: formula-results", 3: "resume artifact digest mismatch: preflight/assets", 4: None}
    some = ledger.withColumn("artifacts", F.slice("artifacts", 1, 4))
    assert {r["error"] for r in ledgers.artifact_errors(some, made).collect()} == {"resume ledger artifact set mismatch"}
    odd = ledger.withColumn("artifacts", F.transform("artifacts", lambda a: a.withField("path", F.regexp_replace(a["path"], "^preflight/assets$", "../x"))))
    assert {r["error"] for r in ledgers.artifact_errors(odd, made, tuple("../x" if a == "preflight/assets" else a for a in ledgers.ARTIFACTS)).collect()} == {"unsafe resume artifact path: ../x"}
    new = spark.createDataFrame([(i, "s" if i != 4 else "t", "auto") for i in range(1, 6)], "page_id bigint, source_sha256 string, mode string")
    old = spark.createDataFrame([(i, "s", "auto") for i in range(1, 5)], "page_id bigint, source_sha256 string, mode string")
    r = {x["page_id"]: x["reason"] for x in ledgers.resumable(new, old, "page_id", ledgers.artifact_errors(ledger, now)).collect()}
    assert r[1] is None and r[4] == "resume fingerprint mismatch: source_sha256" and r[5] == "resume ledger does not exist" and r[3].startswith("resume artifact digest")


def test_resume_eligible(spark):
    body = '<p><span class="katex"><span class="katex-html"><span class="mord">z</span></span></span></p>'
    df = pages.convert_pages(spark.createDataFrame([(1, page(body)), (2, page("")), (3, page('<p><span class="katex"><span class="munder">z</span></span></p>'))], "page_id bigint, html string"))
    c = F.col
    got = {r["page_id"]: r["ok"] for r in df.select("page_id", ledgers.resume_eligible(c("jobs"), c("failures"), pages.count_errors(c("counts"), c("emitted")), c("unresolved")).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_gate(spark):
    df = spark.createDataFrame([(1, "plain\n"), (2, "a  $x$\n"), (3, "```\nopen"), (4, "{{FORMULA:f}}\n"), (5, None)], "k bigint, t string")
    assert {r["k"]: r["code"] for r in pages.gate(df, "k", "t").collect()} == {1: 0, 2: 1, 3: 2, 4: 1, 5: 2}
    assert {r["k"]: r["code"] for r in pages.gate(df, "k", "t", apply=True).collect()} == {1: 0, 2: 0, 3: 2, 4: 1, 5: 2}
    assert pages.exit_code(pages.gate(df, "k", "t")) == 2 and pages.exit_code(pages.gate(df.limit(0), "k", "t")) == 0
    assert [(r["k"], r["line"], r["placeholder"]) for r in pages.residual_placeholders(df, "k", "t").collect()] == [(4, 1, "{{FORMULA:f}}")]


def test_dependencies(capsys):
    from docweave import dependencies

    assert dependencies.missing() == [] and dependencies.missing({"no_such_module": "none"}) == ["none"]
    with pytest.raises(SystemExit) as end:
        dependencies.check({"no_such_module": "none"})
    assert end.value.code == 2 and "none" in capsys.readouterr().err


def test_synthetic(spark):
    df = readers.synthetic(spark, 2, 5, 10, 12, 3)
    rows = pages.convert_pages(df).collect()
    assert {r["status"] for r in rows} == {"converted"}
    assert rows[0]["counts"]["formula_total"] == 12 and rows[0]["counts"]["formula_unique"] == 3
    assert rows[0]["compact_bytes"] < rows[0]["input_bytes"]


def test_benchmark(spark):
    records = benchmark.run(spark, 2, 3, 120, 768, 12, 3)
    assert benchmark.conserved(records) == [] and [r["pass"] for r in records] == ["cold", "warm 1", "warm 2", "cold", "validation", "warm 1", "warm 2"]
    assert all(r["total_ms"] >= r["preflight_ms"] > 0 and r["resume_ms"] == 0 for r in records)
    assert benchmark.conserved([records[0] | {"cache_hits": 1, "reduction": 0.1}]) == ["original, cold: snapshot reduction", "original, cold: cache hits"]
    with pytest.raises(ValueError):
        benchmark.run(spark, 1, 1)


def test_collector(tmp_path, capsys):
    import run_tests

    (tmp_path / "test_a.py").write_text("def test_one():\n    pass\n")
    assert run_tests.main([str(tmp_path)]) == 0 and "1 passed" in capsys.readouterr().out
    (tmp_path / "test_b.py").write_text("x = 1\n")
    (tmp_path / "test_c.py").write_text("def test_two():\n    assert False\n")
    assert run_tests.main([str(tmp_path)]) == 1
    out = capsys.readouterr().out
    assert sorted(re.findall(r"(?m)^(ok|FAILED) \S+\.py: ", out)) == ["FAILED", "FAILED", "ok"]
    with pytest.raises(SystemExit):
        run_tests.main([str(tmp_path / "none")])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
