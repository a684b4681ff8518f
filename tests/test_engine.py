"""The library against its SQL, its traps on hand-made rows, and its streams."""

import datetime
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import query as Q
from corvane.functions import text as X
from corvane.functions import urls as U
from corvane.operators import accounts, batches, chat, html, retrieval, structure
from corvane.operators.normalize import normalize
from corvane.plans import fixtures, oracle
from corvane.plans import queries as plans
from corvane.sources import pages as sources
from corvane.streaming import usage as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = plans.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(oracle.oracle_sql())))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["search", "bm25_topk", "usage_totals", "chunk_child", "crawl_queue"])
def test_rows_do_not_depend_on_partitions(spark, sf_dir, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(str, plans.queries()[name](spark, sf_dir).collect()))

    try:
        assert run("1") == run("8")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'boolean'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], kinds).select(column.alias("r")).head()[0]


def test_sizes_count_only_when_glued(spark):
    sizes = lambda q: one(spark, Q.sizes(F.col("q")), q=q)
    assert sizes("size 10") == [] and sizes("shoes size10") == ["10"] and sizes("waist32") == ["32"]
    assert sizes("it's nice") == ["S"] and sizes("I'm here") == ["M"] and sizes("they do not have size m") == []


def test_word_edges_are_ascii(spark):
    assert one(spark, X.page_colors(F.col("t")), t="éred") == ["red"] and one(spark, X.page_colors(F.col("t")), t="greenish") == []


def test_price_rules(spark):
    price = lambda t: tuple(one(spark, X.price(F.col("t")), t=t))
    assert price("Price: $49.99") == (49.99, "USD") and price("500 rupees") == (500.0, "500") and price("price: 0") == (None, None)
    assert price("cost: 1,299") == (1299.0, None) and price("€ 3") == (3.0, "EUR") and price("price: 1000000") == (None, None)


def test_page_types_are_substrings_in_order(spark):
    kind = lambda u: one(spark, U.page_type(F.col("u")), u=u)
    assert [kind(u) for u in ("https://e.com/support-faq", "https://e.com/workshop", "https://e.com/special", "", None, "https://e.com/zzz")] == ["contact_page", "product_page", "product_page", "homepage", "homepage", "general_page"]


def test_page_type_from_the_page_itself(spark):
    rows = [("https://e.com/x", ["Product"], "", "", ""), ("https://e.com/x", [], "og:product", "", ""), ("https://e.com/x", [], "", "Pricing", ""), ("https://e.com/x", [], "", "", "please add to cart"), ("https://e.com/x", [], "", "", "nothing")]
    got = spark.createDataFrame(rows, "u string, t array<string>, o string, h string, b string").select(U.page_type(*map(F.col, "utohb"))).collect()
    assert [r[0] for r in got] == ["product_page", "product_page", "pricing_page", "product_page", "general_page"]


def test_blocks_have_the_known_quirks():
    assert structure.blocks("Q: a\nQ: b\nc") == [("qa_pair", "Q: a\nQ: b\nc")]
    assert [k for k, _ in structure.blocks("| a |\n```\nx\n```\n| b |")] == ["table", "code_block", "text"]
    assert structure.blocks("```\nopen") == [("code_block", "```\nopen")] and structure.blocks("") == [] and structure.blocks(None) == []


def test_split_keeps_all_lines_and_overlaps():
    text = "\n\n".join(f"Paragraph {k} " + "word " * 40 for k in range(30))
    got = structure.split(text, 350, 50)
    assert all(structure.quarter(c) <= 350 + 60 for c in got)
    for k in range(30):
        assert any(f"Paragraph {k} " in c for c in got)
    for a, b in zip(got[:-1], got[1:], strict=True):
        assert b.startswith(a.split("\n")[-1].strip()[:20])
    assert structure.split("", 10) == [] and structure.split("abc", 10) == ["abc"] and structure.split("x" * 500, 10, 5) == ["x" * 500]


def test_split_emits_an_overlap_alone():
    text = "intro line\n\n" + "\n".join(["y" * 38, "z" * 38])
    assert structure.split(text, 10, 5)[:2] == ["intro line", "intro line"]


def test_html_markdown_rules():
    page = dict(fixtures.PAGES[1])
    got = html.read(page["https://e.com/a"], "https://e.com/a")
    assert got["title"] == "A & B" and got["headings"][0] == {"level": "h1", "text": "Hi  there"} and got["links"] == ["https://e.com/rel", "https://e.com/bare"]
    assert got["markdown"].startswith("# Hi there\n\n# Hi there") and "[link](https://e.com/rel?q=1#f)" in got["markdown"] and "- x\n- y" in got["markdown"] and got["mails"] == ["a@b.co"] and got["calls"] == ["+1555"]
    b = html.read(page["https://e.com/b"], "https://e.com/b")["markdown"]
    assert "| a\\|b | c |\n| --- | --- |" in b and "(Original Price: $9)" in b and "Price: $5" in b and "Price: 7" in b and "gone" not in b and "no" not in b.split() and "9" * 50 in b
    assert "![pic](https://e.com/i.png)" in b and "j.png" not in b and "**k**: v" in b and "### more" in b
    assert html.read(page["https://e.com/f"], "")["markdown"] == ""
    assert html.read(page["https://e.com/d"], "")["error"].startswith("TypeError") and html.read(None)["error"] is None


def test_structured_data_lines():
    page = dict(fixtures.PAGES[1])
    got = html.read(page["https://e.com/c"], "")
    assert got["ld_text"].split("\n") == ["Product: N", "Brand: Br", "Price: USD 5", "Availability: InStock", "Price Range: EUR 1 – EUR 2", "Rating: 4.5/5 (7 reviews)", "Fit: slim", "Q: Q?", "A: Yes it is"]
    assert got["ld_types"] == ["product", "x", "faqpage"]
    assert html.read(page["https://e.com/e"], "")["ld_text"].split("\n") == ["Business Name: R", "Address: 1 St, 9", "Opening Hours: Mo-Tu: 9-5", "Article: H", "Author: W", "Date Published: 2024", "Service: S", 'Area Served: {"a":1}']


def test_a_bad_page_does_not_stop_the_others(spark):
    rows = {r.url: r for r in accounts.ingest_status(normalize(fixtures.frame(spark, fixtures.PAGES))).collect()}
    assert rows["https://e.com/d"].status == "failed" and rows["https://e.com/a"].status == "skipped" and rows["https://e.com/c"].page_type == "product_page"
    assert rows["https://e.com/md"].title == "Top" and rows["https://e.com/md"].code_blocks == 1.0 and rows["https://e.com/md"].emails == ["a@b.co"]
    assert rows["https://e.com/g"].skip_reason == "Empty page body text" and rows[""].title == "Untitled Page"


def test_point_ids_have_the_form_of_version_four(spark):
    ids = {one(spark, structure.point_id(F.col("u"), F.col("i"), F.col("t")), u="a", i=str(k), t="x") for k in range(40)}
    assert len(ids) == 40 and all(i[14] == "4" and i[19] in "89ab" and len(i) == 36 for i in ids)


def test_follow_ups(spark):
    got = {r.id: (r.r.text, r.r.was_resolved) for r in fixtures.frame(spark, fixtures.FOLLOW).withColumn("r", Q.resolved(F.col("query"), F.filter(F.split("recent", "~"), lambda m: m != ""))).collect()}
    assert got["f0"] == ("Alpha Jacket how much is", True) and got["f1"] == ("Beta Coat how much is", True)
    assert got["f2"] == ("Gamma Shoe specifications features material fabric details material", True)
    assert got["f3"] == ("Delta Bag show link", True) and got["f5"] == ("what colours exist for coats", False) and got["f11"] == ("price", False) and got["f12"] == ("", False)


def test_model_answers_are_used_only_where_asked(spark):
    rows = spark.createDataFrame([("zxcv", "SPA"), ("hello", "fra"), ("zxcv", None)], "t string, m string")
    got = rows.select(Q.language(F.col("t"), F.lit("und"), F.lit(0.0), F.lower("m")).alias("l")).collect()
    assert [r.l.code for r in got] == ["spa", "eng", "eng"]
    said = rows.limit(1).select(Q.expanded(F.lit("it fits"), F.lit("general"), F.lit(False), F.lit(" doc ")).alias("e")).head()[0]
    assert said == "it fits\n\ndoc"


def test_dense_search_passes_over_bad_vectors(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 0.0]), (6, [-1.0, 0.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query long, vector array<float>")
    assert [(r.query, r.id, r.score, r["rank"]) for r in retrieval.dense(queries, points).collect()] == [(1, 1, 1_000_000, 1), (1, 5, 1_000_000, 2)]
    assert retrieval.dense(queries.where("query = 2"), points).count() == 0


def test_dense_search_in_several_blocks_of_queries(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, plans.knn_dense(spark, sf_dir).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, plans.knn_dense(spark, sf_dir).collect())) == want


def test_fallback_widens_only_for_queries_without_results(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], "id long, vector array<float>, kind string")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query long, vector array<float>")
    got = retrieval.dense_with_fallback(queries, points, F.col("kind") == "a", F.col("kind") == "z").collect()
    assert sorted((r.query, r.id, r.tier) for r in got) == [(1, 1, 0), (2, 1, 2), (2, 2, 2)]


def test_fusion_is_symmetric_in_score(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query long, id long, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query long, id long, rank int")
    score = lambda x, y: {r.id: r.score for r in retrieval.fuse(x, y).collect()}
    assert score(a, b) == score(b, a) == {7: 16393, 8: 32522, 9: 16129}
    assert score(a, b.limit(0)) == {7: 16393, 8: 16129}


def test_parents_across_pages(spark):
    rows = spark.createDataFrame([(1, 1, 1, "/a", "p0", "x", None, None), (1, 2, 2, "/b", "p0", "y", None, None)], "query long, id long, rank int, url string, parent_id string, text string, parent_text string, contextual_text string")
    assert retrieval.parents(rows).count() == 1 and retrieval.parents(rows, compat=False).count() == 2


def test_context_is_cut(spark):
    rows = spark.createDataFrame([(1, 1, "t", "/u", "k", ["e"], [], "x" * 9000)], "query long, rank int, title string, url string, page_type string, emails array<string>, phones array<string>, text string")
    got = retrieval.context(rows).head().context
    assert got.startswith("RESULT 1:\nTitle: t\nURL: /u\nType: k\nEmails: e\n\nxxx") and got.endswith("\n...[truncated]") and len(got) == 8015


def test_sitemaps_children_and_queue(spark):
    maps = fixtures.frame(spark, fixtures.SITEMAPS)
    assert {r.url for r in sources.sitemap(maps, "https://e.com/sitemap.xml", "https://e.com").collect()} == {"https://e.com/a", "https://www.e.com/d", "https://e.com/z"}
    assert sources.discover(maps, "https://e.com") == "https://e.com/sitemap.xml"
    rest = maps.where("address <> 'https://e.com/sitemap.xml'")
    assert sources.discover(rest, "https://e.com", ["https://e.com/s1.xml"]) == "https://e.com/s1.xml" and sources.discover(rest, "https://e.com") is None


def test_points_by_bot(spark, tmp_path):
    at = f"file://{tmp_path}/points"
    sources.write_points(spark.createDataFrame([("a", 1), ("b", 2)], "bot_id string, id long"), at)
    read = spark.read.parquet(at)
    assert read.where("bot_id = 'a'").count() == 1 and sources.drop_bot(read, "a").count() == 1
    assert "PartitionFilters: [isnotnull(bot_id" in read.where("bot_id = 'a'")._jdf.queryExecution().toString()


def test_history_and_prompt(spark):
    rows = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", "m" * (300 if k == 3 else 5)) for k in range(6)], "conv_id long, turn long, role string, text string")
    got = sorted((r.turn, len(r.content)) for r in chat.history_window(rows).collect())
    assert got == [(2, 5), (3, 253), (4, 5), (5, 5)]
    assert one(spark, chat.system_prompt(F.col("c"), F.lit(None), F.lit(""), F.lit(""), F.lit(""), F.lit("ctx")), c="A prompt of more than twenty").endswith("CONTEXT:\nctx")


def _events(spark, rows):
    return spark.createDataFrame([(datetime.datetime(2024, 1, 1, h, m), "b", "openai/gpt-4o-mini", 1000, 10, 0) for h, m in rows], "ts timestamp, bot string, model string, input_tokens long, output_tokens long, cache_tokens long")


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    src, out = f"{tmp_path}/in", "windows"
    _events(spark, [(1, 0), (1, 30), (2, 5)]).coalesce(1).write.parquet(f"{src}/a")
    schema = spark.read.parquet(f"{src}/a").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = stream.windowed(rows).writeStream.outputMode("append").format("memory").queryName(out).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        _events(spark, [(5, 0)]).coalesce(1).write.parquet(f"{src}/b")
        q.processAllAvailable()
        _events(spark, [(1, 10)]).coalesce(1).write.parquet(f"{src}/c")  # late
        q.processAllAvailable()
        _events(spark, [(9, 0)]).coalesce(1).write.parquet(f"{src}/d")
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.start.hour, r.calls) for r in spark.table(out).collect()}
    assert got >= {(1, 2), (2, 1)} and (1, 3) not in got
    batch = {(r.start.hour, r.calls, r.total_cost) for r in stream.windowed(_events(spark, [(1, 0), (1, 30), (2, 5)])).collect()}
    assert {(r.start.hour, r.calls, r.total_cost) for r in spark.table(out).collect() if r.start.hour < 3} == batch


def test_upserts_survive_a_batch_run_twice(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    run = stream.upserter(path, ["id"], ["v"], buckets=8)
    row = lambda *r: spark.createDataFrame(list(r), "id long, v long")
    held = lambda n: sorted(map(tuple, stream.upserted(spark, path, n).select("id", "v").collect()))
    run(row(*((k, 1) for k in range(40))), 0)
    run(row((1, 5), (1, 3)), 1)
    run(row((1, 5), (1, 3)), 1)
    assert held(1) == [(k, 5 if k == 1 else 1) for k in range(40)] and held(0) == [(k, 1) for k in range(40)]
    assert len(list((tmp_path / "t/data/batch=1").glob("bucket=*"))) == 1  # only what the batch touched
    run(row().limit(0), 2)
    assert held(2) == held(1)


def test_upserts_never_start_from_nothing(spark, tmp_path):
    import shutil

    path = f"file://{tmp_path}/t"
    run = stream.upserter(path, ["id"], ["v"])
    row = lambda *r: spark.createDataFrame(list(r), "id long, v long")
    for n in range(3):
        run(row((n, n)), n)
    with pytest.raises(ValueError, match="further"):
        run(row((9, 9)), 0)
    shutil.rmtree(tmp_path / "t/manifest/2")
    with pytest.raises(ValueError, match="no finished batch 2"):
        run(row((3, 3)), 3)
    with pytest.raises(ValueError, match="no finished batch 7"):
        stream.upserted(spark, path, 7)


def test_the_library_stands_without_its_training_data_part(tmp_path):
    """A copy without those folders, with and without the pipeline beside it."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search' in q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op1') or n == 'pipeline']; print(len(q))"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
        assert done.returncode == 0 and int(done.stdout) > 70, done.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_documents_are_set_in_part(spark):
    old = spark.createDataFrame([("a", "/1", 5, "x"), ("a", "/2", 6, "y")], "bot_id string, url string, size int, kind string")
    new = spark.createDataFrame([("a", "/2", None, 3), ("b", "/2", 1, 4)], "bot_id string, url string, size int, chunks int")
    got = sorted(map(str, map(tuple, accounts.upsert_documents(old, new).select("bot_id", "url", "size", "kind", "chunks").collect())))
    assert got == ["('a', '/1', 5, 'x', None)", "('a', '/2', 6, 'y', 3)", "('b', '/2', 1, None, 4)"]


def test_inner_tables_are_written_once(spark):
    """Twelve tables in each other in moments; a page that would be too long is an
    error of its own."""
    import time

    def page(n):
        return "<table><tr><td>x" * n + "</td></tr></table>" * n

    began = time.time()
    assert html.read(page(12))["error"] is None and time.time() - began < 5
    assert "a table of over" in html.read(page(40))["error"] and time.time() - began < 60


def test_many_queries_go_in_blocks(spark, sf_dir, monkeypatch):
    """Twenty thousand queries, and blocks of few cells, give what one block gives."""
    docs = spark.createDataFrame([(k, f"w{k % 97} common t{k % 13} t{k % 7}") for k in range(60)], "id long, text string")
    few = spark.createDataFrame([(k, f"w{k % 97} common") for k in range(40)], "query long, text string")
    want = sorted(map(tuple, retrieval.bm25(few, docs).collect()))
    monkeypatch.setattr(retrieval, "QUERY_CELLS", 200)
    assert sorted(map(tuple, retrieval.bm25(few, docs).collect())) == want
    monkeypatch.undo()
    many = spark.range(20_000).selectExpr("id as query", "concat('w', id % 97) as text")
    got = retrieval.bm25(many, docs, limit=1).groupBy().agg(F.count("*"), F.max("rank")).head()
    assert got[0] == sum(k % 97 < 60 for k in range(20_000)) and got[1] == 1


def test_containment_by_brute_force(spark):
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("abAB ") for _ in range(r.randint(0, 30))) for _ in range(80)] + [None, ""]
    asked = ["".join(r.choice("abAB ") for _ in range(r.randint(0, 5))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "query long, text string")
    want = {k for k, q in enumerate(asked) if q is not None and any(t is not None and q.lower() in t.lower() for t in texts)}
    assert {x[0] for x in retrieval.containing(questions, docs).collect()} == want


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = plans.scan_pages(spark, sf_dir).select("page_id").where("page_id > 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,3)]" in plan and "ReadSchema: struct<page_id:bigint>" in plan


def test_collections_are_checked(spark, tmp_path):
    at = f"file://{tmp_path}/c"
    assert sources.open_points(spark, at, 2) is None
    points = spark.createDataFrame([("a", "t"), ("a", "u"), ("b", "t")], "bot_id string, text string")
    vectors = spark.createDataFrame([("t", [1.0, 2.0]), ("t", [1.0, 2.0])], "text string, vector array<float>")
    sources.write_points(sources.with_vectors(points, vectors, 2), at)
    assert sources.open_points(spark, at, 2).where("vector is not null").count() == 2 and sources.open_points(spark, at, 3) is None
    with pytest.raises(Exception, match="must have 3"):
        sources.with_vectors(points, vectors, 3).collect()
    with pytest.raises(ValueError, match="no page"):
        sources.require_points(points.limit(0))


def test_only_two_constraints_filter(spark):
    rows = spark.createDataFrame([(5.0, False, 4.0, None), (5.0, False, 6.0, True), (5.0, False, None, True), (None, True, None, True), (None, True, 1.0, None), (None, False, None, None)], "most double, only boolean, price double, stock boolean")
    assert [r[0] for r in rows.select(Q.payload_filter(*map(F.col, ("most", "only", "price", "stock")))).collect()] == [True, False, False, True, False, True]


def test_provider_chain_and_scorer_input(spark):
    rows = spark.createDataFrame([(0.03, None, 0.7, "q\n\ndoc", "", "t"), (0.03, None, None, "q", "c", "t")], "f double, a double, b double, q string, c string, t string")
    got = rows.select(retrieval.chain(F.col("f"), F.col("a"), F.col("b")), retrieval.scored_query(F.col("q")), retrieval.scored_text(F.col("c"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0.7, "q", "t"), (0.03, "q", "c")]


def test_random_texts_agree_between_engines(spark):
    """Spark's and DuckDB's forms of the same patterns on random text."""
    import random

    from corvane.functions import patterns as P

    r = random.Random(8)
    bits = ["size", " ", "10", "red", "é", " ", "$", "5.5", "under", "vs", "compare", "and", "M", "-", "404", "page not found", "it", "\n", "Price:", "usd", "in stock", "@a.co", "x", "+1 555 222 3333", "9.5size", "| - |", "```", "日"]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    con = duckdb.connect()
    con.execute("create table x(id bigint, t varchar)")
    con.executemany("insert into x values (?, ?)", list(enumerate(texts)))
    flat = lambda v: [y for x in v for y in (flat(x) if isinstance(x, tuple) else [x])]
    known = {n: p for n in dir(P) if n.isupper() and isinstance(p := getattr(P, n), (str, tuple))}
    for name in ("PRICES", "OUT_OF_STOCK", "IN_STOCK", "PAGE_NUMBER_SIZE", "RANGE", "AT_MOST", "AT_LEAST", "NUMBER_SIZE", "STANDALONE_SIZE", "NO_SIZE", "COMPARES", "FLUFF", "COMPLEX", "PRONOUNS", "IMPLICIT", "SPEC_WORDS", "CORRECTION", "AMBIGUOUS", "ERROR_PAGES", "EMAIL", "PHONE", "GREETING", "DIRECT", "BOLD", "HTML_TAG"):
        for pattern in [known[name]] if isinstance(known[name], str) else flat(known[name]):
            got = dict(frame.select("id", F.array_join(F.regexp_extract_all("t", F.lit(P.java(pattern)), 0), "~")).collect())
            want = dict(con.execute(f"select id, array_to_string(regexp_extract_all(t, {P.sql(pattern)}), '~') from x").fetchall())
            assert got == want, (name, pattern)


def test_dense_ranking_is_that_of_a_full_sort(spark):
    import numpy as np

    r = np.random.default_rng(3)
    points, queries = r.integers(-2, 3, (500, 4)).astype(float), r.integers(-2, 3, (9, 4)).astype(float)
    p = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(queries)], "query long, vector array<double>")
    want = []
    for k, x in enumerate(queries):
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.floor(points @ x / (np.linalg.norm(points, axis=1) * np.linalg.norm(x)) * 1e6 + 0.5)
        found = sorted((-s, i) for i, s in enumerate(score) if np.isfinite(s) and s >= 50_000)[:30]
        want += [(k, i, int(-s), n + 1) for n, (s, i) in enumerate(found)]
    assert sorted(map(tuple, retrieval.dense(q, p).collect())) == sorted(want)


def test_references_need_their_semicolon():
    """As in the SQL: a title that ends in a reference cut short keeps its signs."""
    got = html.read("<html><head><title>für&&&amp</title></head><body><h1>R&D &amp; more&amp</h1><p>1 &lt 2 &lt; 3 &#39;x&#39; &copyx; &copy;</p></body></html>", "https://e.com/")
    assert got["title"] == "für&&&amp" and got["headings"] == [{"level": "h1", "text": "R&D & more&amp"}]
    assert got["markdown"] == "# R&D & more&amp\n\n1 &lt 2 < 3 'x' &copyx; ©"


def test_a_title_is_read_whatever_else_fails(spark, tmp_path, monkeypatch):
    """A table too long to write, a section of an unknown kind and broken data leave
    the title; a page that can't be parsed is an error, never a title."""
    inner = "x" * 600_000
    for _ in range(30):
        inner = f"<table><tr><td>{inner}</td></tr></table>"
    rows = [(1, "u1", f"<title>long</title><body>{inner}</body>"), (2, "u2", "<title>odd</title><![foo[ x ]]><p>y</p>"), (3, "u3", '<title>null</title><script type="application/ld+json">null</script>'), (4, "u4", None), (5, "u5", "<p>none</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = dict(map(tuple, plans.page_title(spark, str(tmp_path)).collect()))
    assert got == {"p1": "long", "p2": "odd", "p3": "null", "p4": None, "p5": ""}
    assert html.read(rows[0][2])["error"] and html.read(rows[2][2])["error"] and html.read(rows[1][2])["error"] is None
    bad = html.with_title(spark.createDataFrame([("u9", b"\xff")], "url string, html binary"))
    with pytest.raises(Exception, match="the page u9 can't be read"):
        bad.collect()


class Held:
    """A frame that gives back what it is to run on batches."""

    schema = None

    def __init__(self, *columns):
        self.columns = columns

    def withColumn(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


def _in_pieces(run, batch, column, given=lambda b: b):
    """The pieces in which a batch comes out: no more than a slice's rows and bytes,
    but for one row that is longer."""
    out = [given(b) for b in run(iter([batch]))]
    assert sum(b.num_rows for b in out) == batch.num_rows
    assert all(b.num_rows <= batches.MOST_ROWS and (b.num_rows == 1 or sum(map(len, filter(None, b.column(column).to_pylist()))) <= batches.SLICE) for b in out)
    assert pa.concat_arrays([b.column(column) for b in out]).equals(batch.column(column))


def _texts(text):
    return [text(40_000)] * 60 + [None, "", text(3_000_000)] + [text(10)] * 2_500


def test_pages_are_parsed_in_pieces(spark):
    rows = _texts(lambda n: f"<title>t</title><p>{'x ' * (n // 2)}</p>")
    batch = pa.RecordBatch.from_arrays([pa.array(["https://e.com/"] * len(rows)), pa.array(rows)], names=["url", "html"])
    for function in (html.with_tree, html.with_title):
        _in_pieces(function(Held("url", "html")), batch, "html")
    assert list(html.with_tree(Held("url", "html"))(iter([]))) == []


class Sent:
    """What a broadcast is to a task."""

    def __init__(self, value):
        self.value = value


def _peak(run, given):
    """All that comes out, and the most MB that numpy and Python held."""
    tracemalloc.start()
    try:
        out = list(run(iter(given)))
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_vectors_are_compared_in_small_matrices():
    rng = np.random.default_rng(3)
    queries, points = rng.normal(size=(4_096, 16)), rng.normal(size=(2_500, 16)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(points))), pa.array(list(points), pa.list_(pa.float32()))], names=["id", "vector"])
    (found,), most = _peak(retrieval._best(Sent((np.arange(len(queries)), queries)), 2, None), [batch])
    exact = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None] @ (queries / np.linalg.norm(queries, axis=1)[:, None]).T
    assert found.column("query").to_pylist() == np.repeat(np.arange(4_096), 2).tolist()
    assert found.column("id").to_pylist() == np.argsort(-exact, axis=0, kind="stable")[:2].T.ravel().tolist()
    assert most < 80


def test_texts_are_scored_in_small_matrices():
    """Texts in slices into postings, these against blocks of many queries."""
    rng = np.random.default_rng(4)
    names = [f"w{k}" for k in range(6_000)]
    ptr = np.arange(0, 3 * 4_096 + 1, 3)
    which = np.concatenate([np.sort(rng.choice(6_000, 3, replace=False)) for _ in range(4_096)]).astype(np.int32)
    block = Sent((np.arange(4_096), {w: i for i, w in enumerate(names)}, (ptr, which)))
    texts = [" ".join(names[t] for t in rng.choice(6_000, 40)) for _ in range(1_200)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts)], names=["id", "text"])
    postings = list(batches.small(retrieval._postings(block), "text")(iter([batch])))
    assert [p.num_rows for p in postings] == [1_000, 200] and list(retrieval._postings(block)(iter([batch])))[0].equals(pa.Table.from_batches(postings).combine_chunks().to_batches()[0])
    idf = rng.uniform(1, 9, 6_000)
    (found,), most = _peak(retrieval._scored(block, idf, 40.0, 2), postings)
    tf = np.zeros((len(texts), 6_000))
    for k, text in enumerate(texts):
        for w in text.split():
            tf[k, int(w[1:])] += 1
    for q in range(0, 4_096, 97):
        mine = which[3 * q : 3 * q + 3]
        score = (idf[mine] * tf[:, mine] * 2.2 / (tf[:, mine] + 1.2)).sum(axis=1)
        best = [i for i in np.argsort(-np.floor(score * 1e6 + 0.5), kind="stable")[:2].tolist() if score[i] > 0]
        assert [i for a, i in zip(found.column("query").to_pylist(), found.column("id").to_pylist(), strict=True) if a == q] == best
    assert most < 120


def test_documents_are_cut_in_pieces(spark):
    rows = _texts(lambda n: "word " * (n // 5))
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"])
    _in_pieces(structure.with_blocks(Held("text")), batch, "text")
    made = []
    Explodes = type("Explodes", (Held,), {"mapInArrow": lambda self, run, schema: made.append(run) or spark.createDataFrame([], f"text string, chunk {structure.CHUNK}")})
    structure.with_chunks(Explodes("text"))
    _in_pieces(made[0], batch, "text")


@pytest.mark.parametrize("name", ["chunk_points", "html_markdown", "page_title"])
def test_cut_references_are_as_in_sql(spark, tmp_path, name):
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(1, "https://e.com/x", f"<html><head><title>die der&&&amp</title></head><body><h1>die der&&&amp</h1><p>{words} a &amp; b</p></body></html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert [tuple(r) for r in plans.queries()[name](spark, str(tmp_path)).select(*names).collect()] == want.fetchall()
