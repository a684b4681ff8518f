"""The library's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import query as Q
from corvane.functions import text as X
from corvane.functions import urls as U
from corvane.operators import accounts, chat, html, normalize, retrieval, structure
from corvane.operators.gate import skip_reason
from corvane.plans import fixtures as D
from corvane.sources import pages as S
from corvane.sources.spread import spread
from corvane.streaming import usage as stream

Query = Callable[[SparkSession, str], DataFrame]
#: searches take every row whose id is divisible by this as a query
EVERY, LEAST_BM25 = 50, 40_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(values: Column) -> Column:
    return F.array_join(values, "|")


def cents(x: Column) -> Column:
    return F.floor(x * 100.0 + 0.5).cast("long")


def _with(spark, sf_dir, name: str, mark: str, key: str, columns: dict[str, str], fixture: tuple) -> DataFrame:
    """A table and a fixture under one kind of id."""
    own = spread(table(spark, sf_dir, name)).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), *(F.col(c).alias(n) for n, c in columns.items()))
    return own.union(D.frame(spark, fixture))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, "documents", "d", "doc_id", {"text": "text"}, D.TEXTS)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, "pages", "p", "page_id", {"url": "url"}, D.URLS)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with(spark, sf_dir, "benchmark", "b", "item_id", {"query": "text"}, D.QUERIES)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", Q.parsed(F.col("query")).alias("p"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns(table(spark, sf_dir, "conversations")).where("role = 'user'")
    rows = rows.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), "text", "last_user", "has_history")
    return rows.union(D.frame(spark, D.MESSAGES))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(S.scan(spark, f"{sf_dir}/pages.parquet", "url", "html")).union(D.frame(spark, D.PAGES))


def _each(source, columns: Callable[[], dict[str, Column]]) -> Query:
    """id and some expressions over a source; they are made when a session is
    there."""
    return lambda spark, sf_dir: source(spark, sf_dir).select("id", *(c.alias(n) for n, c in columns().items()))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).withColumn("intent", Q.intent(F.col("text"), F.col("last_user"), F.col("has_history")))


def crawl_queue(spark, sf_dir):
    """Pages in the order of their numbers, then the hand-made addresses."""
    later = F.substring("id", 2, 9).cast("long") + F.when(F.col("id").startswith("u"), 1 << 40).otherwise(0)
    return S.queue(urls(spark, sf_dir).withColumn("no", later), "no")


def quality_gate(spark, sf_dir):
    rows = _with(spark, sf_dir, "documents", "d", "doc_id", {"url": "source", "text": "text"}, ("id string, url string, text string", []))
    rows = rows.select("id", "url", F.lit("").alias("title"), "text").union(D.frame(spark, D.GATE))
    return rows.select("id", skip_reason(F.col("url"), F.col("title"), F.col("text"), X.word_count(F.coalesce(F.col("text"), F.lit(" ")))).alias("skip_reason"))


def is_html(spark, sf_dir):
    return _with(spark, sf_dir, "pages", "p", "page_id", {"text": "html"}, ("id string, text string", [])).union(texts(spark, sf_dir)).select("id", X.is_html(F.col("text")).alias("is_html"))


def page_title(spark, sf_dir):
    rows = html.with_title(read(spark, sf_dir))
    return rows.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "title")


def _tree(spark, sf_dir):
    return html.with_tree(fetched(spark, sf_dir)).select("url", "tree.*")


def html_headings(spark, sf_dir):
    return _tree(spark, sf_dir).select("url", F.posexplode("headings").alias("place", "h")).select("url", "place", "h.level", "h.text")


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(S.scan(spark, f"{sf_dir}/pages.parquet", "page_id", "url", "html"))


def html_markdown(spark, sf_dir):
    return html.with_tree(read(spark, sf_dir)).select("url", "tree.markdown", "tree.error")


def html_tables(spark, sf_dir):
    return _tree(spark, sf_dir).select("url", "tables", "code")


def table_markdown(spark, sf_dir):
    """A page for each region with a table of its nations, a caption and a table
    within a cell."""
    cell = lambda *c: F.concat(F.lit("<td>"), *c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.col("n_nationkey").cast("string")), cell(F.lit(" <b>"), "n_name", F.lit("</b> |\n x")), F.lit("</tr>"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda r: r["row"]), "").alias("rows"))
    page = F.concat(F.lit("<body><p>Nations</p><table><tr><th>key</th><th>name</th></tr>"), "rows", F.lit("<tr><td><table><tr><td>in</td></tr></table></td></tr></table></body>"))
    pages = rows.select(F.concat(F.lit("https://e.com/region/"), F.col("n_regionkey").cast("string")).alias("url"), page.alias("html"))
    return html.with_tree(pages).select("url", "tree.markdown")


def page_links(spark, sf_dir):
    return _tree(spark, sf_dir).select("url", F.posexplode("links").alias("place", "link"))


def _offered(spark, sf_dir):
    """A page for each part, with structured data of one of three kinds."""
    name, key, price = F.col("p_name"), F.col("p_partkey"), F.col("p_retailprice")
    offer = F.struct(price.alias("price"), F.lit("USD").alias("priceCurrency"), F.lit("http://schema.org/InStock").alias("availability"))
    said = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("@type"), *(v.alias(k) for k, v in fields.items())))
    size = F.struct(F.lit("Size").alias("name"), F.col("p_size").alias("value"))
    product = said("Product", name=name, sku=key.cast("string"), brand=F.struct(F.col("p_brand").alias("name")), offers=F.array(offer), aggregateRating=F.struct((key % 5 + 1).alias("ratingValue"), (key + 1).alias("reviewCount")), additionalProperty=F.array(size))
    service = said("Service", name=name, description=F.col("p_type"), offers=offer, areaServed=F.col("p_brand"))
    shop = said("LocalBusiness", name=name, telephone=key.cast("string"), address=F.struct(F.col("p_brand").alias("streetAddress"), F.col("p_size").cast("string").alias("postalCode")))
    data = F.when(key % 3 == 0, product).when(key % 3 == 1, service).otherwise(shop)
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), data, F.lit("</script></head><body><p>x</p></body></html>"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("https://e.com/part/"), key.cast("string")).alias("url"), page.alias("html"))


def jsonld_lines(spark, sf_dir):
    """Of all pages, and of a page for each part."""
    rows = html.with_tree(read(spark, sf_dir).select("url", "html").union(_offered(spark, sf_dir))).select("url", "tree.*")
    return rows.where("ld_text <> '' or error is not null").select("url", "ld_text", bars(F.col("ld_types")).alias("types"), "error")


def ingest_status(spark, sf_dir):
    """Pages and chunks by status."""
    rows = accounts.ingest_status(normalize.normalize(read(spark, sf_dir)))
    return rows.groupBy("status", "page_type").agg(F.count("*").alias("pages"), F.sum(F.coalesce("words", F.lit(0))).alias("words"))


def business_name(spark, sf_dir):
    """By the page that was fetched first."""
    rows = normalize.normalize(read(spark, sf_dir).withColumnRenamed("page_id", "page_no"), "page_no")
    return accounts.business_name(accounts.ingest_status(rows))


def _sitemaps(spark, sf_dir):
    """A map of twenty child maps over all pages, each with a page of its own site
    and the page's own address for each."""

    def tag(url: Column) -> Column:
        return F.concat(F.lit("<url><loc>"), url, F.lit("</loc></url>"))

    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("k"), "page_id", tag(F.concat(F.lit("https://gen.example/p/"), F.col("page_id").cast("string"))).alias("own"), tag(F.regexp_replace("url", "&", "&amp;")).alias("other"))
    child = lambda k: F.concat(F.lit("https://gen.example/map"), k.cast("string"), F.lit(".xml"))
    maps = pages.groupBy("k").agg(F.array_join(F.flatten(F.array_sort(F.collect_list(F.array("own", "other")))), "").alias("xml")).select(child(F.col("k")), "xml")
    index = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("<sitemap><loc>"), child(k), F.lit("</loc></sitemap>"))), "")
    root = spark.range(1).select(F.lit("https://gen.example/sitemap.xml"), index)
    return root.union(maps).toDF("address", "xml")


def sitemap_locs(spark, sf_dir):
    own = S.sitemap(D.frame(spark, D.SITEMAPS), "https://e.com/sitemap.xml", "https://e.com")
    return own.union(S.sitemap(_sitemaps(spark, sf_dir), "https://gen.example/sitemap.xml", "https://gen.example"))


def not_visited(spark, sf_dir):
    """Of all links in pages those whose page isn't among the pages."""
    found = page_links(spark, sf_dir).select(F.col("link").alias("url")).distinct()
    return S.not_visited(found, urls(spark, sf_dir))


def md_headings(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.posexplode(X.md_headings(F.col("text"))).alias("place", "h")).select("id", "place", "h.level", "h.text")


def _structured(spark, sf_dir):
    return _with(spark, sf_dir, "documents", "d", "doc_id", {"text": "text"}, D.BLOCKS)


def doc_blocks(spark, sf_dir):
    rows = structure.with_blocks(_structured(spark, sf_dir)).select("id", F.posexplode("blocks").alias("place", "b"))
    return rows.select("id", "place", "b.kind", "b.content")


def _chunks(spark, sf_dir):
    return structure.with_chunks(_structured(spark, sf_dir))


def chunk_parent(spark, sf_dir):
    rows = _chunks(spark, sf_dir).where("child_no = 0")
    return rows.select("id", "parent_index", "parent_id", F.col("parent_text").alias("text"), X.token_count(F.col("parent_text")).alias("tokens"))


def chunk_child(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", "child_index", "parent_id", "chunk_text", X.token_count(F.col("chunk_text")).alias("tokens"))


def context_header(spark, sf_dir):
    """Titles, page types and topics by turns."""
    turn = lambda *values: F.element_at(F.array(*(F.lit(v) if isinstance(v, str) or v is None else v for v in values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    source = F.coalesce("source", F.lit(""))
    topics = F.when(F.col("doc_id") % 2 == 0, F.array(source, F.lit(""), F.coalesce("lang", F.lit("")), *map(F.lit, "abcd"))).otherwise(F.array().cast("array<string>"))
    header = structure.context_header(turn("", "Untitled Page", None, F.concat(F.lit("About "), source)), turn("product_page", "faq_page_type", "", None, "about"), turn(F.col("source"), "", F.concat(F.lit("/d/"), source)), topics)
    return table(spark, sf_dir, "documents").select("doc_id", header.alias("header"))


def chunk_uuid(spark, sf_dir):
    index = F.concat(F.lit("0_"), (F.col("doc_id") % 7).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", structure.point_id(F.col("source"), index, F.col("text")).alias("point_id"))


def chunk_points(spark, sf_dir):
    """Points of all pages' chunks, without vectors."""
    pages = accounts.ingest_status(normalize.normalize(read(spark, sf_dir))).where("status = 'completed'")
    rows = structure.with_chunks(pages.select("url", "title", "page_type", "text", "emails", "phones", "price", "currency", "in_stock", "colors", "sizes", F.transform("headings", lambda h: h["text"]).alias("topics")))
    header = structure.context_header(F.col("title"), F.col("page_type"), F.col("url"), F.col("topics"))
    said = structure.contextual(F.col("chunk_text"), F.col("title"), header)
    point = structure.point_id(F.col("url"), F.col("child_index"), F.col("chunk_text"))
    return rows.select(point.alias("id"), "url", "child_index", "parent_id", F.col("chunk_text").alias("text"), said.alias("contextual_text"), "title", "page_type", X.token_count(said).alias("tokens"), "price", "currency", "in_stock", bars(F.col("colors")).alias("colors"), bars(F.col("sizes")).alias("sizes"), bars(F.col("emails")).alias("emails"), bars(F.col("phones")).alias("phones"))


def resolve_followup(spark, sf_dir):
    rows = chat.labelled(table(spark, sf_dir, "conversations")).select(F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("id"), "resolved", "was_resolved")
    own = D.frame(spark, D.FOLLOW).withColumn("r", Q.resolved(F.col("query"), F.filter(F.split("recent", "~"), lambda m: m != "")))
    return rows.union(own.select("id", "r.text", "r.was_resolved"))


def chat_route(spark, sf_dir):
    """The path of each message, whether it is logged, and its fixed reply."""
    rows = labelled(spark, sf_dir).withColumn("rag_path", Q.route(F.col("intent"), Q.guardrail(F.col("text"))))
    return rows.select("id", "intent", "rag_path", Q.is_logged(F.col("rag_path")).alias("logged"), Q.fixed_reply(F.col("text"), F.col("rag_path"), F.col("has_history"), F.lit("Acme"), F.lit("")).alias("reply"))


def prompt_build(spark, sf_dir):
    """The bots' own prompts, and for every other turn one of its bot's role."""
    roles = F.array(*map(F.lit, (*chat.ROLES, "a poet", "")))
    role = F.element_at(roles, (F.col("conv_id") % (len(chat.ROLES) + 2) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", F.col("text")).alias("text"), role.alias("as"))
    return rows.select("conv_id", "turn", chat.system_prompt(F.col("text"), F.col("as"), F.lit("Acme"), F.lit("Sells things."), F.lit("https://acme.example"), F.lit("")).alias("prompt"))


def analytics_log(spark, sf_dir):
    """The log of all messages, as far as they need no model."""
    path = Q.route(F.col("intent"), Q.guardrail(F.col("text")))
    rows = detected(labelled(spark, sf_dir)).withColumns({"rag_path": path, "l": Q.language(F.col("text"), F.col("d.code"), F.col("d.score"))})
    return accounts.log_rows(rows.select(
        F.lit("bot_1").alias("bot_id"), F.col("id").alias("session_id"), F.lit(None).cast("timestamp").alias("ts"), F.col("l.code").alias("detected_lang"), F.col("l.non_english").alias("is_non_english"), "intent", "rag_path", F.col("text").alias("query_text"), F.lit(None).cast("string").alias("translated_query"),
        Q.fixed_reply(F.col("text"), F.col("rag_path"), F.col("has_history"), F.lit("Acme"), F.lit("")).alias("reply_text"), F.lit(None).cast("long").alias("chunks_retrieved"), Q.guardrail(F.col("text")).alias("guardrail_fired"), F.lit(None).cast("string").alias("feedback"),
    )).drop("ts")


def detected(rows: DataFrame) -> DataFrame:
    from corvane.operators.detect import detect

    return rows.withColumn("d", detect(F.col("text")))


def lang_prepare(spark, sf_dir):
    """Messages and documents with what is made of the detector's answer."""
    own = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    rows = detected(messages(spark, sf_dir).select("id", "text").union(own))
    return rows.select("id", Q.language(F.col("text"), F.col("d.code"), F.col("d.score")).alias("l")).select("id", "l.code", "l.non_english", "l.ask_model")


#: a model's answers on a query's constraints
SAID = (
    'Sure: {"maxPrice": 40, "colors": ["teal"], "inStockOnly": true}', '{"minPrice": 5.5, "sizes": ["M", "L"], "isComparison": true, "comparisonEntities": ["a", "b"]}', '{"maxPrice": "12", "colors": "red", "comparisonEntities": ["a"]}', "no list at all", "{broken",
)


def query_constraints(spark, sf_dir):
    """What is merged of a query and a model's answer, one answer after the other."""
    rows = asked(spark, sf_dir).withColumn("said", F.element_at(F.array(*map(F.lit, SAID)), (F.length(F.coalesce("query", F.lit(""))) % len(SAID) + 1).cast("int")))
    p = F.col("p")
    rows = rows.select("id", Q.constrained(F.col("query"), F.col("said")).alias("p"))
    return rows.select("id", cents(p["most"]).alias("most_cents"), cents(p["least"]).alias("least_cents"), bars(p["colors"]).alias("colors"), bars(p["sizes"]).alias("sizes"), p["in_stock"].alias("in_stock"), p["comparison"].alias("comparison"), bars(p["compared"]).alias("compared"))


#: a scoring model's answers
REPLIES = ('Scores: [{"index": 0, "score": 0.91}, {"index": 2, "score": 0.33333}]', "[0.5, 0.25, 0.125]", '[{"chunk": 3, "score": 0.07}]', "sorry", '[{"item": 2}]')


def model_scores(spark, sf_dir):
    """The twelve candidates of each ranking with a model's scores, and the ten that
    a provider returns."""
    pool = retrieval.diverse(_ranked(spark, sf_dir))
    reply = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("query") % len(REPLIES) + 1).cast("int"))
    scored = pool.withColumn("score", retrieval.model_score(reply, F.col("rank"), F.col("score")))
    return retrieval.top_n(scored).select("query", "id", "rank", retrieval.four(F.col("score")).alias("score"))


def history_window(spark, sf_dir):
    return chat.history_window(table(spark, sf_dir, "conversations"))


def lang_detect(spark, sf_dir):
    """Languages by common short words; sure only of longer texts."""
    from corvane.operators.detect import detect

    return table(spark, sf_dir, "documents").select("doc_id", detect(F.col("text")).alias("d")).select("doc_id", "d.code", "d.score")


# --- retrieval ---


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % EVERY == 0).select(F.expr(f"vec_id div {EVERY}").alias("query"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def knn_dense(spark, sf_dir):
    return retrieval.dense(*_vectors(spark, sf_dir))


def filter_payload(spark, sf_dir):
    """Points in stock at a price of 30 at most; label 0 has no price."""
    queries, points = _vectors(spark, sf_dir)
    price, stock = F.when(F.col("label") > 0, F.col("label") * 10.0), F.col("label") % 2 == 1
    return retrieval.dense(queries, points.where(Q.payload_filter(F.lit(30.0), F.lit(True), price, stock)))


def dense_fallback(spark, sf_dir):
    """Thirds of the queries: under a filter that some points pass, one that only
    the page types widen, and one that only all points do."""
    queries, points = _vectors(spark, sf_dir)
    third = lambda k: queries.where(F.col("query") % 3 == k)
    label = F.col("label")
    own = retrieval.dense_with_fallback(third(0), points, label >= 1, label.isin(1, 3))
    wider = retrieval.dense_with_fallback(third(1), points, label > 100, label.isin(1, 3))
    return own.union(wider).union(retrieval.dense_with_fallback(third(2), points, label > 100, label > 200))


def knn_product(spark, sf_dir):
    """The product pages nearest at 0.30 or more, else any page at 0.20."""
    queries, points = _vectors(spark, sf_dir)
    own = retrieval.dense(queries, points.where("label = 2"), 6, 0.30)
    return own.union(retrieval.dense(queries, points, 6, 0.20).join(own.select("query").distinct(), "query", "left_anti"))


def _documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


def bm25_stats(spark, sf_dir):
    return retrieval.term_stats(_documents(spark, sf_dir))


def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_benchmark(spark, sf_dir), _documents(spark, sf_dir))


def rrf_fuse(spark, sf_dir):
    return retrieval.fuse(knn_dense(spark, sf_dir), bm25_topk(spark, sf_dir))


def compare_interleave(spark, sf_dir):
    lists = knn_dense(spark, sf_dir).select(F.expr("query div 2").alias("query"), (F.col("query") % 2).alias("entity"), "id", "rank")
    return retrieval.interleave(lists)


def _ranked(spark, sf_dir):
    """Hand-made rankings, and those of the benchmark's passages over documents,
    whose queries are numbered from 1,000 on."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("url"), "text")
    rows = bm25_topk(spark, sf_dir).join(docs, "id")
    rows = rows.select(F.col("query") + 1_000, "id", "rank", F.col("score") / 1e8, "url", F.concat(F.lit("p"), (F.col("id") % 5).cast("string")), "text", F.lit(None).cast("string"))
    return D.frame(spark, D.RANKED).union(rows).withColumn("contextual_text", F.lit(None).cast("string"))


def diversity_cap(spark, sf_dir):
    return retrieval.diverse(_ranked(spark, sf_dir)).select("query", "id", "rank")


def calibrate_scores(spark, sf_dir):
    """Hand-made scores, and those of the benchmark's passages, of one provider
    after the other."""
    found = bm25_topk(spark, sf_dir).select(F.element_at(F.array(*map(F.lit, ("jina", "bge", "cohere"))), (F.col("id") % 3 + 1).cast("int")), F.col("score") / 1e8)
    rows, score = D.frame(spark, D.SCORES).union(found), F.col("score")
    value = F.when(F.col("provider") == "jina", retrieval.calibrated("jina", score)).when(F.col("provider") == "bge", retrieval.calibrated("bge", score)).otherwise(score)
    return rows.select("provider", "score", retrieval.four(value).alias("calibrated"))


def rerank_none(spark, sf_dir):
    return retrieval.diverse(_ranked(spark, sf_dir)).select("query", "id", "rank", retrieval.four(retrieval.ladder(F.col("rank"), 0.70)).alias("score"))


def _selected(spark, sf_dir):
    return retrieval.select(retrieval.diverse(_ranked(spark, sf_dir)))


def rerank_select(spark, sf_dir):
    return _selected(spark, sf_dir).select("query", "id", "rank", retrieval.four(F.col("score")).alias("score"))


def abstention(spark, sf_dir):
    questions = D.frame(spark, D.RANKED_QUERIES).union(_benchmark(spark, sf_dir).select(F.col("query") + 1_000, "text"))
    return retrieval.gate(questions, _selected(spark, sf_dir)).select("query", retrieval.four(F.col("top")).alias("top"), "abstained")


def parent_resolve(spark, sf_dir):
    return retrieval.parents(_selected(spark, sf_dir)).select("query", "id", "rank", "text")


def context_text(spark, sf_dir):
    rows = retrieval.parents(_selected(spark, sf_dir)).withColumns({"title": F.lit(""), "page_type": F.lit("general_page"), "emails": F.array(F.lit("a@b.co")), "phones": F.array().cast("array<string>")})
    return retrieval.context(rows)


def eval_recall(spark, sf_dir):
    """Benchmark passages as questions; those in no document are to be declined."""
    questions, docs = _benchmark(spark, sf_dir), _documents(spark, sf_dir)
    found = retrieval.bm25(questions, docs)
    # a passage that is in a document ranks among those that share its words
    inside = retrieval.containing(questions, docs)
    golden = questions.join(inside.withColumn("inside", F.lit(True)), "query", "left").select("query", F.array("text").alias("keywords"), F.col("inside").isNull().alias("should_abstain"))
    gated = questions.select("query").join(found.groupBy("query").agg(F.max("score").alias("top")), "query", "left").select("query", (F.coalesce("top", F.lit(0)) < LEAST_BM25).alias("abstained"))
    return retrieval.evaluate(golden, found.join(docs, "id").select("query", "rank", "text"), gated)


def search(spark, sf_dir):
    """The whole search: dense and sparse, fused, diverse, scored by rank, gated,
    with one passage a source."""
    fused = rrf_fuse(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("url"), "text")
    # texts are joined to what was selected only
    near = fused.join(docs.select("id", "url"), "id").withColumn("parent_id", F.lit(None).cast("string"))
    pool = retrieval.diverse(near).withColumn("score", retrieval.ladder(F.col("rank"), 0.70))
    return retrieval.select(pool).join(docs.select("id", "text"), "id").select("query", "rank", "id", "url", retrieval.four(F.col("score")).alias("score"), F.substring("text", 1, 80).alias("excerpt"))


# --- accounts ---


def _usage(spark, sf_dir):
    model = X.first_of(*[(F.col("event_type") == a, F.lit(b)) for a, b in (("view", "openai/gpt-4o-mini"), ("click", "openai/text-embedding-3-small"), ("purchase", "cohere/rerank-v3.5"), ("signup", "jina-reranker-v3"))], otherwise=F.lit("unknown/model"))
    value = F.coalesce("value", F.lit(0.0))
    cached = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("bot_"), (F.col("user_id") % 20).cast("string")).alias("bot"), model.alias("model"), F.floor(value * 10).cast("long").alias("input_tokens"), F.floor(value).cast("long").alias("output_tokens"), cached.cast("long").alias("cache_tokens"))


def usage_tokens(spark, sf_dir):
    details = F.struct(F.col("cached_tokens"))
    said = F.struct("prompt_tokens", "completion_tokens", details.alias("prompt_tokens_details"), F.col("other_cache").alias("cache_tokens"))
    rows = D.frame(spark, D.USAGE)
    every = lambda n, c: F.when(F.col("event_id") % n == 0, c)
    given = _usage(spark, sf_dir).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")), "input_tokens", "output_tokens", "cache_tokens", every(3, F.col("input_tokens") + 5), every(4, F.col("output_tokens") + 1), every(5, F.col("cache_tokens") + 2), every(7, F.lit(3).cast("long")), "bot", "model"
    )
    rows = rows.union(given)
    return rows.select("id", accounts.tokens(F.struct("input_tokens", "output_tokens", "cache_tokens"), said).alias("t")).select("id", "t.*")


def usage_cost(spark, sf_dir):
    return accounts.costs(_usage(spark, sf_dir)).drop("ts")


def usage_records(spark, sf_dir):
    return accounts.records(accounts.costs(_usage(spark, sf_dir))).select("bot", "place", "event_id", "model", "total_cost")


def _stored(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("bot_"), (F.col("doc_id") % 4).cast("string")).alias("bot_id"), F.concat(F.lit("/d"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("no"), "n_chars", "lang", "source")


def bot_documents(spark, sf_dir):
    """Documents of two bots, with the bots' names."""
    bots = spark.createDataFrame([("bot_1", "One"), ("bot_3", "Three"), ("bot_9", "None")], "bot_id string, bot_name string")
    return accounts.documents_of(_stored(spark, sf_dir), F.broadcast(bots)).select("bot_id", "bot_name", "url", "n_chars")


def documents_upsert(spark, sf_dir):
    """A second ingest of every third document and of some new ones: chunks are
    counted, sizes change, what isn't said stays."""
    stored = _stored(spark, sf_dir)
    new = stored.where("no % 3 = 0").select("bot_id", F.when(F.col("no") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/new"))).alias("url"), F.when(F.col("no") % 9 == 0, F.col("n_chars") + 1).alias("n_chars"), (F.col("no") % 7).alias("chunks"))
    return accounts.upsert_documents(stored.drop("no"), new)


def usage_totals(spark, sf_dir):
    return accounts.totals(accounts.costs(_usage(spark, sf_dir)))


def feedback_latest(spark, sf_dir):
    return accounts.feedback(table(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), "event_type"), D.frame(spark, D.VOTES))


def upsert_points(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value", "ts")
    return S.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["id"], ["ts", "version"]).drop("ts")


def stream_usage(spark, sf_dir):
    return stream.windowed(_usage(spark, sf_dir))


def scan_pages(spark, sf_dir):
    return S.scan(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.length("html").alias("size"))


def queries() -> dict[str, Query]:
    text, url, query, said, label = (lambda: F.col("text")), (lambda: F.col("url")), (lambda: F.col("query")), (lambda: F.col("text")), (lambda: F.col("intent"))
    out: dict[str, Query] = {
        "url_parts": _each(urls, lambda: dict(scheme=U.scheme(url()), host=U.host(url()), path=U.path(url()), origin=U.origin(url()))),
        "url_crawlable": _each(urls, lambda: dict(crawlable=U.is_crawlable(url()))),
        "url_same_domain": _each(urls, lambda: dict(same=U.same_domain(url(), F.lit("https://www.example.com/")))),
        "page_type": _each(urls, lambda: dict(page_type=U.page_type(url()))),
        "word_count": _each(texts, lambda: dict(words=X.word_count(text()))),
        "content_hash": _each(texts, lambda: dict(content_hash=X.content_hash(text()))),
        "token_count": _each(texts, lambda: dict(tokens=X.token_count(text()))),
        "strip_noise": _each(texts, lambda: dict(stripped=X.strip_noise(text()))),
        "contact_emails": _each(texts, lambda: dict(emails=bars(X.emails(text())))),
        "contact_phones": _each(texts, lambda: dict(phones=bars(X.phones(text())))),
        "md_title": _each(texts, lambda: dict(title=X.md_title(text()))),
        "ecom_price": _each(texts, lambda: dict(price_cents=cents(X.price(text())["price"]), currency=X.price(text())["currency"])),
        "ecom_colors": _each(texts, lambda: dict(colors=bars(X.page_colors(text())))),
        "ecom_sizes": _each(texts, lambda: dict(sizes=bars(X.page_sizes(text())))),
        "ecom_stock": _each(texts, lambda: dict(in_stock=X.page_stock(text()))),
        "query_price": _each(asked, lambda: dict(least_cents=cents(Q.prices(query())["least"]), most_cents=cents(Q.prices(query())["most"]))),
        "query_facets": lambda s, d: parsed(s, d).select("id", bars(F.col("p.colors")).alias("colors"), bars(F.col("p.sizes")).alias("sizes"), "p.in_stock", "p.comparison", "p.confidence"),
        "query_parse": lambda s, d: parsed(s, d).select("id", "p.ask_model", "p.cleaned"),
        "query_compare": _each(asked, lambda: dict(compared=bars(Q.compared(query())))),
        "query_clean": _each(asked, lambda: dict(cleaned=Q.cleaned(query()))),
        "intent": _each(labelled, lambda: dict(intent=label(), branch=Q.branch(label()))),
        "guardrail": _each(messages, lambda: dict(guarded=Q.guardrail(said()))),
        "likely_english": _each(messages, lambda: dict(english=Q.likely_english(said()))),
        "augment_query": _each(labelled, lambda: dict(augmented=Q.augmented(said(), label()))),
        "hyde_trigger": _each(labelled, lambda: dict(reason=Q.hyde_reason(said(), label(), F.lit(False)))),
        "expand_query": _each(labelled, lambda: dict(expanded=Q.expanded(said(), label(), F.lit(False)))),
        "greeting_reply": _each(messages, lambda: dict(reply=Q.greeting_reply(said(), F.col("has_history"), F.lit("Acme"), F.lit("")))),
    }
    for f in (
        crawl_queue, quality_gate, is_html, page_title, html_headings, html_markdown, html_tables, table_markdown, page_links, jsonld_lines, ingest_status, business_name, sitemap_locs, md_headings, doc_blocks, chunk_parent, chunk_child, context_header, chunk_uuid, chunk_points, resolve_followup, chat_route,
        prompt_build, history_window, lang_detect, knn_dense, filter_payload, dense_fallback, knn_product, bm25_stats, bm25_topk, rrf_fuse, compare_interleave, diversity_cap, calibrate_scores, rerank_none, rerank_select, abstention, parent_resolve, context_text, eval_recall, search,
        usage_tokens, usage_cost, usage_totals, usage_records, bot_documents, documents_upsert, analytics_log, lang_prepare, query_constraints, model_scores, not_visited, feedback_latest, upsert_points, stream_usage, scan_pages,
    ):
        out[f.__name__] = f
    return out
