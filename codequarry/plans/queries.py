"""The registered queries: each reads the given tables in full and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import text as text_fn
from codequarry.functions import vectors as vector_fn
from codequarry.operators import (
    blocks, embedding, extraction, generation, graph, names, ranking, relations, rendering, search, seeding, sentences,
    subwords, syntax, tfidf, topics,
)
from codequarry.sources import corpus, documents, files as file_source, folders, sinks, storage, versions
from codequarry.streaming.index import follow_files
from codequarry.streaming.search import stream_search

Query = Callable[[SparkSession, str], DataFrame]
CODE_DIM = 64
DIAGRAM_ORDER = ["section", "name", "part", "ordinal", "line"]


# ---- inputs ----------------------------------------------------------------------------

def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents.read_documents(spark, folder)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).withColumnRenamed("doc_id", "id")


def _bench_queries(spark: SparkSession, folder: str) -> DataFrame:
    return documents.read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _doc_files(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    return _documents(spark, folder).select(path.alias("path"), F.col("text").alias("content"))


def _code(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.java_files(spark, folder)


def _decls(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """All declarations, or only those of some kinds where the next step drops the others."""
    return blocks.declarations(_code(spark, folder), kinds or None)


def _stored_decls(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    """Declarations used by several branches of one plan: parsed once, written, read back."""
    return storage.written(_decls(spark, folder, *kinds), "declarations")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return documents.read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _label_means(spark: SparkSession, folder: str) -> DataFrame:
    vectors = documents.read_table(spark, folder, "embeddings")
    return embedding.mean_pool(vectors.select(F.col("label").cast("bigint").alias("id"), "embedding"))


def _label_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _label_means(spark, folder).withColumnRenamed("id", "query_id")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 5))
    return df


# ---- scans, sources, sinks -------------------------------------------------------------

def scan_files(spark, folder):
    """``benchmark`` as one file per row, some with awkward names or contents, scanned back."""
    root = storage.new_folder(spark, "scan")
    item, text = F.col("item_id").cast("string"), F.col("text").cast("binary")
    kind = F.col("item_id") % 5
    head = F.when(kind == 1, "_").when(kind == 2, ".").otherwise("")
    rows = documents.read_table(spark, folder, "benchmark").select(
        F.concat(F.lit("d"), (F.col("item_id") % 3).cast("string"), F.lit("/"), head, F.lit("item"), item, F.lit(".txt")).alias("name"),
        F.when(kind == 3, F.lit("").cast("binary")).when(kind == 4, F.concat(text, F.unhex(F.lit("FF")))).otherwise(text).alias("bytes"),
    )
    sinks.write_files(rows, root)
    raw = file_source.read_raw(spark, root, "txt")
    good, bad = file_source.split_valid(storage.written(raw, "raw"))
    found = good.select("path", F.octet_length("content").cast("bigint").alias("length"), "content_md5", F.lit(True).alias("good")).unionByName(
        bad.select("path", "length", F.lit(None).cast("string").alias("content_md5"), F.lit(False).alias("good"))
    )
    return found.withColumn("path", F.substring_index("path", "/", -2))


def quarantine_bad_files(spark, folder):
    spoiled = F.when(F.col("lang") != "en", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    raw = documents.read_table(spark, folder, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
        F.concat(F.col("text").cast("binary"), spoiled).alias("bytes"),
    )
    return file_source.split_valid(raw)[1]


def drop_empty_files(spark, folder):
    return file_source.drop_empty_files(_code(spark, folder)).select("path", "content_md5")


def corpus_fingerprint(spark, folder):
    return file_source.corpus_fingerprint(_doc_files(spark, folder))


def _build_index(files):
    """Top-level snippets with their text and vector."""
    snips = extraction.snippets(files, top_level_only=True).withColumn("id", F.concat_ws("::", "path", "kind", "name"))
    # path, kind and name tell ids apart, and snippets are placed by path
    rows = embedding.embed_rows(snips.select("id", "path", "kind", "name", "content"), ["path", "kind", "name"], "content", CODE_DIM)
    return rows.select("id", "path", "kind", "name", "content", "embedding")


def _code_index(spark, folder, root=None):
    root = root or storage.new_folder(spark, "index")
    return file_source.load_or_create(spark, _code(spark, folder), root, _build_index, version=f"snippets-{CODE_DIM}")


def load_or_create_index(spark, folder):
    root = storage.new_folder(spark, "index")
    _code_index(spark, folder, root)
    cells = F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint")
    return _code_index(spark, folder, root).select("path", "kind", "name", F.md5("content").alias("content_md5"), cells.alias("cells"))


def _code_questions(spark, folder):
    number = F.col("n_nationkey").cast("string")
    return documents.read_table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("query_id"),
        F.concat(F.lit("abstract class Nation"), number, F.lit(" touch")).alias("text"),
    )


def _code_hits(spark, folder):
    index = _code_index(spark, folder)
    asked = embedding.embed(_code_questions(spark, folder).withColumnRenamed("query_id", "id"), CODE_DIM)
    hits = search.topk(asked.withColumnRenamed("id", "query_id"), index.select("id", "embedding"), 5)
    return search.fetch_hits(hits, index.select("id", "path", "kind", "name", "content"))


def code_search(spark, folder):
    hits = _code_hits(spark, folder).select("query_id", "rank", "id", "kind", F.round("score", 5).alias("score"), F.md5("content").alias("content_md5"))
    return hits


def code_prompt(spark, folder):
    hits, asked = storage.written(_code_hits(spark, folder), "hits"), _code_questions(spark, folder)
    typed = rendering.prompt(asked, hits, "typed").withColumn("style", F.lit("typed"))
    return typed.unionByName(rendering.prompt(asked, hits, "numbered").withColumn("style", F.lit("numbered")))


def write_diagram(spark, folder):
    out = storage.new_folder(spark, "diagram")
    sinks.write_diagram(class_diagram(spark, folder), out, "package", DIAGRAM_ORDER)
    return sinks.read_diagram(spark, out, "package")


def results_table(spark, folder):
    return _doc_hits(spark, folder).select("query_id", "rank", "path", "kind", "content")


# ---- extraction ------------------------------------------------------------------------

def strip_comments(spark, folder):
    return extraction.strip_comments(_code(spark, folder))


def extract_packages(spark, folder):
    return extraction.extract_packages(_code(spark, folder))


def package_members(spark, folder):
    return extraction.package_members(extract_packages(spark, folder))


def extract_imports(spark, folder):
    return extraction.extract_imports(_code(spark, folder))


def _types(spark, folder):
    return extraction.extract_types(_decls(spark, folder, "class", "interface"))


def extract_types(spark, folder):
    return _types(spark, folder).select("path", "name", "kind", "parent", "implements")


def explode_implements(spark, folder):
    return extraction.explode_implements(_types(spark, folder))


def extract_type_body(spark, folder):
    body = extraction.extract_type_body(_types(spark, folder), _code(spark, folder))
    return body.select("path", "name", "body")


def extract_methods(spark, folder):
    return extraction.extract_methods(_decls(spark, folder, "method")).select("path", "type_name", "ordinal", "name")


def extract_fields(spark, folder):
    return extraction.extract_fields(_decls(spark, folder, "field")).select(
        "path", "type_name", "ordinal", "field_type", "name"
    )


def extract_calls(spark, folder):
    return extraction.extract_calls(_decls(spark, folder)).select(
        "path", "caller_type", "caller_method", "receiver", "callee"
    )


def _snippets(spark, folder, **options):
    return extraction.snippets(_code(spark, folder), **options)


def top_level_snippets(spark, folder):
    return _snippets(spark, folder, top_level_only=True).select("path", "kind", "name", "content")


def nested_declarations(spark, folder):
    order = F.row_number().over(extraction.W.partitionBy("path").orderBy("start"))
    return _snippets(spark, folder).select("path", "kind", "name", "depth", "content", order.alias("nth"))


def declaration_name(spark, folder):
    named = _decls(spark, folder, "class", "method").filter(F.col("kind").isin("class", "method") & (F.col("name") != ""))
    return named.groupBy("path", "kind", "name").agg(F.count("*").alias("n"))


def slice_span(spark, folder):
    fields = _decls(spark, folder, "field").filter(F.col("kind") == "field").select(
        "path", F.col("parent_name").alias("type_name"), "name", "start", "end"
    )
    return extraction.slice_span(fields, _code(spark, folder)).select("path", "type_name", "name", "content")


def filter_common_types(spark, folder):
    fields = extract_fields(spark, folder).select("path", "type_name", "field_type", "name")
    return extraction.filter_common_types(fields, "field_type")


def flatten_snippets(spark, folder):
    nested = extraction.group_snippets(_snippets(spark, folder))
    return extraction.flatten_snippets(nested)


# ---- syntax: tokens, scopes, qualified names ---------------------------------------------

def syntax_nodes(spark, folder):
    return syntax.syntax_nodes(corpus.shop_files(spark, folder)).select("path", "kind", "name", "type", "depth", "parent_kind", "parent_name", F.expr("end - start").alias("size"))


def resolved_calls(spark, folder):
    return syntax.resolved_calls(corpus.shop_files(spark, folder)).drop("pos")


def _shop_decls(spark, folder, *kinds):
    return storage.written(blocks.declarations(corpus.shop_files(spark, folder), kinds), "declarations")


def qualified_types(spark, folder):
    return names.qualified_catalogue(names.qualified_types(_shop_decls(spark, folder, *blocks.TYPE_KINDS, "package")))


def qualified_relations(spark, folder):
    calls = storage.written(syntax.resolved_calls(corpus.shop_files(spark, folder)), "calls")
    decls = _shop_decls(spark, folder, *blocks.TYPE_KINDS, "package", "import", "field")
    return names.qualified_relations(decls, calls).drop("path")


# ---- joins -----------------------------------------------------------------------------

def _known(decls):
    return relations.known_names(extraction.extract_types(decls), extraction.declared_imports(decls))


def associates_edges(spark, folder):
    decls = _stored_decls(spark, folder, "class", "interface", "import", "field")
    return relations.associates_edges(extraction.extract_fields(decls), _known(decls)).drop("path")


def uses_edges(spark, folder):
    decls = _stored_decls(spark, folder)
    return relations.uses_edges(extraction.extract_calls(decls), _known(decls)).drop("path")


def fetch_hits(spark, folder):
    hits = search.topk(_label_queries(spark, folder), _vectors(spark, folder))
    items = documents.read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return search.fetch_hits(hits, items).select("query_id", "rank", "id", "label")


def _graph(spark, folder):
    code = _code(spark, folder)
    snips = storage.written(extraction.snippets(code), "snippets")
    return graph.nodes(code, snips), graph.edges(snips)


def node_neighbours(spark, folder):
    return graph.node_neighbours(_graph(spark, folder)[1])


def query_x_vectors(spark, folder):
    return _rounded(
        search.distance_profile(_label_queries(spark, folder), _vectors(spark, folder)), "nearest", "mean"
    )


def topic_x_sentence(spark, folder):
    return (
        topics.topic_scores(_clustered(spark, folder, 3)).groupBy("doc_id", "cluster")
        .agg(F.count("*").alias("related"), F.round(F.max("score"), 5).alias("best"))
    )


# ---- aggregations ----------------------------------------------------------------------

def graph_counts(spark, folder):
    return graph.graph_counts(*_graph(spark, folder))


def snippet_counts(spark, folder):
    return extraction.snippet_counts(_snippets(spark, folder))


def calls_by_method(spark, folder):
    listed = extraction.calls_by_method(extraction.extract_calls(_decls(spark, folder)))
    return listed.withColumn("calls", F.array_join("calls", ","))


def members_by_type(spark, folder):
    listed = extraction.members_by_type(_decls(spark, folder, "field", "method"))
    return listed.select(
        "path", "type_name", F.array_join("fields", ",").alias("fields"), F.array_join("methods", ",").alias("methods")
    )


def nodes_last_wins(spark, folder):
    return graph.nodes_last_wins(_snippets(spark, folder)).select("node_id", "type", "content")


def edges_dedup(spark, folder):
    return graph.edges(_snippets(spark, folder))


def mean_pool(spark, folder):
    return _rounded(_label_means(spark, folder).select("id", F.posexplode("embedding").alias("dim", "x")), "x")


def tfidf_weights(spark, folder):
    return _rounded(tfidf.tfidf(_documents(spark, folder)), "w")


def _clustered(spark, folder, k):
    return topics.cluster_documents(tfidf.tfidf(_documents(spark, folder)), k)


def kmeans_topics(spark, folder):
    return topics.kmeans_topics(_clustered(spark, folder, 3))


def kmeans_corpus(spark, folder):
    return topics.corpus_topics(_documents(spark, folder))


def seeded_topics(spark, folder):
    return seeding.seeded_topics(_documents(spark, folder))


# ---- top-k -----------------------------------------------------------------------------

def topk_l2(spark, folder):
    return _rounded(search.topk(_label_queries(spark, folder), _vectors(spark, folder), 5, "l2"), "score")


def top1_cosine(spark, folder):
    return _rounded(search.topk(_label_queries(spark, folder), _vectors(spark, folder), 1, "cosine"), "score")


def cluster_medoid(spark, folder):
    return topics.cluster_medoid(_clustered(spark, folder, 3))


def key_sentences(spark, folder):
    return _rounded(topics.key_sentences(_clustered(spark, folder, 3)).drop("medoid"), "score")


def no_hit_rows(spark, folder):
    nations = documents.read_table(spark, folder, "nation").select(
        (F.col("n_nationkey") + 1_000_000).cast("bigint").alias("query_id"), F.col("n_name").alias("text")
    )
    asked = _bench_queries(spark, folder).unionByName(nations)
    hits = search.topk_text(asked, _texts(spark, folder))
    return _rounded(search.with_misses(asked, hits), "score")


def graph_context(spark, folder):
    nodes, edges = _graph(spark, folder)
    number = F.col("n_nationkey").cast("string")
    asked = documents.read_table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("Nation"), number, F.lit(" touch")).alias("text")
    )
    vectors = embedding.embed(nodes.select(F.col("node_id").alias("id"), F.col("content").alias("text")))
    queries = embedding.embed(asked).withColumnRenamed("id", "query_id")
    best = search.topk(queries, vectors, 1, "cosine").select("query_id", F.col("id").alias("node_id"))
    return graph.graph_context(storage.written(best, "best"), nodes, edges)


def topk_sparse_cosine(spark, folder):
    return _rounded(search.topk_text(_bench_queries(spark, folder), _texts(spark, folder)), "score")


# ---- sets ------------------------------------------------------------------------------

def all_relations(spark, folder):
    decls = _stored_decls(spark, folder)
    return relations.all_relations(
        extraction.extract_types(decls), extraction.extract_fields(decls),
        extraction.extract_calls(decls), extraction.declared_imports(decls),
    ).drop("path")


def extends_edges(spark, folder):
    return relations.extends_edges(_types(spark, folder)).drop("path")


def implements_edges(spark, folder):
    return relations.implements_edges(_types(spark, folder)).drop("path")


def type_catalogue(spark, folder):
    return relations.type_catalogue(_types(spark, folder)).select("name", "kind", "path")


def code_graph(spark, folder):
    nodes, edges = _graph(spark, folder)
    degree = graph.node_neighbours(edges).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.join(degree, "node_id", "left").select(
        "node_id", "type", F.md5("content").alias("content_md5"), F.coalesce("degree", F.lit(0)).alias("degree")
    )


# ---- scalar functions ------------------------------------------------------------------

def clean_label(spark, folder):
    pages = documents.read_table(spark, folder, "pages")
    return pages.select("page_id", text_fn.clean_label(F.col("html")).alias("label"))


def split_sentences(spark, folder):
    return tfidf.split_sentences(_documents(spark, folder)).select("doc_id", "sent_id", "sentence")


def sentence_model(spark, folder):
    return sentences.sentences(_documents(spark, folder))


def tokenize(spark, folder):
    return tfidf.tokenize(tfidf.split_sentences(_documents(spark, folder))).select("doc_id", "sent_id", "term")


def _to_label_mean(spark, folder, measure, name):
    vectors = documents.read_table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    means = _label_means(spark, folder).select(F.col("id").alias("label"), F.col("embedding").alias("centre"))
    return vectors.join(means, "label").select(
        "vec_id", F.round(measure(F.col("centre"), F.col("embedding")), 5).alias(name)
    )


def node_key(spark, folder):
    return _types(spark, folder).select(graph.node_key("path", "name").alias("node_id"), "kind")


def content_digest(spark, folder):
    return file_source.content_digest(_doc_files(spark, folder))


def truncate_tokens(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", F.posexplode(text_fn.token_windows(F.col("text"))).alias("part", "text")
    )


# ---- text products ---------------------------------------------------------------------

def class_diagram(spark, folder):
    decls = _stored_decls(spark, folder)
    types = extraction.extract_types(decls)
    fields, methods = extraction.extract_fields(decls), extraction.extract_methods(decls)
    edges = relations.all_relations(
        types, fields, extraction.extract_calls(decls), extraction.declared_imports(decls)
    )
    return rendering.class_diagram(
        relations.type_catalogue(types), fields, methods, edges, extraction.declared_packages(decls)
    )


def _doc_hits(spark, folder):
    items = documents.read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("lang").alias("kind"), F.col("text").alias("content"),
    )
    hits = search.topk_text(_bench_queries(spark, folder), _texts(spark, folder))
    return search.fetch_hits(hits, items)


def _prompts(spark, folder, style):
    return rendering.prompt(_bench_queries(spark, folder), _doc_hits(spark, folder), style)


def extractive_summary(spark, folder):
    return topics.extractive_summary(_documents(spark, folder))


def graph_summary(spark, folder):
    return ranking.graph_summary(_documents(spark, folder))


def _weights(spark, folder):
    """Sentence weights that topics and summary share: split and counted once, written."""
    return storage.written(tfidf.sentence_weights(_documents(spark, folder)), "sentence-weights")


def _weighed(weights, k):
    return topics.cluster_documents(weights.filter(F.col("term").isNotNull()).select("doc_id", "sent_id", "term", "w"), k)


def _points(spark, folder, k, clustered=None):
    medoids = topics.cluster_medoid(_clustered(spark, folder, k) if clustered is None else clustered)
    return topics.key_points(medoids, _documents(spark, folder))


def extract_key_points(spark, folder):
    return _points(spark, folder, 5)


def _topics_and_summary(spark, folder):
    docs, weights = _documents(spark, folder), _weights(spark, folder)
    return topics.topics_and_key_sentences(_weighed(weights, 3), docs), topics.extractive_summary(docs, weights=weights)


def topics_and_key_sentences(spark, folder):
    found, summary = _topics_and_summary(spark, folder)
    return found.join(summary, "doc_id")


def mindmap(spark, folder):
    return rendering.mindmap(*_topics_and_summary(spark, folder))


def flowchart(spark, folder):
    weights = _weights(spark, folder)
    points = _points(spark, folder, 5, _weighed(weights, 5))
    return rendering.flowchart(points, topics.extractive_summary(_documents(spark, folder), weights=weights))


def sequence_diagram(spark, folder):
    return rendering.sequence_diagram(_points(spark, folder, 4))


# ---- streaming, incremental, user functions --------------------------------------------

def run_stream_search(spark, folder):
    out = storage.new_folder(spark, "stream")
    schema = documents.read_table(spark, folder, "conversations").schema
    # as a pattern, since a table may be one file or a folder of files
    turns = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/conversations.parque[t]")
    asked = turns.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("query_id"), "text")
    index = search.text_index(_texts(spark, folder))
    items = documents.read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("content")
    )

    def answer(batch):
        asked = storage.written(batch, "asked")
        hits = storage.written(search.search_text(asked, index), "hits")
        prompts = rendering.prompt(asked, search.fetch_hits(hits, items), "numbered")
        # a prompt is stored once, not with each of its hits
        return hits.groupBy("query_id").agg(F.collect_list(F.struct("rank", "id", "score")).alias("hits")).join(prompts, "query_id")

    stream_search(asked, answer, f"{out}/hits", f"{out}/state").awaitTermination()
    found = spark.read.parquet(f"{out}/hits")
    found = found.select("query_id", F.inline("hits"), F.md5("prompt").alias("prompt_md5"))
    return _rounded(found.select("query_id", "rank", "id", "score", "prompt_md5"), "score")


def incremental_index(spark, folder):
    docs = documents.read_table(spark, folder, "documents").select("doc_id", "text")
    labels = documents.read_table(spark, folder, "labels").select("doc_id", "toxic")
    pages = documents.read_table(spark, folder, "pages")
    name = lambda head, key: F.concat(F.lit(head), F.col(key).cast("string")).alias("path")
    new = docs.select(name("docs/", "doc_id"), F.md5("text").alias("content_md5"))
    was = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    old = docs.join(labels, "doc_id").select(name("docs/", "doc_id"), F.md5(was).alias("content_md5"))
    gone = pages.select(name("pages/", "page_id"), F.md5("html").alias("content_md5"))
    return file_source.changed_files(old.unionByName(gone), new)


def _foldered(spark, folder):
    """The documents as files of folders, now and before: toxic ones were other, unlabelled ones are new, pages are gone."""
    docs = documents.read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    labels = documents.read_table(spark, folder, "labels").select("doc_id", "toxic")
    pages = documents.read_table(spark, folder, "pages")
    path = F.concat_ws("/", F.lit("docs"), "source", "lang", F.col("doc_id").cast("string")).alias("path")
    new = docs.select(path, F.md5("text").alias("content_md5"))
    was = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    old = docs.join(labels, "doc_id").select(path, F.md5(was).alias("content_md5"))
    gone = pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.md5("html").alias("content_md5"))
    return old.unionByName(gone), new


def folder_digests(spark, folder):
    return folders.folder_tree(_foldered(spark, folder)[1]).filter("NOT is_file").select("level", "path", "n_files", "digest")


def changed_folders(spark, folder):
    """What differs between two stored trees, found from the root."""
    roots = [storage.new_folder(spark, "tree") for _ in range(2)]
    for files, root in zip(_foldered(spark, folder), roots):
        folders.store_tree(folders.folder_tree(files), root)
    return folders.compare_trees(spark, *roots)


def apply_changes(spark, folder):
    """An index that goes through changed, added, removed and restored files, and a compaction."""
    root, now = storage.new_folder(spark, "versions"), storage.written(_code(spark, folder), "files")
    path, content = F.col("path"), F.col("content")
    before = now.filter(~path.startswith("Größe")).select(
        "path", F.when(path.startswith("src/model/Customer"), F.replace(content, F.lit("touch"), F.lit("poke"))).otherwise(content).alias("content")
    )
    gone = now.filter(path.startswith("src/model/Region")).select(F.replace("path", F.lit("model"), F.lit("old")).alias("path"), "content")
    versions.create(spark, root, before.unionByName(gone), _build_index)
    versions.apply_changes(spark, root, now, _build_index)
    versions.apply_changes(spark, root, now.filter(~path.startswith("src/model/Nation")), _build_index)
    versions.compact(spark, root)
    versions.apply_changes(spark, root, now, _build_index)
    cells = F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint")
    return versions.read(spark, root).select("path", "kind", "name", F.md5("content").alias("content_md5"), cells.alias("cells"), "since")


def stream_index(spark, folder):
    """The same index from a stream: files arrive in three batches, some twice, some to be removed;
    the last batch is delivered again."""
    root, out = storage.new_folder(spark, "stream-index"), storage.new_folder(spark, "arrivals")
    now, path = storage.written(_code(spark, folder), "files"), F.col("path")
    arrivals = [
        now.select("path", F.when(path.startswith("src/model"), F.concat("content", F.lit("// old\n"))).otherwise(F.col("content")).alias("content")).unionByName(
            now.filter(path.startswith("src/model/Region")).select(F.replace("path", F.lit("model"), F.lit("old")).alias("path"), "content")
        ),
        now.filter(path.startswith("src/model")).select("path", "content"),
        now.filter(path.startswith("src/model/Region")).select(F.replace("path", F.lit("model"), F.lit("old")).alias("path"), F.lit(None).cast("string").alias("content")),
    ]
    for i, arrived in enumerate(arrivals):
        arrived.write.parquet(f"{out}/{i}")
        follow_files(spark, f"{out}/*", root, _build_index, f"{out}-state")
    versions.apply_batch(spark, root, arrivals[-1], _build_index, len(arrivals) - 1)
    return versions.read(spark, root).select("path", "kind", "name", F.md5("content").alias("content_md5"), "since")


def hash_embed(spark, folder):
    cells = embedding.embed(_texts(spark, folder)).select("id", F.posexplode("embedding").alias("dim", "x"))
    return _rounded(cells.filter(F.col("x") != 0), "x")


def embed_long(spark, folder):
    """Whole documents, 512 words at a time."""
    cells = embedding.embed_long(_texts(spark, folder)).select("id", F.posexplode("embedding").alias("dim", "x"))
    return _rounded(cells.filter(F.col("x") != 0), "x")


def subword_windows(spark, folder):
    """What an encoder of 512 tokens reads of each document, with 64 tokens of the window before."""
    windows = subwords.subword_windows(_texts(spark, folder), "byte_bpe_50k.json", 512, 64)
    return windows.select("id", "part", "n_tokens", "begin", "stop", F.md5("text").alias("text_md5"))


def _digest_of(prompts: list[str]) -> list[str]:
    """A stand-in model: the digest of the whole prompt."""
    import hashlib

    return ["Seen: " + hashlib.md5(p.encode()).hexdigest() for p in prompts]


def batch_generate(spark, folder):
    return generation.generate(_prompts(spark, folder, "numbered"), _digest_of)


def answer_store(spark, folder):
    """All documents after the labelled ones: answers to texts seen before come from the store."""
    docs = _documents(spark, folder)
    labelled = docs.join(documents.read_table(spark, folder, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    store = storage.new_folder(spark, "answers")

    def ask(texts: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit("Summarise:\n"), F.col("text")).alias("prompt")
        return generation.answer_once(texts.select(F.col("doc_id").alias("query_id"), prompt), _digest_of, store)

    ask(labelled)
    return ask(docs)


QUERIES: dict[str, Query] = {
    "scan_files": scan_files,
    "quarantine_bad_files": quarantine_bad_files,
    "drop_empty_files": drop_empty_files,
    "corpus_fingerprint": corpus_fingerprint,
    "load_or_create_index": load_or_create_index,
    "code_search": code_search,
    "code_prompt": code_prompt,
    "read_documents": _documents,
    "write_diagram": write_diagram,
    "results_table": results_table,
    "strip_comments": strip_comments,
    "extract_packages": extract_packages,
    "package_members": package_members,
    "extract_imports": extract_imports,
    "extract_types": extract_types,
    "explode_implements": explode_implements,
    "extract_type_body": extract_type_body,
    "extract_methods": extract_methods,
    "extract_fields": extract_fields,
    "extract_calls": extract_calls,
    "top_level_snippets": top_level_snippets,
    "nested_declarations": nested_declarations,
    "declaration_name": declaration_name,
    "slice_span": slice_span,
    "filter_common_types": filter_common_types,
    "flatten_snippets": flatten_snippets,
    "syntax_nodes": syntax_nodes,
    "resolved_calls": resolved_calls,
    "qualified_types": qualified_types,
    "qualified_relations": qualified_relations,
    "associates_edges": associates_edges,
    "uses_edges": uses_edges,
    "fetch_hits": fetch_hits,
    "node_neighbours": node_neighbours,
    "query_x_vectors": query_x_vectors,
    "topic_x_sentence": topic_x_sentence,
    "graph_counts": graph_counts,
    "snippet_counts": snippet_counts,
    "calls_by_method": calls_by_method,
    "members_by_type": members_by_type,
    "nodes_last_wins": nodes_last_wins,
    "edges_dedup": edges_dedup,
    "mean_pool": mean_pool,
    "tfidf": tfidf_weights,
    "kmeans_topics": kmeans_topics,
    "kmeans_corpus": kmeans_corpus,
    "seeded_topics": seeded_topics,
    "topk_l2": topk_l2,
    "top1_cosine": top1_cosine,
    "cluster_medoid": cluster_medoid,
    "key_sentences": key_sentences,
    "no_hit_rows": no_hit_rows,
    "graph_context": graph_context,
    "topk_sparse_cosine": topk_sparse_cosine,
    "all_relations": all_relations,
    "extends_edges": extends_edges,
    "implements_edges": implements_edges,
    "type_catalogue": type_catalogue,
    "code_graph": code_graph,
    "clean_label": clean_label,
    "split_sentences": split_sentences,
    "sentence_model": sentence_model,
    "tokenize": tokenize,
    "l2_distance": partial(_to_label_mean, measure=vector_fn.l2_distance, name="d"),
    "cosine_similarity": partial(_to_label_mean, measure=vector_fn.cosine_similarity, name="c"),
    "node_key": node_key,
    "content_digest": content_digest,
    "truncate_tokens": truncate_tokens,
    "class_diagram": class_diagram,
    "prompt_typed": partial(_prompts, style="typed"),
    "prompt_numbered": partial(_prompts, style="numbered"),
    "extractive_summary": extractive_summary,
    "graph_summary": graph_summary,
    "extract_key_points": extract_key_points,
    "topics_and_key_sentences": topics_and_key_sentences,
    "mindmap": mindmap,
    "flowchart": flowchart,
    "sequence_diagram": sequence_diagram,
    "stream_search": run_stream_search,
    "incremental_index": incremental_index,
    "folder_digests": folder_digests,
    "changed_folders": changed_folders,
    "apply_changes": apply_changes,
    "stream_index": stream_index,
    "hash_embed": hash_embed,
    "embed_long": embed_long,
    "subword_windows": subword_windows,
    "batch_generate": batch_generate,
    "answer_store": answer_store,
}
