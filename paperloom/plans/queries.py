"""The queries of the document operators: each takes (spark, sf_dir) and gives flat columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import rules as R
from paperloom.functions.keywords import marks
from paperloom.functions.text import strip
from paperloom.operators import bounded, chat, chunks, classify, entities, headers, items, reader, tables, tags, vectors
from paperloom.plans import run
from paperloom.plans.rendered import raw_tables, rendered
from paperloom.sources import ingest, store
from paperloom.sources.buckets import Bucketed
from paperloom.sources.store import shared_dir
from paperloom.streaming import sessions

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classified(spark, sf_dir):
    return classify.classified(rendered(spark, sf_dir))


@query
def rendered_docs(spark, sf_dir):
    return rendered(spark, sf_dir)


@query
def doc_layout_hints(spark, sf_dir):
    both = rendered(spark, sf_dir).select("doc_id", "full_text").union(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text"))
    out = both.select("doc_id", classify.layout(F.col("full_text")).alias("l")).select("doc_id", "l.*")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_line_length", "colon_ratio")})


@query
def doc_tier1_scores(spark, sf_dir):
    docs = rendered(spark, sf_dir).select("doc_id", marks(F.col("full_text")).alias("found"))
    rows = F.array(*[F.struct(F.lit(n).alias("document_type"), F.round(c, 6).alias("score")) for n, c in classify.type_scores(F.col("found"))])
    return docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


@query
def doc_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "document_type", F.round("class_confidence", 6).alias("class_confidence"))


@query
def known_docs(spark, sf_dir):
    return classify.known(_classified(spark, sf_dir)).select("doc_id", "document_type")


@query
def kv_pairs(spark, sf_dir):
    docs = rendered(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(entities.entity_pairs(F.col("full_text"))).alias("pos", "p")).select("doc_id", "pos", "p.key", "p.value")


def _entity(kind: str, table: str):
    def run(spark, sf_dir):
        docs = rendered(spark, sf_dir).select("doc_id", F.col("full_text").alias("text")) if table == "rendered" else _table(spark, sf_dir, "documents").select("doc_id", "text")
        return docs.select("doc_id", F.posexplode(entities.found(F.col("text"), kind)).alias("pos", "value"))

    return run


for _kind, _name, _input in (
    ("dates", "entity_dates", "rendered"),
    ("amounts", "entity_amounts", "rendered"),
    ("totals", "entity_totals", "rendered"),
    ("order_ids", "entity_order_ids", "rendered"),
    ("invoice_ids", "entity_invoice_ids", "rendered"),
    ("email_addresses", "entity_emails", "documents"),
    ("phone_numbers", "entity_phones", "documents"),
    ("postal_codes", "entity_postal", "documents"),
):
    QUERIES[_name] = _entity(_kind, _input)


@query
def profile_dates_amounts(spark, sf_dir):
    docs = rendered(spark, sf_dir)
    both = F.concat(F.transform(classify.detected_dates(F.col("full_text")), lambda d: F.struct(F.lit("date").alias("kind"), d.alias("value"))), F.transform(classify.detected_amounts(F.col("full_text")), lambda d: F.struct(F.lit("amount").alias("kind"), d.alias("value"))))
    return docs.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.*")


def _field_rows(df: DataFrame) -> DataFrame:
    names = entities.FIELDS
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"typed_fields.{n}").alias("value")) for n in names])
    return df.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*").where("value is not null")


@query
def typed_fields(spark, sf_dir):
    docs = _classified(spark, sf_dir)
    return _field_rows(docs.withColumn("typed_fields", entities.typed_fields(F.col("full_text"), F.col("document_type"))))


@query
def typed_fields_enriched(spark, sf_dir):
    return reader.field_rows(rendered(spark, sf_dir))


@query
def document_mode(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", items.document_mode(F.col("full_text")).alias("document_mode"))


@query
def line_items(spark, sf_dir):
    docs = rendered(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(items.line_items(F.col("full_text"))).alias("pos", "i")).select("doc_id", "pos", "i.*")


@query
def total_validation(spark, sf_dir):
    return reader.normalised(rendered(spark, sf_dir)).select("doc_id", *[F.round(c, 2).alias(c) for c in ("ext_total", "calc_total", "total_amount")])


@query
def completeness_score(spark, sf_dir):
    return reader.normalised(rendered(spark, sf_dir)).select("doc_id", "order_id", "customer_id", "customer_name", "order_date", F.round("confidence", 4).alias("confidence"))


@query
def doc_summary(spark, sf_dir):
    return reader.summaries(rendered(spark, sf_dir)).select("doc_id", F.md5("text").alias("summary_md5"), F.char_length("text").alias("n_chars"))


@query
def header_chunk(spark, sf_dir):
    return reader.headers(rendered(spark, sf_dir))


@query
def header_products(spark, sf_dir):
    """The products that a header chunk takes from a document's tables."""
    return headers.products(tables.normalise_tables(raw_tables(spark, sf_dir)))


@query
def doc_chunks(spark, sf_dir):
    out = reader.chunks(rendered(spark, sf_dir)).withColumn("chunk_id", chunks.chunk_id(F.col("doc_id"), F.col("number")))
    return out.select("doc_id", "chunk_id", "chunk_type", "page_number", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def table_cells_clean(spark, sf_dir):
    docs = raw_tables(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(tables.clean(F.get("raw_tables", F.lit(0)))).alias("row", "cells")).select("doc_id", "row", F.posexplode("cells").alias("col", "cell"))


@query
def kv_table_detect(spark, sf_dir):
    return raw_tables(spark, sf_dir).select("doc_id", tables.is_key_table(tables.clean(F.get("raw_tables", F.lit(0)))).alias("is_key_table"))


@query
def table_header_infer(spark, sf_dir):
    t = tables.clean(F.get("raw_tables", F.lit(0)))
    docs = raw_tables(spark, sf_dir).select("doc_id", t.alias("t")).where(~tables.is_key_table(F.col("t"))).withColumn("at", tables.header_row(F.col("t")))
    return docs.select("doc_id", "at", F.posexplode(tables.headers(F.col("t"), F.col("at"))).alias("pos", "header"))


@query
def table_footer_totals(spark, sf_dir):
    docs = tables.normalise_tables(raw_tables(spark, sf_dir))
    return docs.select("doc_id", F.explode(F.flatten(F.transform("tables", lambda t: t["totals"]))).alias("x")).select("doc_id", "x.*")


@query
def table_normalise(spark, sf_dir):
    docs = tables.normalise_tables(raw_tables(spark, sf_dir)).select("doc_id", F.explode("tables").alias("t"))
    return docs.select("doc_id", F.col("t.table_type").alias("table_type"), F.size("t.headers").alias("n_headers"), F.size("t.rows").alias("n_rows"), F.md5("t.raw_text").alias("text_md5"))


LABELS = sorted({x for labels in (*R.ENRICHED_FIELDS.values(), *headers.PRODUCTS.values()) for x in labels})


@query
def fuzzy_header_match(spark, sf_dir):
    """The column of each data table that each label is most like, if it is like any."""
    data = headers.data_tables(tables.normalise_tables(raw_tables(spark, sf_dir)), "tables", "doc_id").drop("rows")
    found = headers.label_columns(data.select("headers").distinct(), LABELS)
    return data.join(found, "headers").select("doc_id", "no", "label", "column", F.round("score", 6).alias("score"))


@query
def typed_fields_tables(spark, sf_dir):
    """Typed fields after all steps of enrichment: pairs, table columns by their names, and footer totals."""
    return reader.field_rows(rendered(spark, sf_dir).join(raw_tables(spark, sf_dir), "doc_id", "left"))


def _paged(spark, sf_dir):
    """Documents in two pages, their first line and the rest, with the tables on the second."""
    docs = rendered(spark, sf_dir).join(raw_tables(spark, sf_dir), "doc_id", "left")
    cut = F.instr("full_text", "\n")
    none = F.array().cast("array<array<array<string>>>")
    page = lambda n, text, found: F.struct(F.lit(n).alias("page_number"), text.alias("text"), F.coalesce(found, none).alias("raw_tables"))
    tail = F.substring("full_text", cut + 1, F.char_length("full_text"))
    return docs.select("doc_id", F.array(page(2, tail, F.col("raw_tables")), page(1, F.substring("full_text", F.lit(1), cut - 1), none)).alias("pages"))


@query
def document_run(spark, sf_dir):
    """A whole run over documents with pages and tables, a row a document."""
    done = run.run(_paged(spark, sf_dir))
    errors = F.concat_ws("; ", *[f"{step.name}_error" for step in run.STEPS])
    return done.select(
        "doc_id", "document_type", F.round("class_confidence", 6).alias("class_confidence"), "document_mode", F.size("pages").alias("n_pages"), F.size("tables").alias("n_tables"), F.size("line_items").alias("n_items"), F.size("chunks").alias("n_chunks"),
        F.round("confidence", 4).alias("confidence"), F.md5("summary").alias("summary_md5"), F.get_json_object("profile_json", "$.doc_type").alias("profile_type"), F.get_json_object("normalized_schema", "$.order_id").alias("order_id"), errors.alias("errors"),
    )


@query
def document_run_chunks(spark, sf_dir):
    """The chunks of such a run: header with products, pages, tables and entities."""
    out = chunks.listed(run.run(_paged(spark, sf_dir)))
    return out.select("doc_id", "chunk_id", "chunk_type", "page_number", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def page_chunks_boundary(spark, sf_dir):
    return chunks.exploded(_table(spark, sf_dir, "documents"), chunks.page_chunks(F.col("text")), "doc_id").select("doc_id", "pos", F.md5("text").alias("text_md5"))


@query
def char_chunks(spark, sf_dir):
    return chunks.exploded(_table(spark, sf_dir, "documents"), chunks.char_chunks(F.col("text")), "doc_id").select("doc_id", "pos", F.md5("text").alias("text_md5"))


@query
def domain_tags(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", F.posexplode(tags.domains(F.col("full_text"))).alias("pos", "tag"))


@query
def risk_level(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", tags.risk(F.col("full_text"), _amount()).alias("risk"))


def _amount():
    """The first total without its currency sign."""
    return F.regexp_replace(F.get(entities.found(F.col("full_text"), "totals"), F.lit(0)), r"[^0-9.,]", "")


@query
def amount_bucket(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", tags.amount_bucket(_amount()).alias("bucket"))


@query
def vendor_tag(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", tags.vendor(F.col("full_text")).alias("vendor")).where("vendor is not null")


@query
def generate_tags(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", F.posexplode(tags.tags(F.col("full_text"), F.col("document_type"), _amount(), F.col("keywords"))).alias("pos", "tag"))


@query
def mean_pool_vectors(spark, sf_dir):
    return vectors.pooled(_table(spark, sf_dir, "embeddings"), "label").select("label", "pos", F.round("value", 4).alias("value"))


def _hits(spark, sf_dir, k, **more):
    e = _table(spark, sf_dir, "embeddings")
    return vectors.search(e.where("vec_id % 20 = 0"), e, k, **more).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query
def vector_search_topk(spark, sf_dir):
    return _hits(spark, sf_dir, R.TOP_K)


@query
def similar_documents(spark, sf_dir):
    return _hits(spark, sf_dir, R.TOP_K, without_self=True)


@query
def vector_search_bounded(spark, sf_dir):
    """The same hits by an index of groups, of which those that can't have any are left out."""
    e = _table(spark, sf_dir, "embeddings")
    return bounded.search(e.where("vec_id % 20 = 0"), bounded.index(e)).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def _retriever(spark, sf_dir, doc_filter):
    e = _table(spark, sf_dir, "embeddings")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    metadata = e.join(docs, e.vec_id == docs.doc_id, "left").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("type"), F.col("label").cast("string")).alias("document_type"), F.array(F.concat(F.lit("Tag"), (F.col("vec_id") % 3).cast("string"))).alias("tags"), strip(F.coalesce("text", F.lit(""))).alias("cleaned_text"))
    return vectors.Retriever(e.select(F.col("vec_id").alias("doc_id"), "embedding"), metadata, doc_filter=doc_filter), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query
def filtered_retrieval(spark, sf_dir):
    r, q = _retriever(spark, sf_dir, "TAG1")
    return r.candidates(q).select("query_id", "doc_id", "rank", "document_type")


@query
def mmr_retrieval(spark, sf_dir):
    r, q = _retriever(spark, sf_dir, None)
    return r.retrieve(q).select("query_id", "pick", "doc_id")


@query
def rag_context(spark, sf_dir):
    r, q = _retriever(spark, sf_dir, "tag1")
    return chat.context(r.retrieve(q)).select("query_id", F.md5("context").alias("context_md5"))


@query
def rag_sources(spark, sf_dir):
    r, q = _retriever(spark, sf_dir, "tag1")
    return chat.sources(r.retrieve(q), r.candidates(q)).select("query_id", "pick", "doc_name", "page", "similarity_score", "document_type", "content_preview")


@query
def risk_addendum_flag(spark, sf_dir):
    docs = _classified(spark, sf_dir).withColumn("tags", tags.tags(F.col("full_text"), F.col("document_type"), _amount(), F.col("keywords")))
    return docs.groupBy("variant").agg(F.bool_or(chat.risky(F.col("document_type"), F.col("tags"))).alias("any_risk"), F.sum(chat.risky(F.col("document_type"), F.col("tags")).cast("long")).alias("n_risky"))


@query
def chat_window(spark, sf_dir):
    return chat.memory(_table(spark, sf_dir, "conversations"), 2)


@query
def chat_memory_stream(spark, sf_dir):
    """The last exchanges of each session, with the turns as a stream whose state goes to a bucketed table."""
    session, here = sessions.stateful(spark), f"{shared_dir(spark)}/paperloom/chat-{uuid.uuid4().hex}"
    # Streams read folders or patterns, not a file.
    turns = session.readStream.schema(_table(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations*.parquet")
    table = Bucketed(session, f"{here}/table", "conv_id", buckets=32)
    sessions.follow(turns, table, f"{here}/checkpoint").awaitTermination()
    return Bucketed(spark, f"{here}/table", "conv_id", buckets=32).read().where("n_messages > 0")


@query
def chat_history(spark, sf_dir):
    return chat.history(_table(spark, sf_dir, "conversations"))


@query
def chat_clear(spark, sf_dir):
    return chat.without_session(_table(spark, sf_dir, "conversations"), 7).groupBy("conv_id").agg(F.count("*").alias("n"))


@query
def metadata_upsert(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("old").alias("status"))
    return store.upsert(docs.where("doc_id % 3 > 0"), docs.where("doc_id % 5 = 0 or doc_id % 3 = 0").withColumn("status", F.lit("new")))


@query
def metadata_upsert_bucketed(spark, sf_dir):
    """Two batches of a bucketed table, the second over some of the first's keys, and the table after them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("old").alias("status"))
    table = Bucketed(spark, f"{shared_dir(spark)}/paperloom/metadata-{uuid.uuid4().hex}", buckets=32)
    table.upsert(docs.where("doc_id % 3 > 0"), 0)
    table.upsert(docs.where("doc_id % 5 = 0 or doc_id % 3 = 0").withColumn("status", F.lit("new")), 1)
    return table.read()


@query
def index_insert_bucketed(spark, sf_dir):
    """An index of vectors to which those with new keys are added, a bucket at a time."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    table = Bucketed(spark, f"{shared_dir(spark)}/paperloom/index-{uuid.uuid4().hex}", "vec_id", buckets=32)
    table.insert_absent(e.where("vec_id % 2 = 0"), 0)
    table.insert_absent(e.where("vec_id % 3 = 0 or vec_id % 2 = 1").withColumn("label", F.lit(-1)), 1)
    return table.read().select("vec_id", "label")


@query
def metadata_latest(spark, sf_dir):
    return store.latest(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query
def metadata_lookup(spark, sf_dir):
    return store.lookup(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), 11)


@query
def index_insert_absent(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return store.insert_absent(e.where("vec_id % 2 = 0"), e.where("vec_id % 3 = 0 or vec_id % 2 = 1").withColumn("label", F.lit(-1))).select("vec_id", "label")


@query
def index_rebuild_count(spark, sf_dir):
    return store.rebuilt(_table(spark, sf_dir, "embeddings")).agg(F.count("*").alias("n"))


@query
def upload_validation(spark, sf_dir):
    names = _table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.element_at(F.array(*map(F.lit, (".PDF", ".tiff", "", ".scan.Jpeg", ".docx"))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("filename"))
    return names.select("doc_id", ingest.extension(F.col("filename")).alias("extension"), ingest.accepted(F.col("filename")).alias("ok"))


@query
def page_concat(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    half = F.floor(F.char_length("text") / 2).cast("int")
    pages = F.array(*[F.struct(F.lit(n).alias("page_number"), t.alias("text"), F.array().cast("array<array<array<string>>>").alias("raw_tables")) for n, t in ((2, F.substring("text", half + 1, F.lit(1 << 30))), (1, F.substring("text", F.lit(1), half)))])
    return ingest.finalised(docs.select("doc_id", pages.alias("pages"))).select("doc_id", "char_count", "word_count", "page_count", "ocr_status", F.md5("full_text").alias("text_md5"))


@query
def structured_sink(spark, sf_dir):
    """What is persisted of each document, read back from its JSON."""
    parts = F.transform(chunks.char_chunks(F.col("text"), 600, 0), lambda t, i: F.struct(F.format_string("c%d", i + 1).alias("chunk_id"), F.lit("page_text").alias("chunk_type"), (i + 1).alias("page_number"), t.alias("text")))
    stored = store.structured(_table(spark, sf_dir, "documents").select("doc_id", "source", parts.alias("chunks")))
    back = stored.select("doc_id", F.explode(F.from_json("json", "struct<source string, chunks array<struct<chunk_id string, page int, text string>>>")["chunks"]).alias("c"))
    return back.select("doc_id", F.col("c.page").alias("pos"), F.char_length("c.text").alias("n_chars"))


@query
def profile_pairs(spark, sf_dir):
    """The key/value pairs of a profile: keys of any length, as many as it holds."""
    docs = rendered(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(classify.pairs(F.col("full_text"))).alias("pos", "p")).select("doc_id", "pos", "p.key", "p.value")


@query
def tables_by_page(spark, sf_dir):
    """Tables, a row each, gathered by document and page: those of few rows on one page, the others on the next."""
    one = raw_tables(spark, sf_dir).select("doc_id", F.posexplode("raw_tables").alias("table_no", "rows")).withColumn("page_number", F.when(F.size("rows") < 5, 1).otherwise(2))
    out = ingest.tables_by_page(one)
    return out.select("doc_id", "page_number", F.size("raw_tables").alias("n_tables"), F.size(F.flatten("raw_tables")).alias("n_rows"))


@query
def stored_texts(spark, sf_dir):
    """Texts written to the text store and read from it."""
    path = f"{shared_dir(spark)}/paperloom/texts-{uuid.uuid4().hex}"
    store.write_texts(_table(spark, sf_dir, "documents"), path)
    return store.stored_texts(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


@query
def text_information(spark, sf_dir):
    """Extraction from texts of no known type, those without one in hand taken from the text store."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = entities.information(docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text"))), docs)
    return out.select("doc_id", "extraction_status", F.char_length("cleaned_text").alias("n_chars"), F.array_join("email_addresses", ",").alias("emails"), F.array_join("phone_numbers", ",").alias("phones"), F.array_join("postal_codes", ",").alias("postal"))


@query
def rag_prompt(spark, sf_dir):
    """What a model is asked: the question of each query with its context and the session's memory."""
    r, q = _retriever(spark, sf_dir, "tag1")
    found = r.retrieve(q)
    risk = found.groupBy("query_id").agg(F.bool_or(chat.risky(F.col("document_type"), F.col("tags"))).alias("risky"))
    said = chat.memory(_table(spark, sf_dir, "conversations"), 2).select(F.col("conv_id").alias("query_id"), "memory")
    asked = q.select("query_id").join(chat.context(found), "query_id", "left").join(risk, "query_id", "left").join(said, "query_id", "left")
    prompt = chat.prompt(F.concat(F.lit("What does "), F.col("query_id").cast("string"), F.lit(" say?")), F.col("context"), F.coalesce("memory", F.lit("")), F.coalesce("risky", F.lit(False)))
    return asked.select("query_id", prompt.alias("p")).select("query_id", F.md5("p.system").alias("system_md5"), F.md5("p.user").alias("user_md5"))


@query
def index_rebuild_rows(spark, sf_dir):
    """The vectors of a rebuilt index."""
    return store.rebuilt(_table(spark, sf_dir, "embeddings")).select("vec_id", "label", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query
def doc_classify_tables(spark, sf_dir):
    """Classification of documents that come with tables."""
    docs = rendered(spark, sf_dir).join(raw_tables(spark, sf_dir), "doc_id", "left")
    return classify.classified(docs, tables="raw_tables").select("doc_id", "has_tables", "document_type", F.round("class_confidence", 6).alias("class_confidence"))


@query
def table_entities(spark, sf_dir):
    """What tables add to a document's entities: rows as strings, and footer values."""
    docs = tables.normalise_tables(raw_tables(spark, sf_dir)).withColumns({"totals": F.array().cast("array<string>"), "key_value_pairs": F.array().cast(classify.PAIRS)})
    return entities.with_table_entities(docs, "tables").select("doc_id", F.size("table_entities").alias("n_rows"), F.md5(F.array_join("table_entities", "\n")).alias("rows_md5"), F.array_join("totals", ",").alias("totals"), F.size("key_value_pairs").alias("n_pairs"))
