"""Entity graph of enriched documents: mentions, nodes, edges, their queries.

``enriched``: document_id and ``e``, a struct of functions.enrichment.SCHEMA.
``chunks``: document_id, chunk_index, start_char, end_char, content_type, text.
Spans meet chunks in an equi-join on the document with the overlap as residual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmill.functions.text import decode_span, spans_overlap

EDGE = ["document_id", "source_id", "target_id", "relation", "props"]
_NAMED = {"persons": "person", "locations": "location", "terms": "term", "external_documents": "external_document"}


#: Characters of a bin: documents longer than that spread their spans and chunks over several join keys.
BIN_CHARS = 65536


def span_chunks(spans: DataFrame, chunks: DataFrame, narrative_only: bool = True, bin_chars: int = BIN_CHARS) -> DataFrame:
    """Each span (document_id, start, end, ...) with the chunks that it overlaps.

    An equi-join on the document and a bin of offsets, the overlap as residual;
    a pair that shares several bins counts in the one where the overlap begins.
    A table chunk's offsets refer to its own markdown, so only narrative chunks take part unless told otherwise.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_chars), F.floor(F.greatest(F.col(a), F.col(b) - 1) / bin_chars)))
    c = chunks.filter("content_type = 'narrative'") if narrative_only and "content_type" in chunks.columns else chunks
    c = c.select(F.col("document_id").alias("__d"), "chunk_index", "start_char", "end_char", bins("start_char", "end_char").alias("__c"))
    first = F.floor(F.greatest("start", "start_char") / bin_chars)
    on = (F.col("document_id") == F.col("__d")) & (F.col("__b") == F.col("__c")) & spans_overlap(F.col("start_char"), F.col("end_char"), F.col("start"), F.col("end")) & (first == F.col("__b"))
    return spans.withColumn("__b", bins("start", "end")).join(c, on).drop("__d", "__b", "__c", "start_char", "end_char")


def first_chunk(spans: DataFrame, chunks: DataFrame, key: list[str], narrative_only: bool = True) -> DataFrame:
    """Each span with the first chunk that it overlaps, or -1."""
    hit = span_chunks(spans, chunks, narrative_only=narrative_only).groupBy(*key).agg(F.min("chunk_index").alias("chunk_index"))
    return spans.join(hit, key, "left").withColumn("chunk_index", F.coalesce("chunk_index", F.lit(-1)).cast("int"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _span_text(span: Column) -> Column:
    return decode_span(F.col("e.text"), span["start"], span["end"])


def _flat(field: str, make) -> Column:
    """One flat array from an entity list: ``make`` gives an array for each entity."""
    return F.flatten(F.transform(F.coalesce(F.col(f"e.{field}"), F.array()), make))


def _explode(enriched: DataFrame, *arrays: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """All entity kinds of a document in one pass over the table."""
    return enriched.select("document_id", *keep, F.explode(F.concat(*arrays)).alias("r")).select("document_id", *keep, "r.*")


_MENTION = ("document_id", "entity_id", "entity_label", "name", "entity_type", "role", "mention_start", "mention_end")


def _mention_rows(enriched: DataFrame, *keep: str) -> DataFrame:
    def of(field: str, label: str) -> Column:
        def one(x: Column) -> Column:
            kind = F.lit("") if label == "term" else x["type"]
            role = F.coalesce(x["role"], F.lit("")) if label == "person" else F.lit("")
            return F.transform(
                F.coalesce(x["mentions"], F.array()),
                lambda m: F.struct(x["id"].alias("entity_id"), F.lit(label).alias("entity_label"), _span_text(x["name"]).alias("name"), kind.alias("entity_type"), role.alias("role"), m["start"].alias("mention_start"), m["end"].alias("mention_end")),
            )

        return _flat(field, one)

    return _explode(enriched, *[of(f, label) for f, label in _NAMED.items()], keep=keep)


def entity_mentions(enriched: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a mention, with the first narrative chunk it lies in, or -1.

    A document's chunk bounds come to its mentions as one array, in order: one shuffle and no join of spans.
    """
    c = chunks.filter("content_type = 'narrative'") if "content_type" in chunks.columns else chunks
    bounds = c.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "start_char", "end_char"))).alias("b"))
    met = F.filter("b", lambda x: spans_overlap(x["start_char"], x["end_char"], F.col("mention_start"), F.col("mention_end")))
    rows = _mention_rows(enriched.join(bounds, "document_id", "left"), "b")
    return rows.select(*_MENTION, F.coalesce(F.try_element_at(met, F.lit(1))["chunk_index"], F.lit(-1)).cast("int").alias("chunk_index"))


def enrichment_meta(enriched: DataFrame) -> DataFrame:
    size = lambda f: F.greatest(F.coalesce(F.size(f"e.{f}"), F.lit(0)), F.lit(0))
    e = {"segment": "segments", "person": "persons", "location": "locations", "term": "terms", "external_doc": "external_documents", "date": "dates", "heading": "headings", "junk_span": "junk"}
    title = F.when(F.col("e.title").isNotNull(), decode_span(F.col("e.text"), F.col("e.title.start"), F.col("e.title.end")))
    return enriched.select(
        "document_id", F.col("e.type").alias("doc_type_enriched"), F.coalesce("e.jurisdiction", F.lit("")).alias("jurisdiction"), F.coalesce(title, F.lit("")).alias("title"), *[size(v).alias(f"{k}_count") for k, v in e.items()]
    )


def _id(*parts) -> Column:
    return F.concat_ws(":", F.col("document_id"), *parts)


def _props(**values: Column) -> Column:
    flat = [y for k, v in values.items() for y in (F.lit(k), v.cast("string"))]
    return F.create_map(*flat)


_NONE = lambda: F.create_map().cast("map<string,string>")


def nodes(enriched: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, node_id, label, props); of several nodes with one id the last kind wins, and of one kind the last in its list."""
    node = lambda i, rank, label, props, at=F.lit(0): F.struct(at.cast("int").alias("at"), i.alias("node_id"), F.lit(rank).alias("rank"), F.lit(label).alias("label"), props.alias("props"))

    def of(field: str, rank: int, label: str, props) -> Column:
        return F.transform(F.coalesce(F.col(f"e.{field}"), F.array()), lambda x, k: node(_id(x["id"]), rank, label, props(x), k))

    named = lambda x: {"name": _span_text(x["name"])}
    rows = _explode(
        enriched,
        F.array(node(F.col("document_id"), 0, "document", _props(type=F.col("e.type"), jurisdiction=F.col("e.jurisdiction"), title=_span_text(F.col("e.title"))))),
        of("segments", 2, "segment", lambda x: _props(kind=x["kind"], type=x["type"], category=x["category"], level=x["level"], title=_span_text(x["title"]), code=_span_text(x["code"]), start=x["span"]["start"], end=x["span"]["end"])),
        of("persons", 3, "person", lambda x: _props(**named(x), type=x["type"], role=x["role"])),
        of("locations", 4, "location", lambda x: _props(**named(x), type=x["type"])),
        of("terms", 5, "term", lambda x: _props(**named(x), meaning=_span_text(x["meaning"]))),
        of("external_documents", 6, "external_document", lambda x: _props(**named(x), type=x["type"], jurisdiction=x["jurisdiction"], reception=x["reception"])),
    )
    c = {k: F.col(k) for k in ("text", "start_char", "end_char", "content_type", "chunk_index")}
    of_chunks = chunks.select("document_id", _id(F.lit("chunk"), F.col("chunk_index").cast("string")).alias("node_id"), F.lit(1).alias("rank"), F.lit("chunk").alias("label"), _props(**c).alias("props"), F.col("chunk_index").cast("int").alias("at"))
    return rows.unionByName(of_chunks).groupBy("document_id", "node_id").agg(F.max_by(F.struct("label", "props"), F.struct("rank", "at")).alias("n")).select("document_id", "node_id", "n.label", "n.props")


def edges(enriched: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, source_id, target_id, relation, props), duplicates kept.

    One pass over the documents for the edges between entities, one for all
    spans of all kinds, which share a single interval join with the chunks.
    """
    doc = F.col("document_id")
    edge = lambda src, dst, rel, props: F.struct(src.alias("source_id"), dst.alias("target_id"), (F.lit(rel) if isinstance(rel, str) else rel).alias("relation"), props.alias("props"))

    def each(field: str, make, keep=None) -> Column:
        rows = F.coalesce(F.col(f"e.{field}"), F.array())
        return F.transform(F.filter(rows, keep) if keep else rows, make)

    def parent(x: Column) -> Column:
        return edge(_id(x["parent"]), _id(x["id"]), "parent_of", _NONE())

    def segment(x: Column) -> Column:
        root = x["parent"].isNull()
        return edge(F.when(root, doc).otherwise(_id(x["parent"])), _id(x["id"]), F.when(root, "contains").otherwise("parent_of"), _NONE())

    contact = lambda field, rel, prop: each(field, lambda x: edge(_id(x["person"]), _id(x["person"]), rel, _props(**{prop: x[prop]})))
    has_parent = lambda x: x["parent"].isNotNull()
    direct = _explode(
        enriched,
        each("segments", segment),
        each("persons", parent, has_parent),
        each("persons", lambda x: edge(_id(x["id"]), _id(x["residence"]), "resides_at", _NONE()), lambda x: x["residence"].isNotNull()),
        each("locations", parent, has_parent),
        each("external_documents", lambda x: edge(doc, _id(x["id"]), "cites", _props(reception=x["reception"]))),
        each("crossreferences", lambda x: edge(_id(x["start"]), _id(x["end"]), "crossreferences", _props(span_start=x["span"]["start"], span_end=x["span"]["end"]))),
        contact("emails", "has_email", "address"),
        contact("websites", "has_website", "url"),
        contact("phone_numbers", "has_phone", "number"),
        contact("id_numbers", "has_id_number", "number"),
        each("dates", lambda x: edge(doc, F.when(x["person"].isNull(), doc).otherwise(_id(x["person"])), F.concat(F.lit("date_"), x["type"]), _props(value=x["value"]))),
    )
    span = lambda i, rel, s: F.struct(_id(i).alias("id"), F.lit(rel).alias("relation"), s["start"].alias("start"), s["end"].alias("end"))
    spans = _explode(
        enriched,
        each("segments", lambda x: span(x["id"], "spans_chunk", x["span"])),
        *[_flat(f, lambda x: F.transform(F.coalesce(x["mentions"], F.array()), lambda m: span(x["id"], "mentioned_in", m))) for f in _NAMED],
        each("crossreferences", lambda x: span(x["start"], "crossref_in", x["span"])),
    )
    chunk = lambda: _id(F.lit("chunk"), F.col("chunk_index").cast("string"))
    within = F.when(F.col("relation") == "spans_chunk", _NONE()).otherwise(_props(start=F.col("start"), end=F.col("end")))
    met = span_chunks(spans, chunks).select("document_id", F.col("id").alias("source_id"), chunk().alias("target_id"), "relation", within.alias("props"))
    contains = chunks.select("document_id", doc.alias("source_id"), chunk().alias("target_id"), F.lit("contains").alias("relation"), _NONE().alias("props"))
    return _union([contains, direct, met])


def edges_to_rows(e: DataFrame) -> DataFrame:
    """One row a property, or one with empty key and value."""
    return e.select("document_id", "source_id", "target_id", "relation", F.explode_outer("props").alias("k", "v")).select(
        "document_id", "source_id", "target_id", "relation", F.coalesce("k", F.lit("")).alias("prop_key"), F.coalesce("v", F.lit("")).alias("prop_value")
    )


def rows_to_edges(rows: DataFrame, regroup: bool = False) -> DataFrame:
    """Edges from rows: one edge a row, or with ``regroup`` the properties of equal edges together."""
    if not regroup:
        props = F.when(F.col("prop_key") != "", F.create_map("prop_key", "prop_value")).otherwise(_NONE())
        return rows.select("document_id", "source_id", "target_id", "relation", props.alias("props"))
    some = F.array_distinct(F.filter(F.collect_list(F.struct("prop_key", "prop_value")), lambda p: p["prop_key"] != ""))
    last = F.aggregate(some, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["prop_key"]), F.create_map(p["prop_key"], p["prop_value"])))
    return rows.groupBy("document_id", "source_id", "target_id", "relation").agg(last.alias("props"))


def dangling(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edge ends without a node."""
    ends = e.select("document_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node_id")).distinct()
    return ends.join(n.select("document_id", "node_id"), ["document_id", "node_id"], "left_anti")


def load_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Stored mentions; a role that is null becomes ''."""
    return spark.read.parquet(path).withColumn("role", F.coalesce("role", F.lit("")))


def nodes_by_label(n: DataFrame, label: str) -> DataFrame:
    return n.filter(F.col("label") == label)


def edges_by_relation(e: DataFrame, relation: str) -> DataFrame:
    return e.filter(F.col("relation") == relation)


def edges_from(e: DataFrame, node_id: str) -> DataFrame:
    return e.filter(F.col("source_id") == node_id)


def edges_to(e: DataFrame, node_id: str) -> DataFrame:
    return e.filter(F.col("target_id") == node_id)


def mentions_for_document(mentions: DataFrame, document_id: str, label: str | None = None) -> DataFrame:
    out = mentions.filter(F.col("document_id") == document_id)
    return out.filter(F.col("entity_label") == label) if label else out


def edges_for_document(e: DataFrame, document_id: str, relation: str | None = None) -> DataFrame:
    out = e.filter(F.col("document_id") == document_id)
    return out.filter(F.col("relation") == relation) if relation else out


def known_spans(enriched: DataFrame, entities=("PERSON",), person_types=("natural",)) -> DataFrame:
    """(document_id, known): the spans that the enrichment says are personal, in document coordinates. Nothing is shuffled."""
    yes = lambda x: F.lit(True)
    kinds = {"PERSON": ("persons", lambda x: x["type"].isin(*person_types)), "ADDRESS": ("locations", lambda x: x["type"] == "address"), "EMAIL": ("emails", yes), "PHONE_NUMBER": ("phone_numbers", yes), "ID_NUMBER": ("id_numbers", yes)}

    def of(kind: str) -> Column:
        field, keep = kinds[kind]
        made = lambda x: F.transform(F.coalesce(x["mentions"], F.array()), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("entity_type")))
        return F.flatten(F.transform(F.filter(F.coalesce(F.col(f"e.{field}"), F.array()), keep), made))

    return enriched.select("document_id", F.sort_array(F.concat(*[of(k) for k in kinds if k in entities])).alias("known")).filter(F.size("known") > 0)
