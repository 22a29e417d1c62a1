"""A benchmark collection from a large corpus: queries in seeded order with reasons for those left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.functions.java_random import JavaRandom
from textquarry.functions.normalize import prepared_tokens
from textquarry.functions.text import body_key, comparison_key
from textquarry.operators.dedup import first_rows, greedy_unique
from textquarry.session import materialize


def candidates(documents: DataFrame, qrels: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, dict]:
    """(relevant, background, counters) of documents (id, title, text, seq) in scan order.

    relevant: the first row with tokens of each judged id. background: the first `limit` rows with tokens whose id
    no earlier background row has and whose body none has had; a row with a known id does not register its body.
    Rows behind the last background row count only where they are judged and not yet found.
    """
    judged = qrels.select(F.col("doc_id").alias("id")).distinct()
    marked = documents.withColumn("_tokens", F.size(prepared_tokens(F.col("text"))) > 0).withColumn("_body", F.sha2(F.coalesce(body_key(F.col("text")), F.lit("")), 256))
    marked = materialize(marked.join(judged.withColumn("_judged", F.lit(True)), "id", "left"), "scanned")
    if marked.where("id is null or trim(id) = ''").count():
        raise InvalidInput("a document has no id")
    usable = marked.where("_tokens")
    relevant = usable.where("_judged").groupBy("id").agg(F.min_by(F.struct(*documents.columns), "seq").alias("r")).select("r.*")
    # The first row of an id is either background or its body was taken; so bodies compete among those rows, and a
    # later row of an id whose first body was taken can still enter. greedy order over (id, body) decides.
    unique = materialize(first_rows(greedy_unique(usable, "seq", ["id", "_body"]), "seq", limit), "background")
    last = unique.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).first()
    full = last["n"] == limit
    within = F.col("seq") <= F.lit(last["last"] if full else 2**62)
    first = marked.where("_judged and _tokens").groupBy("id").agg(F.min("seq").alias("_first"))
    counted = marked.join(first, "id", "left").where(within | (F.col("_judged") & (F.col("_first").isNull() | (F.col("seq") <= F.col("_first")))))
    sums = counted.agg(F.count_if(~F.col("_tokens")).alias("empty"), F.count_if(within & F.col("_tokens")).alias("seen")).first()
    counters = {"scanned": marked.count(), "empty": sums["empty"], "duplicates": sums["seen"] - last["n"]}
    return relevant, unique.select(*documents.columns), counters


def select_queries(relevant: DataFrame, queries: DataFrame, qrels: DataFrame, documents: int, count: int, seed: int = 42, max_queries: int = 1_000_000) -> tuple[list[str], list[str], dict]:
    """(query ids, document ids, statistics): queries in seeded order are taken one after another, as each may rule
    out the next. The driver holds ids and keys of the queries and of their judged documents alone.

    Reasons, the first that holds: empty_query, no_positive_judgment, missing_or_empty_relevant_document,
    duplicate_query, duplicate_relevant_body, document_limit, query_limit.
    """
    keyed = queries.select("query_id", comparison_key(F.col("text")).alias("key"), (F.size(prepared_tokens(F.col("text"))) == 0).alias("empty"))
    found = relevant.select(F.col("id").alias("doc_id"), F.sha2(body_key(F.col("text")), 256).alias("body"), comparison_key(F.coalesce("title", F.lit(""))).alias("title_key"), comparison_key(F.col("text")).alias("text_key"))
    judged = qrels.where("score > 0").select("query_id", "doc_id").join(keyed.select("query_id", "key"), "query_id").join(found, "doc_id", "left")
    relations: dict[str, list] = {}
    for r in judged.select("query_id", "doc_id", "body", (F.col("title_key") == F.col("key")).alias("t"), (F.col("text_key") == F.col("key")).alias("b")).orderBy("query_id", "doc_id").toLocalIterator():
        relations.setdefault(r["query_id"], []).append(r)
    order = [tuple(r) for r in keyed.orderBy("query_id").limit(max_queries + 1).toLocalIterator()]
    if len(order) > max_queries:
        raise InvalidInput(f"more than {max_queries} queries")
    JavaRandom(seed).shuffle(order)
    chosen, kept, bodies, texts = [], {}, {}, set()
    excluded: dict[str, int] = {}
    matches = {"title": 0, "body": 0}
    for name, key, empty in order:
        rows = relations.get(name, [])
        own = {r["body"]: r["doc_id"] for r in rows}
        clash = len(own) < len({r["doc_id"] for r in rows}) or any(bodies.get(b, d) != d for b, d in own.items())
        new = {r["doc_id"] for r in rows} - kept.keys()
        reason = (
            "empty_query" if empty else "no_positive_judgment" if not rows else "missing_or_empty_relevant_document" if any(r["body"] is None for r in rows)
            else "duplicate_query" if key in texts else "duplicate_relevant_body" if clash else "document_limit" if len(kept) + len(new) > documents
            else "query_limit" if len(chosen) >= count else None
        )
        if reason:
            excluded[reason] = excluded.get(reason, 0) + 1
            continue
        chosen.append(name)
        texts.add(key)
        kept.update(dict.fromkeys(r["doc_id"] for r in rows))
        bodies.update(own)
        matches["title"] += any(r["t"] for r in rows)
        matches["body"] += any(r["b"] for r in rows)
    if len(chosen) != count:
        raise InvalidInput(f"{len(chosen)} of {count} queries are usable; left out: {excluded}")
    statistics = {"source_queries": len(order), "queries": len(chosen), "relevant_documents": len(kept), "excluded_queries": dict(sorted(excluded.items())), "query_title_matches": matches["title"], "query_body_matches": matches["body"]}
    return chosen, list(kept), statistics


def build_subset(documents: DataFrame, queries: DataFrame, qrels: DataFrame, size: int, count: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(documents, queries, qrels, statistics): relevant documents in query order, then background in scan order up
    to `size` documents, none with an id or body taken already."""
    spark = documents.sparkSession
    relevant, background, counters = candidates(documents, qrels.where("score > 0"), size)
    chosen, ids, statistics = select_queries(relevant, queries, qrels, size, count, seed)
    first = spark.createDataFrame([(d, i) for i, d in enumerate(ids)], "id string, _order long")
    taken = relevant.join(first, "id")
    body = F.sha2(body_key(F.col("text")), 256)
    rest = background.join(first, "id", "left_anti").withColumn("_body", body).join(taken.select(body.alias("_body")).distinct(), "_body", "left_anti")
    rest = first_rows(rest, "seq", size - len(ids)).withColumn("_order", F.col("seq") + len(ids))
    columns = ["id", "title", "text", "_order"]
    whole = materialize(taken.select(*columns).unionByName(rest.select(*columns)).withColumnRenamed("_order", "seq"), "collection")
    n = whole.count()
    if n != size:
        raise InvalidInput(f"{n} of {size} documents are unique and not empty")
    order = spark.createDataFrame([(q, i) for i, q in enumerate(chosen)], "query_id string, seq long")
    kept = qrels.where("score > 0").join(order.select("query_id"), "query_id", "left_semi")
    return whole, queries.join(order, "query_id"), kept, statistics | {"documents": n, "judgments": kept.count(), "scanned_documents": counters["scanned"], "empty_candidates": counters["empty"], "duplicate_background_candidates": counters["duplicates"]}
