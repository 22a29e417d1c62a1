"""Duplicate and conflict rules as grouped aggregates and ranks; no group is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.errors import InvalidInput
from textquarry.functions.text import has_tokens, strip
from textquarry.operators.skew import lookup_join
from textquarry.session import materialize


def majority_labels(df: DataFrame, text: str, label: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """(text, label, rows, labels) with the one most frequent label of each exact text; texts whose best labels tie
    are dropped. Texts and labels are stripped, empty ones dropped, labels mapped.

    Counts of (text, label) combine before the shuffle, so a text that a third of all rows share is one row of
    each task by then.
    """
    plain = df.select(strip(F.col(text)).alias("text"), strip(F.col(label)).alias("label")).where("text <> '' and label <> ''")
    plain = plain.replace(mapping or {}, subset=["label"]) if mapping else plain
    counts = plain.groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("text").agg(F.max("n").alias("most"), F.max_by("label", "n").alias("label"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("labels"))
    winners = counts.join(best.select("text", "most"), "text").where("n = most").groupBy("text").agg(F.count(F.lit(1)).alias("winners"))
    return best.join(winners.where("winners = 1"), "text").select("text", "label", "rows", "labels")


def majority_statistics(df: DataFrame, text: str, label: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """One row: rows, kept (texts), empty (rows), ties (texts), resolved (texts of several labels with a winner)."""
    plain = df.select(strip(F.coalesce(F.col(text), F.lit(""))).alias("t"), strip(F.coalesce(F.col(label), F.lit(""))).alias("l"))
    sums = plain.agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.col("t") == "") | (F.col("l") == "")).alias("empty"))
    kept = majority_labels(df, text, label, mapping)
    texts = plain.where("t <> '' and l <> ''").select("t").distinct().agg(F.count(F.lit(1))).scalar()
    both = sums.select("*", kept.agg(F.count(F.lit(1))).scalar().alias("kept"), kept.where("labels > 1").agg(F.count(F.lit(1))).scalar().alias("resolved"))
    return both.select("rows", "empty", "kept", (texts - F.col("kept")).alias("ties"), "resolved")


def require_statistics(statistics: DataFrame, expected: dict[str, int]) -> DataFrame:
    """The statistics, if each expected control number holds; a number that differs is an error that names all."""
    found = statistics.first().asDict()
    wrong = [f"{name}: {found.get(name)} instead of {n}" for name, n in expected.items() if found.get(name) != n]
    if wrong:
        raise InvalidInput("control numbers differ: " + ", ".join(wrong))
    return statistics


def deduplicate(df: DataFrame, duplicates: str = "error", conflicts: str = "error", tie: str = "error") -> DataFrame:
    """Rows (id, text, label, split) with each text once.

    duplicates, for texts whose rows have one label (null is one): error, drop (all copies go) or keep (the
    smallest id stays). conflicts, for several labels: error, or majority, whose smallest id stays; then tie:
    error, or drop all its rows.
    """
    for name, value, allowed in (("duplicates", duplicates, ("error", "drop", "keep")), ("conflicts", conflicts, ("error", "majority")), ("tie", tie, ("error", "drop"))):
        if value not in allowed:
            raise InvalidInput(f"{name} is one of {', '.join(allowed)}")
    # Rows of one text, label and split that share an id are alike; the smallest id stands for its label.
    by_label = df.groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "split")).alias("first"))
    order = Window.partitionBy("text").orderBy(F.desc("n"), F.asc_nulls_first("label"))
    whole = Window.partitionBy("text")
    ranked = by_label.withColumns({"rank": F.row_number().over(order), "labels": F.count(F.lit(1)).over(whole), "rows": F.sum("n").over(whole), "most": F.max("n").over(whole)})
    ranked = ranked.withColumn("best", F.count_if(F.col("n") == F.col("most")).over(whole)).where("rank = 1")
    repeated, conflict = (F.col("labels") == 1) & (F.col("rows") > 1), F.col("labels") > 1
    tied = conflict & (F.col("best") > 1)
    found = ranked.agg(F.count_if(repeated).alias("duplicates"), F.count_if(conflict).alias("conflicts"), F.count_if(tied).alias("ties")).first() if "error" in (duplicates, conflicts, tie) else None
    if found:
        if duplicates == "error" and found["duplicates"]:
            raise InvalidInput(f"{found['duplicates']} texts are repeated")
        if conflicts == "error" and found["conflicts"]:
            raise InvalidInput(f"{found['conflicts']} texts have several labels")
        if tie == "error" and conflicts == "majority" and found["ties"]:
            raise InvalidInput(f"{found['ties']} texts have no most frequent label")
    kept = ranked.where(~tied)
    kept = kept.where(~repeated) if duplicates == "drop" else kept
    return kept.select(F.col("first.id").alias("id"), "text", "label", F.col("first.split").alias("split"))


def unrepeated(df: DataFrame, key: str, valid: Column | None = None, valid_first: bool = False) -> DataFrame:
    """Rows whose key no other row has; blank keys are dropped. Only valid rows come out; with valid_first only
    they count as repeats, else rows that are not valid do too."""
    rows = df.where(F.coalesce(strip(F.col(key)), F.lit("")) != "")
    rows = rows.where(valid) if valid is not None and valid_first else rows
    once = rows.groupBy(key).count().where("count = 1").select(key)
    out = rows.join(once, key, "left_semi")
    return out.where(valid) if valid is not None else out


def first_of_text(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Of rows equal in the columns (null as empty) the one of smallest order. min_by combines before the shuffle."""
    key = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def top_by_hash(df: DataFrame, groups: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group by SHA-256 of order, then by order; each task keeps n of a group before the
    shuffle."""
    by = Window.partitionBy(*groups).orderBy(F.sha2(F.col(order).cast("string"), 256), order)
    return df.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= n).drop("_rank")


def distinct_per_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, texts): number of distinct rows of the columns in each group, null as empty."""
    key = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns]), 256)
    return df.select(group, key.alias("_key")).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("texts"))


def greedy_unique(df: DataFrame, order: str, keys: list[str], rounds: int = 1000) -> DataFrame:
    """Rows that a scan in the given order keeps: each whose keys no kept row has had before.

    A row is kept once it is the first of the undecided in the groups of all its keys; then all others of these
    groups go. Rounds repeat this until none is undecided, two or three mostly, as a round decides the first
    row of every chain of conflicts. order is unique; rows with a null key never conflict by it.
    """
    columns = [F.when(F.col(k).isNull(), F.xxhash64(F.lit(i), order)).otherwise(F.xxhash64(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    undecided = materialize(df.select(F.col(order).alias("o"), *columns), "undecided")
    kept = None
    for _ in range(rounds):
        marked = undecided
        for i in range(len(keys)):
            first = undecided.groupBy(f"k{i}").agg(F.min("o").alias(f"first_{i}"), F.count(F.lit(1)).alias("_n"))
            marked = lookup_join(marked, first, f"k{i}", "_n", "o")
        marked = materialize(marked, "marked")
        winners = marked.where(" and ".join(f"o = first_{i}" for i in range(len(keys)))).select("o", *[f"k{i}" for i in range(len(keys))])
        kept = winners.select("o") if kept is None else kept.unionByName(winners.select("o"))
        rest = undecided
        for i in range(len(keys)):
            rest = rest.join(winners.select(f"k{i}"), f"k{i}", "left_anti")
        undecided = materialize(rest.select(undecided.columns), "undecided")
        if undecided.isEmpty():
            return df.join(kept.withColumnRenamed("o", order), order, "left_semi")
    raise RuntimeError("rows stayed undecided")


def first_rows(df: DataFrame, order: str, n: int, held: int = 100_000, buckets: int = 1024) -> DataFrame:
    """The n rows of smallest order, a unique whole number. Up to `held` rows are a top-n; for more, the n-th value
    is found by counting ranges of values, so rows are neither sorted nor gathered."""
    if n <= held:
        return df.orderBy(order).limit(n)
    if df.isEmpty():
        return df
    low, high = df.agg(F.min(order), F.max(order)).first()
    below = 0
    while low < high:
        width = max(1, -(-(high - low + 1) // buckets))
        inside = df.where(F.col(order).between(low, high))
        counts = inside.groupBy(F.floor((F.col(order) - low) / width).alias("b")).count().orderBy("b").collect()
        for b, count in counts:
            if below + count >= n:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            below += count
        else:
            return df
    return df.where(F.col(order) <= low)


def load_corpus(documents: DataFrame, limit: int, minimum: int = 2) -> tuple[DataFrame, DataFrame]:
    """(corpus, counters) of documents (id, title, text, seq): the first `limit` rows, in source order, with tokens
    whose id and body no accepted row has had. counters has scanned, empty and duplicates of the rows up to the
    last one accepted, or of all if there are fewer."""
    if limit < 2:
        raise InvalidInput("the limit is at least 2")
    usable = documents.withColumn("_tokens", has_tokens(F.col("text"))).withColumn("_body", F.sha2(F.coalesce("text", F.lit("")), 256))
    unique = greedy_unique(usable.where("_tokens"), "seq", ["id", "_body"])
    corpus = materialize(first_rows(unique, "seq", limit).drop("_tokens", "_body"), "corpus")
    found = corpus.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).first()
    if found["n"] < minimum:
        raise InvalidInput(f"{minimum} documents with text are needed, there are {found['n']}")
    seen = usable.where(F.col("seq") <= found["last"]) if found["n"] == limit else usable
    counters = seen.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~F.col("_tokens")).alias("empty")).withColumn("duplicates", F.col("scanned") - F.col("empty") - found["n"])
    return corpus, counters.withColumn("documents", F.lit(found["n"]).cast("long"))
