"""Training tables: model inputs of two shapes, facets with their abstracts, labelled corpora, additions.

Joins and samples go by keys and hashes of them, so a table of any size is handled in
parts. Null texts count as empty. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.relational import sample_per_group, shuffled, without


def abstract_row(title: Column, abstract: Column) -> Column:
    """An abstract as the classifier reads it: a chunk of that section."""
    return T.format_chunk(F.coalesce(abstract, F.lit("")), F.lit("abstract"), title)


def model_inputs(df: DataFrame, name: str = "text_in") -> DataFrame:
    """Add the classifier's input to rows of (text, section) or of (abstract); a title is used if there is one."""
    title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
    if {"text", "section"} <= set(df.columns):
        return df.withColumn(name, T.format_chunk(F.coalesce("text", F.lit("")), F.col("section"), title))
    if "abstract" in df.columns:
        return df.withColumn(name, abstract_row(title, F.col("abstract")))
    raise ValueError(f"need columns (text, section) or (abstract), got {df.columns}")


def paper_titles(chunks: DataFrame, key: str, order: str = "chunk_index") -> DataFrame:
    """(key, title) from the title chunk; of several, the last in ``order``, then the greatest text."""
    found = chunks.where(F.col("section") == "title")
    return found.groupBy(key).agg(F.max_by("text", F.struct(order, "text")).alias("title"))


def chunk_texts(chunks: DataFrame, key: str, with_title: bool = True, order: str = "chunk_index") -> DataFrame:
    """Chunks with ``text_in``, what the classifier reads; a ``title`` of theirs is replaced."""
    bare = chunks.drop("title")
    if with_title:
        bare = bare.join(paper_titles(chunks, key, order), key, "left")
    out = model_inputs(bare)
    return out.drop("title") if with_title else out


def facet_corpus(facets: DataFrame, chunks: DataFrame, key: str, order: str = "chunk_index", least_words: int = 20) -> DataFrame:
    """Facet rows with their item's abstract (``text``, ``n_words``), of at least ``least_words`` words.

    Abstract chunks that repeat a text of their item count once, at their first place.
    """
    parts = chunks.where(F.col("section") == "abstract").groupBy(key, "text").agg(F.min(order).alias(order), F.max("n_words").alias("n_words"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    whole = parts.groupBy(key).agg(joined.alias("text"), F.sum("n_words").alias("n_words")).where(F.col("n_words") >= least_words)
    return facets.join(whole, key)


def training_corpus(abstracts: DataFrame | None, chunks: DataFrame | None, label: str, classes: list[str], key: str, most_chunks: int | None = None, seed: str = "corpus") -> DataFrame:
    """(key, source, text_in, label_id) of both kinds of rows whose label is one of ``classes``.

    With ``most_chunks``, a sampling parameter, the chunks with the smallest hashes stay.
    """
    if abstracts is None and chunks is None:
        raise ValueError("need abstracts, chunks or both")
    parts = []
    if abstracts is not None:
        parts.append(model_inputs(abstracts).withColumn("source", F.lit("abstract")))
    if chunks is not None:
        if most_chunks is not None:
            chunks = chunks.orderBy(shuffled(key, seed), key).limit(most_chunks)
        parts.append(model_inputs(chunks).withColumn("source", F.lit("chunk")))
    number = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label)) - 1
    rows = [p.select(key, "source", "text_in", number.cast("int").alias("label_id")) for p in parts]
    return (rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])).where("label_id >= 0")


def additions(pool: DataFrame, corpora: list[DataFrame], key: str, group: str, n: int, wanted: Column, seed: str = "additions") -> DataFrame:
    """Up to ``n`` rows per group of those ``wanted`` and labelled that no corpus has, by hash."""
    fresh = without(pool.where(wanted & F.col(group).isNotNull()), [c.select(key) for c in corpora], key)
    return sample_per_group(fresh, [group], key, n, seed)


def gold_sample(rows: DataFrame, key: str, design: str, facets: dict[str, int], per_design: int, unlabelled: int, seed: str = "gold") -> DataFrame:
    """Rows to annotate, each once, with ``reasons``: some per design, more with rare facets, some without a design.

    ``facets``: how many rows of each boolean facet column are wanted.
    """
    picks = [sample_per_group(rows.where(F.col(design).isNotNull()), [design], key, per_design, seed).select(key, F.lit("design").alias("_why"))]
    for name, n in facets.items():
        picks.append(rows.where(F.col(name)).orderBy(shuffled(key, f"{seed}-{name}"), key).limit(n).select(key, F.lit(name).alias("_why")))
    picks.append(rows.where(F.col(design).isNull()).orderBy(shuffled(key, f"{seed}-none"), key).limit(unlabelled).select(key, F.lit("unlabelled").alias("_why")))
    every = picks[0]
    for p in picks[1:]:
        every = every.unionByName(p)
    return rows.join(every.groupBy(key).agg(F.array_sort(F.collect_set("_why")).alias("reasons")), key)
