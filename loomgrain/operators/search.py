"""Text search: corpus scan, regular expressions by line, BM25, fuzzy words, phrases, merged ranking, chunks."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.cluster import cut
from loomgrain.functions import text as t

#: Published defaults of the ranking function.
K1, B = 1.2, 0.75


def scan_corpus(documents: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """doc_id, content, n_bytes, lines of the texts within the limit; control characters are dropped, null texts too."""
    kept = documents.filter(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    content = t.strip_controls(F.col("text"))
    return kept.select("doc_id", content.alias("content")).select("doc_id", "content", F.octet_length("content").alias("n_bytes"), t.line_count(F.col("content")).alias("lines"))


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no from 1, line."""
    return documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("__at", "line")).select("doc_id", (F.col("__at") + 1).alias("line_no"), "line")


def regex_lines(documents: DataFrame, pattern: str, most_bytes: int = 1000) -> DataFrame:
    """doc_id, line_no, line (without white space at its ends) of the lines that a pattern fits; longer lines are left out.

    Texts without the trigrams that every match must hold are skipped before they are split.
    """
    for gram in t.required_trigrams(pattern):
        documents = documents.filter(F.contains(F.col("text"), F.lit(gram)))
    found = lines(documents).filter((F.octet_length("line") <= most_bytes) & F.rlike("line", F.lit(pattern)))
    return found.select("doc_id", "line_no", F.trim(F.col("line")).alias("line"))


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(documents: DataFrame, terms: Sequence[str], field: Column, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score of the documents that hold any of the terms.

    The frequency of each term is counted in the document's own row, once: the counts are written to the
    checkpoint folder, since both the corpus' numbers and the scores need them. Nothing is exploded or shuffled. Terms are lower-case words as by code_words().
    """
    terms = list(dict.fromkeys(terms))
    words = t.code_words(field)
    counted = documents.filter(field.isNotNull()).select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("dl"), *(_times("w", term).alias(f"tf{i}") for i, term in enumerate(terms)))
    counted = cut(counted)
    corpus = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("mean")))).otherwise(0.0)
    return counted.crossJoin(F.broadcast(corpus)).select("doc_id", score.alias("score")).filter("score > 0")


def ranked_search(documents: DataFrame, terms: Sequence[str], limit: int) -> DataFrame:
    """The `limit` best documents by the sum of BM25 over text and path."""
    both = bm25(documents, terms, F.col("text")).unionByName(bm25(documents, terms, F.col("file_path")))
    return both.groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def merged_search(ranked: DataFrame, hits: DataFrame, sources: Column, boost: float = 5.0, source_boost: float = 10.0, limit: int = 50) -> DataFrame:
    """Ranked documents and documents with lines that fit a pattern in one list.

    hits: doc_id and what `sources` tests. A hit adds boost, and source_boost more where it is source code.
    """
    found = hits.groupBy("doc_id").agg(F.max(F.when(sources, boost + source_boost).otherwise(boost)).alias("extra"))
    both = ranked.join(found, "doc_id", "full").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0)), 6).alias("score"))
    return both.orderBy(F.desc("score"), "doc_id").limit(limit)


def vocabulary(documents: DataFrame) -> DataFrame:
    """word and the number of documents that hold it."""
    return documents.filter("text is not null").select(F.explode(F.array_distinct(t.code_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("documents"))


def fuzzy_words(documents: DataFrame, query: str, most: int = 2) -> DataFrame:
    """word, documents, distance of the corpus' words within a distance; a transposition counts 1."""
    near = vocabulary(documents).filter(F.length("word").between(len(query) - most, len(query) + most))
    return near.withColumn("distance", t.fuzzy_distance(query, most)(F.col("word"))).filter(F.col("distance") <= most)


def phrase_search(rows: DataFrame, key: str, field: str, phrase: Sequence[str]) -> DataFrame:
    """Rows whose words hold the phrase's words one after the other, with how often."""
    spaced = F.concat(F.lit(" "), F.array_join(t.code_words(F.col(field)), "  "), F.lit(" "))
    wanted = " " + "  ".join(phrase) + " "
    n = (F.length(spaced) - F.length(F.replace(spaced, F.lit(wanted), F.lit("")))) / len(wanted)
    return rows.filter(F.col(field).isNotNull()).select(key, n.cast("int").alias("times")).filter("times > 0")


def distinct_ranked(ranked: DataFrame, group: str, place: str, field: str, threshold: float = 0.95) -> DataFrame:
    """Ranked rows without those that resemble a better one that is kept, greedily by place within each group.

    A group is one query's result list, which a top-k limits. Resemblance is the Jaccard index of
    the word sets, over the threshold.
    """
    schema = ranked.schema

    def keep(pdf):
        kept, sets = [], []
        for row in pdf.sort_values(place).itertuples():
            words = set((getattr(row, field) or "").lower().split())
            if any(len(words & s) > threshold * len(words | s) for s in sets):
                continue
            sets.append(words)
            kept.append(row.Index)
        return pdf.loc[kept]

    return ranked.groupBy(group).applyInPandas(keep, schema)


def window_chunks(documents: DataFrame, size: int = 2000, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_no, byte_offset, chunk: windows of characters over each whole text."""
    step = size - overlap
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    rows = documents.filter("text <> ''").select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start"))
    return rows.select("doc_id", "chunk_no", F.octet_length(F.substring(F.col("text"), F.lit(1), F.col("start"))).alias("byte_offset"), F.substring(F.col("text"), F.col("start") + 1, F.lit(size)).alias("chunk"))


def markdown_chunks(documents: DataFrame, most: int = 512, overlap: int = 64, least: int = 50) -> DataFrame:
    """doc_id, chunk_no, heading, content, tokens: Markdown texts cut at headings and paragraphs."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            who, columns = [], ([], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (heading, content) in enumerate(t.markdown_chunks(text, most, overlap, least)):
                    who.append(i)
                    for c, v in zip(columns, (k, heading, content, -(-len(content.encode()) // 4))):
                        c.append(v)
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *arrays], names=["doc_id", "chunk_no", "heading", "content", "tokens"])

    return documents.select("doc_id", "text").filter("text <> ''").mapInArrow(run, f"doc_id {kind}, chunk_no int, heading string, content string, tokens bigint")
