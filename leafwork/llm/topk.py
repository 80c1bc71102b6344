"""Exact top-k search by MaxScore (operator 1).

Scores are BM25 with quantised impacts: each term of a query adds floor(1000 * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B *
length / mean length))), so sums are exact and the order, by score and then by the smaller document id, is total.

Documents are cut into shards. Within a shard a query's terms are sorted by their largest impact there; the longest run of
the weakest whose bounds sum to less than the k-th best score so far is non-essential. Postings of the essential terms are
traversed a range of documents at a time, and documents stay only while their score and the bounds of the terms not yet
probed reach the k-th best; the non-essential terms are probed for those, strongest first. The k-th best carries over
between the shards of a task. The shards' best are merged by rank.

Scale: only postings of terms that some query holds are made. They are written once to the checkpoint folder, because
document frequencies and mean length must cover all documents before the first score. Queries and their terms are gathered
on the driver and broadcast; they are the small side by nature; a query table of more than ``most_query_bytes`` is searched in parts by the hash of the id, one
after the other, which changes no result since queries don't interact. The merge gets k rows a query and task.

Edge cases: a null or blank query has no terms and no results; queries that share an id are one; repeated terms of a query count once; a null or blank
document has no postings but counts in the number of documents; rows with a null id are left out on either side; repeated
documents are results of their own; documents that share no term with the query are no results; ties as above; empty tables
give an empty result; texts are read whole whatever their length; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafwork.session import cut

K = 10
K1, B = 1.2, 0.75
SHARD_DOCS = 4096
RANGE = 1024
MOST_QUERY_BYTES = 64 << 20
_WORD = re.compile(r"[^\W_]+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _postings(vocabulary, shard_docs: int):
    """Rows of one shard each: documents, and postings as term ids with offsets into document places and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_id = vocabulary.value
        for batch in batches:
            for a in range(0, batch.num_rows, shard_docs):
                part = batch.slice(a, shard_docs)
                length, by_term = [], {}
                for place, text in enumerate(part.column(1)):
                    found = terms(text.as_py())
                    length.append(len(found))
                    for t, n in Counter(found).items():
                        i = term_id.get(t)
                        if i is not None:
                            by_term.setdefault(i, []).append((place, n))
                ids = sorted(by_term)
                flat = np.array([x for i in ids for x in by_term[i]], np.int32).reshape(-1, 2)
                at = np.cumsum([0, *(len(by_term[i]) for i in ids)])
                pack = lambda x, kind: pa.array([np.asarray(x, kind).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pack(part.column(0).to_numpy(), np.int64), pack(length, np.int32), pack(ids, np.int32), pack(at, np.int32), pack(flat[:, 0], np.int32), pack(flat[:, 1], np.int32)],
                    ["docs", "length", "terms", "at", "place", "tf"],
                )

    return run


_SHARD = "docs binary, length binary, terms binary, at binary, place binary, tf binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, n = np.frombuffer(r["terms"], np.int32), np.diff(np.frombuffer(r["at"], np.int32))
            length = np.frombuffer(r["length"], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, [-1, -2]).astype(np.int32)), pa.array(np.append(n, [len(length), length.sum(dtype=np.int64)]).astype(np.int64))], ["term", "n"])


def best_of_shard(query: np.ndarray, impact: dict[int, tuple[np.ndarray, np.ndarray]], docs: np.ndarray, k: int, top: list[tuple[int, int]], span: int = RANGE) -> list[tuple[int, int]]:
    """Update ``top``, the best (score, -doc) so far in descending order, with a shard, by MaxScore."""
    have = sorted((int(impact[t][1].max()), t) for t in query.tolist() if t in impact)
    if not have:
        return top
    bound = np.cumsum([0] + [b for b, _ in have])
    score = np.zeros(span, np.int64)
    for low in range(0, len(docs), span):
        kth = top[-1][0] if len(top) >= k else 0
        if bound[-1] < kth:
            return top
        split = max(0, int(np.searchsorted(bound, kth, "left")) - 1)
        n = min(span, len(docs) - low)
        score[:n] = 0
        for _, t in have[split:]:
            place, value = impact[t]
            a, b = np.searchsorted(place, (low, low + n))
            score[place[a:b] - low] += value[a:b]
        live = np.flatnonzero(score[:n])
        for j in range(split - 1, -1, -1):
            live = live[score[live] + bound[j + 1] >= kth]
            if not len(live):
                break
            place, value = impact[have[j][1]]
            at = np.searchsorted(place, live + low)
            hit = np.flatnonzero((at < len(place)) & (place[np.minimum(at, len(place) - 1)] == live + low))
            score[live[hit]] += value[at[hit]]
        live = live[score[live] >= max(kth, 1)]
        if len(live):
            if len(live) > k:
                live = live[np.lexsort((docs[live + low], -score[live]))[:k]]
            top = sorted(top + list(zip(score[live].tolist(), (-docs[live + low]).tolist())), reverse=True)[:k]
    return top


def _search(queries, statistics, k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = statistics.value
        tops: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                v = {n: np.frombuffer(x, np.int64 if n == "docs" else np.int32) for n, x in r.items()}
                norm = k1 * (1 - b + b * v["length"][v["place"]] / mean)
                weight = np.repeat(idf[v["terms"]], np.diff(v["at"]))
                value = np.floor(1000 * weight * (v["tf"] * (k1 + 1)) / (v["tf"] + norm)).astype(np.int64)
                impact = {t: (v["place"][s:e], value[s:e]) for t, s, e in zip(v["terms"].tolist(), v["at"], v["at"][1:])}
                for i, (_, own) in enumerate(queries.value):
                    tops[i] = best_of_shard(own, impact, v["docs"], k, tops.get(i, []))
        rows = [(queries.value[i][0], -d, s) for i, top in tops.items() for s, d in top]
        if rows:
            q, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["query_id", "doc_id", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text", k1: float = K1, b: float = B, shard_docs: int = SHARD_DOCS, most_query_bytes: int = MOST_QUERY_BYTES) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the k best documents of every query."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).cast("long").alias("i"), F.col(query_text).alias("t")).where("i is not null and t is not null")
    size = asked.agg(F.sum(F.length("t") + 8)).first()[0] or 0
    if size > most_query_bytes:
        parts = -(-size // most_query_bytes) + 1
        found = [top_k(docs, asked.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p), k, doc_id, doc_text, "i", "t", k1, b, shard_docs, 1 << 62) for p in range(parts)]
        return reduce(DataFrame.unionByName, found)
    merged: dict[int, set[str]] = {}
    for r in asked.collect():
        merged.setdefault(r["i"], set()).update(terms(r["t"]))
    own = [(i, sorted(ts)) for i, ts in merged.items()]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in own for t in ts}))}
    sc = spark.sparkContext
    known = sc.broadcast(vocabulary)
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(doc_text), F.lit("")).alias("t")).where("i is not null")
    shards = cut(rows.mapInArrow(_postings(known, shard_docs), _SHARD))
    count = {r["term"]: r["n"] for r in shards.select("terms", "at", "length").mapInArrow(_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = count.pop(-1, 0), count.pop(-2, 0)
    df = np.array([count.get(i, 0) for i in range(len(vocabulary))], np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    asked_terms = sc.broadcast([(i, np.array([vocabulary[t] for t in ts], np.int64)) for i, ts in own])
    found = shards.mapInArrow(_search(asked_terms, sc.broadcast((idf, max(total, 1) / max(n, 1))), k, k1, b), "query_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
st AS (SELECT count(*) AS n, sum(len(w)) AS total FROM d),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark),
p AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
i AS (SELECT p.doc_id, p.t, CAST(floor(1000 * ln(1 + (st.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * (p.tf * ({K1}::DOUBLE + 1))
      / (p.tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * p.len / (st.total::DOUBLE / st.n)))) AS BIGINT) AS v FROM p JOIN f USING (t), st),
s AS (SELECT query_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY ALL HAVING sum(v) > 0)
SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
WHERE rank <= {K}
"""
