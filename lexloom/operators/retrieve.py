"""Retrieval and its scoring: BM25, dense nearest neighbours, reranking, relevance, ranking metrics, failure causes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.functions.text import SPACE, noise, tokens
from lexloom.plans.joins import SMALL_ROWS, join_counted, small
from lexloom.plans.staging import staged

#: parts of a term's postings where queries are too many to broadcast; queries that meet a document at once
SALTS, SHORT_BLOCK = 64, 1024
#: scores of queries and documents that a task holds at once
SCORES = 2_000_000
#: rows of a block of queries, of the part of it that is compared at once, and of a block of vectors
QUERY_BLOCK, QUERY_SLICE, VECTOR_BLOCK = 4096, 256, 8192


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, rank, score: the best k by (score, id). Spark limits each group per task before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("qid", "doc_id", "rank", "score")


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries: qid, query; docs: doc_id, text. Documents are tokenised once.

    Queries that pass their size test go to every task; a document is then counted and scored where it is, and only the best
    k of a batch are shuffled. More queries, or ids that several rows share, meet postings in joins.
    """
    asked = staged(queries.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "bm25-asked")
    if asked.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS and docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return ranked(_scored_in_place(asked, docs, k, k1, b), k)
    return _bm25_by_joins(asked, docs, k, k1, b)


def _scored_in_place(asked: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """qid, doc_id, score of the best k documents of every batch (more if scores are equal) for every query."""
    pairs = asked.collect()  # at most SMALL_ROWS
    terms = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in pairs))}
    asking = {q: i for i, q in enumerate(dict.fromkeys(r["qid"] for r in pairs))}
    names = list(asking)
    links = sorted((terms[r["term"]], asking[r["qid"]]) for r in pairs)
    askers = np.array([q for _, q in links], np.int64)
    upto = np.searchsorted([t for t, _ in links], np.arange(len(terms) + 1)) if links else np.zeros(1, np.int64)
    ids, qids = docs.schema["doc_id"].dataType, asked.schema["qid"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, held, often = [], [], []
            for text in batch.column(1):
                words = text.as_py().split(" ") if text.as_py() else []
                tf = Counter(terms[w] for w in words if w in terms)
                sizes.append(len(words))
                held.append(list(tf))
                often.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(held, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], ["doc_id", "len", "t", "tf"])

    counted = docs.select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("words")).mapInArrow(count, f"doc_id {ids.simpleString()}, len int, t array<int>, tf array<int>")
    counted = staged(counted, "bm25-postings")
    n, avg_len = counted.agg(F.count(F.lit(1)), F.avg("len")).first()
    df = np.zeros(len(terms))
    for r in counted.select(F.explode("t").alias("t")).groupBy("t").count().collect():  # as many rows as terms
        df[r["t"]] = r["count"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    most = max(1, SCORES // max(1, len(names)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, most) for at in range(0, whole.num_rows, most)):
                sizes, t, tf = batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
                weight = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / avg_len)) if len(t) else np.zeros(0)
                each = upto[t + 1] - upto[t] if len(t) else np.zeros(0, np.int64)
                at = np.repeat(np.cumsum(each) - each, each)
                asker = askers[np.repeat(upto[t], each) + np.arange(len(at)) - at] if len(at) else np.zeros(0, np.int64)
                total = np.bincount(asker * batch.num_rows + np.repeat(doc, each), np.repeat(weight, each), len(names) * batch.num_rows).astype(float).reshape(len(names), batch.num_rows)
                best = np.partition(total, -k, axis=1)[:, -k] if k < batch.num_rows else np.zeros(len(names))
                q, d = np.nonzero((total > 0) & (total >= best[:, None] - 2e-6))  # what rounding makes equal stays
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], to_arrow_type(qids)), batch.column(0).take(pa.array(d)), pa.array(total[q, d])], ["qid", "doc_id", "score"])

    scored = counted.mapInArrow(score, f"qid {qids.simpleString()}, doc_id {ids.simpleString()}, score double")
    return scored.withColumn("score", F.round("score", 6))


def _bm25_by_joins(asked: DataFrame, docs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """As _scored_in_place with joins, for any number of queries.

    A row without a term stands for each document, so that the number and mean length of documents come from the same pass.
    Terms and queries that pass their size test are broadcast; postings stay where they are. Beyond it, postings of a term
    are dealt to SALTS parts.
    """
    wanted = small(asked.select("term").distinct().withColumn("_wanted", F.lit(True)))
    rows = docs.select("doc_id", tokens(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("len"), F.explode(F.array_append("ts", F.lit(""))).alias("term"))
    hits = rows.join(wanted, "term", "left").filter("_wanted or term = ''")
    tf = staged(hits.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len")), "bm25-postings")
    size = tf.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    tf = tf.filter("term != ''")
    df = staged(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "bm25-terms")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = join_counted(tf, df, "term", "df").crossJoin(F.broadcast(size)).select("term", "doc_id", weight.alias("w"))  # one row
    if asked.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        met = scored.join(F.broadcast(asked), "term")
    else:
        met = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        met = met.join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"])
    return ranked(met.groupBy("qid", "doc_id").agg(F.round(F.sum("w"), 6).alias("score")), k)


def _directions(column: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places, unit vectors) of the vectors that have a direction: no null, zero or non-finite ones."""
    by_length: dict[int, list[int]] = {}
    for at, v in enumerate(column):
        if v is not None and len(v):
            by_length.setdefault(len(v), []).append(at)
    out = {}
    for length, places in by_length.items():
        x = np.array([list(column.iloc[at]) for at in places], float)
        norm = np.sqrt((x * x).sum(axis=1))
        fine = np.isfinite(norm) & (norm > 0)
        out[length] = (np.array(places)[fine], x[fine] / norm[fine, None])
    return out


def nearest_in_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of one block of vectors for every query of one block of queries."""
    asked, known = _directions(queries.embedding), _directions(vectors.embedding)
    qids, ids = queries.qid.to_numpy(), vectors.doc_id.to_numpy()
    found = [(qids[:0], ids[:0], np.zeros(0))]
    for length in asked.keys() & known.keys():
        (q_at, q), (v_at, v) = asked[length], known[length]
        for start in range(0, len(q), QUERY_SLICE):
            score = np.round(q[start : start + QUERY_SLICE] @ v.T, 6)
            for row, at in zip(score, q_at[start : start + QUERY_SLICE]):
                row[ids[v_at] == qids[at]] = -np.inf
                least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                some = np.flatnonzero((row >= least) & (row > -np.inf))
                some = some[np.lexsort((ids[v_at[some]], -row[some]))][:k]
                found.append((np.repeat(qids[at], len(some)), ids[v_at[some]], row[some]))
    return pd.DataFrame({c: np.concatenate(parts) for c, parts in zip(("qid", "doc_id", "score"), zip(*found))})


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Cosine k nearest neighbours of every query among all other vectors. Both: vec_id, embedding.

    Queries meet vectors block by block, so a task holds one block of each whatever the size of the tables, and passes on
    at most k rows for each query. Vectors without an id or a direction (null, empty, zero or non-finite) and vectors of
    another length than the query's are nobody's neighbours.
    """
    q = queries.filter("vec_id is not null").select(F.col("vec_id").alias("qid"), "embedding")
    v = vectors.filter("vec_id is not null").select(F.col("vec_id").alias("doc_id"), "embedding")
    n_q, n_v = max(1, -(-q.count() // QUERY_BLOCK)), max(1, -(-v.count() // VECTOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("i", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("j", every(n_v))
    v = v.withColumn("j", F.pmod(F.xxhash64("doc_id"), F.lit(n_v)).cast("int")).withColumn("i", every(n_q))
    types = [df.schema[c].dataType.simpleString() for df, c in ((q, "qid"), (v, "doc_id"))]
    met = q.groupBy("i", "j").cogroup(v.groupBy("i", "j"))
    return ranked(met.applyInPandas(lambda a, b: nearest_in_block(a, b, k), f"qid {types[0]}, doc_id {types[1]}, score double"), k)


def rerank(run: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """Reorder a run by a second score (qid, doc_id, score2); rows without one keep their order after the others."""
    both = run.join(second, ["qid", "doc_id"], "left")
    order = Window.partitionBy("qid").orderBy(F.col("score2").desc_nulls_last(), "rank")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("qid", "doc_id", "rank", "score", "score2")


def containing(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """qid, doc_id where the document holds the query text literally.

    The words of a query but its first and last are whole words of any document that holds it: documents are found by up to
    three of them in a row. Queries of fewer than three words have no such anchor; they meet every document in blocks.
    """
    words = lambda c: F.array_remove(F.split(c, f"[{SPACE}]+"), "")
    asked = staged(queries.filter("query is not null").select("qid", "query", words(F.col("query")).alias("w")), "asked")
    run = lambda first, k: F.xxhash64(F.lit(k), *[F.get("w", first + j) for j in range(k)])
    k = F.least(F.size("w") - 2, F.lit(3))
    anchored = asked.filter(F.size("w") >= 3).select("qid", k.alias("k"), F.when(k == 1, run(F.lit(1), 1)).when(k == 2, run(F.lit(1), 2)).otherwise(run(F.lit(1), 3)).alias("anchor"))
    lengths = [r["k"] for r in anchored.select("k").distinct().collect()]  # three at most
    w = F.col("w")
    grams = lambda k: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: run(i, k))
    none = F.array().cast("array<bigint>")
    found = F.array_distinct(F.concat(none, *[F.when(F.size(w) >= k, grams(k)).otherwise(none) for k in lengths]))
    text = docs.filter("text is not null").select("doc_id", "text", words(F.col("text")).alias("w"))
    hits = text.select("doc_id", F.explode(found).alias("anchor")).join(small(anchored.drop("k")), "anchor").select("doc_id", "qid").distinct()
    long = docs.select("doc_id", "text").join(small(staged(hits, "anchored")), "doc_id").join(asked.select("qid", "query"), "qid").filter(F.col("text").contains(F.col("query"))).select("qid", "doc_id").distinct()
    short = asked.filter(F.size("w") < 3)
    n = -(-short.count() // SHORT_BLOCK)
    if not n:
        return long
    blocks = short.groupBy(F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int").alias("b")).agg(F.collect_list(F.struct("qid", "query")).alias("qs"))
    met = docs.filter("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b")).join(blocks, "b")
    held = F.transform(F.filter("qs", lambda q: F.col("text").contains(q["query"])), lambda q: q["qid"])
    return long.unionByName(met.select(F.explode(held).alias("qid"), "doc_id").distinct())


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with rel (0 or 1)."""
    good = qrels.select("qid", "doc_id").distinct().withColumn("rel", F.lit(1))
    return run.join(good, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def hit_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """mrr and hit@k over the queries that have a relevant document."""
    first = judged(run, qrels).filter("rel = 1").groupBy("qid").agg(F.min("rank").alias("best"))
    every = qrels.select("qid").distinct().join(first, "qid", "left")
    hits = [F.round(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in ks]
    return every.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), *hits)


def graded_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """map and ndcg at k. Average precision divides by the relevant documents that k ranks can hold."""
    good = qrels.select("qid", "doc_id").distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    return _graded(judged(run.filter(F.col("rank") <= k), qrels), good, k)


def graded_by_label(run: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """As graded_metrics where the relevant documents are the others with the query's label. labels: doc_id, label; queries: qid, label.

    Labels are counted and compared on the run; pairs of documents with a label in common are never listed.
    """
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    good = queries.join(counts, "label").select("qid", (F.col("n") - 1).alias("n_rel")).filter("n_rel > 0")
    rows = run.filter(F.col("rank") <= k).join(queries.withColumnRenamed("label", "_q"), "qid").join(labels.withColumnRenamed("label", "_d"), "doc_id", "left")
    return _graded(rows.withColumn("rel", F.when(F.col("_q") == F.col("_d"), 1).otherwise(0)), good, k)


def _graded(rows: DataFrame, good: DataFrame, k: int) -> DataFrame:
    """rows: qid, rank, rel; good: qid, n_rel of every judged query."""
    upto = Window.partitionBy("qid").orderBy("rank")
    rows = rows.withColumn("found", F.sum("rel").over(upto))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    per = rows.groupBy("qid").agg(F.sum(F.col("rel") * F.col("found") / F.col("rank")).alias("precision"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    every = good.join(per, "qid", "left")
    ap = F.coalesce("precision", F.lit(0.0)) / F.least("n_rel", F.lit(k))
    return every.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(ap), 6).alias("map"), F.round(F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg"))


def failures(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """cause, n over judged queries: hit, low rank, relevant document not retrieved, nothing retrieved."""
    best = judged(run, qrels).groupBy("qid").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("best"), F.count(F.lit(1)).alias("n"))
    every = qrels.select("qid").distinct().join(best, "qid", "left")
    cause = F.when(F.col("n").isNull(), "nothing_retrieved").when(F.col("best").isNull(), "not_retrieved").when(F.col("best") > k, "low_rank").otherwise("hit")
    return every.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Mean and largest latency of each group, and its speed-up against the slowest group's mean."""
    out = samples.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("longest"))
    return out.withColumn("speed_up", F.max("mean").over(Window.partitionBy()) / F.col("mean"))  # as many rows as groups


def latency_totals(stages: DataFrame, baseline: str) -> DataFrame:
    """system, total (sum of its stages' mean latencies), added (over the baseline's total) and speed_up against the slowest.

    stages: system, stage, ms (any number of samples of a stage).
    """
    means = stages.groupBy("system", "stage").agg(F.avg("ms").alias("mean")).groupBy("system").agg(F.sum("mean").alias("total"))
    everything = Window.partitionBy()  # as many rows as systems
    base = F.max(F.when(F.col("system") == baseline, F.col("total"))).over(everything)
    return means.select("system", F.round("total", 6).alias("total"), F.round(F.col("total") - base, 6).alias("added"), F.round(F.max("total").over(everything) / F.col("total"), 6).alias("speed_up"))


def relative_drop(scores: DataFrame, baseline) -> DataFrame:
    """system, level, score, drop: how many percent the score lies below the system's score at the baseline level."""
    base = scores.filter(F.col("level") == baseline).select("system", F.col("score").alias("_base"))
    drop = F.when(F.col("_base") > 0, F.round(100 * (1 - F.col("score") / F.col("_base")), 6))
    return scores.join(base, "system", "left").select("system", "level", "score", drop.alias("drop"))


def benchmark_pairs(docs: DataFrame, n_words: int = 8, levels: tuple[int, ...] = (1, 2, 3), seed: int = 42) -> DataFrame:
    """qid, level, query, doc_id: a retrieval benchmark of query and passage pairs, one passage of every document at every noise level.

    The passage is a run of n_words words (all words of shorter texts) whose place a seeded hash of the id draws; its document
    is the relevant one. Texts without words give no query.
    """
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), f"[{SPACE}]+"), "")
    rows = docs.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    places = F.greatest(F.size("w") - n_words + 1, F.lit(1))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = rows.select("doc_id", F.array_join(F.slice("w", (draw % places + 1).cast("int"), n_words), " ").alias("passage"))
    each = F.array(*[F.struct(F.lit(level).alias("level"), noise(F.col("passage"), level).alias("query")) for level in levels])
    return rows.select("doc_id", F.explode(each).alias("q")).select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("q.level").cast("string")).alias("qid"), "q.level", "q.query", "doc_id")
