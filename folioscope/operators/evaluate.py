"""Evaluation of batches of questions and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import called


def details(cases: DataFrame, hits: DataFrame, stats: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """L1: a row per case with its contexts in order and its hit counts; cases without hits stay, with an error."""
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", "content"))).alias("h"))
    rows = rows.select("query_id", F.transform("h", lambda x: x["content"]).alias("contexts"))
    out = cases.join(rows, "query_id", "left").join(stats, "query_id", "left")
    out = out.withColumn("error", F.when(F.col("contexts").isNull(), "no hits")).withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    return out if answers is None else out.join(answers.select("query_id", "answer"), "query_id", "left")


def by_category(details: DataFrame) -> DataFrame:
    """L2: per category the cases and the mean numbers of contexts and hits; what failed counts as 0."""
    mean = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(0))), 6)
    return details.groupBy("category").agg(F.count("*").alias("count"), F.round(F.avg(F.size("contexts")), 6).alias("avg_contexts"), *[mean(f"{n}_hits").alias(f"avg_{n}_hits") for n in ("bm25", "semantic", "graph")])


def contribution(stats: DataFrame) -> DataFrame:
    """L3: ``retriever, hits, percent`` over all rows, 0 percent if there are no hits."""
    sums = stats.agg(*[F.coalesce(F.sum(f"{n}_hits"), F.lit(0)).alias(n) for n in ("bm25", "semantic", "graph")])
    rows = sums.selectExpr("stack(3, 'bm25', bm25, 'semantic', semantic, 'graph', graph) as (retriever, hits)", "bm25 + semantic + graph as total")
    return rows.select("retriever", "hits", F.round(F.when(F.col("total") > 0, 100.0 * F.col("hits") / F.col("total")).otherwise(0.0), 6).alias("percent"))


def metric_means(scores: DataFrame) -> DataFrame:
    """L4: ``metric, mean`` of ``scores (metric, value string)`` over the numeric values."""
    return scores.groupBy("metric").agg(F.round(F.avg(F.expr("try_cast(value as double)")), 6).alias("mean"))


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Precision and recall at k from labelled chunks; answer metrics need an outside judge.

    ``relevant`` is by ``query_id, chunk_id``, or by ``chunk_id`` alone for all queries.
    """
    on = [c for c in ("query_id", "chunk_id") if c in relevant.columns]
    top = hits.filter(F.col("final_rank") <= k).join(relevant.select(*on, F.lit(1).alias("good")), on, "left")
    found = top.groupBy("query_id").agg(F.sum(F.coalesce("good", F.lit(0))).alias("found"), F.count("*").alias("shown"))
    if "query_id" in on:
        rows = relevant.groupBy("query_id").agg(F.count("*").alias("wanted")).join(found, "query_id", "left")
    else:
        rows = found.join(F.broadcast(relevant.agg(F.count("*").alias("wanted"))))  # one row
    share = lambda of: F.round(F.coalesce(F.col("found") / F.col(of), F.lit(0.0)), 6)
    return rows.select("query_id", share("shown").alias("precision"), share("wanted").alias("recall"))


def _by_rank(rows: DataFrame, k: int) -> DataFrame:
    """``query_id, found, context_precision, mrr, dcg`` of ``query_id, final_rank, good`` (0, 1); a query has ``k`` rows at most."""
    upto = Window.partitionBy("query_id").orderBy("final_rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.filter(F.col("final_rank") <= k).withColumn("so_far", F.sum("good").over(upto))
    found, gain = F.sum("good"), F.sum(F.col("good") / F.log2(F.col("final_rank") + 1))
    precision = F.sum(F.col("good") * F.col("so_far") / F.col("final_rank")) / F.nullif(found, F.lit(0))
    first = F.min(F.when(F.col("good") == 1, F.col("final_rank")))
    return rows.groupBy("query_id").agg(found.alias("found"), F.coalesce(precision, F.lit(0.0)).alias("context_precision"), F.coalesce(1 / first, F.lit(0.0)).alias("mrr"), F.coalesce(gain, F.lit(0.0)).alias("dcg"))


def ranked_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, context_precision, recall, mrr, ndcg`` at k: precision is the mean of those at the relevant ranks.

    ``relevant`` is by ``query_id, chunk_id``, or by ``chunk_id`` alone for all queries.
    """
    on = [c for c in ("query_id", "chunk_id") if c in relevant.columns]
    rows = hits.join(relevant.select(*on).distinct().withColumn("good", F.lit(1)), on, "left").withColumn("good", F.coalesce("good", F.lit(0)))
    out = _by_rank(rows, k)
    if "query_id" in on:
        out = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("wanted")).join(out, "query_id", "full")
    else:
        out = out.join(F.broadcast(relevant.distinct().agg(F.count("*").alias("wanted"))))  # one row
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("wanted"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    share = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    wanted = F.nullif("wanted", F.lit(0))
    return out.select("query_id", share(F.col("context_precision")).alias("context_precision"), share(F.col("found") / wanted).alias("recall"), share(F.col("mrr")).alias("mrr"), share(F.when(wanted.isNotNull(), F.col("dcg") / ideal)).alias("ndcg"))


#: Where one claim of an answer ends and the next begins.
CLAIMS = r"(?<=[.!?])\s+"


def judged(details: DataFrame, judge, k: int = 10, **options) -> DataFrame:
    """L4: ``query_id, context_precision, context_recall`` of ``query_id, question, ground_truth, contexts`` by a judge.

    ``judge([(claim or question, context), ...])`` gives a number for each, one half and more
    meaning that the context helps, or holds the claim. Precision is by rank; recall is the
    share of the ground truth's claims that some context holds. A case with a pair that the
    judge fails on is null in that metric, as is one without contexts or claims.
    """
    ranks = details.select("query_id", "question", F.posexplode("contexts").alias("place", "context")).filter(F.col("place") < k)
    marked = called(ranks, ["question", "context"], judge, "double", **options)
    failed = marked.groupBy("query_id").agg(F.max(F.col("result").isNull()).alias("failed"))
    rows = marked.select("query_id", (F.col("place") + 1).alias("final_rank"), (F.col("result") >= 0.5).cast("int").alias("good"))
    precision = _by_rank(rows, k).join(failed, "query_id").select("query_id", F.when(~F.col("failed"), F.round("context_precision", 6)).alias("context_precision"))
    claims = details.select("query_id", "contexts", F.posexplode(F.filter(F.split(F.coalesce("ground_truth", F.lit("")), CLAIMS), lambda x: F.trim(x) != "")).alias("nth", "claim"))
    pairs = claims.select("query_id", "nth", "claim", F.explode("contexts").alias("context"))
    held = called(pairs, ["claim", "context"], judge, "double", **options).groupBy("query_id", "nth").agg(F.max(F.col("result") >= 0.5).alias("held"), F.max(F.col("result").isNull()).alias("failed"))
    recall = held.groupBy("query_id").agg(F.when(~F.max("failed"), F.round(F.avg(F.coalesce(F.col("held"), F.lit(False)).cast("int")), 6)).alias("context_recall"))
    return details.select("query_id").join(precision, "query_id", "left").join(recall, "query_id", "left")


def scores(judged: DataFrame) -> DataFrame:
    """L4: ``metric, value`` of judged cases, for ``metric_means``."""
    return judged.selectExpr("stack(2, 'context_precision', cast(context_precision as string), 'context_recall', cast(context_recall as string)) as (metric, value)")


def merged_sections(chunks: DataFrame) -> DataFrame:
    """``doc_id, section, content, chunk_count``: a section's chunks in order, joined by blank lines."""
    rows = chunks.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c"))
    return rows.select("doc_id", "section", F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("content"), F.size("c").cast("long").alias("chunk_count"))


def quota(size: int, documents: Column) -> Column:
    """Questions per document, one at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(size) / documents)).cast("long")


def summary(details: DataFrame, categories: DataFrame, contributions: DataFrame, metrics: DataFrame) -> str:
    """The summary for a console."""
    out = [f"Questions: {details.count()}", *(f"{r['metric']}: {r['mean']:.4f}" for r in metrics.filter("mean is not null").orderBy("metric").toLocalIterator())]
    out += [f"{r['category']}: {r['count']} questions, contexts {r['avg_contexts']:.1f}, BM25 {r['avg_bm25_hits']:.1f}, semantic {r['avg_semantic_hits']:.1f}, graph {r['avg_graph_hits']:.1f}" for r in categories.orderBy("category").toLocalIterator()]
    return "\n".join(out + [f"{r['retriever']}: {r['hits']} hits ({r['percent']:.1f} %)" for r in contributions.orderBy("retriever").toLocalIterator()]) + "\n"


def detailed(details: DataFrame, most: int | None = None, cut: int = 300) -> str:
    """The report by question, of the first ``most`` by id."""
    rows, out = details.orderBy("id") if most is None else details.orderBy("id").limit(most), []
    for k, r in enumerate(rows.toLocalIterator(), 1):
        r = r.asDict()
        out += [f"[{k}] {r['id']} - {r['category']}", f"Question: {r['question']}", f"Answer: {(r.get('answer') or '')[:cut]}", "Hits: " + ", ".join(f"{n} {r.get(f'{n}_hits') or 0}" for n in ("bm25", "semantic", "graph"))]
        out += [f"Error: {r['error']}"] if r.get("error") else [f"  [{n}] {c[:cut]}" for n, c in enumerate(r["contexts"], 1)]
    return "\n".join(out) + "\n"


def report(categories: DataFrame, contributions: DataFrame, title: str = "Evaluation report") -> str:
    """The report as Markdown; the aggregates are a row per category and per retriever."""
    out = [f"# {title}", "", "| category | cases | contexts | BM25 | semantic | graph |", "|---|---|---|---|---|---|"]
    out += [f"| {r['category']} | {r['count']} | {r['avg_contexts']:.2f} | {r['avg_bm25_hits']:.2f} | {r['avg_semantic_hits']:.2f} | {r['avg_graph_hits']:.2f} |" for r in categories.orderBy("category").toLocalIterator()]
    out += ["", "| retriever | hits | share |", "|---|---|---|"]
    out += [f"| {r['retriever']} | {r['hits']} | {r['percent']:.1f} % |" for r in contributions.orderBy("retriever").toLocalIterator()]
    return "\n".join(out) + "\n"
