"""Search: a lexical and a vector arm, rank fusion, re-ranking, and what is shown beside the hits.

Queries come as a table (query, text, vector), so one search or a million are the same plan. Terms meet in inverted lists that
tasks read block by block; vectors meet in lists of alike ones. No query reaches the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.functions.vector import cosine, usable_vector
from loam.operators import inverted
from loam.operators.vector_lists import among_queries
from loam.session import BROADCAST_ROWS, materialize, semi_join
from loam.visibility import days_since, importance

#: Constant of the rank fusion.
RRF_K = 60
#: Numbers of a vector, where nothing else says it.
DIMS = 384


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str | None = None) -> DataFrame:
    """The first k rows of each group; Spark drops the rest before the shuffle."""
    ranked = df.withColumn(name or "_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col(name or "_rank") <= k) if name else ranked.filter(F.col("_rank") <= k).drop("_rank")


def postings(nodes: DataFrame, key: str = "path", wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, length) of each node's title and body; with wanted (term: distinct, materialized) only of those terms."""
    words = nodes.select(key, tx.terms(tx.document()).alias("w"))
    each = words.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    return (each if wanted is None else semi_join(each, wanted, "term")).groupBy(key, "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def _lexical_index(nodes: DataFrame, queries: DataFrame, keep: Sequence[str] = ()) -> inverted.Index:
    return inverted.build(nodes, queries, tx.terms(tx.document()), 1.0 + F.log(1.0 + F.size("w")), keep=keep)


def lexical_hits(nodes: DataFrame, queries: DataFrame, k: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(query, path, score, and columns of the nodes to keep): nodes with every term of the query, by the sum of tf / (1 + ln(1 + length)); the first k of each query, or all for None. A query without terms finds nothing."""
    index = _lexical_index(nodes, queries, keep)
    return index.named(index.search(index.terms, inverted.with_all(k), inverted.HITS)).select("query", "path", "score", *keep)


def lexical_arm(nodes: DataFrame, queries: DataFrame, k: int = 30, keep: Sequence[str] = ()) -> DataFrame:
    """The k best of lexical_hits."""
    return lexical_hits(nodes, queries, k, keep)


def vector_arm(nodes: DataFrame, queries: DataFrame, k: int = 30, dims: int | None = None) -> DataFrame:
    """(query, path, sim): the nodes most similar to each query vector. Vectors of another length than dims, or that aren't finite or all zero, take no part on either side.

    Without dims, it is the commonest length of the queries' vectors (of equally common ones the greatest).

    Both sides are partitioned by lists of alike vectors; up to some thousands of nodes there is one part, and nothing is lost."""
    if dims is None:
        size = F.size("vector")
        found = queries.filter(size > 0).groupBy(size.alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
        dims = found["n"] if found else DIMS
    rows = nodes.filter(usable_vector(F.col("embedding"), dims)).select(F.col("path").alias("id"), F.col("embedding").cast("array<float>").alias("vec"))
    asked = queries.filter(usable_vector(F.col("vector"), dims)).select(F.col("query").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vec"))
    return among_queries(rows, asked, dims, k).select(F.col("id").alias("query"), F.col("neighbour").alias("path"), F.col("similarity").alias("sim"))


def meet(a: DataFrame, b: DataFrame, scores: tuple[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """(query, path, both scores, and columns of the node to keep): the rows of two arms brought together, each pair once, null where an arm lacks it.

    Rows travel once, by query, so that windows over a query and joins by query need them nowhere else."""
    one = lambda df, mine: df.select("query", "path", *[(F.col(c) if c == mine else F.lit(None)).cast("double").alias(c) for c in scores], *keep)
    both = one(a, scores[0]).unionByName(one(b, scores[1])).repartition("query")
    return both.groupBy("query", "path").agg(*[F.max(c).alias(c) for c in (*scores, *keep)])


def fuse(lexical: DataFrame, vector: DataFrame, k: int = RRF_K, keep: Sequence[str] = ()) -> DataFrame:
    """(query, path, rrf, in_lexical, in_vector, na, nb, score, sim, and columns to keep): 1/(k + rank) of both lists; a path that a list lacks ranks behind its last one. na, nb: their lengths."""
    w = Window.partitionBy("query")
    place = lambda score: F.when(F.col(score).isNotNull(), F.row_number().over(w.orderBy(F.desc(score), "path")))
    both = meet(lexical, vector, ("score", "sim"), keep)
    both = both.withColumns({"na": F.count("score").over(w), "nb": F.count("sim").over(w), "ra": place("score"), "rb": place("sim")})
    rrf = 1.0 / (k + F.coalesce("ra", F.col("na") + 1)) + 1.0 / (k + F.coalesce("rb", F.col("nb") + 1))
    return both.select("query", "path", F.round(rrf, 12).alias("rrf"), F.col("ra").isNotNull().alias("in_lexical"), F.col("rb").isNotNull().alias("in_vector"), "na", "nb", "score", "sim", *keep)


def rerank(hits: DataFrame, score: str, now: str) -> DataFrame:
    """Adds final_score = score (1/2 + importance/2) + 1e-6 / (1 + days since the update)."""
    recency = 1.0 / (1.0 + days_since("updated_at", now))
    return hits.withColumn("final_score", F.round(F.col(score) * (0.5 + 0.5 * importance()) + 1e-6 * recency, 12))


def hybrid(nodes: DataFrame, queries: DataFrame, now: str, limit: int = 20, arm: int = 30, dims: int | None = None) -> DataFrame:
    """(query, path, retrieval_score, final_score, position): fused if both arms find something, else the score of the one that does,
    else nodes that contain the query as it is, at 0.1. Decided per query, within one plan."""
    keep = ("importance", "updated_at")
    kept = nodes.select("path", *keep)
    fused = fuse(lexical_arm(nodes, queries, arm, keep), vector_arm(nodes, queries, arm, dims).join(kept, "path"), keep=keep)
    score = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("rrf")).otherwise(F.coalesce("score", "sim"))

    def first(hits: DataFrame) -> DataFrame:
        ranked = top(rerank(hits, "retrieval_score", now), ["query"], [F.desc("final_score"), F.col("path")], limit, "position")
        return ranked.select("query", "path", "retrieval_score", "final_score", "position")

    found = materialize(first(fused.withColumn("retrieval_score", score)))
    empty = queries.select(F.col("query").cast("string"), "text").join(found.select("query").distinct(), "query", "left_anti")
    plain = substring_arm(nodes, empty, arm).withColumn("retrieval_score", F.lit(0.1))
    return found.unionByName(first(plain.join(kept, "path")))


#: Characters by which a query's text is sought before it is compared whole.
PIECE = 8
#: Queries of a round.
ROUND = BROADCAST_ROWS // 10


def _containing(nodes: DataFrame, queries: DataFrame, *conditions: Column) -> DataFrame:
    """(query, path): nodes whose title or body contains the query's text, in any case, under conditions on the node's title and body and `_q`, the text in lower case.

    A query's first PIECE characters (all, if it has fewer) meet the pieces of the nodes' texts in an equi-join; what meets is
    compared whole. So the work grows with the texts and the hits, not with nodes times queries. Texts and their pieces don't
    travel: the queries do, in as many rounds as can be broadcast."""
    q = queries.select(F.col("query").cast("string").alias("query"), F.lower("text").alias("_q")).filter("_q is not null and _q != ''")
    q = materialize(q.withColumn("_n", F.least(F.length("_q"), F.lit(PIECE))).withColumn("_piece", F.expr("substring(_q, 1, _n)")))
    lengths = [(r["_n"], r["n"]) for r in q.groupBy("_n").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most PIECE rows
    n = nodes.select("path", "title", "body", F.lower(F.coalesce("title", F.lit(""))).alias("_t"), F.lower(F.coalesce("body", F.lit(""))).alias("_b"))
    out = n.select(F.lit(None).cast("string").alias("query"), "path").limit(0)
    for length, count in sorted(lengths):
        pieces = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{length}}}))"), F.lit(1)) for c in ("_t", "_b")])))
        rounds = math.ceil(count / ROUND)
        for i in range(rounds):
            asked = q.filter((F.col("_n") == length) & (F.pmod(F.xxhash64("query", "_q"), F.lit(rounds)) == i)).drop("_n")
            met = n.withColumn("_piece", F.explode(pieces)).join(F.broadcast(asked), "_piece").filter(F.col("_t").contains(F.col("_q")) | F.col("_b").contains(F.col("_q")))
            for c in conditions:
                met = met.filter(c)
            out = out.unionByName(met.select("query", "path"))
    return out


def substring_arm(nodes: DataFrame, queries: DataFrame, k: int | None = 30) -> DataFrame:
    """(query, path): the first k nodes by path (all for None) whose title or body contains the query's text, in any case."""
    out = _containing(nodes, queries)
    return out if k is None else top(out, ["query"], [F.col("path")], k)


def match_counts(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, n): the number of paths of nodes with all words of the query or its text, for queries that have any.

    Nodes with all words are counted where they are found, and those that only contain the text where they meet it; the pairs don't
    travel. Only those of a path, or of a query's name, that occurs several times do, as its nodes count once."""
    rows, asked = nodes.select("path", "title", "body"), queries.select(F.col("query").cast("string").alias("query"), "text")
    several = lambda df, key: materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(key))
    paths, names = several(rows, "path"), several(asked, "query")
    parts = []

    def pairs(n: DataFrame, q: DataFrame) -> None:
        both = lexical_hits(n, q).select("query", "path").unionByName(substring_arm(n, q, None)).distinct()
        parts.append(both.groupBy("query").agg(F.count(F.lit(1)).alias("n")))

    if not names.isEmpty():
        pairs(rows, asked.join(names, "query", "left_semi"))
        asked = asked.join(names, "query", "left_anti")
    if not paths.isEmpty():
        pairs(rows.join(paths, "path", "left_semi"), asked)
        rows = rows.join(paths, "path", "left_anti")
    index = _lexical_index(rows, asked)
    parts.append(index.search(index.terms, inverted.count_all(), inverted.COUNTS).join(index.asked, "no").select("query", "n"))
    words = tx.lexemes(F.col("_q"))
    every = (F.size(words) > 0) & (F.size(F.array_except(words, tx.terms(tx.document()))) == 0)
    parts.append(_containing(rows, asked, ~every).groupBy("query").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("query").agg(F.sum("n").alias("n"))


def neighbours(hits: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(query, path, direction, rel_type, neighbour): one hop from each hit, both ways."""
    ids = hits.select("query", "path").join(nodes.select("path", "id"), "path")
    other = nodes.select(F.col("id").alias("_o"), F.col("path").alias("neighbour"))
    ends = directed(links)
    return ids.join(ends, "id").join(other, F.col("other") == F.col("_o")).select("query", "path", "direction", "rel_type", "neighbour")


def directed(links: DataFrame) -> DataFrame:
    """(id, other, direction, rel_type): every link seen from both ends, so that a condition on either end is an equi-join. Ids in lower case."""
    a, b = F.lower("from_id"), F.lower("to_id")
    out = links.select(a.alias("id"), b.alias("other"), F.lit("out").alias("direction"), "rel_type")
    return out.unionByName(links.select(b.alias("id"), a.alias("other"), F.lit("in").alias("direction"), "rel_type"))


def contradictions(hits: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(query, path, neighbour) for the hits that a `contradicts` link touches on either end."""
    return neighbours(hits, nodes, links.filter("rel_type = 'contradicts'")).select("query", "path", "neighbour").distinct()


def tripwire(extracted: DataFrame, queries: DataFrame, least: float = 0.85, most: int = 3, arm: int = 20, dims: int | None = None) -> DataFrame:
    """(query, path, sim): the extracted tier's few very similar nodes, shown although the tier isn't searched."""
    return top(vector_arm(extracted, queries, arm, dims).filter(F.col("sim") >= least), ["query"], [F.desc("sim"), F.col("path")], most)


def coverage(nodes: DataFrame, queries: DataFrame, least_terms: int = 2, least_mass: float = 7.0, k: int = 60, keep: Sequence[str] = ()) -> DataFrame:
    """(query, path, lex_conf, and columns of the nodes to keep): nodes with any term of the query, by the idf mass they cover.

    The confidence is the least of 1, matched mass / query mass, and 1/2 + title mass / query mass. A term that no node has
    counts in the query's mass. Postings and document frequencies are made of the queries' terms only."""
    index = inverted.build(nodes, queries, tx.lexemes(tx.document()), titled=True, keep=keep)
    weights = index.terms.join(index.doc_freqs(), "code", "left").select("no", "code", tx.idf(F.lit(index.nodes), F.coalesce("df", F.lit(0))).alias("w"))
    first = index.named(index.search(weights, inverted.with_any(k, least_terms, least_mass), inverted.HITS))
    return first.select("query", "path", F.round("score", 9).alias("lex_conf"), *keep)


def usage_rank(corpus: DataFrame, replies: DataFrame) -> DataFrame:
    """(query, path, rank_share): share of the corpus that fits the reply's own terms (those that the prompt lacks) at least as well as the
    node that was shown: 0 where the reply names its path, 1 where it has no such term or isn't in the corpus.

    replies: (query, path, prompt, reply). Fit: idf of shared terms over the root of the node's idf mass."""
    post = postings(corpus).select("path", "term")
    df = tx.doc_freqs(post)
    n = corpus.select(F.count(F.lit(1)).alias("n"))
    weighted = post.join(df, "term").join(F.broadcast(n)).withColumn("w", tx.idf(F.col("n"), F.col("df"))).drop("df", "n")
    mass = weighted.groupBy("path").agg(F.sqrt(F.sum("w")).alias("mass"))
    own = replies.select("query", F.explode(F.array_except(tx.lexemes(F.col("reply")), tx.lexemes(F.col("prompt")))).alias("term"))
    fit = own.join(weighted, "term").groupBy("query", "path").agg(F.sum("w").alias("s")).join(mass, "path").withColumn("fit", F.round(F.col("s") / F.col("mass"), 9))
    named = F.contains(F.coalesce("reply", F.lit("")), F.col("path"))
    target = replies.select("query", "path", named.alias("named")).join(fit.select("query", "path", F.col("fit").alias("target")), ["query", "path"], "left").fillna(0.0, ["target"])
    above = fit.select("query", "fit").join(target, "query").filter("fit >= target and target > 0").groupBy("query", "path").agg(F.count(F.lit(1)).alias("above"))
    joined = target.join(above, ["query", "path"], "left").join(F.broadcast(n))
    share = F.when(F.col("named"), 0.0).when(F.col("target") > 0, F.col("above") / F.col("n")).otherwise(1.0)
    return joined.select("query", "path", F.round(share, 9).alias("rank_share"))


def kept_frequencies(nodes: DataFrame, path: str, clock: str, hours: float = 6.0) -> DataFrame:
    """(term, df, n) of the nodes, kept at a path with the time it was built, and built anew once that is `hours` ago; n: number of nodes."""
    spark = nodes.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        kept = spark.read.parquet(path)
        built = kept.select(F.max("built")).first()[0]
        age = spark.sql(f"SELECT (unix_micros(cast(timestamp_ntz'{clock}' as timestamp)) - unix_micros(cast(timestamp_ntz'{built}' as timestamp))) / 3.6e9 AS h").first()["h"] if built else None
        if age is not None and 0 <= age < hours:
            return kept.drop("built")
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    rows = tx.doc_freqs(postings(nodes)).join(F.broadcast(total)).withColumn("built", F.lit(clock).cast("timestamp_ntz"))
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("built")


#: Share of the corpus among which a node must rank to count as used.
USE_TOP_SHARE = 0.01


def judge(ranks: DataFrame, corpus: DataFrame, share: float = USE_TOP_SHARE) -> DataFrame:
    """Adds used: whether a node is among the first percent of the corpus, or the first one of a small corpus. ranks: (.., rank_share)."""
    n = corpus.agg(F.count(F.lit(1)).alias("_n"))
    return ranks.join(F.broadcast(n)).withColumn("used", F.round(F.col("rank_share") * F.col("_n"), 6) <= F.greatest(F.lit(1.0), F.bround(share * F.col("_n")))).drop("_n")


def similar_to(nodes: DataFrame, vector: Column, k: int) -> DataFrame:
    """(path, sim): one query vector, all in the JVM; the plan ends in TakeOrderedAndProject."""
    return nodes.filter(F.col("embedding").isNotNull()).select("path", F.round(cosine(F.col("embedding"), vector), 9).alias("sim")).orderBy(F.desc("sim"), "path").limit(k)


def rank_score() -> Column:
    """Importance + min(accesses, 20)/40 + 0.2 for a node of the last 30 days (column `recent`)."""
    return importance() + F.least(F.coalesce("access_count", F.lit(0)), F.lit(20)) / 40.0 + F.when(F.col("recent"), 0.2).otherwise(0.0)


def digest(nodes: DataFrame, budget: int, share: float = 1.0) -> DataFrame:
    """(project, position, path, chars): each project's nodes by rank score, up to the first line that exceeds the budget of characters."""
    lines = nodes.select("project", "path", F.round(rank_score(), 9).alias("score"), F.length(F.concat_ws(" ", "path", tx.first_sentence(F.col("body")))).alias("chars"))
    w = Window.partitionBy("project").orderBy(F.desc("score"), "path")
    run = F.sum(F.col("chars") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = lines.withColumn("position", F.row_number().over(w)).withColumn("run", run)
    return kept.filter(F.col("run") <= int(budget * share)).select("project", "position", "path", F.col("chars").cast("long").alias("chars"))


def pack_skipping(nodes: DataFrame, budget: int) -> DataFrame:
    """(project, path): each project's bodies by rank score, those that don't fit into what is left of the budget skipped.

    One ordered pass over (project, path, length) that holds one number; a body longer than the whole budget doesn't travel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, left = None, budget
        for batch in batches:
            keep = []
            for i, (p, n) in enumerate(zip(batch.column("project").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                if p != project:
                    project, left = p, budget
                if n <= left:
                    left -= n
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["project", "path"])

    rows = nodes.select("project", "path", F.round(rank_score(), 9).alias("i"), F.length(F.coalesce("body", F.lit(""))).alias("n")).filter((F.col("n") <= budget) & F.col("project").isNotNull())
    ordered = rows.repartition("project").sortWithinPartitions("project", F.desc("i"), "path").select("project", "path", "n")
    return ordered.mapInArrow(run, "project string, path string")
