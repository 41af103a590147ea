"""Web graph, crawl and link analysis (survey S6-S7, S12, C1-C9, G1-G3).

Links are rows (src, dst, pos), never arrays in a page or a dense matrix: a hub that
links to a third of all pages is many rows, not one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import constants as C
from textloom.functions import text as X
from textloom.operators.duplicates import similar_sets
from textloom.plans.lineage import cut, drop

_PREFIX = "local-news://"


def web_graph(docs: DataFrame, near_dup_every: int = 20, exact_dup_every: int = 25) -> tuple[DataFrame, DataFrame]:
    """Pages (url, title, text, category, source_type, is_exact_duplicate, is_near_duplicate, duplicate_of, doc_id)
    and links (src, dst, pos) of a collection (doc_id, category, title, text).

    Places are found on narrow rows (category, doc_id); texts join later."""
    own = Window.partitionBy("category").orderBy("doc_id")
    placed = docs.select("doc_id", "category").withColumn("i", F.row_number().over(own) - 1)
    sizes = docs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).withColumn("hub_pos", F.row_number().over(Window.orderBy("category")) - 1)  # one row per category
    hub = F.concat(F.lit(_PREFIX), F.col("category"), F.lit("/hub"))
    url = F.concat(F.lit(_PREFIX), F.col("category"), F.lit("/"), F.col("doc_id").cast("string"))
    placed = placed.join(sizes, "category").select("doc_id", "category", "i", "n", "hub_pos", (F.col("before") + F.col("i")).alias("idx"), url.alias("url"), hub.alias("hub"))
    mirror = (F.col("idx") % exact_dup_every == 0) if exact_dup_every else F.lit(False)
    syndicated = (F.col("idx") % near_dup_every == 0) if near_dup_every else F.lit(False)

    texts = placed.join(docs.select("doc_id", "title", "text"), "doc_id")
    none, no, yes = F.lit(None).cast("string"), F.lit(False), F.lit(True)
    name, doc = F.col("url"), F.col("doc_id").cast("string")

    def page(rows: DataFrame, url_, title, text, category, exact, near, of, doc_id) -> DataFrame:
        return rows.select(url_.alias("url"), title.alias("title"), text.alias("text"), category.alias("category"), F.lit("dataset").alias("source_type"), exact.alias("is_exact_duplicate"), near.alias("is_near_duplicate"), of.alias("duplicate_of"), doc_id.alias("doc_id"))

    spark, cat = docs.sparkSession, F.col("category")
    home = spark.createDataFrame([(C.HOME_URL, C.HOME_TITLE, C.HOME_TEXT)], "url string, title string, text string")
    pages = [
        page(home, name, F.col("title"), F.col("text"), F.lit("home"), no, no, none, none),
        page(sizes, hub, F.concat(F.initcap(cat), F.lit(" Section")), F.concat(F.lit("Section hub aggregating all "), cat, F.lit(" coverage.")), cat, no, no, none, none),
        page(texts, name, F.col("title"), F.col("text"), cat, no, no, none, doc),
        page(texts.filter(mirror), F.concat(name, F.lit("-mirror")), F.col("title"), F.col("text"), cat, yes, no, name, doc),
        page(texts.filter(syndicated), F.concat(name, F.lit("-syndicated")), F.concat("title", F.lit(" (syndicated)")), F.concat(X.text_or_empty(F.col("text")), F.lit(C.SYNDICATED_SENTENCE)), cat, no, yes, name, doc),
    ]
    ring = placed.filter("n > 3").select("category", "i", "n", "url")
    steps = ring.withColumn("off", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("j", (F.col("i") + F.col("off")) % F.col("n"))
    near = steps.alias("s").join(ring.alias("t"), (F.col("s.category") == F.col("t.category")) & (F.col("s.j") == F.col("t.i")))
    big = 10**12  # mirrors follow all articles of a hub, and syndicated copies follow the mirrors
    links = [
        sizes.select(F.lit(C.HOME_URL).alias("src"), hub.alias("dst"), F.col("hub_pos").cast("long").alias("pos")),
        placed.select(F.col("hub").alias("src"), name.alias("dst"), F.col("i").cast("long").alias("pos")),
        placed.filter(mirror).select(F.col("hub").alias("src"), F.concat(name, F.lit("-mirror")).alias("dst"), (F.col("idx") + big).alias("pos")),
        placed.filter(syndicated).select(F.col("hub").alias("src"), F.concat(name, F.lit("-syndicated")).alias("dst"), (F.col("idx") + 2 * big).alias("pos")),
        near.select(F.col("s.url").alias("src"), F.col("t.url").alias("dst"), (F.col("s.off") - 1).cast("long").alias("pos")),
    ]
    return reduce(DataFrame.unionByName, pages), reduce(DataFrame.unionByName, links)


def seed_options(pages: DataFrame) -> DataFrame:
    """Home, and the hubs."""
    return pages.filter(F.endswith("url", F.lit("/hub")) | (F.col("url") == C.HOME_URL)).select("url")


def first_by_path(level: DataFrame, most: int) -> DataFrame:
    """The ``most`` first rows of a level by path: numbered within the ranges of a global sort, so that no task holds more
    than its range; the driver sees one count per range."""
    ranged = cut(level.repartitionByRange("path").sortWithinPartitions("path").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(map(tuple, ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()))
    keep, left = F.lit(False), most
    for p, n in counts:
        keep = keep | ((part == p) & (F.col("_at").bitwiseAND((1 << 33) - 1) < left))
        left -= n
        if left <= 0:
            break
    return ranged.filter(keep).drop("_at")


def crawl_order(pages: DataFrame, links: DataFrame, seeds: list[str], max_depth: int, max_pages: int) -> tuple[DataFrame, DataFrame]:
    """Visited (url, depth, parent_url, path) and queue (url, depth, path) of a breadth-first crawl.

    The first-in-first-out order is that of (depth, path): a link's path is its parent's path
    and its place in the parent, so pages of a depth need no ranking. A level is one join; its
    result is checkpointed. The page cap takes the first pages of a level by path."""
    spark = pages.sparkSession
    known = pages.select("url")
    schema = "url string, depth int, parent_url string, path array<bigint>"
    level = spark.createDataFrame([(s, 0, None, [i]) for i, s in enumerate(seeds)], schema)
    queue, visited, tried, left = None, None, None, max_pages
    for depth in range(max_depth + 1):
        queue = level if queue is None else queue.unionByName(level)
        fresh = level if tried is None else level.join(tried, "url", "left_anti")
        first = fresh.groupBy("url").agg(F.min(F.struct("path", "parent_url")).alias("m"))
        wanted = cut(first.select("url", F.lit(depth).alias("depth"), F.col("m.parent_url").alias("parent_url"), F.col("m.path").alias("path")))
        fetched = cut(wanted.join(known, "url", "left_semi"))
        found = fetched.count()
        if found > left:
            fetched = cut(first_by_path(fetched, left))
            found = left
        tried = wanted.select("url") if tried is None else tried.unionByName(wanted.select("url"))
        visited = fetched if visited is None else visited.unionByName(fetched)
        left -= found
        if left <= 0 or depth == max_depth:
            break
        level = cut(links.join(fetched.select(F.col("url").alias("src"), "path"), "src").select(F.col("dst").alias("url"), F.lit(depth + 1).alias("depth"), F.col("src").alias("parent_url"), F.concat("path", F.array("pos")).alias("path")))
        if level.isEmpty():
            break
    if left <= 0:  # what is queued behind the last page is never looked at
        last = visited.agg(F.max(F.struct("depth", "path")).alias("stop"))
        queue = queue.crossJoin(F.broadcast(last)).filter(F.struct("depth", "path") <= F.col("stop")).drop("stop")
    return visited, queue.select("url", "depth", "path")


def crawl(pages: DataFrame, links: DataFrame, seeds: list[str], max_depth: int = 2, max_pages: int = 200, near_dup_threshold: float = 0.85, skip_near_duplicates: bool = False, started_at: str = "2024-01-01 00:00:00") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Metadata, content, links of the fetched pages, and one row of statistics."""
    visited, queue = crawl_order(pages, links, seeds, max_depth, max_pages)
    found = visited.join(pages, "url")
    tick = F.row_number().over(Window.orderBy("depth", "path"))  # at most max_pages narrow rows
    ticks = visited.select("url", tick.alias("tick"))
    rows = cut(found.join(ticks, "url").withColumn("content_hash", X.content_hash(F.col("text"))))
    first = rows.groupBy("content_hash").agg(F.min(F.struct("tick", "url")).alias("f"))
    marked = rows.join(first, "content_hash")
    seen = F.col("f.tick") < F.col("tick")
    marked = marked.withColumn("exact", F.col("is_exact_duplicate") | seen).withColumn("of", F.coalesce("duplicate_of", F.when(seen, F.col("f.url"))))
    plain = marked.filter(~F.col("exact") & ~F.col("is_near_duplicate")).select(F.col("tick").alias("id"), X.token_set(F.col("text")).alias("tokens"))
    match = similar_sets(plain, near_dup_threshold).groupBy(F.col("b").alias("tick")).agg(F.min("a").alias("other"))
    match = match.join(ticks.select(F.col("tick").alias("other"), F.col("url").alias("other_url")), "other").select("tick", "other_url")
    done = marked.join(match, "tick", "left")
    near = F.col("is_near_duplicate") | F.col("other_url").isNotNull()
    meta = done.select(
        F.col("url").alias("id"), "url", "source_type", "category", "title", "depth", "parent_url",
        F.date_format(F.to_timestamp(F.lit(started_at)) + F.make_dt_interval(secs=F.col("tick")), "yyyy-MM-dd'T'HH:mm:ss").alias("discovered_at"),
        "content_hash", F.col("exact").cast("int").alias("is_exact_duplicate"), near.cast("int").alias("is_near_duplicate"),
        F.coalesce("of", "other_url").alias("duplicate_of"), X.word_count(F.col("text")).alias("word_count"), "doc_id", "tick",
    )
    meta = cut(meta)
    stored = meta.filter("is_exact_duplicate = 0") if not skip_near_duplicates else meta.filter("is_exact_duplicate = 0 AND is_near_duplicate = 0")
    texts = rows.join(stored.select("url"), "url", "left_semi").select(F.col("url").alias("id"), F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("clean_text"))
    edges = links.join(visited.select(F.col("url").alias("src")), "src", "left_semi").select("src", "dst")
    repeats = queue.agg((F.count(F.lit(1)) - F.countDistinct("url")).alias("pages_skipped_url_dup"))
    stats = meta.agg(
        F.count(F.lit(1)).alias("pages_fetched"), F.coalesce(F.sum("is_exact_duplicate"), F.lit(0)).alias("pages_skipped_content_dup"),
        F.coalesce(F.sum("is_near_duplicate"), F.lit(0)).alias("near_duplicates_flagged"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth_reached"),
    )
    return meta.drop("tick"), texts, edges, stats.crossJoin(repeats)


def unite_links(crawls: list[DataFrame]) -> DataFrame:
    """Src, dst of the links of several crawls, each once."""
    return reduce(DataFrame.unionByName, [c.select("src", "dst") for c in crawls]).distinct()


def adjacency(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: nodes (node) and distinct links (src, dst); self-links stay."""
    edges = links.select("src", "dst").distinct()
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct(), edges


def pagerank(links: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float | None = 1e-8) -> DataFrame:
    """Node, score. With tol None, max_iter rounds without a convergence check."""
    nodes, edges = adjacency(links)
    edges = cut(edges)
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    state = cut(nodes.join(out.withColumnRenamed("src", "node"), "node", "left"))  # node, out (null: dangling)
    n = state.count()
    if not n:
        return state.select("node", F.lit(0.0).alias("score"))
    ranks, kept = state.withColumn("score", F.lit(1.0 / n)), None
    for _ in range(max_iter):
        sent = edges.join(ranks.select(F.col("node").alias("src"), (F.col("score") / F.col("out")).alias("share")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        lost = ranks.filter(F.col("out").isNull()).agg((F.coalesce(F.sum("score"), F.lit(0.0)) / n).alias("lost"))
        moved = ranks.join(sent, "node", "left").crossJoin(F.broadcast(lost))
        new = moved.select("node", "out", F.col("score").alias("old"), ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost"))).alias("score"))
        before, kept = kept, cut(new)
        new, ranks = kept, kept.drop("old")
        drop(before)  # the round before last is read no more
        if tol is not None and new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < tol:
            break
    return ranks.select("node", "score")


def hits(links: DataFrame, max_iter: int = 100, tol: float | None = 1e-8) -> DataFrame:
    """Node, hub, authority, each of length 1."""
    nodes, edges = adjacency(links)
    edges, nodes = cut(edges), cut(nodes)
    state = nodes.select("node", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority"))

    def scaled(raw: DataFrame, name: str) -> DataFrame:
        length = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
        whole = nodes.join(raw, "node", "left").crossJoin(F.broadcast(length))
        return whole.select("node", F.coalesce(F.col("x") / F.when(F.coalesce("len", F.lit(0.0)) > 0, F.col("len")).otherwise(1.0), F.lit(0.0)).alias(name))

    authority, kept = None, None
    for _ in range(max_iter):
        raw = edges.join(state.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("x"))
        before, authority = authority, cut(scaled(raw, "authority"))
        drop(before)
        raw = edges.join(authority.select(F.col("node").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("authority").alias("x"))
        new = cut(scaled(raw, "hub").join(authority, "node"))
        moved = None
        if tol is not None:
            old = state.select("node", F.col("hub").alias("h"), F.col("authority").alias("a"))
            moved = new.join(old, "node").agg(F.sum(F.abs(F.col("hub") - F.col("h")) + F.abs(F.col("authority") - F.col("a")))).first()[0]
        state = new
        drop(kept)
        kept = new
        if moved is not None and moved < tol:
            break
    return state
