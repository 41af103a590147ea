"""Recommendation (survey R1-R6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.index import SearchIndex
from textloom.operators.rank import min_max


def content_based(index: SearchIndex, doc_id, top_k: int | None = 5) -> DataFrame:
    """doc_id, similarity_score: the cosine to one document; documents without a common term have 0, an unknown seed no row."""
    weighted = index.weights()
    seed = weighted.filter(F.col("doc_id") == doc_id).select("term", F.col("weight").alias("w"))
    sims = weighted.join(F.broadcast(seed), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("w")).alias("s"))
    known = index.docs.filter(F.col("doc_id") == doc_id).select(F.lit(1).alias("_k")).limit(1)
    others = index.docs.filter(F.col("doc_id") != doc_id).select("doc_id").join(F.broadcast(known))
    scored = others.join(sims, "doc_id", "left").select("doc_id", F.round(F.round(F.coalesce("s", F.lit(0.0)), 10), 4).alias("similarity_score"))
    return scored if top_k is None else scored.orderBy(F.desc("similarity_score"), "doc_id").limit(top_k)


def synthetic_ratings(docs: DataFrame, users: int = 60, per_user: int = 15, seed: int = 47) -> DataFrame:
    """R2: user_id, doc_id, rating: two favourite categories with 4-5 stars for 70 % of a user's ratings, any documents with 1-3
    for the rest, all chosen by seeded hashes. A user's documents are found by a per-user order of hashes."""
    spark = docs.sparkSession
    people = spark.range(1, users + 1).select(F.format_string("U%03d", "id").alias("user_id"))
    categories = docs.select("category").distinct()
    chance = lambda *c: F.xxhash64(F.lit(seed), *c)
    liked = people.crossJoin(F.broadcast(categories)).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(chance("user_id", "category"), "category"))).filter("r <= 2").select("user_id", "category")
    n_fav = int(per_user * 0.7)

    def pick(pool: DataFrame, n: int, salt: str) -> DataFrame:
        by = Window.partitionBy("user_id").orderBy(chance(F.lit(salt), "user_id", "doc_id"), "doc_id")
        return pool.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= n).select("user_id", "doc_id")

    stars = F.pmod(chance(F.lit("stars"), "user_id", "doc_id"), F.lit(6))
    ids = docs.select("doc_id", "category")
    fav = pick(ids.join(F.broadcast(liked), "category"), n_fav, "liked").withColumn("rating", (4 + stars % 2).cast("int")).withColumn("o", F.lit(0))
    rest = pick(ids.crossJoin(F.broadcast(people)), per_user - n_fav, "any").withColumn("rating", (1 + stars % 3).cast("int")).withColumn("o", F.lit(1))
    first = Window.partitionBy("user_id", "doc_id").orderBy("o")
    return fav.unionByName(rest).withColumn("r", F.row_number().over(first)).filter("r = 1").select("user_id", "doc_id", "rating")


def ratings_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Ratings 1..5 from purchases: user_id (customer), doc_id (part), by the quantity bought."""
    bought = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return bought.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("doc_id"), F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("q") / 10))).cast("int").alias("rating"))


def matrix_shape(ratings: DataFrame) -> DataFrame:
    """Users, docs, ratings, density of the matrix, in which 0 is unrated."""
    n = F.count(F.lit(1))
    users, docs = F.countDistinct("user_id"), F.countDistinct("doc_id")
    return ratings.agg(users.alias("users"), docs.alias("docs"), n.alias("ratings"), F.round(n / (users * docs), 6).alias("density"))


def collaborative(ratings: DataFrame, user_id, top_k: int | None = 5, n_components: int = 20) -> DataFrame:
    """doc_id, predicted_rating of unrated documents by a truncated SVD of the zero-filled matrix.

    The user's row of the reconstruction is (row V) V^T; V (documents x components) comes from the
    Gram matrix's distributed SVD, which limits the documents to some ten thousand."""
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    spark = ratings.sparkSession
    docs = [r[0] for r in ratings.select("doc_id").distinct().orderBy("doc_id").collect()]
    n_users = ratings.select("user_id").distinct().count()
    empty = spark.createDataFrame([], f"doc_id {ratings.schema['doc_id'].dataType.simpleString()}, predicted_rating double")
    own = {r["doc_id"]: float(r["rating"]) for r in ratings.filter(F.col("user_id") == user_id).collect()}
    if not own or len(docs) < 2:
        return empty
    users = ratings.select("user_id").distinct().withColumn("u", F.dense_rank().over(Window.orderBy("user_id")) - 1)
    place = spark.createDataFrame(list(enumerate(docs)), f"d long, doc_id {ratings.schema['doc_id'].dataType.simpleString()}")
    cells = ratings.join(users, "user_id").join(F.broadcast(place), "doc_id").select("u", "d", "rating")
    matrix = CoordinateMatrix(cells.rdd.map(lambda r: MatrixEntry(r[0], r[1], float(r[2]))), n_users, len(docs)).toRowMatrix()
    k = max(1, min(n_components, min(n_users, len(docs)) - 1))
    v = matrix.computeSVD(k).V.toArray()
    row = sum(rating * v[docs.index(d)] for d, rating in own.items())
    scores = v @ row
    rows = [(d, round(float(s), 3)) for d, s in zip(docs, scores, strict=True) if d not in own]
    out = spark.createDataFrame(rows, empty.schema)
    return out if top_k is None else out.orderBy(F.desc("predicted_rating"), "doc_id").limit(top_k)


def blend_recommendations(content: DataFrame, predicted: DataFrame, rated: DataFrame, seed_doc, top_k: int = 5, alpha: float = 0.5) -> DataFrame:
    """doc_id, content_score, collaborative_score, hybrid_score. Each side is scaled over its own rounded scores first."""
    a = min_max(content, "similarity_score", "c").select("doc_id", "c")
    b = min_max(predicted, "predicted_rating", "p").select("doc_id", "p")
    both = a.join(b, "doc_id", "full").join(rated.select("doc_id").distinct(), "doc_id", "left_anti").filter(F.col("doc_id") != seed_doc)
    c, p = F.coalesce("c", F.lit(0.0)), F.coalesce("p", F.lit(0.0))
    out = both.select("doc_id", F.round(c, 3).alias("content_score"), F.round(p, 3).alias("collaborative_score"), F.round(alpha * c + (1 - alpha) * p, 3).alias("hybrid_score"))
    return out.orderBy(F.desc("hybrid_score"), "doc_id").limit(top_k)


def hybrid(index: SearchIndex, ratings: DataFrame, user_id, seed_doc, top_k: int = 5, alpha: float = 0.5) -> DataFrame:
    """R5 over R1 and R4."""
    rated = ratings.filter(F.col("user_id") == user_id)
    return blend_recommendations(content_based(index, seed_doc, None), collaborative(ratings, user_id, None), rated, seed_doc, top_k, alpha)


def user_history(ratings: DataFrame, docs: DataFrame, user_id) -> DataFrame:
    """R6."""
    return ratings.filter(F.col("user_id") == user_id).join(docs, "doc_id", "left")
