"""Pairs within a time window, samples and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def near(src: DataFrame, dst: DataFrame, width: int, t: str = "t", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with |difference of t| <= width, columns prefixed src_ and dst_: an
    equi-join on time buckets (and ``on``); a source looks into three buckets."""
    a = src.select(*[F.col(c).alias(f"src_{c}") for c in src.columns]).withColumn("_b", F.explode(F.array(*[F.floor(F.col(f"src_{t}") / width) + i for i in (-1, 0, 1)])))
    b = dst.select(*[F.col(c).alias(f"dst_{c}") for c in dst.columns]).withColumn("_c", F.floor(F.col(f"dst_{t}") / width))
    cond = F.col("_b") == F.col("_c")
    for c in on:
        cond = cond & (F.col(f"src_{c}") == F.col(f"dst_{c}"))
    return a.join(b, cond & (F.abs(F.col(f"src_{t}") - F.col(f"dst_{t}")) <= width)).drop("_b", "_c")


def top_by_vector(src: DataFrame, dst: DataFrame, width: int, key: str = "id", vector: str = "vec", t: str = "t", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each source's candidate of the largest inner product in the window, ties
    to the earliest, then the smallest key; null key and -1 without any.  The
    candidate's ``carry`` columns come along as dst_ columns."""
    pairs = near(src.select(key, vector, t), dst.select(key, vector, t, *carry), width, t)
    pairs = pairs.withColumn("_s", dot(F.col(f"src_{vector}"), F.col(f"dst_{vector}")))
    kept = [F.col(f"dst_{c}") for c in (key, *carry)]
    best = pairs.groupBy(f"src_{key}").agg(F.max_by(F.struct(*kept, "_s"), F.struct("_s", -F.col(f"dst_{t}"), -F.col(f"dst_{key}"))).alias("m"))
    got = src.select(F.col(key).alias(f"src_{key}")).join(best, f"src_{key}", "left")
    return got.select(f"src_{key}", *[F.col(f"m.dst_{c}") for c in (key, *carry)], F.coalesce("m._s", F.lit(-1.0)).alias("score"))


def top_by_entities(src: DataFrame, dst: DataFrame, width: int, rare: float = 0.03, least: int = 2, key: str = "id", entities: str = "entities", t: str = "t", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each source's candidate with most shared rare entities in the window, at
    least ``least``; ties to the earliest, then the smallest key.  An entity is
    rare if in less than ``rare`` of all rows; others go before the join, so
    no frequent one meets itself."""
    one = lambda df: df.select(key, t, F.explode(F.array_distinct(entities)).alias("e"))
    both = one(src).unionByName(one(dst))
    total = src.select(key).unionByName(dst.select(key)).agg(F.count("*").alias("total"))
    few = both.groupBy("e").agg(F.count("*").alias("n")).join(F.broadcast(total)).where(F.col("n") < rare * F.col("total")).select("e")
    pairs = near(one(src).join(few, "e"), one(dst).join(few, "e"), width, t, ("e",))
    shared = pairs.groupBy(f"src_{key}", f"dst_{key}").agg(F.count("*").alias("shared"), F.first(f"dst_{t}").alias("dt")).where(F.col("shared") >= least)
    best = shared.groupBy(f"src_{key}").agg(F.max_by(F.struct(F.col(f"dst_{key}").alias("d"), F.col("shared").alias("s")), F.struct("shared", -F.col("dt"), -F.col(f"dst_{key}"))).alias("m"))
    got = src.select(F.col(key).alias(f"src_{key}")).join(best, f"src_{key}", "left").select(f"src_{key}", F.col("m.d").alias(f"dst_{key}"), F.coalesce("m.s", F.lit(0)).alias("shared"))
    if carry:
        got = got.join(dst.select(F.col(key).alias(f"dst_{key}"), *[F.col(c).alias(f"dst_{c}") for c in carry]), f"dst_{key}", "left")
    return got


def first_by_hash(df: DataFrame, stratum: str, key: str, n: int, seed: str = "1") -> DataFrame:
    """n rows of each stratum in an order set by md5 (a sampling operator)."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key)
    return df.withColumn("item", F.row_number().over(w)).where(F.col("item") <= n)


def equal_coverage(scored: DataFrame, score: str, other: DataFrame, key: str) -> DataFrame:
    """As many best-scored rows as ``other`` has, counted first: an ordered
    limit keeps that many in each task and merges them."""
    return scored.orderBy(F.desc(score), key).limit(other.count())


def headlines(marks: DataFrame, items: DataFrame, before: int, most: int = 8, t: str = "t", group: str = "group", title: str = "title") -> DataFrame:
    """The first ``most`` titles of each mark's group in [t - before, t], joined."""
    pairs = near(marks.select(group, t), items.select(group, t, title), before, t, (group,)).where(F.col(f"dst_{t}") <= F.col(f"src_{t}"))
    w = Window.partitionBy(f"src_{group}", f"src_{t}").orderBy(f"dst_{t}", f"dst_{title}")
    top = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return top.groupBy(F.col(f"src_{group}").alias(group), F.col(f"src_{t}").alias(t)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(f"dst_{title}").alias("x")))), lambda s: s["x"]), " | ").alias("headlines"))


def tagged_entities(persons: Column, orgs: Column) -> Column:
    """Persons and organisations as one set, told apart by a prefix."""
    tag = lambda c, p: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(p), x))
    return F.array_union(tag(persons, "p:"), tag(orgs, "o:"))


def normalised(vector: Column) -> Column:
    """A vector of length 1, rounded to five places; a zero vector stays."""
    # bound as lambda variables, so that neither is computed again for each component
    bound = F.transform(F.array(vector), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("n")))
    return F.flatten(F.transform(bound, lambda r: F.transform(r["v"], lambda x: F.round(F.when(r["n"] > 0, x.cast("double") / r["n"]).otherwise(0.0), 5))))


def eligible(articles: DataFrame, least: int = 15) -> DataFrame:
    """Articles about the region whose title is longer than ``least`` characters."""
    return articles.where(F.col("about_baltic") & (F.length("title") > least))


def sides(articles: DataFrame, one: str = "ru_by", others: tuple[str, ...] = ("baltic", "baltic_rus")) -> tuple[DataFrame, DataFrame]:
    """Sources and candidates of the matcher."""
    rows = eligible(articles)
    return rows.where(F.col("group") == one), rows.where(F.col("group").isin(*others))


def embedded(rows: DataFrame, encode, title: str = "title", out: str = "vec") -> DataFrame:
    """``rows`` with the vector of their title; each distinct title is encoded
    once.  ``encode`` makes a column of vectors from a column of texts."""
    titles = rows.select(title).distinct()
    return rows.join(titles.withColumn(out, normalised(encode(F.col(title)))), title)


def match(src: DataFrame, dst: DataFrame, encode, hours: int = 48) -> DataFrame:
    """Each source with its best counterpart by cosine and by shared rare names
    within the window.  Rows: id, ts (stamp), domain, title, persons, orgs."""
    both = src.select("title").union(dst.select("title"))
    vectors = embedded(both.distinct(), encode)

    def made(df: DataFrame) -> DataFrame:
        own = df.select("id", "domain", "title", F.unix_seconds(F.to_timestamp("ts", "yyyyMMddHHmmss")).alias("t"), tagged_entities(F.col("persons"), F.col("orgs")).alias("entities"))
        return own.join(vectors, "title")

    # rows are told apart by a hash of the id
    a, b = (made(x).withColumn("n", F.xxhash64("id")) for x in (src, dst))
    emb = top_by_vector(a.select("n", "t", "title", "domain", "entities", "vec"), b, hours * 3600, "n", carry=("title", "domain"))
    # names need no vector, so that side is not made from the encoded titles
    plain = [x.select(F.xxhash64("id").alias("n"), "title", "domain", F.unix_seconds(F.to_timestamp("ts", "yyyyMMddHHmmss")).alias("t"), tagged_entities(F.col("persons"), F.col("orgs")).alias("entities")) for x in (src, dst)]
    ent = top_by_entities(*plain, hours * 3600, key="n", carry=("title", "domain"))
    left = src.select(F.xxhash64("id").alias("src_n"), F.col("id").alias("src_id"), F.col("domain").alias("src_domain"), F.col("title").alias("src_title"))
    with_emb = left.join(emb.select("src_n", F.round("score", 4).alias("emb_cos"), F.col("dst_title").alias("emb_title"), F.col("dst_domain").alias("emb_domain")), "src_n")
    return with_emb.join(ent.select("src_n", F.col("shared").cast("int").alias("ent_shared"), F.col("dst_title").alias("ent_title"), F.col("dst_domain").alias("ent_domain")), "src_n").drop("src_n")
