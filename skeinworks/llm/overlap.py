"""Problem 2: records of evaluation splits that also occur in training, exactly or almost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..session import checkpointed, table
from .common import EVALUATION_SPLITS, current_splits, image_rows


def word_shingles(text, words: int = 5):
    """Distinct shingles of ``words`` words of a text column; a shorter text is one shingle, an empty one none."""
    tokens = F.filter(F.split(F.lower(S.trimmed(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda x: x != "")

    def shingles(t):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (words - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, words), " "))

    # the outer array binds the words to a variable; else each shingle would split the text again
    return F.get(F.transform(F.array(tokens), lambda t: F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(shingles(t)))), F.lit(0))


def prefix_join(evaluation: DataFrame, training: DataFrame, similarity: float | None = 0.8, overlap: int = 1) -> DataFrame:
    """All pairs (evaluation id, training id) whose token sets are alike; exact.

    Both inputs have ``id, token`` rows. With ``similarity`` t a pair counts
    when the Jaccard similarity is at least t; with ``similarity=None`` when
    the sets share at least ``overlap`` tokens. Returns ``id_a, id_b, shared``
    (``shared`` counts all common tokens).

    Tokens are ranked from rare to frequent over both sides. Only the prefix
    of each set that a sufficiently similar set must hit is kept: the
    evaluation prefixes are the index, the training prefixes probe it with a
    length and a position filter. Candidates are verified on the whole sets.
    Tokens of one side only are dropped before the probe, after the ranks are
    set: they can't meet. Hot tokens sit last in the rank order and rarely in
    a prefix; those that do are split by AQE's skew join (both sides sort-merge).

    Defined cases: null ids or tokens are ignored, repeated tokens count once,
    empty sets match nothing, an id on both sides isn't paired with itself.
    """
    sides = evaluation.select("id", "token", F.lit(0).alias("side")).unionByName(training.select("id", "token", F.lit(1).alias("side")))
    sides = sides.where(F.col("id").isNotNull() & F.col("token").isNotNull()).distinct()
    df = sides.groupBy("token").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    df = df.select("token", (F.col("n0") + F.col("n1")).alias("n"), ((F.col("n0") > 0) & (F.col("n1") > 0)).alias("both"))
    if similarity is None:  # only common tokens count, and no length is needed: those of one side can go at once
        df = df.where("both")
    ranked = sides.join(df, "token").groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("n", "token", "both"))).alias("s"))
    size = F.size("s")
    least = F.ceil(F.lit(similarity) * size - F.lit(1e-9)).cast("int") if similarity is not None else F.lit(overlap)
    live = F.transform(F.filter("s", lambda x: x["both"]), lambda x: x["token"])
    sets = checkpointed(ranked.select("side", "id", size.alias("n"), live.alias("tokens"), F.slice("s", F.lit(1), F.greatest(size - least + 1, F.lit(0))).alias("prefix")).where(F.size("tokens") > 0))
    probe = sets.select("side", "id", "n", F.posexplode("prefix").alias("pos", "t")).where("t.both")
    a = probe.where("side = 0").select(F.col("t.token").alias("token"), F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    b = probe.where("side = 1").select(F.col("t.token").alias("token"), F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    rest = F.lit(1) + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    if similarity is not None:
        t = F.lit(similarity)
        needed = F.ceil(t / (t + 1) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9))
        near = (F.col("n_b") >= t * F.col("n_a") - 1e-9) & (F.col("n_a") >= t * F.col("n_b") - 1e-9)
    else:
        needed, near = F.lit(overlap), F.lit(True)
    found = a.hint("merge").join(b, "token").where(near & (F.col("id_a") != F.col("id_b")))
    # the first common prefix token bounds what the rest can still share; later hits of the pair are looser
    found = found.groupBy("id_a", "id_b").agg(F.max(rest).alias("most"), F.first(needed).alias("needed")).where("most >= needed")
    checked = (
        found.join(sets.where("side = 0").select(F.col("id").alias("id_a"), F.col("tokens").alias("ta")), "id_a")
        .join(sets.where("side = 1").select(F.col("id").alias("id_b"), F.col("tokens").alias("tb")), "id_b")
        .withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    )
    return checked.where(F.col("shared") >= F.col("needed")).select("id_a", "id_b", "shared")


def image_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, token, split`` of images: pixel hash and near-duplicate group are the tokens; only splits that matter.

    Both sides are aggregated by id before they meet, so the tokens cross the network once.
    """
    rows = image_rows(spark, sf_dir)
    named = lambda kind, c: F.transform(F.collect_set(c), lambda x: F.concat(F.lit(kind), x))
    tokens = rows.groupBy(F.col("stable_image_id").alias("id")).agg(F.concat(named("pixel:", "pixel"), named("group:", "near_group")).alias("tokens"))
    split = current_splits(spark, sf_dir).select(F.col("stable_image_id").alias("id"), F.col("eligibility").alias("split"))
    return tokens.join(split.where(F.col("split").isin("training", *EVALUATION_SPLITS)), "id").select("id", F.explode("tokens").alias("token"), "split")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation image, training image and the number of their common tokens for every overlap."""
    tokens = checkpointed(image_tokens(spark, sf_dir))
    return prefix_join(tokens.where(F.col("split") != "training"), tokens.where(F.col("split") == "training"), similarity=None, overlap=1)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images in training and an evaluation split with the same pixels or near-duplicate group."""
    pairs = p2_pairs(spark, sf_dir)
    return pairs.select(F.least("id_a", "id_b").alias("stable_image_id_a"), F.greatest("id_a", "id_b").alias("stable_image_id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source root of the evaluation image."""
    pairs = p2_pairs(spark, sf_dir).withColumnRenamed("id_a", "stable_image_id")
    roots = image_rows(spark, sf_dir).groupBy("stable_image_id").agg(F.min("source_root_id").alias("source_root_id"))
    split = current_splits(spark, sf_dir).select("stable_image_id", F.col("eligibility").alias("split"))
    per = pairs.groupBy("stable_image_id").agg(F.count(F.lit(1)).alias("n"))
    return per.join(roots, "stable_image_id").join(split, "stable_image_id").groupBy("split", "source_root_id").agg(F.count(F.lit(1)).alias("n_images"), F.sum("n").alias("n_pairs"))


def text_classes(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, query, class_id, tokens``: documents with shingles; those with the same set share a class, named by the smallest id.

    Shingles are 128-bit hashes. Queries are the documents whose id is divisible by 50.
    """
    hashed = F.array_sort(F.transform(word_shingles(F.col("text"), words), lambda x: F.unhex(F.md5(x))))
    own = checkpointed(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", hashed.alias("tokens")))
    own = own.where(F.size("tokens") > 0).withColumn("key", F.sha2(F.concat_ws("", F.transform("tokens", F.hex)), 256))
    first = own.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    return own.join(first, "key").select("doc_id", (F.col("doc_id") % 50 == 0).alias("query"), "class_id", "tokens")


def p2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query document with the class of its copies, and the number of other documents with a similarity of 0.8 or more.

    Every document whose id is divisible by 50 is a query, against all others
    that aren't. Exact copies are one record of the join, so a group of a
    third of all documents is one set; the links are counted in full.
    """
    rows = checkpointed(text_classes(table(spark, sf_dir, "documents")))
    sizes = rows.groupBy("class_id").agg(F.count_if("query").alias("n_queries"), F.count_if(~F.col("query")).alias("n_others"))
    sets = rows.where("doc_id = class_id").join(sizes, "class_id").select("class_id", "n_queries", "n_others", F.explode("tokens").alias("token"))
    side = lambda c, kind: sets.where(F.col(c) > 0).select(F.concat(F.lit(kind), "class_id").alias("id"), "token")
    pairs = prefix_join(side("n_queries", "q"), side("n_others", "d"), 0.8)
    number = lambda c: F.expr(f"CAST(substring({c}, 2) AS BIGINT)")
    links = pairs.select(number("id_a").alias("class_id"), number("id_b").alias("other")).join(sizes.select(F.col("class_id").alias("other"), "n_others"), "other")
    links = links.groupBy("class_id").agg(F.sum("n_others").alias("n_links"))
    return rows.where("query").select("doc_id", "class_id").join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
