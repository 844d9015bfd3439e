"""SpotSigs fingerprints from built-in functions only.

A spot signature is a common-word anchor with the two content words that follow it.
Words are runs of letters of the lower-cased text. They are told apart as common or content
one by one; zipping the places of the content words with themselves, shifted by one and two,
gives every anchor its chain, in linear time and without a regular expression that repeats. A
document's fingerprint is the set of its signatures' hashes (32 bits), in order. There is one
kind of signature for all texts; only one without any spot is represented by its own hash.

Likeness is the Jaccard similarity of the sets. Near groups join sets of likeness 0.8 or more:
sets are partitioned by length, since sets of similarity t differ in length by a factor of at
most 1/t and a set meets only its own and the next partition; in those, only sets that share
one of their rarest signatures early enough for the similarity to be in reach are compared
(see _setjoin); that loses no pair. Equal sets take part once.

Edge cases: null is an empty text; empty texts are all alike; repeated rows are
fingerprinted each; the next document of repeated ids is their next row by digest of the text; a
null id comes last in descending order, and names a group only if no other id is in it; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._setjoin import like_sets, prefix_size, shared_entries, sketch
from ._tables import bucketed, read, settle

#: Anchors: the commonest function words of English, Spanish, French, German.
ANCHORS = """the of and to in a is that for it as was with be by on this at from are an or not which have had
el la los las de que y en un una por con para su se del al lo es no como
le les des du et est une dans qui que pour pas sur au avec ce il elle sont ne ou
der die das und den von zu mit sich dem ist ein eine nicht auf als auch es an im""".split()
SIMILARITY = 0.8
#: Commonest signatures that come last in the order of prefixes (others go by hash); any number is exact.
OFTEN = 1000
#: Bytes of text of a range of ids, about, and the most ranges (three rows of each reach the driver).
RANGE_BYTES, RANGES = 32 << 20, 1 << 17


def with_signatures(df: DataFrame, text_col: str, name: str, anchors: list[str] = ANCHORS) -> DataFrame:
    """df with a column of the sorted distinct 32-bit hashes of a text's spot signatures.

    In steps, each a column that is used more than once, so that none is evaluated anew.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}]+", " ")), " ")
    common = ["", *sorted(set(anchors))]
    df = df.withColumn(f"__{name}", words)
    w = F.col(f"__{name}")
    # places of content words, after a place 0 before the text
    places = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.get(w, i - 1).isin(common)))
    df = df.withColumn(f"__{name}_at", places)
    at = F.col(f"__{name}_at")
    steps = F.zip_with(at, F.slice(at, 2, 1 << 30), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    steps = F.zip_with(steps, F.slice(at, 3, 1 << 30), lambda s, z: F.struct(s["x"].alias("x"), s["y"].alias("y"), z.alias("z")))
    # a content word y that has common words before it (after x) and a content word z behind it
    chained = F.filter(steps, lambda s: s["z"].isNotNull() & (s["y"] - s["x"] > 1))
    spots = F.flatten(F.transform(chained, lambda s: F.transform(F.slice(w, s["x"] + 1, s["y"] - s["x"] - 1), lambda a: F.hash(a, F.get(w, s["y"] - 1), F.get(w, s["z"] - 1)))))
    df = df.withColumn(f"__{name}", F.array_sort(F.array_distinct(spots))).drop(f"__{name}_at")
    found = F.col(f"__{name}")
    return df.withColumn(name, F.when(F.size(found) > 0, found).otherwise(F.array(F.hash(text)))).drop(f"__{name}")


def fingerprint(signatures: Column) -> Column:
    """The signatures as one string of eight hexadecimal digits each."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(F.when(s < 0, s.cast("long") + (1 << 32)).otherwise(s.cast("long")))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct signatures."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, signatures)."""
    return with_signatures(docs.select(id_col, F.col(text_col).cast("string").alias("__text")), "__text", "signatures").drop("__text")


def near_groups(sets: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", set_col: str = "signatures", node_col: str = "node", often: int = OFTEN) -> DataFrame:
    """(node_col, near_group): rows that have a near one, and the smallest id reached over likeness >= similarity.

    sets: a settled table of distinct longs (node_col), ids and sets.
    """
    s = F.col(set_col)
    digest = [F.xxhash64(s).alias("d1"), F.xxhash64(F.lit(1), s).alias("d2"), F.size(s).alias("n")]
    rows = sets.select(F.col(node_col).alias("node"), F.col(id_col).alias("id"), *digest)
    reps, _ = settle(rows.groupBy("d1", "d2", "n").agg(F.min("node").alias("node"), F.min("id").alias("id"), F.count("*").alias("c")), "spots-classes")
    top = sets.select(F.explode(s).alias("x")).agg(F.expr(f"approx_top_k(x, {often}, {32 * often})").alias("t")).first()["t"]
    common = F.array(*[F.lit(int(r["item"])) for r in top]) if top else F.array().cast("array<int>")
    ordered = F.concat(F.array_except("s", common), F.array_intersect("s", common))
    own = sets.select(F.col(node_col).alias("node"), s.alias("s")).join(reps.select("node"), "node", "left_semi")
    own = own.select("node", F.size("s").alias("n"), ordered.alias("o"))
    entries = own.select("node", F.posexplode(F.slice("o", F.lit(1), prefix_size(F.col("n"), similarity))).alias("pos", "x"))
    # a set of n members lies in length partition floor(log n / -log t); it meets its own and the next
    part = F.floor(F.log(F.size(s)) / F.lit(-_log(similarity))).cast("long")
    about = sets.select(F.col(node_col).alias("node"), F.size(s).alias("n"), part.alias("part"), *sketch(s))
    entries = shared_entries(entries.select(F.col("x").cast("long").alias("h"), "pos", "node"), "spots", about)
    roots = like_sets(entries, lambda nodes: sets.select(F.col(node_col).alias("node"), s.alias("s")).join(nodes, "node", "left_semi"), similarity, "spots", small=0, distinct=True)
    named = reps.join(roots.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("id").alias("near_group"), F.sum("c").alias("size")).where("size > 1")
    named = named.join(first, "root").select("d1", "d2", "n", "near_group")
    return rows.join(named, ["d1", "d2", "n"]).select(F.col("node").alias(node_col), "near_group")


def _log(x: float) -> float:
    import math

    return math.log(x)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id_col, text, signatures, next, next_signatures): each row with its next in descending order of id, the last with the first.

    Texts are dealt once into ranges of ids. Bounds are quantiles of the ids, so their spread
    does not matter; an id that is a bound has a range to itself, and so has the missing one, and a
    range of more rows than its share is split by digest. Each range also gets a copy of the first
    row of the range after it, named by id and digest, so no window spans the table. Per range,
    three rows reach the driver.
    Signatures are computed behind that, before the window, so texts alone are shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    count = min(RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size.bytes or 0) // range_bytes + 1))
    share = max(1, size.n // count)
    cuts = rows.agg(F.percentile_approx("id", [k / count for k in range(1, count)], 10 * count).alias("q")).first().q or [0]
    cuts = sorted(set(cuts), reverse=True)
    # descending ids: range 2k lies between bounds k - 1 and k, range 2k + 1 is bound k; null ids come last
    step = max(1, int(len(cuts) ** 0.5))
    tall = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    lows = F.array(*[F.lit(t[-1]) for t in tall])
    kind = docs.schema[id_col].dataType.simpleString()
    fine = spark.createDataFrame(list(enumerate(tall)), f"at int, fine array<{kind}>")
    rows = rows.withColumn("at", F.size(F.filter(lows, lambda b: b > F.col("id")))).join(F.broadcast(fine), "at", "left")
    at, inner = F.col("at"), F.coalesce("fine", F.array().cast(f"array<{kind}>"))
    k = at * step + F.size(F.filter(inner, lambda b: b > F.col("id")))
    band = F.when(F.col("id").isNull(), 2 * len(cuts) + 1).otherwise(2 * k + F.array_contains(inner, F.col("id")).cast("int"))
    rows = rows.select("id", "text", band.cast("int").alias("band"))
    parts = [(r["band"], r["count"] // share + 1 if r["band"] % 2 else 1) for r in rows.groupBy("band").count().collect()]
    split = [(b, p) for b, p in parts if p > 1]
    pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for bp in split for x in bp]), F.col("band")), F.lit(1)) if split else F.lit(1)
    first_bits = F.conv(F.substring(F.md5("text"), 1, 7), 16, 10).cast("long")
    dealt = rows.select("id", "text", "band", F.floor(first_bits * pieces / F.lit(1 << 28)).cast("int").alias("piece"))
    head = F.min(F.struct(F.col("id").isNull(), (-F.col("id")).alias("o"), F.md5("text").alias("digest"), "id"))
    heads = sorted((r["band"], r["piece"], r["h"]["id"], r["h"]["digest"]) for r in dealt.groupBy("band", "piece").agg(head.alias("h")).collect()) if size.n else []
    known = [(b, p, i, d, *heads[k - 1][:2]) for k, (b, p, i, d) in enumerate(heads)]
    dealt = dealt.join(F.broadcast(spark.createDataFrame(known, f"band int, piece int, head {kind}, digest string, before int, before_piece int")), ["band", "piece"])
    first = F.col("id").eqNullSafe(F.col("head")) & (F.md5("text") == F.col("digest"))
    own = F.struct("band", "piece", F.lit(0).alias("copy"))
    places = F.when(first, F.array(own, F.struct(F.col("before").alias("band"), F.col("before_piece").alias("piece"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    both = dealt.select("id", "text", F.explode(places).alias("p")).select("id", "text", "p.*").repartition("band", "piece")
    both = with_signatures(both, "text", "signatures")
    order = Window.partitionBy("band", "piece").orderBy("copy", F.col("id").desc_nulls_last(), F.md5("text"))
    both = both.select("id", "copy", "text", "signatures", F.lead("text").over(order).alias("next"), F.lead("signatures").over(order).alias("next_signatures"))
    return both.where("copy = 0").select(F.col("id").alias(id_col), "text", "signatures", "next", "next_signatures")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(read(spark, sf_dir, "documents"))
    third = F.floor(F.length("text") / 3).cast("int")
    rows = pairs.withColumn("edited", F.concat(F.left("text", F.length("text") - third), F.left("next", third)))
    rows = with_signatures(rows, "edited", "edited_signatures")
    own, changed, following = (F.col(c) for c in ("signatures", "edited_signatures", "next_signatures"))
    rows = rows.select(F.monotonically_increasing_id().alias("node"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), own.alias("own"), changed.alias("changed"), likeness(own, changed).alias("near_edited"), likeness(own, following).alias("near_next"))
    # dealt by node once, so that sets are found again without a shuffle of their own
    rows = bucketed(rows, "node", "spots")
    groups, _ = settle(near_groups(rows, set_col="own"), "spots-groups")
    rows = rows.join(groups, "node", "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next", F.coalesce("near_group", "doc_id").alias("near_group"))
