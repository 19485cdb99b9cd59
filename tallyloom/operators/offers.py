"""Matching marketplace offers to products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import constants as C
from tallyloom.functions import predicates as P
from tallyloom.functions import text as X
from tallyloom.operators import joins as J
from tallyloom.operators import ranking as R
from tallyloom.session import stored

# Rows of one query kind that can matter: five, and as many as earlier kinds may have taken.
_POOL = C.OFFERS_KEPT * len(C.QUERY_KINDS)
# Of them, those of a kind that finds by name: kinds before it take five each.
_NAME_POOL = C.OFFERS_KEPT * max(i for i, kind in enumerate(C.QUERY_KINDS, 1) if kind.endswith("_name"))


def query_phrases(products: DataFrame) -> DataFrame:
    """(product_id, ord, kind, query) search phrases of every searchable product."""
    wanted = products.filter(P.searchable(F.col("brand_name"), F.col("prod_name"), F.col("model_code")))
    entries = X.search_queries(F.col("brand_name"), F.col("prod_name"), F.col("model_code"))
    return wanted.select("product_id", F.explode(entries).alias("q")).select("product_id", "q.*")


def _wanted(products: DataFrame) -> DataFrame:
    """(product_id, base_price, __code, __name) of every searchable product, texts as offers are held against them."""
    return products.filter(P.searchable(F.col("brand_name"), F.col("prod_name"), F.col("model_code"))).select(
        "product_id",
        "base_price",
        F.lower(X.clean_model_code(F.coalesce(F.col("model_code"), F.lit("")))).alias("__code"),
        F.nullif(X.norm_text(F.trim(F.coalesce("prod_name", F.lit("")))), F.lit("")).alias("__name"),
    )


def acceptable_offers(products: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged offers (product, kind, pos, id, title, price, ..) that pass every filter.

    Texts are normalised on their own side of the join, so a product's name
    once. Cheap filters come first. The similarity is evaluated once per row
    they leave: as an array element that its own test may drop, since a plain
    filter on it would be pushed into the join and evaluated there again.
    """
    wanted = _wanted(products)
    rows = staged.withColumn("title", X.strip_markup(F.col("title"))).filter(~P.is_spam_title(F.col("title")))
    rows = rows.withColumns(
        {"__title": X.norm_text(F.col("title")), "__packed": F.lower(F.replace(F.col("title"), F.lit(" "), F.lit("")))}
    )
    is_code = F.col("kind").endswith("_code")
    exact = (F.col("__code") != "") & F.contains(F.col("__packed"), F.col("__code"))
    kept = (
        rows.join(wanted, "product_id")
        .filter(P.plausible_price(F.col("price"), F.col("base_price")))
        .filter(~is_code | (X.is_valid_code(F.col("__code")) & exact))
    )
    floor = F.when(exact, C.SIMILARITY_FLOOR_WITH_CODE).otherwise(C.SIMILARITY_FLOOR)
    similarity = F.coalesce(X.normal_similarity(F.col("__name"), F.col("__title")), F.lit(0.0))
    scored = F.explode_outer(F.filter(F.array(similarity), lambda s: s >= floor)).alias("similarity")
    return kept.select(*staged.columns, scored).filter(F.col("similarity").isNotNull())


def _accept(pool: Column) -> Column:
    """Walk a product's pool in (kind, price, pos) order and accept five per kind, no id twice."""
    row_type = "struct<kind_ord:int,price:int,pos:bigint,id_key:string,offer_id:string,title:string,mall_name:string,mall_url:string,similarity:double>"
    start = F.array().cast(f"array<{row_type}>")

    def step(taken: Column, row: Column) -> Column:
        full = F.size(F.filter(taken, lambda t: t["kind_ord"] == row["kind_ord"])) >= C.OFFERS_KEPT
        known = F.exists(taken, lambda t: t["id_key"] == row["id_key"])
        return F.when(full | known, taken).otherwise(F.array_append(taken, row))

    return F.aggregate(pool, start, step)


def accepted_offers(
    products: DataFrame, staged: DataFrame, dedupe_blank_ids: bool = False
) -> DataFrame:
    """Offers accepted per product: kinds in order, per kind the cheapest five not yet accepted.

    Earlier kinds take at most fifteen ids, so the twenty cheapest distinct ids
    of a kind decide. Everything above that is folded away map-side, and the
    order-dependent walk sees at most eighty rows per product.
    """
    kind_ord = F.array_position(F.array(*[F.lit(k) for k in C.QUERY_KINDS]), F.col("kind")).cast("int") - 1
    blank = F.coalesce(F.col("offer_id"), F.lit("")) == ""
    own_key = F.concat_ws("#", F.lit(""), F.col("kind"), F.col("pos").cast("string"))
    id_key = F.coalesce(F.col("offer_id"), F.lit("")) if dedupe_blank_ids else F.when(blank, own_key).otherwise(F.col("offer_id"))
    rows = acceptable_offers(products, staged).select(
        "product_id",
        F.struct(
            kind_ord.alias("kind_ord"),
            F.col("price").cast("int").alias("price"),
            F.col("pos").cast("bigint").alias("pos"),
            id_key.alias("id_key"),
            "offer_id",
            "title",
            "mall_name",
            "mall_url",
            F.col("similarity").cast("double").alias("similarity"),
        ).alias("r"),
    )
    cheapest = (
        rows.select("product_id", F.col("r.kind_ord").alias("k"), F.col("r.id_key").alias("i"), "r")
        .groupBy("product_id", "k", "i")
        .agg(F.min("r").alias("r"))
        .drop("i")
    )
    window = Window.partitionBy("product_id", "k").orderBy("r")
    pooled = (
        cheapest.withColumn("__rn", F.row_number().over(window))
        .filter(F.col("__rn") <= _POOL)
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list("r")).alias("pool"))
    )
    return pooled.select("product_id", F.explode(_accept(F.col("pool"))).alias("r")).select("product_id", "r.*").drop("id_key")


def match_offers(
    products: DataFrame, staged: DataFrame, dedupe_blank_ids: bool = False
) -> DataFrame:
    """Final top five per product: accepted offers, the cheapest of each mall, ranked by price."""
    order = [F.col("price"), F.col("kind_ord"), F.col("pos")]
    pooled = accepted_offers(products, staged, dedupe_blank_ids)
    per_mall = R.first_per_mall(pooled, ["product_id"], *order)
    return R.rank_offers(per_mall, ["product_id"], order, C.OFFERS_KEPT).withColumn(
        "similarity_score", F.round("similarity", 2).cast("decimal(5,2)")
    )


def match_offers_fallback(staged: DataFrame, k: int = C.OFFERS_KEPT) -> DataFrame:
    """Simpler policy: code results where there are any, else name results; cheapest k."""
    by_code = F.col("kind").endswith("_code")
    usable = staged.groupBy("product_id").agg(F.bool_or(by_code).alias("__code"))
    # Keep k of each sort per product first: the pick between both then joins few rows.
    pool = R.top_per_key(
        staged.withColumn("__by_code", by_code), ["product_id", "__by_code"], [F.col("price"), F.col("pos")], k
    )
    return (
        pool.join(usable, "product_id")
        .filter(F.col("__by_code") == F.col("__code"))
        .drop("__by_code", "__code")
    )


# Rows of one side that meet in a block; words with more postings are cut into several.
BLOCK_ROWS = 2_000


def _blocks(rows: Column) -> Column:
    return F.ceil(rows / F.lit(BLOCK_ROWS)).cast("int")


def _every(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def candidate_titles(products: DataFrame, titles: DataFrame, min_shared: int = 1) -> DataFrame:
    """Blocking in place of a remote search: (brand, query, title, shared) for titles of a brand that share words with a query.

    Works on distinct (brand, core words) and distinct (brand, title), so copies
    of a name or title meet once. How many queries and titles of a brand hold a
    word is counted first. Words that only one side has are left out there.
    Heavier words are cut into blocks, in proportion on both sides, and every
    block of queries meets every block of titles. A pair is taken where it
    meets at the rarest word it shares, by a test inside the join, and its
    words are counted on the spot: what the join returns are the pairs
    themselves, each once, and they need not be gathered. A query of fewer than
    ``min_shared`` words has to share all of them.
    """
    queries = (
        products.select(F.lower("brand_name").alias("brand"), X.core_tokens(F.lower("prod_name")).alias("tokens"))
        .filter(F.size("tokens") > 0)
        .select("brand", F.array_join("tokens", " ").alias("query"), F.array_distinct("tokens").alias("tokens"))
        .distinct()
    )
    needed = F.least(F.lit(min_shared), F.size("tokens")).alias("needed")
    asked = queries.select("brand", "query", needed, F.explode("tokens").alias("token"))
    words = F.array_distinct(X.core_tokens(F.lower(X.strip_markup(F.col("title"))), None)).alias("words")
    # Stored, so that titles are told apart once and no title is split before that.
    texts = stored(titles.select(F.lower("brand_name").alias("brand"), "title").distinct().select("brand", "title", words), "titles")
    given = texts.select("brand", "title", "words", F.explode("words").alias("token"))
    word = ["brand", "token"]
    frequency = asked.groupBy(*word).agg(F.count("*").alias("in_queries")).join(given.groupBy(*word).agg(F.count("*").alias("in_titles")), word)
    frequency = stored(frequency, "words")
    # A query's words, the rarest first.
    rarest = asked.join(frequency, word).groupBy("brand", "query", "needed").agg(
        F.array_sort(F.collect_list(F.struct("in_titles", "token", "in_queries"))).alias("known")
    )
    own = rarest.select("brand", "query", "needed", F.col("known.token").alias("tokens"), F.explode("known").alias("w"))
    probes = own.select(
        "brand",
        "query",
        "needed",
        "tokens",
        "w.token",
        F.pmod(F.xxhash64("query"), _blocks(F.col("w.in_queries"))).alias("query_block"),
        _every(_blocks(F.col("w.in_titles"))).alias("title_block"),
    )
    postings = given.join(frequency, word).select(
        *word,
        "title",
        "words",
        F.pmod(F.xxhash64("title"), _blocks(F.col("in_titles"))).alias("title_block"),
        _every(_blocks(F.col("in_queries"))).alias("query_block"),
    )
    p, t = probes.alias("p"), postings.alias("t")
    shared = F.array_intersect("p.tokens", "t.words")
    equal = [F.col(f"p.{c}") == F.col(f"t.{c}") for c in ("brand", "token", "query_block", "title_block")]
    pairs = p.join(t, [*equal, F.get(shared, F.lit(0)) == F.col("p.token")])
    found = pairs.select("p.brand", "query", "title", F.size(shared).alias("shared"), "needed")
    return found.filter(F.col("shared") >= F.col("needed")).drop("needed")


def candidate_codes(products: DataFrame, titles: DataFrame) -> DataFrame:
    """Titles that hold a product's cleaned code as a word, by an equi-join on (brand, word)."""
    codes = products.select(
        "product_id", F.lower("brand_name").alias("brand"), F.lower(X.clean_model_code(F.col("model_code"))).alias("word")
    ).filter(X.is_valid_code(F.col("word")))
    # Titles are told apart before they are split, and words that are no code stay where they are.
    texts = titles.select(F.lower("brand_name").alias("brand"), "title").distinct()
    split = F.array_distinct(F.split(F.lower(X.strip_markup(F.col("title"))), r"\s+"))
    words = texts.select("brand", "title", F.explode(F.filter(split, X.is_valid_code)).alias("word"))
    return codes.join(words, ["brand", "word"]).select("product_id", "title")


def _cheapest_by_class(near: DataFrame, there: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, k, n, r): the ``_NAME_POOL`` cheapest ids, numbered, among the offers ``near`` a class, for each of its price floors.

    A class's floors ascend; floor k takes the prices above it, floor 0 all. The
    floors cut prices into steps. Of a step only the cheapest ids can be among
    the cheapest of any floor below it, so every step is folded to those first.
    An offer then counts for the floors above the last cheaper offer of its id
    and above the last full step below its own.
    """
    price, lows = F.col("price"), F.col("lows")
    reached = near.join(classes, CLASS).join(there, ["brand", "title"])
    reached = reached.filter(F.col("any") | (price > F.get(lows, F.lit(0))) & (price < F.col("high")))
    above = F.when(price > F.element_at(lows, -1), F.size(lows)).otherwise(F.coalesce(F.size(F.filter(lows, lambda low: price > low)), F.lit(0)))
    step = F.when(F.size(lows) > 0, above).otherwise(F.lit(0)).alias("step")
    blank = F.coalesce(F.col("offer_id"), F.lit("")) == ""
    own_key = F.concat_ws("#", F.lit(""), F.lit(C.QUERY_KINDS[0]), F.col("pos").cast("string"))
    id_key = F.when(blank, own_key).otherwise(F.col("offer_id")).alias("id_key")
    r = F.struct("price", "pos", id_key, "offer_id", X.strip_markup(F.col("title")).alias("shown"), "mall_name", "mall_url", "title")
    first = reached.select(*CLASS, step, id_key, r.alias("r")).groupBy(*CLASS, "step", "id_key").agg(F.min("r").alias("r"))
    kept = R.top_per_key(first, [*CLASS, "step"], [F.col("r")], _NAME_POOL)
    below = Window.partitionBy(*CLASS).orderBy("step").rangeBetween(Window.unboundedPreceding, -1)
    counted = kept.withColumn("held", F.count("*").over(Window.partitionBy(*CLASS, "step")))
    full = F.max(F.when(F.col("held") >= _NAME_POOL, F.col("step"))).over(below)
    cheaper = F.lag("step").over(Window.partitionBy(*CLASS, "id_key").orderBy("step"))
    lowest = F.greatest(full, cheaper, F.lit(-1)) + 1
    spread = counted.withColumn("lowest", lowest).select(*CLASS, F.explode(F.sequence("lowest", "step")).alias("k"), "r")
    numbered = spread.withColumn("n", F.row_number().over(Window.partitionBy(*CLASS, "k").orderBy("r")))
    return numbered.filter(F.col("n") <= _NAME_POOL).select(*CLASS, "k", "n", "r")


def _holding_codes(titles: DataFrame, asking: DataFrame) -> DataFrame:
    """(class, product_id, title): products of ``asking`` and titles of their brand that hold the code, spaces left out.

    Every piece of a title that is as long as some code meets the codes by equality.
    """
    codes = asking.filter(F.col("__code") != "").select(*CLASS, "product_id", F.col("__code").alias("piece"))
    lengths = sorted(r[0] for r in codes.select(F.length("piece")).distinct().collect())
    packed = F.lower(F.replace(X.strip_markup(F.col("title")), F.lit(" "), F.lit("")))
    sized = titles.select("brand", "title", packed.alias("packed"), F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n"))
    places = F.sequence(F.lit(1), F.length("packed") - F.col("n") + 1)
    placed = sized.filter(F.length("packed") >= F.col("n")).select("brand", "title", "packed", "n", F.explode(places).alias("at"))
    pieces = placed.select("brand", "title", F.substring("packed", F.col("at"), F.col("n")).alias("piece")).distinct()
    return codes.join(pieces, ["brand", "piece"]).select(*CLASS, "product_id", "title")


# Products of a class search the same words of the same brand under the same name: they differ in price and code.
CLASS = ["brand", "query", "__name"]


def staged_from_phrases(products: DataFrame, offers: DataFrame) -> DataFrame:
    """What ``match_offers`` can take of all that a search for each product's phrases finds among ``offers`` (brand_name, title, pos, offer_id, price, ..).

    Name phrases find the titles of the brand that share a word, code phrases
    those that hold the code. What names find grows with products times
    titles, so it is not spread out: titles are held against each name once.
    Those near enough for every product of the name give the cheapest ids
    above each product's floor, as many as the kind and those before it can
    take, five each: each such offer is acceptable, or dearer than the product
    allows, as all after it are. Those near enough only with the code are found
    by it. Blank ids count singly.
    """
    own = products.select(
        "product_id", F.lower("brand_name").alias("brand"), F.array_join(X.core_tokens(F.lower("prod_name")), " ").alias("query")
    )
    base = F.col("base_price")
    priced = base > 0
    low, high = F.when(priced, base * F.lit(C.PRICE_LOW)).alias("low"), F.when(priced, base * F.lit(C.PRICE_HIGH)).alias("high")
    asking = own.join(_wanted(products), "product_id").filter(F.col("__name").isNotNull()).select("product_id", *CLASS, "__code", low, high).distinct()
    asking = stored(asking, "asking")
    classes = asking.groupBy(*CLASS).agg(
        F.sort_array(F.collect_set("low")).alias("lows"), F.max("high").alias("high"), F.bool_or(F.col("low").isNull()).alias("any")
    )
    shown = X.strip_markup(F.col("title"))
    pairs = classes.select(*CLASS).join(candidate_titles(products, offers).select("brand", "query", "title"), ["brand", "query"])
    scored = F.explode(F.filter(F.array(X.normal_similarity(F.col("__name"), X.norm_text(shown))), lambda s: s >= C.SIMILARITY_FLOOR_WITH_CODE))
    pairs = stored(pairs.filter(~P.is_spam_title(shown)).select(*CLASS, "title", scored.alias("similarity")), "pairs")
    there = offers.select(F.lower("brand_name").alias("brand"), "title", "pos", "offer_id", "price", "mall_name", "mall_url")
    phrases = query_phrases(products).select("product_id", "kind", F.substring_index("kind", "_", -1).alias("by")).distinct()

    near = pairs.filter(F.col("similarity") >= C.SIMILARITY_FLOOR).select(*CLASS, "title")
    k = F.coalesce(F.array_position("lows", F.col("low")), F.lit(0)).cast("int").alias("k")
    floors = asking.join(classes.select(*CLASS, "lows"), CLASS).select("product_id", *CLASS, k)
    chosen = floors.join(_cheapest_by_class(near, there, classes), [*CLASS, "k"]).select("product_id", F.lit("name").alias("by"), "n", "r")
    columns = ["product_id", "kind", "title", "pos", "offer_id", "price", "mall_name", "mall_url"]
    kinds = F.array(*[F.lit(kind) for kind in C.QUERY_KINDS])
    taken = F.col("n") <= C.OFFERS_KEPT * F.array_position(kinds, F.col("kind"))
    by_name = chosen.join(phrases, ["product_id", "by"]).filter(taken).select("product_id", "kind", "r.*").select(*columns)

    far = pairs.filter(F.col("similarity") < C.SIMILARITY_FLOOR).select(*CLASS, "title")
    holding = _holding_codes(far.select("brand", "title").distinct(), asking)
    named = holding.join(far, [*CLASS, "title"], "left_semi").select("brand", "product_id", "title", F.lit("name").alias("by"))
    coded = own.select("product_id", "brand").join(candidate_codes(products, offers), "product_id")
    found = named.unionByName(coded.select("brand", "product_id", "title", F.lit("code").alias("by"))).distinct()
    by_code = found.join(phrases, ["product_id", "by"]).join(there, ["brand", "title"]).select(*columns)
    return by_name.unionByName(by_code)


def refine_prices(products: DataFrame, offers: DataFrame) -> DataFrame:
    """(part, id) of clean products, clean offers and quarantined offers, out of one join of offers and products.

    The join leaves a product's offers together, so its first clean offer also
    stands for the product, and nothing is joined or shuffled again.
    """
    tagged = J.tag_offers(products, offers).filter(F.col("verdict").isNotNull())
    clean = F.col("verdict") == "clean"
    first = F.row_number().over(Window.partitionBy("product_id").orderBy(F.when(clean, 0).otherwise(1), "offer_id"))

    def part(name: str, key: str) -> Column:
        return F.struct(F.lit(name).alias("part"), F.col(key).alias("id"))

    parts = F.array(
        F.when(clean, part("offers_clean", "offer_id")).otherwise(part("offers_anomaly", "offer_id")),
        F.when(clean & (F.col("__first") == 1), part("products_clean", "product_id")),
    )
    return tagged.withColumn("__first", first).select(F.explode(F.array_compact(parts)).alias("p")).select("p.*")


def publish_refined(products: DataFrame, offers: DataFrame, root: str, version: str) -> dict[str, DataFrame]:
    """Write the refined tables below ``root/version``, then add the version to ``root/versions``.

    The join runs once: tagged offers are written partitioned by verdict, and
    the clean products are those of the clean partition just written. A
    version is listed only when its tables are complete, and none is ever
    taken from the list, so a reader always finds a whole one.
    """
    spark = products.sparkSession
    tagged = J.tag_offers(products, offers).filter(F.col("verdict").isNotNull()).select(*offers.columns, "verdict")
    tagged.write.mode("errorifexists").partitionBy("verdict").parquet(f"{root}/{version}/offers")
    written = spark.read.schema(tagged.schema).parquet(f"{root}/{version}/offers")
    kept = products.join(written.filter(F.col("verdict") == "clean").select("product_id").distinct(), "product_id", "left_semi")
    kept.write.mode("errorifexists").parquet(f"{root}/{version}/products_clean")
    listed = spark.createDataFrame([(version,)], "version string").coalesce(1)
    listed.write.mode("append").json(f"{root}/versions")
    return refined_version(spark, root, version)


def refined_version(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """The refined tables of a version, by default the current one."""
    version = version or current_version(spark, root)
    written = spark.read.parquet(f"{root}/{version}/offers")
    return {
        "products_clean": spark.read.parquet(f"{root}/{version}/products_clean"),
        "offers_clean": written.filter(F.col("verdict") == "clean").drop("verdict"),
        "offers_anomaly": written.filter(F.col("verdict") == "anomaly").drop("verdict"),
    }


def current_version(spark: SparkSession, root: str) -> str:
    """The greatest version listed; one row of the aggregate reaches the driver."""
    return spark.read.schema("version string").json(f"{root}/versions").agg(F.max("version")).first()[0]


def offer_coverage(products: DataFrame, matched: DataFrame, wanted: int = C.OFFERS_KEPT) -> DataFrame:
    """Number of matched offers per product: found, short or none."""
    counts = matched.groupBy("product_id").agg(F.count("*").alias("matched"))
    return products.select("product_id").join(counts, "product_id", "left").select(
        "product_id",
        F.coalesce("matched", F.lit(0)).alias("matched"),
        F.when(F.coalesce("matched", F.lit(0)) >= wanted, "found")
        .when(F.coalesce("matched", F.lit(0)) > 0, "short")
        .otherwise("none")
        .alias("coverage"),
    )
