"""Candidate duplicates: statements of a type that cite the same longer quote, as clusters.

Blocking gives a star for each (quote, type), never all pairs; clusters are the components of the stars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import scan
from marginalia.operators.anchor import PAGE
from marginalia.operators.components import components
from marginalia.sources.shared import written


def statement_key(page: str = "page_index", statement: str = "statement_id") -> Column:
    return F.concat(F.lit("p"), F.col(page).cast("string"), F.lit(":"), F.col(statement))


def cited_quotes(statements: DataFrame, references: DataFrame, evidence: DataFrame, least: int = 25) -> DataFrame:
    """book_id, key, type and each different normalised quote of at least `least` characters that the statement cites."""
    quotes = evidence.select(*PAGE, "evidence_id", T.normalized(F.col("excerpt")).alias("quote")).where(F.length("quote") >= least)
    met = references.join(quotes, [*PAGE, "evidence_id"]).join(statements.select(*PAGE, "statement_id", "type"), [*PAGE, "statement_id"])
    return met.select("book_id", statement_key().alias("key"), "page_index", "type", "quote").distinct()


def edges(cited: DataFrame, scope: str | None = "book_id") -> DataFrame:
    """u, v (with the book in front): each statement and the first one of its quote and type.

    scope=None looks across books. A quote that very many statements cite gives one star; the stars' centres come from a
    combining aggregate, and the join back can be split where it is skewed."""
    by = [*([scope] if scope else []), "type", "quote"]
    full = F.concat_ws("/", "book_id", "key")
    named = cited.select(*dict.fromkeys([*by]), full.alias("node"))
    first = named.groupBy(*by).agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(first, by).where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def clusters(edge_rows: DataFrame) -> DataFrame:
    """node and cluster (its least node)."""
    return components(edge_rows).select("node", F.col("component").alias("cluster"))


def cluster_lists(members: DataFrame) -> DataFrame:
    """book_id, place, cluster, size and members of each cluster: members by page number, then id; the largest cluster of a book
    first (of equal ones that whose first member comes first)."""
    page = F.regexp_extract("node", r"/p(\d+):", 1).cast("long")
    order = F.struct(page.alias("page"), F.length("node").alias("n"), "node")
    lists = members.groupBy("cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(order)).alias("all"))
    rows = lists.select(F.split_part("cluster", F.lit("/"), F.lit(1)).alias("book_id"), "cluster", "size", (-F.col("size")).alias("fewer"), F.element_at("all", 1).alias("first"), F.array_join(F.transform("all", lambda x: x["node"]), " ").alias("members"))
    placed = scan.placed(rows, ["book_id"], ["fewer", "first"])
    return scan.numbered(placed, ["book_id"], ["fewer", "first"], "place").select("book_id", "place", "cluster", "size", "members")


def accepted(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (cluster, merge_no, node, text) limited to members of their cluster, in groups of at least two."""
    inside = decisions.join(members, ["cluster", "node"], "left_semi")
    size = inside.groupBy("cluster", "merge_no").agg(F.count_distinct("node").alias("n")).where("n >= 2").drop("n")
    return inside.join(size, ["cluster", "merge_no"], "left_semi")


def similar_texts(statements: DataFrame, least: float = 0.8, block: int = 2000) -> DataFrame:
    """Links between statements of a book with token Jaccard of at least `least` (an optional widening of recall).

    Statements with one set of tokens are linked with the first of them alone, so many equal ones give as many links as there
    are others. Between different sets each alike pair is a link of their first statements. A pair so alike shares a token
    among the first few of each in order of rarity (prefix), at places that leave enough tokens after them (position), and
    its sizes are near (length); sizes go by classes of which a set meets its own and the next. A token that more than
    `block` sets of a book and class have is dealt out: the one side to as many parts as it takes, the other to each."""
    tokens = statements.select("book_id", statement_key().alias("key"), F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), T.BLANK), lambda t: t != ""))).alias("tokens")).where("size(tokens) > 0")
    rows = written(tokens.select("book_id", "key", F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("set"), "tokens"), "token-sets")
    one = rows.groupBy("book_id", "set").agg(F.min("key").alias("first"), F.first("tokens").alias("tokens"))
    sets = written(one.withColumn("id", F.monotonically_increasing_id()), "sets")
    copies = rows.select("book_id", "set", "key").join(sets.select("book_id", "set", "first"), ["book_id", "set"]).where("key <> first").select("book_id", F.col("first").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("jaccard"))
    # from here on a set goes by its number and a token by its hash: tokens that share one count as one in the order of rarity,
    # which only lets more pairs through to the check
    coded = sets.select("book_id", F.col("id").alias("set"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    each = coded.select("book_id", "set", F.explode("hashes").alias("token"))
    count = each.groupBy("book_id", "token").agg(F.count("*").alias("n"))
    ranked = each.join(count, ["book_id", "token"]).groupBy("book_id", "set").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda t: t["token"]).alias("order"))
    size = F.size("order")
    prefix = (size - F.ceil(F.lit(least) * size) + 1).cast("int")
    klass = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least) + 1e-9)).cast("int")
    places = written(ranked.select("book_id", "set", size.alias("size"), klass.alias("class"), F.posexplode(F.slice("order", F.lit(1), prefix)).alias("at", "token")), "prefixes")
    key = ["book_id", "token", "class"]
    parts = places.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    # those dealt out are fewer than one in `block` places, so small enough to send to every task
    many = F.broadcast(parts.where("parts > 1"))
    deal = lambda rows: rows.join(many, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = deal(places).select(*key, F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"), F.col("set").alias("u"), F.col("size").alias("su"), F.col("at").alias("pu"))
    # smaller classes come to the larger one's parts, a class to its own
    probes = deal(places.withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1))))
    right = probes.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("set").alias("v"), F.col("size").alias("sv"), F.col("at").alias("pv"))
    need = F.ceil(F.lit(least / (1 + least)) * (F.col("su") + F.col("sv")) - 1e-9)
    near = (F.col("sv") >= least * F.col("su") - 1e-9) & (F.col("su") >= least * F.col("sv") - 1e-9) & (1 + F.least(F.col("su") - F.col("pu"), F.col("sv") - F.col("pv")) - 1 >= need)
    pairs = written(left.join(right, [*key, "part"]).where((F.col("u") != F.col("v")) & near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    met = pairs
    for end in ("u", "v"):  # only tokens of sets that stand in a pair travel
        own = sets.join(pairs.select(F.col(end).alias("id")).distinct(), "id", "left_semi")
        met = met.join(own.select("book_id" if end == "u" else F.lit(0).alias("_"), F.col("id").alias(end), F.col("first").alias(f"{end}_first"), F.col("tokens").alias(f"{end}_tokens")), end)
    common = F.size(F.array_intersect("u_tokens", "v_tokens"))
    jaccard = common / (F.size("u_tokens") + F.size("v_tokens") - common)
    links = met.withColumn("jaccard", jaccard).where(F.col("jaccard") >= least).select("book_id", F.least("u_first", "v_first").alias("a"), F.greatest("u_first", "v_first").alias("b"), "jaccard")
    return copies.unionByName(links)
