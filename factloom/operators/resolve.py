"""Identity resolution: tiered matching, duplicates, survivors, spellings, copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import codes
from factloom.operators import graph, relate
from factloom.session import cut


def tiered(hub: DataFrame, records: DataFrame, keys: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(record, hub, tier, confidence) of matches, and the records left for review.

    `hub` and `records` are (id, code[, signal]). Tiers, strongest first, each on the remainder:
    equal codes (1.0); equal keys after normalising, or one swap of neighbours away, when exactly
    one hub is as close (0.9); equal `signal`, when given and fitting one hub and one record only
    (0.7). Candidates are counted per record before any is kept, so ambiguous keys stay counts.
    """
    hub_keys = cut(hub.select(F.col("id").alias("hub"), "code", codes.match_key(F.col("code")).alias("key")))
    todo = records.select(F.col("id").alias("record"), "code", *(["signal"] if "signal" in records.columns else []))

    exact_hubs = _unique(hub_keys, "code")
    exact = todo.join(exact_hubs, "code").select("record", "hub")
    rest = cut(todo.join(exact.select("record"), "record", "left_anti").withColumn("key", codes.match_key(F.col("code"))))

    same_hubs = hub_keys.where("key <> ''").groupBy("key").agg(F.count_distinct("hub").alias("n"), F.min("hub").alias("hub"))
    near = rest.join(same_hubs, "key")
    normal = near.where("n = 1").select("record", "hub")
    rest = cut(rest.join(near.select("record"), "record", "left_anti"))

    swaps = rest.select("record", F.explode(codes.adjacent_swaps(F.col("key"))).alias("key")).join(same_hubs, "key")
    one_swap = swaps.groupBy("record").agg(F.sum("n").alias("n"), F.min("hub").alias("hub")).where("n = 1").select("record", "hub")
    rest = rest.join(one_swap.select("record"), "record", "left_anti")

    def tier(df: DataFrame, name: str, confidence: float) -> DataFrame:
        return df.select("record", "hub", F.lit(name).alias("tier"), F.lit(confidence).alias("confidence"))
    found = tier(exact, "exact", 1.0).unionByName(tier(normal, "normalized", 0.9)).unionByName(tier(one_swap, "normalized", 0.9))
    if "signal" in records.columns and "signal" in hub.columns:
        hubs = hub.groupBy("signal").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n = 1").select("signal", "hub")
        free = hubs.join(found.select("hub"), "hub", "left_anti")
        backed = rest.join(free, "signal").groupBy("hub").agg(F.count("*").alias("n"), F.min("record").alias("record")).where("n = 1")
        found = found.unionByName(tier(backed, "corroborated", 0.7))
    found = cut(found)
    review = records.select(F.col("id").alias("record"), "code").join(found.select("record"), "record", "left_anti")
    return found, review


def _unique(hubs: DataFrame, column: str) -> DataFrame:
    return hubs.groupBy(column).agg(F.min("hub").alias("hub"), F.count_distinct("hub").alias("n")).where("n = 1").select(column, "hub")


def claimed_twice(matches: DataFrame) -> DataFrame:
    """(record, hubs, first, last): codes that more than one hub claims."""
    once = matches.select("record", "hub").distinct()
    return once.groupBy("record").agg(F.count("*").alias("hubs"), F.min("hub").alias("first"), F.max("hub").alias("last")).where("hubs > 1")


def hub_spelling(rows: DataFrame, pattern: str) -> DataFrame:
    """(key, spelling, n): the commonest spelling of each normalised code that follows the house pattern."""
    fit = rows.where(F.col("code").rlike(pattern)).withColumn("key", codes.match_key(F.col("code")))
    return relate.most_common(fit, ["key"], "code", "spelling")


def spelled_differently(rows: DataFrame, key: Column) -> DataFrame:
    """(key, spellings): codes with several spellings whose most common description is the same.

    `rows` is (code, description).
    """
    top = relate.most_common(rows, ["code"], "description", "top")
    return top.groupBy(key.alias("key")).agg(F.count("*").alias("spellings"), F.min("top").alias("_a"), F.max("top").alias("_b")).where(
        (F.col("spellings") > 1) & F.col("_a").eqNullSafe(F.col("_b"))).select("key", "spellings")


def shared(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owners, first, last): values of `key` that more than one `owner` carries."""
    once = rows.select(key, owner).distinct()
    return once.groupBy(key).agg(F.count("*").alias("owners"), F.min(owner).alias("first"), F.max(owner).alias("last")).where("owners > 1")


def product_codes(files: list[DataFrame], stop: list[str] | None = None) -> DataFrame:
    """(key, spellings): product codes across files of one scheme (code), junk and charges left out."""
    rows = files[0].select("code")
    for f in files[1:]:
        rows = rows.unionByName(f.select("code"))
    good = rows.distinct().where(~codes.is_junk(F.col("code")) & ~F.col("code").isin(codes.NOT_PRODUCTS if stop is None else stop))
    return good.groupBy(codes.normal_code(F.col("code")).alias("key")).agg(F.count("*").alias("spellings"))


def screen(rows: DataFrame, code: str) -> DataFrame:
    """(code, n): the distinct values that are no codes, for review."""
    return rows.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n")).where(
        codes.is_junk(F.col("code")) | F.col("code").isin(codes.NOT_PRODUCTS))


def duplicate_edges(evidence: DataFrame, accounts: DataFrame) -> DataFrame:
    """(newer, older, confidence, rule): each account tied to the oldest that shares its evidence.

    `evidence` is (account, key, rule, confidence), one row per value an account ever used, and
    `accounts` is (account, first_seen). A key's accounts form a star on the oldest; pairs of a
    group are never listed, and a hot key costs one minimum.
    """
    seen = evidence.select("account", "key", "rule", "confidence").distinct().join(accounts, "account")
    oldest = seen.groupBy("rule", "key").agg(F.min_by("account", F.struct("first_seen", "account")).alias("older"))
    stars = seen.join(oldest, ["rule", "key"]).where("account <> older")
    return stars.groupBy(F.col("account").alias("newer"), "older").agg(
        F.max("confidence").alias("confidence"), F.max_by("rule", F.struct("confidence", "rule")).alias("rule"))


def same_as(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """(e, root, confidence): every duplicate and the oldest account of its cluster.

    The confidence is the best direct evidence for that root, else the weakest link of the account.
    """
    clusters = graph.components(edges.select(F.col("newer").alias("src"), F.col("older").alias("dst")))
    oldest = clusters.join(accounts.withColumnRenamed("account", "e"), "e").groupBy(F.col("root").alias("label")).agg(
        F.min_by("e", F.struct("first_seen", "e")).alias("root"))
    labelled = clusters.withColumnRenamed("root", "label").join(oldest, "label").where("e <> root").select("e", "root")
    per = edges.withColumnRenamed("newer", "e").join(labelled, "e").groupBy("e", "root").agg(
        F.max(F.when(F.col("older") == F.col("root"), F.col("confidence"))).alias("direct"), F.min("confidence").alias("weakest"))
    return labelled.join(per, ["e", "root"], "left").select("e", "root", F.coalesce("direct", "weakest").alias("confidence"))


def rule_audit(edges: DataFrame, per_rule: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rule, pairs), and a repeatable sample of pairs per rule ordered by hash."""
    from pyspark.sql import Window as W

    counts = edges.groupBy("rule").agg(F.count("*").alias("pairs"))
    spec = W.partitionBy("rule").orderBy(F.xxhash64("newer", "older"), "newer", "older")
    # a top-k per group: Spark limits each task's groups before the shuffle
    return counts, edges.withColumn("n", F.row_number().over(spec)).where(F.col("n") <= per_rule)


def survivors(rows: DataFrame, roots: DataFrame, column: str = "e") -> DataFrame:
    """`rows` with an entity column replaced by the surviving entity."""
    to = roots.select(F.col("e").alias("_from"), "root")
    return rows.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("root", column)).drop("_from", "root")


def person_key(rows: DataFrame, by_attribute: DataFrame, by_record: DataFrame, roots: DataFrame) -> DataFrame:
    """(e, person): the key that groups a record with its person: its own attribute, the one of the
    record it points at, or its same-as root. The two maps are (e, v)."""
    out = rows.select("e").distinct()
    out = out.join(by_attribute.select("e", F.col("v").alias("_own")), "e", "left")
    out = out.join(by_record.select("e", F.col("v").alias("_via")), "e", "left")
    out = out.join(roots.select("e", F.col("root").cast("string").alias("_root")), "e", "left")
    return out.select("e", F.coalesce("_own", "_via", "_root", F.col("e").cast("string")).alias("person"))


def copies(documents: DataFrame, key: list[Column], path: str) -> DataFrame:
    """(hash, path, copies): one document per content, under its smallest path."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), 256)
    return documents.groupBy(digest.alias("hash")).agg(F.min(path).alias("path"), F.count("*").alias("copies"))


def organisation_key(name: Column) -> Column:
    """Words of an organisation's name, lower case, without its legal form."""
    # fixed values: legal forms
    forms = ["inc", "llc", "ltd", "co", "corp", "company", "limited", "incorporated", "corporation", "plc", "gmbh", "lp", "llp"]
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(forms))
    return F.array_join(words, " ")


def organisation_variants(names: DataFrame) -> DataFrame:
    """(name, variant): each name tied to the one that stands for a leading run of its words.

    The smallest spelling of a run of words stands for it, so spellings form stars and are never
    paired with each other. A name's blocks are its own leading runs of whole words.
    """
    keyed = names.select("name").distinct().withColumn("key", organisation_key(F.col("name"))).where("key <> ''")
    stands = keyed.groupBy("key").agg(F.min("name").alias("name"))
    words = F.split("key", " ")
    runs = keyed.select(F.col("name").alias("variant"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("key"))
    return stands.join(runs, "key").where("name <> variant").select("name", "variant")
