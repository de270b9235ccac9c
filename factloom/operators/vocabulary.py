"""Vocabulary work: search, near duplicates, registration checks, package installs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import extent_similarity, set_similarity, trigram_list, trigrams
from factloom.model import ATTR_SCHEMA, IDENT_PATTERN, KERNEL, SPARK_TYPE
from factloom.operators.similar import containing
from factloom.session import cut

# Thresholds of the near-duplicate rules and the search floor.
NEAR_NAME = 0.6
NEAR_NAME_DOC = 0.3
NEAR_DOC = 0.6
SEARCH_FLOOR = 0.2


def search(attrs: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """(ident, type, cardinality, doc, replaced_by, score): attributes resembling a text; replaced_by is a name.

    The limit is taken first and low scores dropped after, so a search returns at most `limit`.
    """
    wanted = trigrams(F.lit(text))
    score = F.greatest(extent_similarity(wanted, trigram_list(F.col("ident"))), extent_similarity(wanted, trigram_list(F.col("doc"))))
    rows = attrs.where(~F.col("ident").startswith("fs/")).withColumn("score", score)
    names = attrs.select(F.col("id").alias("replaced_by"), F.col("ident").alias("_by"))
    top = rows.orderBy(F.desc("score"), "ident").limit(limit).join(names, "replaced_by", "left").withColumn("replaced_by", F.col("_by"))
    return top.where(F.col("score") >= SEARCH_FLOOR).select("ident", "type", "cardinality", "doc", "replaced_by", F.round("score", 3).alias("score"))


def near_matches(new: DataFrame, attrs: DataFrame, distinct_from: DataFrame | None = None) -> DataFrame:
    """(ident, other, name_score, doc_score) of new attributes (ident, doc) too like existing or other new ones.

    Near means: names alike in one namespace; names alike across namespaces with docs alike; one
    name's words inside the other's in one namespace; or docs much alike. Declared differences
    (ident, other), either way round, are left out. Candidates come from rare shared trigrams or
    words, which misses no pair the rules accept.
    """
    live = attrs.where(~F.col("ident").startswith("fs/") & F.col("replaced_by").isNull()).select("ident", "doc")
    def name(c):
        return F.regexp_replace(F.lower(F.split_part(c, F.lit("/"), F.lit(2))), "[^a-z0-9]", "")

    def words(c):
        space = F.split_part(c, F.lit("/"), F.lit(1))
        return F.array_distinct(F.transform(F.split(F.split_part(c, F.lit("/"), F.lit(2)), "_"), lambda w: F.concat(space, F.lit("/"), w)))

    def prepared(df):
        # split once per attribute, so pairs carry arrays and split nothing
        return cut(df.select("ident", "doc").distinct().select(
            "ident", trigram_list(name(F.col("ident"))).alias("grams"), trigrams(F.col("doc")).alias("doc"), words(F.col("ident")).alias("words")))

    others = prepared(live.unionByName(new.select("ident", "doc")))
    new = prepared(new)

    def side(df, items, key):
        return df.select(F.col("ident").alias(key), items.alias("items"))

    def both_ways(items, fraction):
        one = containing(side(new, items, "l"), side(others, items, "r"), fraction)
        two = containing(side(others, items, "l"), side(new, items, "r"), fraction)
        return one.unionByName(two.select(F.col("r").alias("l"), F.col("l").alias("r")))

    name_set = F.array_distinct("grams")
    pairs = both_ways(name_set, NEAR_NAME).unionByName(both_ways(F.col("words"), 1.0)).unionByName(
        containing(side(new, F.col("doc"), "l"), side(others, F.col("doc"), "r"), NEAR_DOC))
    pairs = pairs.where("l <> r").distinct()

    def named(df, prefix):
        return df.select(F.col("ident").alias(prefix), *[F.col(c).alias(f"{prefix}_{c}") for c in ("grams", "doc", "words")])
    met = pairs.join(named(new, "l"), "l").join(named(others, "r"), "r")
    scored = met.select(
        F.col("l").alias("ident"), F.col("r").alias("other"),
        F.greatest(extent_similarity(F.array_distinct("l_grams"), F.col("r_grams")),
                   extent_similarity(F.array_distinct("r_grams"), F.col("l_grams"))).alias("name_score"),
        set_similarity(F.col("l_doc"), F.col("r_doc")).alias("doc_score"),
        (F.split_part("l", F.lit("/"), F.lit(1)) == F.split_part("r", F.lit("/"), F.lit(1))).alias("_same"),
        ((F.size(F.array_except("l_words", "r_words")) == 0) | (F.size(F.array_except("r_words", "l_words")) == 0)).alias("_nested"))
    near = scored.where(((F.col("name_score") >= NEAR_NAME) & (F.col("_same") | (F.col("doc_score") >= NEAR_NAME_DOC)))
                        | (F.col("_same") & F.col("_nested")) | (F.col("doc_score") >= NEAR_DOC))
    out = near.select("ident", "other", F.round("name_score", 3).alias("name_score"), F.round("doc_score", 3).alias("doc_score"))
    if distinct_from is None:
        return out
    declared = distinct_from.select("ident", "other")
    declared = declared.unionByName(declared.select(F.col("other").alias("ident"), F.col("ident").alias("other"))).distinct()
    return out.join(declared, ["ident", "other"], "left_anti")


def registration_errors(specs: DataFrame, attrs: DataFrame) -> DataFrame:
    """(idx, code) of specs (idx, ident, type, cardinality, unique, doc, distinct_from array) that cannot be registered."""
    known = attrs.select("ident", F.col("type").alias("_t"), F.col("cardinality").alias("_c"), F.col("uniq").alias("_u"))
    repeated = specs.groupBy("ident").agg(F.min("idx").alias("_first"))
    rows = specs.withColumn("unique", F.coalesce("unique", F.lit("none"))).join(known, "ident", "left").join(repeated, "ident", "left")

    def problem(code, when):
        return F.when(F.coalesce(when, F.lit(True)), F.lit(code))
    checks = F.array(
        problem("ident", ~F.col("ident").rlike(IDENT_PATTERN)),
        problem("reserved", F.col("ident").startswith("fs/")),
        problem("type", ~F.col("type").isin(list(SPARK_TYPE))),
        problem("cardinality", ~F.col("cardinality").isin("one", "many")),
        problem("unique", ~F.col("unique").isin("none", "identity")),
        problem("boolean identity", (F.col("unique") == "identity") & (F.col("type") == "boolean")),
        problem("doc", (F.trim("doc") == "") | F.col("doc").contains("\n")),
        problem("twice", F.col("idx") != F.col("_first")),
        F.when(F.col("_t").isNotNull() & ~((F.col("_t") == F.col("type")) & (F.col("_c") == F.col("cardinality")) & (F.col("_u") == F.col("unique"))),
               F.lit("registered otherwise")))
    simple = rows.select("idx", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("code"))
    named = specs.select("idx", F.explode("distinct_from").alias("ident"))
    absent = named.join(attrs.select("ident").unionByName(specs.select("ident")), "ident", "left_anti").select("idx", F.lit("distinct_from").alias("code"))
    return simple.unionByName(absent)


def registration_facts(specs: DataFrame, ids: DataFrame, tx: int) -> DataFrame:
    """The schema facts of new attributes: `ids` is (ident, id), of the new ones and any they are distinct from."""
    from factloom.model import FACT_SCHEMA, KERNEL, VALUES

    own = specs.join(ids, "ident")
    text = own.select("id", F.inline(F.array(*[F.struct(F.lit(KERNEL[a]).cast("long").alias("a"), v.alias("v_string")) for a, v in (
        ("fs/ident", F.col("ident")), ("fs/type", F.col("type")), ("fs/cardinality", F.col("cardinality")),
        ("fs/unique", F.coalesce("unique", F.lit("none"))), ("fs/doc", F.trim("doc")))])))
    other = own.select("id", F.explode("distinct_from").alias("ident")).join(ids.select("ident", F.col("id").alias("v_ref")), "ident")
    refs = other.select("id", F.lit(KERNEL["fs/distinct_from"]).cast("long").alias("a"), "v_ref")
    rows = text.unionByName(refs, allowMissingColumns=True).select(F.col("id").alias("e"), "a", "v_string", "v_ref")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in FACT_SCHEMA.fields if f.name in VALUES and f.name not in ("v_string", "v_ref")}
    return rows.withColumns(empty).withColumn("tx", F.lit(tx).cast("long")).withColumn("op", F.lit(True)).select(*FACT_SCHEMA.fieldNames())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(ident, type, cardinality, unique, doc) of a vocabulary package's manifest file."""
    schema = "name string, version string, doc string, attributes array<struct<ident:string,type:string,cardinality:string,unique:string,doc:string,distinct_from:array<string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("name", "version", F.inline("attributes"))


def install_diff(specs: DataFrame, attrs: DataFrame) -> DataFrame:
    """(ident, action): new, existing, evolve or conflict, for each spec of a package.

    Only cardinality one to many and uniqueness none to identity may evolve.
    """
    known = attrs.select("ident", F.col("type").alias("_t"), F.col("cardinality").alias("_c"), F.col("uniq").alias("_u"))
    rows = specs.withColumn("unique", F.coalesce("unique", F.lit("none"))).join(known, "ident", "left")
    same_c, same_u = F.col("cardinality") == F.col("_c"), F.col("unique") == F.col("_u")
    c_ok = same_c | ((F.col("_c") == "one") & (F.col("cardinality") == "many"))
    u_ok = same_u | ((F.col("_u") == "none") & (F.col("unique") == "identity"))
    action = (F.when(F.col("_t").isNull(), "new").when((F.col("type") != F.col("_t")) | ~c_ok | ~u_ok, "conflict")
              .when(same_c & same_u, "existing").otherwise("evolve"))
    return rows.select("ident", action.alias("action"))


def replacement_errors(requests: DataFrame, attrs: DataFrame) -> DataFrame:
    """(ident, code) of replacements (ident, other) whose target is unknown or that would make a cycle."""
    from factloom.operators import graph

    known = attrs.select("ident", "id")
    rows = requests.join(known, "ident", "left").join(known.select(F.col("ident").alias("other"), F.col("id").alias("to")), "other", "left")
    unknown = rows.where(F.col("to").isNull() | F.col("other").startswith("fs/")).select("ident", F.lit("target").alias("code"))
    new = rows.where(F.col("to").isNotNull() & F.col("id").isNotNull()).select(F.col("id").alias("src"), F.col("to").alias("dst"))
    old = attrs.where(F.col("replaced_by").isNotNull()).select(F.col("id").alias("src"), F.col("replaced_by").alias("dst")).join(
        new.select("src"), "src", "left_anti")
    rings = graph.chain_roots(old.unionByName(new)).where("cyclic").select(F.col("e").alias("id")).unionByName(
        new.where("src = dst").select(F.col("src").alias("id"))).distinct()
    cyclic = rows.join(rings, "id", "left_semi").select("ident", F.lit("cycle").alias("code"))
    return unknown.unionByName(cyclic)


def registry_of(facts: DataFrame, tx: int | None = None) -> DataFrame:
    """The registry that the log's own schema facts tell, now or as of a transaction: each attribute that was registered in it."""
    from factloom.operators import fold

    parts = {"ident": ("fs/ident", "v_string"), "type": ("fs/type", "v_string"), "cardinality": ("fs/cardinality", "v_string"), "uniq": ("fs/unique", "v_string"),
             "doc": ("fs/doc", "v_string"), "replaced_by": ("fs/replaced_by", "v_ref")}
    held = fold.state(facts.where(F.col("a").isin([KERNEL[k] for k, _ in parts.values()])), tx)
    rows = held.groupBy(F.col("e").alias("id")).agg(*(F.max(F.when(F.col("a") == KERNEL[k], F.col(c))).alias(name) for name, (k, c) in parts.items()))
    return rows.where(F.col("ident").isNotNull()).withColumn("uniq", F.coalesce("uniq", F.lit("none"))).select(*ATTR_SCHEMA.fieldNames())


def unfilled(attrs: DataFrame, state: DataFrame) -> DataFrame:
    """(ident): registered attributes that hold no value."""
    return attrs.where(~F.col("ident").startswith("fs/")).join(state.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select("ident")


def registered_by(facts: DataFrame, tx: DataFrame, names: DataFrame) -> DataFrame:
    """(ident, actor): who registered each attribute, from the log: `names` is (e, v) of actors."""
    made = facts.where((F.col("a") == 1) & F.col("op")).select(F.col("v_string").alias("ident"), F.col("tx").alias("id"))
    return made.join(tx, "id").join(names.select(F.col("e").alias("actor"), F.col("v").alias("name")), "actor", "left").select(
        "ident", F.col("name").alias("actor"))


def installed(registered: DataFrame) -> DataFrame:
    """(actor): packages found in the log, as the actors that registered attributes of their own."""
    return registered.where(~F.col("ident").startswith("fs/")).select("actor").distinct()


def field_authority(attrs: DataFrame, authority: DataFrame) -> DataFrame:
    """(ident, system): each attribute's authoritative system, NULL where none is recorded."""
    return attrs.where(~F.col("ident").startswith("fs/")).join(
        authority.select(F.col("e").alias("id"), F.col("v").alias("system")), "id", "left").select("ident", "system")
