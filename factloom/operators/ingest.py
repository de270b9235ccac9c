"""Writing facts: canonical logs, validation, lookups, diffs, identity checks, stamping, excision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.model import (COMMIT_ONLY, FACT_SCHEMA, IDENT_PATTERN, KERNEL, MAX_KEY_LENGTH, REGISTRATION_ONLY,
                            SCHEMA_FACTS, SPARK_TYPE, VALUE_COLUMN, VALUES)
from factloom.operators import fold
from factloom.operators.ordered import Running, numbered, previous, running
from factloom.session import cut, is_empty, written

COLUMNS = FACT_SCHEMA.fieldNames()
V_STRUCT = "struct<" + ",".join(f"{c}:{SPARK_TYPE[t].simpleString()}" for t, c in VALUE_COLUMN.items()) + ">"


def packed() -> Column:
    """The typed value columns as one struct, compared null-safely."""
    return F.struct(*VALUES)


# --- canonical logs -------------------------------------------------------------------------


def canonical_one(feed: DataFrame, *, rows_per_range: int | None = None) -> DataFrame:
    """Effective facts of a raw feed of cardinality-one attributes.

    Within a transaction retracts come before asserts. Each assert of (e, a) opens an island that
    lasts to the next assert. It is effective unless the island before holds the same value and was
    not closed; then the old value is retracted in the same transaction, unless it had been. A
    retract is effective if it is the first in its island that names the island's value.
    """
    rows = feed.withColumn("_v", packed())
    marked = running(rows, ["e", "a"], ["tx", "op"], {
        "_island": Running("sum", F.col("op").cast("long")),
        "_held": Running("last", F.when(F.col("op"), F.struct("_v")))}, rows_per_range=rows_per_range)
    islands = marked.where(F.col("_island") > 0).groupBy("e", "a", "_island", F.col("_held._v").alias("_value")).agg(
        F.min(F.when(F.col("op"), F.col("tx"))).alias("_opened"),
        F.min(F.when(~F.col("op") & F.col("_v").eqNullSafe(F.col("_held._v")), F.col("tx"))).alias("_closed"))
    linked = running(islands, ["e", "a"], ["_island"], {"_last": previous("_value", "_closed")},
                     rows_per_range=rows_per_range)
    open_before = F.col("_last").isNotNull() & F.col("_last._closed").isNull()
    same = open_before & F.col("_last._value").eqNullSafe(F.col("_value"))

    def fact(value: Column, tx: Column, op: bool) -> Column:
        return F.struct(value.alias("v"), tx.alias("tx"), F.lit(op).alias("op"))

    out = linked.select("e", "a", F.inline(F.filter(F.array(
        F.when(~same, fact(F.col("_value"), F.col("_opened"), True)),
        F.when(open_before & ~same, fact(F.col("_last._value"), F.col("_opened"), False)),
        F.when(F.col("_closed").isNotNull(), fact(F.col("_value"), F.col("_closed"), False))),
        lambda f: f.isNotNull())))
    return out.select("e", "a", "v.*", "tx", "op").select(*COLUMNS)


def canonical_many(feed: DataFrame, *, rows_per_range: int | None = None) -> DataFrame:
    """Effective facts of a raw feed of cardinality-many attributes: those that change (e, a, value)."""
    rows = running(feed, ["e", "a", *VALUES], ["tx", "op"], {"_last": previous("op")}, rows_per_range=rows_per_range)
    held = F.coalesce(F.col("_last.op"), F.lit(False))
    return rows.where(F.col("op") != held).select(*COLUMNS)


# --- validation -----------------------------------------------------------------------------

#: Stands for the transaction being written until `stamp` puts its number in; ids of entities are positive.
OWN_TX = -1
OWN_TX_NAME = "tmp:tx"


def entity_text(name: Column) -> Column:
    """Whether text addresses an entity: a positive id, `tmp:name`, or a lookup `ident=value`."""
    return name.rlike(r"^0*[1-9]\d{0,17}$") | name.rlike("^tmp:.") | name.rlike(IDENT_PATTERN[:-1] + "=")


def validate(proposed: DataFrame, attrs: DataFrame) -> DataFrame:
    """Errors (idx, code, message) of proposed facts (idx, e, a, v, op), all as text.

    Every problem is reported, not only the first. `attrs` is the registry; Spark broadcasts it
    while it is under the broadcast threshold.
    """
    r = attrs.select(F.col("ident").alias("a"), F.col("type"), F.col("replaced_by"))
    rows = proposed.join(r, "a", "left")
    known = F.col("type").isNotNull()
    fits = F.lit(None).cast("boolean")
    for t in SPARK_TYPE:
        fits = F.when(F.col("type") == t, entity_text(F.col("v")) if t == "ref" else V.coerce(t, F.col("v")).isNotNull()).otherwise(fits)
    asserting = F.coalesce(F.col("op"), F.lit("assert")) == "assert"

    def problem(code: str, when: Column, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))

    checks = F.array(
        problem("missing", F.col("e").isNull() | F.col("a").isNull() | F.col("v").isNull(),
                F.lit("a fact names e, a and v")),
        problem("entity", F.col("e").isNotNull() & ~entity_text(F.col("e")), F.concat(F.col("e"), F.lit(" addresses no entity"))),
        problem("op", ~F.coalesce(F.col("op"), F.lit("assert")).isin("assert", "retract"),
                F.concat(F.lit("op is assert or retract, not "), F.col("op"))),
        problem("ident", ~known & F.col("a").isNotNull() & ~F.col("a").rlike(IDENT_PATTERN),
                F.concat(F.col("a"), F.lit(" is no attribute name"))),
        problem("unknown", ~known & F.col("a").rlike(IDENT_PATTERN),
                F.concat(F.lit("unknown attribute "), F.col("a"))),
        problem("kernel", F.col("a").isin(*COMMIT_ONLY), F.concat(F.col("a"), F.lit(" is written on commit only"))),
        problem("registration", F.col("a").isin(*REGISTRATION_ONLY),
                F.concat(F.col("a"), F.lit(" is set on registration and never changes"))),
        problem("schema", F.col("a").isin(*[a for a in SCHEMA_FACTS if a != "fs/replaced_by"]) & ~asserting,
                F.concat(F.col("a"), F.lit(" cannot be retracted"))),
        problem("deprecated", known & F.col("replaced_by").isNotNull() & asserting,
                F.concat(F.col("a"), F.lit(" is deprecated"))),
        problem("value", known & F.col("v").isNotNull() & ~F.coalesce(fits, F.lit(False)),
                F.concat(F.col("v"), F.lit(" is not a "), F.col("type"))))
    return rows.select("idx", F.inline(F.filter(checks, lambda c: c.isNotNull())))


# --- identity -------------------------------------------------------------------------------


def key_column() -> Column:
    """Canonical key of the value of a fact: the same text for equal values."""
    return V.any_text()


def identity_index(state: DataFrame, attrs: DataFrame) -> DataFrame:
    """(a, key, e) of current identity values."""
    # a table of known size is broadcast where it is small, so the state stays where it is
    ids = written(attrs.where(F.col("uniq") == "identity").select(F.col("id").alias("a")))
    return state.join(ids, "a", "left_semi").select("a", key_column().alias("key"), "e")


def resolve_lookups(lookups: DataFrame, index: DataFrame) -> DataFrame:
    """(a, key, asserted, e, outcome) per distinct lookup: found, create, or missing.

    `lookups` is (a, key, asserted). One that only retractions use never creates an entity, nor
    does one on a kernel attribute.
    """
    wanted = lookups.groupBy("a", "key").agg(F.bool_or("asserted").alias("asserted"))
    return wanted.join(index, ["a", "key"], "left").select(
        "a", "key", "asserted", "e",
        F.when(F.col("e").isNotNull(), "found").when(F.col("asserted") & (F.col("a") > max(KERNEL.values())), "create")
        .otherwise("missing").alias("outcome"))


def allocate(new: DataFrame, keys: list[str], first: int) -> DataFrame:
    """`new` distinct keys with entity ids from `first`, dense in key order."""
    return numbered(new.select(*keys).distinct(), keys, "e", first)


# --- diff -----------------------------------------------------------------------------------


def batch_conflicts(proposed: DataFrame, attrs: DataFrame) -> DataFrame:
    """(e, a, code): values both asserted and retracted, and several values for a `one` attribute.

    `proposed` is facts without tx. Distinct values are folded before entities, so a hot entity
    sends partial counts.
    """
    values = proposed.groupBy("e", "a", *VALUES).agg(F.bool_or("op").alias("up"), F.bool_or(~F.col("op")).alias("down"))
    both = values.where("up and down").select("e", "a", F.lit("both").alias("code")).distinct()
    one = attrs.where(F.col("cardinality") == "one").select(F.col("id").alias("a"))
    several = values.where("up").groupBy("e", "a").agg(F.count("*").alias("n")).where("n > 1").join(
        one, "a", "left_semi").select("e", "a", F.lit("several").alias("code"))
    return both.unionByName(several)


def diff(proposed: DataFrame, state: DataFrame, attrs: DataFrame, *, folded: bool = False) -> DataFrame:
    """Changes (fact columns without tx, plus `implied`) a batch makes to current state.

    Asserts of held values and retracts of absent ones drop out. A new value of a `one` attribute
    retracts the held one, marked implied. Batch and state, of the attributes the batch names, meet
    on (e, a, value) in one shuffle; the implied retractions join the few effective asserts back to
    what met on (e, a). With `folded`, the state is a fold of this plan, which has dealt it by these
    keys: the batch is dealt alike, and the state does not move again.
    """
    # the attributes a batch names are no more than the registry has
    named = [r.a for r in proposed.select("a").distinct().collect()]
    asked = proposed.select("e", "a", *VALUES, F.col("op").alias("_asked"), F.lit(None).cast("boolean").alias("_held"))
    held = state.where(F.col("a").isin(named)).select("e", "a", *VALUES, F.lit(None).cast("boolean").alias("_asked"), F.lit(True).alias("_held"))
    if folded:
        asked = asked.repartition("e", "a", *VALUES)
    met = asked.unionByName(held).groupBy("e", "a", *VALUES).agg(F.max("_asked").alias("_asked"), F.max("_held").alias("_held"))
    # what is asked for and held already is nobody's change
    met = cut(met.where(~(F.coalesce("_asked", F.lit(False)) & F.coalesce("_held", F.lit(False)))))
    held_now = F.coalesce(F.col("_held"), F.lit(False))
    direct = met.where(F.col("_asked").isNotNull() & (F.col("_asked") != held_now)).select(
        "e", "a", *VALUES, F.col("_asked").alias("op"))
    one = attrs.where((F.col("cardinality") == "one") & F.col("id").isin(named)).select(F.col("id").alias("a"))
    replaced = direct.where("op").join(one, "a", "left_semi").select("e", "a", F.lit(True).alias("_replaced")).distinct()
    old = met.where(held_now & F.col("_asked").isNull()).join(replaced, ["e", "a"], "left_semi").select(
        "e", "a", *VALUES, F.lit(False).alias("op"))
    return direct.withColumn("implied", F.lit(False)).unionByName(old.withColumn("implied", F.lit(True)))


#: An attribute's entities are compared in so many pieces; a task sends a row for each at most.
PIECES = 1024


def _piece() -> Column:
    return F.pmod(F.xxhash64("e"), F.lit(PIECES)).alias("piece")


def _marks() -> list[Column]:
    """128 bits of a fact's (e, a, value) in four numbers that can be added up. Which columns hold a value counts, since hashes pass over NULL."""
    held = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(VALUES)), F.lit(0))
    return [half for seed in (0, 1) for h in [F.xxhash64(F.lit(seed), "e", "a", held, *VALUES)] for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def differing(proposed: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, piece): the pieces of an attribute's entities in which a batch may change what a log holds.

    Elsewhere neither retracts anything, and the facts of both, less `tx`, are the same bag: the sums of
    their marks are. No fact is moved to tell that. Pieces the batch says nothing about are none.
    """
    sides = [df.select("a", _piece(), "op", F.lit(asked).alias("asked"), *(m.alias(f"m{i}") for i, m in enumerate(_marks()))) for df, asked in ((proposed, True), (facts, False))]
    # a sum too large for a long is NULL, and its piece differs
    sums = sides[0].unionByName(sides[1]).groupBy("a", "piece").agg(
        F.bool_or("asked").alias("asked"), F.bool_or(~F.coalesce("op", F.lit(False))).alias("retracts"),
        *(F.try_sum(F.when(F.col("asked"), F.col(f"m{i}")).otherwise(-F.col(f"m{i}"))).alias(f"m{i}") for i in range(4)))
    same = F.lit(True)
    for i in range(4):
        same = same & F.coalesce(F.col(f"m{i}") == 0, F.lit(False))
    return sums.where(F.col("asked") & (F.col("retracts") | ~same)).select("a", "piece")


def diff_log(proposed: DataFrame, facts: DataFrame, attrs: DataFrame) -> DataFrame:
    """`diff` against the fold of a log: only pieces that differ are folded and dealt by value.

    Values of other attributes or entities never decide a fact's, so the changes are those of the whole.
    """
    # a row a piece: its size is known, so that facts stay where they are when they meet it
    pieces = written(differing(proposed, facts))
    if is_empty(pieces):
        asked, held = (df.where(F.lit(False)) for df in (proposed, facts))
    else:
        asked, held = (df.withColumn("piece", _piece()).join(pieces, ["a", "piece"], "left_semi").drop("piece") for df in (proposed, facts))
    return diff(asked, fold.state(held), attrs, folded=True)


def unchanged(proposed: DataFrame, changes: DataFrame) -> DataFrame:
    """Proposed rows (with idx) that change nothing: no effective change has their (e, a, value, op)."""
    on = F.col("p.e").eqNullSafe(F.col("c.e")) & (F.col("p.a") == F.col("c.a")) & (F.col("p.op") == F.col("c.op"))
    for c in VALUES:
        on = on & F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}"))
    return proposed.alias("p").join(changes.alias("c"), on, "left_anti")


def identity_conflicts(changes: DataFrame, index: DataFrame, attrs: DataFrame) -> DataFrame:
    """(a, key, e, code) of identity claims that cannot stand: held elsewhere, claimed twice, too long.

    A key its holder gives up in the same batch is free.
    """
    ids = attrs.where(F.col("uniq") == "identity").select(F.col("id").alias("a"))
    keyed = changes.join(ids, "a", "left_semi").select("a", key_column().alias("key"), "e", "op")
    claims = keyed.where("op").select("a", "key", "e").distinct()
    freed = keyed.where("not op").select("a", "key").distinct()
    taken = claims.join(index.select("a", "key", F.col("e").alias("holder")), ["a", "key"]).where(
        F.col("holder") != F.col("e")).join(freed, ["a", "key"], "left_anti").select(
        "a", "key", "e", F.lit("held").alias("code"))
    double = claims.groupBy("a", "key").agg(F.count("*").alias("n"), F.min("e").alias("e")).where("n > 1").select(
        "a", "key", "e", F.lit("claimed twice").alias("code"))
    long = claims.where(F.length("key") > MAX_KEY_LENGTH).select("a", "key", "e", F.lit("too long").alias("code"))
    return taken.unionByName(double).unionByName(long)


def missing_entities(named: DataFrame, facts: DataFrame) -> DataFrame:
    """Entity ids (e) a batch names that no fact is about.

    The names are written first: their size is known, and the log is only probed for them.
    """
    asked = written(named.select("e").distinct())
    return asked.join(facts.select("e").join(asked, "e", "left_semi").distinct(), "e", "left_anti")


def dangling_temporaries(as_value: DataFrame, as_entity: DataFrame) -> DataFrame:
    """Temporary names (name) used as a value that no fact of the batch describes."""
    return as_value.select("name").distinct().join(as_entity.select("name").distinct(), "name", "left_anti")


def identity_candidate(state: DataFrame, attribute: int, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Whether an attribute could become an identity: keys on several entities with how many hold
    them, and a sample of the smallest keys with each key's two smallest entities."""
    keyed = state.where(F.col("a") == attribute).select(key_column().alias("key"), "e").distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("entities"), F.min("e").alias("first"),
                                      F.max("e").alias("last")).where("entities > 1")
    return shared, shared.orderBy("key").limit(limit)


# --- stamping and removal -------------------------------------------------------------------


def stamp(changes: DataFrame, tx: int, actor: int, at: Column) -> DataFrame:
    """The facts of one committed transaction: its changes, with its number where they name it, and who and when."""
    spark = changes.sparkSession
    null = {c: F.lit(None).cast(SPARK_TYPE[t]) for t, c in VALUE_COLUMN.items()}
    row = spark.range(1)

    def fact(attribute: str, column: str, value: Column) -> DataFrame:
        return row.select(F.lit(tx).cast("long").alias("e"), F.lit(KERNEL[attribute]).cast("long").alias("a"),
                          *[(value if c == column else null[c]).alias(c) for c in VALUES],
                          F.lit(tx).cast("long").alias("tx"), F.lit(True).alias("op"))
    own = {c: F.when(F.col(c) == OWN_TX, F.lit(tx).cast("long")).otherwise(F.col(c)) for c in ("e", "v_ref")}
    return (changes.withColumns(own).withColumn("tx", F.lit(tx).cast("long")).select(*COLUMNS)
            .unionByName(fact("fs/actor", "v_ref", F.lit(actor).cast("long")))
            .unionByName(fact("fs/at", "v_instant", at)))


def next_instant(last: Column, now: Column) -> Column:
    """A commit time after every earlier one."""
    return F.greatest(now, F.timestamp_micros(F.unix_micros(last) + 1))


def apply_changes(state: DataFrame, changes: DataFrame, tx: Column) -> DataFrame:
    """Current state after a batch: retracted values gone, asserted ones in.

    One aggregate over (e, a, value): a value stays if its last word is not a retract, and keeps
    its older transaction if it was already held.
    """
    held = state.select("e", "a", *VALUES, "tx", F.lit(0).alias("_when"), F.lit(True).alias("op"))
    new = changes.select("e", "a", *VALUES, tx.alias("tx"), F.lit(1).alias("_when"), "op")
    met = held.unionByName(new).groupBy("e", "a", *VALUES).agg(
        F.max(F.col("_when") * 2 + F.col("op").cast("int")).alias("_k"),
        F.min(F.when(F.col("op"), F.col("tx"))).alias("tx"))
    return met.where(F.col("_k") % 2 == 1).select("e", "a", *VALUES, "tx")


def without(facts: DataFrame, erased: DataFrame) -> DataFrame:
    """Facts less those of `erased` (e, a); a NULL attribute erases the entity whole."""
    whole = erased.where(F.col("a").isNull()).select("e").distinct()
    some = erased.where(F.col("a").isNotNull()).select("e", "a").distinct()
    return facts.join(whole, "e", "left_anti").join(some, ["e", "a"], "left_anti").select(*COLUMNS)


def excisions(erased: DataFrame, tx: int) -> DataFrame:
    """(e, a, tx) of `erased` (e, a): each entity with its own transaction, dense from `tx` in entity order.

    An entity that is also erased whole has only that one row.
    """
    numbers = numbered(erased.select("e").distinct(), ["e"], "tx", tx)
    whole = erased.where("a is null").select("e").distinct()
    rows = erased.where("a is not null").select("e", "a").distinct().join(whole, "e", "left_anti").unionByName(
        whole.select("e", F.lit(None).cast("long").alias("a")))
    return rows.join(numbers, "e").select("e", "a", "tx")


def excision_facts(wanted: DataFrame, stamps: DataFrame) -> DataFrame:
    """Facts that record `wanted` (e, a, tx): the entity, the attributes where not all, and `stamps` (id, actor, at)."""
    null = {c: F.lit(None).cast(SPARK_TYPE[t]) for t, c in VALUE_COLUMN.items()}

    def rows(df: DataFrame, attribute: str, column: str, value: Column, tx: str = "tx") -> DataFrame:
        return df.select(F.col(tx).alias("e"), F.lit(KERNEL[attribute]).cast("long").alias("a"),
                         *[(value if c == column else null[c]).alias(c) for c in VALUES],
                         F.col(tx).alias("tx"), F.lit(True).alias("op"))
    return (rows(wanted.select("e", "tx").distinct(), "fs/excised_entity", "v_ref", F.col("e"))
            .unionByName(rows(wanted.where("a is not null"), "fs/excised_attribute", "v_ref", F.col("a")))
            .unionByName(rows(stamps, "fs/actor", "v_ref", F.col("actor"), "id"))
            .unionByName(rows(stamps, "fs/at", "v_instant", F.col("at"), "id")))


#: The kernel attribute of each field of a registry entry that may change.
FIELDS = {"cardinality": KERNEL["fs/cardinality"], "unique": KERNEL["fs/unique"], "doc": KERNEL["fs/doc"]}
REPLACED_BY = KERNEL["fs/replaced_by"]


def evolution_codes(requests: DataFrame, attrs: DataFrame, state: DataFrame) -> DataFrame:
    """`requests` (ident, field, value, …) with `code`: why the change is not allowed, or NULL.

    Cardinality goes one to many only; uniqueness none to identity only, and only if no key is on
    two entities. What holds already is allowed. Another field than cardinality, unique or doc is not.
    """
    known = attrs.select("ident", F.col("id").alias("_id"), F.col("type").alias("_type"), F.col("cardinality").alias("_cardinality"), F.col("uniq").alias("_unique"), F.col("doc").alias("_doc"))
    r = requests.join(known, "ident", "left")
    keys = state.join(r.where("field = 'unique' and value = 'identity'").select(F.col("_id").alias("a")).distinct(), "a",
                      "left_semi").select("a", key_column().alias("key"), "e").distinct()
    shared = keys.groupBy("a", "key").agg(F.count("*").alias("n")).groupBy("a").agg(
        F.bool_or(F.col("n") > 1).alias("_shared"), F.bool_or(F.length("key") > MAX_KEY_LENGTH).alias("_long"))
    r = r.join(shared.withColumnRenamed("a", "_id"), "_id", "left")
    held = F.when(F.col("field") == "cardinality", F.col("_cardinality")).when(F.col("field") == "unique", F.col("_unique")).when(F.col("field") == "doc", F.col("_doc"))
    code = (F.when(F.col("_id").isNull(), "unknown")
            .when(F.col("ident").startswith("fs/"), "kernel")
            .when(~F.coalesce(F.col("field").isin(*FIELDS), F.lit(False)), "field")
            .when(F.col("value").isNull(), "value")
            .when(F.col("value") == held, None)
            .when((F.col("field") == "cardinality") & (F.col("value") != "many"), "one to many only")
            .when((F.col("field") == "unique") & (F.col("value") != "identity"), "none to identity only")
            .when((F.col("field") == "unique") & (F.col("_type") == "boolean"), "boolean identity")
            .when((F.col("field") == "unique") & F.col("_shared"), "shared keys")
            .when((F.col("field") == "unique") & F.col("_long"), "long keys")
            .when((F.col("field") == "doc") & ((F.trim("value") == "") | F.col("value").contains("\n")), "doc"))
    return r.select(*requests.columns, code.alias("code"))


def evolution_errors(requests: DataFrame, attrs: DataFrame, state: DataFrame) -> DataFrame:
    """(ident, code) of schema changes `requests` (ident, field, value) that are not allowed."""
    return evolution_codes(requests, attrs, state).where(F.col("code").isNotNull()).select("ident", "code")


def schema_errors(changes: DataFrame, attrs: DataFrame, state: DataFrame) -> DataFrame:
    """(e, a, code) of changes to attributes that break the rules of evolution and of replacement."""
    from factloom.operators.vocabulary import replacement_errors

    names = attrs.select(F.col("id").alias("e"), "ident")
    asserted = changes.where(F.col("op") & F.col("a").isin(REPLACED_BY, *FIELDS.values())).join(names, "e", "left").withColumn("ident", F.coalesce("ident", F.lit("")))
    field = None
    for name, a in FIELDS.items():
        field = F.when(F.col("a") == a, name) if field is None else field.when(F.col("a") == a, name)
    requests = asserted.where(F.col("a") != REPLACED_BY).select("e", "a", "ident", field.alias("field"), F.col("v_string").alias("value"))
    evolved = evolution_codes(requests, attrs, state).where(F.col("code").isNotNull()).select("e", "a", "code")
    moved = asserted.where(F.col("a") == REPLACED_BY).join(attrs.select(F.col("id").alias("v_ref"), F.col("ident").alias("other")), "v_ref", "left").select(
        "e", "a", "ident", F.coalesce("other", F.lit("")).alias("other"))
    moved = cut(moved)
    bad = replacement_errors(moved.select("ident", "other"), attrs).distinct()
    return evolved.unionByName(moved.join(bad, "ident").select("e", "a", "code"))


def changed_registry(changes: DataFrame, attrs: DataFrame) -> DataFrame:
    """The registry's rows of the attributes that `changes` are about, as they are afterwards."""
    def new(a: int, column: str) -> Column:
        return F.max(F.when(F.col("op") & (F.col("a") == a), F.col(column)))
    moved = changes.where(F.col("a").isin(REPLACED_BY, *FIELDS.values())).groupBy(F.col("e").alias("id")).agg(
        *(new(a, "v_string").alias(f"_{name}") for name, a in FIELDS.items()), new(REPLACED_BY, "v_ref").alias("_by"), F.bool_or(F.col("a") == REPLACED_BY).alias("_moved"))
    return attrs.join(moved, "id").select(
        "id", "ident", "type", F.coalesce("_cardinality", "cardinality").alias("cardinality"), F.coalesce("_unique", "uniq").alias("uniq"),
        F.trim(F.coalesce("_doc", "doc")).alias("doc"), F.when(F.col("_moved"), F.col("_by")).otherwise(F.col("replaced_by")).alias("replaced_by"))


# --- the whole write ------------------------------------------------------------------------


@dataclass(frozen=True)
class Written:
    """What a batch would write: its facts, problems, rows that change nothing, and lookups."""

    changes: DataFrame
    errors: DataFrame
    unchanged: DataFrame
    lookups: DataFrame
    #: (idx) of proposed rows that are among the changes.
    changed: DataFrame
    #: The registry's new rows, where the batch changes attributes.
    registry: DataFrame | None = None


def plan_write(proposed: DataFrame, state: DataFrame, facts: DataFrame, attrs: DataFrame, first_entity: int) -> Written:
    """Validate, resolve and diff proposed facts without writing; the dry run.

    `proposed` is (idx, e, a, v, op) text with e and ref values given as `123` (an entity id),
    `tmp:name` (a new entity), `tmp:tx` (the transaction written), or `ident=value` (a lookup on an
    identity attribute). Every row ends as a change, as unchanged, or with an error, and every error
    names its row; `outcomes` tells which. Facts about attributes (`fs/cardinality`, `fs/unique`,
    `fs/doc`, `fs/replaced_by`) are held to the rules of evolution and replacement, and what they
    make of the registry is part of the write.
    """
    # few attributes are named by many rows: as a table of known size they are broadcast, however large the registry
    asked = written(attrs.join(proposed.select(F.col("a").alias("ident")).distinct(), "ident", "left_semi").select(*attrs.columns))
    reg = asked.select(F.col("id").alias("aid"), F.col("ident").alias("a"), "type", "cardinality", "uniq")
    rows = cut(proposed.withColumn("op", F.coalesce("op", F.lit("assert"))).join(reg, "a", "left"))
    asserted = F.col("op") == "assert"

    named = rows.select("idx", asserted.alias("asserted"), F.col("e").alias("name"), F.lit("e").alias("place")).unionByName(
        rows.where("type = 'ref'").select("idx", asserted.alias("asserted"), F.col("v").alias("name"),
                                          F.lit("v").alias("place")))
    is_lookup = F.col("name").rlike(IDENT_PATTERN[:-1] + "=")
    look = named.where(is_lookup).select(
        "idx", "asserted", "place", "name", F.split_part("name", F.lit("="), F.lit(1)).alias("ident"),
        F.expr("substring(name, instr(name, '=') + 1)").alias("text"))
    look = look.join(attrs.select(F.col("id").alias("la"), "ident", F.col("type").alias("ltype"), F.col("uniq").alias("lu")),
                     "ident", "left")
    key = F.col("text")
    for t in ("decimal", "date", "instant", "ref"):
        key = F.when(F.col("ltype") == t, V.canonical_key(t, V.coerce(t, F.col("text")))).otherwise(key)
    look = cut(look.withColumn("key", key))
    bad_lookup = look.where(F.col("la").isNull() | (F.col("lu") != "identity") | F.col("key").isNull()
                            | (F.length("key") > MAX_KEY_LENGTH)).select(
        "idx", F.lit("lookup").alias("code"), F.concat(F.col("name"), F.lit(" addresses no entity")).alias("message"))

    good = look.where((F.col("lu") == "identity") & F.col("key").isNotNull())
    index = cut(identity_index(state, attrs))
    resolved = cut(resolve_lookups(good.select(F.col("la").alias("a"), "key", "asserted"), index))
    temporary = named.where(F.col("name").startswith("tmp:") & (F.col("name") != "tmp:tx"))
    new = resolved.where("outcome = 'create'").select(F.lit(0).alias("kind"), F.col("a"), F.col("key")).unionByName(
        temporary.select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("a"), F.col("name").alias("key")).distinct())
    ids = allocate(new, ["kind", "a", "key"], first_entity)
    created = ids.where("kind = 0").select("a", "key", F.col("e").alias("made"))
    lookups = resolved.join(created, ["a", "key"], "left").select(
        "a", "key", F.coalesce("e", "made").alias("e"), F.col("made").isNotNull().alias("created"), "outcome")

    targets = good.select("name", F.col("la").alias("a"), "key").distinct().join(lookups, ["a", "key"]).select("name", "e")
    targets = cut(targets.unionByName(ids.where("kind = 1").select(F.col("key").alias("name"), "e")))

    def place(df: DataFrame, column: str, out: str) -> DataFrame:
        # only names that have to be found meet the targets: numbers and NULLs would all meet in one task
        name = F.col(column)
        asks = F.coalesce((name.startswith("tmp:") & (name != OWN_TX_NAME)) | name.rlike(IDENT_PATTERN[:-1] + "="), F.lit(False))
        number = F.when(name == OWN_TX_NAME, OWN_TX).when(name.rlike(r"^\d+$"), V.coerce("ref", name))
        found = df.where(asks).join(targets.select(F.col("name").alias(column), F.col("e").cast("long").alias(out)), column, "left")
        return df.where(~asks).withColumn(out, number.cast("long")).unionByName(found)

    placed = place(rows.withColumn("_e", F.col("e")).withColumn("_v", F.when(F.col("type") == "ref", F.col("v"))), "_e", "eid")
    placed = place(placed, "_v", "vid")
    typed = [F.when(F.col("type") == t, F.col("vid") if t == "ref" else V.coerce(t, F.col("v"))).alias(c)
             for t, c in VALUE_COLUMN.items()]
    ops = placed.where(F.col("aid").isNotNull()).select("idx", F.col("eid").alias("e"), F.col("aid").alias("a"), *typed,
                                                        asserted.alias("op"))
    # a created entity carries the value it was looked up by
    made = lookups.where("created").join(attrs.select(F.col("id").alias("a"), "type"), "a").select(
        F.lit(None).cast("long").alias("idx"), "e", "a",
        *[F.when(F.col("type") == t, V.coerce(t, F.col("key"))).alias(c) for t, c in VALUE_COLUMN.items()],
        F.lit(True).alias("op"))
    # the batch and its changes are each computed once; every check below reads them
    # (the test of what was read comes after the write: before it, each text would be read again for the test)
    batch = written(ops.unionByName(made)).where(F.col("e").isNotNull() & V.one_value())
    changes = written(diff(batch, state, attrs))
    told = batch.where("idx IS NOT NULL")

    def wrong(df: DataFrame, code: Column, message: Column) -> DataFrame:
        return df.select("idx", code.alias("code"), message.alias("message"))

    errors = [validate(rows.select("idx", "e", "a", "v", "op"), asked), bad_lookup]
    used = good.select("idx", F.col("la").alias("a"), "key")
    errors.append(wrong(used.join(lookups.where("outcome = 'missing'").select("a", "key"), ["a", "key"]).distinct(), F.lit("missing entity"),
                        F.concat(F.lit("no entity has the value "), F.col("key"))))
    numbers = named.where(F.col("name").rlike(r"^0*[1-9]\d{0,17}$")).select("idx", F.col("name").cast("long").alias("e")).distinct()
    # an attribute is an entity, also where the log tells nothing of it
    unheard = missing_entities(numbers, facts).join(attrs.select(F.col("id").alias("e")), "e", "left_anti")
    errors.append(wrong(numbers.join(unheard, "e"), F.lit("no such entity"), F.col("e").cast("string")))
    as_value = temporary.where("place = 'v'").select("idx", "name")
    errors.append(wrong(as_value.join(dangling_temporaries(as_value, temporary.where("place = 'e'")), "name"), F.lit("dangling"), F.col("name")))
    clashing = told.select("idx", "e", "a", "op").join(batch_conflicts(batch, attrs), ["e", "a"]).where((F.col("code") == "both") | F.col("op"))
    errors.append(wrong(clashing.distinct(), F.col("code"), F.concat_ws(" ", "e", "a")))
    # who claims a key: rows that assert it, and rows whose lookup makes an entity of it
    claims = told.where("op").select("idx", "a", key_column().alias("key"), "e").unionByName(
        used.join(lookups.where("created").select("a", "key", "e"), ["a", "key"]).select("idx", "a", "key", "e"))
    taken = identity_conflicts(changes, index, attrs).withColumnRenamed("e", "_e")
    claimed = claims.join(taken, ["a", "key"]).where((F.col("code") == "claimed twice") | (F.col("e") == F.col("_e")))
    errors.append(wrong(claimed.distinct(), F.col("code"), F.concat_ws(" ", "a", "key")))
    registry = None
    if told.where(F.col("a").isin(REPLACED_BY, *FIELDS.values())).take(1):
        broken = schema_errors(changes, attrs, state)
        errors.append(wrong(told.where("op").select("idx", "e", "a").join(broken, ["e", "a"]), F.col("code"), F.concat_ws(" ", "e", "a")))
        registry = changed_registry(changes, attrs)
    found = errors[0]
    for more in errors[1:]:
        found = found.unionByName(more)
    still = unchanged(told, changes).select("idx")
    return Written(changes, found, still, lookups, told.select("idx").join(still, "idx", "left_anti"), registry)


def outcomes(write: Written) -> DataFrame:
    """(idx, outcome) of every proposed row: the code of an error (of several, the first by name), `changed` or `unchanged`."""
    wrong = write.errors.groupBy("idx").agg(F.min("code").alias("_wrong"))
    right = write.changed.select("idx", F.lit("changed").alias("_right")).unionByName(write.unchanged.select("idx", F.lit("unchanged").alias("_right")))
    return wrong.join(right, "idx", "full").select("idx", F.coalesce("_wrong", "_right").alias("outcome"))
