"""The user's entry point: a fact log with its registry and transactions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import Attribute
from factloom.operators import fold

Reader = Callable[[list[Attribute] | None], DataFrame]
#: Current values of some attributes as asserts, with the facts written since, and whether there are none of those.
Snapshot = Callable[[list[Attribute] | None], tuple[DataFrame, bool]]
#: A string literal or a comment, which stay as they are, or a relation in double quotes.
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|(\bhistory\s*\.\s*)?"([a-z][a-z0-9_]*/[a-z][a-z0-9_]*)\"""", re.I | re.S)

_KEYWORDS = "where|group|order|join|left|right|inner|full|cross|natural|semi|anti|on|using|having|limit|offset|union|intersect|except|minus|lateral|window|tablesample|pivot|unpivot|cluster|distribute|sort"
_FACTS = re.compile(rf"""'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|`[^`]*`|(\b(?:from|join)\s+)facts\b(?!\s*[.(])(?=(\s+(?:as\s+)?(?!(?:{_KEYWORDS})\b)[a-z_])?)""", re.I | re.S)


class AsOfError(ValueError):
    """An as-of point that cannot be read."""


class UnknownTransaction(AsOfError):
    pass


class NoZone(AsOfError):
    pass


class BeforeFirstTransaction(AsOfError):
    pass


class FactLog:
    """A fact log read through `reader`, which returns the facts of the attributes it is given.

    Reading by attribute lets a partitioned log prune to the partitions a query names.
    """

    def __init__(self, reader: Reader, attrs: DataFrame, tx: DataFrame | Callable[[], DataFrame],
                 known: list[Attribute] | None = None, snapshot: Snapshot | None = None) -> None:
        self.reader = reader
        self._snapshot = snapshot
        self.attrs = attrs
        self._tx = tx
        self._known = {a.ident: a for a in known or []}
        self._again: Callable[[], FactLog] | None = None
        #: Of a store on disk, its version's number, for `commit`, and the greatest id in it.
        self.number: int | None = None
        self.high: int | None = None

    @property
    def tx(self) -> DataFrame:
        """Transactions (id, actor, at), built when first asked for."""
        if callable(self._tx):
            self._tx = self._tx()
        return self._tx

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FactLog:
        """The store written under `path` by `factloom.sources.log`, as it is now.

        Every method reads the batches committed by now, so their answers agree; `refresh` gives
        the store with what was committed since.
        """
        from factloom.sources import log

        at = log.version(spark, path)
        store = cls(lambda attributes: log.scan(spark, path, attributes=attributes, at=at),
                    log.attributes(spark, path, at), log.transactions(spark, path, at),
                    snapshot=log.snapshot(spark, path, at))
        store._again = lambda: cls.open(spark, path)
        store.number, store.high = at.number, at.high
        return store

    def refresh(self) -> FactLog:
        """The store with all that is committed now; itself where it is not on disk."""
        return self._again() if self._again else self

    @classmethod
    def of(cls, facts: DataFrame, attrs: DataFrame, tx: DataFrame) -> FactLog:
        """A store over a facts DataFrame."""
        def read(attributes):
            return facts if attributes is None else facts.where(F.col("a").isin([a.id for a in attributes]))
        return cls(read, attrs, tx)

    def attribute(self, ident: str) -> Attribute:
        if ident not in self._known:
            rows = self.attrs.where(F.col("ident") == ident).take(1)
            if not rows:
                raise KeyError(f"no attribute {ident}")
            r = rows[0]
            self._known[ident] = Attribute(r.id, r.ident, r.type, r.cardinality, r.uniq, r.doc, r.replaced_by)
        return self._known[ident]

    def attributes(self, idents: list[str]) -> list[Attribute]:
        return [self.attribute(i) for i in idents]

    def log(self, idents: list[str] | None = None) -> DataFrame:
        """Raw facts, of all or the named attributes."""
        return self.reader(None if idents is None else self.attributes(idents))

    def attr(self, ident: str, as_of=None) -> DataFrame:
        """(e, v, tx) of an attribute."""
        return self._relation(self.attribute(ident), self.resolve(as_of))

    def _relation(self, a: Attribute, tx: int | None) -> DataFrame:
        if tx is None and self._snapshot is not None:
            rows, final = self._snapshot([a])
            if final:
                return rows.where(F.col("a") == a.id).select("e", F.col(a.column).alias("v"), "tx")
            return fold.relation(rows, a)
        return fold.relation(self.reader([a]), a, tx)

    def history(self, ident: str, as_of=None) -> DataFrame:
        a = self.attribute(ident)
        return fold.history(self.reader([a]), a, self.resolve(as_of))

    def wide(self, idents: list[str], as_of=None) -> DataFrame:
        """One row per entity with a column per attribute."""
        attributes = self.attributes(idents)
        if as_of is None and self._snapshot is not None:
            return fold.wide(self._snapshot(attributes)[0], attributes)
        return fold.wide(self.reader(attributes), attributes, self.resolve(as_of))

    def state(self, as_of=None) -> DataFrame:
        """Every value that holds; read from the snapshot, with what was written since folded over it, if there is one."""
        if as_of is None and self._snapshot is not None:
            rows, final = self._snapshot(None)
            return rows.drop("op") if final else fold.state(rows)
        return fold.state(self.reader(None), self.resolve(as_of))

    def has_snapshot(self) -> bool:
        """Whether current state is stored as it stands."""
        return self._snapshot is not None and self._snapshot(None)[1]

    def facts(self, as_of=None) -> DataFrame:
        """(e, a, v as text, tx)."""
        return fold.facts_text(self.state(as_of), self.attrs)

    def resolve(self, as_of) -> int | None:
        """The transaction a read is bounded by: a number names it, an instant means the last one recorded by then."""
        if as_of is None:
            return None
        text = str(as_of) if isinstance(as_of, (int, str)) and not isinstance(as_of, bool) else None
        if text is not None and text.isdigit():
            return self._numbered(int(text))
        try:
            when = datetime.fromisoformat(text) if text is not None else as_of
        except ValueError:
            when = None
        if not isinstance(when, datetime):
            raise AsOfError(f"a store is read as of a transaction number or an ISO 8601 instant, and {as_of!r} is none")
        if when.tzinfo is None:
            raise NoZone(f"say which zone {as_of} is in")
        return self._recorded_by(when)

    def _numbered(self, tx: int) -> int:
        if self.tx.where(F.col("id") == tx).isEmpty():
            raise UnknownTransaction(f"the store has no transaction {tx}")
        return tx

    def _recorded_by(self, when: datetime) -> int:
        micros = (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        tx, first = self.tx.agg(F.max(F.when(F.unix_micros("at") <= micros, F.col("id"))), F.min("at")).first()
        if tx is None:
            raise BeforeFirstTransaction(f"the first transaction was recorded at {first}, after {when}; as-of reads go by recording time, not by when facts held")
        return tx

    def sql(self, text: str, as_of=None) -> DataFrame:
        """One SELECT over attribute relations, named in double quotes as "po/status".

        `history."po/status"` reads every fact, `facts` every value as text. Each named relation
        becomes a temp view, so only the attributes in the text are scanned.
        """
        spark = self.attrs.sparkSession
        at = self.resolve(as_of)
        if not re.match(r"^\s*(select|with)\b", text, re.IGNORECASE):
            raise ValueError("a query is one SELECT")
        views: dict[tuple[str, bool], str] = {}
        mark = uuid.uuid4().hex[:8]

        def view(m) -> str:
            if m[2] is None:
                return m[0]
            a, past = self.attribute(m[2]), m[1] is not None
            if (m[2], past) not in views:
                # names of its own, so that two queries of one session don't meet
                views[m[2], past] = f"{m[2]}:{'history' if past else 'now'}:{mark}"
                (fold.history(self.reader([a]), a, at) if past else self._relation(a, at)).createOrReplaceTempView(f"`{views[m[2], past]}`")
            return f"`{views[m[2], past]}`"

        def whole(m) -> str:
            if m[1] is None:
                return m[0]
            name = views.setdefault(("facts", False), f"facts:{mark}")
            fold.facts_text(self.state(at), self.attrs).createOrReplaceTempView(f"`{name}`")
            return f"{m[1]}`{name}`" + ("" if m[2] else " facts")

        out = spark.sql(_FACTS.sub(whole, _QUOTED.sub(view, text)))
        for name in views.values():
            spark.catalog.dropTempView(name)
        return out


def capped(df: DataFrame, rows: int) -> tuple[list, bool]:
    """At most `rows` rows for display, and whether there are more."""
    found = df.limit(rows + 1).collect()
    return found[:rows], len(found) > rows
