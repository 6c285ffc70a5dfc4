"""Declared relations between tables, and queries addressed by relation path.

``Rows(store, "orders").filter(customer__nation__n_name__startswith="F")``
becomes plain equi joins and predicates; Catalyst picks the physical joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions import lookups as lk


@dataclass(frozen=True)
class Relation:
    """One named hop. ``keys`` pairs source columns with target columns."""

    source: str
    name: str
    target: str
    keys: tuple[tuple[str, str], ...]
    many: bool = False
    nullable: bool = False
    only: Callable[[DataFrame], DataFrame] | None = None  # extra ON restriction


@dataclass
class Catalog:
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    hops: dict[tuple[str, str], Relation] = field(default_factory=dict)
    shortcuts: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)

    def table(self, name: str, *key: str) -> "Catalog":
        self.keys[name] = key
        return self

    def foreign_key(
        self,
        source: str,
        name: str,
        target: str,
        *pairs: tuple[str, str],
        reverse: str,
        nullable: bool = False,
        unique: bool = False,
    ) -> "Catalog":
        """FK (or one-to-one if ``unique``) and its reverse hop."""
        back = tuple((t, s) for s, t in pairs)
        self.hops[source, name] = Relation(source, name, target, pairs, nullable=nullable)
        self.hops[target, reverse] = Relation(
            target, reverse, source, back, many=not unique, nullable=True
        )
        return self

    def many_to_many(self, source: str, name: str, first: str, second: str) -> "Catalog":
        """Two hops over a through table, under one name."""
        self.shortcuts[source, name] = (first, second)
        return self

    def hop(self, table: str, name: str) -> Relation | None:
        return self.hops.get((table, name))


class Store:
    """Catalog plus a loader of tables."""

    def __init__(self, catalog: Catalog, load: Callable[[str], DataFrame]):
        self.catalog = catalog
        self.load = load

    def target(self, hop: Relation) -> DataFrame:
        rows = self.load(hop.target)
        return hop.only(rows) if hop.only else rows


def star_catalog() -> Catalog:
    """Relations of the sales star schema and the document labels."""
    c = Catalog()
    c.table("region", "r_regionkey").table("nation", "n_nationkey")
    c.table("customer", "c_custkey").table("supplier", "s_suppkey")
    c.table("part", "p_partkey").table("orders", "o_orderkey")
    c.table("lineitem", "l_orderkey", "l_linenumber")
    c.table("documents", "doc_id").table("labels", "doc_id")
    c.foreign_key("nation", "region", "region", ("n_regionkey", "r_regionkey"), reverse="nations")
    c.foreign_key("customer", "nation", "nation", ("c_nationkey", "n_nationkey"), reverse="customers")
    c.foreign_key("supplier", "nation", "nation", ("s_nationkey", "n_nationkey"), reverse="suppliers")
    c.foreign_key("orders", "customer", "customer", ("o_custkey", "c_custkey"), reverse="orders")
    c.foreign_key("lineitem", "order", "orders", ("l_orderkey", "o_orderkey"), reverse="lines")
    c.foreign_key("lineitem", "part", "part", ("l_partkey", "p_partkey"), reverse="lines")
    c.foreign_key("lineitem", "supplier", "supplier", ("l_suppkey", "s_suppkey"), reverse="lines")
    c.foreign_key("labels", "document", "documents", ("doc_id", "doc_id"), reverse="label", unique=True)
    c.many_to_many("part", "suppliers", "lines", "supplier")
    c.many_to_many("supplier", "parts", "lines", "part")
    return c


def hop_join(df: DataFrame, child: DataFrame, pairs, how: str) -> DataFrame:
    """Equi join on (left column, right column) pairs; right key columns stay."""
    cond = lk.all_of(*[df[a] == child[b] for a, b in pairs])
    return df.join(child, cond, how)


@dataclass(frozen=True)
class Rows:
    """Rows of a table with the single-valued relations joined so far.

    Columns of a related table appear as ``path__column``.
    """

    store: Store
    table: str
    frame: DataFrame | None = None
    joined: tuple[tuple[str, ...], ...] = ()

    @property
    def df(self) -> DataFrame:
        return self.store.load(self.table) if self.frame is None else self.frame

    def _with(self, df: DataFrame, joined=None) -> "Rows":
        return Rows(self.store, self.table, df, self.joined if joined is None else joined)

    def _expand(self, path: str) -> list[str]:
        """Path parts, many-to-many names replaced by their two hops."""
        out, table = [], self.table
        for part in path.split("__"):
            short = self.store.catalog.shortcuts.get((table, part))
            for p in short or (part,):
                hop = self.store.catalog.hop(table, p) if table else None
                table = hop.target if hop else None
                out.append(p)
        return out

    def _split(self, path: str) -> tuple[list[Relation], list[str]]:
        """Leading relation hops and the remaining parts."""
        parts, table, hops = self._expand(path), self.table, []
        while parts:
            hop = self.store.catalog.hop(table, parts[0])
            if hop is None:
                break
            hops.append(hop)
            table = hop.target
            parts = parts[1:]
        return hops, parts

    def join(self, hops: list[Relation], how: str | None = None) -> "Rows":
        """Join the hops not joined yet; LEFT once a nullable hop is passed."""
        rows, prefix, outer = self, (), False
        for hop in hops:
            outer = outer or hop.nullable
            path = prefix + (hop.name,)
            if path not in rows.joined:
                lead = "__".join(prefix) + "__" if prefix else ""
                mark = "__".join(path) + "__"
                child = rows.store.target(hop)
                child = child.select(*[F.col(c).alias(mark + c) for c in child.columns])
                pairs = [(lead + a, mark + b) for a, b in hop.keys]
                kind = how or ("left" if outer else "inner")
                df = hop_join(rows.df, child, pairs, kind)
                rows = rows._with(df, rows.joined + (path,))
            prefix = path
        return rows

    def resolve(self, path: str, how: str | None = None) -> tuple["Rows", Column, list[str]]:
        """Rows with the needed joins, the column, and steps left over.

        A path that ends in the key of its last hop reads the foreign key
        itself, without the join.
        """
        hops, rest = self._split(path)
        if not rest or (hops and rest[0] in lk.LOOKUPS):
            rest = ["pk", *rest]
        if rest[0] == "pk":
            table = hops[-1].target if hops else self.table
            rest = [self.store.catalog.keys[table][0], *rest[1:]]
        column = rest[0]
        if hops and not hops[-1].many and hops[-1].only is None:
            keyed = {t: s for s, t in hops[-1].keys}
            if column in keyed:
                hops, column = hops[:-1], keyed[column]
        rows = self.join(hops, how)
        lead = "".join(h.name + "__" for h in hops)
        return rows, F.col(lead + column), rest[1:]

    def condition(self, **lookups) -> tuple["Rows", Column]:
        """AND of the lookups; OR branches need ``how='left'`` joins, see any_of."""
        rows, conds = self, []
        for path, value in lookups.items():
            rows, col, steps = rows.resolve(path)
            conds.append(lk.predicate(col, steps, value))
        return rows, lk.all_of(*conds)

    def any_of(self, *branches: dict) -> "Rows":
        """OR of several lookup sets: relations are joined LEFT, since a row may
        qualify through a branch that does not use them."""
        rows, ors = self, []
        for branch in branches:
            ands = []
            for path, value in branch.items():
                rows, col, steps = rows.resolve(path, how="left")
                ands.append(lk.predicate(col, steps, value))
            ors.append(lk.all_of(*ands))
        return rows._with(rows.df.where(lk.any_of(*ors)))

    def _sort_out(self, lookups: dict):
        """Split lookups into own/single-valued ones and groups per to-many hop."""
        single, groups = {}, {}
        for path, value in lookups.items():
            hops, rest = self._split(path)
            at = next((i for i, h in enumerate(hops) if h.many), None)
            if at is None:
                single[path] = value
                continue
            below = "__".join([h.name for h in hops[at + 1 :]] + rest)
            groups.setdefault(tuple(hops[: at + 1]), {})[below] = value
        return single, groups

    def _children(self, hops, below: dict) -> tuple["Rows", DataFrame, list]:
        *lead, last = hops
        rows = self.join(list(lead))
        child = Rows(self.store, last.target, self.store.target(last)).filter(**below)
        mark = "__child__"
        keys = child.df.select(*[F.col(b).alias(mark + b) for _, b in last.keys])
        pre = "".join(h.name + "__" for h in lead)
        return rows, keys, [(pre + a, mark + b) for a, b in last.keys]

    def filter(self, **lookups) -> "Rows":
        """Conditions of one call on the same to-many relation must hold on the
        same child row; a second call may match another child. As in SQL, a
        parent appears once per matching child."""
        single, groups = self._sort_out(lookups)
        rows = self
        if single:
            rows, cond = rows.condition(**single)
            rows = rows._with(rows.df.where(cond))
        for hops, below in groups.items():
            rows, keys, pairs = rows._children(hops, below)
            df = hop_join(rows.df, keys, pairs, "inner").drop(*keys.columns)
            rows = rows._with(df)
        return rows

    def filter_exists(self, **lookups) -> "Rows":
        """Like filter, but each parent at most once (semi join)."""
        single, groups = self._sort_out(lookups)
        rows = self.filter(**single) if single else self
        for hops, below in groups.items():
            rows, keys, pairs = rows._children(hops, below)
            rows = rows._with(hop_join(rows.df, keys, pairs, "left_semi"))
        return rows

    def exclude(self, **lookups) -> "Rows":
        """NOT(AND of lookups). Rows with NULLs stay; a to-many lookup is met if the
        parent has a matching child (anti join), several lookups by several children."""
        single, _ = self._sort_out(lookups)
        # each to-many lookup may be met by a child of its own
        groups = [g for path, v in lookups.items() for g in self._sort_out({path: v})[1].items()]
        rows = self
        if groups and not single and len(groups) == 1:
            (hops, below), = groups
            rows, keys, pairs = rows._children(hops, below)
            return rows._with(hop_join(rows.df, keys, pairs, "left_anti"))
        cond = F.lit(True)
        if single:
            rows, cond = rows.condition(**single)
        flags = []
        for i, (hops, below) in enumerate(groups):
            rows, keys, pairs = rows._children(hops, below)
            flag = f"__match{i}"
            keys = keys.distinct().withColumn(flag, F.lit(True))
            drop = [c for c in keys.columns if c != flag]
            rows = rows._with(hop_join(rows.df, keys, pairs, "left").drop(*drop))
            flags.append(flag)
        conds = [cond] + [F.coalesce(F.col(f), F.lit(False)) for f in flags]
        return rows._with(rows.df.where(lk.negate(lk.all_of(*conds))).drop(*flags))

    def annotate(self, **exprs) -> "Rows":
        """New columns; a value is a Column or a relation path."""
        rows = self
        for name, expr in exprs.items():
            if name in self.store.load(self.table).columns:
                raise ValueError(f"annotation {name} clashes with a column")
            if isinstance(expr, str):
                rows, expr, steps = rows.resolve(expr)
                for s in steps:
                    expr = lk.TRANSFORMS[s](expr)
            rows = rows._with(rows.df.withColumn(name, expr))
        return rows

    def values(self, *paths: str, **exprs) -> DataFrame:
        """Project paths (named by the path) and expressions."""
        rows, cols = self, []
        for name, path in [(p, p) for p in paths] + list(exprs.items()):
            if isinstance(path, Column):
                cols.append(path.alias(name))
                continue
            rows, col, steps = rows.resolve(path)
            for s in steps:
                col = lk.TRANSFORMS[s](col)
            cols.append(col.alias(name))
        return rows.df.select(*cols)

    def count_by(self, *paths: str, **aggs: Column) -> DataFrame:
        """values(paths).annotate(aggs): group by the listed paths only."""
        rows, keys = self, []
        for path in paths:
            rows, col, steps = rows.resolve(path)
            for s in steps:
                col = lk.TRANSFORMS[s](col)
            keys.append(col.alias(path))
        return rows.df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def select_related(rows: Rows, *paths: str) -> DataFrame:
    """Each named single-valued relation as a nested struct column."""
    out, base = rows, rows.df.columns
    structs = []
    for path in paths:
        hops, _ = out._split(path)
        out = out.join(hops)
        mark = path + "__"
        inner = [c for c in out.df.columns if c.startswith(mark) and "__" not in c[len(mark):]]
        key = F.col(mark + hops[-1].keys[0][1])
        pack = F.struct(*[F.col(c).alias(c[len(mark):]) for c in inner])
        structs.append(F.when(key.isNotNull(), pack).alias(path))
    return out.df.select(*base, *structs)


def generic_join(links: DataFrame, kind: str, key: str, targets: dict[str, tuple[DataFrame, str]],
                 columns: dict[str, Column | str]) -> DataFrame:
    """Polymorphic (type, id) relation: one equi join per target table.

    ``columns`` names the output and gives, per target type, what to take:
    {output: {type: column}}.
    """
    parts = []
    for label, (target, pk) in targets.items():
        side = links.where(F.col(kind) == label)
        picked = target.select(
            F.col(pk).alias("__pk"),
            *[F.col(per[label]).cast("string").alias(out) for out, per in columns.items()],
        )
        parts.append(side.join(picked, side[key] == picked["__pk"], "left").drop("__pk"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
