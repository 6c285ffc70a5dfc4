"""Writes as functions: (table, change) -> new table, for a new stored version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.runtime import cut_lineage


def with_generated(df: DataFrame, **exprs: Column) -> DataFrame:
    """Stored generated columns."""
    return df.withColumns(exprs)


def fill_defaults(df: DataFrame, **defaults: Column) -> DataFrame:
    """Column defaults for missing input; an absent column is added."""
    cols = {n: F.coalesce(F.col(n), d) if n in df.columns else d for n, d in defaults.items()}
    return df.withColumns(cols)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the least by ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def bulk_create(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new, allowMissingColumns=True)


def number_new(table: DataFrame, new: DataFrame, pk: str, order: list[Column]) -> DataFrame:
    """Give rows without a key the next keys after the largest one in use."""
    from relweave.operators.windows import row_number

    keyed = new.where(F.col(pk).isNotNull())
    blank = row_number(new.where(F.col(pk).isNull()), [], order, "__rn")
    top = table.select(pk).unionByName(keyed.select(pk)).agg(F.coalesce(F.max(pk), F.lit(0))).first()[0]
    numbered = blank.withColumn(pk, F.lit(top) + F.col("__rn")).drop("__rn")
    return keyed.unionByName(numbered)


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Append rows that clash neither with the table nor with an earlier new row."""
    fresh = first_per_key(new, keys, order).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Update ``fields`` where the key exists, insert the other rows whole."""
    old = table.withColumn("__old", F.lit(True))
    new = changes.select(
        *keys, *[F.col(c).alias(f"__n_{c}") for c in changes.columns if c not in keys], F.lit(True).alias("__new")
    )
    both = old.join(new, keys, "full")

    def pick(c: str) -> Column:
        if c in keys:
            return F.col(c)
        incoming = F.col(f"__n_{c}") if c in changes.columns else F.lit(None)
        take = F.col("__old").isNull()
        if c in fields:
            take = take | F.col("__new").isNotNull()
        return F.when(take, incoming).otherwise(F.col(c)).alias(c)

    return both.select(*[pick(c) for c in table.columns])


def bulk_update(table: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Set listed fields by key; ``changed`` marks the rows matched."""
    if key in fields:
        raise ValueError("the key cannot be updated")
    new = changes.select(key, *[F.col(f).alias(f"__n_{f}") for f in fields], F.lit(True).alias("changed"))
    out = table.join(new, key, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    for f in fields:
        out = out.withColumn(f, F.when(F.col("changed"), F.col(f"__n_{f}")).otherwise(F.col(f)))
    return out.select(*table.columns, "changed")


def update_where(table: DataFrame, cond: Column, **exprs: Column) -> DataFrame:
    """All new values are computed from the old row."""
    hit = F.coalesce(cond, F.lit(False))
    return table.withColumns({n: F.when(hit, e).otherwise(F.col(n)) for n, e in exprs.items()})


def get_or_create(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Existing row for each wanted key, else the wanted row; ``created`` tells."""
    return update_or_create(table, wanted, keys, [])


def update_or_create(table: DataFrame, wanted: DataFrame, keys: list[str], fields: list[str],
                     create_defaults: dict[str, Column] | None = None) -> DataFrame:
    """Batch form: the resulting row per wanted key and a ``created`` flag."""
    found = table.withColumn("__found", F.lit(True))
    new = wanted.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in wanted.columns if c not in keys])
    both = new.join(found, keys, "left").withColumn("created", F.col("__found").isNull())
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        incoming = F.col(f"__n_{c}") if c in wanted.columns else F.lit(None)
        fresh = (create_defaults or {}).get(c, incoming)
        kept = incoming if c in fields else F.col(c)
        out.append(F.when(F.col("created"), fresh).otherwise(kept).alias(c))
    return both.select(*out, "created")


def delete_where(table: DataFrame, cond: Column) -> DataFrame:
    return table.where(~F.coalesce(cond, F.lit(False)))


def delete_keys(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(*keys), keys, "left_anti")


@dataclass(frozen=True)
class OnDelete:
    """What happens to ``table`` rows whose ``columns`` point at a deleted row."""

    table: str
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    action: str  # cascade, set_null, set_value, protect, restrict, do_nothing
    value: object = None


class ProtectedRows(ValueError):
    """Deletion refused: protected or restricted rows refer to deleted ones."""


def cascade_delete(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]],
                   rules: list[OnDelete], start: str, doomed: DataFrame):
    """Follow references from ``doomed`` rows of ``start``.

    Returns (new tables, {table: deleted row count}). Rules are applied until
    no table gains doomed rows, so self references and cycles end. Restricted
    rows are allowed if they are doomed themselves.
    """
    gone = {start: cut_lineage(doomed.select(*keys[start]).distinct())}
    frontier = dict(gone)
    while frontier:
        found: dict[str, DataFrame] = {}
        for rule in rules:
            if rule.action != "cascade" or rule.target not in frontier:
                continue
            hit = _pointing(tables, rule, frontier[rule.target], keys).select(*keys[rule.table])
            found[rule.table] = found[rule.table].unionByName(hit) if rule.table in found else hit
        frontier = {}
        for name, hit in found.items():
            new = hit.distinct()
            if name in gone:
                new = new.join(gone[name], list(keys[name]), "left_anti")
            new = cut_lineage(new)
            if not new.isEmpty():
                frontier[name] = new
                gone[name] = gone[name].unionByName(new) if name in gone else new
    for rule in rules:
        if rule.action in ("protect", "restrict") and rule.target in gone:
            hit = _pointing(tables, rule, gone[rule.target], keys)
            if rule.action == "restrict" and rule.table in gone:
                hit = hit.join(gone[rule.table], list(keys[rule.table]), "left_anti")
            if not hit.isEmpty():
                raise ProtectedRows(f"{rule.table} rows refer to deleted {rule.target} rows")
    out = dict(tables)
    for rule in rules:
        if rule.action not in ("set_null", "set_value") or rule.target not in gone:
            continue
        refs = gone[rule.target] if set(rule.target_columns) == set(keys[rule.target]) else None
        refs = _target_values(tables, rule, gone, keys) if refs is None else refs
        marks = refs.select(*[F.col(t).alias(c) for c, t in zip(rule.columns, rule.target_columns)]).distinct()
        table = out[rule.table].join(marks.withColumn("__hit", F.lit(True)), list(rule.columns), "left")
        for c in rule.columns:
            kind = tables[rule.table].schema[c].dataType
            table = table.withColumn(c, F.when(F.col("__hit"), F.lit(rule.value).cast(kind)).otherwise(F.col(c)))
        out[rule.table] = table.select(*tables[rule.table].columns)
    counts = {}
    for name, doomed_keys in gone.items():
        out[name] = delete_keys(out[name], doomed_keys, list(keys[name]))
        counts[name] = doomed_keys.count()
    return out, counts


def _target_values(tables, rule: OnDelete, gone, keys) -> DataFrame:
    target = rule.target
    return tables[target].join(gone[target], list(keys[target]), "left_semi")


def _pointing(tables, rule: OnDelete, doomed: DataFrame, keys) -> DataFrame:
    """Rows of the rule's table that refer to doomed target rows."""
    refs = doomed
    if not set(rule.target_columns) <= set(doomed.columns):
        refs = tables[rule.target].join(doomed, list(keys[rule.target]), "left_semi")
    refs = refs.select(*[F.col(t).alias(c) for c, t in zip(rule.columns, rule.target_columns)])
    return tables[rule.table].join(refs, list(rule.columns), "left_semi")


def link_add(pairs: DataFrame, new: DataFrame, symmetric: bool = False) -> DataFrame:
    """Many-to-many add: existing pairs are skipped."""
    a, b = pairs.columns[:2]
    new = new.select(a, b)
    if symmetric:
        new = new.union(new.select(b, a)).toDF(a, b)
    fresh = new.distinct().join(pairs, [a, b], "left_anti")
    return pairs.unionByName(fresh)


def link_remove(pairs: DataFrame, gone: DataFrame, symmetric: bool = False) -> DataFrame:
    a, b = pairs.columns[:2]
    gone = gone.select(a, b)
    if symmetric:
        gone = gone.union(gone.select(b, a)).toDF(a, b)
    return pairs.join(gone, [a, b], "left_anti")


def link_set(pairs: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """Owners named in ``wanted`` get exactly the wanted pairs."""
    a, b = pairs.columns[:2]
    owners = wanted.select(owner).distinct()
    keep = pairs.join(owners, owner, "left_anti")
    return keep.unionByName(wanted.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())


def link_clear(pairs: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    return pairs.join(owners.select(owner), owner, "left_anti")


def purge_expired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.where(F.col(expires) >= now)


def ttl_state(ops: DataFrame, now: Column) -> DataFrame:
    """Live entries of a keyed store after an operation log.

    Columns of ``ops``: key, op (set, touch, delete), value, ts, timeout
    (seconds, NULL = never expires), seq (breaks ties of ts). The last set or
    delete decides the value; touches after it may move the expiry.
    """
    at = F.struct("ts", "seq")
    writes = ops.where(F.col("op").isin("set", "delete"))
    last = writes.groupBy("key").agg(
        F.max(at).alias("at"),
        F.max_by(F.struct("op", "value", "timeout", "ts"), at).alias("w"),
    ).where(F.col("w.op") == "set")
    touches = ops.where(F.col("op") == "touch").select("key", at.alias("t_at"), F.col("timeout").alias("t_timeout"), F.col("ts").alias("t_ts"))
    touched = touches.join(last.select("key", "at"), "key").where(F.col("t_at") > F.col("at"))
    latest = touched.groupBy("key").agg(F.max_by(F.struct("t_ts", "t_timeout"), "t_at").alias("t"))
    out = last.join(latest, "key", "left")
    base = F.when(F.col("t").isNotNull(), F.col("t.t_ts")).otherwise(F.col("w.ts"))
    timeout = F.when(F.col("t").isNotNull(), F.col("t.t_timeout")).otherwise(F.col("w.timeout"))
    expires = base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), timeout)
    out = out.select("key", F.col("w.value").alias("value"), expires.alias("expires"))
    return out.where(F.col("expires").isNull() | (F.col("expires") > now))


def add_if_absent(state: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Add keys that are absent or expired in ``state`` (key, value, expires)."""
    live = state.where(F.col("expires").isNull() | (F.col("expires") > now))
    return live.unionByName(new.join(live.select("key"), "key", "left_anti"))


def cull(state: DataFrame, max_entries: int, frequency: int = 3) -> DataFrame:
    """Over ``max_entries``: drop every key below the one ranked count/frequency.

    The cut key is found by its rank in key order.
    """
    from relweave.operators.windows import row_number

    total = state.count()
    if total <= max_entries:
        return state
    ranked = row_number(state, [], [F.col("key").asc()], "__rn")
    return ranked.where(F.col("__rn") > total // frequency).drop("__rn")
