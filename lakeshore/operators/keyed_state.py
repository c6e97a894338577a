"""Operators on keyed records: insert with a limit, update, close, delete, expiry, ids, dispatch and replay of a change log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.operators.lookup import carried_forward

#: Records kept, and milliseconds from a request to expiry.
LIMIT, EXPIRY_MS = 1, 1_000_000
MAX_SAFE_INTEGER = 9007199254740991


def newest(records: DataFrame, order: str, limit: int = LIMIT) -> DataFrame:
    """Insert newest first and keep ``limit``: a top-k, never a full sort."""
    return records.orderBy(F.col(order).desc_nulls_last()).limit(limit)


def updated(records: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], present: str | None = None) -> DataFrame:
    """Shallow merge by key, without inserts.

    ``updates`` has at most one row a key. A field named in its array column ``present`` wins even if it is null;
    without such a column every field of an update is taken as given.
    """
    renamed = updates.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_new_{f}") for f in fields], *([F.col(present).alias("_present")] if present else []), F.lit(True).alias("_hit"))
    x = records.join(renamed, F.col(key) == F.col("_key"), "left")
    given = lambda f: F.coalesce(F.col("_hit") & (F.array_contains("_present", f) if present else F.lit(True)), F.lit(False))
    return x.select(*[(F.when(given(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)) for c in records.columns])


def closed(records: DataFrame, key: str, value: object | None, flag: str = "open") -> DataFrame:
    """Set ``flag`` to false for one key, or for all rows when ``value`` is None."""
    hit = F.lit(True) if value is None else F.coalesce(F.col(key) == F.lit(value), F.lit(False))
    return records.withColumn(flag, F.when(hit, F.lit(False)).otherwise(F.col(flag)))


def deleted(records: DataFrame, key: str, value: object | None) -> DataFrame:
    """Delete one key's rows, or all when ``value`` is None; rows without a key stay."""
    return records.limit(0) if value is None else records.filter(~F.col(key).eqNullSafe(F.lit(value)))


def deleted_keys(records: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Delete the rows of many keys: an anti join."""
    return records.join(keys.select(key), key, "left_anti")


def first_expiry(requests: DataFrame, key: str, at: str, delay_ms: int = EXPIRY_MS) -> DataFrame:
    """(key, requested, expires): the first request of a key sets its expiry, later ones don't move it.

    An aggregate, so a hot key is combined before the shuffle.
    """
    first = requests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("requested"))
    return first.withColumn("expires", F.col("requested") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay_ms / 1000).cast("decimal(18,6)")))


def dense_ids(records: DataFrame, order: Sequence[str], bucket: Column, modulus: int = MAX_SAFE_INTEGER) -> DataFrame:
    """Sequential ids from 1 as text, wrapping at ``modulus``.

    ``bucket`` must rise with ``order``; rows are numbered inside buckets, and bucket sizes are summed, so
    no task sorts the whole table.
    """
    x = records.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket only
    sizes = x.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_bucket").alias("_b"), "_before")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    numbered = x.withColumn("_at", inside).join(sizes, F.col("_bucket").eqNullSafe(F.col("_b")))
    return numbered.withColumn("id", ((F.col("_before") + F.col("_at")) % F.lit(modulus)).cast("string")).drop("_bucket", "_b", "_before", "_at")


def handled(requests: DataFrame, store: str, seq: str, raises: Column, id_bucket: Column, day: Column, name: str = "toast_id") -> DataFrame:
    """``requests`` with the id of the handle that each goes through: one that ``raises`` a record gets a handle of its own, the next
    sequential id of all stores; any other gets its store's last handle, null if it has none yet.

    ``id_bucket`` and ``day`` must rise with ``seq``: ids are counted in buckets (:func:`dense_ids`), and a store's handles are carried along
    its days (:func:`lakeshore.operators.lookup.carried_forward`), so that neither all requests nor a busy store are one task.
    """
    new = dense_ids(requests.filter(raises), [seq], id_bucket).select(F.col(seq).alias("_seq"), F.col("id").alias("_raised"))
    x = requests.join(new, F.col(seq) == F.col("_seq"), "left").withColumn(name, F.col("_raised")).drop("_seq", "_raised")
    return carried_forward(x, store, [seq], name, bucket=day)


def dispatched(kind: Column, actions: Mapping[str, Column | str], otherwise: Column | str | None = None) -> Column:
    """The value of the action that a type tag names; ``otherwise`` for other tags, null ones, and where there are no actions."""
    out = F.when(F.lit(False), otherwise)
    for tag, value in actions.items():
        out = out.when(kind == tag, value)
    return out.otherwise(otherwise)


def replayed(actions: DataFrame, fields: Sequence[str] = ("title", "description", "open")) -> DataFrame:
    """The record each store shows after its change log, with one record to a store.

    ``actions`` has (store, seq, type, toast_id, ``fields``, present): ``add`` puts a new record in place, ``update``
    changes the present fields of its id, ``dismiss`` closes and ``remove`` deletes an id or, with a null id, whatever is there; an
    ``add`` without an id is ignored. Only what follows a store's last add matters, so the fold is two aggregates, by id
    and by store, both combined before their shuffles: a hot store is no hot task.
    """
    kind = F.col("type")

    def last(field: str) -> Column:
        given = kind.isin("add", "update") & (F.array_contains("present", field) | (kind == "add"))
        value = F.col(field)
        if field == "open":
            given = given | (kind == "dismiss")
            value = F.when(kind == "dismiss", F.lit(False)).otherwise(F.when(kind == "add", F.lit(True)).otherwise(value))
        return F.max(F.when(given, F.struct("seq", value.alias("value")))).alias(field)

    # an add gives every field, so the last value of each id that was added is of its last add or later
    at = lambda name: F.max(F.when(kind == name, F.col("seq"))).alias(f"_{name}")
    each = actions.groupBy("store", "toast_id").agg(at("add"), at("remove"), at("dismiss"), *[last(f) for f in fields])
    own = F.when(F.col("toast_id").isNotNull() & F.col("_add").isNotNull(), F.struct("_add", "toast_id", "_remove", *fields))
    every = lambda name: F.max(F.when(F.col("toast_id").isNull(), F.col(f"_{name}"))).alias(f"_all_{name}")
    x = each.groupBy("store").agg(F.max(own).alias("_shown"), every("dismiss"), every("remove")).filter("_shown is not null")
    x = x.filter(~F.coalesce(F.greatest("_shown._remove", "_all_remove") > F.col("_shown._add"), F.lit(False)))
    closed_ = lambda f: F.coalesce(F.col("_all_dismiss") > F.col(f"_shown.{f}.seq"), F.lit(False))
    value = lambda f: F.when(closed_(f), F.lit(False)).otherwise(F.col(f"_shown.{f}.value")) if f == "open" else F.col(f"_shown.{f}.value")
    return x.select("store", F.col("_shown.toast_id").alias("toast_id"), *[value(f).alias(f) for f in fields])
