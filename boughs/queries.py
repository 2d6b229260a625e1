"""Queries over whole tables, one for each operator, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boughs import streaming
from boughs.core import DataTree
from boughs.functions import flatten_column, isna, native
from boughs.plans.schema import Leaf, Schema
from boughs.plans.types import FunctionType, PrimitiveType
from boughs.session import shared_folder, ship_code
from boughs.sources import files, paged

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(func: Query) -> Query:
        _queries[func.__name__] = func
        if sql:
            _sql[func.__name__] = sql
        return func

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tree(spark: SparkSession, sf_dir: str, name: str, by: str | list[str]) -> DataTree:
    return DataTree.from_df(_table(spark, sf_dir, name), by)


def _events(spark: SparkSession, sf_dir: str) -> DataTree:
    """Events with their properties as a struct."""
    return DataTree.from_df(_table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k long")), "event_id")


def _gappy(spark: SparkSession, sf_dir: str) -> DataTree:
    """Customers of whom one segment is null."""
    return DataTree.from_df(_table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))), "c_custkey")


# Paths


@_query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def project_depth(spark, sf_dir):
    return _events(spark, sf_dir)[:, "props.k"].to_df()


@_query("SELECT o_orderkey, o_totalprice FROM orders")
def project_breadth(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[:, ["o_orderkey", "o_totalprice"]].to_df()


@_query("SELECT CAST(NULL AS VARCHAR) AS nothing, o_orderkey FROM orders")
def project_missing(spark, sf_dir):
    found = _tree(spark, sf_dir, "orders", "o_orderkey")[:, ["o_clerk.nothing", "o_orderkey"]].to_df()
    return found.withColumn("nothing", F.col("nothing").cast("string"))


@_query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events")
def path_multi(spark, sf_dir):
    return _events(spark, sf_dir).path(["event_type", "props.k", "ts"]).to_df()


@_query("SELECT upper(c_name) AS c_name, c_custkey FROM customer")
def path_collision(spark, sf_dir):
    both = _table(spark, sf_dir, "customer").withColumn("loud", F.struct(F.upper("c_name").alias("c_name")))
    return DataTree.from_df(both, "c_custkey").path(["c_name", "loud.c_name", "c_custkey"]).to_df()


@_query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def list_cross(spark, sf_dir):
    groups = _tree(spark, sf_dir, "conversations", ["conv_id", "turn"])[:, "conv_id"].group_by()
    return groups[:, ["conv_id", "members.role"]].to_df().select("conv_id", F.array_join("role", ",").alias("roles"))


# Rows


@_query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) = 8")
def row_int(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[7, "o_orderkey"].to_df()


@_query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) BETWEEN 11 AND 40")
def row_slice(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[10:40, "o_orderkey"].to_df()


@_query("SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 6) % 7 = 0 AND row_number() OVER (ORDER BY o_orderkey) >= 6")
def row_step(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[5::7, "o_orderkey"].to_df()


@_query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) <= 25")
def row_negative(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[-25:, "o_orderkey"].to_df()


@_query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) BETWEEN 11 AND 40")
def row_back(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[-40:-10, "o_orderkey"].to_df()


@_query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) > 100 AND row_number() OVER (ORDER BY o_orderkey DESC) > 50")
def row_middle(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[100:-50, "o_orderkey"].to_df()


@_query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) IN (3, 10, 17, 24)")
def row_front_step(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[2:30:7, "o_orderkey"].to_df()


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place FROM orders")
def row_reverse(spark, sf_dir):
    turned = _tree(spark, sf_dir, "orders", "o_orderkey")[::-1]
    return turned.numbered("place").select("o_orderkey", "place")


@_query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders) SELECT i AS place, o_orderkey FROM r JOIN (VALUES (0, 5), (1, 0), (2, 5), (3, -1)) AS w(i, p) ON n = CASE WHEN p < 0 THEN c + p ELSE p END")
def row_gather(spark, sf_dir):
    return _tree(spark, sf_dir, "orders", "o_orderkey")[[5, 0, 5, -1]].numbered("place").select(F.col("place").cast("int").alias("place"), "o_orderkey")


@_query("SELECT c_name, c_acctbal, CAST(NULL AS VARCHAR) AS missing FROM customer")
def prune_dict(spark, sf_dir):
    found = _tree(spark, sf_dir, "customer", "c_custkey")[{"c_name": str, "c_acctbal": float, "missing": None}].to_df()
    return found.withColumn("missing", F.col("missing").cast("string"))


@_query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_suppkey FROM supplier QUALIFY place NOT IN (0, 2, 5)")
def drop_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier")
    numbered = DataTree.from_df(rows, "s_suppkey").numbered("place")
    return DataTree.from_df(numbered, "place").drop_rows([0, 2, 5]).path(["place", "s_suppkey"]).to_df()


# Filters and maps


@_query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_native(spark, sf_dir):
    rows = _tree(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])
    return rows[:, "l_quantity"].filter(native(lambda q: q > 45))[:, ["l_orderkey", "l_quantity"]].to_df()


@_query("SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount > 0.05")
def filter_udf(spark, sf_dir):
    rows = _tree(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])
    return rows[:, "l_discount"].shallow(lambda d: d > 0.05, returns="double")[:, ["l_orderkey", "l_discount"]].to_df()


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'")
def filter_breadth(spark, sf_dir):
    rows = _tree(spark, sf_dir, "orders", "o_orderkey")[:, ["o_totalprice", "o_orderstatus"]]
    return rows.filter(native(lambda price, status: (price > 150000) & (status == "O")))[:, ["o_orderkey", "o_totalprice"]].to_df()


@_query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders")
def map_value(spark, sf_dir):
    rows = _tree(spark, sf_dir, "orders", "o_orderkey")[:, "o_totalprice"]
    return rows.shallow(native(lambda x: x * 2))[:, ["o_orderkey", "o_totalprice"]].to_df()


@_query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS o_orderpriority FROM orders")
def map_udf(spark, sf_dir):
    rows = _tree(spark, sf_dir, "orders", "o_orderkey")[:, "o_orderpriority"]
    return rows.shallow(lambda s: s.split("-")[0], returns="string")[:, ["o_orderkey", "o_orderpriority"]].to_df()


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k FROM events")
def map_nested(spark, sf_dir):
    return _events(spark, sf_dir)[:, "props.k"].shallow(native(lambda k: k + 1))[:, ["event_id", "props.k"]].to_df()


@_query("SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def mixed_keep_map(spark, sf_dir):
    rows = _tree(spark, sf_dir, "orders", "o_orderkey")[:, "o_orderstatus"]
    return rows.shallow(lambda s: False if s == "F" else s.lower(), returns="string")[:, ["o_orderkey", "o_orderstatus"]].to_df()


@_query("SELECT c_custkey, 'nation ' || c_nationkey AS c_nationkey FROM customer")
def map_retype(spark, sf_dir):
    """A Python map from a number to a text."""
    rows = _tree(spark, sf_dir, "customer", "c_custkey")[:, "c_nationkey"]
    return rows.shallow(lambda n: f"nation {n}", returns="string")[:, ["c_custkey", "c_nationkey"]].to_df()


@_query("SELECT event_type, count(*) AS ids FROM events GROUP BY event_type")
def map_list_to_number(spark, sf_dir):
    """A Python map from a list to a number."""
    groups = _tree(spark, sf_dir, "events", "event_id").path(["event_type", "event_id"])[:, "event_type"].group_by("ids")
    counted = groups.chain(lambda df: df.withColumn("ids", F.col("ids.event_id")))[:, "ids"].shallow(len, returns="long")
    return counted[:, ["event_type", "ids"]].to_df()


@_query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE '<odd>' END AS c_nationkey FROM customer WHERE c_nationkey % 3 > 0")
def map_keep_or_retype(spark, sf_dir):
    """One Python function that drops, keeps and gives values of another type."""
    rows = _tree(spark, sf_dir, "customer", "c_custkey")[:, "c_nationkey"]
    found = rows.shallow(lambda n: False if n % 3 == 0 else True if n % 2 == 0 else "<odd>", returns="variant")[:, ["c_custkey", "c_nationkey"]].to_df()
    return found.select("c_custkey", F.try_variant_get("c_nationkey", "$", "string").alias("c_nationkey"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_custkey + 1152921504606846976 END AS big FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 2 = 1")
def map_null_beside_numbers(spark, sf_dir):
    """Large integers and nulls in one batch: Python sees ints and None."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") + (1 << 60)).alias("big"))
    odd = DataTree.from_df(rows, "c_custkey")[:, "big"].shallow(lambda b: True if b is None else isinstance(b, int) and b % 2 == 1, returns="long")
    return odd[:, ["c_custkey", "big"]].to_df()


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def isna_rows(spark, sf_dir):
    return _gappy(spark, sf_dir)[:, "c_mktsegment"].isna()[:, "c_custkey"].to_df()


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def not_isna(spark, sf_dir):
    return _gappy(spark, sf_dir)[:, "c_mktsegment"].not_(isna)[:, ["c_custkey", "c_mktsegment"]].to_df()


@_query("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_mktsegment, 'BUILDING') = 'MACHINERY', false)")
def not_null_result(spark, sf_dir):
    return _gappy(spark, sf_dir)[:, "c_mktsegment"].not_(native(lambda s: s == "MACHINERY"))[:, "c_custkey"].to_df()


@_query("SELECT conv_id * 10 AS conv_id, string_agg(turn * 10 || lower(coalesce(role, '-')), ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def deep_map(spark, sf_dir):
    """All leaves of conversations with their turns as lists of records."""
    grouped = _tree(spark, sf_dir, "conversations", ["conv_id", "turn"])[:, "conv_id"].group_by()
    found = grouped.deep({T.StringType: F.lower, T.IntegralType: lambda x: x * 10}).to_df()
    said = F.transform("members", lambda m: F.concat(m["turn"].cast("string"), F.coalesce(m["role"], F.lit("-"))))
    return found.select("conv_id", F.array_join(said, ",").alias("turns"))


@_query("SELECT o_orderkey * 10 AS o_orderkey, o_orderstatus FROM orders")
def deep_udf(spark, sf_dir):
    rows = _tree(spark, sf_dir, "orders", "o_orderkey").path(["o_orderkey", "o_orderstatus"]).deep(lambda v: v * 10 if isinstance(v, int) else v)
    return rows.as_typed("o_orderkey long, o_orderstatus string").to_df()


@_query("SELECT c_custkey, 'X' AS c_mktsegment FROM customer")
def assign_flat(spark, sf_dir):
    return _tree(spark, sf_dir, "customer", "c_custkey")[:, "c_mktsegment"].assign("X")[:, ["c_custkey", "c_mktsegment"]].to_df()


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 99 AS flag FROM events")
def assign_nested(spark, sf_dir):
    return _events(spark, sf_dir)[:, "props.flag"].assign(99)[:, ["event_id", "props.k", "props.flag"]].to_df()


@_query("SELECT o_orderkey, o_orderstatus, o_totalprice * 0.5 AS half FROM orders WHERE o_orderstatus = 'P'")
def chain_frames(spark, sf_dir):
    rows = _tree(spark, sf_dir, "orders", "o_orderkey").chain(lambda df: df.where("o_orderstatus = 'P'").withColumn("half", F.col("o_totalprice") * 0.5))
    return rows.path(["o_orderkey", "o_orderstatus", "half"]).to_df()


# Groups


@_query("SELECT event_type, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY event_type")
def group_members(spark, sf_dir):
    groups = _tree(spark, sf_dir, "events", "event_id")[:, "event_type"].group_by()
    ids = F.array_join(F.transform("members", lambda m: m["event_id"].cast("string")), ",")
    return groups.to_df().select("event_type", F.size("members").cast("long").alias("n"), ids.alias("ids"))


@_query("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
def group_composite(spark, sf_dir):
    rows = _tree(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]).path(["l_returnflag", "l_linestatus", "l_quantity"])
    groups = rows[:, ["l_returnflag", "l_linestatus"]].group_by("rows").to_df()
    return groups.select("l_returnflag", "l_linestatus", F.size("rows").cast("long").alias("n"), F.array_max(F.col("rows.l_quantity")).alias("most"))


@_query("SELECT CAST(NULL AS VARCHAR) AS \"group\", count(*) AS n, string_agg(s_name, ',' ORDER BY s_suppkey) AS names FROM supplier")
def group_all(spark, sf_dir):
    groups = _tree(spark, sf_dir, "supplier", "s_suppkey").group_by().to_df()
    return groups.select("group", F.size("members").cast("long").alias("n"), F.array_join("members.s_name", ",").alias("names"))


@_query("SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL")
def group_nested(spark, sf_dir):
    nested = _gappy(spark, sf_dir)[:, "c_nationkey"].group_by()[:, "members.c_mktsegment"].group_by().to_df()
    rows = nested.select("c_nationkey", F.explode("members").alias("g"))
    return rows.select("c_nationkey", "g.c_mktsegment", F.size("g.members").cast("long").alias("n"), F.col("g.members")[0]["c_custkey"].alias("first"))


@_query("SELECT event_type, user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY ALL")
def group_inner_many(spark, sf_dir):
    """Many groups inside a few large ones."""
    rows = _tree(spark, sf_dir, "events", "event_id").path(["event_id", "event_type", "user_id"])
    nested = rows[:, "event_type"].group_by()[:, "members.user_id"].group_by("rows").to_df()
    inner = nested.select("event_type", F.explode("members").alias("g"))
    return inner.select("event_type", "g.user_id", F.size("g.rows").cast("long").alias("n"), F.col("g.rows")[0]["event_id"].alias("first"), F.array_max("g.rows.event_id").alias("last"))


@_query("SELECT c_nationkey, c_mktsegment, CAST(c_custkey % 2 AS BIGINT) AS odd, count(*) AS n FROM customer GROUP BY ALL")
def group_recurse(spark, sf_dir):
    """Groups in groups in groups."""
    rows = _table(spark, sf_dir, "customer").withColumn("odd", F.col("c_custkey") % 2)
    one = DataTree.from_df(rows, "c_custkey")[:, "c_nationkey"].group_by()
    three = one[:, "members.c_mktsegment"].group_by()[:, "members.members.odd"].group_by(recurse=True).to_df()
    deep = three.select("c_nationkey", F.explode("members").alias("g")).select("c_nationkey", "g.c_mktsegment", F.explode("g.members").alias("h"))
    return deep.select("c_nationkey", "c_mktsegment", F.col("h.odd").cast("long").alias("odd"), F.size("h.members").cast("long").alias("n"))


@_query("SELECT CAST(c_custkey % 3 AS BIGINT) AS a, count(*) AS n FROM customer GROUP BY ALL")
def group_list_key(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.array((F.col("c_custkey") % 3)).alias("key"))
    groups = DataTree.from_df(rows, "c_custkey")[:, "key"].group_by().to_df()
    return groups.select(F.col("key")[0].alias("a"), F.size("members").cast("long").alias("n"))


@_query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, max(l_extendedprice) AS dearest FROM lineitem GROUP BY l_returnflag")
def summarize_groups(spark, sf_dir):
    rows = _tree(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])[:, "l_returnflag"]
    return rows.summarize({"n": F.count(F.lit(1)), "quantity": F.sum("l_quantity"), "dearest": F.max("l_extendedprice")}).to_df()


@_query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, bit_xor(event_id * 7) AS code FROM events GROUP BY ALL")
def fold_groups(spark, sf_dir):
    """An aggregate in Python, from states that each task keeps."""
    groups = _events(spark, sf_dir)[:, ["event_type", "props.k"]]
    return groups.fold("event_id", lambda: 0, lambda state, v: state ^ v * 7, lambda a, b: a ^ b, "long", name="code").to_df()


@_query("WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) SELECT NULL AS c_custkey, string_agg(s, ',' ORDER BY c_custkey) AS segments FROM c WHERE s IS NOT NULL UNION ALL SELECT c_custkey, NULL FROM c WHERE s IS NULL")
def aggregate_single(spark, sf_dir):
    rows = _gappy(spark, sf_dir).path(["c_custkey", "c_mktsegment"])[:, "c_mktsegment"].aggregate().to_df()
    return rows.select("c_custkey", F.array_join("c_mktsegment", ",").alias("segments"))


@_query("WITH c AS (SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) SELECT string_agg(coalesce(s, '-') || '=' || coalesce(n, '-'), ',' ORDER BY c_custkey) AS pairs FROM (SELECT c_custkey, s, CASE WHEN c_nationkey > 9 THEN c_nationkey::VARCHAR END AS n FROM c) WHERE s IS NOT NULL OR n IS NOT NULL UNION ALL SELECT NULL FROM c WHERE s IS NULL AND c_nationkey <= 9")
def aggregate_breadth(spark, sf_dir):
    """Lists of a text and a number, either of which may be null; customers with neither stay as they are."""
    rows = _gappy(spark, sf_dir).path(["c_custkey", "c_nationkey", "c_mktsegment"]).chain(lambda df: df.withColumn("c_nationkey", F.when(F.col("c_nationkey") > 9, F.col("c_nationkey"))))
    found = rows[:, ["c_mktsegment", "c_nationkey"]].aggregate().to_df()
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("-"))
    return found.select(F.array_join(F.transform("aggregated", lambda p: F.concat_ws("=", text(p[0]), text(p[1]))), ",").alias("pairs"))


@_query("SELECT NULL AS o_orderkey, string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS states FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'")
def aggregate_two_keys(spark, sf_dir):
    """The records are ordered by two columns."""
    rows = _table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    tree = DataTree.from_df(rows, ["o_orderdate", "o_orderkey"]).path(["o_orderkey", "o_orderstatus"])
    return tree[:, "o_orderstatus"].aggregate().to_df().select("o_orderkey", F.array_join("o_orderstatus", ",").alias("states"))


@_query("SELECT string_agg(name, ',' ORDER BY side, name) AS names FROM (SELECT 0 AS side, n_name AS name FROM nation UNION ALL SELECT 1, s_name FROM supplier)")
def aggregate_union(spark, sf_dir):
    """Two trees one after the other, each ordered by a text."""
    first, second = (DataTree.from_df(_table(spark, sf_dir, t).select(F.col(c).alias("name")), "name") for t, c in (("nation", "n_name"), ("supplier", "s_name")))
    return first.union(second)[:, "name"].aggregate().to_df().select(F.array_join("name", ",").alias("names"))


@_query("SELECT c_custkey, c_mktsegment AS seg FROM customer")
def add_path_same_rows(spark, sf_dir):
    tree = _tree(spark, sf_dir, "customer", "c_custkey")
    return tree.add_path("meta.seg", tree[:, "c_mktsegment"])[:, ["c_custkey", "meta.seg"]].to_df()


@_query("WITH f AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, o_totalprice AS other FROM f JOIN o USING (n)")
def add_path_zip(spark, sf_dir):
    tree = _tree(spark, sf_dir, "orders", "o_orderkey")[:, "o_orderstatus"]
    done, open_ = (tree.filter(native(lambda s, k=k: s == k)) for k in ("F", "O"))
    return done.add_path("other", open_[:, "o_totalprice"])[:, ["o_orderkey", "other"]].to_df()


@_query("SELECT o_orderstatus AS status, o_orderkey FROM orders")
def add_path_wrap(spark, sf_dir):
    tree = _tree(spark, sf_dir, "orders", "o_orderkey").path(["o_orderkey", "o_orderstatus"])
    wrapped = tree.add_path("..", tree[:, "o_orderstatus"]).to_df().withColumn("status", F.json_object_keys("record")[0])
    return wrapped.select("status", F.expr("get_json_object(record, '$.' || status || '.o_orderkey')").cast("long").alias("o_orderkey"))


# Lists


@_query("SELECT c_custkey, unnest([c_custkey, c_nationkey::BIGINT]) AS x FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 3 = 0")
def explode_lists(spark, sf_dir):
    items = F.when(F.col("c_custkey") % 3 == 1, F.array().cast("array<long>")).when(F.col("c_custkey") % 3 == 2, F.array("c_custkey", F.col("c_nationkey").cast("long")))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", items.alias("x"))
    return DataTree.from_df(rows, "c_custkey")[:, ["c_custkey", "x"]].explode().to_df()


@_query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10")
def head_rows(spark, sf_dir):
    return _tree(spark, sf_dir, "part", "p_partkey").head(10).path(["p_partkey", "p_name"]).to_df()


@_query("SELECT c_custkey, concat_ws(',', c_custkey, c_nationkey, 7) AS items FROM customer")
def flatten_lists(spark, sf_dir):
    nested = F.array(F.array(F.array("c_custkey", F.col("c_nationkey").cast("long"))), F.array(F.array(F.lit(7).cast("long"))))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", nested.alias("items"))
    flat = DataTree.from_df(rows, "c_custkey")[:, "items"].shallow(native(lambda x: flatten_column(x, 3)))
    return flat.to_df().withColumnRenamed("items", "x").select(F.col("x")[0].alias("c_custkey"), F.array_join("x", ",").alias("items"))


@_query("SELECT unnest(regexp_extract_all(text, '[a-z]{12,}')) AS tag, conv_id AS created FROM conversations WHERE text IS NOT NULL")
def flagship(spark, sf_dir):
    """Tags of feed items: a path through two lists, a null filter, flattened lists, without empty ones, a row for each tag."""
    tags = F.transform(F.regexp_extract_all("text", F.lit("[a-z]{12,}"), F.lit(0)), lambda w: F.struct(w.alias("tag")))
    said = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.when(F.col("turn") >= 0, tags).alias("features")).alias("f"))
    feed = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("f")).alias("facets")).select("conv_id", F.struct(F.struct("facets", F.col("conv_id").alias("created")).alias("record")).alias("post"))
    found = DataTree.from_df(feed, "conv_id").path(["post.record.facets.features.tag", "post.record.created"])
    flat = found[:, "tag"].not_(isna).shallow(native(lambda t: flatten_column(t, 2))).not_(native(lambda t: F.forall(t, lambda x: x.isNull())))
    return flat[:, ["tag", "created"]].explode()[:, "tag"].not_(isna)[:, ["tag", "created"]].to_df()


@_query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def group_chain(spark, sf_dir):
    """Paths, a null filter, groups and groups in groups."""
    found = _events(spark, sf_dir).path(["event_type", "props.k"])[:, "k"].not_(isna)
    nested = found[:, "event_type"].group_by()[:, "members.k"].group_by().to_df()
    return nested.select("event_type", F.explode("members").alias("g")).select("event_type", "g.k", F.size("g.members").cast("long").alias("n"))


@_query("SELECT unnest(regexp_extract_all(text, '[a-z]{12,}')) AS word, conv_id FROM conversations WHERE text IS NOT NULL")
def explode_words(spark, sf_dir):
    """Lists made by a native map, without null and empty ones, as a table."""
    rows = _tree(spark, sf_dir, "conversations", ["conv_id", "turn"]).path(["conv_id", "text"])
    words = rows[:, "text"].not_(isna).shallow(native(lambda t: F.regexp_extract_all(t, F.lit("[a-z]{12,}"), F.lit(0))))
    found = words.filter(native(lambda w: F.size(w) > 0))[:, ["conv_id", "text"]].explode()
    return found.to_df().select(F.col("text").alias("word"), "conv_id")


@_query("WITH e AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT k, unnest([k, -k]) AS x FROM e")
def explode_list_rows(spark, sf_dir):
    """Records that are lists, by position."""
    tree = files.json_column(_table(spark, sf_dir, "events"), "props", "event_id")
    found = tree.shallow(lambda r: [r["k"], [r["k"], -r["k"]]])[:, ["k", "x"]].explode().unproject().to_df()
    return found.select(*[F.get_json_object("record", f"$[{i}]").cast("long").alias(n) for i, n in enumerate("kx")])


# Records that differ in kind


def _mixed(spark: SparkSession, sf_dir: str) -> DataTree:
    """Records of three kinds made from events."""
    n = F.col("event_id") % 3
    made = F.when(n == 0, F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))).when(n == 1, F.to_json(F.struct(F.col("event_id").alias("id"), F.struct("value").alias("body")))).otherwise(F.to_json(F.struct("user_id", F.col("event_type").alias("tag"))))
    return files.json_column(_table(spark, sf_dir, "events").select("event_id", made.alias("j")), "j", "event_id")


@_query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS schema_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_id % 3) AS first FROM events)")
def schema_ids(spark, sf_dir):
    return _mixed(spark, sf_dir).schema_ids().select(F.col("__pos").alias("event_id"), "schema_id")


@_query("SELECT user_id, event_type AS tag FROM events WHERE event_id % 3 = 2")
def variant_rows(spark, sf_dir):
    tree = _mixed(spark, sf_dir)
    wanted = next(i for i, s in tree.schemas().items() if "tag" in s)
    return tree.variant(wanted).as_typed("user_id long, tag string").to_df()


@_query("SELECT event_id AS id, value FROM events WHERE event_id % 3 = 1")
def matching_rows(spark, sf_dir):
    return _mixed(spark, sf_dir).matching({"id": int, "body": {}}).as_typed("id long, body struct<value: double>")[:, ["id", "body.value"]].to_df()


@_query("SELECT CASE event_id % 3 WHEN 0 THEN event_type END AS kind, CASE WHEN event_id % 3 < 2 THEN event_id END AS id, CASE event_id % 3 WHEN 2 THEN event_type END AS tag FROM events")
def mixed_paths(spark, sf_dir):
    return _mixed(spark, sf_dir).path(["kind", "id", "tag"]).as_typed("kind string, id long, tag string").to_df()


@_query("SELECT CASE event_id % 3 WHEN 0 THEN event_type END AS kind, count(*) AS n FROM events GROUP BY ALL")
def mixed_group(spark, sf_dir):
    """Sizes of a few groups that grow with the table, so their records aren't collected."""
    groups = _mixed(spark, sf_dir)[:, "kind"].summarize({"n": F.count(F.lit(1))})
    return groups.as_typed("kind string, n long").to_df()


@_query("SELECT conv_id, count(*) AS n, string_agg(coalesce(role, '-'), ',' ORDER BY role NULLS FIRST) AS roles FROM conversations GROUP BY conv_id")
def record_groups(spark, sf_dir):
    """JSON records in groups that don't grow with the table."""
    rows = _table(spark, sf_dir, "conversations").select("turn", F.to_json(F.struct("conv_id", "turn", "role")).alias("j"))
    groups = files.json_column(rows, "j", "turn")[:, "conv_id"].group_by().as_typed("conv_id long, members array<struct<role: string>>").to_df()
    roles = F.transform(F.sort_array("members.role"), lambda r: F.coalesce(r, F.lit("-")))
    return groups.select("conv_id", F.size("members").cast("long").alias("n"), F.array_join(roles, ",").alias("roles"))


@_query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_filter(spark, sf_dir):
    tree = files.json_column(_table(spark, sf_dir, "events"), "props", "event_id")
    return tree[:, "k"].shallow(lambda k: k is not None and k > 50).to_df().select(F.col("k").cast("long").alias("k"))


@_query("SELECT o_orderkey, o_orderstatus, CAST(NULL AS DOUBLE) AS o_margin FROM orders")
def project_schema(spark, sf_dir):
    wanted = Schema(o_orderkey=Leaf(PrimitiveType(int)), o_orderstatus=Leaf(PrimitiveType(str))) + {"o_margin": float}
    return _tree(spark, sf_dir, "orders", "o_orderkey")[:].project(wanted).to_df()


def _talks(spark: SparkSession, sf_dir: str) -> DataTree:
    """Conversations as JSON records with a list of turns; a role may be null."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return files.json_column(rows.select("conv_id", F.to_json(F.struct("conv_id", F.struct("turns").alias("said"))).alias("j")), "j", "conv_id")


@_query("SELECT conv_id, string_agg(coalesce(role, '-'), ',' ORDER BY turn, role NULLS FIRST) AS roles FROM conversations GROUP BY conv_id")
def record_list_cross(spark, sf_dir):
    """A path through a list that only the records know of."""
    found = _talks(spark, sf_dir)[:, ["conv_id", "said.turns.role"]].to_df()
    roles = F.transform(found["role"].cast("array<string>"), lambda r: F.coalesce(r, F.lit("-")))
    return found.select(found["conv_id"].cast("long").alias("conv_id"), F.array_join(roles, ",").alias("roles"))


@_query("SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def record_add_list(spark, sf_dir):
    """What such a path leads to, as a field of each record."""
    tree = _talks(spark, sf_dir)
    found = tree.add_path("about.turns", tree[:, "said.turns.turn"]).as_typed("conv_id long, about struct<turns: array<long>>").to_df()
    return found.select("conv_id", F.array_join(F.col("about.turns").cast("array<string>"), ",").alias("turns"))


@_query("SELECT n_nationkey, n_name FROM nation")
def memory_records(spark, sf_dir):
    """Records from a list and from an iterator, one after the other."""
    held = [r.asDict() for r in _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows at any scale
    tree = DataTree(held[:12], spark=spark).union(DataTree(iter(held[12:]), True, spark))
    return tree.path(["n_nationkey", "n_name"]).as_typed("n_nationkey int, n_name string").to_df()


def nation_pages(options: dict[str, str]) -> Callable:
    """The nations, 25 at any scale, as a paged interface."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{options['dir']}/nation.parquet", columns=["n_nationkey", "n_name"]).to_pylist()

    def fetch(cursor: str | None, limit: int) -> dict:
        upto = int(cursor or 0) + limit
        return {"items": rows[upto - limit : upto], "cursor": str(upto) if upto < len(rows) else None}

    return fetch


@_query("SELECT n_nationkey, n_name FROM nation")
def paged_source(spark, sf_dir):
    """All items of all pages, seven a page."""
    ship_code(spark)
    spark.dataSource.register(paged.PagedSource)
    rows = spark.read.format("paged").option("fetch", "boughs.queries:nation_pages").option("dir", sf_dir).option("limit", 7).load()
    return DataTree.from_df(rows).path(["n_nationkey", "n_name"]).as_typed("n_nationkey int, n_name string").to_df()


@_query("SELECT r_regionkey, r_name FROM region")
def aggregate_nothing(spark, sf_dir):
    """Without a projection, and with one that leads nowhere, aggregate changes nothing."""
    tree = _tree(spark, sf_dir, "region", "r_regionkey")
    return tree.aggregate()[:, "nowhere"].aggregate().path(["r_regionkey", "r_name"]).to_df()


@_query("SELECT event_id AS id, event_type AS kind, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events")
def json_lines_files(spark, sf_dir):
    """JSON records written to files, read back in their order."""
    folder = f"{shared_folder(spark)}/json-lines-{uuid.uuid4().hex}"
    wanted = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind")).orderBy("event_id")
    wanted.select(F.to_json(F.struct(F.col("event_id").alias("id"), "kind")).alias("value")).write.text(folder)
    return files.json_lines(spark, folder).as_typed("id long, kind string").numbered("place")


@_query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 2 AND user_id % 2 = 0")
def matching_predicate(spark, sf_dir):
    """Records whose field is a member of a type given by a predicate."""
    even = FunctionType(lambda u: isinstance(u, int) and u % 2 == 0)
    found = _mixed(spark, sf_dir).matching({"user_id": even})
    return found.df.select(F.col("__pos").alias("event_id"), F.get_json_object("__doc", "$.user_id").cast("long").alias("user_id"))


# Several trees


@_query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect_trees(spark, sf_dir):
    rich = DataTree.from_df(_table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"), "c_custkey")
    done = DataTree.from_df(_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return rich.intersect(done).to_df()


@_query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def subtract_trees(spark, sf_dir):
    rich = DataTree.from_df(_table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"), "c_custkey")
    done = DataTree.from_df(_table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return rich.subtract(done).to_df()


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sorted_top(spark, sf_dir):
    """The first records in another order."""
    rows = _tree(spark, sf_dir, "orders", "o_orderkey")[:, ["o_totalprice", "o_orderkey"]].sort(descending=[True, False])
    return rows.head(20).path(["o_orderkey", "o_totalprice"]).to_df()


@_query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 10")
def sql_view(spark, sf_dir):
    """A tree as a view that SQL reads."""
    return _tree(spark, sf_dir, "orders", "o_orderkey").sql("SELECT o_orderpriority, count(*) AS n FROM {tree} GROUP BY ALL HAVING count(*) > 10")


@_query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_inner(spark, sf_dir):
    customers = DataTree.from_df(_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return _tree(spark, sf_dir, "orders", "o_orderkey").merge(customers, "o_custkey").path(["o_orderkey", "c_name"]).to_df()


@_query("SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id)")
def merge_left(spark, sf_dir):
    labels = _tree(spark, sf_dir, "labels", "doc_id")
    return _tree(spark, sf_dir, "documents", "doc_id").merge(labels, "doc_id", "left").path(["doc_id", "source", "quality"]).to_df()


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def merge_anti(spark, sf_dir):
    orders = DataTree.from_df(_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), "o_orderkey")
    return _tree(spark, sf_dir, "customer", "c_custkey").merge(orders, "c_custkey", "anti").path(["c_custkey"]).to_df()


@_query("SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def union_trees(spark, sf_dir):
    nations = DataTree.from_df(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "name")
    regions = DataTree.from_df(_table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "name")
    return nations.union(regions).to_df()


# Streams


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click' OR value > 50")
def stream_filter(spark, sf_dir):
    rows = streaming.read(spark, sf_dir, "events.parquet", _table(spark, sf_dir, "events").schema, "event_id")
    shaped = rows.chain(lambda df: df.withColumn("props", F.from_json("props", "k long")))
    found = shaped.filter((F.col("event_type") == "click") | (F.col("value") > 50)).path(["event_id", "props.k"])
    return streaming.run_once(found, "stream-filter")


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    rows = streaming.read(spark, sf_dir, "events.parquet", _table(spark, sf_dir, "events").schema, "event_id")
    counted = streaming.windowed(rows[:, "event_type"], "ts", "1 hour", {"n": F.count(F.lit(1))})
    return streaming.run_complete(counted, spark).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
