"""Queries of the label algebra."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwave.functions import labels
from loomwave.operators import joins, labelled
from loomwave.operators.sorted_scan import carried
from loomwave.plans.signals import _EL, long, packed, r6
from loomwave.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_PL = "pl AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT event_type FROM events))"


@query(f"WITH {_PL}, pu AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS place FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN (SELECT event_type FROM pl WHERE place >= n - 3))) SELECT event_id FROM events JOIN pl USING (event_type) JOIN pu USING (user_id) WHERE pl.place >= n - 3 AND pu.place BETWEEN 10 AND 99 AND (pu.place - 10) % 3 = 0")
def slice_labels(spark, d):
    return labelled.select(table(spark, d, "events"), event_type=slice(-3, None), user_id=slice(10, 100, 3)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND value > 40 AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def select_lists_and_masks(spark, d):
    return labelled.select(table(spark, d, "events"), event_type=["view", "click"], value=F.col("value") > 40, user_id=(1, 2, 3, 5, 8, 13, 21, 34, 55, 89)).select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN 0 ELSE value END AS value FROM events")
def assign_region(spark, d):
    return labelled.assign(table(spark, d, "events"), (F.col("event_type") == "error") & (F.col("value") > 100), "value", F.lit(0.0)).select("event_id", "value")


@query(f"WITH {_PL}, w AS (SELECT unnest([-1, 0, 2, 0]) AS w, unnest([0, 1, 2, 3]) AS i) SELECT CAST(i AS BIGINT) AS i, event_id FROM events JOIN pl USING (event_type) JOIN w ON place = (w + n) % n")
def take_places(spark, d):
    return labelled.take(table(spark, d, "events").select("event_type", "event_id"), "event_type", [-1, 0, 2, 0], out="i").select("i", "event_id")


@query("WITH w AS (SELECT unnest(['view', 'error', 'view']) AS event_type, unnest([0, 1, 2]) AS i) SELECT CAST(i AS BIGINT) AS i, event_id FROM events JOIN w USING (event_type)")
def take_labels(spark, d):
    return labelled.take(table(spark, d, "events").select("event_type", "event_id"), "event_type", ["view", "error", "view"], "label", "i").select("i", "event_id")


@query("WITH p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)) SELECT o_orderpriority, place FROM p WHERE CASE WHEN (SELECT count(*) FROM p WHERE o_orderpriority = 'HIGH') > 0 THEN o_orderpriority = 'HIGH' ELSE list_contains(string_split(o_orderpriority, '-'), 'HIGH') END")
def find_places(spark, d):
    return labelled.find(table(spark, d, "orders"), "o_orderpriority", "HIGH").select("o_orderpriority", "place")


@query("SELECT event_id, CAST(n_nationkey AS BIGINT) AS place FROM events JOIN nation ON user_id = n_nationkey * 3")
def reorder_by_table(spark, d):
    wanted = table(spark, d, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("user_id"), F.col("n_nationkey").cast("long").alias("place"))
    return labelled.reorder_like(table(spark, d, "events"), "user_id", wanted, "place").select("event_id", "place")


@query(f"""WITH {_EL}, a AS (SELECT trial, t, v FROM el WHERE trial < 20 AND t < 40), b AS (SELECT trial - 20 AS trial, t, v FROM el WHERE trial BETWEEN 20 AND 49), s AS (SELECT trial, t, v FROM a UNION ALL SELECT trial + 20, t, v FROM b)
SELECT g.trial, g.t, round(v, 6) + 0.0 AS v FROM (SELECT x.trial, y.t FROM (SELECT unnest(range(50)) AS trial) x, (SELECT unnest(range(64)) AS t) y) g LEFT JOIN s ON s.trial = g.trial AND s.t = g.t""")
def concatenate_places(spark, d):
    el = long(spark, d).select("trial", "t", "v")
    out = labelled.concatenate_positional([el.where("trial < 20 and t < 40"), el.where("false"), el.where("trial between 20 and 49").withColumn("trial", F.col("trial") - 20)], "trial", ["t"], "v")
    return out.select("trial", "t", r6("v").alias("v"))


@query("SELECT 'short' AS part, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT 'long', l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40")
def stack_parts(spark, d):
    li = table(spark, d, "lineitem")
    return labelled.stack({"short": li.where("l_quantity < 10"), "long": li.where("l_quantity > 40")}, "part").select("part", "l_orderkey", "l_linenumber")


@query("SELECT true AS same, false AS moved, false AS shorter")
def equal_arrays(spark, d):
    el = long(spark, d).select("trial", "t", F.when(F.col("t") != 5, F.col("v")).alias("v"))
    parts = [("same", el), ("moved", labelled.assign(el, (F.col("trial") == 3) & (F.col("t") == 7), "v", F.lit(9.0))), ("shorter", el.where("trial > 0"))]
    rows = [labelled.equal(el, other, ["trial", "t"], "v").withColumnRenamed("equal", name) for name, other in parts]
    return rows[0].join(F.broadcast(rows[1])).join(F.broadcast(rows[2]))


@query("SELECT n_name, r_name, n_name || '-' || r_name AS label FROM nation, region")
def outer_labels(spark, d):
    return labelled.outer_labels(table(spark, d, "nation"), table(spark, d, "region"), "n_name", "r_name", "label")


@query("SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS label FROM lineitem")
def joined_labels(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", labelled.joined_labels(["l_returnflag", "l_linestatus"]).alias("label"))


@query(f"WITH {_EL} SELECT trial, t % 16 AS r, t // 16 AS c, round(v, 6) + 0.0 AS v FROM el")
def transpose_matrix(spark, d):
    m = packed(spark, d).select("trial", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("values", i * 16 + 1, 16)).alias("m"))
    rows = m.select("trial", F.posexplode(labelled.transpose("m")).alias("r", "row")).select("trial", "r", F.posexplode("row").alias("c", "v"))
    return rows.select("trial", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), r6("v").alias("v"))


@query(f"WITH {_EL} SELECT trial, t, round(v, 6) + 0.0 AS v FROM el")
def flatten_lists(spark, d):
    m = packed(spark, d).select("trial", F.array(F.slice("values", 1, 10), F.slice("values", 11, 54)).alias("m"))
    flat = m.select("trial", F.posexplode(labelled.flatten_once("m")).alias("t", "v"))
    return flat.select("trial", F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query("SELECT p_partkey, (p_size % 3 + 1 = p_partkey % 3 + 1 OR p_size % 3 = 0 OR p_partkey % 3 = 0) AS fits FROM part")
def broadcastable_shapes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array(F.lit(4), F.col("p_size") % 3 + 1).alias("a"), F.array(F.lit(4), (F.col("p_partkey") % 3 + 1).cast("int"), F.lit(7)).alias("b"))
    return p.select("p_partkey", labelled.broadcastable("a", "b").alias("fits"))


@query("SELECT s_suppkey, array_to_string(CASE s_suppkey % 3 WHEN 0 THEN ['b', 'a', 'c'] WHEN 1 THEN ['b', 'a', 'x', 'c'] ELSE ['b', 'a'] END, '|') AS names FROM supplier")
def ordered_unions(spark, d):
    k = F.col("s_suppkey") % 3
    letters = lambda x: F.array(*map(F.lit, x))
    s = table(spark, d, "supplier").select("s_suppkey", letters("ba").alias("a"), F.when(k == 0, letters("abc")).when(k == 1, letters("xbcx")).otherwise(letters("ab")).alias("b"))
    return s.select("s_suppkey", F.array_join(labelled.ordered_union("a", "b"), "|").alias("names"))


@query("SELECT event_id, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shank FROM events")
def shank_numbers(spark, d):
    ev = table(spark, d, "events").select("event_id", (F.col("event_id") % 7 + 1).alias("contact")).withColumn("first", (F.col("contact") == 1).cast("long"))
    counted = carried(ev, [], ["event_id"], sums={"running": "first"})
    return counted.select("event_id", labelled.shank_numbers("contact", "running").alias("shank"))


@query("SELECT l_orderkey, l_linenumber, ceil(round(l_extendedprice / 100, 9)) * 100.0::DOUBLE AS up, round(l_extendedprice - trunc(l_extendedprice), 6)::DOUBLE AS rest FROM lineitem")
def round_up_prices(spark, d):
    price = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", labelled.round_up(price, 100.0).alias("up"), F.round(labelled.fractional(price), 6).alias("rest"))


@query("SELECT l_returnflag, 'x' AS shared FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def shared_parts(spark, d):
    lists = table(spark, d, "lineitem").select("l_returnflag", F.concat_ws("-", F.lit("x"), "l_linestatus", F.col("l_linenumber").cast("string")).alias("label")).groupBy("l_returnflag").agg(F.collect_set("label").alias("labels"))
    return lists.select("l_returnflag", F.array_join(labelled.decompose("labels"), "-").alias("shared"))


@query("""WITH e AS (SELECT user_id % 4 AS ch, event_id % 50 AS trial, CASE WHEN event_type <> 'error' THEN value END AS v, event_id FROM events), k AS (SELECT trial FROM e WHERE v IS NOT NULL GROUP BY trial HAVING count(DISTINCT ch) = (SELECT count(DISTINCT ch) FROM e))
SELECT event_id FROM e WHERE trial IN (SELECT trial FROM k)""")
def trials_of_all_channels(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("ch"), (F.col("event_id") % 50).alias("trial"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"), "event_id")
    return labelled.common_over(e, "ch", "trial", "v").select("event_id")


_LAB = "l AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Left-White-Matter' WHEN 1 THEN 'Unknown' WHEN 2 THEN n_name || ' Gyrus' ELSE n_name || ' sulcus' END AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _anatomy(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    return s.select("s_suppkey", F.when(k == 0, "Left-White-Matter").when(k == 1, "Unknown").when(k == 2, F.concat("n_name", F.lit(" Gyrus"))).otherwise(F.concat("n_name", F.lit(" sulcus"))).alias("label"))


@query(f"WITH {_LAB} SELECT s_suppkey FROM l WHERE label NOT LIKE '%White-Matter%' AND label NOT LIKE '%nknown%'")
def grey_matter_channels(spark, d):
    return labelled.grey_matter(_anatomy(spark, d), "label", labels.NO_GREY).select("s_suppkey")


@query(f"WITH {_LAB} SELECT s_suppkey FROM l WHERE lower(label) LIKE '%gyrus%' OR lower(label) LIKE '%unknown%'")
def channels_in_regions(spark, d):
    return labelled.in_region(_anatomy(spark, d), "label", ["gyrus", "UNKNOWN"]).select("s_suppkey")


@query("""WITH r AS (SELECT event_type, user_id % 6 AS s, row_number() OVER (PARTITION BY event_type, user_id % 6 ORDER BY event_id) AS rank, value FROM events), m AS (SELECT event_type, max(rank) AS most FROM r GROUP BY event_type),
g AS (SELECT DISTINCT event_type, s, unnest(range(1, most + 1)) AS rank FROM r JOIN m USING (event_type)) SELECT g.event_type, g.s, g.rank, coalesce(value, 0) AS value FROM g LEFT JOIN r USING (event_type, s, rank)""")
def pool_padded_trials(spark, d):
    ev = table(spark, d, "events").select("event_type", (F.col("user_id") % 6).alias("s"), "event_id", "value")
    ranked = joins.pool_repeats(ev, "event_type", "s", F.col("event_id"), "max")
    return labelled.padded_pool(ranked, "event_type", "s", "rank", "value").select("event_type", "s", "rank", "value")
