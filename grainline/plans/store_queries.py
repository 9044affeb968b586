"""Queries over the whole life of a store: encode, archive, restore, walk, fetch attributes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainline.runtime import shared_dir

from . import store
from .base import E_SQL, edges, table

QUERIES, SQL = {}, {}


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("P"), "p_partkey").alias("key"), "p_name", "p_brand")


def _archived(spark, sf, model="order_k"):
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.encode(edges(spark, sf), _parts(spark, sf), path, model=model, edge_columns=("w",), vertex_columns=("p_name", "p_brand"))
    return path


def store_backward(spark, sf):
    """Lines that hold a part and the customers' edges to their orders, from an encoded archive of every edge."""
    start = edges(spark, sf).where("src LIKE 'O%'").agg(F.min_by("dst", "eid")).first()[0]
    found, _ = store.query(spark, _archived(spark, sf), [start], 10**6, backward=True)
    return found.select("eid", F.col("dst_key").alias("src"), F.col("src_key").alias("dst"), "w")


def store_forward(spark, sf):
    """Orders of a customer and their parts by name, from an encoded archive of every edge."""
    start = edges(spark, sf).agg(F.min_by("src", "eid")).first()[0]
    _, nodes = store.query(spark, _archived(spark, sf), [start], 10**6)
    return nodes.select("key", "p_name", "p_brand")


def store_bytes(spark, sf):
    """Files and bytes of an archive of every edge, by table and in all."""
    return store.sizes(spark, _archived(spark, sf))


QUERIES |= {"store_backward": store_backward, "store_forward": store_forward, "store_bytes": store_bytes}
SQL["store_backward"] = f"""WITH {E_SQL}, L AS (SELECT * FROM E WHERE src LIKE 'O%' AND dst = (SELECT arg_min(dst, eid) FROM E WHERE src LIKE 'O%'))
    SELECT eid, src, dst, w FROM L UNION ALL SELECT c.eid, c.src, c.dst, c.w FROM L JOIN E c ON c.dst = L.src"""
SQL["store_forward"] = f"""WITH {E_SQL}, C AS (SELECT dst FROM E WHERE src = (SELECT arg_min(src, eid) FROM E)),
    N AS (SELECT dst AS key FROM C UNION SELECT E.dst FROM C JOIN E ON E.src = C.dst) SELECT key, p_name, p_brand FROM N LEFT JOIN part ON key = 'P' || p_partkey"""
