import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from edgewise.session import local_session
    s = local_session(cores="4", shuffle_partitions=4, driver_memory="4g", app="edgewise-tests")
    yield s
    s.stop()


def make_graph(spark, edges, vertices=None, id_type="bigint"):
    """Graph from Python lists; vertices default to the edge endpoints."""
    from edgewise.graph import Graph
    e = spark.createDataFrame(edges, f"src {id_type}, dst {id_type}")
    if vertices is None:
        return Graph.from_edges(e)
    v = spark.createDataFrame([(x,) for x in vertices], f"id {id_type}")
    return Graph(v, e)


def as_dict(df, key="id", value=None):
    cols = df.columns
    value = value or [c for c in cols if c != key][0]
    return {r[key]: r[value] for r in df.collect()}
