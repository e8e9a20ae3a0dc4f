"""Results do not depend on shuffle partitions or input partitioning."""
import math

import pytest

import __spark_entry__ as E
from conftest import SF001

NAMES = ["flow_folds", "flow_train_test", "flow_quantile_transform", "score_auc",
         "early_stop", "graph_propagate", "malware_minmax", "score_report"]


def _rows(df):
    out = []
    for r in df.collect():
        out.append(tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x
                         for x in r))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_same_result_with_other_shuffle_partitions(spark, name):
    q = E.queries()[name]
    a = _rows(q(spark, SF001))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = _rows(q(spark, SF001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert a == b
