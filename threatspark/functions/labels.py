"""Label, rule and decision expressions.

Everything is a built-in column expression, so it stays inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import q

# Fixed values that must equal the reference's.
BENIGN = "BENIGN"
NORMAL, ATTACK = "Normal", "Attack"
TRAFFIC_TYPE = "traffic type"
TRAFFIC_CODES = {"Normal": 0, "Attack": 1}
PHISHING_TARGET_CODES = {-1: 0, 1: 1}
# Source-port rule of the packet monitor (inclusive bounds).
BENIGN_PORTS = (1000, 5000)
ATTACK_PORTS = (5001, 10000)
# Suspicion rules of the inference check: (column, operator, bound, message format).
SUSPICION_RULES = [
    ("SYN Flag Count", ">", 100, "High SYN Count: %s (Possible SYN Flood)"),
    ("RST Flag Count", ">", 100, "High RST Count: %s (Possible RST Flood)"),
    ("Flow Bytes/s", ">", 10000, "High Flow Rate: %.2f bytes/s"),
    ("Flow IAT Min", "<", 0.0001, "Very small Inter-Arrival Time: %s"),
]
DECISION_THRESHOLD = 0.5


def binary_label(df: DataFrame, label: str = "Label", out: str = TRAFFIC_TYPE) -> DataFrame:
    """P10: 'BENIGN' -> 'Normal'; every other value, null included -> 'Attack'."""
    return df.withColumn(out, F.when(q(label).eqNullSafe(F.lit(BENIGN)), F.lit(NORMAL))
                         .otherwise(F.lit(ATTACK)))


def binary_label_int(df: DataFrame, label: str = "Label", out: str = TRAFFIC_TYPE) -> DataFrame:
    """Scoring side. If ``label`` exists: non-BENIGN -> 1, BENIGN -> 0, drop it."""
    if label not in df.columns:
        return df
    return df.withColumn(out, F.when(q(label).eqNullSafe(F.lit(BENIGN)), F.lit(0))
                         .otherwise(F.lit(1))).drop(label)


def map_values_expr(c: Column, mapping: Mapping) -> Column:
    """Value lookup; a value outside ``mapping`` (or null) gives null."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr


def map_values(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, map_values_expr(q(col), mapping))


def port_class_expr(port: Column) -> Column:
    """P19: 'benign' for 1000-5000, 'attack' for 5001-10000, null otherwise."""
    return (F.when(port.between(*BENIGN_PORTS), F.lit("benign"))
            .when(port.between(*ATTACK_PORTS), F.lit("attack")))


def classify_port(df: DataFrame, port: str = "sport", out: str = "class") -> DataFrame:
    """Class by source port; packets outside both ranges are discarded."""
    return df.withColumn(out, port_class_expr(q(port))).where(F.col(out).isNotNull())


def filter_tcp_host(df: DataFrame, host: str = "127.0.0.1", proto: str = "proto",
                    src: str | None = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """P20: TCP packets to or from ``host`` (the capture filter)."""
    cond = q(dst) == F.lit(host)
    if src and src in df.columns:
        cond = cond | (q(src) == F.lit(host))
    return df.where((q(proto) == F.lit("tcp")) & cond)


def indicators_expr(rules=SUSPICION_RULES) -> Column:
    """Array of messages, one per rule that fires (empty when none)."""
    parts = []
    for col, op, bound, fmt in rules:
        x = q(col)
        cond = x > F.lit(bound) if op == ">" else x < F.lit(bound)
        shown = x if "%.2f" in fmt else x.cast("string")
        parts.append(F.when(cond, F.format_string(fmt, shown)))
    return F.array_compact(F.array(*parts))


def indicators(df: DataFrame, out: str = "indicators") -> DataFrame:
    return df.withColumn(out, indicators_expr())


def decide_expr(p: Column, threshold: float = DECISION_THRESHOLD) -> Column:
    """Strictly greater than the threshold -> 1; null for a null or NaN score
    (Spark orders NaN above every number, so it must not reach the comparison)."""
    return F.when(~F.isnan(p), (p > F.lit(threshold)).cast("int"))


def verdict_expr(p: Column, threshold: float = DECISION_THRESHOLD) -> Column:
    d = decide_expr(p, threshold)
    return F.when(d == 1, F.lit("Malicious")).when(d == 0, F.lit("Benign"))


def pct_expr(p: Column) -> Column:
    """Probability as a percentage with two decimals, e.g. '42.17%'."""
    return F.format_string("%.2f%%", p * F.lit(100.0))
