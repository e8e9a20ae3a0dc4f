"""Malware plans: two labelled inputs -> one normalised table -> graph nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from ..operators import importance as I
from ..operators import sampling as S
from ..operators.transforms import apply_impute_minmax, fit_impute_minmax

LABEL = "Label"


def union_labelled(attack: DataFrame, normal: DataFrame, label: str = LABEL) -> DataFrame:
    """P18 + U1: label attack rows 1 and normal rows 0, union by name,
    columns absent on one side are null there."""
    return C.with_constant(attack, label, 1).unionByName(
        C.with_constant(normal, label, 0), allowMissingColumns=True)


def normalise(df: DataFrame, exclude: Sequence[str] = (), fit_rows: DataFrame | None = None
              ) -> DataFrame:
    """T1 + T2 in one pass: mean imputation then min-max of every numeric
    column, the label included (0/1 stays 0/1). The statistics come from all
    rows (as in the reference) or from ``fit_rows`` (e.g. the training part)."""
    cols = C.numeric_columns(df, exclude)
    return apply_impute_minmax(df, fit_impute_minmax(df if fit_rows is None else fit_rows, cols))


def rank_features(norm: DataFrame, key_cols: Sequence[str], label: str = LABEL,
                  seed=42, keep_above: float = I.MALWARE_IMPORTANCE_KEEP_ABOVE, **forest) -> DataFrame:
    """M2 + M3: forest importance on the 80 % training part, keep > 0.01."""
    split = S.train_test(norm, key_cols, seed, test=0.2)
    feats = [c for c in C.numeric_columns(norm) if c not in (*key_cols, label)]
    train = split.where("is_train").withColumn(label, C.q(label).cast("string"))
    imp = I.forest_importance(train, feats, label, seed=seed, decimals=10, key_cols=key_cols, **forest)
    return I.prune_by_importance(imp, above=keep_above)


def graph_nodes(norm: DataFrame, features: Sequence[str], row_id: str, label: str = LABEL,
                chunk: int = G.CHUNK_ROWS) -> DataFrame:
    """Node table with chunk ids and per-chunk masks."""
    return G.build_graph(norm, features, row_id, label, chunk)


def run_malware_preprocess(spark, attack_path: str, normal_path: str, out_dir: str,
                           key: str = "row_id", seed=42, fit_on: str = "all") -> list[str]:
    """The malware preprocessing script end to end: both class files (S3),
    label + union (P18, U1), mean imputation + min-max in one pass (T1, T2;
    ``fit_on='train'`` takes the statistics from the training part only),
    forest importance on the 80 % part, keep > 0.01 (M2, M3), then the
    important features (S7) and the normalised table (S8) are written."""
    from ..sources.readers import read_two_class, write_csv
    from .flow import with_row_id
    attack, normal = read_two_class(spark, attack_path, normal_path)
    df = with_row_id(union_labelled(attack, normal), key)
    if fit_on == "train":      # statistics from the 80 % part the ranking trains on
        fit_rows = S.train_test(df, [key], seed, test=0.2).where("is_train").drop("is_train")
    elif fit_on == "all":
        fit_rows = None
    else:
        raise ValueError(f"fit_on must be 'all' or 'train', got {fit_on!r}")
    norm = normalise(df, exclude=[key], fit_rows=fit_rows)
    norm = norm.checkpoint(eager=True)       # reused by the ranking and the writes
    imp = rank_features(norm.na.fill(0.0), [key], seed=seed)
    imp.coalesce(1).write.mode("overwrite").option("header", True) \
       .csv(f"{out_dir}/important_features")
    write_csv(norm, f"{out_dir}/processed_data")
    return [r[0] for r in imp.orderBy(F.col("Importance").desc(), "Feature").collect()]


def run_graph_build(spark, processed: DataFrame, features: Sequence[str], out: str,
                    row_id: str = "row_id", label: str = LABEL,
                    chunk: int = G.CHUNK_ROWS) -> DataFrame:
    """The graph script: node table with chunk ids and masks (M14) written as
    parquet; the chunks' complete graphs stay implicit (see graph module)."""
    nodes = graph_nodes(processed, features, row_id, label, chunk)
    nodes.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
