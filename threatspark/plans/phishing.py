"""Phishing plans: ARFF table -> feature ranking, and -> tuned classifier.

Feature ranking: decode (P14), drop incomplete rows (P16), one-hot with the
first category dropped (T6), trimmed names with a required target (P7),
80/20 split (K3), standardise on the train part (T5), boosted trees (M5),
split counts per feature (M6, J5).

Model: numeric cast (P15), the nine best base features (L4 / P4), target
-1/1 -> 0/1 (P13), 80/20 split (K3), random search with 5-fold CV over a
scaler + boosted-trees pipeline (M7), accuracy and report on the test part
(A12, A11), saved model (S13).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import labels as L
from ..operators import importance as I
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import sampling as S
from ..operators.transforms import apply_standardize, dummies, fit_standardize

# Fixed values of the reference.
TARGET = "Result"
TARGET_DUMMY = "Result_1"
SPLIT_SEED = 42


def with_key(df: DataFrame, key: str = "row_id") -> DataFrame:
    return df if key in df.columns else df.withColumn(key, F.monotonically_increasing_id())


def rank_features(df: DataFrame, key: str = "row_id", rounds: int = I.BOOST_ROUNDS) -> DataFrame:
    """Split-count importance of the one-hot features (Feature, Importance)."""
    df = with_key(C.drop_null_rows(C.decode_bytes(df)), key)
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    d = C.normalize_columns(dummies(df, text, drop_first=True), required=[TARGET_DUMMY])
    feats = [c for c in d.columns if c not in (key, TARGET_DUMMY)]
    split = S.train_test(d, [key], SPLIT_SEED, test=0.2)
    train = split.where("is_train")
    st = fit_standardize(train, feats)
    model = I.boosted_fit(apply_standardize(train, st), feats, TARGET_DUMMY, rounds=rounds)
    return model.split_counts(df.sparkSession)


def train_model(df: DataFrame, top: Sequence[str], key: str = "row_id", **search):
    """Random-searched boosted trees on the ``top`` base features.
    Returns (the search, test report, test accuracy)."""
    df = with_key(C.to_numeric(C.decode_bytes(df), [*top, TARGET]), key)
    d = C.select_features(df, [key, *top, TARGET])
    d = L.map_values(d, TARGET, L.PHISHING_TARGET_CODES, out="label")
    split = S.train_test(d, [key], SPLIT_SEED, test=0.2)
    k = search.pop("folds", MD.SEARCH_FOLDS)
    train = S.stratified_folds(split.where("is_train"), "label", [key], k, seed=SPLIT_SEED)
    found = MD.random_search(train, list(top), "label", fold="fold", folds=k, **search)
    test = found.best.score(split.where("NOT is_train").withColumn("label", F.col("label").cast("double")))
    test = test.withColumn("prediction", (F.col("p") > 0.5).cast("double"))
    return found, M.classification_report(test), M.accuracy(test).first()[0]
