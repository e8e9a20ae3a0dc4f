"""The flow and malware steps as stages of one ``Pipeline``.

Each step has params, and what it learns is a param too (as JSON), so a fitted ``PipelineModel`` that
starts from raw rows and ends in a score is one object: ``save`` writes all of it, ``PipelineModel.load`` brings
it back, in another session too. Steps work on what is there: a column that a batch lacks is passed over,
so rows to score need no label.

* ``InfinitiesToNull``      P17
* ``DropColumns``           P1, P3 by name
* ``DropZeroColumns``       P2, decided at fit
* ``LabelToInt``            P11
* ``ImputeMean``            T1, and with ``scale`` T2 (min-max), fitted
* ``QuantileScale``         T3, T4, fitted
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import labels as L
from .transforms import MinMaxState, QuantileModel, apply_impute_minmax, fit_impute_minmax

TEXT, TEXTS, WHOLE, FLAG = (TypeConverters.toString, TypeConverters.toListString, TypeConverters.toInt, TypeConverters.toBoolean)


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    pass


class InfinitiesToNull(Transformer, _Saved):
    """Infinities and NaN become null."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return C.inf_to_null(df)


class DropColumns(Transformer, _Saved):
    """Drops the named columns that are there."""
    names = Param(Params._dummy(), "names", "columns to drop", TEXTS)

    @keyword_only
    def __init__(self, *, names: Sequence[str] = ()):
        super().__init__()
        self._set(names=list(names))

    def _transform(self, df: DataFrame) -> DataFrame:
        return C.drop_columns(df, self.getOrDefault(self.names))


class DropZeroColumns(Estimator, _Saved):
    """Finds the numeric columns whose every value is 0; the model drops them."""
    keep = Param(Params._dummy(), "keep", "columns that stay in any case", TEXTS)

    @keyword_only
    def __init__(self, *, keep: Sequence[str] = ()):
        super().__init__()
        self._set(keep=list(keep))

    def _fit(self, df: DataFrame) -> DropColumns:
        return DropColumns(names=C.zero_columns(df.drop(*self.getOrDefault(self.keep))))


class LabelToInt(Transformer, _Saved):
    """A text label to 0 (benign) and 1; rows without the column pass."""
    label = Param(Params._dummy(), "label", "text column", TEXT)
    out = Param(Params._dummy(), "out", "column of 0 and 1", TEXT)

    @keyword_only
    def __init__(self, *, label: str = "Label", out: str = L.TRAFFIC_TYPE):
        super().__init__()
        self._set(label=label, out=out)

    def _transform(self, df: DataFrame) -> DataFrame:
        return L.binary_label_int(df, self.getOrDefault(self.label), self.getOrDefault(self.out))


class _Fitted(Transformer, _Saved):
    """A step with learned state."""
    state = Param(Params._dummy(), "state", "what the fit learned, as JSON", TEXT)

    @keyword_only
    def __init__(self, *, state: str = "null"):
        super().__init__()
        self._set(state=state)

    def learned(self):
        return json.loads(self.getOrDefault(self.state))


class ImputeMean(Estimator, _Saved):
    """Means for missing values, and with ``scale`` the ranges for min-max."""
    cols = Param(Params._dummy(), "cols", "numeric columns; none: all", TEXTS)
    exclude = Param(Params._dummy(), "exclude", "columns left as they are", TEXTS)
    scale = Param(Params._dummy(), "scale", "whether to scale to 0 .. 1", FLAG)

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = (), exclude: Sequence[str] = (), scale: bool = False):
        super().__init__()
        self._set(cols=list(cols), exclude=list(exclude), scale=scale)

    def _fit(self, df: DataFrame) -> ImputeMeanModel:
        cols = self.getOrDefault(self.cols) or C.numeric_columns(df, self.getOrDefault(self.exclude))
        st = fit_impute_minmax(df, cols)
        return ImputeMeanModel(state=json.dumps({"scale": self.getOrDefault(self.scale), "mean": _plain(st.mean), "lo": _plain(st.lo),
                                                 "hi": _plain(st.hi)}))


def _plain(values: dict) -> dict:
    return {k: None if v is None else float(v) for k, v in values.items()}


class ImputeMeanModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        got = self.learned()
        there = [c for c in got["mean"] if c in df.columns]
        if got["scale"]:
            st = MinMaxState(*({c: got[k][c] for c in there} for k in ("mean", "lo", "hi")))
            return apply_impute_minmax(df, st)
        return df.withColumns({c: F.coalesce(C.q(c).cast("double"), F.lit(got["mean"][c]).cast("double")) for c in there})


class QuantileScale(Estimator, _Saved):
    """Quantile knots of the columns, over all rows."""
    cols = Param(Params._dummy(), "cols", "columns; none: all numeric ones", TEXTS)
    exclude = Param(Params._dummy(), "exclude", "columns left as they are", TEXTS)
    quantiles = Param(Params._dummy(), "quantiles", "references", WHOLE)

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = (), exclude: Sequence[str] = (), quantiles: int = 1000):
        super().__init__()
        self._set(cols=list(cols), exclude=list(exclude), quantiles=quantiles)

    def _fit(self, df: DataFrame) -> QuantileScaleModel:
        cols = self.getOrDefault(self.cols) or C.numeric_columns(df, self.getOrDefault(self.exclude))
        m = QuantileModel.fit(df, cols, n_quantiles=self.getOrDefault(self.quantiles))
        return QuantileScaleModel(state=json.dumps({"features": m.features, "knots": m.knots, "lo": m.ref_lo, "hi": m.ref_hi}))


class QuantileScaleModel(_Fitted):
    def model(self) -> QuantileModel:
        got = self.learned()
        return QuantileModel(got["features"], got["knots"], got["lo"], got["hi"])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.model().transform(df, compact=True)      # earlier stages compute its columns


def flow_stages(label: str = "Label", keep: Sequence[str] = (), identifiers: Sequence[str] = C.FLOW_IDENTIFIERS_SCORING,
                redundant: Sequence[str] = C.REDUNDANT_FEATURES, quantiles: int = 1000) -> list:
    """T8's steps from raw flows to scaled features; ``keep`` names row keys, which pass through."""
    own = [c for c in keep]
    return [InfinitiesToNull(), DropColumns(names=[c for c in identifiers if c not in own]), DropColumns(names=list(redundant)),
            LabelToInt(label=label), DropZeroColumns(keep=[*own, L.TRAFFIC_TYPE]),
            QuantileScale(exclude=[*own, L.TRAFFIC_TYPE], quantiles=quantiles)]


def flow_pipeline(classifier: Sequence, **how) -> Pipeline:
    """One object from raw flows to a score: the steps of ``flow_stages``, then e.g. an assembler and a model."""
    return Pipeline(stages=[*flow_stages(**how), *classifier])
