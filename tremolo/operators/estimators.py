"""Monitors and detectors as pipeline stages, with their settings as params."""

from __future__ import annotations

from dataclasses import fields

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param
from pyspark.sql import DataFrame

from tremolo.operators.monitors import load_model, save_model


class MonitorModel(Model):
    """A fitted monitor or detector; transform adds its columns."""

    def __init__(self, model=None):
        super().__init__()
        self.model = model

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def save(self, path: str) -> None:
        save_model(self.model, path)

    @classmethod
    def load(cls, path: str) -> MonitorModel:
        return cls(load_model(path))


class MonitorEstimator(Estimator):
    """Fits ``kind`` (a class of similarity or monitors) on (id, v, label).

    Each setting of kind that is a number, text or flag is a param of the same name, so that grids,
    copies and pipelines can set it; ``arguments`` go to the fit after the table.
    """

    def __init__(self, kind: type, *arguments, **settings):
        super().__init__()
        self.kind, self.arguments = kind, arguments
        for f in fields(kind):
            if isinstance(f.default, (bool, int, float, str)):
                setattr(self, f.name, Param(self, f.name, f"{kind.__name__}.{f.name}"))
                self._setDefault(**{f.name: f.default})
        self._set(**settings)

    def _fit(self, df: DataFrame) -> MonitorModel:
        made = self.kind(**{p.name: self.getOrDefault(p) for p in self.params})
        return MonitorModel(made.fit(df, *self.arguments))
