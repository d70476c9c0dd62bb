"""Shared plumbing for the library's own ``pyspark.ml`` Estimators.

Fitted state that is small by construction (a few numbers or a bounded level list
per column) is kept as a JSON ``Param``, so models persist through
``DefaultParamsWritable`` and sit inside a ``Pipeline`` like MLlib stages.  A model that
rests on tables or on other models is ``WithParts``: it is saved with them, inside its
folder, and loaded from there, whatever became of the scratch folder that it was fitted in.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame


class HasState(Params):
    state = Param(Params._dummy(), "state", "fitted state as JSON", typeConverter=TypeConverters.toString)

    def _state(self):
        return json.loads(self.getOrDefault(self.state))

    def _set_state(self, value):
        return self._set(state=json.dumps(value))


class ColumnsEstimator(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over ``inputCols`` whose ``_fit_state(df)`` returns a JSON-able state."""

    model_class: type = None

    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(**self._defaults())
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _defaults(self) -> dict:
        return {}

    def _fit(self, dataset):
        model = self.model_class()
        model._set(inputCols=self.getInputCols())
        model._set_state(self._fit_state(dataset))
        for p in self._extra_params():
            model._set(**{p: self.getOrDefault(p)})
        return model

    def _extra_params(self) -> list[str]:
        return []

    def _fit_state(self, df):  # pragma: no cover - abstract
        raise NotImplementedError


class ColumnsModel(Model, HasInputCols, HasState, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()

    def state_dict(self):
        return self._state()


class WithParts(MLReadable, MLWritable):
    """A model saved with its tables and child models.

    ``_parts`` returns (numbers and texts for JSON, tables by name, children by name);
    ``_from_parts`` builds the model from the same, with the paths of the saved tables.
    """

    def _parts(self) -> tuple[dict, dict[str, DataFrame], dict]:
        raise NotImplementedError

    @classmethod
    def _from_parts(cls, values: dict, tables: dict[str, str], children: dict):
        raise NotImplementedError

    def write(self):
        return _PartsWriter(self)

    @classmethod
    def read(cls):
        return _PartsReader(cls)


class _PartsWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        values, tables, children = self.instance._parts()
        extra = {"parts": {"values": values, "tables": list(tables), "children": list(children)}}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=extra)
        for name, table in tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        for name, child in children.items():
            child.write().save(f"{path}/children/{name}")


class _PartsReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = metadata["parts"]
        children = {n: DefaultParamsReader.loadParamsInstance(f"{path}/children/{n}", self.sparkSession) for n in parts["children"]}
        model = self.cls._from_parts(parts["values"], {n: f"{path}/tables/{n}" for n in parts["tables"]}, children)
        model._resetUid(metadata["uid"])
        own = {"state"} if parts["tables"] else set()  # paths of the fit: the saved tables take their place
        DefaultParamsReader.getAndSetParams(model, metadata, skipParams=list(own))
        return model
