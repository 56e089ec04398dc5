"""Top-level object: named workspaces over one session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from relquill.sources.workspace import Workspace


class Engine:
    """Workspaces by name; each is an isolated namespace of tables and id counters."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._open: dict[str, Workspace] = {}

    def workspace(self, name: str = "default") -> Workspace:
        if name not in self._open:
            self._open[name] = Workspace(self.spark, name)
        return self._open[name]

    def close(self, name: str = "default") -> None:
        """Closing is final for the workspace object; the name may be opened anew."""
        if name in self._open:
            self._open.pop(name).close()
