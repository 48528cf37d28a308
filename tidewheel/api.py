"""The interface of a deployment: queries, label listings, rendering, writes. Results are frames; the JSON forms are for small, displayed results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidewheel.operators.frames import SECOND, Matcher, SeriesSource
from tidewheel.plans import pipes, promql_parser
from tidewheel.plans.graphite import Renderer
from tidewheel.plans.promql import LOOKBACK, Engine
from tidewheel.sources import ingest, render


@dataclass
class Api:
    source: SeriesSource
    lookback: int = LOOKBACK
    compat: str = "native"
    max_series: int | None = None
    require_exhaustive: bool = False

    @property
    def engine(self) -> Engine:
        return Engine(self.source, self.lookback, self.compat)

    def query_range(self, query: str, start: float, end: float, step: float) -> DataFrame:
        return self.engine.query_range(query, start, end, step)

    def query_instant(self, query: str, at: float) -> DataFrame:
        return self.engine.query_instant(query, at)

    def query_range_json(self, query: str, start: float, end: float, step: float) -> str:
        frame, whole = self._limited(self.query_range(query, start, end, step))
        parts = (r["json"] for r in render.matrix_json(frame).toLocalIterator())
        return "".join(render.response("matrix", parts, [] if whole else [f"only {self.max_series} series are shown"]))

    def query_instant_json(self, query: str, at: float) -> str:
        frame, whole = self._limited(self.query_instant(query, at))
        parts = (r["json"] for r in render.vector_json(frame).toLocalIterator())
        return "".join(render.response("vector", parts, [] if whole else [f"only {self.max_series} series are shown"]))

    def _limited(self, frame: DataFrame) -> tuple[DataFrame, bool]:
        return (frame, True) if self.max_series is None else render.limited(frame, self.max_series, self.require_exhaustive)

    def series(self, selector: str, start: float, end: float) -> DataFrame:
        return self.source.series_list(self._matchers(selector), round(start * SECOND), round(end * SECOND))

    def label_names(self, selector: str | None = None) -> DataFrame:
        return self.source.label_names(self._matchers(selector))

    def label_values(self, label: str, selector: str | None = None) -> DataFrame:
        return self.source.label_values(label, self._matchers(selector))

    def search(self, selector: str | None = None, names: str = ".*") -> DataFrame:
        return self.source.complete_tags(self._matchers(selector), names)

    @staticmethod
    def _matchers(selector: str | None) -> list[Matcher]:
        if selector is None:
            return []
        tree = promql_parser.parse(selector)
        if not isinstance(tree, promql_parser.Selector) or tree.range is not None:
            raise promql_parser.ParseError(f"not a selector: {selector!r}")
        return tree.matchers

    @staticmethod
    def parse(query: str) -> str:
        """The query's canonical text."""
        return promql_parser.unparse(promql_parser.parse(query))

    @staticmethod
    def threshold(query: str) -> tuple[str, str, float]:
        return promql_parser.threshold(query)

    def render(self, targets: list[str], start: str | int, until: str | int, step: int, max_points: int | None = None, now: float | None = None) -> list[DataFrame]:
        """One frame per dotted-path target; ``step`` in seconds."""
        renderer = Renderer(self.source, now)
        return [renderer.render(t, start, until, step * SECOND, max_points) for t in targets]

    def find(self, glob: str) -> DataFrame:
        return Renderer(self.source).find(glob)

    def pipeline(self, text: str, start: float, end: float, step: float) -> DataFrame:
        return pipes.Pipes(self.source, self.lookback).query(text, start, end, step)


#: Writers by format: lines (a frame with a column ``value``) to sample rows.
WRITERS = {"carbon": ingest.carbon, "influx": ingest.influx, "json": ingest.json_write, "remote": ingest.remote_write}
