"""The insights report: every panel over one session frame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom import runtime
from clickloom.operators import envelope, insights, periods, sessions


@contextmanager
def insights_report(events: DataFrame, as_of, days: int | None = 7, **options) -> Iterator[Panels]:
    """Panels of the report by name. What they share is written below one folder in the
    shared directory, which goes away with the ``with`` block."""
    spark = events.sparkSession
    folder = runtime.run_dir(spark, "report")
    try:
        yield build(events, as_of, days, keep=lambda frame: written(frame, folder), **options)
    finally:
        runtime.remove(spark, folder)


def written(frame: DataFrame, folder: str | None = None) -> DataFrame:
    """Keep a frame as a table in the shared folder: losing an executor loses nothing.

    Without a folder the table goes away when the driver's Python ends.
    """
    spark = frame.sparkSession
    path = f"{folder or runtime.passing_dir(spark, 'report')}/{uuid.uuid4().hex[:12]}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def build(
    events: DataFrame, as_of, days: int | None = 7, comparison: str = "prior",
    window_seconds: int | None = None, dedupe: bool = True,
    keep: Callable[[DataFrame], DataFrame] = written,
) -> Panels:
    """The panels; ``keep`` decides how what several panels read is held.

    Kept are the deduplicated events of both periods with the columns the panels use,
    the session frame, the KPIs, the board counts and the hourly counts, each when a
    panel first asks for it. So the raw table is read and shuffled by event id once,
    however many panels are asked for, and one panel alone writes only what it needs.
    """
    seconds = window_seconds or periods.window_days(days) * periods.DAY
    span = 2 * seconds if comparison == "prior" else seconds
    rows = periods.events_in_window(events, span, as_of)
    rows = envelope.dedupe_events(rows) if dedupe else rows

    def of_current(held: DataFrame) -> DataFrame:
        return held.where(F.col("period") == periods.CURRENT).drop("period")

    @cache
    def both() -> DataFrame:
        return keep(periods.split_periods(rows, seconds, as_of, comparison).select("period", *COLUMNS))

    def current() -> DataFrame:
        return of_current(both())

    @cache
    def frames() -> DataFrame:
        return keep(sessions.session_frame(both(), "period"))

    def frame() -> DataFrame:
        return of_current(frames())

    @cache
    def boards() -> DataFrame:
        return keep(insights.board_counts(current()))

    @cache
    def hours() -> DataFrame:
        return keep(insights.hourly_activity(current()))

    @cache
    def by_period() -> DataFrame:
        return keep(insights.kpis_from(frames(), insights.actor_flags(both(), "period"), "period"))

    def prepare() -> None:
        both()
        # independent jobs over the same events: submitted together they fill the cluster
        with ThreadPoolExecutor(3) as pool:
            list(pool.map(lambda table: table(), (frames, boards, hours)))

    return Panels({
        "kpis": lambda: of_current(by_period()),
        "kpi_comparison": lambda: insights.kpi_comparison(by_period()),
        "funnel": lambda: insights.funnel(frame()),
        "activity_trends": lambda: insights.trends_from(hours(), frame(), insights.is_hourly(seconds)),
        "activity_heatmap": lambda: insights.heatmap_from(hours()),
        "time_to_convert": lambda: insights.time_to_convert(frame()),
        "visitor_mix": lambda: insights.visitor_mix(both()),
        "boards": lambda: insights.board_tops(boards()),
        **{name: lambda name=name: insights.board_top(boards(), name) for name in insights.BOARDS},
        "blueprint_treemap": lambda: insights.treemap_from(boards()),
        "top_paths": lambda: insights.top_paths(current()),
        "recent_converters": lambda: sessions.recent_converters(current(), frame=frame()),
        "all_sessions": lambda: sessions.session_rows(current(), frame=frame()),
        "session_summary": lambda: sessions.session_summary(frame()),
    }, prepare)


class Panels(Mapping):
    """Panels by name, each defined when it is asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]], prepare: Callable[[], None]) -> None:
        self._builders = builders
        #: Write the shared tables at once, for callers who want most panels.
        self.prepare = prepare

    def __getitem__(self, name: str) -> DataFrame:
        return self._builders[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


#: Event columns the panels read.
COLUMNS = (
    "event_id", "event_name", "properties_json", "user_id", "anonymous_id", "page_path", "kafka_partition",
    "kafka_offset", "received_at", "session_key", "actor_key",
)
#: Panels small enough for the flat form, with their label and value columns.
FLAT = {
    "funnel": ("step", ("sessions", "rate_pct")),
    "activity_trends": ("label", ("events", "sessions", "form_submissions")),
    "top_paths": ("path", ("sessions", "converted", "conversion_rate_pct")),
}
SINGLE = ("kpis", "kpi_comparison", "time_to_convert", "visitor_mix", "session_summary")


def flat_report(panels: Panels) -> DataFrame:
    """One long frame (panel, label, metric, value) of every fixed-size panel."""
    panels.prepare()
    parts = []
    for name, (label, values) in FLAT.items():
        parts.append(_long(panels[name], name, F.col(label), values))
    metric = F.create_map(*[F.lit(x) for b, spec in insights.BOARDS.items() for x in (b, spec.count)])
    parts.append(
        panels["boards"].select(
            F.col("board").alias("panel"), "label", F.element_at(metric, F.col("board")).alias("metric"),
            F.col("n").cast("double").alias("value"),
        )
    )
    for name in SINGLE:
        panel = panels[name]
        parts.append(_long(panel, name, F.lit(""), panel.columns))
    flat = parts[0]
    for part in parts[1:]:
        flat = flat.unionByName(part)
    return flat


def _long(panel: DataFrame, name: str, label, values) -> DataFrame:
    entries = [F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]
    return panel.select(F.lit(name).alias("panel"), label.alias("label"), F.inline(F.array(*entries)))
