"""``GridFrame``: a gridded time series in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.projection import WGS84
from .operators.axes import Axis, RegularAxis, axis_product, coord, measure_axis


@dataclass(frozen=True)
class GridFrame:
    """One row per (time, latitude, longitude), one column per variable.

    A missing value is NULL, or a row that is not there. Axes may be declared;
    otherwise they are measured when an operator first needs them. Latitude
    counts from the north unless ``descending`` says otherwise.
    """

    df: DataFrame
    time: str = "time"
    lat: str = "latitude"
    lon: str = "longitude"
    crs: str = WGS84
    axes: Mapping[str, Axis] = field(default_factory=dict)
    descending: frozenset = frozenset({"latitude"})
    # The grid this one is a part of: its axes are the parent's, cut to the
    # range of what is left, so that an emptied row keeps its place.
    parent: "GridFrame | None" = field(default=None, repr=False)
    _measured: dict = field(default_factory=dict, repr=False, compare=False)
    # The same rows with the column that a stored grid is partitioned by, while
    # only times and variables have been chosen: choices of years prune by it.
    _stored: DataFrame | None = field(default=None, repr=False, compare=False)

    @classmethod
    def of(cls, df: DataFrame, **kwargs) -> "GridFrame":
        """A grid from any table: roles found by name, NaN made NULL, time cast."""
        from .operators.profile import detect_varnames

        found = detect_varnames(df.columns)[0]
        for role, var in (("time", "timevar"), ("lat", "latvar"), ("lon", "lonvar")):
            if kwargs.get(role) is None:
                kwargs[role] = found[var]
            if kwargs[role] is None:
                raise ValueError(f"no column found for the {role} dimension among {df.columns}")
        dims = {kwargs["time"], kwargs["lat"], kwargs["lon"]}
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if f.name == kwargs["time"]:
                c = c.cast("timestamp_ntz")
            elif f.name not in dims and f.dataType.typeName() in ("double", "float"):
                c = F.nanvl(c, F.lit(None).cast(f.dataType))
            cols.append(c.alias(f.name))
        kwargs.setdefault("descending", frozenset({kwargs["lat"]}))
        return cls(df.select(*cols), **kwargs)

    @property
    def dims(self) -> tuple[str, str, str]:
        return self.time, self.lat, self.lon

    @property
    def variables(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.dims]

    def with_df(self, df: DataFrame, lost: Sequence[str] = (), **kwargs) -> "GridFrame":
        """The same grid over other rows; ``lost`` dimensions forget their axis."""
        kept = {d: a for d, a in {**self._measured, **self.axes}.items() if d not in lost}
        if self.parent is not None and {self.lat, self.lon} & set(lost):
            # The new places are not those of the parent any more.
            kept.update({d: self.axis(d) for d in (self.lat, self.lon) if d not in lost})
            kwargs["parent"] = None
        return replace(self, df=df, axes=kept, _measured={}, **{"_stored": None, **kwargs})

    def stored_by(self, column: str) -> "GridFrame":
        """This grid, one of whose variables is the year that its files are partitioned by."""
        return replace(self, df=self.df.drop(column), _stored=self.df, _measured={})

    def _of_times(self, choose, years: tuple[int | None, int | None]) -> "GridFrame":
        """The rows that ``choose`` keeps, all of which lie in ``years``."""
        if self._stored is None:
            return self.with_df(choose(self.df), lost=[self.time])
        column = next(c for c in self._stored.columns if c not in self.df.columns)
        stored = self._stored
        for year, keeps in zip(years, (F.col(column).__ge__, F.col(column).__le__)):
            if year is not None:
                stored = stored.where(keeps(F.lit(year)))
        stored = choose(stored)
        return self.with_df(stored.drop(column), lost=[self.time], _stored=stored)

    def with_axes(self, axes: Mapping[str, Axis]) -> "GridFrame":
        """The same grid with these axes declared."""
        return replace(self, axes={**self.axes, **axes}, _measured={})

    def cropped_to(self, df: DataFrame) -> "GridFrame":
        """A grid of some of this grid's cells, on this grid's axes."""
        return replace(self, df=df, axes={d: a for d, a in self.axes.items() if d == self.time},
                       parent=self, _measured={}, _stored=None)

    def axis(self, dim: str) -> Axis:
        """The axis of ``dim``, measured once if it is not declared."""
        if dim not in self.dims:
            raise ValueError(f"the grid has no dimension {dim}")
        if dim in self.axes:
            return self.axes[dim]
        if dim not in self._measured:
            self._measured[dim] = self._cut_axis(dim) if self.parent and dim != self.time else measure_axis(
                self.df, dim, dim in self.descending
            )
        return self._measured[dim]

    def _cut_axis(self, dim: str) -> Axis:
        whole = self.parent.axis(dim)
        v = coord(self.df, dim)
        lo, hi = self.df.agg(F.min(v), F.max(v)).first()
        if lo is None:
            raise ValueError("the grid is empty")
        if isinstance(whole, RegularAxis):
            i, j = sorted(round((end - whole.first) / whole.step) for end in (lo, hi))
        else:
            i, j = whole.df.where(F.col("value").isin(lo, hi)).agg(F.min("idx"), F.max("idx")).first()
        return whole.slice(i, j)

    def product(self) -> DataFrame:
        """All combinations of the axes of this grid."""
        return axis_product(self.df.sparkSession, self.df, self.dims, [self.axis(d) for d in self.dims])

    # Operators as methods, for chains -------------------------------------

    def select_variables(self, *variables: str) -> "GridFrame":
        """Keep the chosen variables; the scan reads no others."""
        missing = [v for v in variables if v not in self.variables]
        if missing:
            raise ValueError(f"the grid has no variables {', '.join(missing)}")
        stored = self._stored
        if stored is not None:
            stored = stored.select(*self.dims, *variables, *[c for c in stored.columns if c not in self.df.columns])
        return self.with_df(self.df.select(*self.dims, *variables), _stored=stored)

    def select_time_range(self, start=None, end=None) -> "GridFrame":
        """Times between two ends, both included. Of a stored grid only the folders of those years are read."""
        from .operators.time_select import range_years, select_time_range

        return self._of_times(lambda df: select_time_range(df, self.time, start, end), range_years(start, end))

    def select_time_cond(self, **conditions) -> "GridFrame":
        """Times of certain years, months, days and hours. Of a stored grid only the folders of those years are read."""
        from .operators.time_select import select_time_cond, selected

        years = selected(conditions.get("years"), conditions.get("year_range"))
        return self._of_times(lambda df: select_time_cond(df, self.time, **conditions), (years[0], years[-1]) if years else (None, None))

    def select_spatial(self, polygons: DataFrame, **kwargs) -> "GridFrame":
        from .operators.grid_spatial import select_spatial

        return select_spatial(self, polygons, **kwargs)

    def thin(self, n) -> "GridFrame":
        from .operators.reshape import thin

        return thin(self, n)

    def coarsen(self, windows, **kwargs) -> "GridFrame":
        from .operators.reshape import coarsen

        return coarsen(self, windows, **kwargs)

    def resample_time(self, quantity=1, unit="day", **kwargs) -> "GridFrame":
        from .operators.resample import resample_time

        return resample_time(self, quantity, unit, **kwargs)

    def reindex_like(self, other: "GridFrame") -> "GridFrame":
        from .operators.reshape import reindex_like

        return reindex_like(self, other)

    def regrid_to(self, target, method="nearest") -> "GridFrame":
        from .operators.regrid import regrid_to

        return regrid_to(self, target, method)

    def group_stats(self, var: str, by: Sequence[str] = (), **kwargs) -> DataFrame:
        from .operators.stats import groupby_multi_time

        return groupby_multi_time(self, var, by, **kwargs)

    def zonal_stats(self, polygons: DataFrame, id_col: str, var: str, by: Sequence[str] = (), **kwargs) -> DataFrame:
        from .operators.grid_spatial import groupby_poly_time

        return groupby_poly_time(self, polygons, id_col, var, by, **kwargs)
