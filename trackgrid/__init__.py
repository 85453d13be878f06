"""trackgrid: movement tracks, vector features and gridded time series on Spark."""

from .functions.geometry import bbox_to_polygon, geometry_kind
from .functions.headers import clean_headers
from .functions.projection import reproject
from .grid import GridFrame
from .operators.axes import RegularAxis
from .operators.boundary import convex_hull, envelope, hull_features, tracks_extent
from .operators.clip import clip_to_box, clip_to_polygons
from .operators.features import box_features, get_crs, make_features, reproject_features, set_crs
from .operators.grid_spatial import groupby_poly_time, select_spatial
from .operators.overlay import buffer_polygons, dissolve_polygons, polygon_area
from .operators.profile import (
    detect_varnames, feature_schema, profile_features, time_resolution, time_unit_domain, value_range,
)
from .operators.regrid import interpolate_space, regrid_to
from .operators.resample import resample_time
from .operators.reshape import coarsen, concat_time, reindex_like, thin
from .operators.spatial import filter_bbox, filter_polygon, points_in_polygons
from .operators.stats import (
    count_exceeding, first_day_exceeded, groupby_multi_time, sort_stats, spatial_mean_series,
)
from .operators.time_select import (
    select_time_cond, select_time_range, select_time_slice, sort_by_time, time_encoding_days,
)
from .operators.tracks import (
    clip_tracks_timerange, combine_studies, dissolve_points, merge_tracks_ref, track_density,
)
from .plans.explore import explore_grid
from .plans.prepare import prepare_tracks
from .plans.subset import SubsetResult, subset_features
from .session import configure
from .sources.readers import (
    geometry_from_wkt, read_features, read_grid, read_ref, read_studies, read_tracks, stack_rasters_by_date,
)
from .sources.writers import write_features, write_grid, write_stats, write_tracks

__version__ = "0.1.0"
