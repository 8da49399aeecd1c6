"""Fixed values of the hydraulic and display rules, all overridable per call."""

# Depth at or below which a cell counts as dry on displays, in metres.
DISPLAY_DRY_M = 0.01
# Accuracy gate thresholds.
FLOODED_M = 0.05
MIN_IOU = 0.90
MAX_MEDIAN_DIFF_M = 0.03
MAX_P95_DIFF_M = 0.10
MAX_VOLUME_REL_DIFF = 0.02
# Manning roughness of ground, road and building perimeter.
MANNING_GROUND = 0.050
MANNING_ROAD = 0.030
MANNING_PERIMETER = 0.060
# Elevation providers in priority order.
DEM_PROVIDERS = ["DEM1A", "DEM5A", "DEM5B", "DEM5C", "DEM10B"]
# Share of interior cells that may lack elevation before an area is refused.
MAX_INTERIOR_MISSING = 0.02
# Mean Earth radius in km, used by the haversine distance.
EARTH_RADIUS_KM = 6371.0088
# Web-mercator latitude limit and half world width.
MERCATOR_MAX_LAT = 85.05112878
MERCATOR_HALF_WORLD_M = 20037508.342789244
# GRS80 / WGS84 semi-major axis and WGS84 flattening.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
# Durations (minutes) every ranking source must cover.
REQUIRED_DURATIONS = [10, 60, 1440]
# Rain-measuring station types kept from the station master.
RAIN_STATION_TYPES = ["四", "三", "官", "雨"]
# Ranking row labels (NFKC, no blanks) and the duration they stand for.
RANK_LABEL_MINUTES = {
    "日最大10分間降水量の多い方から": 10,
    "日最大10分間降水量(mm)": 10,
    "日最大1時間降水量(10分間隔)の多い方から": 60,
    "日最大1時間降水量(10分間隔)の多い方から(mm)": 60,
    "日最大1時間降水量(mm)": 60,
    "日降水量": 1440,
    "日降水量の多い方から": 1440,
    "日降水量(mm)": 1440,
}
# Run life cycle.
RUN_SEQUENCE = [
    "CREATED", "VALIDATING", "ACQUIRING_TERRAIN", "ACQUIRING_VECTORS",
    "ACQUIRING_RAINFALL", "PREPROCESSING_TERRAIN", "ALLOCATING_ROOF_RAIN",
    "BUILDING_GRID", "BUILDING_MODEL", "ENSURING_ENGINE", "RUNNING_ENGINE",
    "READING_RESULTS", "COMPLETE",
]
TERMINAL_STATES = ["COMPLETE", "FAILED", "CANCELLED"]
# Block sizes of the multi-resolution map and the plane-fit limits per size:
# (rmse, largest residual, curvature, detrended relief) in metres.
LEVELS_M = [1, 2, 4, 8]
BLOCK_LIMITS = {
    2: (0.03, 0.10, 0.08, 0.18),
    4: (0.04, 0.12, 0.08, 0.22),
    8: (0.05, 0.15, 0.08, 0.28),
    16: (0.06, 0.20, 0.10, 0.36),
    32: (0.08, 0.25, 0.12, 0.45),
}
CONNECTIVITY_RELIEF_M = 0.05
STRUCTURE_CURVATURE_M = 0.05
STRUCTURE_RELIEF_M = 0.05
# Metric buffers: hard structures, inner and outer terrain structure, target radii.
STRUCTURE_BUFFER_M = 2.0
TERRAIN_INNER_M = 2.0
TERRAIN_OUTER_M = 6.0
TARGET_CORE_M = 100.0
TARGET_MID_M = 250.0
TARGET_MID_CEILING = 2
# Readable class-edge mantissas.
NICE_MANTISSAS = [1, 1.25, 1.5, 2, 2.5, 3, 4, 5, 7.5, 10]
# Cells per side of a processing tile.
TILE = 256
# Display palettes: depth bands (lower edge in m, rgba), elevation ramp (rgba),
# block size (m, rgba) and flow speed (hex).
DEPTH_BANDS = [
    (0.00, (198, 232, 255, 210)),
    (0.05, (91, 177, 255, 215)),
    (0.10, (64, 110, 222, 220)),
    (0.20, (126, 82, 196, 225)),
    (0.40, (196, 65, 139, 230)),
    (0.80, (109, 27, 74, 235)),
    (1.60, (73, 18, 52, 240)),
]
ELEVATION_COLOURS = [
    (49, 54, 149, 220), (69, 117, 180, 220), (0, 183, 212, 220), (26, 152, 80, 220),
    (253, 231, 37, 220), (253, 174, 97, 220), (244, 109, 67, 220), (165, 0, 38, 220),
]
BLOCK_COLOURS = {
    1: (38, 70, 83, 210), 2: (42, 111, 151, 210), 4: (61, 145, 128, 210),
    8: (122, 168, 116, 210), 16: (186, 188, 125, 210), 32: (208, 200, 173, 210),
}
FLOW_COLOURS = ["#2DC4B2", "#3BB2D0", "#3F51B5", "#8E44AD", "#E74C3C", "#A52A2A", "#7F0000"]
