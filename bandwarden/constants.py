"""Fixed values of the instrument, the calibration and the survey rules."""
from __future__ import annotations

import math

# --- instrument geometry (fixed values) -------------------------------------
BAND_TOP_HZ = 800.0e6
BAND_WIDTH_HZ = 400.0e6
COARSE_CHANNELS = 1024
SAMPLE_RATE_HZ = BAND_WIDTH_HZ / COARSE_CHANNELS          # 390625 Hz
SAMPLE_PERIOD_S = 2.56e-6
FRAME_SAMPLES = 16384
WINDOW_SAMPLES = 128
FINE_PAD = 2
FINE_BINS = FINE_PAD * FRAME_SAMPLES // WINDOW_SAMPLES    # 256
COARSE_BIN_HZ = SAMPLE_RATE_HZ / WINDOW_SAMPLES
FINE_BIN_HZ = COARSE_BIN_HZ / FINE_BINS
FRAME_SECONDS = FRAME_SAMPLES * SAMPLE_PERIOD_S
COARSE_MHZ = BAND_WIDTH_HZ / COARSE_CHANNELS / 1e6
STREAMS = 2048
REFERENCE_OFFSET_BINS = 2

# --- television allocation (fixed values) -----------------------------------
FIRST_CHANNEL = 14
LAST_CHANNEL = 69
LAST_ALLOCATION = 36
FIRST_CHANNEL_LOWER_EDGE_HZ = 470.0e6
CHANNEL_WIDTH_HZ = 6.0e6
PILOT_OFFSET_HZ = 309441.0
CHANNEL_MATCH_TOLERANCE_HZ = SAMPLE_RATE_HZ / 2

# --- unit conversions (fixed values) ----------------------------------------
PILOT_BELOW_DATA_DB = 11.3
CAPTURE_EFFICIENCY = 1.0
SHELF_BANDWIDTH_HZ = 6.0e6
SPREADING_DB = 10.0 * math.log10(SHELF_BANDWIDTH_HZ / COARSE_BIN_HZ)
EXCESS_TO_SHELF_DB = PILOT_BELOW_DATA_DB - SPREADING_DB
THRESHOLD_MAX_DENOMINATOR = 2**32
EMPIRICAL_MAX_DENOMINATOR = 2**16
Q16_ONE = 65536

# --- site and calendar (fixed values) ---------------------------------------
LONGITUDE_EAST_DEG = -119.6175
CIVIL_ZONE = "America/Vancouver"
SOLAR_OFFSET_HOURS = LONGITUDE_EAST_DEG / 15.0
SURVEY_MONTH0 = 2018 * 12 + 11
SEASONS = ("DJF", "MAM", "JJA", "SON")

# --- frame gate (fixed values) ----------------------------------------------
POWER_CEILING = 128.0
REASONS = (
    "detector_invalid",
    "detector_powers_all_zero",
    "baseband_power_nonfinite",
    "baseband_power_out_of_complex_int4_bounds",
    "baseband_power_at_negative_full_scale_ceiling",
    "coarse_power_ratio_nonfinite",
    "fine_power_ratio_nonfinite",
    "fine_power_ratio_negative",
)
GATE_VERSION = "frame_gate_v1"

# --- core, tail and calibration windows (fixed values, in units of mu0) ------
CORE_WINDOW = 6.0e-3
TAIL_EDGE = 12.0e-3
GEOMETRY_BOUND = 20.0e-3
MIN_CORE_FRACTION = 0.15
MIN_NULL_FROM_MASK = 0.20
ETA_LADDER = (1.0, 1.1, 1.2, 1.4, 2.0, 5.0)
NULL_PROBES = ((0.32, 1.0), (0.05, 1.96), (0.003, 2.9677))
FLOOR_SIGMAS = 3.0902
NULL_TOLERANCE_DB = 0.20
CARRIER_DOMINATED_DB = 3.0
EXCISE_OCCUPANCY = 0.50
CLEAN_OCCUPANCY = 0.10
TRUNCATED_WINDOW_SD = 0.8796
MAD_SCALE = 1.4826
WILSON_Z = 1.959963984540054

# --- eras (fixed values) ----------------------------------------------------
ERA_MIN_MONTHS = 6
ERA_MIN_DAYS = 270.0
ERA_MIN_STEP_DB = 2.0
ERA_Z = 4.0
ERA_MAX = 5
DAYS_PER_MONTH = 30.44

# --- fine spectra (fixed values) --------------------------------------------
LINE_RATIO = 1.5
ANCHOR_HALF_WIDTH = 30
LINE_HALF_WIDTH = 2
ANCHOR_MIN_FRAMES = 30
ANCHOR_MIN_PERSISTENCE = 0.10
ANCHOR_MIN_MARGIN = 0.02
ANCHOR_CLEAR_HALF_WIDTH = 5
CFAR_GUARD_BINS = 1
CFAR_P_FA = 1.0e-3
CFAR_LEFT_QUANTILE = 0.1587
CFAR_FALLBACK_FRACTION = 0.20
CFAR_FALLBACK_LOCATION = 0.25
CFAR_FALLBACK_LEFT = 0.02275

# --- service classes (fixed values) -----------------------------------------
PRIMARY_CLASSES = ("primary", "full_service", "full_power", "fs", "dt", "dtv")
NON_PRIMARY_CLASSES = (
    "non_primary", "translator", "translator_lptv", "tx_translator", "repeater",
    "rebroadcaster", "relay", "lptv", "low_power", "low_power_lptv", "ld", "dc", "class_a",
)

# --- scale limits ------------------------------------------------------------
# A group of at most this many rows may be sorted or held by one task; larger
# groups take the split path of the operator that needs them.
HOT_GROUP_ROWS = 1_000_000
# A side of at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000
# A group of at most this many rows may be one sorted array.
MODE_ROWS = 200_000
