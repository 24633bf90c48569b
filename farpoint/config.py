"""Constants and settings."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Radius (m), rotation period (s), halo speeds (km/s), mass flux (g/s) and diffusivities (m^2/Myr).
RADIUS_M = 1_737_400.0
PERIOD_S = 27.321661 * 86_400.0
OMEGA = 2.0 * math.pi / PERIOD_S
AREA_KM2 = 4.0 * math.pi * (RADIUS_M / 1e3) ** 2
V_CIRCULAR, V_ESCAPE = 220.0, 544.0
FLUX_G_S = 2.277
KAPPA = 1.6
KAPPA_LOW, KAPPA_HIGH, ANOMALOUS = 0.5, 5.5, 56.0
SECONDS_PER_MYR = 1e6 * 365.25 * 86_400.0


@dataclass(frozen=True)
class Settings:
    """What steers detection, pairing, scoring and the null model."""

    # The defaults that users expect.

    grid_step_deg: float = 2.0
    max_grid_points: int = 0
    max_resolution_mpp: float = 2.0
    feature_count: int = 40
    chip_size_px: int = 1024
    chip_span_m: float = 1200.0
    radius_range_m: tuple[float, float] = (1.0, 10.0)
    n_scales: int = 30
    peak_quantile: float = 0.9994
    min_depth_proxy: float = 0.22
    min_circularity: float = 0.55
    min_radius_px: float = 3.0
    confident_radius_px: float = 5.0
    sigma_position_deg: float = 0.5
    weight_strength: float = 0.7
    weight_contrast: float = 0.3
    nls_scale: float = 3.0
    rcr_scale: float = 8.0
    sigma_nls: float = 0.71
    sigma_rcr: float = 1.92
    max_nls_diff: float = 1.5
    max_rcr_diff: float = 4.0
    min_separation_deg: float = 30.0
    max_radius_diff_m: float = 2.0
    sigma_radius: float = 5.0
    cone_reliable_deg: float = 2.0
    cone_deg: float = 10.0
    sigma_ellipticity: float = 0.04
    sigma_orientation_deg: float = 3.0
    max_pairs: int = 500_000
    trials: int = 2000
    seed: int = 42
    alpha: float = 0.05


DEFAULT = Settings()
