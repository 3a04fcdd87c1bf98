"""Tolerances and thresholds.  All of them are plain parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass

MM_PER_INCH = 25.4
MM_PER_PT = 25.4 / 72.0


@dataclass(frozen=True)
class Recognition:
    """Tolerances of page recognition, in model millimetres."""

    min_segment_len: float = 0.05
    dimension_assoc_radius: float = 75.0
    circle_fit_tol: float = 0.25
    closed_loop_min_area: float = 100.0
    min_dimension_confidence: float = 0.3
    table_gap: float = 12.0
    table_min_cells: int = 4
    region_gap: float = 50.0
    region_min_prims: int = 3
    assembly_prims: int = 50


@dataclass(frozen=True)
class Hatching:
    """A hatch is a set of near-parallel, evenly spaced lines of similar length."""

    min_lines: int = 6
    angle_tol_deg: float = 3.0
    spacing_cv: float = 0.35
    length_cv: float = 0.50
    min_spacing: float = 0.3
    min_len: float = 0.5


@dataclass(frozen=True)
class ArcFit:
    """Arc and circle promotion."""

    tol_mm: float = 0.05
    min_arc_deg: float = 5.0
    max_segments: int = 64
    loose_tol_mm: float = 0.20
    loose_min_deg: float = 8.0


@dataclass(frozen=True)
class ContentClass:
    """Thresholds that separate real vector pages from glyph and fill floods."""

    glyph_drawings: int = 1500
    glyph_fill: float = 0.75
    glyph_tiny: float = 0.45
    glyph_blocks: int = 50
    glyph_words: int = 400
    glyph_stroke_max: float = 0.05
    fill_drawings: int = 400
    fill_heavy: float = 0.60
    fill_stroke_max: float = 0.22
    pure_ratio: float = 0.95
    pure_stroke_max: float = 0.02
    pure_min_groups: int = 12
    pure_min_items: int = 24
    pure_large_rect: float = 0.03
    complex_ratio: float = 0.98
    complex_stroke_max: float = 0.01
    complex_min_items: int = 3000


@dataclass(frozen=True)
class RasterBudget:
    """Resource limits for page rasters."""

    page_pixels: int = 16_000_000
    page_dimension: int = 8_192
    job_pixels: int = 134_217_728
    min_dpi: float = 36.0
    tile_pixels: int = 1536
    terminal_page_pixels: int = 134_217_728
    terminal_page_dimension: int = 24_576
    terminal_job_pixels: int = 268_435_456
    terminal_job_tiles: int = 512
    composite_images: int = 256
