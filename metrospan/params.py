"""Study parameters held on the driver."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StudyParameters:
    # The defaults of the study.
    origin: str = "SYNTHETIC"
    seed: int = 0
    w_um: float = 30.0
    h_um: float = 30.0
    faces: int = 4
    wall_materials: tuple = ("pdms", "pdms", "glass", "pdms")
    end_material: str = "pdms"
    end_rate_ratio: float = 1.0
    C0_mol_m3: float = 50.0
    Vm_m3_mol: float = 1.45e-5
    D_ref_m2_s: float = 6e-10
    D_ref_T_C: float = 25.0
    eta_ref_Pa_s: float = 0.00089
    gly_basis: str = "mass_pct"
    ar_ladder: tuple = (9, 13, 18, 25, 35, 49)
    top_offset_um: float = 50.0
    window_half_um: float = 16.0
    tile_px: int = 32
    wall_margin_px: int = 4
    invalid_pixel_fraction_max: float = 0.01
    t_min: float = 1e-4
    t_max: float = 2.0
    sc_target: float = 0.90
    inner_splits: int = 3
    map_observable: str = "endpoints"
    map_ar_limit: float = 1000000.0
    induction_fraction: float = 0.05
    nonlinear_alpha: float = 0.05
    allow_flagged_growth: bool = False
    min_top_nm: float = 1.0

    def reactive_materials(self) -> list[str]:
        """Materials whose rate the configured channel needs."""
        need = {m for m in self.wall_materials[: self.faces] if m != "inert"}
        if self.end_material != "inert" and self.end_rate_ratio > 0:
            need.add(self.end_material)
        return sorted(need)
