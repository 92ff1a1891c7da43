from simplexspark.sources.stages import cut, load_stage, materialise, save_stage, scratch_root, stage_scope
from simplexspark.sources.tables import read_polygons, read_raster, read_table

__all__ = [
    "cut", "load_stage", "materialise", "read_polygons", "read_raster", "read_table",
    "save_stage", "scratch_root", "stage_scope",
]
