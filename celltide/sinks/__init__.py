"""Writers of rasters and grids."""
