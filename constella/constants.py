"""Fixed values of the matching method: results depend on each of them."""

# Neighbours and template
NEIGHBOUR_RANK = 3
RADIUS_FACTOR = 1.5
FALLBACK_RADIUS = 200
SEARCH_FACTOR = 0.75
MAX_SEARCH_DISTANCE = 50
OFFSET_ANGLE = 30

# Scores
SKIP_COST = 50.0
DEVIATION_SCALE = 20.0
SELECTIVITY_SCALE = 0.5
GEOMETRY_SCALE = 1.0
TINY = 1e-6
TOP_MATCHES = 16
OVERRIDE_PERCENTAGE = 999.0
PAGE_SIZE = 9

# Particles and raster steps
MIN_PARTICLE_SIZE = 1
RED = (240, 5, 5)
GREEN = (5, 240, 5)
BLACK_BELOW = 10
CORNER_RUN = 10
GREEN_LEAST = 10
GREEN_MAX_THICKNESS = 10
EDGE_COVERAGE = 0.8
WHITE_FACTOR = 1.5
GREY_AGGREGATE = 100
COLOUR_AGGREGATE = 20
HALO_DILATIONS = 6
HALO_SIGMA = 3.0
OPENING_SIZE = 31
THRESHOLD_BLOCK = 15
THRESHOLD_OFFSET = 3.0
OUTER_FRAME = 5
