"""Schemas of the engine's tables, as DDL."""

RASTER = "struct<height:int,width:int,channels:int,data:binary>"
IMAGE = f"sample_dir string, path string, name string, role string, raster {RASTER}"
PARTICLE = f"sample_dir string, image_key string, role string, particle_id int, min_row int, min_col int, max_row int, max_col int, pixel_count int, center_row int, center_col int, bbox_size int, color array<int>, crop {RASTER}"
PROCESSED = f"sample_dir string, image_key string, role string, path string, error string, warning string, raster {RASTER}, particles array<struct<particle_id:int,min_row:int,min_col:int,max_row:int,max_col:int,pixel_count:int,center_row:int,center_col:int,bbox_size:int,color:array<int>,crop:{RASTER}>>"
PERCENTAGE_CSV = "red_square string, green_square string, percentage string, distance string, base_score string, completeness_ratio string, geometry_consistency string, individual_scores string, particle_details string"
DISTANCE_CSV = "red_square string, green_square string, horizontal_distance string"
PARTICLE_JSON = "id int, corner_coordinates array<array<int>>, center_position array<int>, color array<int>, nearby_particle_ids array<int>, full_particle array<array<array<int>>>, largest_particle_length int, largest_particle_width int"
RELATIONS_JSON = "struct<primary_particle_id:int,relation_ids:array<int>,equivalent_particles:array<array<int>>,offset_angle:double,search_distance_modifier:double,max_search_distance:double>"
CACHE_JSON = f"cache_kind string, schema_version int, image_cache_file string, image_shape array<int>, image_dtype string, image_data array<array<array<int>>>, particles array<struct<{', '.join(f.replace(' ', ':', 1) for f in PARTICLE_JSON.split(', '))}>>, relations {RELATIONS_JSON}, _corrupt_record string"
