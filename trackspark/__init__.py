"""GPS track, elevation, tile and area-coverage analytics as Spark jobs."""
