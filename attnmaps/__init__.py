"""attnmaps: Spark jobs for click annotations, attention maps and agreement scores."""
