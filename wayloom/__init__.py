"""Spark jobs for gazetteers, place lore, terrain, travel times and map tiles."""
