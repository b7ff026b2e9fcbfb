"""Panel assembly, cleaning, universe and membership."""
