"""Association genetics for polyploid panels, expressed as Spark jobs."""

__version__ = "0.1.0"
