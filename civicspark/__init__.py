"""civicspark: Spark jobs that plan, land, normalise and consolidate
public-spending records from many transparency portals."""

__version__ = "0.1.0"
