"""Tellurion: ellipsoid-accurate spatial analytics as PySpark DataFrame operations."""

__version__ = "0.1.0"


def version() -> str:
    return __version__
