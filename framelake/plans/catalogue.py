"""All registered queries and their SQL; importing the modules registers them."""

from . import documents, files, raster, records, relations
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "documents", "files", "raster", "records", "relations"]
