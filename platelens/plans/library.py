"""All registered queries of the library."""

from . import io_queries, job_queries, proposal_queries, raster_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
