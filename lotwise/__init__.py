"""lotwise: marketplace-listing analytics as Spark DataFrame jobs.

Pages (already fetched) or per-source listing files go in; one clean listing
table with a fixed schema, quality reports and snapshots come out.  Every
operator is either a ``Column -> Column`` function or a
``DataFrame -> DataFrame`` transform usable with ``df.transform``.
"""

from lotwise.schema import LISTING, LISTING_COLS, PAGES, CRITERIA  # noqa: F401

__version__ = "0.1.0"
