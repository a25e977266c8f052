"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from ledgerlake.plans import audits, ledger, relational, streams, writes  # noqa: F401  (they register queries)
from ledgerlake.plans.base import ORACLE, QUERIES  # noqa: F401
