"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

from sonoframe.plans import audio, catalogs, deliveries, labels, readouts, signal, voting

_MODULES = [signal, deliveries, catalogs, voting, readouts, audio, labels]
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
