"""All registered queries of the engine: name -> plan, and name -> SQL."""

from __future__ import annotations

from . import ingest, manifests, scoring, waveforms  # noqa: F401
from .registry import ORACLES as ORACLES
from .registry import QUERIES as QUERIES
