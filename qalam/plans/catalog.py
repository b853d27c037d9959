"""Imports every query family so that all queries and oracles are registered."""

from qalam.plans import (cleaning, evaluation, files_q, merging, packing, scoring, streams,  # noqa: F401
                         subword, transcripts)
from qalam.plans.registry import ORACLES, QUERIES  # noqa: F401
