"""Importing this module registers every catalogue query."""

from __future__ import annotations

import orrery.operators.attributes
import orrery.operators.batches
import orrery.operators.dealers
import orrery.operators.drains
import orrery.operators.enrichment
import orrery.operators.image_colour
import orrery.operators.intake
import orrery.operators.keyword_index
import orrery.operators.listing
import orrery.operators.monitor
import orrery.operators.planner
import orrery.operators.prices
import orrery.operators.quality
import orrery.operators.records
import orrery.operators.resolve
import orrery.operators.sanitize
import orrery.operators.search  # noqa: F401
from orrery.registry import ORACLES, QUERIES  # noqa: F401
