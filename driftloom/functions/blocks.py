"""Documentation blocks: their vocabulary and the facets each depends on."""

from __future__ import annotations

# Block ids in canonical order, and the facets of the owner that each block is written from.
BLOCK_FACETS = {
    "purpose": ["signature", "placement"],
    "responsibility": ["signature", "deps", "usage"],
    "invariants": ["signature", "body"],
    "dependencies": ["deps"],
    "workflows": ["body", "deps"],
    "limitations": ["body"],
    "changeGuide": ["body", "deps", "usage", "placement"],
}
FACETS = ["signature", "body", "deps", "usage", "placement"]
BLOCKS = list(BLOCK_FACETS)
